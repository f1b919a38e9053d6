"""Terms come from all labelled rows, whatever the sample for the weights."""

import random

from courtflow.llm.toxicity import learn
from helpers import documents


def test_rare_terms_outside_the_sample_are_learned(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(1000):
        w = [rnd.choice([f"word{k}" for k in range(300)]) for _ in range(30)]
        if i % 5 == 0:
            w[3] = "zyxx" if i % 100 == 0 else "villain"
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "doc_id long, toxic int")
    model = learn(documents(spark, rows), labels, sample=60)
    assert {"zyxx", "villain"} <= set(model.words)
