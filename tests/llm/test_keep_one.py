"""One row of each component stays, also where ids repeat or are missing."""

from courtflow.llm.ngram_join import keep_one_of_each
from helpers import clashing, documents

A = "one two three four five six seven eight nine ten eleven twelve"
B = "red orange yellow green blue indigo violet black white grey brown pink"
C = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
NEAR = " ".join(f"n{i}" for i in range(60))


def kept(df):
    return sorted(((r.doc_id, r.text, r.lang) for r in keep_one_of_each(df).collect()), key=str)


def test_repeated_and_missing_ids(spark):
    rows = [(1, A, "en")] * 40 + [(5, B, "en"), (5, C, "en"), (3, B, "en")] + [(None, NEAR, "en")] * 20 + [(None, NEAR + " end", "de")]
    rows += [(9, "", "en"), (9, "", "en"), (None, None, "en"), (None, None, "en")]
    got = kept(clashing(documents(spark, rows)))
    near = [r for r in got if r[1] and r[1].startswith("n0")]
    assert len(near) == 1
    rest = sorted([(1, A, "en"), (3, B, "en"), (5, C, "en"), (9, "", "en"), (9, "", "en"), (None, None, "en"), (None, None, "en")], key=str)
    assert sorted((r for r in got if r not in near), key=str) == rest


def test_named_rows_come_first_and_values_decide_among_one_id(spark):
    rows = [(None, A, "en"), (7, A, "en"), (8, A, "en"), (2, NEAR, "en"), (2, NEAR, "de"), (2, NEAR + " end", "fr")]
    got = kept(documents(spark, rows))
    assert len(got) == 2 and (7, A, "en") in got
    again = kept(documents(spark, list(reversed(rows))))
    assert got == again
