import random
import zlib

from courtflow.llm.sharding import shard_by_bytes, sharded
from helpers import clashing, documents, empty, odd


def test_contiguous_and_balanced(spark):
    rnd = random.Random(1)
    rows = [(i, "é" * rnd.randrange(400)) for i in range(2000)]
    rnd.shuffle(rows)
    got = sorted(shard_by_bytes(documents(spark, rows), 7).collect())
    texts = dict(rows)
    assert [r.doc_id for r in got] == list(range(2000)) and [r.shard for r in got] == sorted(r.shard for r in got)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for s in range(7):
        slots = [r.slot for r in got if r.shard == s]
        assert slots == list(range(len(slots)))


def test_odd_rows(spark):
    df = odd(spark)
    got = shard_by_bytes(clashing(df), 3).collect()
    assert len(got) == df.count() and {r.text_crc32 for r in got if r.size == 8} == {0}
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})
    whole = sharded(clashing(df), 3)
    assert whole.columns == [*clashing(df).columns, "shard", "slot"]
    assert sorted(map(str, whole.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert sorted((r.shard, r.slot) for r in whole.collect()) == sorted((r.shard, r.slot) for r in got)
    assert shard_by_bytes(empty(spark), 3).count() == 0 and sharded(empty(spark), 3).count() == 0


def test_a_third_of_all_rows_alike(spark):
    got = shard_by_bytes(documents(spark, [(5, "same text")] * 500 + [(i, "other") for i in range(1000)]), 5).collect()
    counts = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(counts) - min(counts) <= 40
