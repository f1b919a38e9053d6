"""Pages at any depth and upserts that leave other files alone."""

import random

import pytest
from pyspark.sql import functions as F

from courtflow.sources import store


@pytest.fixture(scope="module")
def shuffled(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), f"k{rng.randrange(40):02d}", i) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "a long, b string, id long").repartition(7)


@pytest.mark.parametrize("offset", [0, 1, 99, 1234, 2950, 2999, 3000, 9000])
def test_any_page_equals_the_sorted_rows(shuffled, offset):
    rows, df = shuffled
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[offset : offset + 100]
    got = store.deep_page(df, F.lit(True), ["a", "b", "id"], 100, offset, few=20).collect()
    assert sorted((r.id, r.total) for r in got) == sorted((r[2], 3000) for r in want)


def test_pages_cover_equal_rows_once(spark):
    rows = [(1, "x")] * 500 + [(1, "y")] * 3 + [(0, "z")] * 7 + [(2, None)] * 40
    df = spark.createDataFrame(rows, "a long, b string").repartition(5)
    got = [tuple(r)[:2] for at in range(0, 600, 50) for r in store.deep_page(df, F.lit(True), ["a"], 50, at, few=5).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert store.deep_page(df, F.col("a") == 9, ["a"], 5, 0).count() == 0
    with pytest.raises(ValueError):
        store.deep_page(df, F.lit(True), ["a"], 0, 0)


def test_upsert_rewrites_only_the_parts_it_touches(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "id long, v string")
    store.write_bucketed(rows, path, "id", 16)
    files = lambda: {p.parent.name: p.name for p in tmp_path.glob("records/part=*/*.parquet")}
    before = files()
    batch = spark.createDataFrame([(3, "new"), (7, None), (900, "more")], "id long, v string")
    store.upsert_touched(batch, path, "id", 16)
    touched = {f"part={r.p}" for r in batch.select(store.bucket_of("id", 16).alias("p")).collect()}
    after = files()
    assert {p for p in after if after[p] != before.get(p)} == touched
    want = {i: f"v{i}" for i in range(200)} | {3: "new", 7: None, 900: "more"}
    stored = spark.read.parquet(path).select("id", "v").collect()
    assert len(stored) == len(want) and {r.id: r.v for r in stored} == want
    store.upsert_touched(batch.limit(0), path, "id", 16)
    assert files() == after
    with pytest.raises(ValueError):
        store.upsert_touched(batch.union(batch), path, "id", 16)


def test_a_page_goes_through_its_rows_twice(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        runs.add(1)
        yield from batches

    df = spark.range(5000, numPartitions=1).mapInArrow(seen, "id long")
    got = store.deep_page(df, F.lit(True), ["id"], 100, 2500, few=20).collect()
    assert sorted(r.id for r in got) == list(range(2500, 2600))
    assert runs.value <= 4  # a checkpoint goes through them to count and again to write
