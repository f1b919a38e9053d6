import random

import duckdb
import pytest
from courtflow.llm.mixing import mix_sources, take
from courtflow.llm.queries import OP9_SQL
from helpers import clashing, documents, empty, odd


def plain_targets(sizes, share=1.5, cap=2, weights=(3, 1, 2)):
    """Sources in order; shared again until none is above its cap."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if weight[k] * level > cap * sizes[k]]
        if not over:
            return out | {k: weight[k] * level for k in open_}
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
            open_.remove(k)
    return out


def test_targets_and_nearness(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(1, 60), None, rnd.choices(["a", "b", "c", "é", None], [60, 5, 20, 10, 5])[0]) for i in range(3000)]
    df = documents(spark, rows)
    got = mix_sources(df).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for source, target in want.items():
        mine = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 60
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    assert sorted(got, key=str) == sorted(mix_sources(df.repartition(3)).collect(), key=str)
    smaller = {r.doc_id: r.taken for r in mix_sources(df, share=1.2).collect()}
    capped = {s for s, t in want.items() if t >= plain_targets(sizes, 1.2)[s]}
    assert all(smaller[r.doc_id] <= r.taken for r in got if r.source in capped)
    rows_taken = take(df)
    assert rows_taken.columns == df.columns and rows_taken.count() == sum(r.passes for r in got)


def test_odd_rows(spark):
    df = odd(spark)
    got = mix_sources(clashing(df)).collect()
    assert len(got) == df.count() and all(r.taken <= 2 * r.size for r in got)
    assert mix_sources(empty(spark)).count() == 0 and take(empty(spark)).count() == 0
    assert take(clashing(df)).columns == clashing(df).columns
    nothing = mix_sources(documents(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0)] * 2


def test_missing_and_repeated_ids_meet_the_targets(spark):
    """Nine of ten rows have no id, half of them one text; ids repeat among the others."""
    rows = [(i % 40 if i % 10 == 0 else None, "w " * (7 if i % 2 else 1 + i % 23), None, "a" if i % 3 else None) for i in range(6000)]
    df = documents(spark, rows).repartition(5)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    for source in ("a", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 23
    assert sorted(got, key=str) == sorted(mix_sources(df.repartition(3)).collect(), key=str)
    wide = take(clashing(df))
    assert wide.count() == sum(r.passes for r in got) and wide.columns == clashing(df).columns


def test_equals_sql_on_missing_and_repeated_ids(spark):
    rows = [(i % 7 if i % 3 else None, None if i % 11 == 0 else "w " * (i % 5), None, (None, "", "a", "b")[i % 4]) for i in range(900)]
    base = duckdb.connect()
    documents_table = documents(spark, rows).toPandas()  # noqa: F841
    base.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents_table")
    want = base.execute(OP9_SQL).fetchall()
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(documents(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
