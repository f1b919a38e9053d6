"""Queries against their check SQL on tables that the small ones do not have the like of."""

import glob
import os

import check_oracle
import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from courtflow.operators import quality as Q


def changed(folder, **tables):
    """The smallest tables with some of them replaced."""
    for file in os.listdir(SF):
        if file.removesuffix(".parquet") not in tables:
            os.symlink(f"{SF}/{file}", folder / file)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same(spark, folder, *names):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}{'/*.parquet' * os.path.isdir(path)}'")
    for name in names:
        status, count, _, note = check_oracle.compare(spark, con, name, folder)
        assert status == "ok" and count, (name, note)


def test_split_with_ties_and_unknown_names(spark, tmp_path):
    # Six against one: on the way to 70, 15 and 15 percent, rounding decides.
    rows = [(i, "x", "en" if i else None, "s", 1) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    same(spark, changed(tmp_path, documents=docs), "d5_leakage_safe_split")


@pytest.mark.parametrize("name", ["f2_frame_box_matching", "a27_detection_metrics", "a27_side_metrics", "a29_strategy_comparison"])
def test_rows_that_share_a_box_id(spark, tmp_path, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    key = F.col("l_partkey") + F.col("l_orderkey")
    again = lines.filter(key % 3 == 0).withColumns({
        "l_quantity": F.col("l_quantity") + F.when(key % 2 == 0, 0.5).otherwise(4.0), "l_partkey": F.col("l_partkey") + key % 3,
        "l_discount": (F.col("l_discount") + 0.03) % 0.11, "l_suppkey": F.col("l_suppkey") + 1})
    odd = lines.unionByName(again).unionByName(lines.filter(key % 5 == 0))
    same(spark, changed(tmp_path, lineitem=odd), name)


def test_shot_numbers_of_long_and_unnumbered_rallies(spark):
    numbers = {
        1: range(1, 201), 2: [None], 3: [*range(1, 130), 7], 4: [1, 2, 2], 5: [1, 2, 3], 6: [1, 63, 2, 3], 7: [*range(1, 100), *range(101, 131), 5],
        8: [0, 1, 2], 9: [-1, 1, 3], 10: [1, None, 3], 11: [1]}
    shots = spark.createDataFrame([(1, r, n) for r, of in numbers.items() for n in of], "match_id long, rally_id long, shot_index long")
    rallies = spark.createDataFrame([(1, r) for r in numbers if r != 11] * 2, "match_id long, rally_id long")
    got = sorted(tuple(r)[1:] for r in Q.shot_violations(shots, rallies).collect())
    bad = [r for r, of in numbers.items() if None in of or sorted(of) != list(range(1, len(of) + 1))]
    assert got == sorted([(r, len(numbers[r]), "index_not_contiguous") for r in bad] + [(11, 1, "unknown_rally")])


def test_shots_are_not_made_distinct_before_corrections_reach_them(spark):
    plan = entry.queries()["j13_correction_targets"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate(") <= 2  # both halves of the one over what came out
