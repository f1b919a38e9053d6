"""Queries over all rows of their tables: ties, used ids and every type of correction are reported."""

from conftest import SF

import __spark_entry__ as entry


def test_ties_and_used_ids_are_reported(spark, tables):
    got = {(r.match_id, r.rally_id, r.reason) for r in entry.queries()["s6_rally_order_all"](spark, SF).collect()}
    tied = tables.bursts.groupBy("match_id", "start_frame").count().filter("count > 1").count()
    assert any(reason == "duplicate_id" for _, _, reason in got)
    assert tied == 0 or any(reason == "overlaps_previous" for _, _, reason in got)


def test_every_type_of_correction_has_a_snapshot(spark):
    kinds = {r.type for r in entry.queries()["p7_prediction_snapshot_all"](spark, SF).select("type").distinct().collect()}
    assert kinds == {"shot_type", "hitter", "rally_boundary", "player_identity", "bounce"}
