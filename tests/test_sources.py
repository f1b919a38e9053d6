"""Files in and out."""

import hashlib
import json

import pytest
from conftest import rows_of
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from courtflow.operators import quality as Q
from courtflow.sources import artifacts, racket_pose, store


def test_json_records_under_a_key_and_at_the_root(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "result": {"items": [{"id": 1, "time": {"s": 0.5}}, {"id": 2, "time": {"s": 1.5}}]}}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3, "time": {"s": 2.5}}]))
    schema, fields = "id bigint, time struct<s:double>", {"event": "id", "t_s": "time.s"}
    got = artifacts.read_records(spark, str(tmp_path / "a.json"), schema, "result.items", fields)
    assert rows_of(got, "event", "t_s") == [(1, 0.5), (2, 1.5)]
    assert rows_of(artifacts.read_records(spark, str(tmp_path / "b.json"), schema, None, fields), "event", "t_s") == [(3, 2.5)]


def test_write_once_refuses_to_replace(spark, tmp_path):
    path = str(tmp_path / "out")
    artifacts.write_once(spark.range(3), path)
    with pytest.raises(AnalysisException):
        artifacts.write_once(spark.range(3), path)


def test_content_hash_shows_broken_lineage(spark, tmp_path):
    (tmp_path / "rallies.json").write_text("[1]")
    got = artifacts.content_hashes(spark, str(tmp_path)).first()
    assert got.content_hash == hashlib.sha256(b"[1]").hexdigest()
    rallies = spark.createDataFrame([(1, got.content_hash)], "match_id bigint, content_hash string")
    shots = lambda h: spark.createDataFrame([(1, h)], "match_id bigint, rallies_hash string")
    assert Q.lineage_breaks(shots(got.content_hash), rallies).isEmpty()
    assert Q.lineage_breaks(shots("other"), rallies).count() == 1


def test_upsert_replaces_whole_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id bigint, name string, v double")
    rows.write.parquet(str(tmp_path / "t1"))
    batch = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "id bigint, name string, v double")
    store.upsert_parquet(batch, str(tmp_path / "t1"), str(tmp_path / "t2"), "id")
    assert rows_of(spark.read.parquet(str(tmp_path / "t2")), "id", "name", "v") == [(1, "a", 1.0), (2, None, 9.0), (3, "c", 3.0)]
    with pytest.raises(ValueError):
        store.upsert_parquet(batch.union(batch), str(tmp_path / "t1"), str(tmp_path / "t3"), "id")


def test_page_limits(spark):
    rows = spark.range(50).withColumn("match_id", F.lit(1))
    got = store.page(rows, F.col("match_id") == 1, [F.desc("id")], 5, 10).collect()
    assert sorted(r.id for r in got) == [35, 36, 37, 38, 39] and {r.total for r in got} == {50}
    with pytest.raises(ValueError):
        store.page(rows, F.lit(True), [F.asc("id")], 101, 0)


def test_racket_sequences(spark, tmp_path):
    def put(path, text):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    root = tmp_path / "tennis"
    points = [[x, 540.0] for x in (960.0, 970.0, 980.0, 990.0, 1000.0)]
    left = [[x - 500, y] for x, y in points]
    frames = [[{"keypoints": points, "keypoint_scores": [1.0, 0.5]}, {"keypoints": left, "keypoint_scores": []}], []]
    for rally in ("r1", "r2", "r3"):
        put(root / "interp_ball" / "m1" / rally / "results.csv", "Frame,X,Y,Visibility,Confidence\n0,960,540,1,0.7\n1,10,10,0,1.5\n2,192,108,1,0.2\n")
        put(root / "merged_racket" / "m1" / rally / "result.json", json.dumps(frames))
    put(root / "interp_ball" / "m1" / "r9" / "results.csv", "Frame,X,Y,Visibility,Confidence\n0,1,1,1,1\n")
    put(root / "info" / "train.json", json.dumps([["m1", "r1"], ["m1", "r2"]]))
    put(root / "info" / "val.json", json.dumps([["m1", "r2"]]))
    put(root / "info" / "test.json", json.dumps([]))
    base = str(tmp_path)
    ball, rackets, splits = racket_pose.read_ball(spark, base), racket_pose.read_rackets(spark, base), racket_pose.read_splits(spark, base)
    good, bad = racket_pose.pair(ball, rackets, splits)
    assert rows_of(good, "rally_id", "split") == [("r1", "train")]
    assert rows_of(bad, "rally_id", "reason") == [("r2", "leaks_across_splits"), ("r3", "no_fixed_split")]
    out = {r.frame: r.features for r in racket_pose.features(ball.filter("rally_id = 'r1'"), rackets.filter("rally_id = 'r1'")).collect()}
    assert len(out) == 3 and all(len(v) == 28 for v in out.values())
    assert out[0][:4] == [0.5, 0.5, 1.0, 0.7] and out[1][:4] == [0.0, 0.0, 0.0, 1.0]
    assert out[0][4] == 460.0 / 1920 and out[0][14:16] == [0.0, 1.0] and out[0][16] == 0.5 and out[0][26:28] == [0.75, 1.0]
    assert out[2][4:] == [0.0] * 24
