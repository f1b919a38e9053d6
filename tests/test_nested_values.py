"""Record checks look at every depth of the payload."""

from courtflow.operators.quality import record_violations


def test_nested_numbers_and_binary_names(spark):
    rows = [
        (1, 1.0, '{"a": {"b": [1, NaN]}}'), (2, 1.0, '{"a": [{"b": -Infinity}]}'), (3, None, '{"a": {"b": 1e999}}'), (4, 1.0, '{"a": {"raw_Frames": [1]}}'),
        (5, 1.0, '{"mp4_bytes": "x"}'), (6, 1.0, '{"a": "NaN, 1e999 and Infinity", "b": "rawframes", "NaN": 1.5}'), (7, float("nan"), '{"a": 1}'), (8, 1.0, "no json"),
    ]
    df = spark.createDataFrame(rows, "id long, score double, payload string")
    got = sorted((r.id, r.reason) for r in record_violations(df, "id", "payload", ["score"]).collect())
    assert got == [(1, "not_finite"), (2, "not_finite"), (3, "not_finite"), (4, "binary_field_name"), (5, "binary_field_name"), (7, "not_finite"), (8, "not_an_object")]


def test_names_are_decoded_and_told_from_values(spark):
    long = "x\\n" * 200_000
    rows = [
        (1, '{"\\u0024set": 1}'), (2, '{"a": {"b\\u002ec": 1}}'), (3, '{"raw\\u005fFrames" : 1}'), (4, '{"": 1}'), (5, '{"a\\"b": "$set"}'),
        (6, '["a", 1.5, ":b"]'), (7, '{"a": "\\"$set\\": 1"}'), (8, f'{{"a": "{long}", "$b" : 1}}'), (9, None), (10, "{}"),
    ]
    df = spark.createDataFrame(rows, "id long, payload string")
    got = sorted((r.id, r.reason) for r in record_violations(df, "id").filter("id <> 9").collect())
    assert got == [(1, "unsafe_field_name"), (2, "unsafe_field_name"), (3, "binary_field_name"), (4, "unsafe_field_name"), (8, "unsafe_field_name")]
