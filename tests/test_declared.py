"""Declared schemas name what is wrong with a record; drifting objects are taken apart row by row."""

import json

import pytest

from cohortlens.sources.declared import Declared, checked, read_declared, shredded

FIELDS = [
    Declared("id", "INTEGER", "REQUIRED"),
    Declared("who", "RECORD", "NULLABLE", (Declared("name", "STRING", "REQUIRED"), Declared("ages", "INTEGER", "REPEATED"))),
    Declared("tags", "STRING", "REPEATED"),
    Declared("items", "RECORD", "REPEATED", (Declared("w", "FLOAT"), Declared("ok", "BOOLEAN", "REQUIRED"))),
]


def run(spark, *records):
    lines = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")
    return checked(lines.coalesce(1), FIELDS).collect()


def test_good_records_are_typed(spark):
    row = run(spark, {"id": 7, "who": {"name": "a", "ages": [1, 2]}, "tags": ["x"], "items": [{"w": 1, "ok": True}, {"w": 2.5, "ok": False}], "more": 1})[0]
    assert row["_errors"] == [] and row["id"] == 7 and row["who"].asDict() == {"name": "a", "ages": [1, 2]} and row["tags"] == ["x"]
    assert [i.asDict() for i in row["items"]] == [{"w": 1.0, "ok": True}, {"w": 2.5, "ok": False}]


def test_nullable_may_be_missing_or_null_and_repeated_is_then_empty(spark):
    for row in run(spark, {"id": 1}, {"id": 1, "who": None, "tags": None, "items": None}):
        assert row["_errors"] == [] and row["who"] is None and row["tags"] == row["items"] == []


@pytest.mark.parametrize("record,errors", [
    ({}, ["id: required"]),
    ({"id": None}, ["id: required"]),
    ({"id": "7"}, ["id: not INTEGER"]),
    ({"id": 1.5}, ["id: not INTEGER"]),
    ({"id": 1, "who": {"ages": [1]}}, ["who.name: required"]),
    ({"id": 1, "who": {"name": "a", "ages": 3}}, ["who.ages: not REPEATED"]),
    ({"id": 1, "who": {"name": "a", "ages": [1, "x", "y"]}}, ["who.ages[]: not INTEGER"]),
    ({"id": 1, "who": "a"}, ["who: not RECORD"]),
    ({"id": 1, "tags": "x"}, ["tags: not REPEATED"]),
    ({"id": 1, "tags": ["x", None]}, ["tags[]: null"]),
    ({"id": 1, "items": [{"w": 1}]}, ["items[].ok: required"]),
    ({"id": 1, "items": [3]}, ["items[]: not RECORD"]),
    ({"id": 1, "items": [{"ok": 1, "w": "x"}]}, ["items[].w: not FLOAT", "items[].ok: not BOOLEAN"]),
    ({"tags": 1}, ["id: required", "tags: not REPEATED"]),
    ("[1]", ["record: not an object"]), ("{cut", ["record: not an object"]), ("null", ["record: not an object"]),
])
def test_what_is_wrong_is_named(spark, record, errors):
    assert run(spark, record)[0]["_errors"] == errors


def test_the_cap_counts_records_and_names_fields(spark, tmp_path):
    records = [{"id": k} for k in range(10)] + [{"id": "x", "tags": 3}, {"id": "y"}, {}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, records)) + "\n\n  \n")
    assert sorted(r["id"] for r in read_declared(spark, str(tmp_path), FIELDS, max_bad_records=3).collect()) == list(range(10))
    with pytest.raises(ValueError, match=r"3 bad records exceed the limit of 2: id: not INTEGER \(2\); id: required \(1\); tags: not REPEATED \(1\)"):
        read_declared(spark, str(tmp_path), FIELDS, max_bad_records=2)


def test_bad_declarations():
    for bad in ({"type": "DATE"}, {"mode": "OPTIONAL"}, {"type": "RECORD"}, {"fields": (Declared("x"),)}):
        with pytest.raises(ValueError):
            Declared("a", **bad)
    with pytest.raises(ValueError):
        Declared("a']")


def test_drifting_objects(spark):
    lines = ['{"author":"a","created_utc":5}', '{"author":{"name":"b","id":9},"created_utc":"6"}', '{"author":3,"created":7.0}', "{cut",
             '{"author":null,"created_utc":"soon","created":8}', "[]", '{"created_utc":[1],"author":["x"]}']
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    assert [tuple(r) for r in shredded(df, ["author", "created_utc"]).collect()] == [("a", 5), ("b", 6), (None, 7), (None, None), (None, 8), (None, None), (None, None)]
