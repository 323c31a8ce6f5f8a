from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from carryover.operators.drift import acyclic, canonical_names, consistent_table, fused_schema, schema_changes, table_schema
from carryover.operators.snapshots import snapshot_changes, tree_bits
from tests.conftest import rows

SCHEMA = "row_no bigint, s int, id string, body string, gone boolean, at timestamp, change string"


def changes(df, **kw):
    return rows(snapshot_changes(df, "id", "s", [F.col("body"), F.coalesce("gone", F.lit(False))], F.struct("at", "row_no"), **kw), "id", "snapshot_no", "change")


def brute(data):
    by = {}
    for r in sorted(data, key=lambda r: (r[5] is not None, r[5], r[0])):
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[1], {})[r[2]] = (r[3], r[4] or False)
    out, order = [], sorted(by)
    for a, b in zip(order, order[1:], strict=False):
        for k in by[a].keys() | by[b].keys():
            if by[a].get(k) != by[b].get(k):
                out.append((k, b, "added" if k not in by[a] else "removed" if k not in by[b] else "changed"))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    from datetime import datetime

    rng = random.Random(5)
    data = []
    for n in range(3000):
        s = rng.choice([1, 2, 4, None]) if n % 50 == 0 else rng.choice([1, 2, 4])
        key = rng.choice([None, ""]) if n % 97 == 0 else f"k{rng.randrange(700)}"
        data.append((n, s, key, rng.choice(["x", "", None, "y" * 50_000 if n % 500 == 0 else "y"]), rng.choice([None, True, False]), datetime(2026, 1, 1, 0, 0, rng.randrange(60)), "mine"))
    df = spark.createDataFrame(data, SCHEMA)
    for leaf in (1, 4, 10_000):
        assert changes(df, keys_per_leaf=leaf) == brute(data)


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert changes(df) == []
    one = spark.createDataFrame([(1, 1, "a", "x", None, None, None)] * 3, SCHEMA)
    assert changes(one) == []
    assert tree_bits(0) == 6 and tree_bits(10**9) == 30


def export(spark, files):
    data = [(feed, no, i, "memory", line if isinstance(line, str) else json.dumps(line)) for feed, no, lines in files for i, line in enumerate(lines)]
    return spark.createDataFrame(data, "feed_id bigint, file_no int, line_no int, fam string, payload string")


def test_changes(spark):
    files = [
        (1, 1, [{"id": "a", "t": "x", "n": 1, "e": [{"k": True}]}, {"id": "b", "t": "y", "n": None}]),
        (1, 3, [{"id": "a", "body": "x", "n": "1", "e": [{"k": True}, {"k": "z"}], "new": {"w": 0}}, {"id": "b", "body": "y"}, '{"id": "c", "cut":', "[1]", "NaN"]),
        (1, 3, [{"id": "a", "body": "x", "n": "1", "e": [{"k": True}, {"k": "z"}], "new": {"w": 0}}]),
        (1, 4, ["broken"]),
        (2, 1, [{"id": "a", "only": 1}]),
    ]
    got = rows(schema_changes(export(spark, files), "feed_id", "file_no", "payload"))
    gone = [(1, 4, "removed", p, "") for p in ("id", "body", "n", "e", "e[].k", "new", "new.w")]
    assert got == sorted([(1, 3, "renamed", "t", "body"), (1, 3, "type_changed", "n", "n"), (1, 3, "type_changed", "e[].k", "e[].k"), (1, 3, "added", "", "new"), (1, 3, "added", "", "new.w"), *gone], key=repr)


def test_rename_needs_most_records(spark):
    files = [(1, 1, [{"id": "a", "t": "x"}, {"id": "b", "t": "y"}, {"t": "keyless"}]), (1, 2, [{"id": "a", "u": "x"}, {"id": "b", "u": "other"}])]
    assert rows(schema_changes(export(spark, files), "feed_id", "file_no", "payload")) == sorted([(1, 2, "removed", "t", ""), (1, 2, "added", "", "u")], key=repr)


def test_table_and_schema(spark):
    files = [(1, 1, [{"id": "a", "t": "x", "line_no": 7}]), (1, 2, [{"id": "b", "u": {"v": 1}, "flag": True}, "cut"])]
    df = export(spark, files)
    schema = {r["path"]: r["types"] for r in fused_schema(df, "fam", "feed_id", "file_no", "payload").collect()}
    assert schema == {"id": "string", "t": "string", "u": "object", "u.v": "number", "flag": "boolean", "line_no": "number"}
    table = consistent_table(df, {"t": "u"}, {"id": 1, "t": 1, "u": 8, "u.v": 2, "flag": 4, "line_no": 2}, ["feed_id", "line_no"], "payload")
    assert table.columns == ["feed_id", "line_no", "flag", "id", "value_line_no", "u", "u__string", "u__object", "u.v"]
    assert rows(table, "id", "u", "u__string", "u__object", "`u.v`", "value_line_no") == [("a", "x", "x", None, None, 7.0), ("b", '{"v": 1}', None, '{"v": 1}', 1.0, None)]
    assert acyclic({"a": "b", "b": "a", "c": "d"}) == {"a": "b", "c": "d"}


def test_empty(spark):
    df = export(spark, [(1, 1, ["x"])]).limit(0)
    assert schema_changes(df, "feed_id", "file_no", "payload").count() == 0
    assert fused_schema(df, "fam", "feed_id", "file_no", "payload").count() == 0


def test_feeds_that_rename_one_path_differently(spark):
    names = canonical_names([(1, "text", "body"), (2, "text", "content"), (2, "content", "note")])
    assert names == {1: {"text": "text", "body": "text"}, 2: {"text": "text", "content": "text", "note": "text"}}
    data = [(1, '{"text": "a"}'), (1, '{"body": "b"}'), (2, '{"content": "c"}'), (2, '{"note": "d"}'), (3, '{"text": "e"}'), (3, '{"body": "other"}'), (1, '{"text": "f", "body": "g"}')]
    df = spark.createDataFrame(data, "feed_id int, payload string")
    got = consistent_table(df, {}, {k: 1 for k in ("text", "body", "content", "note")}, ["feed_id"], "payload", names)
    want = [(1, "a", None), (1, "b", None), (1, "f", "g"), (2, "c", None), (2, "d", None), (3, "e", None), (3, None, "other")]
    assert rows(got, "feed_id", "text", "body") == sorted(want, key=repr)
    assert rows(got.selectExpr("count(content)", "count(note)")) == [(0, 0)]


def test_drift_inside_arrays(spark):
    data = [(1, '{"m": [{"body": "x", "e": {"on": true}}, {"body": "z", "e": {"on": "yes"}}]}'), (2, '{"m": [{"content": "y", "e": {"on": 1}}]}')]
    df = spark.createDataFrame(data, "feed_id int, payload string")
    schema = {"m": 16, "m[].body": 1, "m[].content": 1, "m[].e": 8, "m[].e.on": 7}
    got = consistent_table(df, {}, schema, ["feed_id"], "payload", canonical_names([(2, "m[].body", "m[].content")]))
    made = {r[0]: json.loads(r[1]) for r in got.select("feed_id", "m").collect()}
    assert made == {1: [{"body": "x", "e.on": "true", "e.on__boolean": True}, {"body": "z", "e.on": "yes", "e.on__string": "yes"}], 2: [{"body": "y", "e.on": "1", "e.on__number": 1}]}


def test_names_that_differ_in_case(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"loc": "a"}'), (1, '{"Loc": "b"}'), (2, '{"Loc": "c"}')], "feed_id int, payload string")
    got = consistent_table(df, {}, {"loc": 1, "Loc": 1}, ["feed_id"], "payload", canonical_names([(1, "loc", "Loc")]))
    got.write.parquet(str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "feed_id", "loc", "Loc_") == [(1, "a", None), (1, "b", None), (2, None, "c")]


def test_numbers_keep_every_digit(spark):
    big = 2**53 + 1
    data = [(1, 1, f'{{"i": {big}, "f": 1, "m": {big}, "h": 1}}'), (1, 1, f'{{"i": 2, "f": 1.5, "m": 0.5, "h": {10**30}}}')]
    df = spark.createDataFrame(data, "feed_id int, file_no int, payload string")
    got = consistent_table(df, {}, table_schema(df, "feed_id", "file_no", "payload"), ["feed_id"], "payload")
    assert dict(got.dtypes) == {"feed_id": "int", "i": "bigint", "f": "double", "m": "string", "h": "string"}
    assert rows(got, "i", "f", "m", "h") == sorted([(big, 1.0, str(big), "1"), (2, 1.5, "0.5", str(10**30))], key=repr)


def test_maps_whose_keys_are_data_stay_whole(spark):
    data = [(1, 1, json.dumps({"id": str(k), "by_id": {f"k{k}": {"v": k}}, "o": {"x": k}})) for k in range(30)]
    df = spark.createDataFrame(data, "feed_id int, file_no int, payload string")
    schema = table_schema(df, "feed_id", "file_no", "payload", most_keys=10)
    assert set(schema) == {"id", "by_id", "o", "o.x"}
    got = consistent_table(df, {}, schema, ["feed_id"], "payload")
    assert got.columns == ["feed_id", "by_id", "id", "o.x"] and json.loads(got.where("id = '3'").first()["by_id"]) == {"k3": {"v": 3}}
