from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carryover.functions.jsonstream import pointer, triples
from carryover.operators.coverage import json_leaves, unreported
from carryover.operators.nested import flatten_json, flatten_typed, pivot, repeated_ancestors
from tests.conftest import rows

values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12)


def walk(value, path=()):
    yield path, value
    if isinstance(value, list):
        for k, v in enumerate(value):
            yield from walk(v, (*path, k))
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k))


@settings(max_examples=200, deadline=None)
@given(values, st.booleans())
def test_reader_agrees_with_json(value, ascii_only):
    got = triples(json.dumps(value, ensure_ascii=ascii_only, indent=1))
    assert [t.path for t in got] == [p for p, _ in walk(value)]
    assert [t.ordinals for t in got] == [tuple(x for x in p if isinstance(x, int)) for p, _ in walk(value)]
    for t, (_, v) in zip(got, walk(value), strict=True):
        if t.kind == "string":
            assert t.value == v.encode("utf-8", "replace").decode()
        elif t.kind == "number":
            assert json.loads(t.value) == v


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", '{"a":}', "01", "NaN", "[1 2]", '"\t"', '{"a":1,}', "nul", "[1]x", "{1:2}", '"abc', "1.", "-", '["a" "b"]', "[" * 50])
def test_invalid(text):
    with pytest.raises(ValueError):
        triples(text)


def test_repeated_key_keeps_last_and_depth():
    assert [(t.path, t.value) for t in triples('{"a":[1,2],"b":0,"a":[3]}')] == [((), None), (("b",), "0"), (("a",), None), (("a", 0), "3")]
    assert [(t.path, t.value) for t in triples('{"a":{"x":1,"x":[2]},"a":{"x":3},"b":[{"k":1,"k":2}]}')] == [((), None), (("a",), None), (("a", "x"), "3"), (("b",), None), (("b", 0), None), (("b", 0, "k"), "2")]
    many = '{"a":[' + ",".join("1" * 20_000) + "]" + ',"a":[1]' * 20_000 + "}"
    assert len(triples(many)) == 3
    assert len(triples("[" * 3000 + "]" * 3000)) == 3000
    assert len(triples(json.dumps("x" * 2_000_000))) == 1
    assert pointer(("a/b", 0, "m~n")) == "/a~1b/0/m~0n"


def test_flatten_json(spark):
    df = spark.createDataFrame(
        [(1, '{"a":[{"x":1,"y":{"z":"q"}},null,[]],"b":2}', "extra"), (1, '{"a":[]}', None), (2, "broken", None), (3, None, None), (4, "[[5]]", None), (None, "[6]", None)], "pos int, doc string, kind string"
    )
    got = flatten_json(df, "pos", "doc")
    assert rows(got, "pos", "table_path", "row_pointer", "parent_pointer", "child_pos", "kind") == sorted(
        [(1, "/a", "/a/0", "", 0, "object"), (1, "/a", "/a/1", "", 1, "null"), (1, "/a", "/a/2", "", 2, "array"), (4, "", "/0", "", 0, "array"), (4, "/*", "/0/0", "/0", 0, "number"), (None, "", "/0", "", 0, "number")], key=repr
    )
    ids = df.withColumnRenamed("pos", "id")
    table = pivot(flatten_json(ids, "id", "doc"), "id", "/a", ["/x", "/y/z", "/pos"])
    assert table.columns == ["id", "row_pointer", "parent_pointer", "pos", "x", "y_z", "value_pos"]
    assert rows(table, "pos", "x", "y_z") == sorted([(0, "1", "q"), (1, None, None), (2, None, None)], key=repr)
    assert flatten_json(ids, "id", "doc", roots=True).where("kind = 'invalid'").count() == 1
    assert flatten_json(ids.limit(0), "id", "doc").count() == 0


def test_flatten_typed(spark):
    df = spark.createDataFrame([(1, [("p", "c"), (None, None), None]), (2, []), (3, None), (1, [("p", "c")])], "pos int, files array<struct<path:string,pos:string>>")
    got = flatten_typed(df, "pos", "files", {"path": "path", "pos": "pos"})
    assert got.columns == ["pos", "child_pos", "path", "value_pos"]
    assert got.count() == 4
    plain = flatten_typed(df.withColumnRenamed("pos", "id"), "id", "files", {"path": "path"})
    assert rows(plain) == sorted([(1, 0, "p"), (1, 0, "p"), (1, 1, None), (1, 2, None)], key=repr)
    assert repeated_ancestors(df.schema) == {"": ["pos"], "files": ["files.path", "files.pos"]}


def test_leaves_and_coverage(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1,"c":[1,2]},"d":{},"e":null}'), (2, "nope"), (3, None)], "id int, j string")
    leaves = json_leaves(df, "id", "j")
    assert rows(leaves, "id", "leaf") == sorted([(1, "/a/b"), (1, "/a/c"), (1, "/d"), (1, "/e"), (2, None)], key=repr)
    mapped = spark.createDataFrame([(1, "/a"), (1, "/e"), (2, "/x")], "id int, path string")
    assert rows(unreported(leaves, mapped, "id"), "leaf") == [("/d",)]
