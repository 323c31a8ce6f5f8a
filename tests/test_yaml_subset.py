from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.functions.yaml_subset import front_matter_json, parse


@pytest.mark.parametrize(
    "text,expected",
    [
        ("", None),
        ("# only\n\n", None),
        ("a: 1\nb: x y # z\nc: 'it''s'\nd: \"q\\n\"\ne:\nf: ~\ng: true\nh: 1.5e3\ni: 2024-01-02", {"a": 1, "b": "x y", "c": "it's", "d": "q\n", "e": None, "f": None, "g": True, "h": 1500.0, "i": "2024-01-02"}),
        ("tags: [a, 'b c', \"d,e\"]\nm: {x: 1, y: [2, z]}\n", {"tags": ["a", "b c", "d,e"], "m": {"x": 1, "y": [2, "z"]}}),
        ("tags:\n- a\n- b: 1\n  c: 2\nm:\n  n:\n    - x\n  o: u:v\n", {"tags": ["a", {"b": 1, "c": 2}], "m": {"n": ["x"], "o": "u:v"}}),
        ("t: |\n  one\n   two\n\nu: >-\n  a\n  b\nv: http://x/y#z", {"t": "one\n two\n", "u": "a b", "v": "http://x/y#z"}),
        ('{"a": {"b": [1, null]}}', {"a": {"b": [1, None]}}),
        ("metadata:\r\n  node_type: memory\r\n", {"metadata": {"node_type": "memory"}}),
    ],
)
def test_parse(text, expected):
    assert parse(text) == expected


@pytest.mark.parametrize("text", ["- a", "just text", "a: &x 1", "a: [1, 2", "a: 'x", "a: 1\na: 2", "a: 1\n   b: 2", "\ta: 1", "{a: 1} x", "a: " + "[" * 300])
def test_errors(text):
    with pytest.raises(ValueError):
        parse(text)


def test_column(spark):
    df = spark.createDataFrame([("a: [1]",), ("- x",), (None,), ("#",)], "v string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(front_matter_json(F.col("v"))).collect()] == [('{"a": [1]}', None), (None, "no map"), None, (None, None)]
