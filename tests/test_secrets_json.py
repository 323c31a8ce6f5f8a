from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carryover.functions import canonical_json as cj
from carryover.functions import secrets

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"
GH = "ghp_" + "a" * 36


@pytest.mark.parametrize(
    "text,expected",
    [
        (f"前缀 ({AWS})", [("aws-access-token", 8, 28)]),
        (f"x{AWS}", []),
        (f"password={GH}", [("github-pat", 9, 49), ("password-assignment", 9, 49)]),
        ("password=short", []),
        ("xpassword=abcdefgh password=abcdefgh", [("password-assignment", 28, 36)]),
        ("", []),
        (None, []),
    ],
)
def test_spans(text, expected):
    assert secrets.find_secrets(text) == expected


def test_mask_merges_overlaps():
    assert secrets.mask_text(f"a password={GH} b") == "a password=[secret] b"
    assert secrets.mask_text("plain") == "plain"
    assert secrets.mask_text(None) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([AWS, GH, "password=12345678", " ", "x", "é", "-"]), max_size=8))
def test_mask_leaves_no_secret(parts):
    text = "".join(parts).encode()
    merged = []
    for _, s, e in sorted(secrets.find_secrets(text.decode()), key=lambda x: x[1:]):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + b"[secret]" + text[e:]
    assert secrets.mask_text("".join(parts)) == text.decode()


def test_columns(spark):
    df = spark.createDataFrame([(1, f"ü {AWS}"), (2, None), (3, "x" * 300_000), (4, "")], "id int, rule_id string")
    got = df.select("id", secrets.findings(F.col("rule_id"), "/content", "block", frozenset({"aws-access-token"})).alias("f"), secrets.masked(F.col("rule_id")).alias("m")).orderBy("id").collect()
    assert [(r["id"], [tuple(x) for x in r["f"]]) for r in got][0] == (1, [("aws-access-token", "/content", 3, 23, "allowlisted")])
    assert [len(r["f"]) for r in got] == [1, 0, 0, 0]
    assert got[0]["m"] == "ü [secret]" and got[1]["m"] is None and len(got[2]["m"]) == 300_000
    with pytest.raises(ValueError):
        secrets.check_policy("block", {"no-such-rule"})


def test_canonical_json():
    assert cj.canonical({"": -0.0, "\U0001f600": 1.0, "a": 1e30}) == '{"a":1e+30,"\U0001f600":1,"":0}'
    for x, text in ((1e-7, "1e-7"), (0.0000001, "1e-7"), (0.000001, "0.000001"), (123456789.5, "123456789.5"), (1.5e300, "1.5e+300"), (-2.50, "-2.5"), (100.0, "100")):
        assert cj.canonical(x) == text
    for bad in (2**53, -(2**53), 1e20, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            cj.canonical(bad)
    for bad in ('{"a":1,"a":2}', "[NaN]", "[" * 200 + "]" * 200):
        with pytest.raises(ValueError):
            cj.strict_load(bad)


def test_canonical_column(spark):
    df = spark.createDataFrame([('{"b":1, "a":[1.0,null]}',), ("{",), (None,), ('{"a":1,"a":1}',)], "j string")
    assert [r[0] for r in df.select(cj.canonical_text("j")).collect()] == ['{"a":[1,null],"b":1}', None, None, None]
