from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carryover.functions import identity, text
from carryover.plans.home import derive_satellite_id


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()[0]


def test_record_id_vector(spark):
    got = one(spark, "note.md", lambda v: identity.canonical_id(F.lit("markdown"), F.lit(""), v))
    assert got == "i4qddchtghm45k3wcgh2alzcsh326qn4"
    assert one(spark, None, lambda v: identity.canonical_id(F.lit("markdown"), v, F.lit("note.md"))) == got


def test_satellite_id_agrees_with_driver(spark):
    for path in ("/a", "/synthetic/vault", "/ü/ж"):
        assert one(spark, path, identity.satellite_id) == derive_satellite_id(path)


def test_content_hash_and_shapes(spark):
    assert one(spark, "é", identity.content_hash) == "sha256:" + hashlib.sha256("é".encode()).hexdigest()
    assert one(spark, "a" * 32, identity.valid_record_id) is True
    assert one(spark, "a" * 32 + "\n", identity.valid_record_id) is False
    assert one(spark, "1" * 8, identity.valid_satellite_id) is False
    assert one(spark, None, identity.valid_satellite_id) is False


def test_fold_title_slug(spark):
    assert one(spark, " \t a 　b\r\n c ", text.fold_whitespace) == "a b c"
    assert one(spark, "\n \n## Title  \nbody", lambda v: text.title(v, F.lit("x"))) == "Title"
    assert one(spark, "\n \n", lambda v: text.title(v, F.lit("x"))) == "Memory x"
    assert one(spark, "# " + "ж" * 100, lambda v: text.title(v, F.lit("x"))) == "ж" * 80
    assert one(spark, "  Héllo, World! ", lambda v: text.slug(v, F.lit("abcdefghijklmnop"))) == "h-llo-world"
    assert one(spark, "жж", lambda v: text.slug(v, F.lit("abcdefghijklmnop"))) == "note-abcdefghijkl"
    assert one(spark, None, text.fold_whitespace) is None


def test_calendar(spark):
    for value, ok in (("2024-02-29", True), ("2023-02-29", False), ("0000-01-01", True), ("2024-2-9", False), ("2024-13-01", False), (None, False), ("2024-04-31", False)):
        assert one(spark, value, text.calendar_date) is ok, value


def test_front_matter(spark):
    def parts(v):
        return tuple(one(spark, v, text.front_matter))

    assert parts("---\na: 1\n---\nbody\n---\nmore") == ("a: 1", "body\n---\nmore", False)
    assert parts("---\r\na: 1\r\n---\r\nb") == ("a: 1", "b", False)
    assert parts("---\n---\nb") == ("", "b", False)
    assert parts("---\na: 1\nb") == (None, "---\na: 1\nb", True)
    assert parts("plain") == (None, "plain", False)


def test_kinds(spark):
    assert one(spark, "preference", text.dna_class) == "dna"
    assert one(spark, "tool", text.kind_is_inferred) is False
    assert one(spark, None, text.kind_is_inferred) is True
    assert one(spark, "instruction", text.exchange_kind) == "procedural"
    assert one(spark, "a/b~c", text.escape_pointer) == "a~1b~0c"


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_fold_matches_python(spark, value):
    value = value.encode("utf-8", "ignore").decode().replace("\x00", "")
    # Python's split also cuts at the four information separators, which aren't White_Space
    if not any("\x1c" <= c <= "\x1f" for c in value):
        assert one(spark, value, text.fold_whitespace) == " ".join(value.split())
