from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.canonical import completed, with_record_hash
from carryover.functions.identity import canonical_id, content_hash
from carryover.sinks import envelope


def sample(spark):
    df = spark.createDataFrame([("n.md", 'Title "x"\r\n---\nbody #', ["a", "b:c"], "2024-01-01T00:00:00Z"), ("o.md", "", None, None)], "source_record_id string, content string, tags array<string>, updated_at string")
    src = F.struct(F.lit("markdown").alias("system"), F.lit("1").alias("adapter_version"), F.lit("unknown").alias("export_version"), F.lit(None).cast("string").alias("satellite_id"))
    who = F.struct(F.lit("kim").alias("actor"), F.lit("user").alias("actor_kind"), F.lit("m").alias("method"), F.lit("n").alias("source_ref"), F.lit(None).cast("array<struct<source_ref:string,weight:double>>").alias("evidence"))
    df = df.withColumns({"source": src, "provenance": who, "source_locator": F.col("source_record_id"), "scope": F.lit("user"), "dna_class": F.lit("dna"), "evidence_level": F.lit("measured"), "content_hash": content_hash(F.col("content"))})
    return with_record_hash(completed(df.withColumn("canonical_id", canonical_id(F.lit("markdown"), F.lit(""), F.col("source_record_id")))))


def notes_of(spark, df, change=lambda t: t):
    data = [(r["path"], change(r["note"]).encode()) for r in envelope.rendered(df).orderBy("path").collect()]
    return spark.createDataFrame(data, "path string, content binary")


def test_round_trip(spark):
    df = sample(spark)
    got = envelope.restored(notes_of(spark, df))
    want = {r["canonical_id"]: r["record_hash"] for r in df.collect()}
    assert all(len(h) == 71 for h in want.values())
    assert {r["canonical_id"]: (r["record_hash"], r["envelope_hash"], r["home_fields"], r["classification"]) for r in got.collect()} == {k: (h, h, [], None) for k, h in want.items()}


def test_owner_edits(spark):
    df = sample(spark).where("source_record_id = 'n.md'")
    edited = envelope.restored(notes_of(spark, df, lambda t: t.replace('tags: ["a","b:c"]', "tags: solo").replace("body #", "other"))).first()
    assert (edited["tags"], edited["content"], edited["home_fields"]) == (["solo"], 'Title "x"\r\n---\nother', ["/body", "/frontmatter/tags"])
    assert edited["content_hash"] != df.first()["content_hash"] and edited["record_hash"] != edited["envelope_hash"]
    titled = envelope.restored(notes_of(spark, df, lambda t: t.replace('title: "Title', 'title: "Other').replace('"author":"human:kim"', '"author":"human:lee"')))
    assert titled.first()["home_fields"] == ["/frontmatter/title", "/frontmatter/sources"]
    assert sorted(r["code"] for r in envelope.edit_anomalies(titled).collect()) == ["note_provenance_divergent", "note_title_divergent"]


def test_damage_and_strangers(spark):
    df = sample(spark).where("source_record_id = 'n.md'")
    for change, expected in (
        (lambda t: t.replace('carryover_note: "1"', 'carryover_note: "9"'), "managed_invalid"),
        (lambda t: t.replace('"source_record_id":"n.md"', '"source_record_id":"zz.md"'), "managed_invalid"),
        (lambda t: t.replace("\n---\nTitle", "\nTitle").replace("\r\n---\n", ""), "managed_invalid"),
        (lambda t: "---\ntitle: x\n---\nplain", "unmanaged"),
        (lambda t: "", "unmanaged"),
    ):
        r = envelope.restored(notes_of(spark, df, change)).first()
        assert (r["classification"], r["canonical_id"], r["record_hash"], r["home_fields"]) == (expected, None, None, [])


def test_index_and_log():
    assert envelope.owned_index(envelope.INDEX_MARK + "\n- x") and not envelope.owned_index("# Index") and not envelope.owned_index(None)
    log = envelope.logged(None, "2024-01-01", 2, 0)
    log = envelope.logged(envelope.owned_log(log), "2024-01-01", 0, 1)
    log = envelope.logged(envelope.owned_log(log), "2024-01-02", 1, 1)
    assert envelope.owned_log(log) == {"2024-01-02": ["- +1 ~1"], "2024-01-01": ["- +0 ~1", "- +2 ~0", ""]}
    assert envelope.owned_log("# Log\n") is None and envelope.owned_log(None) is None
    for bad in ("", "# Log\n", "# Log\n- x\n", "# Log\n## 2024-13-01\n- x\n", "# Log\n## 2024-01-01\n- x\n## 2024-01-02\n- y\n", "# Log\n## 2024-01-02\n## 2024-01-01\n- y\n"):
        with pytest.raises(ValueError):
            envelope.owned_log(envelope.LOG_MARK + "\n" + bad)
    with pytest.raises(ValueError):
        envelope.logged(envelope.owned_log(log), "2023-01-01", 1, 0)
