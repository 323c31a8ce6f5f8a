from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from carryover.sinks.writers import WRITERS, NotesWriter, Registry
from tests.conftest import rows
from tests.test_envelope import sample


def test_registry():
    assert list(WRITERS) == ["exchange", "notes", "permalink"]
    with pytest.raises(ValueError):
        Registry(NotesWriter(), NotesWriter())
    with pytest.raises(ValueError):
        WRITERS["other"]


def test_exchange_rows(spark, tmp_path):
    root, w = str(tmp_path), WRITERS["exchange"]
    df = sample(spark)
    none = spark.createDataFrame([], "canonical_id string")
    w.write(df.withColumn("expected", F.lit(None).cast("string")), root).count()
    held = w.state(spark, root, none)
    assert rows(held, "target_id", "record_hash", "classification") == sorted([(r["canonical_id"], r["record_hash"], None) for r in df.collect()], key=repr)
    assert rows(held, "target_id", "target_hash") == rows(w.planned(df), "target_id", "projection_hash")
    part = next(n for n in os.listdir(f"{root}/records.json") if n.startswith("part-") and os.path.getsize(f"{root}/records.json/{n}"))
    os.unlink(f"{root}/records.json/.{part}.crc")
    with open(f"{root}/records.json/{part}") as f:
        lines = f.read().splitlines()
    with open(f"{root}/records.json/{part}", "w") as f:
        f.write("\n".join([lines[0].replace('"kind":"semantic"', '"kind":"working"'), '{"id":"theirs","kind":"semantic","content":"x"}']))
    spark.catalog.refreshByPath(f"{root}/records.json")
    assert sorted(r["classification"] for r in w.state(spark, root, none).collect() if r["classification"]) == ["managed_invalid", "unmanaged"]
    w.write(df.withColumn("expected", F.lit(None).cast("string")), root).count()  # rows of others stay
    assert spark.read.json(f"{root}/records.json").where("id = 'theirs'").count() == 1


def test_a_permalink_taken_twice_is_refused(spark):
    df = sample(spark).withColumn("content", F.lit("# Same title"))
    assert rows(WRITERS["permalink"].planned(df), "target_id", "status", "code") == [("same-title", "unresolved", "target_untracked")] * 2


def test_redaction_is_refused(spark):
    consent = F.struct(F.lit(None).cast("boolean").alias("exportable"), F.lit(None).cast("string").alias("retention"), F.array(F.lit("/content")).alias("redact"), F.lit(None).cast("boolean").alias("memory_enabled"))
    df = sample(spark).withColumn("consent", consent)
    for ident in WRITERS:
        assert {r[1:] for r in rows(WRITERS[ident].planned(df), "canonical_id", "status", "code")} == {("rejected", "redact_unsupported")}
