"""Targets behind one interface: how records are planned for them, what they hold, how they are written.

A writer has ``ident``, ``can_update``, ``reads_back``, ``round_trips``, ``shared`` (files
that records share) and

* ``planned(records)``: canonical_id, target_id, projection_hash, status, code,
* ``state(spark, root, history)``: what is there, as ``decide`` wants it,
* ``write(chosen, root)``: writes records whose target still is as it was planned.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.canonical import DDL, completed, record_json, record_type, with_record_hash
from carryover.functions.canonical_json import canonical_text
from carryover.functions.identity import content_hash
from carryover.functions.text import fold_whitespace, front_matter, slug, title
from carryover.operators.dedup import duplicate_key
from carryover.sinks import envelope
from carryover.sinks.exchange import projection
from carryover.sinks.files import read_or_none, replace_file, safe_join

STATE = "target_id string, canonical_id string, record_hash string, content_hash string, target_hash string, classification string, envelope_hash string, home_fields array<string>, key binary"

#: Fields that copies of a record may differ in.
_OWN = ("canonical_id", "source", "source_record_id", "source_locator", "content", "content_hash", "sensitive_findings", "record_hash")


def record_key(df: DataFrame) -> Column:
    """What duplicates agree in: all metadata but identity and origin, and the folded body."""
    typed = [c for c in df.columns if c not in _OWN]
    meta = [F.to_json(F.struct(F.col(c).alias("v"))) if c != "provenance" else F.to_json(F.struct(*(F.col(f"provenance.{x}") for x in ("actor", "actor_kind", "method")))) for c in typed]
    return duplicate_key([canonical_text(F.concat_ws("", F.lit("["), F.concat_ws(",", *meta), F.lit("]")))], fold_whitespace(F.col("content")))


def _refused(df: DataFrame) -> Column:
    """A record whose owner wants parts blacked out can't be written as a whole."""
    return F.coalesce(F.size("consent.redact") > 0, F.lit(False))


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    if not os.path.isdir(folder) or not any(n.endswith(pattern.lstrip("*")) for n in os.listdir(folder)):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def _write_files(notes: DataFrame, root: str) -> DataFrame:
    """(path, status) of each note of (path, note, expected): a file is replaced only while it is as planned."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            status = []
            for path, note, expected in zip(pdf["path"], pdf["note"], pdf["expected"], strict=True):
                at, data = safe_join(root, path), note.encode("utf-8", "surrogatepass")
                there = read_or_none(at)
                if there == data:  # a task that runs again
                    status.append("unchanged")
                elif (None if there is None else "sha256:" + hashlib.sha256(there).hexdigest()) == (expected if isinstance(expected, str) else None):
                    replace_file(at, data, there)
                    status.append("written")
                else:
                    status.append("moved")
            yield pd.DataFrame({"path": list(pdf["path"]), "status": status})

    return notes.mapInPandas(run, "path string, status string")


class NotesWriter:
    """Markdown notes that hold the whole record, an index and a log."""

    ident, version = "notes", "1"
    can_update = reads_back = round_trips = True
    shared = ("index.md", "log.md")

    def planned(self, records: DataFrame) -> DataFrame:
        notes = envelope.rendered(records).select("canonical_id", "target_id", content_hash(F.col("note")).alias("projection_hash"))
        vector = F.col("embedding").isNotNull()  # notes don't hold vectors: they have to be made again
        status = F.when(_refused(records), "rejected").when(vector, "transformed").otherwise("accepted")
        return completed(records).select("canonical_id", status.alias("status"), F.when(_refused(records), "redact_unsupported").when(vector, "vector_dropped").alias("code")).join(notes, "canonical_id")

    def state(self, spark: SparkSession, root: str, history: DataFrame) -> DataFrame:
        files = _files(spark, os.path.join(root, "memories"), "*.md").withColumn("path", F.regexp_extract("path", r"(memories/[^/]+\.md)$", 1))
        got = envelope.restored(files)
        return got.select("target_id", "canonical_id", "record_hash", "content_hash", "target_hash", "classification", "envelope_hash", "home_fields", F.when(F.col("canonical_id").isNotNull(), record_key(got.drop("path", "target_id", "target_hash", "classification", "envelope_hash", "home_fields"))).alias("key"))

    def read_back(self, spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
        return self.state(spark, root, ids).join(ids.select("canonical_id"), "canonical_id", "left_semi").select("canonical_id", "target_id", "record_hash", "content_hash", "target_hash")

    def write(self, chosen: DataFrame, root: str) -> DataFrame:
        notes = envelope.rendered(chosen).join(chosen.select("canonical_id", "expected"), "canonical_id")
        return _write_files(notes.select("path", "note", "expected"), root)

    def finish(self, spark: SparkSession, root: str, day: str, added: int, updated: int) -> None:
        """Index and log, from what the notes hold now."""
        files = _files(spark, os.path.join(root, "memories"), "*.md").withColumn("path", F.regexp_extract("path", r"(memories/[^/]+\.md)$", 1))
        got = envelope.restored(files).where("canonical_id IS NOT NULL")
        label = F.concat("scope", F.coalesce(F.concat(F.lit(": "), "scope_qualifier"), F.lit("")))
        name = F.regexp_replace(title(F.col("content"), F.col("canonical_id")), r"([\[\]\\])", r"\\$1")
        lines = got.select(label.alias("label"), "canonical_id", F.concat(F.lit("- ["), name, F.lit("]("), "path", F.lit(")")).alias("line")).orderBy("label", "canonical_id")
        at = safe_join(root, "index.md")
        body, current = [envelope.INDEX_MARK, "# Index"], None
        for r in lines.toLocalIterator():  # the index is one file; rows come one partition at a time
            if r["label"] != current:
                current = r["label"]
                body += ["", f"## {current}", ""]
            body.append(r["line"])
        replace_file(at, ("\n".join(body) + "\n").encode(), read_or_none(at))
        if added or updated:
            at = safe_join(root, "log.md")
            there = read_or_none(at)
            days = envelope.owned_log(there.decode()) if there else None
            if there and days is None:
                raise ValueError("log.md isn't ours")
            replace_file(at, envelope.logged(days, day, added, updated).encode(), there)

    def foreign(self, root: str) -> bool:
        """Whether an index or log is there that isn't ours."""
        index, log = (read_or_none(safe_join(root, n)) for n in self.shared)
        return index is not None and not envelope.owned_index(index.decode("utf-8", "replace")) or log is not None and envelope.owned_log(log.decode("utf-8", "replace")) is None


class PermalinkWriter:
    """Notes of a vault, known by their permalink; files carry no record, so only bodies are compared."""

    ident, version = "permalink", "1"
    can_update = reads_back = True
    round_trips = False
    shared = ()

    def rendered(self, records: DataFrame) -> DataFrame:
        """(canonical_id, target_id, path, note); the permalink is the record's own, else made from its title."""
        df = completed(records)
        heading = title(df["content"], F.lit(""))
        own = F.when(F.col("source.system") == "notes", F.col("source_record_id"))
        link = F.coalesce(own, slug(F.when(heading != "Memory ", heading), F.col("canonical_id")))
        text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        front = F.concat_ws("\n", F.concat(F.lit("title: "), text(title(df["content"], F.col("canonical_id")))), F.lit("type: note"), F.concat(F.lit("permalink: "), text(link)), F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.to_json("tags"))))
        return df.select("canonical_id", link.alias("target_id"), F.concat(link, F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "content").alias("note"))

    def planned(self, records: DataFrame) -> DataFrame:
        made = self.rendered(records).select("canonical_id", "target_id", content_hash(F.col("note")).alias("projection_hash"))
        # a permalink that several records of the batch would take is refused for all of them
        taken = made.groupBy("target_id").agg(F.count("*").alias("n"))
        made = made.join(taken, "target_id")
        clash = F.col("n") > 1
        status = F.when(_refused(records), "rejected").when(clash, "unresolved").otherwise("accepted")
        code = F.when(_refused(records), "redact_unsupported").when(clash, "target_untracked")
        return completed(records).join(made, "canonical_id").select("canonical_id", "target_id", "projection_hash", status.alias("status"), code.alias("code"))

    def state(self, spark: SparkSession, root: str, history: DataFrame) -> DataFrame:
        """Files say nothing of the record: an untouched file is the record that history wrote there."""
        if not os.path.isdir(root):
            return spark.createDataFrame([], STATE)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
        relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + re.escape(os.path.realpath(root).rstrip("/")) + "/", "")
        text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
        got = files.select(F.regexp_replace(relative, r"\.md$", "").alias("target_id"), content_hash(F.col("content")).alias("target_hash"), content_hash(front_matter(text)["body"]).alias("content_hash")).where(~F.col("target_id").startswith(".control/"))
        known = history.where("own IS NOT NULL").select(F.col("own.target_id").alias("target_id"), "canonical_id", F.col("own.record_hash").alias("_r"), F.col("own.target_hash").alias("_t"), F.col("own.content_hash").alias("_c"))
        j = got.join(known, "target_id", "left")
        same, body = F.col("_t") == F.col("target_hash"), F.col("_c") != F.col("content_hash")
        return j.select(
            "target_id", "canonical_id", F.when(F.col("canonical_id").isNotNull(), F.when(same, F.col("_r")).otherwise(F.col("target_hash"))).alias("record_hash"), "content_hash", "target_hash", F.lit(None).cast("string").alias("classification"),
            F.lit(None).cast("string").alias("envelope_hash"), F.when(body, F.array(F.lit("/body"))).otherwise(F.array().cast("array<string>")).alias("home_fields"), F.lit(None).cast("binary").alias("key"),
        )

    def read_back(self, spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
        got = self.state(spark, root, spark.createDataFrame([], "canonical_id string, own struct<target_id:string,record_hash:string,target_hash:string,content_hash:string>")).drop("canonical_id", "record_hash")
        return got.join(ids.select("canonical_id", "target_id", "record_hash"), "target_id").select("canonical_id", "target_id", "record_hash", "content_hash", "target_hash")

    def write(self, chosen: DataFrame, root: str) -> DataFrame:
        return _write_files(self.rendered(chosen).join(chosen.select("canonical_id", "expected"), "canonical_id").select("path", "note", "expected"), root)

    def finish(self, spark: SparkSession, root: str, day: str, added: int, updated: int) -> None:
        pass

    def foreign(self, root: str) -> bool:
        return False


class ExchangeWriter:
    """Rows of the exchange format as JSON lines, in order of id; rows of others stay as they are."""

    ident, version = "exchange", "1"
    can_update = reads_back = round_trips = True
    shared = ()
    FOLDER = "records.json"
    ROW = "id string, kind string, owner string, address string, observed string, content string, record string"

    def rows(self, records: DataFrame) -> DataFrame:
        df = projection(completed(records))
        whole = canonical_text(record_json(df.drop("content", "kind", "owner", "address", "observed", "hash_holds")))
        return df.select(F.col("canonical_id").alias("id"), "kind", "owner", "address", "observed", "content", whole.alias("record"))

    @staticmethod
    def row_hash(df: DataFrame) -> Column:
        return content_hash(F.to_json(F.struct("id", "kind", "owner", "address", "observed", "content", "record")))

    def planned(self, records: DataFrame) -> DataFrame:
        rows = self.rows(records)
        made = rows.select(F.col("id").alias("canonical_id"), F.col("id").alias("target_id"), self.row_hash(rows).alias("projection_hash"))
        return completed(records).select("canonical_id", F.when(_refused(records), "rejected").otherwise("accepted").alias("status"), F.when(_refused(records), "redact_unsupported").alias("code")).join(made, "canonical_id")

    def _held(self, spark: SparkSession, root: str) -> DataFrame:
        at = os.path.join(root, self.FOLDER)
        return spark.read.schema(self.ROW).json(at) if os.path.isdir(at) else spark.createDataFrame([], self.ROW)

    def state(self, spark: SparkSession, root: str, history: DataFrame) -> DataFrame:
        held = self._held(spark, root)
        r = held.select("*", self.row_hash(held).alias("target_hash"), F.explode(F.array(F.from_json("record", DDL))).alias("e"))
        ours = F.col("e.canonical_id") == F.col("id")
        names = record_type().names
        given = F.struct("kind", "owner", "address", "observed").alias("given")
        full = with_record_hash(r.select("id", "target_hash", "content", given, ours.alias("ours"), *(F.col(f"e.{c}").alias(c) for c in names if c != "content")))
        # a row whose fields don't follow from the record that it carries is damaged
        again = projection(full)
        agrees = F.lit(True)
        for f in ("kind", "owner", "address", "observed"):
            agrees = agrees & again[f].eqNullSafe(again[f"given.{f}"])
        full = again.withColumn("agrees", agrees).drop("kind", "owner", "address", "observed", "hash_holds", "given")
        known = F.coalesce(F.col("ours") & F.col("agrees"), F.lit(False))
        body = ~F.col("content_hash").eqNullSafe(content_hash(F.col("content")))
        return full.select(
            F.col("id").alias("target_id"), F.when(known, F.col("canonical_id")).alias("canonical_id"), F.when(known, F.col("record_hash")).alias("record_hash"), content_hash(F.col("content")).alias("content_hash"), "target_hash", F.when(F.coalesce(F.col("ours"), F.lit(False)) & ~known, "managed_invalid").when(~known, "unmanaged").alias("classification"),
            F.when(known, F.col("record_hash")).alias("envelope_hash"), F.when(known & body, F.array(F.lit("/content"))).otherwise(F.array().cast("array<string>")).alias("home_fields"), F.when(known, record_key(full.drop("id", "target_hash", "ours", "agrees"))).alias("key"),
        )

    def read_back(self, spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
        return self.state(spark, root, ids).join(ids.select("canonical_id"), "canonical_id", "left_semi").select("canonical_id", "target_id", "record_hash", "content_hash", "target_hash")

    def write(self, chosen: DataFrame, root: str) -> DataFrame:
        spark = chosen.sparkSession
        new, held = self.rows(chosen), self._held(spark, root)
        at = os.path.join(root, self.FOLDER)
        merged = new.unionByName(held.join(new.select("id"), "id", "left_anti")).orderBy("id")
        merged.write.mode("overwrite").json(f"{at}.next")
        # the folder is swapped in two renames; a run that stops between them leaves the old one beside it
        if os.path.isdir(at):
            os.rename(at, f"{at}.old")
        os.rename(f"{at}.next", at)
        shutil.rmtree(f"{at}.old", ignore_errors=True)
        return new.select(F.col("id").alias("path"), F.lit("written").alias("status"))

    def finish(self, spark: SparkSession, root: str, day: str, added: int, updated: int) -> None:
        pass

    def foreign(self, root: str) -> bool:
        return False


class Registry:
    """Plugins by their ident; none twice."""

    def __init__(self, *plugins: object) -> None:
        self._by: dict[str, object] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: object) -> None:
        if plugin.ident in self._by:
            raise ValueError(f"{plugin.ident} is registered")
        self._by[plugin.ident] = plugin

    def __getitem__(self, ident: str):  # noqa: ANN204
        if ident not in self._by:
            raise ValueError(f"no writer {ident}")
        return self._by[ident]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._by))


WRITERS = Registry(NotesWriter(), PermalinkWriter(), ExchangeWriter())
