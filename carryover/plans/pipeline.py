"""From a source to planned, written, verified and filed records, for any number of targets.

``gather`` reads all files that any reader claims; ``prepare`` checks, gates and decides
every record for every target and binds all of it to one digest; ``apply`` makes the plan
again, compares it, writes, reads back, and files what is settled. Records travel as
frames; the driver sees counts, digests and at most one row of an error.
"""

from __future__ import annotations

import datetime
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carryover.canonical import completed, problems, with_record_hash
from carryover.functions.canonical_json import digest
from carryover.operators import gate
from carryover.operators.coverage import json_leaves, unreported
from carryover.operators.decide import clusters, decide
from carryover.operators.history import latest_run, violations
from carryover.operators.relocate import relocation_candidates
from carryover.plans import home as homes
from carryover.plans.plan import StaleBasis, frame_digest, phase
from carryover.session import cut
from carryover.sinks.files import read_or_none, safe_join
from carryover.sinks.writers import WRITERS, record_key
from carryover.sources import inventory, readers

PAST = "struct<canonical_id:string,target_id:string,record_hash:string,content_hash:string,target_hash:string,verified:boolean>"
RECEIPT = (
    f"run_id string, satellite_id string, created_at string, target string, writer string, location string, canonical_id string, source_record_id string, content_hash string, "
    f"status string, code string, detail string, verification string, own {PAST}, alias {PAST}, shared_hash string"
)
VERDICT = "cluster_id string, canonical_ids array<string>, bases array<string>"


@dataclass
class Gathered:
    """Everything a source holds: its inventory with the fate of each file, and what the readers gave."""

    inventory: DataFrame
    output: readers.Output
    kind: str
    system: str


@dataclass
class Prepared:
    """A plan: decided entries, the records behind them, and what they were made from."""

    entries: DataFrame
    records: DataFrame
    clusters: DataFrame
    gathered: Gathered
    digest: str
    satellite: str
    targets: list[tuple[str, str, str]]
    #: digest of what each target is to be written
    batches: dict[str, str] = field(default_factory=dict)


def gather(spark: SparkSession, source: str, satellite: str = "", is_home: bool = False) -> Gathered:
    """Reads a folder or archive with every reader that claims something; raises ValueError for damaged files."""
    files = cut(inventory.scan_zip(spark, source) if os.path.isfile(source) else inventory.scan_folder(spark, source))
    claims = cut(readers.claims(files, home=is_home))
    if twice := claims.groupBy("path").agg(F.count_distinct("reader").alias("n")).where("n > 1").limit(1).collect():
        raise ValueError(f"two readers claim {twice[0]['path']}")
    found = [(r["reader"], r["layer"], r["registered_only"]) for r in claims.select("reader", "layer", "registered_only").distinct().orderBy("reader", "layer").collect()]
    out = readers.read_registered(files.limit(0), "index")
    for reader, layer, registered in found:
        mine = files.join(claims.where((F.col("reader") == reader) & (F.col("layer") == layer)).select("path"), "path", "left_semi")
        out = out + (readers.read_registered(mine, layer) if registered else readers.READERS[reader, layer](mine, satellite))
    if bad := out.errors.limit(1).collect():
        raise ValueError(f"{bad[0]['path']}: {bad[0]['error']}")
    status = F.when(F.col("registered_only").isNull(), "unclaimed").when(F.col("registered_only"), "registered_only").otherwise("claimed")
    listed = inventory.manifest(files).drop("status").join(claims.drop("layer"), "path", "left").select("path", "sha256", "bytes", status.alias("status"), F.when(F.col("bytes") > 0, "data_present").otherwise("empty").alias("state"), "reader")
    names = {r for r, _, _ in found}
    systems = [r[0] for r in out.records.select("source.system").distinct().limit(3).collect()]
    return Gathered(listed, out, "export_bundle" if names & readers.EXPORT_BUNDLES else "directory", systems[0] if len(systems) == 1 else "mixed" if systems else "unknown")


def checked(gathered: Gathered) -> DataFrame:
    """The records, cut, after every rule held: unique ids that follow from their files, closed vocabularies, no secret identity."""
    records = cut(gathered.output.records)
    if twice := violations(records, ["canonical_id"]).limit(1).collect():
        raise ValueError(f"{twice[0][0]} occurs {twice[0]['n']} times")
    if records.join(gathered.inventory.where("status = 'claimed'").select("path"), "path", "left_anti").limit(1).count():
        raise ValueError("a record has no file")
    if bad := problems(records).limit(1).collect():
        raise ValueError(f"{bad[0]['canonical_id']}: {bad[0]['problem']}")
    gate.refuse_identities(records, ["source_record_id", "source_locator"])
    return records


def unmapped_fields(records: DataFrame) -> DataFrame:
    """(canonical_id, leaf): fields of a source that no field of the record took; they are kept in its source_extra."""
    leaves = json_leaves(records, "canonical_id", "fields")
    return unreported(leaves, records.select("canonical_id", F.explode("mapped").alias("path")), "canonical_id").select("canonical_id", "leaf")


def unreported_anomalies(records: DataFrame) -> DataFrame:
    """(path, code, line, field_path): fields that are neither mapped nor kept."""
    kept = json_leaves(records.where("source_extra IS NOT NULL"), "canonical_id", "source_extra").select("canonical_id", "leaf")
    lost = unmapped_fields(records).join(kept, ["canonical_id", "leaf"], "left_anti")
    return lost.join(records.select("canonical_id", "path"), "canonical_id").select("path", F.lit("reader_unreported_field").alias("code"), F.lit(None).cast("bigint").alias("line"), F.col("leaf").alias("field_path"))


def receipts(spark: SparkSession, root: str) -> DataFrame:
    """All receipt entries that are filed in a home."""
    at = os.path.join(root, homes.CONTROL, "receipts")
    return spark.read.schema(RECEIPT).option("recursiveFileLookup", True).parquet(at) if os.path.isdir(at) and os.listdir(at) else spark.createDataFrame([], RECEIPT)


def history_of(filed: DataFrame, satellite: str, targets: list[tuple[str, str, str]]) -> DataFrame:
    """The newest receipt of a satellite, which carries all earlier ones; refuses one that doesn't fit the targets."""
    newest = latest_run(filed.where(F.col("satellite_id") == satellite), "created_at", "run_id")
    if twice := violations(newest, ["target", "canonical_id"]).limit(1).collect():
        raise ValueError(f"a receipt names {twice[0]['canonical_id']} twice")
    places = {t: (w, at) for t, w, at in targets}
    for r in newest.select("target", "writer", "location").distinct().limit(len(targets) + 1).collect():
        if r["target"] in places and places[r["target"]] != (r["writer"], r["location"]):
            raise ValueError(f"target {r['target']} was written elsewhere")
    return newest


def shared_basis(filed: DataFrame, targets: list[tuple[str, str, str]]) -> dict[str, str]:
    """target -> hash of the files that records share, by the newest receipt of any satellite with a verified entry."""
    out = {}
    for target, writer, location in targets:
        mine = filed.where((F.col("target") == target) & (F.col("writer") == writer) & (F.col("location") == location))
        used = mine.groupBy("run_id").agg(F.bool_or(F.col("verification") == "verified").alias("ok")).where("ok").select("run_id")
        row = mine.join(used, "run_id", "left_semi").agg(F.max(F.struct("created_at", "run_id", "shared_hash"))["shared_hash"]).first()
        if row[0]:
            out[target] = row[0]
    return out


def shared_hash(writer: object, location: str) -> str:
    held = {n: read_or_none(safe_join(location, n)) for n in writer.shared} if os.path.isdir(location) else {}
    return digest({n: None if v is None else v.hex() for n, v in held.items()})


def moved_from(spark: SparkSession, records: DataFrame, filed: DataFrame, satellite: str) -> list[tuple[str, int, float]]:
    """(satellite, matched, ratio), best first: known sources whose records this new source holds."""
    if filed.where(F.col("satellite_id") == satellite).limit(1).count():
        return []
    now = records.select(F.lit(satellite).alias("satellite_id"), "source_record_id", "content_hash")
    chains = filed.groupBy("satellite_id").agg(F.max(F.struct("created_at", "run_id")).alias("m")).select("satellite_id", "m.run_id")
    known = filed.join(chains, ["satellite_id", "run_id"], "left_semi").select("satellite_id", "source_record_id", "content_hash")
    found = relocation_candidates(now, known, "satellite_id", "source_record_id", "content_hash")
    return [(r["candidate"], r["matched"], r["ratio"]) for r in found.orderBy(F.desc("matched"), F.desc("ratio"), "candidate").limit(100).collect()]


def prepare(spark: SparkSession, source: str, targets: list[tuple[str, str, str]], satellite: str, filed: DataFrame, verdicts: DataFrame, policy: dict, is_home: bool = False) -> Prepared:
    """Decides every record of a source for every (target, writer, location)."""
    if len({t for t, _, _ in targets}) != len(targets):
        raise ValueError("a target is named twice")
    gathered = gather(spark, source, satellite, is_home)
    records = checked(gathered)
    passed = gate.gated(records, policy.get("gate", "pass"), frozenset(policy.get("allowlist", [])))
    passed = cut(with_record_hash(completed(passed).join(passed.select("canonical_id", "gate_status", "gate_code"), "canonical_id")))
    typed = completed(passed)
    past = cut(history_of(filed, satellite, targets))
    basis = shared_basis(filed, targets)
    planned = states = None
    moved = []
    for target, ident, location in targets:
        w = WRITERS[ident]
        mine = w.planned(typed).withColumns({"target": F.lit(target), "can_update": F.lit(w.can_update), "reads_back": F.lit(w.reads_back), "round_trips": F.lit(w.round_trips)})
        if w.foreign(location):  # an index that isn't ours: nothing may be written beside it
            mine = mine.withColumns({"code": F.when(F.col("status").isin("accepted", "transformed"), "target_untracked").otherwise(F.col("code")), "status": F.when(F.col("status").isin("accepted", "transformed"), "unresolved").otherwise(F.col("status"))})
        held = w.state(spark, location, past.where(F.col("target") == target)).withColumn("target", F.lit(target))
        planned, states = (mine, held) if planned is None else (planned.unionByName(mine), states.unionByName(held))
        moved.append((target, target in basis and basis[target] != shared_hash(w, location)))
    base = passed.select("canonical_id", "record_hash", "content_hash", F.col("conflict_cluster_id").alias("own_cluster"), record_key(typed).alias("key"), "gate_status", "gate_code")
    planned, states = cut(planned.join(base, "canonical_id")), cut(states)
    gate.refuse_identities(planned, ["target_id"])
    # a run before this one may have dropped a record that the source never had: nothing of it is planned
    decided = decide(planned, past, states, verdicts, spark.createDataFrame(moved, "target string, modified boolean"))
    own = planned.select("target", "canonical_id", "target_id", "record_hash", "content_hash")
    now = states.select("target", F.col("target_id"), F.col("target_hash").alias("expected"))
    entries = decided.join(own, ["target", "canonical_id"]).join(now, ["target", "target_id"], "left").join(records.select("canonical_id", "source_record_id"), "canonical_id")
    entries = cut(entries.join(past.select("target", "canonical_id", "own", "alias"), ["target", "canonical_id"], "left"))
    batches = {t: batch_digest(entries.where((F.col("target") == t) & F.col("status").isin("accepted", "transformed"))) for t, _, _ in targets}
    parts = {
        "batches": batches, "entries": frame_digest(entries, ["target", "canonical_id", "rule", "status", "code", "detail", "basis", "target_id", "record_hash", "expected"]),
        "inventory": frame_digest(gathered.inventory, ["path", "sha256", "bytes", "status"]), "policy": {"gate": policy.get("gate", "pass"), "allowlist": sorted(policy.get("allowlist", []))},
        "targets": [list(t) for t in targets], "satellite": satellite, "shared": {t: m for t, m in moved},
    }
    return Prepared(entries, passed, clusters(decided, planned, states, past), gathered, digest(parts), satellite, targets, batches)


def batch_digest(chosen: DataFrame) -> str:
    """Digest of exactly what a writer is about to write, in no order."""
    return frame_digest(chosen, ["canonical_id", "record_hash", "expected"])


def apply(spark: SparkSession, accepted: str, again, filed: DataFrame, home: str) -> DataFrame:  # noqa: ANN001
    """Writes what was accepted and files the receipt; returns its entries.

    ``again`` makes the plan from what is there now; another digest raises StaleBasis.
    """
    started = [False]
    with phase("planning", started):
        plan: Prepared = again()
        if plan.digest != accepted:
            raise StaleBasis("the plan isn't what was accepted")
    run, moment = uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    done: DataFrame | None = None
    for target, ident, location in plan.targets:
        w = WRITERS[ident]
        mine = plan.entries.where(F.col("target") == target)
        writes = F.col("status").isin("accepted", "transformed")
        chosen = plan.records.join(mine.where(writes).select("canonical_id", "expected"), "canonical_id")
        if batch_digest(chosen) != plan.batches[target]:  # records that aren't the ones that were decided
            raise StaleBasis("the batch isn't what was planned")
        with phase("writing", started):
            started[0] = True
            wrote = cut(w.write(chosen, location))
            if wrote.where("status = 'moved'").limit(1).count():
                raise StaleBasis("a target moved while it was written")
            new = mine.where(writes & F.col("expected").isNull()).count()
            n = mine.where(writes).count()
            w.finish(spark, location, moment[:10], new, n - new)
        with phase("reading back", started):
            seen = cut(w.read_back(spark, location, mine.where(writes).select("canonical_id", "target_id", "record_hash")))
        back = seen.select("canonical_id", F.col("record_hash").alias("b_record"), F.col("content_hash").alias("b_content"), F.col("target_hash").alias("b_target"))
        j = mine.join(back, "canonical_id", "left")
        same = (F.col("b_record") == F.col("record_hash")) & (F.col("b_content") == F.col("content_hash"))
        verification = F.when(writes, F.when(F.coalesce(same, F.lit(False)), "verified").when(F.col("b_record").isNull(), "missing").otherwise("mismatch"))
        written = F.struct("canonical_id", "target_id", "record_hash", "content_hash", F.col("b_target").alias("target_hash"), F.lit(True).alias("verified"))
        # taking the home's side settles the source as it is and the home as it was seen
        settled = F.struct("canonical_id", "target_id", "record_hash", "content_hash", F.col("expected").alias("target_hash"), F.lit(True).alias("verified"))
        own = F.when(writes, F.when(F.coalesce(same, F.lit(False)), written).otherwise(written.withField("verified", F.lit(False)))).when(F.col("basis") == "settled", settled).otherwise(F.col("own"))
        full = j.select("target", F.lit(ident).alias("writer"), F.lit(location).alias("location"), "canonical_id", "source_record_id", "content_hash", "status", "code", "detail", verification.alias("verification"), own.cast(PAST).alias("own"), "alias", F.lit(shared_hash(w, location)).alias("shared_hash"))
        done = full if done is None else done.unionByName(full)
    done = cut(done)
    # duplicates refer to what their representative wrote
    rep = done.where("own IS NOT NULL").select(F.col("target").alias("_t"), F.col("canonical_id").alias("_rep"), F.col("own").alias("_own"))
    done = done.join(rep, (F.col("code") == "duplicate_of") & (F.col("detail") == F.col("_rep")) & (F.col("target") == F.col("_t")), "left")
    done = done.withColumn("alias", F.when(F.col("code") == "duplicate_of", F.coalesce("_own", "alias"))).drop("_t", "_rep", "_own")
    # what earlier runs wrote and this source no longer has stays on record
    past = history_of(filed, plan.satellite, plan.targets)
    here = [t for t, _, _ in plan.targets]
    gone = past.where(F.col("target").isin(here)).join(done.select("target", "canonical_id"), ["target", "canonical_id"], "left_anti")
    gone = gone.withColumns({"status": F.lit("omitted"), "code": F.lit("source_missing"), "detail": F.lit(None).cast("string"), "verification": F.lit(None).cast("string")})
    kept = gone.select(*done.columns)
    out = done.unionByName(kept).withColumns({"run_id": F.lit(run), "satellite_id": F.lit(plan.satellite), "created_at": F.lit(moment)})
    out = out.select(*StructType.fromDDL(RECEIPT).names)
    at = os.path.join(home, homes.CONTROL, "receipts", f"{plan.satellite or 'direct'}-{run}")
    out.sortWithinPartitions("target", "canonical_id").write.mode("errorifexists").parquet(at)
    return spark.read.schema(RECEIPT).parquet(at)


def counts(entries: DataFrame) -> list[dict]:
    """[{target, status, code, n}] in order."""
    return [r.asDict() for r in entries.groupBy("target", "status", "code").agg(F.count("*").alias("n")).orderBy("target", "status", "code").collect()]


def exit_class(entries: DataFrame) -> int:
    """3 while a record is rejected, unresolved, or was read back otherwise than written; else 0."""
    bad = F.col("status").isin("rejected", "unresolved")
    if "verification" in entries.columns:
        bad = bad | F.coalesce(F.col("verification").isin("mismatch", "missing"), F.lit(False))
    return 3 if entries.where(bad).limit(1).count() else 0
