"""Command line: init, plan, apply, decide, show, discover, sync.

    python -m carryover.cli init HOME
    python -m carryover.cli plan SOURCE --to HOME --report plan.json
    python -m carryover.cli apply plan.json --yes

A source is a folder or ZIP of Markdown notes, note vaults and chat exports. A target is a
folder, with the writer before it where it isn't ``notes`` (``exchange:DIR``). The report
is masked JSON; entries, anomalies, inventory and conflicts lie beside it as parquet. Exit
codes: 0 clean, 1 input or output, 3 incomplete, 4 stale basis.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.functions.canonical_json import canonical, strict_load
from carryover.functions.secrets import RULES, check_policy, mask_json, masked
from carryover.operators import gate
from carryover.plans import home as homes
from carryover.plans import pipeline as pipe
from carryover.plans import plan as plans
from carryover.plans.schemas import validate
from carryover.session import cut, ship_code
from carryover.sinks.files import read_or_none, replace_file
from carryover.sinks.writers import WRITERS


def targets_of(given: list[str]) -> list[tuple[str, str, str]]:
    """(target, writer, folder) of each ``[writer:]folder``; several of one writer are numbered."""
    out = []
    for text in given:
        ident, _, at = text.partition(":") if text.partition(":")[0] in WRITERS else ("notes", "", text)
        n = sum(w == ident for _, w, _ in out)
        out.append((f"{ident}{n + 1}" if n else ident, ident, os.path.realpath(at)))
    if len({at for *_, at in out}) != len(out):
        raise ValueError("two targets are one folder")
    return out


def _policy(root: str, gate_action: str | None, allow: list[str]) -> dict:
    """The home's settings, with what the call overrides."""
    config = homes.read_config(root)
    config = config | ({"gate": gate_action} if gate_action else {}) | {"allowlist": sorted({*config.get("allowlist", []), *allow})}
    check_policy(config.get("gate", "pass"), set(config["allowlist"]))
    return config


def _apart(source: str, targets: list[tuple[str, str, str]], report: str) -> None:
    """Refuses a source, target or report that lies inside another."""
    places = [os.path.realpath(source), *(at for *_, at in targets)]
    inside = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
    for k, a in enumerate(places):
        if any(inside(a, b) or inside(b, a) for b in places[:k]):
            raise ValueError("source and targets overlap")
    if inside(os.path.realpath(report), places[0]):
        raise ValueError("the report would lie in the source")


def _verdicts(spark: SparkSession, root: str) -> DataFrame:
    at = os.path.join(root, homes.CONTROL, "verdicts")
    return spark.read.schema(pipe.VERDICT).parquet(at) if os.path.isdir(at) else spark.createDataFrame([], pipe.VERDICT)


def make(spark: SparkSession, body: dict) -> pipe.Prepared:
    """The plan of a report's source, targets and settings, from what is there now."""
    targets = [tuple(t) for t in body["targets"]]
    return pipe.prepare(spark, body["source"], targets, body["satellite_id"], pipe.receipts(spark, body["home"]), _verdicts(spark, body["home"]), body["policy"], os.path.isfile(os.path.join(body["source"], homes.CONTROL, "config.json")))


def cmd_plan(spark: SparkSession, source: str, to: list[str], report: str, home: str | None = None, satellite: str | None = None, fresh: bool = False, gate_action: str | None = None, allow: list[str] | None = None) -> int:
    targets = targets_of(to)
    home = os.path.realpath(home or targets[0][2])
    _apart(source, targets, report)
    path = os.path.realpath(source)
    policy = _policy(home, gate_action, allow or [])
    known = [(s["satellite_id"], s.get("path")) for s in homes.read_config(home).get("satellites", [])]
    found = homes.resolve(known, path, satellite)
    body = {"source": path, "home": home, "targets": [list(t) for t in targets], "satellite_id": found.satellite_id, "policy": {"gate": policy.get("gate", "pass"), "allowlist": policy["allowlist"]}}
    plan = make(spark, body)
    if found.how == "derived" and not fresh and (moved := pipe.moved_from(spark, plan.records, pipe.receipts(spark, home), found.satellite_id)):
        told = ", ".join(f"{s} ({n} records, {r:.0%})" for s, n, r in moved[:5])
        raise ValueError(f"this source looks like one that moved: {told}; name it with --satellite, or give --new")
    g = plan.gathered
    anomalies = cut(g.output.anomalies.unionByName(pipe.unreported_anomalies(plan.records.join(g.output.records.select("canonical_id", "path", "fields", "mapped"), "canonical_id"))))
    listed = lambda df, *by: [r.asDict() for r in df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by).collect()]
    total = gate.summary(plan.records, []).first().asDict()
    body |= {
        "digest": plan.digest, "kind": g.kind, "system": g.system, "summary": pipe.counts(plan.entries), "inventory": listed(g.inventory, "status", "state"), "anomalies": listed(anomalies, "code"), "gate": {k: v or 0 for k, v in total.items()},
        "counts": [r.asDict() for r in g.output.counts.agg(F.coalesce(F.sum("registered_count"), F.lit(0)).alias("registered"), F.coalesce(F.sum("deleted_count"), F.lit(0)).alias("deleted")).collect()], "unavailable": [r.asDict() for r in g.output.unavailable.distinct().orderBy("system", "layer").collect()],
    }
    validate("report", body)
    replace_file(os.path.abspath(report), (canonical(mask_json(body)) + "\n").encode(), None)
    os.chmod(os.path.abspath(report), 0o600)
    beside = {"entries": plan.entries.drop("own", "alias"), "anomalies": anomalies.select(masked(F.col("path")).alias("path"), "code", "line", masked(F.col("field_path")).alias("field_path")), "inventory": g.inventory, "clusters": plan.clusters}
    for name, df in beside.items():
        df.write.mode("errorifexists").parquet(f"{os.path.abspath(report)}.d/{name}")
    print(json.dumps(body["summary"]))
    return pipe.exit_class(plan.entries)


def _report(path: str) -> dict:
    body = strict_load((read_or_none(os.path.abspath(path)) or b"null").decode())
    validate("report", body)
    return body


def cmd_apply(spark: SparkSession, report: str, yes: bool) -> int:
    body = _report(report)
    if not yes and input(f"Write {body['summary']} to {body['targets']}? [y/N] ").strip().lower() != "y":
        return 3
    home = body["home"]
    entries = pipe.apply(spark, body["digest"], lambda: make(spark, body), pipe.receipts(spark, home), home)
    config = homes.read_config(home)
    others = [s for s in config.get("satellites", []) if s["satellite_id"] != body["satellite_id"]]
    if [s.get("path") for s in config.get("satellites", []) if s["satellite_id"] == body["satellite_id"]] != [body["source"]]:
        homes.write_config(home, config | {"satellites": [*others, {"satellite_id": body["satellite_id"], "path": body["source"]}]})
    done = [r.asDict() for r in entries.groupBy("target", F.coalesce("verification", "code", "status").alias("result")).agg(F.count("*").alias("n")).orderBy("target", "result").collect()]
    print(json.dumps(done))
    return pipe.exit_class(entries)


def cmd_decide(spark: SparkSession, report: str, chosen: list[str], keep: str) -> int:
    """Records which side of conflicts to keep; ``all`` stands for every open one of the report."""
    body = _report(report)
    open_ = spark.read.parquet(f"{os.path.abspath(report)}.d/clusters").groupBy("cluster_id").agg(F.collect_set("canonical_id").alias("canonical_ids"))
    if chosen != ["all"]:
        open_ = open_.where(F.col("cluster_id").isin(chosen))
    bases = ["source", "home"] if keep == "both" else [keep]
    merged = cut(plans.merge_verdicts(_verdicts(spark, body["home"]), open_.withColumn("bases", F.array(*map(F.lit, bases)))))
    merged.write.mode("overwrite").parquet(os.path.join(body["home"], homes.CONTROL, "verdicts"))
    print(merged.count())
    return 0


def cmd_show(spark: SparkSession | None, report: str, conflicts: bool) -> int:
    print(json.dumps(strict_load((read_or_none(os.path.abspath(report)) or b"null").decode()), indent=1, ensure_ascii=False))
    if conflicts:
        for r in spark.read.parquet(f"{os.path.abspath(report)}.d/clusters").orderBy("cluster_id", "basis").toLocalIterator():
            print(json.dumps(mask_json(r.asDict())))
    return 0


def cmd_discover(spark: SparkSession, folders: list[str], root: str | None) -> int:
    rows = []
    for f in folders:
        for at, _, files in os.walk(f):
            n = sum(x.lower().endswith(".md") for x in files)
            if n:
                rows.append((os.path.realpath(at), n))
    known = [(s["satellite_id"], s.get("path"), None) for s in homes.read_config(root).get("satellites", [])] if root else []
    seen = spark.createDataFrame(rows, "path string, records int")
    for r in homes.discovered(seen, spark.createDataFrame(known, homes.REGISTRY)).orderBy("path").collect():
        print(r["path"], r["records"], "registered" if r["registered"] else "new")
    return 0


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="carryover")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("init")
    x.add_argument("home")
    x.add_argument("--gate", choices=["pass", "block"], default="pass")
    x = sub.add_parser("plan")
    x.add_argument("source")
    x.add_argument("--to", required=True, action="append")
    x.add_argument("--report", required=True)
    x.add_argument("--home")
    x.add_argument("--satellite")
    x.add_argument("--new", action="store_true")
    x.add_argument("--gate", choices=["pass", "block"])
    x.add_argument("--allow", action="append", default=[])
    x = sub.add_parser("apply")
    x.add_argument("report")
    x.add_argument("--yes", action="store_true")
    x = sub.add_parser("decide")
    x.add_argument("report")
    x.add_argument("clusters", nargs="+")
    x.add_argument("--keep", choices=["source", "home", "both"], required=True)
    x = sub.add_parser("show")
    x.add_argument("report")
    x.add_argument("--conflicts", action="store_true")
    x = sub.add_parser("discover")
    x.add_argument("folders", nargs="+")
    x.add_argument("--home")
    x = sub.add_parser("sync")
    x.add_argument("home")
    sub.add_parser("rules")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "init":
        print(*homes.init_home(a.home, a.gate))
        return 0
    if a.command == "rules":
        print(*RULES, sep="\n")
        return 0
    if a.command == "show" and not a.conflicts:
        return cmd_show(None, a.report, False)
    spark = spark or SparkSession.builder.appName("carryover").getOrCreate()
    ship_code(spark)
    try:
        if a.command == "plan":
            return cmd_plan(spark, a.source, a.to, a.report, a.home, a.satellite, a.new, a.gate, a.allow)
        if a.command == "apply":
            return cmd_apply(spark, a.report, a.yes)
        if a.command == "decide":
            return cmd_decide(spark, a.report, a.clusters, a.keep)
        if a.command == "show":
            return cmd_show(spark, a.report, True)
        if a.command == "discover":
            return cmd_discover(spark, a.folders, a.home)

        def one(satellite: str, path: str) -> int:
            report = os.path.join(a.home, homes.CONTROL, f"plan-{uuid.uuid4().hex}.json")
            code = cmd_plan(spark, path, [a.home], report)
            return homes.worst_exit([code, cmd_apply(spark, report, True)])

        return homes.sync([(s["satellite_id"], s.get("path")) for s in homes.read_config(a.home).get("satellites", [])], one)
    except plans.StaleBasis as e:
        print(e, file=sys.stderr)
        return 4
    except (ValueError, OSError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
