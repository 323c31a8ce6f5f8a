from __future__ import annotations

import json
import os
import shutil

import pytest

from carryover.cli import main
from tests.conftest import rows
from tests.test_files_plan import put


@pytest.fixture(autouse=True)
def small_plans(spark):
    """Few rows in many small jobs: compiling them takes longer than running them."""
    fast = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in fast}
    for k, v in fast.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def entries(spark, report):
    return {r["canonical_id"]: (r["target"], r["status"], r["code"]) for r in spark.read.parquet(f"{report}.d/entries").collect()}


def summary(report):
    return sorted((x["target"], x["status"], x["code"], x["n"]) for x in json.load(open(report))["summary"])


def test_whole_cycle(spark, tmp_path, capsys):
    src, home = str(tmp_path / "src"), str(tmp_path / "home")
    put(src, "a.md", "---\ntype: preference\n---\nOne\n")
    put(src, "copy.md", "---\ntype: preference\n---\n One \n")
    put(src, "b.md", "Bee\n")
    put(src, "MEMORY.md", "- [a](a.md)")
    put(src, "secret.md", "password=hunter2hunter2")
    put(src, "chat/memory.json", json.dumps({"memory": [{"id": "m1", "content": "hello", "extra": {"k": 1}}, {"id": "m2", "content": "gone", "deleted": True}, {"id": "m3", "text": "off", "enabled": False}, {"id": "m4"}], "version": 2}))
    put(src, "chat/log.chatgpt.md", "[2024-01-02] [preference] likes  tea\n[2024-01-02] [preference] likes tea\nbroken\n")
    put(src, "acc/memories.json", json.dumps([{"account_uuid": "u", "memory_files": [{"path": "/p", "content": "account text", "type": "project"}, {"path": None}]}]))
    put(src, "acc/projects.json", json.dumps([{"uuid": "p", "name": "n", "docs": [{"uuid": "d", "content": "doc"}], "prompt_template": "be brief"}]))
    put(src, "acc/users.json", "[]")
    assert main(["init", home, "--gate", "block"]) == 0
    report = str(tmp_path / "p1.json")
    assert main(["plan", src, "--to", home, "--report", report], spark) == 3  # one is rejected
    body = json.load(open(report))
    assert summary(report) == [("notes", "accepted", None, 7), ("notes", "omitted", "duplicate_of", 1), ("notes", "rejected", "password-assignment", 1), ("notes", "unresolved", "memory_disabled", 1)]
    assert {x["code"]: x["n"] for x in body["anomalies"]} == {"missing_memory_content": 1, "uncarried_export_field": 1, "duplicate_prompt_line": 1, "invalid_prompt_line": 1, "invalid_memory_file": 1}
    assert (body["kind"], body["system"], body["counts"]) == ("export_bundle", "mixed", [{"registered": 2, "deleted": 1}])
    assert body["gate"]["blocked"] == 1 and "hunter2" not in open(report).read() and os.stat(report).st_mode & 0o777 == 0o600
    assert main(["apply", report, "--yes"], spark) == 3
    assert len(os.listdir(f"{home}/memories")) == 7
    assert open(f"{home}/index.md").read().count("](memories/") == 7 and "- +7 ~0" in open(f"{home}/log.md").read()
    # the source changes one record and loses others, the owner edits two notes: one conflict, one edit
    put(src, "b.md", "Two\n")
    shutil.rmtree(f"{src}/acc")
    os.unlink(f"{src}/chat/log.chatgpt.md")
    os.unlink(f"{src}/secret.md")
    named = lambda text: next(f"{home}/memories/{n}" for n in os.listdir(f"{home}/memories") if text in open(f"{home}/memories/{n}").read())
    edited, torn = named("hello"), named("Bee\n")
    for at in (edited, torn):
        with open(at, "a") as f:
            f.write("by hand")
    second = str(tmp_path / "p2.json")
    assert main(["plan", src, "--to", home, "--report", second], spark) == 3
    assert summary(second) == [("notes", "omitted", "already_migrated", 1), ("notes", "omitted", "duplicate_of", 1), ("notes", "omitted", "home_modified", 1), ("notes", "unresolved", "conflict", 1), ("notes", "unresolved", "memory_disabled", 1)]
    assert entries(spark, second)[os.path.basename(edited)[:-3]] == ("notes", "omitted", "home_modified")
    assert main(["show", second, "--conflicts"], spark) == 0 and '"basis": "home"' in capsys.readouterr().out
    assert main(["decide", second, "all", "--keep", "source"], spark) == 0
    assert main(["sync", home], spark) == 3  # the disabled memory stays open
    assert open(torn).read().endswith("Two\n") and open(edited).read().endswith("by hand")
    filed = spark.read.option("recursiveFileLookup", True).parquet(f"{home}/.control/receipts").where("code = 'source_missing'")
    assert rows(filed, "status", "verification", "own.verified") == sorted([("omitted", None, True)] * 4 + [("omitted", None, None)], key=repr)
    assert main(["plan", src, "--to", f"{src}/x", "--report", str(tmp_path / "p4.json")], spark) == 1  # they overlap
    assert main(["discover", src, "--home", home], spark) == 0 and "registered" in capsys.readouterr().out
    assert main(["show", second]) == 0 and main(["rules"]) == 0


def test_three_targets_and_a_moved_source(spark, tmp_path, capsys):
    src, home, rows_, vault = (str(tmp_path / x) for x in ("src", "home", "rows", "vault"))
    for k in range(6):  # as many as it takes to tell a moved source
        put(src, f"n{k}.md", f"# Note {k}\ntext {k}")
    put(src, "vault/x.md", "---\npermalink: some/where\n---\nsee [[other]]")
    main(["init", home])
    first, third = (str(tmp_path / f"r{k}.json") for k in range(2))
    to = ["--to", home, "--to", f"exchange:{rows_}", "--to", f"permalink:{vault}"]
    assert main(["plan", src, *to, "--report", first], spark) == 0
    assert summary(first) == [(t, "accepted", None, 7) for t in ("exchange", "notes", "permalink")]
    assert main(["apply", first, "--yes"], spark) == 0
    assert sorted(os.listdir(vault)) == [f"note-{k}.md" for k in range(6)] + ["some"]
    assert spark.read.json(f"{rows_}/records.json").count() == 7
    os.rename(src, src + "2")
    assert main(["plan", src + "2", *to, "--report", third], spark) == 1 and "moved" in capsys.readouterr().err
    known = json.load(open(first))["satellite_id"]
    config = json.load(open(f"{home}/.control/config.json"))
    assert [(x["satellite_id"], x["path"]) for x in config["satellites"]] == [(known, os.path.realpath(src))]
