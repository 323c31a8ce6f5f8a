from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from carryover import canonical as can
from carryover.functions import secrets
from carryover.functions.identity import canonical_id, content_hash
from carryover.functions.text import rfc3339_text
from carryover.operators.coverage import json_leaves, preserved, without_mapped
from carryover.plans import home
from carryover.sinks import notes
from carryover.sources import exports
from tests.conftest import rows

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"


def files(spark, data):
    return spark.createDataFrame([(p, json.dumps(v).encode() if not isinstance(v, bytes) else v) for p, v in data], "path string, content binary")


def test_saved_memory_files(spark):
    item = [{"id": "a", "content": "x", "text": "y", "enabled": False}, {"text": "t"}, {"id": "c", "content": "z", "deleted": True}, {"id": "d"}]
    got = exports.read_saved_memories(files(spark, [("m.json", {"memory": item, "other": 1}), ("n.json", item), ("bad.json", b"{"), ("b.json", b"\xff")]))
    assert rows(got.where("path = 'm.json'"), "body", "memory_enabled", "anomaly") == rows(got.where("path = 'n.json'"), "body", "memory_enabled", "anomaly")
    assert rows(got.where("path = 'm.json'"), "body", "memory_enabled", "anomaly") == sorted([("x", False, "conflicting_memory_content"), ("t", True, None), (None, True, "missing_memory_content")], key=repr)
    left = json_leaves(spark.createDataFrame([(1, json.dumps({"memory": item, "v": {"n": 1}}))], "k int, j string"), "k", "j").where("leaf <> '/memory'")
    assert rows(left, "leaf") == [("/v/n",)]


def test_account_and_project_files(spark):
    acc = [{"account_uuid": "u", "memory_files": [{"path": "/a", "content": "x"}, {"path": None}], "conversations_memory": "old"}, {"account_uuid": "w", "conversations_memory": "c", "project_memories": {"p": "q"}}]
    got = exports.read_account_exports(files(spark, [("memories.json", acc)]))
    assert rows(got, "source_record_id", "anomaly") == sorted([("u:/a", None), ("u:#1", "invalid_memory_file"), ("u:conversations", "legacy_memory_fields_not_reimported"), ("w:conversations", None), ("w:project:p", None)], key=repr)
    pro = [{"uuid": "p", "docs": [{"uuid": "d", "content": ""}, {"filename": "f"}], "prompt_template": "do"}, {"uuid": "q", "prompt_template": "  "}]
    got = exports.read_projects(files(spark, [("projects.json", pro)]))
    assert rows(got, "source_record_id", "dna_class", "anomaly") == sorted([("d", "standard", None), ("p/f", "standard", "missing_project_content"), ("p#instructions", "dna", None)], key=repr)


def test_prompt_logs_and_transcripts(spark):
    log = b"```\n[2024-02-29] [note] hello\n\n[2024-02-30] [x] y\nbroken\n  [2024-02-29] [note] hello  \n```"
    got = exports.read_prompt_logs(files(spark, [("b.chatgpt.md", log), ("a.chatgpt.md", b"[2024-02-29] [note] hello")]))
    assert rows(got, "path", "line_no", "anomaly") == sorted([("a.chatgpt.md", 1, None), ("b.chatgpt.md", 2, "duplicate_prompt_line"), ("b.chatgpt.md", 4, "invalid_prompt_date"), ("b.chatgpt.md", 5, "invalid_prompt_line"), ("b.chatgpt.md", 6, "duplicate_prompt_line")], key=repr)
    t = exports.transcript_counts(files(spark, [("a", [{"mapping": {"x": {}}}, {"mapping": {}}]), ("b", [{"id": 1}]), ("c", b"nope")]))
    assert rows(t) == [("a", 2, True), ("b", 1, False), ("c", 0, False)]


def test_json_secrets():
    value = {"a": [f"x {AWS}"], AWS: 1, "n": {"password": "hunter2hunter2", "other": "hunter2hunter2"}}
    assert secrets.find_in_json(value) == [("aws-access-token", "", 0, 20, True), ("aws-access-token", "/a/0", 2, 22, False), ("password-assignment", "/n/password", 0, 14, False)]
    assert secrets.mask_json(value) == {"a": ["x [secret]"], AWS: 1, "n": {"password": "[secret]", "other": "hunter2hunter2"}}


def test_json_secret_column(spark):
    df = spark.createDataFrame([(json.dumps({"k": AWS}),), (f"not json {AWS}",), (None,), ("",)], "j string")
    assert [[(x["field_path"], x["start"]) for x in r[0]] for r in df.select(secrets.json_findings(F.col("j"))).collect()] == [[("/k", 0)], [("", 9)], [], []]


def test_preserve_unknown(spark):
    assert without_mapped('{"a":{"b":1,"c":2},"d":[1]}', ["/a/b", "/zz", "/d"]) == '{"a": {"c": 2}}'
    assert without_mapped('{"a":{"b":1}}', ["/a/b"]) is None and without_mapped("[1]", []) is None and without_mapped(None, None) is None
    df = spark.createDataFrame([('{"a":1,"x/y":2}', ["/x~1y"]), (None, None), ("{", None)], "j string, m array<string>")
    assert [r[0] for r in preserved(df, "j", "m").select("source_extra").collect()] == ['{"a": 1}', None, None]


def record(spark, **changes):
    base = {"canonical_id": None, "source": ("markdown", "1", "unknown", None), "source_record_id": "n.md", "source_locator": "n.md", "scope": "user", "content": "x", "content_hash": None, "dna_class": "dna", "evidence_level": "measured", "provenance": ("p", "scan", "m", None)} | changes
    ddl = "canonical_id string, source struct<system:string,adapter_version:string,export_version:string,satellite_id:string>, source_record_id string, source_locator string, scope string, content string, content_hash string, dna_class string, evidence_level string, provenance struct<actor:string,actor_kind:string,method:string,source_ref:string>"
    df = spark.createDataFrame([tuple(base.values())], ddl)
    ident = F.coalesce("canonical_id", canonical_id(F.col("source.system"), F.col("source.satellite_id"), F.col("source_record_id")))
    return df.withColumns({"canonical_id": ident, "content_hash": F.coalesce("content_hash", content_hash(F.col("content")))})


@pytest.mark.parametrize(
    "changes,expected",
    [
        ({}, []),
        ({"scope": "planet"}, ["vocabulary:/scope"]),
        ({"content_hash": "sha256:" + "0" * 64}, ["derived:/content_hash"]),
        ({"canonical_id": "x"}, ["derived:/canonical_id", "shape:/canonical_id"]),
        ({"dna_class": None, "provenance": ("p", "robot", "m", None)}, ["missing:/dna_class", "vocabulary:/provenance/actor_kind"]),
    ],
)
def test_record_checks(spark, changes, expected):
    df = record(spark, **changes)
    assert sorted(r[1] for r in can.problems(df).collect()) == expected
    assert sorted(r[1] for r in can.problems(can.completed(df)).collect()) == expected


def test_times(spark):
    cases = {"2024-01-02t03:04:05.123456789+05:30": "2024-01-02T03:04:05.123456789+05:30", "1717922301": "2024-06-09T08:38:21Z", "1717922301.120": "2024-06-09T08:38:21.12Z", "2024-01-02": None, "2024-02-30T00:00:00Z": None, "2024-01-02T24:00:00Z": None, "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in df.select(rfc3339_text(F.col("v"))).collect()] == list(cases.values())


def test_home(spark, tmp_path):
    root = str(tmp_path / "home")
    assert home.init_home(root, "block") == ["index.md", ".control/config.json"] and home.init_home(root) == []
    config = home.read_config(root)
    assert config["gate"] == "block"
    home.write_config(root, config | {"satellites": [{"satellite_id": "a", "path": "/x"}]})
    assert home.read_config(root)["satellites"][0]["path"] == "/x"
    with pytest.raises(ValueError):
        home.write_config(root, {"gate": "maybe"})
        home.read_config(root)
    entries = spark.createDataFrame([("c1", "accepted")], "canonical_id string, disposition string")
    home.file_receipt(entries, root, "a", "r1")
    home.file_receipt(entries, root, "b", "r1")
    with pytest.raises(Exception, match="(?i)exist"):
        home.file_receipt(entries, root, "a", "r1")
    assert rows(home.read_receipts(spark, root, "a"), "canonical_id", "run") == [("c1", "r1")]
    reg = home.register(home.empty_registry(spark), "abcdefgh", "/x")
    seen = spark.createDataFrame([("/x", 3), ("/y", 1)], "path string, records int")
    assert rows(home.discovered(seen, reg), "path", "registered") == [("/x", True), ("/y", False)]


def test_sync_and_severity():
    ran = []

    def one(ident, path):
        ran.append(ident)
        if ident == "bad":
            raise ValueError
        return 3 if ident == "half" else 0

    assert home.sync([("ok", "/a"), ("none", None), ("half", "/b")], one) == 3 and ran == ["ok", "half"]
    assert home.sync([("bad", "/a"), ("ok", "/b")], one) == 1
    assert home.worst_exit([0, 4, 3]) == 4 and home.worst_exit([]) == 0


def test_owner_edits(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a" * 32, "user", "body"), ("b" * 32, "user", "text")], "canonical_id string, scope string, content string")
    notes.write_notes(df, root).collect()
    at = f"{root}/memories/{'a' * 32}.md"
    text = open(at).read()
    with open(at, "w") as f:
        f.write(text.replace("body", "edited").replace('"user"', '"project"'))
    with open(f"{root}/memories/{'c' * 32}.md", "w") as f:
        f.write('---\ncanonical_id: "' + "c" * 32 + '"\n---\nx')
    got = {r[0][0]: sorted(r[1]) for r in notes.divergence(notes.read_notes(spark, root), df).collect()}
    assert got == {"a": ["/content", "/scope"], "c": ["unmanaged"]}
