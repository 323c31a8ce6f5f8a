from __future__ import annotations

import json

from carryover.sources import readers
from tests.conftest import rows
from tests.test_envelope import notes_of, sample


def inventory(spark, data):
    return spark.createDataFrame([(p, 0, v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else json.dumps(v).encode()) for p, v in data.items()], "path string, length bigint, content binary")


def test_claims_by_shape_and_folder(spark):
    files = {
        "a/memories.json": [{"content": "x"}], "b/memories.json": [{"account_uuid": "u"}], "c/memories.json": [], "d/memories.json": [], "d/user.json": {}, "e/memories.json": "broken", "e/projects.json": [], "f/memories.json": [{"odd": 1}],
        "g/conversations.json": [{"mapping": {}}], "h/conversations.json": [{"chat_messages": []}], "i/conversations.json": [{}], "d/conversations.json": [{}],
        "n.md": "---\npermalink: a/b\n---\nx", "m.md": "---\npermalink: 3\n---\nx", "MEMORY.md": "", "index.md": "", "l.chatgpt.md": "", "memory.db": b"\0", "z.bin": b"\0", ".control/x.md": "", "bad.md": b"\xff",
    }
    got = rows(readers.claims(inventory(spark, files)), "path", "reader", "layer", "registered_only")
    assert got == sorted([
        ("a/memories.json", "chat", "saved_memory", False), ("b/memories.json", "account", "saved_memory", False), ("c/memories.json", "account", "saved_memory", False), ("d/memories.json", "chat", "saved_memory", False), ("d/user.json", "chat", "instruction", True),
        ("e/memories.json", "account", "saved_memory", False), ("e/projects.json", "account", "project_doc", False), ("g/conversations.json", "chat", "transcript", True), ("h/conversations.json", "account", "transcript", True), ("d/conversations.json", "chat", "transcript", True),
        ("n.md", "notes", "note", False), ("m.md", "markdown", "memory", False), ("MEMORY.md", "markdown", "index", True), ("index.md", "markdown", "memory", False), ("l.chatgpt.md", "chat", "prompt_extract", False), ("memory.db", "notes", "vector_index", True), ("bad.md", "markdown", "memory", False),
    ], key=repr)


def test_project_notes_and_damage(spark):
    meta = "metadata:\n  node_type: memory\n  type: preference\n  originSessionId: s1\n  modified: 2024-01-02T03:04:05Z\n  other: 1"
    files = {"projects/demo/memory/m.md": f"---\n{meta}\n---\nhi", "x/y.md": f"---\n{meta}\n---\nho", "open.md": "---\nno end", "odd.md": "---\ntype: [a]\n---\nx", "bad.md": b"\xff"}
    out = readers.read_markdown(inventory(spark, files), "sat")
    got = {r["path"]: r for r in out.records.where("path LIKE '%/%'").collect()}
    m = got["projects/demo/memory/m.md"]
    assert (m["scope"], m["scope_qualifier"], m["dna_class"], m["updated_at"], m["provenance"]["evidence"][0]["source_ref"], m["provenance"]["actor_kind"]) == ("project", "sat/demo", "dna", "2024-01-02T03:04:05Z", "session:s1", "scan")
    assert json.loads(m["source_extra"]) == {"frontmatter": {"metadata": {"other": 1}}} and got["x/y.md"]["scope_qualifier"] == "sat/x"
    assert rows(out.anomalies, "path", "code") == [("open.md", "frontmatter_unclosed"), ("x/y.md", "project_scope_relative_fallback")]
    assert rows(out.errors) == [("bad.md", "not UTF-8"), ("odd.md", "a kind is no text")]


def test_managed_notes_come_back_as_records(spark):
    df = sample(spark).where("source_record_id = 'n.md'")
    files = notes_of(spark, df, lambda t: t + "!")
    out = readers.read_managed(files)
    r, before = out.records.first(), df.first()
    assert (r["canonical_id"], r["source_record_id"], r["content"]) == (before["canonical_id"], "n.md", before["content"] + "!")
    assert rows(out.anomalies, "code", "field_path") == [("note_body_changed", "/body")] and out.errors.count() == 0
    assert [x[1:] for x in rows(readers.claims(files), "path", "reader", "layer")] == [("markdown", "managed")]
