from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from carryover.functions.identity import content_hash
from carryover.plans import plan as plans
from carryover.plans.home import empty_registry, register, resolve
from carryover.sinks import exchange, files, notes
from carryover.sources import exports, inventory, markdown
from carryover.streaming.snapshots import follow_snapshots
from tests.conftest import rows


def put(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_folder_scan_and_markdown(spark, tmp_path):
    root = str(tmp_path / "v")
    put(root, "note.md", "---\nname: T\ntype: preference\ntags: [a, 'b c']\nmetadata:\n  node_type: other\n---\nBödy [[x]]\n")
    put(root, "projects/demo/memory/m.md", "---\ntype: project\nmetadata:\n  node_type: memory\n---\nhi")
    put(root, "n/p.md", "---\npermalink: a/b\ntags:\n- x\n- y\ncreated: 2024-01-01\n---\nsee [[link]]")
    put(root, "MEMORY.md", "- [a](b)\n  - [c](d)\n- no")
    put(root, "open.md", "---\nno end")
    put(root, "bad.md", b"\xff\xfe")
    put(root, ".control/receipts/x.md", "x")
    put(root, "a.bin", b"\0")
    scan = inventory.scan_folder(spark, root)
    assert [r[0] for r in rows(inventory.manifest(scan), "path")] == sorted(["note.md", "projects/demo/memory/m.md", "n/p.md", "MEMORY.md", "open.md", "bad.md", "a.bin"])
    got = {r["path"]: r for r in markdown.markdown_records(scan).collect()}
    assert got["note.md"]["canonical_id"] == "i4qddchtghm45k3wcgh2alzcsh326qn4"
    assert (got["note.md"]["content"], got["note.md"]["tags"], got["note.md"]["dna_class"]) == ("Bödy [[x]]\n", ["a", "b c"], "dna")
    assert (got["projects/demo/memory/m.md"]["scope"], got["projects/demo/memory/m.md"]["scope_qualifier"]) == ("project", "demo")
    assert (got["n/p.md"]["source_record_id"], got["n/p.md"]["tags"], got["n/p.md"]["anomalies"]) == ("a/b", ["x", "y"], ["relations_body_only"])
    assert (got["MEMORY.md"]["registered_only"], got["MEMORY.md"]["links"]) == (True, 2)
    assert got["open.md"]["anomalies"] == ["frontmatter_unclosed"] and got["bad.md"]["anomalies"] == ["invalid_utf8"]
    os.symlink("note.md", os.path.join(root, "link.md"))
    with pytest.raises(ValueError):
        inventory.scan_folder(spark, root)


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["a\\b"], ["C:x"], ["a/../b"], ["a", "./a"], ["x\0y"], ["a/b", "a//b"]])
def test_hostile_zip_names(names):
    with pytest.raises(ValueError):
        inventory.check_names(names)


def test_zip_scan(spark, tmp_path):
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d/", "")
        z.writestr("./d/a.md", "hello")
        z.writestr("empty.txt", "")
    assert rows(inventory.scan_zip(spark, path).select("path", "length")) == [("d/a.md", 5), ("empty.txt", 0)]
    with zipfile.ZipFile(path, "a") as z, pytest.warns(UserWarning):
        z.writestr("empty.txt", "again")
    with pytest.raises(ValueError):
        inventory.scan_zip(spark, path)


def test_claims(spark):
    names = ["a/memory.json", "a/memories.json", "b/projects.json", "b/conversations.json", "c/memories.json", "x.chatgpt.md", "n.MD", "z.bin", "m/memory.json", "m/projects.json", "m/memories.json"]
    got = dict(exports.source_shape(spark.createDataFrame([(n,) for n in names], "path string"), "path").select("path", "claim").collect())
    assert [got[n] for n in names] == ["saved_memories", "saved_memories", "account_export", "account_export", "ambiguous", "prompt_log", "markdown", None, "saved_memories", "account_export", "ambiguous"]
    twice = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "path string, reader string")
    assert rows(exports.claims_twice(twice, "path", "reader")) == [("p", 2)]


def test_safe_files(tmp_path):
    root = str(tmp_path)
    os.symlink("/tmp", os.path.join(root, "link"))
    for bad in ("../x", "/x", "a\\b", "", "link/x", "c:x"):
        with pytest.raises(ValueError):
            files.safe_join(root, bad)
    at = files.safe_join(root, "d/./f")
    files.replace_file(at, b"1", None)
    with pytest.raises(RuntimeError):
        files.replace_file(at, b"2", None)
    files.replace_file(at, b"2", b"1")
    assert files.read_or_none(at) == b"2" and files.read_or_none(at + "x") is None
    with pytest.raises(ValueError):
        files.read_or_none(os.path.join(root, "d"))


def records(spark, data):
    df = spark.createDataFrame(data, "canonical_id string, scope string, scope_qualifier string, source_kind string, content string")
    return df.withColumns({"content_hash": content_hash(F.col("content")), "source": F.struct(F.lit("markdown").alias("system"), F.lit(None).cast("string").alias("satellite_id")), "created_at": F.lit("2024-01-01T00:00:00Z"), "updated_at": F.lit(None).cast("string")})


def test_plan_apply_round_trip(spark, tmp_path):
    root = str(tmp_path / "out")
    df = records(spark, [("a" * 32, "user", None, "profile", 'line "one"\r\n---\nend'), ("b" * 32, "project", "p: q", None, "")])
    hashes = df.select("canonical_id", "content_hash")
    none = hashes.limit(0)

    def state():
        if not os.path.isdir(os.path.join(root, "memories")):
            return none
        return notes.read_notes(spark, root).select("canonical_id", content_hash(F.col("body")).alias("content_hash"))

    again = lambda: plans.make_plan(hashes, none, state(), root)
    plan = again()
    assert plans.exit_code(plan) == 0 and rows(plans.summary(plan)) == [("accepted", None, 2)]
    with pytest.raises(plans.StaleBasis):
        plans.apply_plan("sha256:0", again, df, lambda x: notes.write_notes(x, root), state, None, "r0", ["content_hash"])
    old = spark.createDataFrame([("z" * 32, "accepted", "verified", "")], "canonical_id string, disposition string, verification string, differing string")
    receipt = plans.apply_plan(plan.digest, again, df, lambda x: notes.write_notes(x, root), state, old, "r1", ["content_hash"])
    assert rows(receipt, "disposition", "verification", "reason") == sorted([("accepted", "verified", None)] * 2 + [("omitted", None, "source_missing")], key=repr)
    settled = plans.make_plan(hashes, hashes, state(), root)
    assert rows(plans.summary(settled)) == [("omitted", "unchanged", 2)]
    assert rows(notes.write_notes(df, root), "status") == [("unchanged",)] * 2
    with open(os.path.join(root, "memories", "a" * 32 + ".md"), "a") as f:
        f.write("edited")
    assert rows(plans.summary(plans.make_plan(hashes, hashes, state(), root))) == sorted([("omitted", "unchanged", 1), ("unresolved", "target_changed", 1)], key=repr)
    with pytest.raises(ValueError):
        plans.make_plan(hashes.union(hashes), none, none, root)


def test_digest_ignores_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    first = plans.frame_digest(df, ["a", "b"])
    assert first == plans.frame_digest(df.orderBy(F.desc("id")).repartition(7), ["a", "b"])
    assert first != plans.frame_digest(df.union(df.limit(1)), ["a", "b"])
    assert first != plans.frame_digest(df.withColumn("b", F.lit("")), ["a", "b"])


def test_exchange(spark):
    df = exchange.projection(records(spark, [("a", "user", None, "profile", "x"), ("b", "project", "q", "tool", "y")]))
    assert rows(df, "kind", "address", "hash_holds") == [("identity", "user/-", True), ("semantic", "project/q", True)]
    assert exchange.contradictions(df, "canonical_id").count() == 0
    assert rows(exchange.contradictions(df.withColumn("kind", F.lit("working")), "canonical_id")) == [("a", "kind"), ("b", "kind")]
    new = df.where("canonical_id = 'b'").withColumn("content", F.lit("z"))
    assert rows(exchange.merge_by_id(df, new, "canonical_id"), "canonical_id", "content") == [("a", "x"), ("b", "z")]


def test_log_and_registry(spark):
    log = notes.prepend_log(None, "2024-01-01", 2, 0)
    log = notes.prepend_log(log, "2024-01-01", 0, 1)
    log = notes.prepend_log(log, "2024-01-02", 1, 1)
    assert log == "# Log\n## 2024-01-02\n- +1 ~1\n## 2024-01-01\n- +0 ~1\n- +2 ~0\n"
    with pytest.raises(ValueError):
        notes.prepend_log(log, "2023-01-01", 1, 0)
    reg = register(empty_registry(spark), "abcdefgh", "/a")
    with pytest.raises(ValueError):
        register(reg, "abcdefgh", "/b")
    known = [(r[0], r[1]) for r in reg.collect()]
    assert resolve(known, "/a").how == "path" and resolve(known, "/b").how == "derived" and resolve(known, "/b", "zzzzzzzz").how == "explicit"
    with pytest.raises(ValueError):
        resolve(known, "/b", "abcdefgh")


def test_stream_of_snapshots(spark, tmp_path):
    src, state, out, cp = (str(tmp_path / x) for x in ("src", "state", "out", "cp"))
    mk = lambda d: spark.createDataFrame(d, "id string, h string").coalesce(1).write.mode("append").parquet(src)
    deliveries = [[("a", "1"), ("b", "1"), (None, "x"), ("b", "1")], [("b", "2"), ("c", "1")]]
    for d in deliveries:
        mk(d)
        stream = spark.readStream.schema("id string, h string").parquet(src)
        follow_snapshots(stream, "id", "h", state, out, cp).awaitTermination()
    assert rows(spark.read.parquet(out), "batch", "id", "change") == [(0, "a", "added"), (0, "b", "added"), (1, "a", "removed"), (1, "b", "changed"), (1, "c", "added")]


def test_index(spark, tmp_path):
    df = records(spark, [(x * 32, "project" if x in "bc" else "user", "q" if x in "bc" else None, None, x) for x in "cab"])
    lines = notes.index_lines(df)
    assert [(r["label"], r["entries"], r["first"][3]) for r in notes.index_summary(lines).orderBy("label").collect()] == [("project: q", 2, "b"), ("user", 1, "a")]
    notes.write_index(lines, str(tmp_path / "index"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "index")).collect()]
    assert sorted(text) == sorted(f"{label}\t- [{x * 32}](memories/{x * 32}.md)" for label, x in (("project: q", "b"), ("project: q", "c"), ("user", "a")))
