"""A repository end to end: backups, restore, verify, browse, crash, encryption, streaming."""

import os
import random
from datetime import UTC, datetime

import pytest

from cairnstore import cli
from cairnstore.functions.crypto import WrongPassphrase
from cairnstore.repo import InUse, SnapshotRepo
from cairnstore.sources.tree import blocks, scan
from cairnstore.streaming.ingest import backup_stream

SMALL = {"least": 256, "most": 4096, "bits": 9, "volume_bytes": 30_000, "lanes": 2}


def make_tree(root, seed=1):
    r = random.Random(seed)
    for i in range(12):
        folder = root / f"d{i % 3}" / (f"e{i}" if i % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        body = r.randbytes(r.randint(0, 20_000)) if i % 4 == 0 else (f"line {i % 2} of text\n" * r.randint(1, 900)).encode()
        (folder / f"f{i}.{'bin' if i % 4 == 0 else 'txt'}").write_bytes(body)
    (root / "empty").write_bytes(b"")
    (root / "_hidden").write_bytes(b"x")
    (root / ".dot").write_bytes(b"y")
    (root / "copy1").write_bytes((root / "d1" / "e1" / "f1.txt").read_bytes())
    (root / "hollow").mkdir()
    os.symlink(root / "empty", root / "link")


def contents(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(root) for f in files if not os.path.islink(os.path.join(d, f))}


def test_scan(spark, tmp_path):
    make_tree(tmp_path / "t")
    rows = {r.path: r for r in scan(spark, str(tmp_path / "t"), "# c\n\n**.bin\nd2\n").collect()}
    names = {os.path.relpath(p, tmp_path / "t") for p in rows}
    assert {"empty", "_hidden", ".dot", "hollow", "."} <= names and "link" not in names
    assert not [n for n in names if n.endswith(".bin") or n.startswith("d2")]
    assert rows[str(tmp_path / "t" / "empty")].size == 0
    deep = tmp_path / "deep"
    for i in range(40):
        (deep / "one" / "two" / f"d{i}").mkdir(parents=True)
        (deep / "one" / "two" / f"d{i}" / "f").write_text("x" * i)
    found = scan(spark, str(deep), "**/d7")
    assert found.rdd.getNumPartitions() > 8
    walked = [p for d, _, files in os.walk(deep) for p in (d, *(os.path.join(d, f) for f in files)) if "/d7" not in p]
    assert sorted(r.path for r in found.collect()) == sorted(walked)
    parts = blocks(found.where("NOT is_folder"), 16)
    assert {r.path: r.n for r in parts.groupBy("path").agg({"content": "count"}).withColumnRenamed("count(content)", "n").collect()} == {p: max(1, -(-os.path.getsize(p) // 16)) for p in walked if p.endswith("/f")}


def test_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    make_tree(src)
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), **SMALL)
    first = repo.backup(str(src), at=datetime(2024, 1, 1, tzinfo=UTC))
    assert first["snapshot"] and first["new_chunks"] > 10 and repo.verify().count() == 0
    v1 = contents(src)
    again = repo.backup(str(src), at=datetime(2024, 1, 2, tzinfo=UTC))
    assert not again["snapshot"] and again["new_chunks"] == 0 and "new" not in again
    (src / "copy1").unlink()
    (src / "more.txt").write_text("more")
    with open(src / "d1" / "e1" / "f1.txt", "ab") as f:
        f.write(b"tail")
    third = repo.backup(str(src), at=datetime(2024, 1, 3, tzinfo=UTC))
    assert third["snapshot"] and third["new"] == 1 and third["changed"] == 1
    assert repo.snapshots().count() == 2
    for when, want in (("2024-01-02", v1), (None, contents(src))):
        out = tmp_path / f"out-{when}"
        assert repo.restore_to(str(out), as_of=when) == len(want)
        assert contents(out) == want
        assert repo.restore_to(str(out), as_of=when) == 0
    assert abs(os.stat(out / "hollow").st_mtime - os.stat(src / "hollow").st_mtime) < 1
    names = [r.name for r in repo.browse(str(src)).collect()]
    assert names[:4] == ["d0", "d1", "d2", "hollow"] and "empty" in names
    assert repo.browse(str(src), recursive=True, search="F1").count() == 3
    s = repo.statistics().first()
    assert s.distinct_bytes < s.logical_bytes


@pytest.mark.parametrize("codec", ["none", "gzip", "lzma", "snappy", "deflate", "lz4", "lz4hc"])
def test_codecs_and_key(spark, tmp_path, codec):
    rows = [(f"/r/f{i}.txt", 100 * i, i, bytearray(b"abc" * i * 40)) for i in range(6)]
    files = spark.createDataFrame(rows, "path string, size long, mtime_ms long, content binary")
    word = "secret" if codec in ("none", "lz4") else None
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), word, codec=codec, hash_algorithm="blake2b_256", **SMALL)
    repo.backup(files)
    assert {r.path: bytes(r.content) for r in repo.restore().collect()} == {r[0]: bytes(r[3]) for r in rows}
    if word:
        for wrong in ("other", None):
            with pytest.raises(WrongPassphrase):
                SnapshotRepo.open(spark, str(tmp_path / "repo"), wrong)
    with pytest.raises(ValueError):
        SnapshotRepo.open(spark, str(tmp_path / "repo"), word, hash_algorithm="sha3_256")


def test_damage(spark, tmp_path):
    files = spark.createDataFrame([(f"/r/f{i}", 9, i, bytearray(random.Random(i).randbytes(3000))) for i in range(4)], "path string, size long, mtime_ms long, content binary")
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), codec="none", **SMALL)
    repo.backup(files)
    rows = repo.table("volumes").collect()
    n, (lost, torn) = len(rows), rows[:2]
    kept = [(r.volume, r.hash, r.start, r.content if r.hash != torn.hash else bytearray(b"\0bad"), r.run) for r in rows if r.hash != lost.hash]
    from cairnstore.repo import TABLES

    spark.createDataFrame(kept, TABLES["volumes"]).write.parquet(str(tmp_path / "v"))
    os.rename(tmp_path / "repo" / "volumes", tmp_path / "old")
    os.rename(tmp_path / "v", tmp_path / "repo" / "volumes")
    problems = repo.verify().collect()
    assert n > 4 and torn.hash.hex() and any(p.kind == "content" for p in problems)
    again = repo.backup(files)
    assert again["new_chunks"] == 0


def test_crash(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("/r/a", 3, 1, bytearray(b"abc"))], "path string, size long, mtime_ms long, content binary")
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), **SMALL)
    write = SnapshotRepo._write
    for table in ("volumes", "chunks", "versions", "snapshots"):
        def broken(self, df, name, run, table=table):
            write(self, df, name, run)
            if name == table:
                raise RuntimeError("crash")

        monkeypatch.setattr(SnapshotRepo, "_write", broken)
        with pytest.raises(RuntimeError):
            repo.backup(files)
        assert repo.snapshots().count() == 0 and repo.table("chunks").count() == 0
    monkeypatch.setattr(SnapshotRepo, "_write", write)
    assert repo.clean() == 4
    assert repo.backup(files)["snapshot"] and repo.verify().count() == 0
    open(tmp_path / "repo" / "lock", "w").close()
    with pytest.raises(InUse):
        repo.backup(files)
    with pytest.raises(InUse):
        repo.clean()
    assert repo.clean(force=True) == 0
    repo.backup(files)


def _without(root, table, lose):
    """Rewrites a table of a repository without some of its rows."""
    from cairnstore.repo import TABLES

    def run(spark, repo):
        rows = [r for r in repo.table(table, published=False).collect() if not lose(r)]
        spark.createDataFrame(rows, TABLES[table]).write.parquet(str(root / "kept"))
        os.rename(root / "repo" / table, root / f"old-{table}")
        os.rename(root / "kept", root / "repo" / table)

    return run


def test_lost_payload_and_folder(spark, tmp_path):
    """Verification names chunks without payload and files without their folder."""
    (tmp_path / "src" / "sub").mkdir(parents=True)
    (tmp_path / "src" / "sub" / "a").write_bytes(random.Random(1).randbytes(3000))
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), **SMALL)
    repo.backup(str(tmp_path / "src"))
    assert repo.verify().count() == 0
    lost = bytes(repo.table("chunks").orderBy("start").first().hash)
    _without(tmp_path, "volumes", lambda r: bytes(r.hash) == lost)(spark, repo)
    assert [(p.subject, p.detail) for p in repo.verify().where("kind = 'content'").collect()] == [(lost.hex(), "lost or unreadable")]
    assert [r.content for r in repo.restore().collect()] == [None]
    _without(tmp_path, "folders", lambda r: r.path.endswith("/sub"))(spark, repo)
    assert [p.subject for p in repo.verify().where("kind = 'folder'").collect()] == [str(tmp_path / "src" / "sub" / "a")]


def test_unreadable_stays(spark, tmp_path):
    """A file without content is not stored as an empty one: the known version stays, also when an index row is lost."""
    schema = "path string, size long, mtime_ms long, content binary"
    body = bytearray(random.Random(2).randbytes(700))
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), **SMALL)
    repo.backup(spark.createDataFrame([("/s/old", 700, 1, body)], schema))
    _without(tmp_path, "chunks", lambda r: True)(spark, repo)
    spark.createDataFrame([("/s/new", 3, 2, bytearray(b"abc"))], schema).write.parquet(str(tmp_path / "in"))
    backup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), repo, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.path: bytes(r.content) for r in repo.restore().collect()} == {"/s/old": bytes(body), "/s/new": b"abc"}
    done = repo.backup(spark.createDataFrame([("/s/old", 9, 5, None), ("/s/never", 1, 1, None)], schema))
    assert done["unreadable"] == 2 and [(r.path, r.size) for r in repo.files().collect()] == [("/s/old", 700)]
    assert repo.verify().where("kind = 'chunk'").count() == 1


def test_clean_spares_the_writer(spark, tmp_path, monkeypatch):
    """Nothing is deleted under a writer; a writer whose lock was taken does not publish."""
    files = spark.createDataFrame([("/r/a", 3, 1, bytearray(b"abc"))], "path string, size long, mtime_ms long, content binary")
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), **SMALL)
    write, force = SnapshotRepo._write, []

    def late(self, df, name, run):
        write(self, df, name, run)
        if name == "snapshots":
            if force:
                repo.clean(force=True)
            else:
                with pytest.raises(InUse):
                    repo.clean()

    monkeypatch.setattr(SnapshotRepo, "_write", late)
    assert repo.backup(files)["snapshot"] and [bytes(r.content) for r in repo.restore().collect()] == [b"abc"]
    force.append(True)
    with pytest.raises(InUse):
        repo.backup(files.withColumn("mtime_ms", files["mtime_ms"] + 1))
    assert [r.mtime_ms for r in repo.files().collect()] == [1]


def test_stream(spark, tmp_path):
    schema = "path string, size long, mtime_ms long, content binary"
    repo = SnapshotRepo.open(spark, str(tmp_path / "repo"), **SMALL)
    for n in range(2):
        spark.createDataFrame([(f"/s/{n}", 3, n, bytearray(b"abc")), ("/s/same", 2, 5, bytearray(b"xy"))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = backup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), repo, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert sorted(r.path for r in repo.files().collect()) == ["/s/0", "/s/1", "/s/same"]
    assert repo.table("chunks").count() == 2


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("hello")
    assert cli.main(["backup", str(tmp_path / "repo"), str(tmp_path / "src")], spark) == 0
    assert cli.main(["verify", str(tmp_path / "repo"), "--percent-of-files", "50"], spark) == 0
    assert cli.main(["restore", str(tmp_path / "repo"), "--to-folder", str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out" / "a.txt").read_text() == "hello"
    assert cli.main(["browse", str(tmp_path / "repo"), "--folder", str(tmp_path / "src")], spark) == 0
    assert "a.txt" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["restore", str(tmp_path / "repo")], spark)
    with pytest.raises(ValueError):
        cli.main(["verify", str(tmp_path / "repo"), "--percent-of-files", "500"], spark)
