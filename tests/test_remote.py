"""A mirror of a repository, export and import."""

import os

from cairnstore.operators import journal
from cairnstore.sources.exchange import export_json, import_json, write_repeat_script
from cairnstore.sources.remote import RateLimit, RemoteStore, mirror


def test_mirror(spark, tmp_path):
    here, there = tmp_path / "here", tmp_path / "there"
    (here / "sub").mkdir(parents=True)
    there.mkdir()
    (here / "a").write_text("aaa")
    (here / "sub" / "b").write_text("bb")
    (here / "same").write_text("s")
    (there / "same").write_text("s")
    (there / "a").write_text("wrong size")
    (there / "left.tmp").write_text("x")
    (there / "extra").write_text("kept")
    store = RemoteStore(spark, str(there))
    assert mirror(spark, str(here), store) == {"put": 2, "deleted": 2, "failed": 0}
    assert (there / "a").read_text() == "aaa" and (there / "sub" / "b").read_text() == "bb" and (there / "extra").exists()
    assert not (there / "left.tmp").exists() and mirror(spark, str(here), store)["put"] == 0
    assert store.exists("a") and not store.exists("z") and store.size("sub/b") == 2
    store.get("a", str(tmp_path / "back"))
    assert (tmp_path / "back").read_text() == "aaa"


def test_mirror_gives_up(spark, tmp_path):
    (tmp_path / "here").mkdir()
    (tmp_path / "here" / "a").write_text("a")

    class Broken(RemoteStore):
        tries = 0

        def put(self, local, path):
            Broken.tries += 1
            raise OSError("down")

    assert mirror(spark, str(tmp_path / "here"), Broken(spark, str(tmp_path / "there")), retries=3)["failed"] == 1 and Broken.tries == 3


def test_exchange(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\0\xff"), "x"), (2, None, None)], "id long, hash binary, t string")
    export_json(df, str(tmp_path / "e"))
    (tmp_path / "e" / "bad.json").write_text('{"id": 3, "t": "y"}\n{"id": "no"}\n{oops\n')
    rows, bad = import_json(spark, str(tmp_path / "e"), "id long, hash binary, t string")
    assert sorted((r.id, r.hash) for r in rows.collect()) == [(1, bytearray(b"\0\xff")), (2, None), (3, None)] and bad.count() == 2
    assert write_repeat_script(str(tmp_path / "again.sh"), "/r", "/my files") and not write_repeat_script(str(tmp_path / "again.sh"), "/r", "/f")
    assert "'/my files'" in (tmp_path / "again.sh").read_text() and os.access(tmp_path / "again.sh", os.X_OK)


def test_journal_files(spark, tmp_path):
    lines = spark.createDataFrame([("Start_Writing", None, None), ("File_Finished", "v/a", "m")], "typ string, file string, md5 string").coalesce(1)
    journal.append(lines, str(tmp_path / "j"))
    assert [(r.typ, r.file) for r in journal.entries(journal.read(spark, str(tmp_path / "j"))).orderBy("seq").collect()] == [("Start_Writing", None), ("File_Finished", "v/a")]


def test_journal_order(spark, tmp_path):
    """Lines of separate appends are read in the order of writing."""
    for typ, want in (("Start_Writing", True), ("Stop_Writing", False), ("Start_Writing", True), ("Stop_Writing", False)):
        journal.append(spark.createDataFrame([(typ, None, None)], "typ string, file string, md5 string").coalesce(1), str(tmp_path / "j"))
        assert journal.dirty(journal.entries(journal.read(spark, str(tmp_path / "j")))) is want
    many = spark.createDataFrame([(i, "File_Finished", f"f {i % 50}", f"m{i}") for i in range(200)], "seq long, typ string, file string, md5 string").repartition(4)
    journal.append(many, str(tmp_path / "j"))
    held = journal.entries(journal.read(spark, str(tmp_path / "j")))
    assert {r.file: r.md5 for r in journal.finished(held).collect()} == {f"f {i}": f"m{i}" for i in range(50)}


def test_rate_limit():
    now, slept = [0.0], []
    limit = RateLimit(100, clock=lambda: now[0], sleep=slept.append)
    for size in (50, 100, 0):
        limit.take(size)
    assert slept == [0.5, 1.5]
    RateLimit(None).take(10**12)
