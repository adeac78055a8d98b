"""Column functions and operators on small inputs."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnstore.functions import codecs, hashing, names, paths, sizes
from cairnstore.operators import changes, chunking, journal, policy, remote, tree
from cairnstore.sources.config import RepoConfig, check_options, merged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sizes(spark):
    for text, n in (("512B", 512), ("1MB", 1 << 20), ("1 MB", 1 << 20), ("102.4kB", 104857), ("1gb", 1 << 30), ("0.5gb", 1 << 29), ("none", -1), ("", -1)):
        assert one(spark, sizes.parse(F.lit(text))) == n, text
    for n, text in ((0, "0"), (-5, "0"), (512, "512 B"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (3 << 50, "3072 TB")):
        assert one(spark, sizes.readable(F.lit(n).cast("long"))) == text
    for ms, text in ((250, "250 ms"), (12_500, "12.50 s"), (93_784_000, "1d 02:03:04"), (3_723_000, "01:02:03")):
        assert one(spark, sizes.duration(F.lit(ms).cast("long"))) == text
    assert one(spark, sizes.percent(F.lit(7), F.lit(9))) == 77
    assert one(spark, sizes.eta_seconds(F.lit(10), F.lit(40), F.lit(5), F.lit(60))) == 360


def test_paths(spark):
    p = lambda f, *a: one(spark, f(*(F.lit(x) for x in a)))
    assert p(paths.parts, "/a\\b/c//") == ["", "a", "b", "c"] and p(paths.name, "/a/b.tar.gz") == "b.tar.gz"
    assert p(paths.parent, "/a/b/c") == "/a/b" and p(paths.normal, "\\a//b\\\\c") == "a/b/c" and p(paths.resolve, "a/", "/b") == "a/b"
    assert p(paths.codec_key, "/x.y/Makefile") == "Makefile" and p(paths.codec_key, "/a.b.TXT") == "TXT"
    assert p(paths.relation, "/a/b", "/a") == "sub" and p(paths.relation, "/a", "/a/b") == "top" and p(paths.relation, "/a", "/ab") == "none"
    assert p(paths.below_common, "/a/b/c", "/a/x") == "b/c" and p(paths.below_common, "/a", "/a/x") == ""
    assert p(paths.prefixes, "/a/b/c") == ["", "/a", "/a/b"]
    assert p(paths.preview_kind, "/a/B.PNG") == "image" and p(paths.preview_kind, "x.md") == "text" and p(paths.preview_kind, "x.bin") == "unknown"
    assert [one(spark, c) for c in paths.bucket_and_key(F.lit("s3://b/p/q"))] == ["b", "p/q"]
    for glob, yes, no in (("*.txt", "a.txt", "d/a.txt"), ("**.txt", "d/a.txt", "a.txt2"), ("{a,b}?", "b1", "c1"), ("[!x]y", "ay", "xy"), ("a.b", "a.b", "aXb")):
        assert one(spark, F.lit(yes).rlike(paths.glob_regex(glob))) and not one(spark, F.lit(no).rlike(paths.glob_regex(glob)))


def test_names(spark):
    assert one(spark, names.numbered("volume", F.lit(42))) == "volume/volume_000042"
    assert one(spark, names.numbered("volume", F.lit(12345))) == "volume/12/volume_012345"
    assert one(spark, names.number_of("volume", F.lit("volume/12/volume_012345.gz"))) == 12345
    assert one(spark, names.number_of("volume", F.lit("other_1"))) is None
    data = bytes(range(250, 256)) * 3
    assert one(spark, names.from_url64(names.url64(F.lit(bytearray(data))))) == data
    assert names.member(names.Codec, "LZ4") is names.Codec.lz4 and names.codec_by_tag(5) is names.Codec.deflate
    with pytest.raises(ValueError):
        names.member(names.Remote, "sideways")


def test_journal(spark):
    good = [r.x for r in spark.createDataFrame([("File_Finished", "a b.gz", "m1"), ("Start_Writing", None, None)], "t string, f string, m string").select(names.journal_line(F.col("t"), F.col("f"), F.col("m")).alias("x")).collect()]
    lines = [good[1], good[0] + "\r", "7 " + good[0], "junk", good[0].replace("m1", "m22"), good[0][:-2] + "m9", "14 Other_Writing", good[1]]
    j = journal.entries(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))
    assert sorted((r.seq, r.typ) for r in j.collect()) == [(0, "Start_Writing"), (1, "File_Finished"), (5, "File_Finished"), (7, "Start_Writing")]
    assert [(r.file, r.md5) for r in journal.finished(j).collect()] == [("a b.gz", "m1")]
    assert journal.dirty(j)
    assert [r.path for r in journal.unmentioned(spark.createDataFrame([("a b.gz",), ("c",)], "path string"), j).collect()] == ["c"]


@pytest.mark.parametrize("name", [*hashing.HASHES, "sha256"])
def test_hashes(spark, name):
    got = one(spark, hashing.content_hash(F.lit(bytearray(b"abc")), name))
    want = hashlib.sha256(b"abc").digest() if name == "sha256" else hashing.digest_function(name)(b"abc")
    assert bytes(got) == want and len(want) == hashing.HASHES.get(name, 32)


def test_etag(spark):
    data = random.Random(1).randbytes(5000)
    sums = b"".join(hashlib.md5(data[i : i + 2000]).digest() for i in range(0, 5000, 2000))
    tag = hashlib.md5(sums).hexdigest() + "-3"
    d = F.lit(bytearray(data))
    assert one(spark, hashing.etag(d, 2000)) == tag
    assert one(spark, hashing.etag_matches(d, F.lit(f'"{tag}"'), (1, 2), 1000))
    assert one(spark, hashing.etag_matches(d, F.lit(hashlib.md5(data).hexdigest())))
    assert not one(spark, hashing.etag_matches(d, F.lit(tag[:-3] + "9-3"), (1, 2), 1000))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([c.name for c in names.Codec]))
def test_codecs(data, codec):
    assert codecs.unpack(codecs.pack(data, codec)) == data and codecs.pack(data, codec)[0] == names.Codec[codec].tag


def test_unknown_tag():
    with pytest.raises(ValueError):
        codecs.unpack(b"\x63x")


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=6000), st.integers(1, 300), st.integers(0, 700), st.integers(2, 8))
def test_cuts(data, least, more, bits):
    made = list(chunking.cuts(np.frombuffer(data, np.uint8), least, least + more, bits, chunking.byte_table()))
    assert made[0][0] == 0 and made[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(made, made[1:], strict=False))
    assert all(least <= b - a <= least + more for a, b in made[:-1]) and made[-1][1] - made[-1][0] <= least + more


def test_cuts_resist_shifts():
    data = random.Random(2).randbytes(200_000)
    table = chunking.byte_table()
    cut = lambda d: {d[a:b] for a, b in chunking.cuts(np.frombuffer(d, np.uint8), 256, 8192, 9, table)}
    a, b = cut(data), cut(data[:777] + b"!" + data[777:])
    assert len(a & b) > 0.95 * len(a)
    flat = list(chunking.cuts(np.zeros(20_000, np.uint8), 256, 4096, 4, table))
    assert [y - x for x, y in flat[:4]] == [4096] * 4
    assert list(chunking.cuts(np.zeros(0, np.uint8), 1, 2, 1, table)) == [(0, 0)]


def test_packing(spark):
    r = random.Random(3)
    rows = [(lane, i, r.randint(1, 60)) for lane in (1, 2) for i in range(80)]
    got = chunking.pack_volumes(spark.createDataFrame(rows, "lane int, ordinal long, length long"), 100, spare=10).collect()
    for lane in (1, 2):
        mine = sorted((g for g in got if g.lane == lane), key=lambda g: g.ordinal)
        volume, used = 0, 0
        for g in mine:
            if used and used + g.length + 10 > 100:
                volume, used = volume + 1, 0
            assert (g.volume, g.start) == (volume, used)
            used += g.length


def test_roots(spark):
    t = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    roots = lambda *x: sorted(r.path for r in tree.roots(t(*x)).collect())
    assert roots("/a", "/a/b", "/ab", "/c/d", "/c/d/e/f") == ["/a", "/ab", "/c/d"]
    with pytest.raises(Exception, match="twice"):
        roots("/a", "/a")
    files = t("/x/a/1", "/y/b/2", "/z")
    got = lambda r, d: {x.path: x.target for x in tree.targets(files, r, d).collect()}
    assert got(t("/x/a"), "/o")["/x/a/1"] == "/o/1"
    assert got(t("/x/a", "/y/b"), "/o") == {"/x/a/1": "/o/a/1", "/y/b/2": "/o/b/2", "/z": "/o/z"}
    assert got(t("/x/a", "/y/a"), "/o")["/x/a/1"] == "/o/x/a/1"
    assert got(t("/x/a"), None)["/z"] == "/z"


def test_tree(spark):
    entries = spark.createDataFrame([("/a/b/1", False, 5), ("/a/2", False, 7), ("/a", True, 0), ("/a/b/1/x", False, 1)], "path string, is_folder boolean, size long")
    nodes = tree.nodes(entries)
    assert {r.path: r.real for r in nodes.collect()} == {"": False, "/a": True, "/a/b": False, "/a/b/1": True, "/a/2": True, "/a/b/1/x": True}
    assert [r.path for r in tree.children(nodes, "/a").collect()] == ["/a/b", "/a/2"]
    assert tree.lookup(nodes, "/a/b/nope").first().path == "/a/b"
    assert tree.selection_kind(entries) == "both" and tree.selection_kind(entries.where("is_folder")) == "folder" and tree.selection_kind(entries.where("size = 9")) == "none"


def test_changes(spark):
    s = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("c", 1, 2)], "path string, size long, mtime_ms long")
    k = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "path string, size long, mtime_ms long")
    assert sorted((r.path, r.status) for r in changes.classify(s, k).collect()) == [("a", "unchanged"), ("b", "changed"), ("c", "new"), ("c", "storing")]
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(2,), (1,)], "id long")
    assert not changes.is_different(a, b) and changes.is_different(a, b.where("id = 1"))
    d = spark.sql("SELECT timestamp'2024-01-02 03:04:05' snapshot_ts UNION ALL SELECT timestamp'2023-01-01 00:00:00'")
    assert changes.choose(d, 1) == "2024-01-02.030405" and changes.choose(d, "2023-01-01.000000")
    with pytest.raises(ValueError, match="2023"):
        changes.choose(d, "none")
    ids = spark.sql("SELECT array(1L, 9L) file_ids")
    with pytest.raises(Exception, match="no version"):
        changes.assemble(ids, spark.sql("SELECT 1L id, 'p' path")).collect()


def test_policy(spark):
    rated = spark.createDataFrame([("a", "none", 1.0), ("a", "lz4", 0.5), ("a", "gzip", 0.48), ("b", "none", 1.0), ("b", "gzip", 0.6), ("c", "none", 1.0), ("c", "lz4", 1.1)], "ext string, codec string, ratio double")
    won = policy.winners(rated)
    assert {r.ext: r.codec for r in won.collect()} == {"a": "lz4", "b": "gzip", "c": "none"}
    assert [(r.codec, r.extensions) for r in policy.histogram(won).collect()] == [("none", 1), ("lz4", 1), ("gzip", 1)]


def test_remote(spark):
    q = spark.createDataFrame([("a", 5, 0), ("b", 1, 0), ("c", 1, 11), ("d", 9, 0), ("e", 1, 1)], "path string, size long, failures int")
    assert [r.path for r in remote.next_uploads(q, 2).orderBy("place").collect()] == ["b", "a"]
    assert tuple(remote.remaining(q).first()) == (4, 16)


def test_config():
    c = merged(None, {"codec": "gzip"})
    assert merged(c, {"volume_bytes": 5}) == RepoConfig(codec="gzip", volume_bytes=5)
    for bad in ({"hash_algorithm": "blake2b_256"}, {"codec": "zip"}, {"remote_uri": "x"}, {"what": 1}, {"volume_bytes": 0}):
        with pytest.raises(ValueError):
            merged(c, bad)
    with pytest.raises(ValueError):
        check_options({"a": 1, "b": 2}, exclusive=(("a", "b"),))
    with pytest.raises(ValueError):
        check_options({"a": 1, "b": None}, together=(("a", "b"),))
