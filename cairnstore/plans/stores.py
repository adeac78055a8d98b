"""Queries that go through sources and sinks: trees of files, repositories, exchange, second places, options.

Trees are written from `nation` and `region` (a folder for each region, a file for each nation), so every query has the
SQL that gives the same rows. What is written lies in a new folder of the shared one and goes with the application.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths, sizes
from ..operators import changes, tree
from .catalogue import FILES, _scratch, files, query, table

NATIONS = "SELECT '/' || r_name || '/' || n_name || '.txt' AS path, r_name, n_name, n_nationkey, coalesce(n_name, '') || repeat('x', CAST(n_nationkey AS INTEGER)) AS body FROM nation JOIN region ON n_regionkey = r_regionkey"


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """path, content and time of a file for each nation."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat("n_name", F.repeat(F.lit("x"), F.col("n_nationkey").cast("int")))
    path = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit(".txt"))
    return rows.select(path.alias("path"), "r_name", "n_name", F.lit(False).alias("is_folder"), F.length(body).cast("long").alias("size"), (F.col("n_nationkey") * 1000 + 10**12).cast("long").alias("mtime_ms"), body.cast("binary").alias("content"))


def with_folders(rows: DataFrame) -> DataFrame:
    folders = rows.select(paths.parent(F.col("path")).alias("path"), F.lit(True).alias("is_folder"), F.lit(0).cast("long").alias("size"), F.lit(10**12).cast("long").alias("mtime_ms")).distinct()
    return rows.select("path", "is_folder", "size", "mtime_ms", "content").unionByName(folders, allowMissingColumns=True)


def local(url: str) -> str:
    return url.removeprefix("file://")


def written(spark: SparkSession, sf: str) -> str:
    """A tree of the nations' files, with a link and an ignored folder."""
    root = local(_scratch(spark))
    for r in nations(spark, sf).toLocalIterator():
        os.makedirs(os.path.dirname(root + r.path), exist_ok=True)
        with open(root + r.path, "wb") as f:
            f.write(r.content)
    os.makedirs(f"{root}/skip/deep", exist_ok=True)
    with open(f"{root}/skip/deep/x.txt", "w") as f:
        f.write("x")
    os.symlink(f"{root}/skip", f"{root}/link")
    return root


def repository(spark: SparkSession, sf: str, **more):
    from ..repo import SnapshotRepo

    repo = SnapshotRepo.open(spark, _scratch(spark), codec="none", hash_algorithm="sha256", least=256, most=8192, bits=10, **more)
    repo.backup(with_folders(nations(spark, sf)))
    return repo


def below(root: str):
    return F.substring("path", len(root) + 1, 10_000)


@query(f"SELECT path, false AS is_folder, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM ({NATIONS}) n UNION ALL SELECT '/' || r_name, true, 0, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def scan_tree(spark, sf):
    """Files and folders, ignored ones and links left out."""
    from ..sources.tree import scan

    root = written(spark, sf)
    rows = scan(spark, root, "/skip\nskip\n", content=True).where(F.col("path") != root)
    return rows.select(below(root).alias("path"), "is_folder", "size", F.when(~F.col("is_folder"), F.sha2("content", 256)).alias("sha256"))


@query(f"SELECT path, CAST(i AS INTEGER) AS block_nr, CAST(i * 7 AS BIGINT) AS start, sha256(substr(body, i * 7 + 1, 7)) AS sha256 FROM ({NATIONS}) n, range(0, 1000) r(i) WHERE i < greatest(1, CAST(ceil(strlen(body) / 7.0) AS BIGINT))")
def scan_blocks(spark, sf):
    """Files read in ranges, each by itself."""
    from ..sources.tree import blocks, scan

    root = written(spark, sf)
    rows = blocks(scan(spark, root, "skip").where("NOT is_folder"), 7)
    return rows.select(below(root).alias("path"), "block_nr", "start", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT path, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256, 1000000000000 + n_nationkey * 1000 AS mtime_ms, 25 AS files, 0 AS again FROM ({NATIONS}) n")
def restore_files(spark, sf):
    """A backup restored to a folder, read again; a second restore writes nothing."""
    from ..sources.tree import scan

    repo, root = repository(spark, sf), local(_scratch(spark))
    first, again = repo.restore_to(root), repo.restore_to(root)
    rows = scan(spark, root, content=True).where("NOT is_folder")
    return rows.select(below(root).alias("path"), "size", F.sha2("content", 256).alias("sha256"), "mtime_ms", F.lit(first).alias("files"), F.lit(again).alias("again"))


@query(f"""SELECT 'content' AS kind, sha256(body) AS subject, 'lost or unreadable' AS detail FROM ({NATIONS}) n WHERE n_nationkey % 5 = 0
 UNION ALL SELECT 'chunk', sha256(body), 'missing' FROM ({NATIONS}) n WHERE n_nationkey % 7 = 1
 UNION ALL SELECT 'folder', path, '/' || r_name FROM ({NATIONS}) n WHERE r_name = 'ASIA'""")
def repository_damage(spark, sf):
    """Payloads, index rows and a folder's row are lost; verification names each."""
    repo = repository(spark, sf)
    rows = nations(spark, sf).select(F.unhex(F.sha2("content", 256)).alias("hash"), F.round((F.col("mtime_ms") - 10**12) / 1000).cast("int").alias("n"))
    lost, unlisted = rows.where("n % 5 = 0").select("hash"), rows.where("n % 7 = 1").select("hash")
    for name, kept in (("volumes", lambda t: t.join(lost, "hash", "left_anti")), ("chunks", lambda t: t.join(unlisted, "hash", "left_anti")), ("folders", lambda t: t.where("path <> '/ASIA'"))):
        place = f"{repo.root}/{name}"
        kept(repo.table(name, published=False)).select(*repo.table(name).columns).write.parquet(f"{place}-kept")
        from ..repo import _delete, _fs

        _delete(spark, place)
        fs, old = _fs(spark, f"{place}-kept")
        fs.rename(old, _fs(spark, place)[1])
    # a volume that lost its last payload is also too short for it; which one that is depends on the packing
    return repo.verify().where("detail <> 'out of bounds'").select("kind", "subject", "detail")


@query("SELECT c_custkey, c_name, sha256(c_name) AS hash, CAST(2 AS BIGINT) AS damaged FROM customer")
def json_exchange(spark, sf):
    """Rows with binary values exported as compressed JSON and imported; damaged lines are counted apart."""
    from ..sources.exchange import export_json, import_json

    path = _scratch(spark)
    export_json(table(spark, sf, "customer").select("c_custkey", "c_name", F.unhex(F.sha2("c_name", 256)).alias("hash")), path)
    spark.createDataFrame([('{"c_custkey": "no number"}',), ("{cut off",)], "value string").write.mode("append").text(path)
    rows, bad = import_json(spark, path, "c_custkey long, c_name string, hash binary")
    return rows.select("c_custkey", "c_name", F.lower(F.hex("hash")).alias("hash"), F.lit(bad.count()).alias("damaged"))


@query(f"SELECT substr(path, 2) AS path, CAST(strlen(body) AS BIGINT) AS size, 25 AS put, 1 AS deleted, CASE WHEN r_name = 'ASIA' THEN false ELSE true END AS there FROM ({NATIONS}) n")
def remote_mirror(spark, sf):
    """A tree mirrored to a second place that held a torn upload; one folder's files are deleted there afterwards."""
    from ..sources.remote import RemoteStore, mirror

    here, there = written(spark, sf), local(_scratch(spark))
    import shutil

    shutil.rmtree(f"{here}/skip")
    os.remove(f"{here}/link")
    os.makedirs(there)
    with open(f"{there}/torn.tmp", "w") as f:
        f.write("x")
    store = RemoteStore(spark, f"file://{there}")
    done = mirror(spark, f"file://{here}", store, bytes_per_second=1e9)
    listed = store.list().where("NOT path LIKE '%.crc'").collect()
    for r in listed:
        if r.path.startswith("ASIA/"):
            store.delete(r.path)
    rows = [(r.path, store.size(r.path) if store.exists(r.path) else r.size, done["put"], done["deleted"], store.exists(r.path)) for r in listed]
    return spark.createDataFrame(rows, "path string, size long, put int, deleted int, there boolean")


@query("""SELECT 'none' AS selection, 'none' AS kind UNION ALL SELECT * FROM (VALUES ('one file', 'file'), ('files', 'files'), ('one folder', 'folder'), ('folders', 'folders'), ('both', 'both')) t""")
def selection_kinds(spark, sf):
    rows = with_folders(nations(spark, sf))
    chosen = {"none": "false", "one file": "path = '/ASIA/NATION_12.txt'", "files": "NOT is_folder", "one folder": "path = '/ASIA'", "folders": "is_folder", "both": "true"}
    return spark.createDataFrame([(k, tree.selection_kind(rows.where(v))) for k, v in chosen.items()], "selection string, kind string")


@query("SELECT q AS asked, f AS found FROM (VALUES ('/ASIA/NATION_12.txt', '/ASIA/NATION_12.txt'), ('/ASIA/none.txt', '/ASIA'), ('/ASIA/a/b/c', '/ASIA'), ('/EUROPE', '/EUROPE')) t(q, f)")
def tree_lookup(spark, sf):
    held = tree.nodes(with_folders(nations(spark, sf)).select("path", "is_folder", "size"))
    asked = ("/ASIA/NATION_12.txt", "/ASIA/none.txt", "/ASIA/a/b/c", "/EUROPE")
    return spark.createDataFrame([(q, tree.lookup(held, q).first().path) for q in asked], "asked string, found string")


@query(f"""SELECT path, CAST(row_number() OVER (ORDER BY folder, is_folder DESC, name) AS BIGINT) AS place FROM (
 SELECT path, '/' || r_name AS folder, false AS is_folder, n_name || '.txt' AS name FROM ({NATIONS}) n UNION ALL SELECT '/' || r_name, '', true, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)) x""")
def listing_order(spark, sf):
    """The order in which a listing of everything comes: by folder, folders first, by name."""
    held = tree.nodes(with_folders(nations(spark, sf)).select("path", "is_folder", "size"))
    listed = tree.children(held, "", recursive=True).select("path").collect()
    return spark.createDataFrame([(r.path, i) for i, r in enumerate(listed, 1)], "path string, place long")


@query("""SELECT ms, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.2f s', ms / 1000.0)
 ELSE CASE WHEN ms >= 86400000 THEN (ms // 86400000) || 'd ' ELSE '' END || lpad(CAST(ms // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') END AS shown
 FROM (SELECT CAST(o_orderkey * o_orderkey * 30 AS BIGINT) AS ms FROM orders) o""")
def durations(spark, sf):
    ms = (F.col("o_orderkey") * F.col("o_orderkey") * 30).cast("long")
    return table(spark, sf, "orders").select(ms.alias("ms")).select("ms", sizes.duration(F.col("ms")).alias("shown"))


@query(f"""SELECT path, replace(replace(to_base64(unhex(sha256(text))), '+', '-'), '/', '_') AS url64, sha256(text) AS back,
 CASE WHEN doc_id % 3 = 2 THEN '' ELSE source END AS bucket, CASE WHEN doc_id % 3 = 2 THEN '' ELSE lang || '/' || doc_id END AS key FROM ({FILES}) f""")
def text_forms(spark, sf):
    """Hashes as text for addresses, and buckets with prefixes of three kinds of addresses, one of them none."""
    by = F.col("doc_id") % 3
    rows = files(spark, sf).select("path", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), F.concat(F.when(by == 0, "s3://").when(by == 1, "arn:aws:s3:::").otherwise("https://"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    bucket, key = paths.bucket_and_key(F.col("url"))
    coded = names.url64(F.col("hash"))
    return rows.select("path", coded.alias("url64"), F.lower(F.hex(names.from_url64(coded))).alias("back"), bucket.alias("bucket"), key.alias("key"))


@query("""SELECT * FROM (VALUES ('codec', 'DEFLATE', 'deflate'), ('codec', ' lz4hc ', 'lz4hc'), ('codec', 'rar', 'error'), ('tag', '3', 'lzma'), ('tag', '2', 'error'), ('mode', 'Mirror', 'mirror'), ('mode', 'x', 'error'),
 ('hash', 'sha256', 'ok'), ('hash', 'crc', 'error'), ('remote', 'uri alone', 'error'), ('remote', 'both', 'ok'), ('fixed', 'other bits', 'error'), ('unknown', 'colour', 'error'),
 ('one of', 'none', 'error'), ('one of', 'a', 'ok'), ('not both', 'a b', 'error'), ('together', 'a', 'error'), ('together', 'a b', 'ok'), ('range', '0', 'error'), ('range', '50', 'ok')) t(option, given, outcome)""")
def option_checks(spark, sf):
    """What enumerations, configurations and command options accept."""
    from ..sources.config import RepoConfig, check_options, merged

    def said(f) -> str:
        try:
            found = f()
            return found.name if isinstance(found, names.Codec | names.Remote) else "ok"
        except ValueError:
            return "error"

    rows = [
        *(("codec", x, said(lambda x=x: names.member(names.Codec, x))) for x in ("DEFLATE", " lz4hc ", "rar")),
        *(("tag", str(x), said(lambda x=x: names.codec_by_tag(x))) for x in (3, 2)),
        *(("mode", x, said(lambda x=x: names.member(names.Remote, x))) for x in ("Mirror", "x")),
        *(("hash", x, said(lambda x=x: merged(None, {"hash_algorithm": x}))) for x in ("sha256", "crc")),
        ("remote", "uri alone", said(lambda: merged(None, {"remote_uri": "s3://b/p"}))),
        ("remote", "both", said(lambda: merged(None, {"remote_uri": "s3://b/p", "remote_mode": "mirror"}))),
        ("fixed", "other bits", said(lambda: merged(RepoConfig(), {"bits": 3}))),
        ("unknown", "colour", said(lambda: merged(None, {"colour": 1}))),
        ("one of", "none", said(lambda: check_options({"c": 1, "a": None}, need_one=("a", "b")))),
        ("one of", "a", said(lambda: check_options({"a": 1}, need_one=("a", "b")))),
        ("not both", "a b", said(lambda: check_options({"a": 1, "b": 2}, exclusive=(("a", "b"),)))),
        ("together", "a", said(lambda: check_options({"a": 1}, together=(("a", "b"),)))),
        ("together", "a b", said(lambda: check_options({"a": 1, "b": 2}, together=(("a", "b"),)))),
        *(("range", str(x), said(lambda x=x: check_options({"p": x}, ranges={"p": (0.1, 100)}))) for x in (0, 50)),
    ]
    return spark.createDataFrame(rows, "option string, given string, outcome string")


@query("""SELECT CAST(i AS INTEGER) AS number, name, name AS by_name FROM (SELECT row_number() OVER (ORDER BY name) - 1 AS i, name FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d.%H%M%S') AS name FROM orders) d) n
 WHERE i IN (0, 7, 30)""")
def choose_snapshot(spark, sf):
    """Snapshots by their number in the order of time, and by name."""
    dates = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("snapshot_ts"))
    rows = [(i, name, changes.choose(dates, name)) for i in (0, 7, 30) for name in [changes.choose(dates, i)]]
    return spark.createDataFrame(rows, "number int, name string, by_name string")


@query("SELECT CASE WHEN kind = 'real' THEN 'kept' ELSE 'stored' END AS folders, count(*) AS n FROM (SELECT r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'real' ELSE 'changed' END AS kind FROM region) r GROUP BY 1")
def folders_to_store(spark, sf):
    """Folders whose attributes differ from the known ones, or which are new, are stored again."""
    rows = table(spark, sf, "region").select(F.col("r_name").alias("path"), F.struct(F.col("r_regionkey").alias("mtime_ms"), F.lit(None).cast("string").alias("owner")).alias("attrs"), "r_regionkey")
    old = rows.where("r_regionkey <> 1").select("path", F.struct(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey")).otherwise(F.col("r_regionkey") + 1).alias("mtime_ms"), F.lit(None).cast("string").alias("owner")).alias("attrs"))
    store = changes.folders_to_store(rows.select("path", "attrs"), old).select("path", F.lit("stored").alias("folders"))
    both = rows.select("path").join(store, "path", "left").select(F.coalesce("folders", F.lit("kept")).alias("folders"))
    return both.groupBy("folders").agg(F.count(F.lit(1)).alias("n"))
