"""A repository of deduplicated snapshots in Parquet.

    <root>/config, journal, chunks, volumes, versions, folders, snapshots

Every write belongs to a run. A run writes payloads, then the chunk index, then versions, then the snapshot, and at
last one journal row that publishes it; readers take only rows of published runs, so a run that broke off at
any point is not seen, and the next one starts clean. Chunks are found by hash; payloads are not read to back up.

The lock holds its writer's run; a run publishes only while the lock is still its own, and rows of unfinished runs are
deleted only under the lock. A file whose content can't be read is not stored as an empty one: what the newest snapshot
has of it stays, and the backup counts it as unreadable.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, crypto, hashing, paths
from .operators import audit, changes, chunking, dedup, policy, tree
from .sources.config import RepoConfig, merged, plain
from .sources.tree import scan

ATTRS = "struct<mtime_ms:long,ctime_ms:long,owner:string,grp:string,permissions:string,hidden:boolean,readonly:boolean>"
TABLES = {
    "journal": "seq long, typ string, run string, at timestamp",
    "chunks": "hash binary, volume string, start long, length long, raw_length long, codec string, run string",
    "volumes": "volume string, hash binary, start long, content binary, run string",
    "versions": f"id long, path string, size long, mtime_ms long, attrs {ATTRS}, hashes array<binary>, run string",
    "folders": f"id long, path string, attrs {ATTRS}, run string",
    "snapshots": "snapshot_ts timestamp, kind string, id long, run string",
}


class InUse(RuntimeError):
    pass


class SnapshotRepo:
    def __init__(self, spark: SparkSession, root: str, config: RepoConfig, key: bytes | None) -> None:
        self.spark, self.root, self.config, self.key = spark, root.rstrip("/"), config, key

    @classmethod
    def open(cls, spark: SparkSession, root: str, passphrase: str | None = None, **given) -> SnapshotRepo:
        """Creates or opens; options that are given replace stored ones, apart from those fixed at creation."""
        root, stored, key = root.rstrip("/"), None, None
        if _exists(spark, f"{root}/config"):
            stored = RepoConfig(**spark.read.json(f"{root}/config", schema=_config_schema()).first().asDict())
        config = merged(stored, given)
        if stored is None and passphrase:
            key, record = crypto.new_key(passphrase, config.key_bits or 128)
            config = merged(None, given | {"key_bits": record.bits, "key_salt": record.salt, "key_check": record.check})
        elif config.key_check:
            if not passphrase:
                raise crypto.WrongPassphrase("this repository needs a passphrase")
            key = crypto.open_key(passphrase, crypto.KeyRecord(config.key_salt, config.key_check, config.key_bits))
        if config != stored:
            spark.createDataFrame([tuple(plain(config).values())], _config_schema()).coalesce(1).write.mode("overwrite").json(f"{root}/config")
        return cls(spark, root, config, key)

    # tables

    def table(self, name: str, published: bool = True) -> DataFrame:
        path = f"{self.root}/{name}"
        rows = self.spark.read.schema(TABLES[name]).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], TABLES[name])
        if name == "journal" or not published:
            return rows
        return rows.join(self.table("journal").where("typ = 'Stop_Writing'").select("run"), "run", "left_semi")

    def _write(self, df: DataFrame, name: str, run: str) -> None:
        want = self.spark.createDataFrame([], TABLES[name]).schema
        df = df.withColumn("run", F.lit(run)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def _journal(self, typ: str, run: str) -> None:
        at = datetime.now(UTC)
        rows = [(int(at.timestamp() * 1e6), typ, run, at)]
        self.spark.createDataFrame(rows, TABLES["journal"]).coalesce(1).write.mode("append").parquet(f"{self.root}/journal")

    @contextmanager
    def _locked(self, run: str) -> Iterator[None]:
        lock = f"{self.root}/lock"
        if not _create(self.spark, lock, run):
            raise InUse(f"{self.root} is being written to by {_read(self.spark, lock)}; clean(force=True) if that writer is gone")
        try:
            yield
        finally:
            if _read(self.spark, lock) == run:
                _delete(self.spark, lock)

    @contextmanager
    def _writing(self) -> Iterator[str]:
        """One writer at a time; a run that fails, or lost its lock, leaves its start without a stop."""
        run = uuid.uuid4().hex
        with self._locked(run):
            try:
                self._journal("Start_Writing", run)
                yield run
                if _read(self.spark, f"{self.root}/lock") != run:
                    raise InUse(f"the lock of {run} was taken away; it is not published")
                self._journal("Stop_Writing", run)
            finally:
                _delete(self.spark, f"{self.root}/staging-{run}")

    def unfinished(self) -> DataFrame:
        """Runs that started, did not stop and were not removed; the running one among them."""
        j = self.table("journal")
        return j.where("typ = 'Start_Writing'").join(j.where("typ IN ('Stop_Writing', 'Removed')").select("run"), "run", "left_anti")

    def clean(self, force: bool = False) -> int:
        """Deletes the files that unfinished runs wrote and returns the number of such runs. Nobody may be writing;
        force takes the lock of a writer that is gone, and one that is not gone after all won't publish."""
        if force:
            _delete(self.spark, f"{self.root}/lock")
        with self._locked(f"clean-{uuid.uuid4().hex}"):
            gone = self.unfinished().select("run")
            number = gone.count()
            for name in TABLES:
                if number and name != "journal" and _exists(self.spark, f"{self.root}/{name}"):
                    rows = self.table(name, published=False).withColumn("f", F.input_file_name())
                    for r in rows.join(gone, "run", "left_semi").select("f").distinct().toLocalIterator():
                        _delete(self.spark, r.f)
            if number:
                rows = gone.select(F.lit(0).cast("long").alias("seq"), F.lit("Removed").alias("typ"), "run", F.current_timestamp().alias("at"))
                self.spark.createDataFrame(rows.collect(), TABLES["journal"]).coalesce(1).write.mode("append").parquet(f"{self.root}/journal")
            return number

    # hashes and payloads

    def digest(self, data: Column) -> Column:
        return hashing.content_hash(data, self.config.hash_algorithm)

    def _packed(self, content: Column, codec: Column) -> Column:
        body = codecs.compress(content, codec)
        return crypto.seal(body, self.key) if self.key else body

    def _unpacked(self, content: Column) -> Column:
        return codecs.decompress(crypto.unseal(content, self.key) if self.key else content)

    # backup

    def backup(self, entries: DataFrame | str, at: datetime | None = None, force_rehash: bool = False) -> dict:
        """entries: a folder's path, or rows of path, is_folder, size, mtime_ms, content (and attributes).

        Files whose path, size and time agree with the newest snapshot, and whose chunks are all there, are not
        opened again. A file without content (null) that would have to be is unreadable: the known version of its path
        stays in the snapshot. Returns counts; snapshot is False where nothing differs from the newest one.
        """
        if isinstance(entries, str):
            entries = scan(self.spark, entries, self.config.ignore, content=True, links=self.config.save_symlinks)
        at = at or datetime.now(UTC)
        entries = _with_attrs(entries)
        with self._writing() as run:
            known = self.files().select("id", "path", "size", "mtime_ms", "hashes")
            tagged = changes.classify(entries.where("NOT is_folder"), known)
            whole = audit.complete(known, self.table("chunks")).where("complete").select(F.col("path").alias("whole_path"))
            tagged = tagged.join(whole, F.col("path") == F.col("whole_path"), "left")
            same = F.lit(not force_rehash) & (F.col("status") == "unchanged") & F.col("whole_path").isNotNull()
            unreadable = ~same & F.col("content").isNull()
            keep = same | unreadable
            stage = f"{self.root}/staging-{run}"
            old = tagged.where(keep).join(known.select("path", "id"), "path").select("id")
            fresh = tagged.where(~keep & (F.col("status") != "storing"))
            blocks = chunking.content_chunks(fresh, self.config.least, self.config.most, self.config.bits)
            blocks.withColumn("hash", self.digest(F.col("content"))).withColumn("length", F.octet_length("content").cast("long")).write.parquet(f"{stage}/blocks")
            blocks = self.spark.read.parquet(f"{stage}/blocks")
            first = dedup.first_seen(blocks, ["path", "block_nr"]).join(self.table("chunks").select("hash"), "hash", "left_anti")
            where = first.select("hash", F.col("first.path").alias("fp"), F.col("first.block_nr").alias("fn"))
            new = blocks.join(where, (blocks["hash"] == where["hash"]) & (F.col("path") == F.col("fp")) & (F.col("block_nr") == F.col("fn"))).drop(where["hash"])
            new = new.withColumn("ext", paths.codec_key(F.col("path")))
            if self.config.codec == "smart":
                won = policy.choose(new.select("ext", "hash", "length", "content"))
                new = new.join(won.select("ext", F.col("codec").alias("won")), "ext", "left")
                new = new.withColumn("codec", codecs.policy(F.col("length"), F.col("won")))
            else:
                new = new.withColumn("codec", F.lit(self.config.codec))
            new.select("hash", F.col("length").alias("raw_length"), "codec", self._packed(F.col("content"), F.col("codec")).alias("content")).write.parquet(f"{stage}/payload")
            payload = self.spark.read.parquet(f"{stage}/payload").withColumn("length", F.octet_length("content").cast("long"))
            packed = payload.select("hash", "length", F.pmod(F.xxhash64("hash"), F.lit(self.config.lanes)).alias("lane"), F.hex("hash").alias("ordinal"))
            placed = chunking.pack_volumes(packed, self.config.volume_bytes)
            placed = placed.select(F.unhex("ordinal").alias("hash"), F.concat_ws("-", F.lit(run), F.col("lane").cast("string"), F.col("volume").cast("string")).alias("volume"), "start")
            placed.write.parquet(f"{stage}/placed")
            placed = payload.join(self.spark.read.parquet(f"{stage}/placed"), "hash")
            self._write(placed.repartition("volume").sortWithinPartitions("volume", "start"), "volumes", run)
            self._write(placed, "chunks", run)
            recipe = dedup.recipes(blocks).select(F.col("path").alias("rp"), "hashes")
            stored = fresh.join(recipe, F.col("path") == F.col("rp"), "left").withColumn("id", F.xxhash64("path", "size", "mtime_ms", F.lit(run)))
            self._write(stored, "versions", run)
            folders = entries.where("is_folder").withColumn("id", F.xxhash64("path", F.lit("folder"), F.lit(run)))
            known_folders = self.folders().select(F.col("id").alias("old_id"), F.col("path").alias("old_path"), F.col("attrs").alias("old_attrs"))
            folders = folders.join(known_folders, (F.col("path") == F.col("old_path")) & F.col("attrs").eqNullSafe(F.col("old_attrs")), "left")
            self._write(folders.where("old_id IS NULL"), "folders", run)
            ids = old.select("id", F.lit("file").alias("kind")).unionByName(self.table("versions", published=False).where(F.col("run") == run).select("id", F.lit("file").alias("kind")))
            ids = ids.unionByName(folders.select(F.coalesce("old_id", "id").alias("id"), F.lit("folder").alias("kind")))
            ids.write.parquet(f"{stage}/ids")
            ids = self.spark.read.parquet(f"{stage}/ids")
            different = ids.limit(1).count() > 0 and changes.is_different(self.members(), ids)
            if different:
                self._write(ids.withColumn("snapshot_ts", F.lit(at)), "snapshots", run)
            status = F.when(unreadable & (F.col("status") != "storing"), "unreadable").otherwise(F.col("status"))
            counts = {r.status: r["count"] for r in tagged.groupBy(status.alias("status")).count().collect()}
        return {"run": run, "snapshot": different, "new_chunks": self.table("chunks").where(F.col("run") == run).count(), **counts}

    # reading

    def snapshots(self) -> DataFrame:
        return self.table("snapshots").groupBy("snapshot_ts").agg(F.count(F.when(F.col("kind") == "file", 1)).alias("files"), F.count(F.when(F.col("kind") == "folder", 1)).alias("folders")).orderBy("snapshot_ts")

    def members(self, as_of: datetime | str | None = None) -> DataFrame:
        return changes.as_of(self.table("snapshots"), as_of).select("id", "kind")

    def files(self, as_of: datetime | str | None = None) -> DataFrame:
        return self.table("versions").join(self.members(as_of).where("kind = 'file'").select("id"), "id", "left_semi")

    def folders(self, as_of: datetime | str | None = None) -> DataFrame:
        return self.table("folders").join(self.members(as_of).where("kind = 'folder'").select("id"), "id", "left_semi")

    def blocks(self, files: DataFrame) -> DataFrame:
        """path, block_nr, hash and plain content, null where a chunk is lost."""
        lost = dedup.resolve(files, self.table("volumes").select("hash", F.col("content").alias("sealed")))
        return lost.select("path", "block_nr", "hash", self._unpacked(F.col("sealed")).alias("content"))

    def restore(self, as_of: datetime | str | None = None, prefix: str | None = None, dest: str | None = None) -> DataFrame:
        """path, target, size, attrs, content of the files of a snapshot."""
        files = self.files(as_of)
        if prefix:
            files = files.where(F.col("path").eqNullSafe(F.lit(prefix)) | F.col("path").startswith(prefix.rstrip("/") + "/"))
        content = dedup.reassemble(self.blocks(files)).select(F.col("path").alias("cp"), "content")
        files = tree.targets(files, tree.roots(self.folders(as_of).select("path")), dest)
        return files.join(content, F.col("path") == F.col("cp"), "left").select("path", "target", "size", "attrs", "content")

    def restore_to(self, dest: str, as_of: datetime | str | None = None, prefix: str | None = None) -> int:
        """Writes files and folders below dest, a folder all executors see; files that are there with equal length
        and time are left. Folders get their times last. Returns the number of files written."""
        folders = tree.targets(self.folders(as_of), tree.roots(self.folders(as_of).select("path")), dest).select("target", "attrs")
        written = self.spark.sparkContext.accumulator(0)

        def make(rows):
            for r in rows:
                os.makedirs(r.target, exist_ok=True)

        def put(rows):
            for r in rows:
                when = (r.attrs.mtime_ms or 0) if r.attrs else 0
                if os.path.exists(r.target) and os.path.getsize(r.target) == r.size and os.stat(r.target).st_mtime_ns // 1_000_000 == when:
                    continue
                os.makedirs(os.path.dirname(r.target), exist_ok=True)
                with open(r.target, "wb") as f:
                    f.write(bytes(r.content or b""))
                _restore_attrs(r.target, r.attrs)
                written.add(1)

        def finish(rows):
            for r in sorted(rows, key=lambda x: -len(x.target)):
                _restore_attrs(r.target, r.attrs)

        folders.foreachPartition(make)
        self.restore(as_of, prefix, dest).select("target", "size", "attrs", "content").foreachPartition(put)
        folders.foreachPartition(finish)
        return written.value

    def restore_info(self, as_of: datetime | str | None = None) -> DataFrame:
        return self.files(as_of).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))

    def verify(self, percent: float = 100) -> DataFrame:
        """kind, subject, detail: every snapshot's versions, every chunk's place and content, every file's folder (in
        snapshots that have folders). A chunk without payload is a problem, whatever the index says."""
        files = audit.sampled(self.table("versions"), percent)
        needed = files.select(F.explode("hashes").alias("hash"))
        volumes, snapshots = self.table("volumes"), self.table("snapshots")
        ends = volumes.groupBy("volume").agg(F.max(F.col("start") + F.octet_length("content")).alias("volume_length"))
        payload = needed.distinct().join(volumes.select("hash", F.col("content").alias("sealed")), "hash", "left").select("hash", self._unpacked(F.col("sealed")).alias("content"))
        members = snapshots.where("kind = 'file'").join(files.select("id", "path"), "id").select("snapshot_ts", "path")
        folders = snapshots.where("kind = 'folder'").join(self.table("folders").select("id", "path"), "id").select("snapshot_ts", "path")
        return (
            audit.snapshot_problems(snapshots.where("kind = 'file'"), self.table("versions"))
            .unionByName(audit.chunk_problems(needed, self.table("chunks"), ends))
            .unionByName(audit.content_problems(payload, self.digest))
            .unionByName(audit.snapshot_orphans(members, folders))
        )

    def browse(self, folder: str = "", as_of: datetime | str | None = None, recursive: bool = False, search: str = "") -> DataFrame:
        files = self.files(as_of).select("path", F.lit(False).alias("is_folder"), "size")
        entries = files.unionByName(self.folders(as_of).select("path", F.lit(True).alias("is_folder"), F.lit(0).cast("long").alias("size")))
        return tree.children(tree.nodes(entries), folder.rstrip("/"), recursive, search)

    def statistics(self) -> DataFrame:
        used = self.table("versions").select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("uses"))
        rows = used.join(self.table("chunks"), "hash")
        return rows.agg(F.sum(F.col("uses") * F.col("raw_length")).alias("logical_bytes"), F.sum("raw_length").alias("distinct_bytes"), F.sum("length").alias("stored_bytes"), F.count(F.lit(1)).alias("chunks"))


def _with_attrs(entries: DataFrame) -> DataFrame:
    have = dict(entries.dtypes)
    kinds = {"mtime_ms": "long", "ctime_ms": "long", "owner": "string", "grp": "string", "permissions": "string", "hidden": "boolean", "readonly": "boolean"}
    if "is_folder" not in have:
        entries = entries.withColumn("is_folder", F.lit(False))
    attrs = F.struct(*((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    return entries.withColumn("attrs", attrs).withColumn("mtime_ms", F.col("attrs.mtime_ms"))


def _restore_attrs(path: str, attrs) -> None:
    """Permissions, then owner and group where allowed, times last; what fails is left."""
    if not attrs:
        return
    try:
        if attrs.permissions and len(attrs.permissions) == 9:
            os.chmod(path, sum(1 << (8 - i) for i, c in enumerate(attrs.permissions) if c != "-"))
        if attrs.owner or attrs.grp:
            import shutil

            shutil.chown(path, attrs.owner or None, attrs.grp or None)
    except (OSError, LookupError):
        pass
    if attrs.mtime_ms is not None:
        os.utime(path, ns=(attrs.mtime_ms * 1_000_000, attrs.mtime_ms * 1_000_000))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _create(spark: SparkSession, path: str, content: str) -> bool:
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if not fs.createNewFile(p):
        return False
    out = fs.create(p, True)
    out.writeUTF(content)
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str | None:
    """What _create wrote; null for a file of another make or none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).getLen() < 2:
        return None
    held = fs.open(p)
    try:
        return held.readUTF()
    finally:
        held.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _config_schema() -> str:
    kind = {str: "string", int: "long", bool: "boolean"}
    return ", ".join(f"{k} {kind[type(v)]}" for k, v in plain(RepoConfig()).items())
