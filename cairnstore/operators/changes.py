"""What changed: known files, folders, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(scan: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("path",), same: tuple[str, ...] = ("size", "mtime_ms")) -> DataFrame:
    """Adds status: unchanged (path, size and time agree with the known version), changed, new; a path that
    comes again in the scan is storing."""
    old = known.select(*keys, *(F.col(c).alias(f"old_{c}") for c in same), F.lit(True).alias("known"))
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*same)) > 1
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).cast("bigint").eqNullSafe(F.col(f"old_{c}").cast("bigint"))
    tag = F.when(F.col("again"), "storing").when(F.col("known").isNull(), "new").when(agree, "unchanged").otherwise("changed")
    return scan.withColumn("again", again).join(old, list(keys), "left").withColumn("status", tag).drop("again", "known", *(f"old_{c}" for c in same))


def folders_to_store(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Folders without a known version of equal attributes."""
    same = (scan["path"] == known["path"]) & scan["attrs"].eqNullSafe(known["attrs"])
    return scan.join(known, same, "left_anti")


def deleted(known: DataFrame, scan: DataFrame) -> DataFrame:
    return known.join(scan.select("path"), "path", "left_anti")


def latest(versions: DataFrame, key: str = "path", order: str = "batch_no") -> DataFrame:
    """The last writer's row of each key."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def as_of(snapshots: DataFrame, at, column: str = "snapshot_ts") -> DataFrame:
    """Rows of the newest snapshot not after `at`; of the newest of all for None."""
    rows = snapshots if at is None else snapshots.where(F.col(column) <= F.lit(at).cast("timestamp"))
    newest = rows.agg(F.max(column).alias("newest"))
    return rows.join(F.broadcast(newest), F.col(column) == F.col("newest"), "left_semi")


def choose(dates: DataFrame, choice: str | int, column: str = "snapshot_ts"):
    """A snapshot by its number in ascending order (from 0) or by its exact name; an unknown one lists the choices."""
    names = sorted(r[0] for r in dates.select(F.date_format(column, "yyyy-MM-dd.HHmmss")).distinct().collect())
    if isinstance(choice, int) and 0 <= choice < len(names):
        return names[choice]
    if choice in names:
        return choice
    raise ValueError(f"{choice!r} is none of {', '.join(names)}")


def assemble(ids: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions of a snapshot's ids in stored order, pos; an id without a version is an error."""
    rows = ids.select(F.posexplode("file_ids").alias("pos", "id")).join(versions, "id", "left")
    return rows.withColumn("path", F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no version has id "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("path")))


def differences(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """path and added, removed or modified; equal ones are left out."""
    both = old.select(key, F.col(value).alias("o"), F.lit(1).alias("a")).join(new.select(key, F.col(value).alias("n"), F.lit(1).alias("b")), key, "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def is_different(old: DataFrame, new: DataFrame, key: str = "id") -> bool:
    """Whether two snapshots differ as sets: order and repeats don't matter."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return a.exceptAll(b).union(b.exceptAll(a)).limit(1).count() > 0
