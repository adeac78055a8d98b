"""backup, verify, restore, browse, help, --version."""

from __future__ import annotations

import argparse
import sys
from importlib.metadata import entry_points

from .sources.config import VERSION, check_options


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairnstore", description=__doc__)
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command")
    for name in ("backup", "verify", "restore", "browse", "help"):
        p = sub.add_parser(name)
        if name == "help":
            continue
        p.add_argument("repository")
        p.add_argument("--passphrase")
        if name == "backup":
            p.add_argument("folder")
            p.add_argument("--codec")
            p.add_argument("--hash-algorithm")
            p.add_argument("--volume-bytes", type=int)
            p.add_argument("--ignore-file")
            p.add_argument("--remote-uri")
            p.add_argument("--remote-mode")
        if name == "verify":
            p.add_argument("--percent-of-files", type=float)
        if name in ("restore", "browse"):
            p.add_argument("--as-of")
        if name == "restore":
            p.add_argument("--to-folder")
            p.add_argument("--to-original", action="store_true", default=None)
            p.add_argument("--prefix")
        if name == "browse":
            p.add_argument("--folder", default="")
            p.add_argument("--search", default="")
            p.add_argument("--subfolders", action="store_true")
    return top


def plugins() -> dict:
    """Commands of other packages: entry points of the group `cairnstore.commands`, each a function of the
    arguments and the session."""
    return {e.name: e for e in entry_points(group="cairnstore.commands")}


def main(argv: list[str] | None = None, spark=None) -> int:
    words = sys.argv[1:] if argv is None else argv
    if words and words[0] in (more := plugins()):
        return more[words[0]].load()(words[1:], spark)
    args = parser().parse_args(words)
    if args.command in (None, "help"):
        parser().print_help()
        return 0
    given = vars(args)
    check_options(given, ("to_folder", "to_original") if args.command == "restore" else (), (("to_folder", "to_original"),), (("remote_uri", "remote_mode"),), {"percent_of_files": (1, 100)})
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from .repo import SnapshotRepo

    options = {k: given[k] for k in ("codec", "hash_algorithm", "volume_bytes", "remote_uri", "remote_mode") if given.get(k) is not None}
    if given.get("ignore_file"):
        with open(given["ignore_file"]) as f:
            options["ignore"] = f.read()
    repo = SnapshotRepo.open(spark, args.repository, args.passphrase, **options)
    if args.command == "backup":
        print(repo.backup(args.folder))
        return 0
    if args.command == "verify":
        problems = repo.verify(args.percent_of_files or 100)
        problems.show(truncate=False)
        return problems.count()
    if args.command == "restore":
        print(repo.restore_to(args.to_folder or "/", args.as_of, args.prefix))
        return 0
    repo.browse(args.folder, args.as_of, args.subfolders, args.search).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
