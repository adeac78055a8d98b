"""A repository's configuration: options are merged over the stored ones, only where they are given."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from ..functions.hashing import HASHES
from ..functions.names import Codec, Remote, member

VERSION = "1"
#: Set when a repository is created, fixed from then on.
FIXED = ("hash_algorithm", "key_bits", "key_salt", "key_check", "least", "most", "bits")


@dataclass(frozen=True)
class RepoConfig:
    version: str = VERSION
    hash_algorithm: str = "sha3_256"
    codec: str = "smart"
    volume_bytes: int = 500 << 20
    least: int = 128 << 10
    most: int = 16 << 20
    bits: int = 19
    lanes: int = 16
    save_symlinks: bool = False
    ignore: str = ""
    remote_uri: str = ""
    remote_mode: str = "off"
    key_bits: int = 0
    key_salt: str = ""
    key_check: str = ""

    def checked(self) -> RepoConfig:
        if self.hash_algorithm not in (*HASHES, "sha256"):
            raise ValueError(f"unknown hash {self.hash_algorithm!r}")
        if self.codec != "smart":
            member(Codec, self.codec)
        if (member(Remote, self.remote_mode) is not Remote.off) != bool(self.remote_uri):
            raise ValueError("a remote needs both an address and a mode")
        if not 0 < self.least <= self.most or self.volume_bytes <= 0 or self.lanes < 1:
            raise ValueError("sizes must be positive and least at most most")
        return self


def merged(stored: RepoConfig | None, given: dict) -> RepoConfig:
    """The stored configuration with what is given; fixed settings can't change."""
    known = {f.name for f in fields(RepoConfig)}
    if odd := set(given) - known:
        raise ValueError(f"unknown options {', '.join(sorted(odd))}")
    if stored is None:
        return replace(RepoConfig(), **given).checked()
    for k in FIXED:
        if k in given and given[k] != getattr(stored, k):
            raise ValueError(f"{k} is fixed when a repository is created")
    return replace(stored, **given).checked()


def plain(config: RepoConfig) -> dict:
    return asdict(config)


def check_options(given: dict, need_one: tuple[str, ...] = (), exclusive: tuple[tuple[str, str], ...] = (), together: tuple[tuple[str, str], ...] = (), ranges: dict[str, tuple[float, float]] | None = None) -> None:
    """Command options: some must be given, some not both, some only both, some within a range."""
    have = {k for k, v in given.items() if v is not None}
    if need_one and not have & set(need_one):
        raise ValueError(f"one of {', '.join(need_one)} is needed")
    for a, b in exclusive:
        if {a, b} <= have:
            raise ValueError(f"{a} and {b} exclude each other")
    for a, b in together:
        if len({a, b} & have) == 1:
            raise ValueError(f"{a} and {b} go together")
    for k, (low, high) in (ranges or {}).items():
        if k in have and not low <= given[k] <= high:
            raise ValueError(f"{k} lies from {low} to {high}")
