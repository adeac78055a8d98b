"""Numbered and dated names, enumerations, journal lines, text forms of hashes."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd.HHmmss"
#: Kinds of journal entries.
START, STOP, FINISHED = "Start_Writing", "Stop_Writing", "File_Finished"


class Codec(Enum):
    """Tag byte and relative cost of each codec; costs are our own ranks."""

    # fixed values: names and tag bytes
    none = (0, 0)
    gzip = (1, 5)
    lzma = (3, 6)
    snappy = (4, 1)
    deflate = (5, 4)
    lz4 = (6, 2)
    lz4hc = (7, 3)

    @property
    def tag(self) -> int:
        return self.value[0]

    @property
    def cost(self) -> int:
        return self.value[1]


class Remote(Enum):
    off = "off"
    mirror = "mirror"


def member(kind: type[Enum], text: str) -> Enum:
    """By name, without regard to case; an unknown one is an error that lists the choices."""
    for x in kind:
        if x.name.lower() == text.strip().lower():
            return x
    raise ValueError(f"{text!r} is none of {', '.join(x.name for x in kind)}")


def codec_by_tag(tag: int) -> Codec:
    for x in Codec:
        if x.tag == tag:
            return x
    raise ValueError(f"no codec has tag {tag}")


def numbered(stem: str, number: Column) -> Column:
    """`stem/stem_000042`, from 1000 on in a folder for each thousand; numbers of more than six digits stay whole."""
    digits = number.cast("string")
    file = F.concat(F.lit(f"{stem}_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))
    return F.when(number >= 1000, F.concat_ws("/", F.lit(stem), F.floor(number / 1000).cast("string"), file)).otherwise(F.concat_ws("/", F.lit(stem), file))


def number_of(stem: str, path: Column) -> Column:
    """The number in a numbered name; null for other files."""
    return F.regexp_extract(path, rf"(?:^|/){stem}_([0-9]+)[^/]*$", 1).try_cast("long")


def next_number(number: Column) -> Column:
    return F.coalesce(F.max(number) + 1, F.lit(0))


def dated(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.date_format(at, STAMP))


def date_of(prefix: str, path: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(path, rf"(?:^|/){prefix}_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\.[0-9]{{6}})", 1), F.lit(STAMP))


def url64(data: Column) -> Column:
    return F.translate(F.base64(data), "+/", "-_")


def from_url64(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def journal_line(kind: Column, file: Column, md5: Column) -> Column:
    """`len kind [file md5]`: len counts the rest of the line and the blank before it."""
    rest = F.concat_ws(" ", kind, file, md5)
    return F.concat_ws(" ", (F.length(rest) + 1).cast("string"), rest)


def parse_journal(line: Column) -> Column:
    """struct(typ, file, md5); null if the length is wrong, the kind unknown or its fields are missing. A line is cut
    at its blanks once; a file's name may have blanks, the sum after it has none."""

    def read(p: Column) -> Column:
        size, typ, n = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.size(p)
        file, md5 = F.array_join(F.slice(p, 3, F.greatest(n - 3, F.lit(0))), " "), F.element_at(p, -1)
        rest = F.length(F.array_join(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), " "))
        counted = (size != "") & (F.translate(size, "0123456789", "") == "") & (size.try_cast("int") == rest + 1)
        done = (typ == FINISHED) & (n > 3) & (file != "")
        ended = typ.isin(START, STOP) & (n == 2)
        return F.when(counted & (done | ended), F.struct(typ.alias("typ"), F.when(done, file).alias("file"), F.when(done, md5).alias("md5")))

    return F.get(F.transform(F.array(F.split(F.rtrim(line, F.lit("\r")), " ", -1)), read), F.lit(0))
