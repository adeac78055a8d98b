"""Path expressions. A path's segments are divided by `/` or `\\`; trailing empty segments don't count, a leading one
does."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of files that are shown as text, then of those shown as images.
TEXT_ENDINGS = (
    *("csv", "txt", "dif", "diff", "patch", "svg", "asc", "cnf", "cfg", "conf", "htm", "html", "cfm", "cgi", "asp", "aspx", "ini", "pl", "py"),
    *("md", "css", "cs", "js", "jsp", "log", "htaccess", "htpasswd", "gitignore", "gitattributes", "env", "json", "atom", "eml", "rss", "markdown"),
    *("sql", "xml", "xsl", "xslt", "sh", "rb", "as", "bat", "cmd", "cob", "for", "ftn", "frm", "frx", "inc", "lisp", "scm", "coffee"),
    *("php", "php3", "php4", "php5", "php6", "java", "c", "cbl", "go", "h", "scala", "vb", "tmpl", "lock", "yml", "yaml", "tsv", "lst"),
)
IMAGE_ENDINGS = ("jpg", "jpeg", "gif", "bmp", "png", "svg", "tif", "tiff")


def parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def parent(path: Column) -> Column:
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/")


def codec_key(path: Column) -> Column:
    """What codecs are chosen by: after the last dot of the name, or the whole name."""
    return F.substring_index(name(path), ".", -1)


def extension(path: Column, is_folder: Column) -> Column:
    """What a listing shows: empty for folders and names without a dot."""
    n = name(path)
    return F.when(~is_folder & n.contains("."), F.substring_index(n, ".", -1)).otherwise("")


def kind(is_folder: Column) -> Column:
    return F.when(is_folder, "dir").otherwise("file")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normal(path: Column) -> Column:
    """Backslashes to slashes, repeats collapsed, one leading slash off."""
    return F.regexp_replace(F.regexp_replace(slashes(path), "/+", "/"), "^/", "")


def resolve(base: Column, more: Column) -> Column:
    return normal(F.concat_ws("/", base, more))


def relative(path: Column, base: Column) -> Column:
    """The rest of path below base; the path itself where it isn't below."""
    head = F.concat(base, F.lit("/"))
    return F.when(F.startswith(path, head), F.substring(path, F.char_length(head) + 1, F.char_length(path))).otherwise(path)


def below_common(path: Column, other: Column, ignore_case: bool = False) -> Column:
    """Segments of path after those it shares with other at the head, joined by slashes."""
    a, b = parts(path), parts(other)
    lower = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    same = F.transform(a, lambda x, i: lower(x) == lower(F.coalesce(F.get(b, i), F.lit("\0"))))
    first = F.array_position(same, F.lit(False)).cast("int")
    rest = F.when(first == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.greatest(first, F.lit(1)), F.size(a)))
    return F.array_join(rest, "/")


def relation(path: Column, other: Column) -> Column:
    """same, sub (path lies below other), top (other lies below path) or none, by segments."""
    a, b = parts(path), parts(other)
    return F.when(a == b, "same").when(F.slice(a, 1, F.size(b)) == b, "sub").when(F.slice(b, 1, F.size(a)) == a, "top").otherwise("none")


def prefixes(path: Column) -> Column:
    """All proper ancestors, shortest first."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda n: F.array_join(F.slice(p, 1, n), "/"))


def preview_kind(path: Column) -> Column:
    low = F.lower(name(path))
    ends = lambda e: low.rlike(r"\.(" + "|".join(e) + ")$")
    return F.when(ends(TEXT_ENDINGS), "text").when(ends(IMAGE_ENDINGS), "image").otherwise("unknown")


def name_matches(path: Column, text: str) -> Column:
    """A listing's search: part of the name, without regard to case; an empty text matches all."""
    return F.lower(name(path)).contains(text.lower()) if text else F.lit(True)


def glob_regex(glob: str) -> str:
    """A `glob:` pattern as a regular expression: `*` within a segment, `**` across, `?`, `[..]`, `{a,b}`."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if glob[i : i + 1] == "*":
                out, i = out + ".*", i + 1
            else:
                out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i < len(glob):
            out, i = out + re.escape(glob[i]), i + 1
        else:
            out += re.escape(c)
    return "^" + out + "$"


def bucket_and_key(url: Column) -> tuple[Column, Column]:
    """Bucket and prefix of s3://bucket/prefix or arn:aws:s3:::bucket/prefix."""
    pattern = r"^(?:s3[an]?://|arn:aws:s3:::)([^/]+)/?(.*)$"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)


def tombstone(path: Column) -> Column:
    """A deleted file or folder: its path and size 0."""
    return F.struct(path.alias("path"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("deleted"))
