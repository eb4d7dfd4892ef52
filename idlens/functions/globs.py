"""Glob patterns met by equality: an index of patterns by a fixed part that every path they match must hold.

A pattern's anchor is a whole name, an extension or a first folder that stands in it without wildcards; a path has few
such keys. Patterns and paths of a repository are joined by anchor, and only pairs that share one are put to the
pattern's regular expression. Patterns of wildcards alone have no anchor and meet every path of their repository, as
they match nearly all of them anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The anchor of patterns without a fixed part, and a key of every path.
ANY = "*"


def fixed(segment: Column) -> Column:
    return (segment != "") & ~segment.rlike(r"[*?]")


def extension_of(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^./]+)$", 1)


def key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def last_name_anchor(body: Column, rooted: Column) -> Column:
    """Of a pattern that ends where the path ends and whose wildcards stay in a segment: the last name, its extension,
    or the first folder."""
    segments = F.split(body, "/")
    last, first = F.element_at(segments, -1), segments[0]
    tail = F.regexp_extract(last, r"\.([^.*?]+)$", 1)
    return F.when(fixed(last), key("name", last)).when(tail != "", key("ext", tail)).when(rooted & fixed(first), key("first", first)).otherwise(ANY)


def last_name_keys(path: Column) -> Column:
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.array(key("name", last), key("ext", extension_of(last)), key("first", F.split(path, "/")[0]), F.lit(ANY))


def any_name_anchor(body: Column, rooted: Column) -> Column:
    """Of a pattern that covers what is below it and whose wildcards cross folders: the first folder, a folder anywhere,
    or an extension of some name."""
    first = F.split(body, "/")[0]
    tail = F.regexp_extract(body, r"\.([^./*?]+)$", 1)
    return F.when(rooted & fixed(first), key("first", first)).when(fixed(first), key("name", first)).when(tail != "", key("ext", tail)).otherwise(ANY)


def any_name_keys(path: Column) -> Column:
    names = F.split(path, "/")
    each = F.flatten(F.transform(names, lambda n: F.array(key("name", n), key("ext", extension_of(n)))))
    return F.array_distinct(F.concat(each, F.array(key("first", names[0]), F.lit(ANY))))


def matches(paths: DataFrame, rules: DataFrame, path: str, keys: Column) -> DataFrame:
    """Rows of ``paths`` (repo, ``path``, ...) with each of ``rules`` (repo, anchor, rx, ...) that matches."""
    keyed = paths.withColumn("anchor", F.explode(keys))
    return keyed.join(rules, ["repo", "anchor"]).where(F.expr(f"regexp_like({path}, rx)")).drop("anchor", "rx")
