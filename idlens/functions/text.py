"""Text functions over whole files and their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = ["scan_id", "repo", "path"]


def base_name(path: str = "path") -> Column:
    return F.regexp_extract(F.lower(F.col(path)), r"([^/\\]*)$", 1)


def extension(path: str = "path") -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def stem(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def explode_lines(df: DataFrame, gate: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row a line, 1-based; a whole-text ``gate`` regex spares files that cannot match."""
    rows = df.where(F.col("content").rlike(gate)) if gate else df
    return rows.select(*(keep or FILE), F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")


def line_at_offset(content: Column, position: Column) -> Column:
    """Line of a 1-based character position; null where there is none."""
    return F.when(position > 0, F.size(F.split(F.substring(content, F.lit(1), position - 1), "\n")))


def line_of_pattern(content: Column, pattern: str) -> Column:
    return line_at_offset(content, F.regexp_instr(content, F.lit(pattern)))


def line_for_key_value(content: Column, key: Column, value: Column) -> Column:
    """First line that holds the key's last part or the value."""
    tail = F.regexp_replace(F.regexp_extract(key, r"([^.]*)$", 1), r"\[.*$", "")
    at = [F.when(F.length(x) > 0, F.nullif(F.instr(content, x), F.lit(0))) for x in (tail, F.coalesce(value, F.lit("")))]
    return line_at_offset(content, F.least(*at))


def unquote(v: Column) -> Column:
    return F.regexp_replace(v, r"^['\"]+|['\"]+$", "")


PAIR = "array<struct<key:string,value:string,line_no:int>>"


def yaml_pairs(content: Column) -> Column:
    """``key: value`` lines, without list dashes and quotes."""
    lines = F.transform(F.split(content, "\n"), lambda x, i: F.struct(F.trim(x).alias("s"), (i + 1).cast("int").alias("n")))
    lines = F.filter(lines, lambda x: x["s"].contains(":") & ~x["s"].startswith("#"))

    def pair(x: Column) -> Column:
        key = F.trim(F.regexp_replace(F.regexp_extract(x["s"], r"^([^:]*):", 1), r"^[-\s]+", ""))
        value = unquote(F.trim(F.regexp_extract(x["s"], r"^[^:]*:(.*)$", 1)))
        return F.struct(unquote(key).alias("key"), value.alias("value"), x["n"].alias("line_no"))

    return F.transform(lines, pair).cast(PAIR)


def kv_pairs(content: Column) -> Column:
    """TOML and INI pairs: the earlier of ``=`` and ``:`` parts them; bare values lose trailing comments.

    Keys carry their section, as ``section.key``.
    """
    marked = F.split(content, "\n")
    lines = F.transform(marked, lambda x, i: F.struct(F.trim(x).alias("s"), (i + 1).cast("int").alias("n")))
    lines = F.filter(lines, lambda x: x["s"].rlike(r"^[^#;\[][^=:]*[=:]"))

    def pair(x: Column) -> Column:
        value = F.trim(F.regexp_extract(x["s"], r"^[^=:]*[=:](.*)$", 1))
        quoted = F.regexp_extract(value, r"""^(['"])(.*?)\1""", 2)
        bare = unquote(F.trim(F.regexp_replace(value, r"\s[#;].*$", "")))
        key = F.trim(F.regexp_replace(F.regexp_extract(x["s"], r"^([^=:]*)[=:]", 1), r"^[-\s]+", ""))
        return F.struct(key.alias("key"), F.when(value.rlike(r"""^['"]"""), quoted).otherwise(bare).alias("value"), x["n"].alias("line_no"))

    return F.transform(lines, pair).cast(PAIR)


def numbered_lines(content: Column) -> Column:
    """array<struct<n,s>>: the lines of a text, 1-based."""
    return F.transform(F.split(content, "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("s")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def last_before(marks: Column, n: Column, field: str) -> Column:
    """``field`` of the last of ``marks`` (ascending ``n``) at or before ``n``; null where there is none."""
    return F.try_element_at(F.filter(marks, lambda m: m["n"] <= n), F.lit(-1))[field]


def toml_section_pairs(df: DataFrame) -> DataFrame:
    """(file, line_no, key, value) with the section before the key, all in the file's own row."""
    lines = F.transform(numbered_lines(F.col("content")), lambda x: F.struct(x["n"].alias("n"), F.trim(x["s"]).alias("s")))
    header = r"^\[+([^\]]+)\]+$"
    sections = F.transform(F.filter("l", lambda x: x["s"].rlike(header)), lambda x: F.struct(x["n"].alias("n"), unquote(F.trim(F.regexp_extract(x["s"], header, 1))).alias("section")))
    pairs = F.filter("l", lambda x: x["s"].rlike(r"^[A-Za-z0-9_.-]+\s*=\s*.+$"))

    def pair(x: Column) -> Column:
        key = F.concat_ws(".", last_before(F.col("h"), x["n"], "section"), F.regexp_extract(x["s"], r"^([A-Za-z0-9_.-]+)", 1))
        return F.struct(x["n"].alias("line_no"), key.alias("key"), unquote(F.trim(F.regexp_extract(x["s"], r"=\s*(.+)$", 1))).alias("value"))

    rows = df.select(*FILE, lines.alias("l")).withColumn("h", sections)
    return rows.select(*FILE, F.inline(F.transform(pairs, pair)))


def json_depth(content: Column) -> Column:
    """How many containers of a JSON text stand in one another at most: the highest count of open brackets outside strings."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)\\.", ""), '"[^"]*"', "")
    steps = F.transform(F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda a, x: F.struct((a["open"] + x).alias("open"), F.greatest(a["most"], a["open"] + x).alias("most")), lambda a: a["most"])


def flatten_json(content: Column) -> Column:
    """array<struct<key,value>> of a JSON text's leaves, keys as ``a.b[0].c``; null if it does not parse.

    Containers are opened level by level inside one projection, as many levels as the text has.
    """
    node = "array<struct<key:string,v:variant>>"
    level = F.array(F.struct(F.lit("").alias("key"), F.try_parse_json(content).alias("v"))).cast(node)

    def is_kind(v: Column, kind: str) -> Column:
        return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))

    def open_(x: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
        items = F.try_variant_get(x["v"], "$", "array<variant>")
        dot = F.when(x["key"] == "", F.lit("")).otherwise(F.lit("."))
        as_fields = F.transform(fields, lambda e: F.struct(F.concat(x["key"], dot, e["key"]).alias("key"), e["value"].alias("v")))
        as_items = F.transform(items, lambda v, i: F.struct(F.concat(x["key"], F.lit("["), i.cast("string"), F.lit("]")).alias("key"), v.alias("v")))
        opened = F.when(is_kind(x["v"], "OBJECT"), as_fields.cast(node)).when(is_kind(x["v"], "ARRAY"), as_items.cast(node))
        return F.coalesce(opened, F.array(x).cast(node))

    parsed = F.when(F.try_parse_json(content).isNotNull(), content)
    level = F.aggregate(F.array_repeat(F.lit(0), json_depth(parsed)), level, lambda a, _: F.flatten(F.transform(a, open_)).cast(node))
    leaves = F.transform(level, lambda x: F.struct(x["key"].alias("key"), F.coalesce(F.try_variant_get(x["v"], "$", "string"), F.to_json(x["v"])).alias("value")))
    return F.when(F.try_parse_json(content).isNotNull(), leaves)


def json5_lite(content: Column) -> Column:
    """Strict JSON as it is; else without comments and trailing commas."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?m)(^|\s)//[^\n]*$", "$1"), r"(?s)/\*.*?\*/", "")
    bare = F.regexp_replace(bare, r",(\s*[}\]])", "$1")
    return F.when(F.try_parse_json(content).isNotNull(), content).otherwise(bare)


BLOCKS = "array<struct<a:int,b:int>>"


def blocks(lines: Column, header: str) -> Column:
    """The indented blocks of a file's ``numbered_lines``, as struct<a, b>: a line n stands in one if a < n < b.

    A block opens at a line that matches ``header`` and ends before the first later line that is not blank and stands no
    further right, or at the next header. Comments count neither for a header's indent nor as lines. The work is that of
    the file's lines times its headers, in the file's own row.
    """
    bare = lambda x: F.regexp_replace(x["s"], r"#.*$", "")
    heads = F.transform(F.filter(lines, lambda x: x["s"].rlike(header)), lambda x: F.struct(x["n"].alias("n"), F.length(F.regexp_extract(bare(x), r"^( *(?:- +)?)", 1)).alias("indent")))
    stops = F.transform(F.filter(lines, lambda x: (F.trim(bare(x)) != "") & ~x["s"].rlike(header)), lambda x: F.struct(x["n"].alias("n"), F.length(F.regexp_extract(x["s"], r"^( *)", 1)).alias("lead")))
    never = F.lit(2**31 - 1)

    def block(heads: Column, stops: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            following = F.coalesce(F.try_element_at(heads, (i + 2).cast("int"))["n"], never)
            stop = F.coalesce(F.array_min(F.transform(F.filter(stops, lambda x: (x["n"] > h["n"]) & (x["lead"] <= h["indent"])), lambda x: x["n"])), never)
            return F.struct(h["n"].alias("a"), F.least(following, stop).alias("b"))

        return F.transform(heads, one).cast(BLOCKS)

    return let(heads, lambda h: let(stops, lambda s: block(h, s)))


def inside(found: Column, n: Column) -> Column:
    """Whether line ``n`` stands in one of ``blocks``."""
    return F.exists(found, lambda x: (n > x["a"]) & (n < x["b"]))


def in_block(df: DataFrame, header: str, keep: list[str] | None = None) -> DataFrame:
    """Lines of files with ``inside``: they stand in the indented block that the last ``header`` line opened."""
    rows = df.select(*(keep or FILE), numbered_lines(F.col("content")).alias("_l")).withColumn("_b", blocks(F.col("_l"), header))
    return rows.select(*(keep or FILE), "_b", F.inline("_l")).select(*(keep or FILE), F.col("s").alias("line"), F.col("n").alias("line_no"), inside(F.col("_b"), F.col("n")).alias("inside"))


# Names of one capability.
CANONICAL_TOOL = {
    "postgres": "database",
    "mysql": "database",
    "sqlite": "database",
    "run_shell": "shell",
    "run_command": "shell",
    "execute_command": "shell",
    "terminal": "shell",
    "send_email": "email",
    "gmail": "email",
    "read_file": "filesystem",
    "write_file": "filesystem",
}


def capabilities(text: Column, vocabulary: list[str]) -> Column:
    """Sorted distinct capabilities that a text names as whole words."""
    words = "|".join(sorted(vocabulary, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9_-])(?:{words})(?!\.com\b)(?![a-z0-9_-])"), F.lit(0))
    table = F.create_map(*(F.lit(x) for kv in CANONICAL_TOOL.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.coalesce(F.try_element_at(table, m), m))))


def has_word(text: Column, words: list[str]) -> Column:
    return text.rlike(rf"(?i)\b(?:{'|'.join(words)})\b")


# Fixed values, in order of precedence.
SERVER_PARTS = [".command", ".args", ".env", ".url", ".headers", ".type", ".transport", ".source", ".package", ".image"]


def server_prefix(key: Column) -> Column:
    """What of a flattened key names the server it configures."""
    low = F.lower(key)
    cut = F.coalesce(*(F.when(low.contains(p), F.instr(low, F.lit(p))) for p in SERVER_PARTS))
    return F.when(cut.isNotNull(), F.substring(low, F.lit(1), cut - 1)).otherwise(F.regexp_replace(low, r"\.[^.]*$", ""))


def bounded_strings(content: Column) -> Column:
    """Printable ASCII runs of five or more in the first 256 KiB of a binary."""
    return F.regexp_extract_all(F.decode(F.substring(content, 1, 262_144), "ISO-8859-1"), F.lit("[ -~]{5,}"), F.lit(0))
