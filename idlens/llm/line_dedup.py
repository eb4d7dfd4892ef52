"""Line dedup by overlapping three-line windows.

Native: DataFrame functions only. Every three consecutive lines of a document are hashed; windows found more
than once anywhere have a first occurrence, the smallest (doc_id, place); the lines of every later one go, and
the covered places of a document are merged before its text is put together again. The first occurrence of a
line is never covered by a later window, so every distinct line survives somewhere.

Each row without a doc_id is a document of its own, after all that have one: it loses its later occurrences and
takes nothing from rows with ids. ``ORACLE`` joins by doc_id and so leaves rows without one as they are; it agrees
on all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlens.llm.common import materialize

LINES = 3
#: A window is heavy if more than one of so many windows equal it; there are no more heavy ones than this.
HEAVY = 1000


#: Names a row without a doc_id; empty where there is one. Sorts rows without ids last.
ROW = "_line_dedup_row"
DOC = [ROW, "doc_id"]


def name_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``ROW``: hash of the text and a number. Rows without ids are written once, so their numbers stay."""
    number = F.concat_ws("-", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    nameless = materialize(docs.where(F.col("doc_id").isNull()).withColumn(ROW, number), "nameless")
    return docs.where(F.col("doc_id").isNotNull()).withColumn(ROW, F.lit("")).union(nameless)


def windows(docs: DataFrame, text: str = "text", lines: int = LINES) -> DataFrame:
    """(row, doc_id, at, h1, h2): place and 128-bit hash of each window; texts of fewer lines have none.

    Windows of blank lines only do not count. Lines compare exactly, as LF ends them.
    """
    parts = docs.select(*DOC, F.split(text, "\n").alias("l")).where(F.size("l") >= lines)

    def window(i):
        piece = F.slice("l", i, lines)
        joined = F.array_join(piece, "\n")
        return F.struct(i.alias("at"), F.xxhash64(joined).alias("h1"), F.xxhash64(joined, F.lit(1)).alias("h2"), (F.trim(F.regexp_replace(joined, r"\s+", "")) == "").alias("blank"))

    made = parts.select(*DOC, F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - lines + 1), window)).alias("w"))
    return made.select(*DOC, "w.at", "w.h1", "w.h2").where("NOT w.blank")


def covered_lines(docs: DataFrame, text: str = "text", lines: int = LINES) -> DataFrame:
    """(row, doc_id, gone): the 1-based places of a document's lines that later occurrences cover, merged.

    First occurrences are found by a partial aggregate, so a window in every document costs a row a task; a
    document's list is bounded by its own lines. Heavy windows are told to all tasks, so none of them has to take
    in a window's every occurrence; the counts of all windows add up, so that at most ``HEAVY`` rows are broadcast.
    """
    found = materialize(windows(docs, text, lines), "windows")
    here = F.struct(*DOC, "at")
    repeated = materialize(found.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    heavy = F.col("n") * HEAVY > found.count()
    marked = found.join(F.broadcast(repeated.where(heavy).drop("n")), ["h1", "h2"], "left")
    light = marked.where("first IS NULL").drop("first").join(repeated.where(~heavy).drop("n"), ["h1", "h2"])
    later = marked.where("first IS NOT NULL").unionByName(light).where(~here.eqNullSafe(F.col("first")))
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + lines - 1)))))
    return later.groupBy(*DOC).agg(places.alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``, and columns n_lines and n_removed.

    Null text stays null with no lines; a text losing every line becomes empty; other columns pass through, but for
    input columns of the two added names. Rows that share a doc_id share the places found for it. A long text takes
    time in proportion to its lines. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # other columns of the input stay packed, so that their names never meet those used here
    packed = name_rows(docs.select("doc_id", F.col(text).alias("_text"), F.struct(*(c for c in kept if c != text)).alias("_row")), "_text")
    gone = covered_lines(packed, "_text", lines).select(F.col(ROW).alias("_gone_row"), F.col("doc_id").alias("_gone_id"), F.col("gone").alias("_gone"))
    rows = packed.join(gone.hint("shuffle_hash"), packed.doc_id.eqNullSafe(gone._gone_id) & (packed[ROW] == gone._gone_row), "left")
    rows = rows.select("_row", "_text", F.split("_text", "\n").alias("_lines"), "_gone")
    # the places left come from one hash of those gone
    places = F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.col("_gone"))
    left = F.array_join(F.transform(places, lambda i: F.element_at("_lines", i)), "\n")
    return rows.select(
        *(F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left).alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in kept),
        F.coalesce(F.array_size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, pos, array_to_string(l[pos:pos+2], chr(10)) AS w
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS pos FROM l WHERE len(l) >= 3)),
f AS (SELECT w, min(doc_id) AS d, arg_min(pos, struct_pack(a := doc_id, b := pos)) AS a FROM w
      WHERE regexp_matches(w, '[^ \t\n\v\f\r]') GROUP BY w HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM w JOIN f USING (w) WHERE doc_id <> d OR pos <> a),
k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT doc_id, pos, l[pos] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM l)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM x ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(l.l), 0)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(t.text, '')) AS text_sha256
FROM l LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
