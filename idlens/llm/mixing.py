"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Native: DataFrame functions only. Documents get a hash-random key; its leading bits are the ranges of the
sort (the key is uniform, so equal ranges hold equal shares and no sampling is needed). Sizes are summed by
source and range, the sums are prefix-summed within each source, and a window over one range at a time
finishes each document's prefix sum. A hot source is spread over all its ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import WORD, discard, materialize

#: Weights by a source's place, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
EPOCHS = 3
#: Documents a range holds on average, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 256, 1 << 16


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, key): words of the whole text (null: 0) and a 32-bit hash-random key."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) for each source, null included.

    Sources rank by code point, null last. Their targets share the whole size by weight; a target stops at
    ``epochs`` times its source's size and the excess goes to the others by weight until none is above. With
    sources in ascending order of cap by weight, the capped ones are a prefix: those whose cap is at most
    the level that the rest of the size and of the weights give.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    w = by.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * float(epochs))
    up = Window.orderBy(F.col("cap") / F.col("w"), "w", "source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    w = w.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "w", F.coalesce("source", F.lit("")), "level"))).over(everything)
    return w.withColumn("final", first["level"]).select(
        "source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target")
    )


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` counts words with repeats: whole epochs of the source, and of the last one the words up to the
    source's exact budget, so that the document at the cut gives its leading words. Order within a source: key,
    doc_id, size; equal rows are interchangeable. An empty table gives no rows; extra columns are not read.
    """
    sized = materialize(sizes(docs, text), "sizes")
    n = sized.count()
    ranges = 1 << min(int(math.log2(MOST_RANGES)), max(6, math.ceil(math.log2(max(1, n) / RANGE_ROWS))))
    spread = sized.withColumn("range", F.shiftright("key", 32 - int(math.log2(ranges))).cast("int"))
    sums = spread.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    up = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.withColumn("base", F.coalesce(F.sum("in_range").over(up), F.lit(0))).drop("in_range"), "starts")
    goal = materialize(targets(sized, weights, epochs), "targets")
    starts = starts.alias("s").join(goal.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("d").join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range"))
    ).select("d.doc_id", "d.source", "size", "source_size", "target", (F.col("base") + F.col("inner")).alias("before"))
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - full * F.col("source_size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``taken`` holds its size, to the nearest whole number.

    Texts stay whole: the one document at each source's cut is in or out. Documents without words, or without an
    id, go; rows that share an id are taken alike.
    """
    copies = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    want = mix(docs).where("size > 0").select(F.col("doc_id").alias("_id"), copies.alias("_copies")).where("_copies > 0")
    want = want.groupBy("_id").agg(F.max("_copies").alias("_copies"))
    joined = docs.join(want, docs.doc_id == want._id)
    extra = "_copy" + "_".join(docs.columns)  # a name that no column has
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), want._copies)).alias(extra)).drop(extra)


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3) + 1]::DOUBLE AS w,
        source_size * 3.0::DOUBLE AS cap FROM src),
l AS (SELECT *, cap / w AS ratio, ((SELECT sum(source_size) FROM src)::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY cap / w, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, ratio) AS final FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT final FROM f), 1e300) * w) AS target FROM l),
p AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, floor(target)::BIGINT AS budget FROM p),
c AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_epochs FROM b)
SELECT doc_id, source, size, source_size, target,
  (full_epochs * size + greatest(0, least(size, budget - full_epochs * source_size - before)))::BIGINT AS taken FROM c
"""
