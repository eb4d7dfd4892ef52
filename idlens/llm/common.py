"""Helpers shared by the training-data operators: shared scratch tables, folds and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a separator of words in every contract: blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one of this machine's own if Spark is local, as in
    tests; on a cluster an error, as executors would not see it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Parquet row groups of intermediate tables: a writer holds one in memory, so small ones keep executors small.
ROW_GROUP = {"parquet.block.size": str(16 << 20)}


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as a table in the shared scratch folder and read it back.

    Cuts lineage, so a lost executor costs only the stage in flight; no data stays on an executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/idlens/{name}-{uuid.uuid4().hex}"
    df.write.options(**ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._idlens_path = path
    return out


#: Rows and bytes of an Arrow batch where whole texts cross to Python: bounds what a worker and the JVM hold at once.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, once the session sends texts to Python workers in batches of bounded size.

    Spark reads the two settings when a query runs, so they stay set for the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    return df


def give_back() -> None:
    """Return a Python worker's free memory to the system: idle workers of earlier stages stay beside the heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own count
        return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that gives free memory back when the task ends."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def discard(df: DataFrame) -> None:
    """Remove a table written by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_idlens_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def held_out(doc_id) -> F.Column:
    """True for the fifth of documents no model may learn from: crc32 of the id as text, modulo 5, is 0.

    A null id counts as not held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_fraction(col, fraction: float | F.Column) -> F.Column:
    """Deterministic row sample by a hash of ``col``; ``fraction`` >= 1 keeps every row."""
    most = F.floor(fraction * (1 << 30)) if isinstance(fraction, F.Column) else F.lit(int(fraction * (1 << 30)))
    return F.pmod(F.xxhash64(col, F.lit(20)), F.lit(1 << 30)) < most


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``edges``; ``comp`` is the smallest node it can reach.

    Every node hooks to its smallest neighbour; chains are halved until they end at roots; links are redrawn
    between roots and the same ones merged. The number of roots at least halves a round, so links shrink fast and
    a node with very many of them is looked up once. Every round is a written table, every step a join or an
    aggregate, so neither links nor labels pass through the driver.
    """
    ends = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    pair = materialize(edges.select(*ends).where("a < b").distinct(), "edges")
    labels = None
    while True:
        both = pair.select(F.col("a").alias("node"), F.col("b").alias("near")).union(pair.select("b", "a"))
        up = materialize(both.groupBy("node").agg(F.least("node", F.min("near")).alias("comp")), "hooks")
        while True:
            higher = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            hop = up.join(higher, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved"))
            hop = materialize(hop, "hooks")
            moved = hop.where("moved").limit(1).count()
            discard(up)
            up = hop
            if not moved:
                break
        up = up.select("node", "comp")
        if labels is None:
            labels = up
        else:
            moves = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            labels = materialize(labels.join(moves, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            pair = pair.join(up.withColumnsRenamed({"node": end, "comp": "_top"}), end).drop(end).withColumnRenamed("_top", end)
        ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        pair = materialize(pair.select(*ends).where("a < b").distinct(), "edges")
        if not pair.head(1):
            return labels
