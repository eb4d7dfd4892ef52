"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full shingle sets.

Each permutation keeps its minimum and its maximum, so 128 signature values cost 64 hash evaluations a
shingle; 32 bands of 2 minima and 2 maxima propose pairs. A pair at similarity 0.75 misses all of them with a
chance of 1e-5 at most. In small sets a minimum and a maximum depend on each other, so sets of fewer than ``SHORT``
shingles have twice the bands; pairs of those miss with a chance of 2e-8 at most. Confirmation needs no list of all
pairs of a bucket:

1. documents with equal sets form a class and only classes are compared;
2. in each bucket the classes are compared with one leader, and links joined into components;
3. buckets that still hold several components are compared in blocks of classes, each pair of blocks one small
   group whose overlaps are counted at once; only links that join components leave it. Blocks are bounded by the
   number and the summed size of their sets, so that long texts make small blocks.

So every pair that shares a band is confirmed exactly or already known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.bpe import text_blocks
from idlens.llm.common import connected_components, discard, give_back, lean, materialize, text_batches

WORDS, PERMUTATIONS, BANDS = 5, 64, 32
#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Sets below this size have twice the permutations and bands.
SHORT = 22
#: Classes and shingles of a block, on average and at most, when a bucket is compared exactly.
BLOCK, BLOCK_SHINGLES = 320, 1_000_000
#: Pairs of one leader that a task compares.
STAR = 4096

_draw = np.random.default_rng(20240607)
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _draw.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_PERM = _draw.integers(0, 2**64, 2 * PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_BASE = int(_STEP[63])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and where each text's words begin (and the end)."""
    parts = [t.encode("utf-8").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, int(len(buf)).bit_length())
    if size not in _power_cache:
        _power_cache.clear()
        _power_cache[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    up, down = _power_cache[size]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return h, np.searchsorted(start, first)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words make one shingle, none an empty set."""
    h, at = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for k in range(words):
        s += h[k : k + n] * _STEP[k]
    s = _mix(s)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            out.append(_mix((h[a:b] * _STEP[10 : 10 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the bands over minima and maxima under every permutation."""
    times = 2 if len(s) < SHORT else 1
    perm, bands = _PERM[: times * PERMUTATIONS], times * BANDS
    low, high = np.full(len(perm), 2**64 - 1, np.uint64), np.zeros(len(perm), np.uint64)
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048] * perm[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    per = PERMUTATIONS // BANDS
    v = np.concatenate([low.reshape(bands, per), high.reshape(bands, per)], 1)
    v = _mix(v) * _STEP[20 : 20 + 2 * per]
    return _mix(v.sum(1) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def text_key(text: str) -> F.Column:
    """A hash that finds a class's text again, also where its rows have no id."""
    return F.xxhash64(F.col(text), F.lit(24))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, bands) of each row; digest and bands are null for an empty set."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("text_key", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, "text", 500_000):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "bands"],
            )

    rows = docs.select("doc_id", text_key(text).alias("text_key"), F.col(text).alias("text"))
    return text_batches(rows).mapInArrow(lean(run), schema)


def full_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(digest, hashes) for the classes of ``wanted`` (digest, rep, key), made anew from the text of their first row."""
    rows = docs.select("doc_id", text_key(text).alias("key"), F.col(text).alias("text"))
    rows = rows.join(wanted, (rows["key"] == wanted["key"]) & rows["doc_id"].eqNullSafe(wanted["rep"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, "text", 500_000):
            found = [(d, s.tobytes()) for d, s in zip(batch.column("digest").to_pylist(), shingle_sets(texts)) if _digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["digest", "hashes"])

    # equal ids may stand on several rows with one text
    return text_batches(rows.select("digest", "text")).mapInArrow(lean(run), "digest binary, hashes binary").dropDuplicates(["digest"])


def linked(overlap, a, b):
    return 100 * overlap >= PERCENT * (a + b - overlap)


def confirm_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough; an ``a`` of many pairs is dealt to several tasks."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    pairs = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(25)), "parts").cast("int").alias("part"))
    leaders = sets.withColumnsRenamed({"digest": "a", "hashes": "ha"}).join(load, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = pairs.join(sets.withColumnsRenamed({"digest": "b", "hashes": "hb"}), "b").join(leaders, ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(lean(run), "a binary, b binary")


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the hashes that two sets share."""
    n = len(sets)
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1
    new = np.cumsum(shared) - 1
    keep = shared[inv]
    row, tok = row[keep], new[inv[keep]]
    order = np.argsort(tok, kind="stable")
    row, tok = row[order], tok[order]
    out = np.zeros((n, n), np.float32)
    width = int(shared.sum())
    for a in range(0, width, chunk):
        lo, hi = np.searchsorted(tok, (a, a + chunk))
        m = np.zeros((n, min(chunk, width - a)), np.float32)
        m[row[lo:hi], tok[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components in one pair of blocks, as many as join them."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    comp, block = pdf["comp"].tolist(), pdf["block"].to_numpy()
    size = np.array([len(s) for s in sets])
    common = overlaps(sets)
    good = np.triu(linked(common, size[:, None], size[None, :]), 1)
    if block.min() != block.max():
        good &= block[:, None] != block[None, :]
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.get(x, x) != x:
            x = root[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(good)):
        x, y = find(comp[i]), find(comp[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((comp[i], comp[j]))
    del sets, common, good
    if len(pdf) > BLOCK // 4:
        give_back()
    return pd.DataFrame(found, columns=["a", "b"])


def components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Null or blank texts have an empty set, no links and their own id. Rows with a null id link like others; they are
    kept, and their component is the smallest id linked with, null where there is none. Rows that repeat an id stand
    for themselves. Texts are read whole, whatever their length. Ties do not arise: ids are compared as numbers. An
    empty table gives no rows. Only ``doc_id`` and the text are read, so other columns never clash.
    """
    rows = materialize(signatures(docs, text), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("rep"), F.col("text_key").alias("key")))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("digest", "first.rep", "first.key", "n", "bands"), "classes")
    banded = classes.select("digest", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min(F.struct("digest", "n")).alias("leader"), F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1")
    members = materialize(banded.join(buckets, "band"), "members")
    wanted = members.select("digest").distinct().join(classes.select("digest", "rep", "key"), "digest")
    sets = materialize(full_sets(docs, wanted, text), "sets")
    close = f"{PERCENT} * greatest(n, leader.n) <= 100 * least(n, leader.n)"
    stars = members.where("digest <> leader.digest").where(close).select(F.col("leader.digest").alias("a"), F.col("digest").alias("b")).distinct()
    comp = materialize(connected_components(confirm_pairs(stars, sets)), "comp")

    named = members.join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    h = F.xxhash64("digest")
    # a pair's bucket is settled by its leader; equal buckets are compared once
    open_ = (
        named.where("m > 2")
        .groupBy("band", "m")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.expr("bit_xor(xxhash64(digest))").alias("x"), F.expr("bit_xor(xxhash64(digest, 1))").alias("y"))
        .where("c0 <> c1")
        .groupBy("m", "x", "y")
        .agg(F.min("band").alias("band"))
    )
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    todo = named.join(open_.select("band"), "band", "left_semi").select("band", "digest", "comp", blocks.alias("blocks"))
    todo = todo.withColumn("block", F.pmod(h, "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    todo = todo.select("band", "digest", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rest = todo.join(sets, "digest").groupBy("band", "i", "j").applyInPandas(block_links, "a binary, b binary")
    over = materialize(connected_components(rest), "over")
    for done in (members, sets):
        discard(done)

    label = classes.select("digest", "rep").join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    label = label.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("outer")), "comp", "left").withColumn("comp", F.coalesce("outer", "comp"))
    label = materialize(label.select("digest", "comp", "rep"), "label")
    discard(classes)
    least = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = label.join(least, "comp").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest id.

    Rows of an equal id are told apart by nothing here and stay together; rows without an id stay.
    """
    gone = components(docs, text).where("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone_id, "left_anti")
