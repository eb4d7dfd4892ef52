"""Packing of documents into sequences of a fixed length by best-two-fit.

A sequence is filled greedily, each time with the longest unpacked piece that fits. Then its smallest piece comes out
again where two unpacked pieces fit the gap it leaves more tightly. Pieces of one length are alike to this method, so
it needs to know of all pieces only how many there are of each length: ``plan`` runs it on those counts, and a filling
that the counts allow many times over is written once with its number of repeats. The plan is as large as the sequence
length asks, whatever the number of documents, and is the one that packing all documents one by one would give.

Spark does the rest. One pass encodes and cuts the documents and writes the pieces, each with its number among the
pieces of its length in its part; sums over parts make that a number among all, without bringing a length's pieces
together; the plan's entries, met by length and number, tell sequence and offset.

Null texts are empty and give a piece of the end id alone. Rows without an id or with the same one are pieces of their
own. A text of any length is encoded whole and cut into pieces of the sequence length. Other columns are not read, so
their names never clash; an empty table gives no rows. Reruns over the same partitions agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.bpe import text_blocks, word_ids
from idlens.llm.common import lean, materialize, text_batches
from idlens.llm.token_files import library_encoder

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 2048, 0


class Entry(NamedTuple):
    """Of the pieces of ``length``, numbers ``first`` up to ``first + repeats * each``: ``each`` a sequence, side by side
    from ``offset`` on, in sequences from ``sequence`` on."""

    length: int
    first: int
    repeats: int
    each: int
    sequence: int
    offset: int


def fill(counts: np.ndarray, size: int) -> tuple[dict[int, int], int]:
    """The next sequence out of ``counts`` (pieces by length), as pieces by length, and how often it comes in a row."""
    used: dict[int, int] = {}
    room = size
    while room:
        there = np.flatnonzero(counts[: room + 1])
        there = there[::-1]
        # lengths taken up to nothing make way for the next shorter one
        pick = next((int(s) for s in there if counts[s] > used.get(int(s), 0)), 0)
        if not pick:
            break
        n = min(int(counts[pick]) - used.get(pick, 0), room // pick)
        used[pick] = used.get(pick, 0) + n
        room -= n * pick
    held = dict(used)  # pieces that must be there for this choice
    if room and used:
        small = min(used)
        left = counts.copy()
        for s, n in used.items():
            left[s] -= n
        gap = room + small
        pair = best_pair(left, gap)
        if pair and sum(pair) > small:
            for s in pair:
                held[s] = held.get(s, 0) + 1
            used[small] -= 1
            for s in pair:
                used[s] = used.get(s, 0) + 1
            used = {s: n for s, n in used.items() if n}
    repeats = min((int(counts[s]) - held[s]) // used[s] + 1 if s in used else 1 << 62 for s in held)
    return used, repeats


def best_pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two lengths out of ``left`` that fill ``gap`` most; of equal ones those of the longest piece."""
    there = np.flatnonzero(left[: gap + 1])
    if not len(there):
        return None
    at = np.searchsorted(there, gap - there, "right") - 1
    # the other piece is no longer than this one, and another one than this
    at = np.minimum(at, np.arange(len(there)))
    at = np.where((at == np.arange(len(there))) & (left[there] < 2), at - 1, at)
    good = at >= 0
    if not good.any():
        return None
    total = np.where(good, there + there[at], -1)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(there[best]), int(there[at[best]])


def plan(counts: dict[int, int], size: int = LENGTH) -> list[Entry]:
    """Best-two-fit over all pieces, given how many there are of each length (1 to ``size``)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(size + 1, np.int64)
    out: list[Entry] = []
    sequence = 0
    while left.any():
        used, repeats = fill(left, size)
        offset = 0
        for length in sorted(used, reverse=True):
            each = used[length]
            out.append(Entry(length, int(taken[length]), repeats, each, sequence, offset))
            taken[length] += repeats * each
            left[length] -= repeats * each
            offset += each * length
        sequence += repeats
    return out


PIECES = "doc_id {}, piece int, start long, length int, nth long, ids_crc32 long, ids array<int>"


def cut(docs: DataFrame, path: str, text: str = "text", size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, nth, ids_crc32, ids) for each piece; ``nth`` counts the pieces of its length before
    it in its partition. Ids come from the tokenizers library, asked once for each distinct pre-token of a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path, "library", lambda vocab: library_encoder(path, vocab))
        seen = np.zeros(size + 1, np.int64)
        for batch, texts in text_blocks(batches, "text"):
            flat, bounds = known.encode(texts)
            flat = np.insert(flat, bounds[1:], end_id)
            tokens = np.diff(bounds) + 1
            pieces = -(-tokens // size)
            parent = np.repeat(np.arange(len(tokens)), pieces)
            number = np.arange(len(parent)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(size, tokens[parent] - number * size)
            ends = np.concatenate([[0], np.cumsum(length)])
            raw = flat.astype("<u4")
            # the order among equal lengths of this block, after those of earlier ones
            order = np.argsort(length, kind="stable")
            lengths, count = np.unique(length, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count) + seen[length[order]]
            seen[lengths] += count
            columns = [
                batch.column("doc_id").take(pa.array(parent)),
                pa.array(number.astype(np.int32)),
                pa.array(number * size),
                pa.array(length.astype(np.int32)),
                pa.array(nth),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "nth", "ids_crc32", "ids"])

    source = docs.select("doc_id", F.col(text).alias("text"))
    return text_batches(source).mapInArrow(lean(run), PIECES.format(source.schema["doc_id"].dataType.simpleString()))


def place(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """``pieces`` (length, part, nth) with sequence_id and offset instead of part and nth.

    The counts of lengths by part are summed in Spark; those of all parts, ``size`` numbers at most, give the plan. Its
    entries, cut at the parts' bounds, meet the pieces by part and length.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    entries = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    planned = spark.createDataFrame(entries, "length int, first long, repeats long, each int, sequence long, offset int")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.col("first") + F.col("repeats") * F.col("each")
    # bounded by the sequence length, not by the documents
    met = ranges.join(F.broadcast(planned), "length").where((F.col("first") < F.col("base") + F.col("n")) & (last > F.col("base")))
    met = met.select("part", "length", (F.col("first") - F.col("base")).alias("_first"), (last - F.col("base")).alias("_last"), "each", "sequence", F.col("offset").alias("_offset"))
    joined = pieces.join(met, ["part", "length"]).where("nth >= _first AND nth < _last")
    at = F.col("nth") - F.col("_first")
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    return joined.select(
        *kept,
        (F.col("sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, text: str = "text", size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): every piece and its place.

    ``start`` counts its document's ids before it. The pieces are a written table, so a reader that asks for no ids
    fetches none.
    """
    pieces = materialize(cut(docs, path, text, size, end_id).withColumn("pos", F.monotonically_increasing_id()), "pieces")
    return place(pieces.withColumn("part", F.shiftright("pos", 33)).drop("pos"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, documents): the packed sequences, each with its ids and the pieces in it. A group
    holds a sequence's tokens, so none is large."""
    piece = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    ids = F.flatten(F.col("pieces.ids"))
    documents = F.transform("pieces", lambda p: p.dropFields("ids"))
    return rows.select("sequence_id", F.size(ids).alias("n_tokens"), ids.alias("ids"), documents.alias("documents"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The query of the contract."""
    return pack(docs, path).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
