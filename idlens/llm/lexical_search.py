"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents are indexed in shards of bounded size, one pass over the texts: for the terms that queries ask for, a shard
holds its documents' places and frequencies. In a shard a query's short lists are summed term at a time into
accumulators; these are then one more iterator, with the largest sum as its bound, beside the long lists in
a document-at-a-time evaluation. That goes through windows of documents: a window whose bounds cannot reach the
threshold is skipped, lists whose bounds together cannot reach it bring no candidates, and such long lists are
skipped through to the candidates that can still make it. The threshold is the score of the last place so far, kept
from shard to shard of a task. Tasks give their best of each query, and those of all tasks are ranked together.

A score sums, over the query's distinct terms, weight * ((10^9 * tf) div (1000 * tf + 8 * m)), where m grows with the
document's length against the mean one; see ``Collection``.

Null texts have no terms and count nowhere. Equal scores rank by ascending id, rows without one last; rows that repeat an
id are documents of their own. Rows of queries that share an id are one query with the terms of all; a query without
terms has no results. Very long texts are taken whole. Other columns are not read, so their names never clash; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.common import discard, lean, materialize, text_batches

#: Documents and postings of a shard, at most (one document more may go over).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: A list is short if it holds at most this share of its shard's documents.
SHORT = 1 / 16
#: Documents of a window of the document-at-a-time part.
WINDOW = 4096
#: Pairs of query and term that one pass over the documents serves; more queries take more passes.
BLOCK_PAIRS = 500_000
TOP = 10

# Fixed values of the score.
TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90

# ASCII letters and digits make terms, capitals in lower case, and so does all beyond ASCII; the rest parts them.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a whole text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def query_terms(queries: DataFrame, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, term): the distinct terms of each query, in UTF-8."""
    source = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("t"))
    schema = T.StructType([source.schema["query_id"], T.StructField("term", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t))) if t else [] for t in batch.column("t").cast(pa.binary()).to_pylist()]
            parent = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(parent)), pa.array([t for x in own for t in x], pa.binary())], names=["query_id", "term"])

    return text_batches(source).mapInArrow(lean(run), schema).distinct()


@dataclass
class Block:
    """Queries of one pass: their ids, and numbers of their terms."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def blocks(asked: DataFrame, pairs: int = BLOCK_PAIRS) -> Iterator[Block]:
    """The queries of ``query_terms`` in blocks of about ``pairs`` pairs, read a partition at a time."""
    grouped = asked.groupBy("query_id").agg(F.collect_set("term").alias("terms")).orderBy("query_id")
    ids, lists, vocabulary, held = [], [], {}, 0
    for row in grouped.toLocalIterator():
        ids.append(row.query_id)
        lists.append(np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row.terms], np.int64))
        held += len(row.terms)
        if held >= pairs:
            yield Block(ids, lists, vocabulary)
            ids, lists, vocabulary, held = [], [], {}, 0
    if ids:
        yield Block(ids, lists, vocabulary)


SHARD = "doc_ids binary, no_id binary, lengths binary, docs int, words long, terms array<int>, counts array<int>, places binary, tfs binary"


def _pack(ids: list, lengths: list[int], words: list[int], places: list[int], tfs: list[int]) -> pa.RecordBatch:
    """A shard's row: postings by term, then place."""
    word, place, tf = np.array(words, np.int32), np.array(places, np.int32), np.array(tfs, np.int32)
    order = np.argsort(word, kind="stable")
    numbers, counts = np.unique(word, return_counts=True)
    n = np.array(lengths, np.int64)
    row = {
        "doc_ids": np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
        "no_id": np.array([i is None for i in ids], bool).tobytes(),
        "lengths": n.tobytes(),
        "docs": int((n > 0).sum()),
        "words": int(n.sum()),
        "terms": numbers.astype(np.int32).tolist(),
        "counts": counts.astype(np.int32).tolist(),
        "places": place[order].tobytes(),
        "tfs": tf[order].tobytes(),
    }
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """One row a shard: ids and lengths of its documents, and the postings of the terms of ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("t").cast(pa.binary())):
                found = terms(raw.as_py() or b"")
                hits = [(w, c) for t, c in Counter(found).items() if (w := vocabulary.get(t)) is not None]
                ids, lengths, words, places, tfs = shard
                words += [w for w, _ in hits]
                tfs += [c for _, c in hits]
                places += [len(ids)] * len(hits)
                ids.append(doc)
                lengths.append(len(found))
                if len(ids) >= SHARD_DOCS or len(words) >= SHARD_POSTINGS:
                    yield _pack(*shard)
                    shard = ([], [], [], [], [])
        if shard[0]:
            yield _pack(*shard)

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"))).mapInArrow(lean(run), SHARD)


@dataclass
class Collection:
    """What scores need of all documents: how many have terms, their terms with repeats, each term's weight."""

    docs: int
    words: int
    weights: np.ndarray

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """m of each document: 100 at the mean length."""
        if not self.words:
            return np.full(len(lengths), 100 - LENGTH_SHARE, np.int64)
        if len(lengths) and int(lengths.max()) * self.docs * LENGTH_SHARE < 1 << 63:
            return 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * self.docs) // self.words
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * self.docs // self.words for n in lengths], np.int64)


def collection(index: DataFrame, size: int) -> Collection:
    """Sums over the whole index; a row for each term that queries ask for comes to the driver."""
    total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    rows = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).collect()
    df = np.zeros(size, np.int64)
    df[[r.terms for r in rows]] = [r.df for r in rows]
    weights = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()]
    return Collection(total.docs, total.words, np.array(weights, np.int64))


@dataclass
class Best:
    """A query's best so far."""

    top: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def threshold(self) -> int:
        """A score below this one has no place any more; 1 while places are free."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, no_id = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.no_id, no_id)))
        order = np.lexsort((doc, no_id, -score))[: self.top]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]


class Postings:
    """A list of ascending places with their parts of the score, and its windows."""

    def __init__(self, places: np.ndarray, parts: np.ndarray, docs: int):
        self.places, self.parts = places, parts
        self.cuts = np.searchsorted(places, np.arange(0, docs + WINDOW, WINDOW))
        some = np.flatnonzero(self.cuts[:-1] < self.cuts[1:])
        self.bounds = np.zeros(len(self.cuts) - 1, np.int64)
        if len(some):
            self.bounds[some] = np.maximum.reduceat(parts, self.cuts[some])

    def window(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[k], self.cuts[k + 1]
        return self.places[a:b], self.parts[a:b]


class Shard:
    """A shard's postings with their parts of the score."""

    def __init__(self, row: dict, known: Collection):
        self.doc, self.no_id = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], bool)
        self.size = len(self.doc)
        counts, numbers = np.array(row["counts"], np.int64), np.array(row["terms"], np.int64)
        places, tf = np.frombuffer(row["places"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        norm = known.norm(np.frombuffer(row["lengths"], np.int64))
        parts = np.repeat(known.weights[numbers], counts) * (TF_SCALE * tf // (TF_UNIT * tf + LENGTH_UNIT * norm[places]))
        ends = np.cumsum(counts)
        # terms that nearly every document holds weigh nothing
        self.lists = {int(t): (places[e - c : e], parts[e - c : e]) for t, c, e in zip(numbers, counts, ends) if known.weights[t] > 0}
        self.long: dict[int, Postings] = {}
        self.sums = np.zeros(self.size, np.int64)

    def long_list(self, term: int) -> Postings:
        if term not in self.long:
            self.long[term] = Postings(*self.lists[term], self.size)
        return self.long[term]

    def accumulate(self, lists: list[tuple[np.ndarray, np.ndarray]]) -> Postings:
        """Short lists summed term at a time."""
        for places, parts in lists:
            self.sums[places] += parts
        touched = np.unique(np.concatenate([p for p, _ in lists]))
        out = Postings(touched, self.sums[touched], self.size)
        self.sums[touched] = 0
        return out

    def search(self, numbers: np.ndarray, best: Best) -> None:
        """Add this shard's best for a query's terms to ``best``."""
        own = [t for t in numbers.tolist() if t in self.lists]
        short = [self.lists[t] for t in own if len(self.lists[t][0]) <= SHORT * self.size]
        iterators = [self.long_list(t) for t in own if len(self.lists[t][0]) > SHORT * self.size]
        least = best.threshold
        if short:
            summed = self.accumulate(short)
            iterators.append(summed)
            if len(summed.parts) >= best.top:  # so many documents score that much at least
                least = max(least, int(np.partition(summed.parts, -best.top)[-best.top]))
        if not iterators:
            return
        bounds = np.stack([x.bounds for x in iterators])
        reach = bounds.sum(0)
        for k in range(bounds.shape[1]):
            least = max(least, best.threshold)
            if reach[k] >= least:
                self.window(k, iterators, bounds[:, k], least, best)

    def window(self, k: int, iterators: list[Postings], bounds: np.ndarray, least: int, best: Best) -> None:
        """Document at a time within window ``k``."""
        first = k * WINDOW
        order = np.argsort(bounds, kind="stable")
        upto = np.cumsum(bounds[order])
        # documents in these lists alone stay below the threshold
        idle = int(np.searchsorted(upto, least))
        score, hit = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for i in order[idle:]:
            places, parts = iterators[i].window(k)
            score[places - first] += parts
            hit[places - first] = True
        at = np.flatnonzero(hit)
        for j in range(idle - 1, -1, -1):
            at = at[score[at] + upto[j] >= least]
            if not len(at):
                return
            places, parts = iterators[order[j]].window(k)
            if len(places):
                spot = np.minimum(np.searchsorted(places, at + first), len(places) - 1)
                met = places[spot] == at + first
                score[at[met]] += parts[spot[met]]
        at = at[score[at] >= least]
        if len(at):
            best.add(score[at], self.doc[at + first], self.no_id[at + first])


def search_index(index: DataFrame, block: Block, known: Collection, top: int = TOP) -> DataFrame:
    """(query, score, doc_id): each task's best of each query of the block, by its number."""
    schema = T.StructType([T.StructField("query", T.IntegerType(), False), T.StructField("score", T.LongType(), False), T.StructField("doc_id", T.LongType())])
    asked = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], known)
                for numbers, own in zip(asked, best):
                    shard.search(numbers, own)
        sizes = [len(b.score) for b in best]
        if sum(sizes):
            ids = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.no_id for b in best]))
            columns = [pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32)), pa.array(np.concatenate([b.score for b in best])), ids]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "doc_id"])

    return index.mapInArrow(lean(run), schema)


def search(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``top`` documents of each of ``queries`` with a score above 0.

    ``docs`` has doc_id (long) and ``text``, ``queries`` ``query_id`` and ``text``. Queries go in blocks, each with one
    index over all documents; only a block's terms and the weights come to the driver.
    """
    spark = docs.sparkSession
    ranked = None
    for block in blocks(query_terms(queries, query_id, text)):
        index = materialize(build_index(docs, block.vocabulary, text), "lexical-index")
        known = collection(index, len(block.vocabulary))
        found = materialize(search_index(index, block, known, top), "lexical-found")
        discard(index)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField(query_id, queries.schema[query_id].dataType)]))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        # a block's ids are bounded as its pairs are
        part = found.withColumn("rank", place).where(F.col("rank") <= top).join(F.broadcast(names), "query")
        part = part.select(query_id, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        ranked = part if ranked is None else ranked.union(part)
    if ranked is None:
        return spark.createDataFrame([], T.StructType([queries.schema[query_id], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return ranked


def digest(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The query of the contract: every item of ``queries`` against all of ``docs``."""
    return search(docs, queries)


ORACLE = r"""
WITH fold AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM fold),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM w GROUP BY r),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM w GROUP BY r, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM d, c),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * docs) // words) AS m FROM n, c),
s AS (SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN v USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
