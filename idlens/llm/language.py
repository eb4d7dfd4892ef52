"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile lists the most frequent 1- to 3-grams of a language's words (padded by blanks), most frequent first.
A document's own list is compared with each: every n-gram adds the difference of its ranks, or the list's
length if the profile lacks it; the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.bpe import text_blocks, with_column
from idlens.llm.common import hash_fraction, held_out, lean, text_batches
from idlens.llm.unicode_tables import code_points, letters

#: Entries of a profile, and of a document's list.
PROFILE = 300
#: About how many labelled documents each language's profile is learned from, at most.
SAMPLE_ROWS = 5_000
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of a whole text: 21 bits a character, 0 for the blank around words."""
    alpha, _, lower = letters()
    cp = code_points(text)
    c = np.zeros(len(cp) + 2, np.int64)
    c[1:-1] = lower[cp]
    if not c.any():
        return np.empty(0, np.int64)
    c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]
    if c[-1]:
        c = np.append(c, 0)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] > 0]
    # marks of length keep the three kinds apart where blanks lead
    return np.concatenate([c[c > 0], two | 1 << 62, three | -(1 << 63)])


def ranked(codes: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The ``n`` most frequent codes, ties by code."""
    kinds, count = np.unique(codes, return_counts=True)
    return kinds[np.argsort(-count, kind="stable")[:n]]


def learn(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, list[int]]:
    """Profiles by language, from documents that are not held out and have a language.

    The sample is by a hash of doc_id, about ``sample_rows`` documents of each language, so that a rare one is learned
    too; counts are summed by Spark and only the profiles, 300 entries a language, reach the driver. Texts with a null
    language or id teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    totals = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return {}
    # one row a language, as many as there are profiles
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, sample_rows / n)) for lang, n in totals.items()], T.StructType([docs.schema["lang"], T.StructField("_share", T.DoubleType())]))
    rows = known.select("doc_id", "lang", text).join(F.broadcast(share), "lang").where(hash_fraction("doc_id", F.col("_share"))).select("lang", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, text):
            by: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), texts):
                by.setdefault(lang, []).append(grams(t))
            for lang, parts in by.items():
                kinds, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    if not out:
        out = {r.lang: [] for r in known.select("lang").distinct().orderBy("lang").collect()}
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score). Score: the second-best distance's share of the two best (0.5 to 1).

    ``und`` with score 0 for null texts, texts without letters, and if nothing was learned; ties go to the
    first language by code point. One narrow pass.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        ranks = np.full((len(langs), len(known)), -1, np.int64)
        for i, lang in enumerate(langs):
            ranks[i, np.searchsorted(known, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))
        for batch, texts in text_blocks(batches, text):
            names, scores = [], []
            for t in texts:
                own = ranked(codes) if len(codes := grams(t)) else ()
                if not len(own) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                r = ranks[:, at] if len(known) else np.full((len(langs), len(own)), -1)
                there = (r >= 0) & (known[at] == own if len(known) else False)
                d = np.where(there, np.abs(r - np.arange(len(own))), PROFILE).sum(1)
                best = int(d.argmin())
                second = int(np.delete(d, best).min()) if len(langs) > 1 else PROFILE * len(own)
                names.append(langs[best])
                scores.append(second / (second + int(d[best])) if second else 0.5)
            yield with_column(batch.select(["doc_id"]), ("lang_pred", pa.array(names, pa.string())), ("score", pa.array(scores, pa.float64())))

    return text_batches(docs.select("doc_id", text)).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the labelled documents and predict all: (doc_id, held_out, lang_pred, score).

    One row for each row: rows that repeat an id or lack one are predicted each by its own text, very long texts whole.
    Other columns are not read, so their names never clash; an empty table gives no rows.
    """
    return predict(docs, learn(docs, text, sample_rows), text).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
