"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (plain and de-obfuscated words), how near its words
stand to the second person, capitals, punctuation and obfuscation rates. The lexicon, the trees and the
calibration are learned from separate parts of one bounded sample of labelled documents.

Null text counts as empty; an empty or blank text has zero features and is scored like any other. Long texts are read
whole. Every row is scored on its own, so rows that repeat get equal scores, and rows with a null id are scored too.
A score of exactly 0.5 counts as toxic. An empty table gives no rows, and without labels of both kinds every score is
the share of toxic labels (0 without any). Other columns are not read, so their names never clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.bpe import text_blocks, with_column
from idlens.llm.common import hash_fraction, held_out, lean, materialize, text_batches
from idlens.llm.unicode_tables import code_points, letters

#: About how many labelled documents everything is learned from, at most.
SAMPLE_ROWS = 20_000
#: Entries of the lexicon at most; least positive documents and log odds of an entry.
LEXICON, LEAST_DOCS, LEAST_ODDS = 400, 3, 2.5
#: Words around a lexicon word in which the second person counts as near.
NEAR = 5
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes vosotros".split())
#: Signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][0-9@$!|*._-]+[^\W\d_][^\s]*")
_NAMES = ["density", "hits", "masked_density", "weight", "strongest", "near", "capitals", "shouting", "exclaims", "punctuation", "masked", "words"]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features in the order of ``_NAMES``; all zero for an empty text."""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    odds = [lexicon[words[i]] for i in hits]
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    masked = _MASKED.findall(low)
    plain = [re.sub(r"[^\w]|[\d_]", "", m.translate(LEET)) for m in masked]
    found = sum(p in lexicon for p in plain)
    alpha, upper, _ = letters()
    cp = code_points(text)
    n_alpha = int(alpha[cp].sum())
    n_upper = int(upper[cp].sum())
    shouting = sum(map(str.isupper, _WORD.findall(text))) if n_upper * 4 > n_alpha else 0
    size = max(1, len(text))
    signs = int(((cp < 128) & (cp > 32) & ~alpha[cp]).sum())
    return [len(hits) / n, log1p(len(hits)), found / n, sum(odds) / n, max(odds, default=0.0), near / max(1, len(hits)), n_upper / max(1, n_alpha), shouting / n, text.count("!") / size, signs / size, len(masked) / n, log1p(len(words))]


def feature_column(lexicon: dict[str, float], text: F.Column) -> F.Column:
    """array<double>: features of each row's whole text (null: empty). Only texts cross to Python, features come back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = np.array([features(t.as_py() or "", lexicon) for t in batch], np.float64)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * len(_NAMES)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    return F.arrow_udf(lean(run), T.ArrayType(T.DoubleType()))(text)


def learn_lexicon(rows: DataFrame, text: str = "text") -> dict[str, float]:
    """Words by log odds of toxic to other documents, at most ``LEXICON`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, text):
            count = {0: Counter(), 1: Counter()}
            for y, t in zip(batch.column("label").to_pylist(), texts):
                count[int(y)].update({"", *_WORD.findall(t.lower())})  # "" counts documents
            words = list(count[0] | count[1])
            columns = [pa.array(words, pa.string()), *(pa.array([count[y][w] for w in words], pa.int64()) for y in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "pos", "neg"])

    sums = text_batches(rows.select("label", text)).mapInArrow(lean(run), "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = materialize(sums.where(f"pos >= {LEAST_DOCS} OR word = ''"), "lexicon")
    whole = sums.where("word = ''").first()
    if not whole:
        return {}
    odds = F.log((F.col("pos") + 0.5) / (whole.pos + 1)) - F.log((F.col("neg") + 0.5) / (whole.neg + 1))
    top = sums.where("word <> ''").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r.word: r.odds for r in top.orderBy(F.desc(F.col("pos") * F.col("odds")), "word").limit(LEXICON).collect()}


class ToxicityModel:
    """A fitted lexicon, trees and calibration; without both labels to learn from, a constant."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, prior: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
        """Learn from labelled documents that are not held out, about ``sample_rows`` of them by hash of id.

        Half of the sample gives the lexicon, three tenths the trees, the rest the calibration. Labels of one id
        that differ count as toxic; null labels teach nothing.
        """
        known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
        total = known.count()
        if not total:
            return cls({})
        part = hash_fraction("doc_id", sample_rows / total)
        fold = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(10))
        rows = docs.select("doc_id", text).where(part).join(known.where(part), "doc_id").withColumn("fold", fold)
        lexicon = learn_lexicon(rows.where("fold < 5"), text)
        fit = text_batches(rows.where("fold >= 5")).select("label", "fold", feature_column(lexicon, F.col(text)).alias("features"))
        fit = materialize(fit, "features")
        fit = fit.coalesce(4).withColumn("features", array_to_vector("features")).cache()
        counts = {r.label: r.n for r in fit.where("fold < 8").groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            prior = counts.get(1.0, 0) / max(1, sum(counts.values()))
            return cls(lexicon, prior=prior)
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=11, featuresCol="features", labelCol="label").fit(fit.where("fold < 8"))
        margin = trees.transform(fit.where("fold >= 8")).select("label", cls._margin().alias("margin"))
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin) if margin.head(1) else None
        fit.unpersist()
        return cls(lexicon, trees, calibration)

    @staticmethod
    def _margin():
        return vector_to_array("rawPrediction")[1]

    def score(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """(``key``, score): the calibrated chance that the whole text is toxic; one narrow pass over ``docs``."""
        if self.trees is None:
            return docs.select(key, F.lit(float(self.prior)).alias("score"))
        rows = text_batches(docs).select(key, array_to_vector(feature_column(self.lexicon, F.col(text))).alias("features"))
        scored = self.trees.transform(rows).select(key, self._margin().alias("margin"))
        if self.calibration is None:
            return scored.select(key, (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))
        return self.calibration.transform(scored).select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = ToxicityModel.fit(docs, labels, text).score(docs, text)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept, whatever their names.

    One narrow pass in which only texts go to Python and only features come back.
    """
    model = ToxicityModel.fit(docs, labels, text)
    packed = docs.select(F.struct("*").alias("_row"))
    return model.score(packed, f"_row.{text}", "_row").where("score < 0.5").select("_row.*")
