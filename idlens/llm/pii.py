"""Personal data by candidate gradient boosting.

Native: DataFrame functions and JVM models only. Strict patterns give the base spans. High-recall generators
propose further, overlapping spans of the same kinds; boosted trees judge each by its format and context, and
isotonic calibration on a part left out turns margins into chances.

There are no labels of personal data, so the trees learn from weak ones that are not the base rule:

* positive: a valid base match written in another format (other separators, no plus or at sign, accented letters), in
  its own context, so that its format no longer fits the strict pattern;
* negative: a match that fails its kind's check (Luhn, octets, digits), also in another format; a loose candidate
  that fails it, that is part of a longer word or number, that is of another kind, or that nothing in its text
  speaks for;
* the rest, loose candidates that pass the check and that something speaks for, are unknown. Only these are judged
  and may be added.

All labelled candidates of the table count, no sample of them: candidates alike in label and features become one
weighted row, which trees, calibration and threshold take as so many candidates.

A candidate is added if its calibrated chance reaches the threshold: the lowest one at which the part left out has
the wanted precision. Where there is none, nothing is added.

Null text counts as empty and has no spans. A text is scanned whole, whatever its length; the patterns take linear
time, placing matches the square of their number in a text (a quick copy each).
Repeated rows, and rows with a null or repeated id, are scanned each on its own. Ties: equal spans of one kind
count once. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Splits that the trees may try of a feature, at least; more where there are more kinds of candidate.
LEAST_BINS = 256
#: Least chance and least precision on the part left out of an added span.
THRESHOLD, PRECISION = 0.5, 0.95

# The base patterns. Look-behinds and possessive loops only spare hopeless starts inside a run; they find the
# same leftmost matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The generators: looser forms of the same kinds.
LOOSE = {
    "email": r"(?i)(?<![^\s@()\[\]])[^\s@()\[\]]++(?:@|\s?[\[(]at[\])]\s?)[^\s@()\[\]]++",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\[?\.\]?[0-9]{1,4}){2,5}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,22}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?[0-9(](?:[\x20().-]{0,2}[0-9]){6,16}+(?![0-9])",
}
#: A text without this sign holds no match.
NEEDS = {"email": "@", "phone": "+"}
#: Words that speak of personal data, looked for before a candidate.
CUES = r"(?i)(?<![a-z])(?:e-?mail|phone|telephone|tel|call|fax|card|account|visa|address|ip|contact|mobile|telefon|kontakt|konto|carte|tarjeta|correo)(?![a-z])[^\n]{0,16}$"
FEATURES = ("kind", "size", "digits", "alphas", "signs", "groups", "first_group", "last_group", "kinds_of_sign", "cue", "label_before", "joined_left", "joined_right", "ends_word")


def spans(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start, stop, found>> of the leftmost non-overlapping matches, in code points.

    Spark gives matches and the pieces between them; their lengths add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,stop:int,found:string>>"

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["found"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["found"].alias("found"))
        return F.struct(stop.alias("at"), F.array_append(acc["out"], one).cast(kind).alias("out"))

    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("found")))
    empty = F.array().cast(kind)
    placed = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), place, lambda acc: acc["out"])
    there = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    return F.when(there & (F.size(found) > 0), placed).otherwise(empty)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """True if the digits of ``s`` pass Luhn's test."""
    signs = F.reverse(F.split(digits(s), ""))
    doubled = F.transform(F.filter(signs, lambda x: x != ""), lambda x, i: x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        return ~F.exists(F.split(s, r"\."), lambda p: ~p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return luhn(s)
    if kind == "phone":
        return F.length(digits(s)).between(10, 15)
    return F.lit(True)


def fits(kind: str, s: Column) -> Column:
    """What a span of the kind must be in any format."""
    if kind == "email":
        return F.regexp_replace(s, r"(?i)\s?[\[(]at[\])]\s?", "@").rlike(r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)*\.\p{L}{2,}[.,;:!?]?$")
    if kind == "ip":
        bare = F.regexp_replace(s, r"[\[\]]", "")
        return bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") & valid("ip", bare)
    if kind == "card":
        return F.length(digits(s)).between(14, 19) & luhn(s)
    return F.length(digits(s)).between(10, 15)


def altered(kind: str, s: Column) -> Column:
    """A base match in a format that the strict pattern does not know; which one, its own hash says."""
    way = F.pmod(F.xxhash64(s, F.lit(23)), F.lit(3))
    if kind == "email":
        return F.when(way == 0, F.regexp_replace(s, "^(.)", "$1\u00e9")).when(way == 1, F.replace(s, F.lit("@"), F.lit(" (at) "))).otherwise(F.replace(s, F.lit("@"), F.lit("[at]")))
    if kind == "ip":
        return F.when(way == 0, F.replace(s, F.lit("."), F.lit("[.]"))).otherwise(F.regexp_replace(s, r"\.([0-9]+)$", "[.]$1"))
    if kind == "card":
        parts = F.regexp_extract_all(digits(s), F.lit("[0-9]{1,4}"), F.lit(0))
        return F.when(way == 0, F.array_join(parts, ".")).when(way == 1, F.array_join(parts, "/")).otherwise(F.array_join(parts, "."))
    bare = F.regexp_replace(s, r"^\+", "")
    return F.when(way == 0, F.concat(F.lit("00"), bare)).when(way == 1, bare).otherwise(F.regexp_replace(bare, r"[\x20().-]+", "."))


CANDIDATE = "array<struct<start:int,kind:int,stop:int,fit:boolean,cue:boolean,joined:boolean,f:struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">>>"


def described(text: Column, kind: str, found: Column, change: bool = False) -> Column:
    """Candidates with their features: format of the match, and what stands around it.

    ``change`` describes matches as they would stand there in another format.
    """

    def one(c: Column) -> Column:
        s = altered(kind, c["found"]) if change else c["found"]
        left = F.substring(text, F.greatest(F.lit(1), c["start"] - 31), F.least(F.lit(32), c["start"]))
        after = F.substring(text, c["stop"] + 1, F.lit(2))
        cue, joined_left, joined_right = left.rlike(CUES), left.rlike(r"[0-9A-Za-z_]$|[0-9A-Za-z][./+-]$"), after.rlike(r"^[0-9A-Za-z_]|^[./-][0-9A-Za-z]")
        values = {
            "kind": F.lit(KINDS.index(kind)),
            "size": F.length(s),
            "digits": F.length(digits(s)),
            "alphas": F.regexp_count(s, F.lit("[A-Za-z]")),
            "signs": F.regexp_count(s, F.lit(r"[^0-9\p{L}]")),
            "groups": F.regexp_count(s, F.lit("[0-9]+")),
            "first_group": F.length(F.regexp_extract(s, r"([0-9A-Za-z]+)", 1)),
            "last_group": F.length(F.regexp_extract(s, r"([0-9A-Za-z]+)[^0-9A-Za-z]*$", 1)),
            "kinds_of_sign": F.size(F.array_distinct(F.split(F.regexp_replace(s, r"[0-9\p{L}]", ""), ""))),
            "cue": cue,
            "label_before": left.rlike(r"[:=#]\s{0,2}$"),
            "joined_left": joined_left,
            "joined_right": joined_right,
            "ends_word": after.rlike(r"^[\s,;.)]|^$"),
        }
        f = F.struct(*(values[n].cast("double").alias(n) for n in FEATURES))
        fit = valid(kind, c["found"]) if change else fits(kind, s)
        return F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["stop"].alias("stop"), fit.alias("fit"), cue.alias("cue"), (joined_left | joined_right).alias("joined"), f.alias("f"))

    return F.transform(found, one).cast(CANDIDATE)


def scan(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """(row, doc_id, base, candidates, taught): one narrow pass over whole texts, written once as it is used thrice.

    ``taught`` has the matches of the base patterns in other formats, valid ones and failing ones. ``whole`` keeps the
    input rows beside them, packed as ``kept``.
    """
    kept = [F.struct("*").alias("kept")] if whole else []
    raw = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"), *kept)
    t = F.col("t")
    # matches are columns of their own, so that no expression repeats them
    raw = raw.select("*", *(spans(t, BASE[k], NEEDS.get(k)).alias(f"strict_{k}") for k in KINDS), *(spans(t, LOOSE[k]).alias(f"loose_{k}") for k in KINDS))

    def strict(kind: str) -> Column:
        kept = F.filter(f"strict_{kind}", lambda c: valid(kind, c["found"]))
        return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["stop"].alias("stop")))

    found = raw.select(
        "doc_id",
        F.array_sort(F.concat(*(strict(k) for k in KINDS))).alias("base"),
        F.concat(*(described(t, k, F.col(f"loose_{k}")) for k in KINDS)).alias("candidates"),
        F.concat(*(described(t, k, F.col(f"strict_{k}"), True) for k in KINDS)).alias("taught"),
        *(["kept"] if whole else []),
    )
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii")


def labelled(scanned: DataFrame) -> DataFrame:
    """(row, start, k, stop, label) and ``FEATURES``: the weak labels of the module's head; null for unknown candidates.

    Candidates that overlap a base span of their kind are left out: they are spans already.
    """
    shared = ["row", F.col("c.start").alias("start"), F.col("c.kind").alias("k"), F.col("c.stop").alias("stop")]
    features = [F.col(f"c.f.{f}").alias(f) for f in FEATURES]
    overlap = lambda b: (b["start"] < F.col("c.stop")) & (b["stop"] > F.col("c.start"))
    own = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & overlap(b))
    other = F.exists("base", lambda b: (b["kind"] != F.col("c.kind")) & overlap(b))
    spoken = F.col("c.cue") | F.exists("base", lambda b: b["kind"] == F.col("c.kind"))
    loose = scanned.where(F.size("candidates") > 0).select("row", "base", F.explode("candidates").alias("c")).where(~own)
    unlike = ~F.col("c.fit") | F.col("c.joined") | other | ~spoken
    loose = loose.select(*shared, F.when(unlike, 0.0).alias("label"), *features)
    taught = scanned.where(F.size("taught") > 0).select("row", F.explode("taught").alias("c"))
    return loose.union(taught.select(*shared, F.col("c.fit").cast("double").alias("label"), *features))


def lessons(rows: DataFrame) -> DataFrame:
    """(part, label, n) and ``FEATURES``: how many of the labelled candidates are alike, in each of three parts.

    The parts, by a hash of row and start: six tenths fit the trees (0), two calibrate (1), two set the threshold (2).
    """
    fold = F.pmod(F.xxhash64("row", "start", F.lit(22)), F.lit(10))
    part = F.when(fold < 6, 0).when(fold < 8, 1).otherwise(2).alias("part")
    return rows.where("label IS NOT NULL").groupBy(part, "label", *FEATURES).agg(F.count("*").cast("double").alias("n"))


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).drop(*FEATURES)


def threshold_of(judged: DataFrame) -> float | None:
    """The threshold from (label, prediction, n) rows left out of the fit: the lowest calibrated chance, at least
    ``THRESHOLD``, from which on the share of positives is ``PRECISION`` or more; None where there is none.

    Counts from the highest chance down are sums over steps of a thousandth, then over the chances within a step.
    """
    chances = judged.where(F.col("prediction") >= THRESHOLD).groupBy("prediction").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    chances = chances.withColumn("step", F.floor(F.col("prediction") * 1000))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    # at most 501 steps, whatever the table
    steps = chances.groupBy("step").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    steps = steps.select("step", *(F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("good", "n")))
    within = Window.partitionBy("step").orderBy(F.desc("prediction"))
    upto = [(F.col(f"{c}_above") + F.sum(c).over(within)).alias(c) for c in ("good", "n")]
    return chances.join(F.broadcast(steps), "step").select("prediction", *upto).where(F.col("good") >= PRECISION * F.col("n")).agg(F.min("prediction")).first()[0]


def added(scanned: DataFrame) -> DataFrame | None:
    """(row, more): spans of the unknown candidates the trees select; None where they cannot learn or gain nothing."""
    rows = labelled(scanned)
    known = materialize(vectors(lessons(rows)), "pii-lessons")
    parts = [known.where(F.col("part") == i) for i in range(3)]
    if len(parts[0].select("label").distinct().collect()) < 2 or not parts[1].head(1):
        return None
    # with so many bins Spark looks at every row for the splits, not at a sample of the rows
    bins = max(LEAST_BINS, math.isqrt(parts[0].count()) + 1)
    trees = GBTClassifier(weightCol="n", maxIter=15, maxDepth=4, maxBins=bins, stepSize=0.3, seed=13).fit(parts[0])
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    # equal margins meet first, as the regression would have them meet in the driver
    margins = trees.transform(parts[1]).select("label", "n", margin).groupBy("margin").agg((F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("label"), F.sum("n").alias("n"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="n").fit(margins)
    level = threshold_of(calibration.transform(trees.transform(parts[2]).select("label", "n", margin)))
    if level is None:
        return None
    scored = calibration.transform(trees.transform(vectors(rows.where("label IS NULL"))).select("row", "start", "k", "stop", margin))
    good = scored.where(F.col("prediction") >= level)
    return good.groupBy("row").agg(F.collect_set(F.struct("start", F.col("k").alias("kind"), "stop")).alias("more"))


def find(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, kind, stop>, sorted; kind is a place in ``KINDS``. ``whole``
    adds the input rows, packed as ``kept``."""
    scanned = scan(docs, text, whole)
    more = added(scanned)
    kept = ["kept"] if whole else []
    if more is None:
        return scanned.select("doc_id", "base", F.col("base").alias("spans"), *kept)
    merged = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.array_union("base", "more")))
    return scanned.join(more, "row", "left").select("doc_id", "base", merged.alias("spans"), *kept)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``find`` in ``text`` replaced by its kind in brackets, overlapping ones merged.

    One row for each row, whatever its id: rows without an id and rows that repeat one are each redacted by their own
    spans. Null and empty texts stay as they are, very long ones are redacted whole, other columns pass through
    whatever their names, and an empty table gives no rows. Of overlapping spans the first one names the cut.
    """
    found = find(docs, text, whole=True)
    names, own = F.array(*map(F.lit, KINDS)), F.col("kept").getField(text)

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))
    return found.select(*(F.when(F.size("spans") > 0, done).otherwise(own).alias(c) if c == text else F.col("kept").getField(c).alias(c) for c in docs.columns))


def written(spans_: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The query of the contract."""

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
