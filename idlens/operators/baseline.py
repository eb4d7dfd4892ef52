"""Baselines and trends of findings, by keys that line moves do not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlens.functions import secrets as S
from idlens.operators.identities import SCAN
from idlens.sources.store import write_tables


def baseline_key() -> Column:
    """Of rule, path and evidence; of rule, path, name and title where there is no evidence."""
    text = F.concat_ws(" ", F.filter(F.transform("evidence", lambda e: F.lower(F.trim(e))), lambda e: e != ""))
    path = F.coalesce("file_path", F.lit(""))
    bare = S.stable_id("base", "rule_id", path, F.coalesce("identity_name", F.lit("")), "title")
    return F.when(text != "", S.stable_id("base", "rule_id", path, text)).otherwise(bare)


def write_baseline(findings: DataFrame, trust: str = "clean", keep: tuple[str, ...] = ()) -> DataFrame:
    """Accepted-finding entries; of an untrusted scan they are refused, as its findings say nothing."""
    if trust == "untrusted":
        raise ValueError("an untrusted scan gives no baseline")
    return findings.select(
        *keep, baseline_key().alias("key"), "rule_id", "file_path", "line_number", "identity_name", "title", "severity",
        F.lit(None).cast("string").alias("accepted_by"), F.lit(None).cast("string").alias("accepted_until"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("review_required"),
    )


def save_baseline(root: str, findings: DataFrame, scans: DataFrame) -> None:
    """Write the baselines of ``scans`` (repo, trust_level) to the store below ``root``, replacing those of the same
    repositories, also where no finding is left. Repositories with an untrusted scan keep the baseline they have."""
    sound = scans.groupBy("repo").agg(F.bool_or(F.col("trust_level") == "untrusted").alias("bad")).where("NOT bad").select("repo")
    entries = write_baseline(findings.join(sound, "repo", "left_semi"), keep=("repo",))
    write_tables(root, {"baseline": entries, "baselined": sound}, by=("repo",))


def active_baseline(baseline: DataFrame, today: Column | None = None) -> DataFrame:
    """Keys that still hold: the date is not over or unreadable, and no review is due under a date."""
    until = F.nullif("accepted_until", F.lit(""))
    valid = until.isNull() | F.coalesce(F.try_to_date(until, "yyyy-MM-dd") >= (F.current_date() if today is None else today), F.lit(False))
    review = F.coalesce("review_required", F.lit(False)) & until.isNotNull()
    return baseline.where(F.col("key").isNotNull() & valid & ~review).select("key").distinct()


def apply_baseline(findings: DataFrame, active: DataFrame) -> DataFrame:
    """Findings with baseline_key and baseline_status (new or known)."""
    keyed = findings.withColumn("baseline_key", baseline_key())
    marked = active.select(F.col("key").alias("baseline_key"), F.lit(True).alias("_known"))
    return keyed.join(marked, "baseline_key", "left").withColumn("baseline_status", F.when(F.col("_known"), "known").otherwise("new")).drop("_known")


def previous_scan(scans: DataFrame) -> DataFrame:
    """Every scan with the one before it in its repository."""
    w = Window.partitionBy("repo").orderBy("completed_at", "scan_id")
    return scans.select("repo", "scan_id", "completed_at", F.lag("scan_id").over(w).alias("previous_scan_id"))


def trend(current: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, key, status): new, resolved or unchanged, by a full outer join of distinct keys.

    Both sides have ``keys`` and ``key``.
    """
    a = current.select(*keys, "key").distinct().withColumn("now", F.lit(True))
    b = prior.select(*keys, "key").distinct().withColumn("was", F.lit(True))
    j = a.join(b, [*keys, "key"], "full_outer")
    return j.select(*keys, "key", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged").alias("status"))


def trend_history(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """(repo, scan_id, previous_scan_id, n_new, n_resolved, n_unchanged) of every scan that has one before it."""
    pairs = previous_scan(scans).where("previous_scan_id IS NOT NULL").select("repo", "scan_id", "previous_scan_id")
    keyed = findings.select("repo", "scan_id", "key").distinct()
    now = keyed.join(pairs, ["repo", "scan_id"]).select("repo", "scan_id", "previous_scan_id", "key")
    was = keyed.withColumnRenamed("scan_id", "previous_scan_id").join(pairs, ["repo", "previous_scan_id"]).select("repo", "scan_id", "previous_scan_id", "key")
    t = trend(now, was, ["repo", "scan_id", "previous_scan_id"])
    counts = t.groupBy("repo", "scan_id", "previous_scan_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "resolved", "unchanged")))
    return pairs.join(counts, ["repo", "scan_id", "previous_scan_id"], "left").fillna(0)
