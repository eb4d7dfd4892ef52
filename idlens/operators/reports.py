"""Report aggregates, the detection scorecard, and JSON and SARIF documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlens.functions import secrets as S
from idlens.operators.identities import SCAN


def owasp_counts(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("owasp_nhi_refs").alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


def ai_ref_counts(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("ai_risk_refs").alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


def top_themes(findings: DataFrame, n: int = 5) -> DataFrame:
    """The most common categories of a repository; of equal ones first the one seen first in the findings' order."""
    first = F.min(F.struct(-F.col("risk_score"), "rule_id", "file_path", "category"))
    counts = findings.groupBy("repo", "category").agg(F.count("*").alias("n"), first.alias("first"))
    r = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "first"))
    counts = counts.withColumn("rank", r.cast("long")).drop("first")
    return counts.where(F.col("rank") <= n)


def blast_radius(identities: DataFrame) -> DataFrame:
    """What a repository's identities reach."""
    level = lambda v: F.bool_or(F.col("data_access_level") == v)
    return identities.groupBy(*SCAN).agg(
        F.bool_or("has_secret").alias("secrets"), F.bool_or("admin_access").alias("admin"), F.bool_or("production_access").alias("production"),
        F.bool_or("external_access").alias("external"), level("customer").alias("customer_data"), level("source-code").alias("source_code"),
        F.bool_or(F.size("tools") > 0).alias("tools"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").pivot("severity", ["critical", "high", "medium", "low"]).agg(F.count(F.lit(1))).fillna(0)


def detection_scorecard(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, cases, hit): planted cases found, and placebos that fired; labels are (case_id, repo, path, rule_id, kind)."""
    f = findings.select("repo", F.col("file_path").alias("path"), "rule_id").distinct().withColumn("hit", F.lit(1))
    j = labels.join(f, ["repo", "path", "rule_id"], "left")
    return j.groupBy("kind").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct(F.when(F.col("hit") == 1, F.col("case_id"))).alias("hit"))


def missed_cases(findings: DataFrame, labels: DataFrame) -> DataFrame:
    f = findings.select("repo", F.col("file_path").alias("path"), "rule_id").distinct()
    return labels.where("kind = 'planted'").join(f, ["repo", "path", "rule_id"], "left_anti")


#: Rows of a list in one part of a document, about.
PART_ROWS = 10_000


def in_parts(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``part``: its rows dealt by a hash of ``key`` to as many parts as their number asks for, by scan and
    repository, so that no document holds a hot repository whole."""
    parts = df.groupBy(*SCAN).agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    return df.join(parts, SCAN).withColumn("part", F.pmod(F.xxhash64(key), "_parts").cast("int")).drop("_parts")


def sarif(findings: DataFrame) -> DataFrame:
    """(scan_id, repo, part, sarif): SARIF 2.1.0 documents, one a scan and repository, or several valid ones where there
    are more findings than one should hold."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    uri = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), "^/+", "")
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        level.alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.coalesce("line_number", F.lit(1))).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"),
    )
    rule = F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.format_string("%.1f", F.col("risk_score") / 10).alias("security-severity")).alias("properties"))
    keys, rows = [*SCAN, "part"], in_parts(findings, "id")
    rules = rows.groupBy(*keys, "rule_id").agg(F.min_by(rule, "id").alias("r")).groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("rules"))
    results = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("idlens").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    made = rules.join(results, keys).select(*keys, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
    return S.guard_no_raw_secret(made)


def scan_json(identities: DataFrame, findings: DataFrame, paths: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(scan_id, repo, part, json): a whole scan as one document, or as several where a list is longer than one should
    hold; a part lacks the lists that have no rows in it. ``related`` (of ``related_links``) is dealt to parts by the
    related identity, so what a correlation relates may stand in several."""
    keys = [*SCAN, "part"]
    named = [("identities", identities, "id"), ("findings", findings, "id"), ("risk_paths", paths, "id")]
    if related is not None:
        named.append(("related", related, "related_id"))

    def items(n: int, df: DataFrame, key: str) -> DataFrame:
        """A list's rows, each written and checked by itself, so that no document is parsed or written whole."""
        item = F.to_json(F.struct(*[c for c in df.columns if c not in (*SCAN, "ord")]))
        rows = in_parts(df.select(*SCAN, F.col(key).alias("key"), item.alias("item")), "key")
        return S.guard_no_raw_secret(rows.select(*keys, F.lit(n).alias("list"), "item"))

    # dealt by document before they are gathered: a task holds a few documents, however large the partitions of a
    # shuffle are, and documents are put together from their rows' texts
    tasks = -(-identities.count() // PART_ROWS) or 1
    rows = reduce(DataFrame.union, (items(n, df, key) for n, (_, df, key) in enumerate(named))).repartition(tasks, *keys)
    docs = rows.groupBy(*keys).agg(*(F.collect_list(F.when(F.col("list") == n, F.col("item"))).alias(name) for n, (name, _, _) in enumerate(named)))
    head = F.regexp_replace(F.to_json(F.struct(*keys)), r"\}$", "")
    lists = [F.when(F.size(name) > 0, F.concat(F.lit(f',"{name}":['), F.array_join(name, ","), F.lit("]"))).otherwise("") for name, _, _ in named]
    return docs.select(*keys, F.concat(head, *lists, F.lit("}")).alias("json"))
