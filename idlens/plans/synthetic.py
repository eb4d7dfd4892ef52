"""Identities, scans and baselines derived from the orders table, for the relational operators.

``BASE_SQL`` says the same in ANSI SQL, so that another engine can start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column, expression. The expressions read the same in Spark and in other engines.
COLUMNS = [
    ("scan_id", "'s1'"),
    ("repo", "concat('repo_', cast(o_custkey % 40 AS varchar(12)))"),
    ("id", "concat('i', cast(o_orderkey AS varchar(12)))"),
    ("name", "concat('n', cast(o_orderkey % 977 AS varchar(12)))"),
    ("kind", "cast(o_orderkey % 8 AS int)"),
    ("source", "concat('src', cast(o_orderkey % 5 AS varchar(12)))"),
    ("file_path", "concat('f/', cast(o_orderkey % 97 AS varchar(12)), '.env')"),
    ("line_number", "cast(o_orderkey % 50 AS int)"),
    ("provider", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('p', cast(o_orderkey % 7 AS varchar(12))) END"),
    ("has_secret", "o_orderkey % 3 = 0"),
    ("secret_fingerprint", "CASE WHEN o_orderkey % 3 = 0 THEN concat('fp', cast(o_orderkey % 601 AS varchar(12))) END"),
    ("admin_access", "o_orderkey % 11 = 0"),
    ("production_access", "o_orderkey % 6 = 0"),
    ("external_access", "o_orderkey % 10 = 0"),
    ("approval_required", "CASE WHEN o_orderkey % 9 = 0 THEN true WHEN o_orderkey % 9 < 4 THEN false END"),
    ("logging_enabled", "CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 13 < 5 THEN false END"),
    ("data_access_level", "CASE o_orderkey % 14 WHEN 0 THEN 'customer' WHEN 1 THEN 'session' ELSE 'unknown' END"),
    ("confidence", "CASE WHEN o_orderkey % 17 = 0 THEN 'low' ELSE 'medium' END"),
    ("owner", "CASE WHEN o_orderkey % 12 = 0 THEN 'team@example.org' END"),
    ("deploys", "o_orderkey % 15 = 0"),
    ("commit_sha", "CASE WHEN o_orderkey % 21 = 0 THEN 'abcdef0123' END"),
]
BASE_SQL = "SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS) + " FROM orders"

#: The type of ``ord`` in identities of signals and correlations.
PLACE = "struct<path: string, detector: string, line_no: int, rule_id: string, name: string, evidence: string>"

TYPES = ["ai_agent", "mcp_server", "model_gateway", "ci_runner", "service_account", "api_key", "deployment_identity", "webhook_identity"]


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.selectExpr("o_orderkey", *(f"{e} AS {c}" for c, e in COLUMNS))
    none = F.array().cast("array<string>")
    pick = lambda cond, *w: F.when(cond, F.array(*map(F.lit, w))).otherwise(none)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.col("kind") + 1)
    tags = F.concat(
        pick(F.col("kind") == 0, "ai_agent"), pick(F.col("kind") == 1, "mcp"), pick(F.col("kind").isin(3, 6), "ci_cd"),
        pick(F.col("has_secret"), "nhi_hardcoded_secret"), pick(F.col("admin_access"), "nhi_overprivileged_nhi"), pick(F.expr("o_orderkey % 30 = 0"), "untrusted_context"),
    )
    out = base.select(
        "scan_id", "repo", "id", "name", kind.alias("identity_type"), "source", "file_path", "line_number", "provider", "owner", F.lit(None).cast("string").alias("expires_at"),
        "secret_fingerprint", F.lit(None).cast("string").alias("masked_secret"), "has_secret", F.when(F.col("has_secret"), "missing").alias("rotation_status"),
        pick(F.col("deploys"), "deployment").alias("permissions"), none.alias("scopes"), pick(F.col("kind").isin(0, 1), "shell").alias("tools"), pick(F.col("kind").isin(0, 1), "shell").alias("tool_permissions"), none.alias("data_classes"),
        "admin_access", "production_access", "external_access", "approval_required", "logging_enabled", "data_access_level",
        none.alias("ai_risk_refs"), F.lit(None).cast("string").alias("ai_attack_class"), F.lit(None).cast("string").alias("attack_chain_stage"), "confidence", tags.alias("tags"), F.array(F.concat(F.lit("evidence "), "name")).alias("evidence"), none.alias("related_identities"),
        "commit_sha", F.left("commit_sha", F.lit(7)).alias("commit_short_sha"), F.lit(None).cast("string").alias("commit_author"), F.lit(None).cast("string").alias("commit_date"),
        F.struct(F.col("file_path").alias("path"), F.lit("synthetic").alias("detector"), "line_number", F.lit("r").alias("rule_id"), "name", F.col("id").alias("evidence")).alias("ord"),
    )
    return out


def scan_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(findings: repo, scan_id, key; scans: repo, scan_id, completed_at): monthly scans of part-keyed findings."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat('repo_', cast(l_suppkey % 20 AS varchar(12))) AS repo", "date_format(l_shipdate, 'yyyy-MM') AS scan_id", "cast(l_partkey % 60 AS string) AS key")
    findings = rows.distinct()
    return findings, findings.select("repo", "scan_id", F.col("scan_id").alias("completed_at")).distinct()
