"""Signals to identities, and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlens.functions import globs
from idlens.functions import secrets as S
from idlens.functions.catalog import IDENTITY_TYPES, TYPE_ALIASES
from idlens.functions.text import FILE, explode_lines

SCAN = ["scan_id", "repo"]
ORDER = ["path", "detector", "line_no", "rule_id", "name", "evidence"]


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """The first signal of each rule, place, name and evidence within a scan."""
    key = [*FILE, "rule_id", "line_no", "name", "evidence"]
    return signals.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("detector", "confidence"))).where("_n = 1").drop("_n")


def canonical_identity_type(c: Column) -> Column:
    """Lower case, aliases resolved; anything else becomes a slug."""
    low = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit("non_human_identity"))), "[-/]", "_"), r"\s+", " "))
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = {k.replace("/", "_"): v for k, v in TYPE_ALIASES.items()}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.when(low.isin(IDENTITY_TYPES), low).otherwise(F.coalesce(F.try_element_at(table, low), F.try_element_at(table, slug), F.nullif(slug, F.lit("")), F.lit("non_human_identity")))


def normalize_bool(c: Column, default: bool | None = False) -> Column:
    """Words and numbers as booleans; what is neither takes the default."""
    t = F.lower(F.trim(c.cast("string")))
    known = F.when(t.isin("true", "yes", "y", "on", "1", "enabled", "required"), True).when(t.isin("false", "no", "n", "off", "0", "disabled", "none", ""), False)
    return F.coalesce(known, F.try_to_number(t, F.lit("999999999999")).cast("double") != 0, F.lit(default))


def normalize_string_list(c: Column) -> Column:
    """A JSON list, or text parted by commas, semicolons, newlines or else blanks; trimmed, redacted, first-seen distinct."""
    t = F.trim(c)
    parsed = F.when(t.rlike(r"(?s)^\[.*\]$"), F.from_json(t, "array<string>"))
    parts = F.split(t, r"[,;\n]+|\s{2,}")
    parts = F.when((F.size(parts) == 1) & t.contains(" ") & ~t.rlike(r":\\|/|\\"), F.split(t, r"\s+")).otherwise(parts)
    clean = F.transform(F.coalesce(parsed, parts), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    return F.coalesce(F.array_distinct(S.redact_items(F.filter(clean, lambda x: x != ""))), F.array().cast("array<string>"))


def normalize_signals(signals: DataFrame) -> DataFrame:
    """One projection from signal to identity, whose place is a redacted path."""
    signals = S.redact_path(signals, "path", "path")
    tags = F.array_sort(F.array_distinct(F.concat(F.array("rule_id"), "tags")))
    has_secret = F.col("secret_fingerprint").isNotNull() | F.array_contains(tags, "plaintext_secret")
    sha = F.when(F.col("commit_sha").rlike("^[0-9a-fA-F]{7,64}$"), F.col("commit_sha"))
    evidence = F.array("evidence")
    return signals.select(
        *SCAN,
        S.stable_id("nhi", "scan_id", "repo", "path", "line_no", "rule_id", "name", "evidence").alias("id"),
        "name",
        canonical_identity_type(F.col("identity_type")).alias("identity_type"),
        "source", F.col("path").alias("file_path"), F.col("line_no").alias("line_number"), "provider",
        F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("expires_at"),
        "secret_fingerprint", "masked_secret", has_secret.alias("has_secret"),
        F.when(has_secret, "missing").alias("rotation_status"),
        "permissions", "scopes", "tools", F.col("tools").alias("tool_permissions"), "data_classes",
        "admin_access", "production_access", "external_access", "approval_required", "logging_enabled", "data_access_level",
        "ai_risk_refs", "ai_attack_class", "attack_chain_stage", "confidence", tags.alias("tags"), F.array_compact(evidence).alias("evidence"),
        F.array().cast("array<string>").alias("related_identities"),
        sha.alias("commit_sha"), "commit_short_sha", "commit_author", "commit_date",
        F.struct(*ORDER).alias("ord"),
    )


def dedupe_identities(identities: DataFrame) -> DataFrame:
    """One row an id within a scan: the last content at the first position."""
    rest = [c for c in identities.columns if c not in (*SCAN, "id", "ord")]
    kept = identities.groupBy(*SCAN, "id").agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord"))
    return kept.select(*SCAN, "id", "r.*", "ord")


def identity_inventory(identities: DataFrame) -> DataFrame:
    """Counts by repository, type and provider."""
    return identities.groupBy("repo", "identity_type", "provider").agg(F.count("*").alias("n"), F.count_if("has_secret").alias("n_secret"))


# Where a CODEOWNERS file may stand, best first.
CODEOWNERS = [".github/codeowners", ".gitlab/codeowners", "docs/codeowners", "codeowners"]


def parse_codeowners(artifacts: DataFrame) -> DataFrame:
    """(repo, ord, pattern, owners) of each repository's first CODEOWNERS file."""
    rank = F.array_position(F.array(*map(F.lit, CODEOWNERS)), F.lower("path"))
    best = artifacts.where(rank > 0).groupBy(*SCAN).agg(F.min_by(F.struct("path", "content"), rank).alias("f")).select(*SCAN, "f.*")
    words = F.split(F.trim(F.regexp_replace("line", r"(?:^|\s)#.*$", "")), r"\s+")
    lines = explode_lines(best).withColumn("w", words).where(F.size("w") >= 2)
    return lines.select("repo", F.col("line_no").alias("ord"), F.col("w")[0].alias("pattern"), F.array_join(F.slice("w", F.lit(2), F.size("w")), " ").alias("owners"))


def owner_regex(pattern: Column) -> Column:
    """A pattern as a regex: here ``*`` does cross ``/``; a folder covers what is below it."""
    anchored = F.startswith(pattern, F.lit("/"))
    body = F.regexp_replace(F.regexp_replace(pattern, "^/", ""), r"([.+^$(){}|\[\]\\])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("**"), F.lit("*")), F.lit("*"), F.lit(".*"))
    body = F.replace(body, F.lit("?"), F.lit("."))
    tail = F.when(F.endswith(pattern, F.lit("/")), F.lit(".*")).otherwise(F.lit("(?:/.*)?"))
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), body, tail, F.lit("$"))


def match_codeowners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, owners): the last matching rule of the path's repository, met by repository and anchor."""
    pattern = F.col("pattern")
    anchor = globs.any_name_anchor(F.regexp_replace(pattern, "^/", ""), F.startswith(pattern, F.lit("/")))
    rx = rules.select("repo", "ord", "owners", anchor.alias("anchor"), owner_regex(pattern).alias("rx"))
    hit = globs.matches(paths.select("repo", "path").distinct(), rx, "path", globs.any_name_keys(F.col("path")))
    return hit.groupBy("repo", "path").agg(F.max_by("owners", "ord").alias("owners"))


def blame_owner(identities: DataFrame, blame: DataFrame) -> DataFrame:
    """Identities with the author of their line."""
    b = blame.select("repo", F.col("path").alias("file_path"), F.col("line").alias("line_number"), "email", "ts")
    return identities.join(b, ["repo", "file_path", "line_number"], "left")


def enrich_owners(identities: DataFrame, blame: DataFrame, rules: DataFrame) -> DataFrame:
    """Fills ``owner`` of working-tree rows that have none: last author and month, then the team by CODEOWNERS."""
    teams = match_codeowners(identities.select("repo", F.col("file_path").alias("path")), rules).withColumnRenamed("path", "file_path")
    rows = blame_owner(identities, blame).join(teams, ["repo", "file_path"], "left")
    author = F.when(F.col("email").isNotNull(), F.concat("email", F.lit(" (last modified "), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM"), F.lit(")")))
    team = F.when(F.col("owners").isNotNull(), F.concat("owners", F.lit(" via CODEOWNERS")))
    found = F.nullif(F.concat_ws("; ", author, team), F.lit(""))
    open_ = F.col("owner").isNull() & F.col("commit_sha").isNull() & F.col("file_path").isNotNull() & F.col("line_number").isNotNull()
    return rows.withColumn("owner", F.when(open_, found).otherwise(F.col("owner"))).select(*identities.columns)
