"""A whole scan: artifacts to identities, findings, risk paths and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from idlens.functions.secrets import key_table
from idlens.operators.correlate import correlate, related_links, risk_paths
from idlens.operators.detect import detect_all, file_errors
from idlens.operators.identities import dedupe_identities, dedupe_signals, enrich_owners, normalize_signals
from idlens.operators.rules import run_rules, scan_summary
from idlens.sources.store import staged


def identities_of(signals: DataFrame, artifacts: DataFrame | None = None, surface: str = "repo") -> DataFrame:
    """Identities of deduplicated signals and the correlations between them. Identities are written to the shared folder
    before they are correlated, as correlations read them a dozen times."""
    base = staged(dedupe_identities(normalize_signals(dedupe_signals(signals))), "base")
    return base.unionByName(dedupe_identities(correlate(base, artifacts, surface)))


def scan(artifacts: DataFrame, key: bytes | None = None, custom: list[dict] | None = None, blame: DataFrame | None = None, codeowners: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a scan: signals, identities, related, findings, risk_paths, errors, scans. The first two are written to the
    shared folder here, so that later stages start from rows."""
    signals = staged(detect_all(artifacts, key_table(artifacts.sparkSession, key), custom), "signals")
    identities = staged(identities_of(signals, artifacts), "identities")
    if blame is not None and codeowners is not None:
        identities = enrich_owners(identities, blame, codeowners)
    findings = run_rules(identities, custom)
    errors = file_errors(artifacts)
    scans = scan_summary(identities, findings, errors)
    return {"signals": signals, "identities": identities, "related": related_links(identities), "findings": findings, "risk_paths": risk_paths(identities), "errors": errors, "scans": scans}
