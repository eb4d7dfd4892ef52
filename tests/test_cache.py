"""Reuse of cached signals without an exchange of contents, rules and files that fail, counters and references."""

import json

import pytest
from pyspark.sql import functions as F

from idlens.functions import secrets as S
from idlens.functions.text import base_name
from idlens.operators import detect as D
from idlens.operators import identities as I
from idlens.operators import rules as R
from idlens.sources import artifacts as src
from idlens.sources import keyfilter
from tests.test_scan import art


def files(spark, n=400):
    """``n`` files, a content in two places, and one without content; content i's cache row follows from i."""
    k = F.col("id")
    rows = spark.range(n).select(F.lit("s1").alias("scan_id"), F.lit("r1").alias("repo"), F.concat(F.lit("d"), k, F.lit("/F"), (k % 2), F.lit(".txt")).alias("path"), F.concat(F.lit("text "), F.floor(k / 2) * 2).alias("content"))
    return src.complete(rows.unionByName(rows.where("path = 'd0/F0.txt'").withColumn("content", F.lit(None).cast("string"))))


def cache(a):
    """Two thirds of the keys: a third as clean signals, a third with a secret, which is not reused."""
    n = F.regexp_extract("path", r"d(\d+)", 1).cast("int")
    held = a.where((n % 3 < 2) & F.col("content").isNotNull())
    print_ = F.when(n % 3 == 1, F.lit("fp"))
    return held.select("content_sha", base_name().alias("name_key"), F.lit("v1").alias("version"), F.lit("old").alias("scan_id"), F.lit("old").alias("repo"), F.lit("old").alias("path"), F.lit("iac").alias("detector"), print_.alias("secret_fingerprint"), F.lit("rule").alias("rule_id"))


def number(path):
    return int(path[1:].split("/")[0])


@pytest.mark.parametrize("blocks", [1, 4096])
def test_each_file_is_reused_or_scanned(spark, blocks):
    """With room in the filter the two sides are exact; one that is full moves files to the scan, never to the cache."""
    a = files(spark, 400 if blocks > 1 else 12000)
    c = cache(a)
    misses, reused = src.split_cached(a, c.unionByName(c), "v1", blocks)
    scanned = [r.path for r in misses.where("content IS NOT NULL").select("path").collect()]
    given = {r.path for r in reused.select("path").collect()}
    clean = {p for p in (f"d{k}/F{k % 2}.txt" for k in range(400 if blocks > 1 else 12000)) if number(p) % 3 == 0}
    assert len(scanned) == len(set(scanned)) and not set(scanned) & given and given <= clean
    assert set(scanned) | given == {r.path for r in a.where("content IS NOT NULL").select("path").collect()}
    assert misses.where("content IS NULL").count() == 1 and misses.columns == a.columns
    if blocks > 1:
        assert given == clean


def test_no_content_is_exchanged(spark, capsys):
    a = files(spark)
    misses, reused = src.split_cached(a, cache(a), "v1")
    misses.explain()
    plan = capsys.readouterr().out
    final = plan[: plan.index("BroadcastExchange")]
    assert "Exchange" not in final and "SortMergeJoin" not in final  # the files' own branch has broadcast joins only


def test_other_versions_and_empty_caches(spark):
    a = files(spark, 20)
    for c in (cache(a).withColumn("version", F.lit("v0")), cache(a).where("false")):
        misses, reused = src.split_cached(a, c, "v1")
        assert misses.count() == 21 and reused.count() == 0
    misses, reused = src.split_cached(a.where("false"), cache(a), "v1")
    assert misses.count() == 0 and reused.count() == 0


def test_filters_hold_every_key(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    made = keyfilter.build(keys, ["a", "b"], 8)
    assert made.count() == 8 and made.where("length(_bits) <> 4096").count() == 0
    assert keyfilter.mark(keys, ["a", "b"], made, "in_it", 8).where("NOT in_it").count() == 0
    others = spark.range(5000, 25000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    wrong = keyfilter.mark(others, ["a", "b"], made, "in_it", 8).where("in_it").count()
    assert wrong < 20  # 625 keys a block, 4 bits each: about 3e-5 of the others
    nulls = others.withColumn("a", F.lit(None).cast("string"))
    assert keyfilter.mark(nulls, ["a", "b"], made, "in_it", 8).where("in_it").count() == 0


def test_a_bad_rule_costs_its_own_detector_only(spark):
    pack = json.dumps({"rules": [{"id": "ok", "pattern": "tok_[a-z0-9]{20}", "ai_risk_refs": ["own:1"]}, {"id": "loop", "pattern": "(a|a)*$"}, {"pattern": "x"}, {"id": "s", "type": "structural"}, {"id": "long", "pattern": "x" * 513}]})
    errors = {(r.rule, r.error) for r in src.rule_pack_errors(spark, pack).collect()}
    assert errors == {("loop", "unsafe or invalid pattern"), ("rule 3", "no id"), ("s", "no condition"), ("long", "pattern over 512 characters")}
    rules = src.load_rule_pack(pack)
    found = D.detect_custom_regex(art(spark, ("a/x.txt", "tok_a1b2c3d4e5f6g7h8i9j0")), S.key_table(spark, b"k"), rules)
    [row] = R.run_rules(I.normalize_signals(found), rules).where("rule_id = 'ok'").collect()
    assert row.ai_risk_refs == ["own:1"]


def test_errors_by_detector(spark):
    """A file that two detectors read as JSON fails for each; what the others find in it stands."""
    a = art(spark, ("x/package.json", "{"), ("x/.mcp.json", '{"a"'), ("b/.env", None))
    assert sorted((r.path, r.detector, r.error) for r in D.file_errors(a).collect()) == [("b/.env", "all", "no content"), ("x/.mcp.json", "mcp", "not JSON"), ("x/package.json", "package", "not JSON")]
