"""What correlations relate, as rows."""

import json

import pytest
from pyspark.sql import functions as F

from idlens.operators import correlate as C
from idlens.operators import detect as D
from idlens.operators import identities as I
from idlens.operators import reports as A
from idlens.operators import rules as R
from idlens.plans import synthetic
from idlens.plans.scan import identities_of
from tests.conftest import SF


def hot(spark):
    """Every identity in one repository."""
    return synthetic.identities(spark, SF).withColumn("repo", F.lit("hot")).withColumn("ord", F.col("ord").cast(synthetic.PLACE))


def test_links_of_a_hot_repository(spark):
    """Each identity that a correlation counts has a row, and none stands in a list that grows with the repository."""
    base = hot(spark)
    rows = base.select("id", "identity_type", "production_access", "admin_access", "approval_required", "permissions").collect()
    made = C.correlate(base)
    assert max(len(r.related_identities) for r in made.select("related_identities").collect()) == 2
    links = C.related_links(base.unionByName(made)).collect()
    open_ = {r.id for r in rows if r.production_access and not r.approval_required and r.identity_type in ("ci_runner", "deployment_identity") and (r.admin_access or "deployment" in r.permissions)}
    got = [r for r in links if r.rule_id == "nhi_ci_deployment_without_approval"]
    assert open_ and {r.related_id for r in got} == open_ and len(got) == len(open_) and {r.n_related for r in got} == {len(open_)}
    target = [r for r in links if r.rule_id == "nhi_shared_target_exposure"]
    assert len({r.id for r in target}) == 1 and len(target) == target[0].n_related == len({r.related_id for r in target}) > 100
    pairs = [r for r in links if r.rule_id == "nhi_history_secret_still_current"]
    assert all(r.n_related == 2 for r in pairs) and {r.id for r in links} <= {r.id for r in made.select("id").collect()}


def test_no_list_of_ids_in_the_plan(spark, capsys):
    C.correlate_repo_flags(hot(spark)).explain()
    C.correlate_shared_target_exposure(hot(spark)).explain()
    C.related_links(hot(spark)).explain()
    plan = capsys.readouterr().out
    assert "collect_set(id" not in plan and "collect_list(id" not in plan and "collect_set(CASE WHEN" in plan


def test_links_in_documents(spark, monkeypatch):
    """Documents hold every link once, in as many parts as it takes."""
    monkeypatch.setattr(A, "PART_ROWS", 50)
    base = hot(spark)
    both = base.unionByName(C.correlate(base))
    links = C.related_links(both)
    docs = [json.loads(r.json) for r in A.scan_json(both, R.run_rules(both), C.risk_paths(both), links).collect()]
    told = [(x["id"], x["related_id"]) for d in docs for x in d.get("related", [])]
    assert sorted(told) == sorted((r.id, r.related_id) for r in links.collect()) and max(len(d.get("related", [])) for d in docs) < len(told) / 2


def test_no_correlations_no_links(spark):
    base = hot(spark)
    assert C.related_links(base).count() == 0 and C.related_links(base.where("false")).count() == 0


def test_history_correlations_of_one_place(spark):
    """Two secrets of one file, name and commit, both still current, are two correlations, each with its own pair."""
    one = hot(spark).limit(1).withColumns({"name": F.lit("token"), "file_path": F.lit("a.env"), "commit_short_sha": F.lit("abcdef0")})
    cases = [(f"{when}{n}", f"fp{n}", sha) for n in (1, 2) for when, sha in (("old", "abcdef0123"), ("now", None))]
    case = spark.createDataFrame(cases, "id string, secret_fingerprint string, commit_sha string")
    base = one.drop("id", "secret_fingerprint", "commit_sha").crossJoin(case).select(*one.columns).withColumn("ord", F.struct(*(F.col("id").alias("evidence") if c == "evidence" else F.col(f"ord.{c}") for c in I.ORDER)).cast(synthetic.PLACE))
    made = I.dedupe_identities(C.correlate_history_secret_still_current(base)).collect()
    assert sorted(tuple(r.related_identities) for r in made) == [("old1", "now1"), ("old2", "now2")]


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_scan_starts_from_rows(spark, tmp_path, capsys):
    """Correlations read written identities, not what makes them anew; a summary goes through the findings once."""
    base = hot(spark)
    R.run_rules(base).write.parquet(str(tmp_path / "rows-f"))
    found = spark.read.parquet(str(tmp_path / "rows-f"))
    assert plan_of(R.scan_summary(base, found), capsys).count("rows-f") == 1
    signals = spark.createDataFrame([], "scan_id string, repo string, path string, line_no int, detector string, rule_id string, " + ", ".join(f"{c} {k}" for c, k in D.FACTS.items() if c != "explicit_confidence") + ", evidence string, secret_fingerprint string, masked_secret string, confidence string, " + ", ".join(f"{c} string" for c in D.HISTORY))
    assert "_n#" in plan_of(I.dedupe_signals(signals), capsys) and "_n#" not in plan_of(identities_of(signals), capsys)


def test_documents_are_dealt_before_they_are_gathered(spark, monkeypatch, capsys):
    """A task holds few documents whatever the shuffle's partitions, and documents are put together from texts of rows; no
    row of a document is left out, and a raw value in one still fails the job."""
    monkeypatch.setattr(A, "PART_ROWS", 100)
    base = hot(spark)
    docs = A.scan_json(base, R.run_rules(base), C.risk_paths(base))
    plan = plan_of(docs, capsys)
    assert "FullOuter" not in plan and f", {-(-base.count() // 100)}), REPARTITION_BY_NUM" in plan
    read = [json.loads(r.json) for r in docs.collect()]
    assert sorted(x["id"] for d in read for x in d.get("identities", [])) == sorted(r.id for r in base.select("id").collect())
    assert all(v for d in read for v in d.values() if isinstance(v, list)) and {tuple(d)[:3] for d in read} == {("scan_id", "repo", "part")}
    with pytest.raises(Exception, match="raw secret"):
        A.scan_json(base.withColumn("name", F.lit("FAKE_SECRET_DO_NOT_USE")), R.run_rules(base), C.risk_paths(base)).collect()
