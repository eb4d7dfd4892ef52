"""Detection and the tail of a scan on small fixtures."""

import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from idlens.functions import secrets as S
from idlens.functions.catalog import rule_rows
from idlens.operators import baseline as B
from idlens.operators import correlate as C
from idlens.operators import detect as D
from idlens.operators import identities as I
from idlens.operators import reports as P
from idlens.operators import rules as R
from idlens.operators.specs import ALL
from idlens.plans import corpus, queries, synthetic
from idlens.sources import artifacts as A
from idlens.sources import store

from .conftest import SF

HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def art(spark, *files):
    rows = [("s1", "r1", p, c) for p, c in files]
    return A.complete(spark.createDataFrame(rows, "scan_id string, repo string, path string, content string"))


def rules_of(df):
    return sorted((r.rule_id, r.line_no) for r in df.select("rule_id", "line_no").collect())


def test_every_spec_is_in_the_catalog():
    assert {f"nhi_{s.rule}" for s in ALL} <= {r[0] for r in rule_rows()} and len(rule_rows()) == 152


def test_env_files(spark):
    keys = S.key_table(spark, b"k")
    a = art(spark, ("svc/.env", f"# c\nexport PAY_TOKEN=q7Zx81LmPw02RtVb # x\nDATABASE_URL=postgres://u:p4ss@h/d\nREDIS_URL=redis://h\nOPENAI_API_KEY={HEX}prod"), ("svc/.env.example", "PAY_TOKEN=q7Zx81LmPw02RtVb"), ("a/empty.env", ""), ("b/.env", None))
    got = D.detect_env_secrets(a, keys).collect()
    assert sorted((r.path, r.line_no, r.rule_id[4:], r.confidence) for r in got) == [
        ("svc/.env", 2, "plaintext_env_secret", "medium"), ("svc/.env", 3, "database_url_with_credentials", "medium"), ("svc/.env", 5, "ai_provider_key_detected", "high"),
        ("svc/.env", 5, "production_ai_key_in_env", "high"), ("svc/.env.example", 1, "plaintext_env_secret", "low"),
    ]
    assert not any("q7Zx81LmPw02RtVb" in str(r) or HEX in str(r) for r in got)


def test_config_placeholder_suppressed(spark):
    a = art(spark, ("a/s.toml", '[db]\npassword = "k39fjw02mcnq81xz"\ntoken = "your-password-here"'), ("x.json", json.dumps({"a": {"api_key": HEX}})))
    assert rules_of(D.detect_credential_assignments(a, S.key_table(spark, b"k"))) == [("nhi_hardcoded_secret", 1), ("nhi_hardcoded_secret", 2)]


def test_workflow(spark):
    text = f"permissions: write-all\non: pull_request_target\njobs:\n  x:\n    steps:\n      - uses: acme/ship@v2\n      - uses: acme/ok@{HEX}\n      - run: |\n          echo ${{{{ github.head_ref }}}}\n      - name: ${{{{ github.head_ref }}}}\n"
    got = rules_of(D.detect_family(art(spark, (".github/workflows/ship.yml", text)), "ci", S.key_table(spark, b"k")))
    assert got == [("nhi_github_actions_expression_injection", 9), ("nhi_github_actions_unpinned_action", 6), ("nhi_github_actions_write_all", 1)]


def test_netrc_pypirc_bicep(spark):
    a = art(spark, ("h/.netrc", f"machine m.example\n login bob\n password {HEX}"), ("h/.pypirc", f"[pypi]\nusername = u\npassword = {HEX}"), ("i/m.bicep", "@secure()\nparam adminPassword string\n\nparam dbPassword string\n"))
    got = {r.rule_id: (r.name, r.line_no) for r in D.detect_windowed(a, S.key_table(spark, b"k")).collect()}
    assert got == {"nhi_netrc_credential": ("m.example:bob", 3), "nhi_pypi_token_in_pypirc": ("[pypi] password", 3), "nhi_bicep_param_missing_secure_decorator": ("dbPassword", 4)}


def test_documents_and_state(spark):
    keys = S.key_table(spark, b"k")
    manifest = json.dumps({"name": "x", "permissions": ["tabs", "<all_urls>"], "background": {"service_worker": "b.js"}})
    a = art(spark, ("e/manifest.json", manifest), ("p/package.json", json.dumps({"scripts": {"deploy": "curl https://x | sh"}})), ("renovate.json", '{"automerge": true, // c\n}'), ("oauth.json", '{"scope": "repo chat:write"}'), ("t/a.tfstate", json.dumps({"resources": [{"type": "aws_db", "instances": [{"password": HEX}]}]})))
    assert {r.rule_id[4:] for r in D.detect_documents(a, keys).collect()} == {"browser_extension_risky_permissions", "browser_extension_broad_host_background", "environment_isolation_failure", "npm_script_remote_execution", "renovate_bot_identity", "renovate_automerge_enabled", "broad_oauth_scope"}
    assert [(r.rule_id[4:], r.provider) for r in D.detect_nested_secrets(a, keys).collect()] == [("terraform_state_plaintext_secret", "aws")]


def test_deep_state_secrets(spark):
    """A secret at level 12 of a Terraform state, below its resource's type."""
    value = {"client_secret": HEX}
    for k in range(7):
        value = {f"k{k}": value}
    a = art(spark, ("t/a.tfstate", json.dumps({"resources": [{"type": "google_container_cluster", "instances": [{"attributes": value}]}]})))
    assert [(r.rule_id[4:], r.provider, r.name.count(".")) for r in D.detect_nested_secrets(a, S.key_table(spark, b"k")).collect()] == [("terraform_state_plaintext_secret", "google", 10)]


def test_state_names(spark):
    """Every attribute name that the reference lists for Terraform state; CDK context keeps the names of any secret."""
    names = "secret password passwd private_key client_secret primary_access_key api_key token auth_key encrypted_password session_token ssh_key tls_key certificate_pem".split()
    values = json.dumps({n: HEX for n in [*names, "location"]})
    got = D.detect_nested_secrets(art(spark, ("t/a.tfstate", values), ("cdk.json", json.dumps({"primary_access_key": HEX, "token": HEX}))), S.key_table(spark, b"k")).collect()
    assert sorted(r.name for r in got if r.path == "t/a.tfstate") == sorted(names) and [r.name for r in got if r.path == "cdk.json"] == ["token"]


def test_renovate_json5_by_lines(spark):
    """JSON5 with unquoted keys is read a line at a time; a variable is no token, nor is one outside host rules."""
    one = f"{{automerge: true, hostRules: [{{token: '{HEX}'}}]}}"
    more = f"{{\n  automerge: false,\n  hostRules: [\n    {{token: '$TOKEN'}},\n    {{matchHost: 'x', token: \"{HEX}\"}},\n  ],\n}}"
    a = art(spark, ("renovate.json5", one), ("x/renovate.json5", more), ("y/.renovaterc", f"{{token: '{HEX}'}}"))
    got = D.detect_documents(a, S.key_table(spark, b"k")).collect()
    assert sorted((r.path, r.rule_id[13:], r.line_no) for r in got) == [
        ("renovate.json5", "automerge_enabled", 1), ("renovate.json5", "bot_identity", 1), ("renovate.json5", "host_rules_plaintext_token", 1),
        ("x/renovate.json5", "bot_identity", 1), ("x/renovate.json5", "host_rules_plaintext_token", 5), ("y/.renovaterc", "bot_identity", 1),
    ]
    assert HEX not in str(got)


def test_ignore_rules(spark):
    a = art(spark, ("a/b.md", "x"), ("keep.md", "x"), ("build/deep/x.py", "x"), ("src/build.py", "x"), ("a/q/z.tf", "x"))
    rules = spark.createDataFrame([("r1", 1, "*.md"), ("r1", 2, "!keep.md"), ("r1", 3, "build/"), ("r1", 4, "a/**/z.tf")], "repo string, ord int, pattern string")
    assert sorted(r.path for r in A.apply_ignore_rules(a, rules).collect()) == ["keep.md", "src/build.py"]


def test_history_remaps_lines(spark):
    keys = S.key_table(spark, b"k")
    patch = f"0123456789abcdef\t0123456\tAnn\ta@x\t2024-05-01\ts\ndiff\n--- a/c.toml\n+++ b/c.toml\n@@ -6,0 +7,2 @@\n+x = 1\n+password = \"{HEX}\"\n"
    lines = A.added_lines(spark.createDataFrame([("r1", 1, patch)], "repo string, patch_id long, patch_text string"))
    got = A.scan_history(lines, lambda a: D.detect_credential_assignments(a, keys)).collect()
    assert [(r.line_no, r.commit_short_sha, "git_history" in r.tags) for r in got] == [(8, "0123456", True)]


def test_incremental_equals_full(spark):
    keys = S.key_table(spark, b"k")
    a = art(spark, ("x/Dockerfile", "RUN curl https://x | sh"), ("y/Dockerfile", "ADD https://x /x"))
    full = D.detect_family(a, "iac", keys)
    cached = full.join(a.select("path", "content_sha"), "path").where("path = 'x/Dockerfile'").withColumn("name_key", F.lit("dockerfile")).withColumn("version", F.lit("1"))
    again = A.incremental_scan(a, cached, "1", lambda m: D.detect_family(m, "iac", keys))
    assert rules_of(again) == rules_of(full) and A.split_cached(a, cached, "1")[0].count() == 1


def test_rule_pack():
    pack = {"rules": [{"id": "ok", "pattern": "abc"}, {"pattern": "x"}, {"id": "b", "severity": "x", "pattern": "x"}, {"id": "c", "pattern": "(a+)+$"}, {"id": "d", "type": "structural"}, {"id": "e", "pattern": "("}]}
    assert [r["id"] for r in A.load_rule_pack(json.dumps(pack))] == ["ok"]
    with pytest.raises(ValueError):
        A.load_rule_pack('{"rules": []}')


def test_structural_rules(spark):
    i = synthetic.identities(spark, SF)
    found = R.run_rules(i, [{"id": "mine", "type": "structural", "severity": "critical", "when": {"has_secret": True, "tools_contains_any": ["SHE"]}}]).where("rule_id = 'mine'")
    assert found.count() == i.where("has_secret AND size(tools) > 0").count() > 0


def test_owners(spark):
    i = synthetic.identities(spark, SF).limit(20)
    blame = i.select("repo", F.col("file_path").alias("path"), F.col("line_number").alias("line"), F.lit("a@x").alias("email"), F.lit("A").alias("name"), F.lit(1714521600).cast("long").alias("ts")).distinct()
    rules = i.select("repo").distinct().select("repo", F.lit(1).alias("ord"), F.lit("*").alias("pattern"), F.lit("@t").alias("owners"))
    got = I.enrich_owners(i, blame, rules).collect()
    assert {r.owner for r in got} <= {"a@x (last modified 2024-05); @t via CODEOWNERS", "team@example.org", None} and any("CODEOWNERS" in (r.owner or "") for r in got)


def test_baseline_dates(spark):
    rows = [("a", None, False), ("b", "2999-01-01", False), ("c", "2000-01-01", False), ("d", "soon", False), ("e", "2999-01-01", True), ("f", None, True)]
    b = spark.createDataFrame(rows, "key string, accepted_until string, review_required boolean")
    assert sorted(r.key for r in B.active_baseline(b).collect()) == ["a", "b", "f"]


def test_host_surface_skips_governance(spark):
    i = synthetic.identities(spark, SF)
    host = {r.r for r in C.correlate(i, surface="host").select(F.col("ord.rule_id").alias("r")).collect()}
    assert not host & {"nhi_orphaned_identity_cluster", "nhi_ci_deployment_without_approval", "nhi_production_without_approval_gate"}


def test_empty_tables(spark):
    i = synthetic.identities(spark, SF).limit(0)
    assert R.run_rules(i).count() == C.risk_paths(i).count() == 0


@pytest.mark.parametrize("name", ["findings", "correlations", "risk_paths", "trend_history", "identity_scores", "added_lines", "flattened_json", "fingerprints", "severity_counts"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "supplier", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    theirs = con.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, theirs))


def test_files_that_cannot_be_read(spark):
    """A broken state file and a file without content lower the trust in their scan; comments alone do not."""
    a = art(spark, ("t/a.tfstate", '{"x": '), ("b/.env", None), ("renovate.json", "{// c\n}"), ("p/package.json", '{"a": 1,}'), ("q/package.json", ""), ("n/notes.json", "{"))
    errors = D.file_errors(a)
    assert sorted((r.path, r.error) for r in errors.collect()) == [("b/.env", "no content"), ("t/a.tfstate", "not JSON")]
    i = synthetic.identities(spark, SF).where("repo = 'repo_1'").withColumn("repo", F.lit("r1"))
    f = R.run_rules(i)
    [row] = R.scan_summary(i, f, errors).collect()
    assert (row.trust_level, row.policy, row.n_errors) == ("degraded", "block" if row.n_critical else "manual_review", 2)
    scans = R.scan_summary(i.limit(0), f.limit(0), errors, errors.select("scan_id", "repo"))
    said = "The scan did not end, so nothing it says can be relied on; it blocks until one ends."
    assert [(r.trust_level, r.policy, r.summary, r.overall_score) for r in scans.collect()] == [("untrusted", "block", said, 100)]
    assert [r.gate for r in R.gate_status(f.limit(0).withColumn("baseline_status", F.lit("new")), scans).collect()] == [10]


def test_one_pass_finds_all(spark):
    """The gate loses nothing: each detector over all artifacts says what the whole detection says of it."""
    keys = S.key_table(spark, b"k")
    a = corpus.artifacts(spark, SF).where("pmod(hash(path), 8) = 0")
    said = lambda df: sorted(map(str, df.select("path", "rule_id", "line_no", "name", "evidence", "secret_fingerprint", "masked_secret", "confidence", "tags").collect()))
    each = [D.detect_family(a, f, keys) for f in D.FAMILIES] + [f(a, keys) for f in (D.detect_env_secrets, D.detect_credential_assignments, D.detect_nested_secrets, D.detect_windowed, D.detect_documents, D.detect_mcp, D.detect_ai_agents)]
    whole = D.detect_all(a, keys)
    assert said(whole) == sorted(x for df in each for x in said(df)) and whole._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 16


def test_folder_store_and_documents(spark, tmp_path):
    """A folder is read with its line ends and bytes made clean; a scan is stored, read, listed, replaced and cleared."""
    (tmp_path / "repo/sub").mkdir(parents=True)
    (tmp_path / "repo/sub/x.env").write_bytes(b"A=1\r\nPAY_TOKEN=" + HEX.encode() + b"\rB=\xff2\n")
    (tmp_path / "repo/big.txt").write_bytes(b"x" * (A.MAX_BYTES + 1))
    got = A.read_artifacts(spark, str(tmp_path / "repo"), "r1").collect()
    assert [(r.path, r.content) for r in got] == [("sub/x.env", f"A=1\nPAY_TOKEN={HEX}\nB=\ufffd2\n")]
    (tmp_path / "repo/sub/x.env").rename(tmp_path / "repo/sub/.env")
    (tmp_path / "packed").mkdir()
    for kind in ("zip", "gztar"):
        shutil.make_archive(str(tmp_path / f"packed/{kind}"), kind, tmp_path / "repo")
    packed = A.read_archives(spark, str(tmp_path / "packed")).collect()
    assert sorted((r.repo, r.path, r.content) for r in packed) == [(k, "sub/.env", got[0].content) for k in ("gztar", "zip")]
    made = A.artifacts_from_table(spark.createDataFrame([("d", "p", b"x\r\ny")], "r string, p string, c binary"), F.col("r"), F.col("p"), F.col("c")).collect()
    assert [(r.repo, r.path, r.content, r.n_bytes) for r in made] == [("d", "p", "x\ny", 3)]
    i = synthetic.identities(spark, SF).drop("ord")
    f, root = R.run_rules(synthetic.identities(spark, SF)), str(tmp_path / "store")
    scans = i.select("scan_id", "repo").distinct().withColumn("completed_at", F.lit("2024"))
    for _ in range(2):
        store.write_scan(root, {"findings": f, "scans": scans})
    assert store.findings_of(spark, root, "s1").count() == f.count() and store.latest_scans(store.read_table(spark, root, "scans")).count() == 40
    with pytest.raises(ValueError):
        store.write_scan(root, {"scans": scans}, trust="untrusted")
    assert store.clear(spark, root) == ["scans", "findings"] and store.clear(spark, root) == []


def test_documents_in_parts(spark, monkeypatch):
    """More findings than a document should hold make several valid ones, which hold each finding once."""
    monkeypatch.setattr(P, "PART_ROWS", 20)
    i = synthetic.identities(spark, SF).where("repo IN ('repo_1', 'repo_2')")
    f = R.run_rules(i)
    made = [json.loads(r.sarif) for r in P.sarif(f).collect()]
    results = [r for d in made for r in d["runs"][0]["results"]]
    assert len(made) > 4 and len(results) == f.count() and all({r["ruleId"] for r in d["runs"][0]["results"]} == {r["id"] for r in d["runs"][0]["tool"]["driver"]["rules"]} for d in made)
    docs = [json.loads(r.json) for r in P.scan_json(i, f, C.risk_paths(i)).collect()]
    assert sum(len(d.get("findings", [])) for d in docs) == f.count() and sum(len(d.get("identities", [])) for d in docs) == i.count()


def test_rare_correlations(spark):
    """Rules that the synthetic rows never raise: untrusted deployment, build sink, shadow admin, unguarded env file."""
    base = synthetic.identities(spark, SF).where("repo = 'repo_1'").limit(4)
    none = F.array().cast("array<string>")
    tag = lambda *w: F.array(*map(F.lit, w))
    one = base.limit(1).withColumns({"permissions": none, "tags": none, "has_secret": F.lit(False), "admin_access": F.lit(False), "production_access": F.lit(False)})
    ci = one.withColumns({"tags": tag("ci_cd"), "admin_access": F.lit(True), "production_access": F.lit(True), "id": F.lit("a")})
    action = one.withColumns({"tags": tag("third_party", "unpinned"), "id": F.lit("b")})
    host = one.withColumns({"tags": tag("docker", "host_access"), "has_secret": F.lit(True), "file_path": F.lit("x/.env"), "id": F.lit("c")})
    rules = {r.r for r in C.correlate(ci.unionByName(action).unionByName(host), art(spark, ("README.md", "x"))).select(F.col("ord.rule_id").alias("r")).collect()}
    assert {f"nhi_{r}" for r in ("untrusted_ci_deploy_path", "build_pipeline_secret_sink", "shadow_admin_path", "secret_file_not_gitignored")} <= rules


def test_stream_equals_batch(spark, tmp_path):
    from idlens.streaming.stream import scan_stream

    rows = art(spark, ("svc/.env", f"PAY_TOKEN={HEX}")).withColumn("arrived_at", F.current_timestamp())
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    seen = []

    def detect(df, key):
        return {"signals": D.detect_env_secrets(df, S.key_table(spark, key))}

    q = scan_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda t, n: seen.extend(rules_of(t["signals"])), str(tmp_path / "cp"), b"k", run=detect)
    q.processAllAvailable()
    q.stop()
    assert seen == rules_of(detect(rows, b"k")["signals"])


def test_detection_writes_and_shuffles_no_raw_value(spark, tmp_path):
    """A scan leaves no planted value in the shared folder, and its detection is one stage: nothing raw is exchanged."""
    import os

    from idlens.functions import secrets as S
    from idlens.operators import detect as D
    from idlens.plans.scan import scan
    from idlens.sources import artifacts as src
    from idlens.sources.store import shared_dir

    value = "zq7Rk2Lm9Xw4Tv8Bn3Hs6Pd1"
    files = [
        ("a/.env", f"PAY_TOKEN={value}\n"), ("a/config.json", '{"api_key": "' + value + '"}'), ("ci/.gitlab-ci.yml", f"variables:\n  DEPLOY_TOKEN: {value}\n"),
        ("h/.netrc", f"machine m\n login u\n password {value}\n"), ("k/d.yaml", f"apiVersion: v1\nenv:\n  - name: DB_PASSWORD\n    value: {value}\n"),
        ("m/mcp.json", '{"mcpServers": {"x": {"url": "https://h.example/s", "headers": {"Authorization": "Bearer ' + value + '"}}}}'),
    ]
    rows = spark.createDataFrame([("r", p, c) for p, c in files], "repo string, path string, content string")
    artifacts = src.artifacts_from_table(rows, F.col("repo"), F.col("path"), F.col("content"))
    keys = S.key_table(spark, b"k")
    signals = D.detect_all(artifacts, keys)
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "Repartition" not in plan
    assert signals.count() >= len(files)
    tables = scan(artifacts, b"k")
    assert tables["findings"].count() > 0
    for folder, _, names in os.walk(shared_dir(spark).removeprefix("file:")):
        for name in names:
            with open(os.path.join(folder, name), "rb") as f:
                assert value.encode() not in f.read(), (folder, name)


def test_block_flags_equal_a_plain_walk(spark):
    """Random indented texts: the lines that stand in blocks, by a walk over the lines."""
    import random
    import re

    from idlens.functions import text as X

    def walk(lines):
        out, head = set(), None
        for n, s in enumerate(lines, 1):
            bare = re.sub(r"#.*$", "", s)
            if re.search(r"^\s*(?:-\s+)?run\s*:", s):
                head = len(re.match(r"^( *(?:- +)?)", bare)[1])
            elif head is not None:
                if bare.strip(" ") and len(re.match(r"^( *)", s)[1]) <= head:
                    head = None
                else:
                    out.add(n)
        return out

    rnd = random.Random(5)
    parts = ["run: x", "- run: |", "echo", "# note", "", "key: v  # run: no", "- item"]
    texts = ["\n".join(" " * rnd.choice([0, 2, 4, 6]) + rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(200)]
    d = spark.createDataFrame([("s", "r", str(i), t) for i, t in enumerate(texts)], "scan_id string, repo string, path string, content string")
    got = {}
    for r in X.in_block(d, r"^\s*(?:-\s+)?run\s*:").where("inside").collect():
        got.setdefault(int(r.path), set()).add(r.line_no)
    assert all(got.get(i, set()) == walk(t.split("\n")) for i, t in enumerate(texts))


def test_anchor_words_stand_in_every_match(spark):
    """Each spec's words, where it tells some, stand in what it finds in the planted corpus."""
    import re

    from idlens.functions import anchors
    from idlens.operators.specs import ALL
    from idlens.plans import corpus

    texts = [r.content for r in corpus.artifacts(spark, "/root/testdata/sf0.001").select("content").limit(200).collect()]
    told = 0
    for s in ALL:
        words = anchors.words(s.match)
        for t in texts if words else ():
            for m in re.finditer(s.match, t, re.MULTILINE):
                told += 1
                assert any(w in m[0].lower() for w in words), (s.match, m[0])
    assert told > 100 and anchors.words(r"(?i)gh[pousr]_\w+") == ("ghp_", "gho_", "ghu_", "ghs_", "ghr_") and anchors.words(r"\w+") is None


def test_corpus_of_one_small_file_is_many_tasks(spark, monkeypatch):
    """Keys of a corpus stand in a row group that one task reads; the files made of them are dealt to several."""
    monkeypatch.setattr(corpus, "TASK_FILES", 100)
    files = corpus.artifacts(spark, SF)
    n = files.count()
    assert files.rdd.getNumPartitions() == -(-n // 100) > 1 and files.select("path").distinct().count() == n


def test_files_tell_which_specs_can_match(spark):
    """Words of a spec tell the files it is put to; lines of others are not opened, and what is found stays the same."""
    part = D.spec_part([s for s in ALL if s.family == "ai"])
    rows = D.file_columns(corpus.artifacts(spark, SF)).withColumn("low_text", F.lower("content")).withColumns(part.early)
    for layer in part.layers:
        rows = rows.withColumns({c: F.when(part.gate, v) for c, v in layer.items()})
    opened = rows.where(F.coalesce(part.gate & part.opens, F.lit(False)))
    assert 0 < opened.count() < rows.count() / 4
    assert opened.where("path LIKE 'docs/%' OR path LIKE 'k8s/%'").count() == 0


def test_conditions_on_texts_are_put_once(spark):
    """Conditions that look for several words anywhere begin at a text's start only, so that a long text with none of them
    takes a search, not one from each of its places."""
    asked = {s.also for s in ALL if s.also and "(?=" in s.also}
    assert len(asked) == 2
    began = time.time()
    for also in asked:
        for text, want in (("x " * 30_000, False), ("customer of chroma: load( http ) " + "x " * 1000, True), ("\n\nhttp\n\nload(\ntenant\nfaiss", True)):
            assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(also)).head()[0] is want
    assert time.time() - began < 20
