"""Folders, archives, glob indexes, history bounds, rule packs and scans that fail."""

import json
import os
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from idlens.operators import identities as I
from idlens.operators import rules as R
from idlens.sources import artifacts as src
from idlens.sources import folders, patterns

TREE = {
    "r1/.env": "A=1",
    "r1/.github/workflows/x.yml": "a: b",
    "r1/node_modules/x/index.js": "no",
    "r1/sub/.git/config": "no",
    "r2/a/b/c/.npmrc": "z\r\ny",
    "r2/_under.txt": "u",
    "r2/big.txt": "x" * (src.MAX_BYTES + 1),
    "r2/empty.txt": "",
    "r2/bad.txt": b"ok \xff end",
    "top.txt": "t",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())
    os.symlink(root / "r1", root / "r3")
    os.symlink(root / "top.txt", root / "r2" / "link.txt")
    return str(root)


def test_folder_source_keeps_hidden_names_and_follows_no_links(spark, tree):
    got = {(r.repo, r.path): r.content for r in src.read_artifacts(spark, tree).collect()}
    assert got == {
        ("r1", ".env"): "A=1", ("r1", ".github/workflows/x.yml"): "a: b", ("r2", "a/b/c/.npmrc"): "z\ny", ("r2", "_under.txt"): "u",
        ("r2", "empty.txt"): "", ("r2", "bad.txt"): "ok � end", ("", "top.txt"): "t",
    }
    one = {r.path for r in src.read_artifacts(spark, f"file://{tree}", "one").select("path").collect()}
    assert one == {"/".join(x for x in k if x) for k in got}


def test_folder_source_takes_filters(spark, tree, capsys):
    """Filters on path and length leave the plan, and refused files are not opened."""
    folders.register(spark)
    small = spark.read.format(folders.NAME).load(tree).where("length <= 100 AND path LIKE 'r1/%' AND path NOT LIKE '%x%'")
    small.explain()
    plan = capsys.readouterr().out
    assert "length" not in plan.split("Filter (")[1].split("\n")[0].replace("isnotnull(length", "") and "StartsWith" not in plan
    assert "Contains" in plan and {r.path for r in small.collect()} == {"r1/.env", "r1/sub/.git/config"}
    reader = folders.FolderReader(tree, [], 4)
    os.chmod(f"{tree}/r1/.env", 0)
    reader.tests = [("path", folders.StringEndsWith, ".npmrc")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


@pytest.mark.parametrize("wanted", [1, 2, 5, 100])
def test_folder_source_deals_each_file_once(tree, wanted):
    reader = folders.FolderReader(tree, [], wanted)
    paths = sorted(p for part in reader.partitions() for f in reader.files(folders.Tree(tree, []), part) for p in [f.path])
    assert paths == sorted(TREE) and len(reader.partitions()) <= wanted


def test_archives_a_member_at_a_time(spark, tree, tmp_path):
    with tarfile.open(tmp_path / "shop.tar.gz", "w:gz") as t:
        t.add(f"{tree}/r1", "./")
    got = {(r.repo, r.path) for r in src.read_archives(spark, str(tmp_path)).collect()}
    assert {("shop", ".env"), ("shop", ".github/workflows/x.yml")} <= got


IGNORES = ["*.log", "!keep.log", "/build", "docs/**", "tmp?", "**/cache", "a*b/c", "*", "!*.py", ".env", "!src", "x.d/", "# no", "", "data/*.csv", "**.bak", "n/**/m.txt"]


def ignored_by_hand(path, rules):
    def regex(p):
        p = p.lstrip("!") if p.startswith("!") else p
        p = p.rstrip("/")
        rooted = "/" in p
        p = p.removeprefix("/")
        body = ""
        while p:
            if p.startswith("**/"):
                body, p = body + "(?:.*/)?", p[3:]
            elif p.startswith("**"):
                body, p = body + ".*", p[2:]
            else:
                body, p = body + {"*": "[^/]*", "?": "[^/]"}.get(p[0], re.escape(p[0])), p[1:]
        return ("^" if rooted else "^(?:.*/)?") + body + "$"

    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        hits = [not p.startswith("!") for p in rules if p and not p.startswith("#") and re.search(regex(p), "/".join(parts[:k]))]
        if hits and hits[-1]:
            return True
    return False


def test_ignore_rules_by_anchor_equal_every_rule_on_every_path(spark):
    rnd = random.Random(1)
    names = ["src", "build", "docs", "tmp1", "cache", "axb", "c", "x.log", "keep.log", "m.py", ".env", "x.d", "data", "q.csv", "o.bak", "n", "m.txt", "README"]
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(400)})
    repos = {f"r{i}": rnd.sample(IGNORES, rnd.randint(1, 9)) for i in range(12)}
    rules = spark.createDataFrame([(r, i, p) for r, ps in repos.items() for i, p in enumerate(ps)], "repo string, ord int, pattern string")
    files = spark.createDataFrame([(r, p) for r in repos for p in paths], "repo string, path string")
    got = {(r.repo, r.path) for r in src.apply_ignore_rules(files, rules).collect()}
    assert got == {(r, p) for r, ps in repos.items() for p in paths if not ignored_by_hand(p, ps)}


def owner_by_hand(path, rules):
    last = None
    for p, who in rules:
        body = re.escape(p.lstrip("/")).replace(r"\*\*", r"\*").replace(r"\*", ".*").replace(r"\?", ".")
        if re.search(("^" if p.startswith("/") else "^(?:.*/)?") + body + (".*" if p.endswith("/") else "(?:/.*)?") + "$", path):
            last = who
    return last


def test_codeowners_by_anchor_equal_every_rule_on_every_path(spark):
    rnd = random.Random(2)
    pool = ["*", "*.py", "/src/", "docs", "docs/", "/docs/*.md", "src/*/x.py", "**/lib", "a?c", "/x*", "*.tar.gz", "lib/**", "/src"]
    names = ["src", "docs", "lib", "abc", "x.py", "xy", "y.md", "z.tar.gz", "k"]
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(300)})
    repos = {f"r{i}": [(p, f"@t{k}") for k, p in enumerate(rnd.sample(pool, rnd.randint(1, 8)))] for i in range(12)}
    rules = spark.createDataFrame([(r, i, p, w) for r, ps in repos.items() for i, (p, w) in enumerate(ps)], "repo string, ord int, pattern string, owners string")
    files = spark.createDataFrame([(r, p) for r in repos for p in paths], "repo string, path string")
    got = {(r.repo, r.path): r.owners for r in I.match_codeowners(files, rules).collect()}
    assert got == {(r, p): w for r, ps in repos.items() for p in paths if (w := owner_by_hand(p, ps))}


def test_rules_of_a_hot_repository_meet_few_paths(spark):
    """2,000 rules and 2,000 paths: pairs put to a pattern are in proportion to paths, not to their product."""
    from idlens.functions import globs

    rules = spark.range(2000).select(F.lit("r").alias("repo"), F.col("id").alias("ord"), F.concat(F.lit("team"), "id", F.lit("/*.py")).alias("pattern"))
    paths = spark.range(2000).select(F.lit("r").alias("repo"), F.concat(F.lit("team"), "id", F.lit("/a.py")).alias("path"))
    keyed = paths.withColumn("anchor", F.explode(globs.any_name_keys(F.col("path"))))
    anchors = rules.withColumn("anchor", globs.any_name_anchor(F.col("pattern"), F.lit(False)))
    assert keyed.join(anchors, ["repo", "anchor"]).count() == 2000
    owners = I.match_codeowners(paths, rules.withColumn("owners", F.concat(F.lit("@"), "ord")))
    assert owners.where("owners = concat('@', regexp_extract(path, '([0-9]+)', 1))").count() == 2000


def test_owners_beyond_a_thousand(spark):
    text = "* " + " ".join(f"@u{i}" for i in range(1500)) + "\n"
    files = spark.createDataFrame([("s", "r", "CODEOWNERS", text)], "scan_id string, repo string, path string, content string")
    assert len(I.parse_codeowners(files).first().owners.split()) == 1500


def test_history_is_bounded_only_when_asked(spark):
    rows = [("r", f"{i:040x}", f"{i:07x}", "a", f"2024-{i // 28 % 12 + 1:02}-{i % 28 + 1:02}T10:00:00+02:00", f"f{i}.txt", 1, "x") for i in range(1200)]
    rows.append(("r", "f" * 40, "fffffff", "a", "no date", "late.txt", 1, "x"))
    lines = spark.createDataFrame(rows, "repo string, sha string, short_sha string, author string, date string, path string, line_no int, text string")
    seen = []

    def detect(artifacts):
        seen.append(artifacts.count())
        return artifacts.select("scan_id", "repo", "path", F.lit(1).alias("line_no"), F.array(F.lit("t")).alias("tags"), *(F.lit(None).cast("string").alias(c) for c in ("commit_sha", "commit_short_sha", "commit_author", "commit_date")))

    assert src.scan_history(lines, detect).count() == 1201
    assert src.scan_history(lines, detect, max_commits=5).count() == 5
    assert src.scan_history(lines, detect, since="2024-12-01").count() == 1 + sum(r[4] >= "2024-12" for r in rows[:-1])


@pytest.mark.parametrize("pattern", [r"(a+)+$", r"((a+)b?)+$", r"(a|a)*$", r"(a*)*", r"(\w|\d)+x", r"(a|aa)+$", r"(.*a){12}b", r"(x+x+)+y", r"(a?){30}a", r"(?i)(k|K)+z", r"(a{1,40}){1,40}$", "(", "a{2,1}"])
def test_unsafe_patterns_are_refused(spark, pattern):
    assert patterns.refused(pattern)


@pytest.mark.parametrize(
    "pattern, text", [(r"[0-9a-f]{40}", "a1" * 20), (r"(?P<k_1>tok_[a-z]+)=(?P=k_1)x", "tok_a=tok_ax"), (r"(x+)?y", "xxy"), (r"(?:[a-z]+-)*[a-z]+", "ab-cd-e"), (r"[[a&&b]+z", "[&az"), (r"(a{,3})b\Z", "aab"), (r"[]x]+", "]x"), (r"[^]x]+", "ab"), (r"\bghp_\w{4}\b", "ghp_éa1b"), (r"a\vb", "a\x0bb"), (r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==)", "abcdAB==")]
)
def test_safe_patterns_find_there_what_they_find_here(spark, pattern, text):
    assert patterns.refused(pattern) is None and re.search(pattern, text)
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(patterns.translated(pattern))).first()[0]


def test_rule_pack_drops_what_is_refused(spark):
    pack = {"rules": [{"id": "ok", "pattern": "(?P<k>tok_[a-z0-9]{20})"}, {"id": "loop", "pattern": "(a|a)*$"}, {"id": "s", "type": "structural"}, {"id": "sev", "pattern": "x", "severity": "odd"}]}
    assert [(r["id"], r["pattern"]) for r in src.load_rule_pack(json.dumps(pack))] == [("ok", "(?<g1>tok_[a-z0-9]{20})")]
    with pytest.raises(ValueError):
        src.load_rule_pack(json.dumps({"rules": [{"id": "loop", "pattern": "((a+)b?)+$"}]}))


def test_scans_that_fail(spark):
    """A scan that did not end scores 100 and says so, with or without findings; failed files say how many."""
    from idlens.plans import synthetic

    i = synthetic.identities(spark, "/root/testdata/sf0.001").where("repo IN ('repo_1', 'repo_2', 'repo_3')")
    fatal = spark.createDataFrame([("s1", "repo_1"), ("s1", "gone")], "scan_id string, repo string")
    errors = spark.createDataFrame([("s1", "repo_2", "x")] * 3, "scan_id string, repo string, path string")
    got = {r.repo: r for r in R.scan_summary(i, R.run_rules(i), errors, fatal).where("scan_id = 's1'").collect()}
    assert got["repo_1"].overall_score == got["gone"].overall_score == 100 and got["gone"].policy == got["repo_1"].policy == "block"
    assert got["gone"].summary == got["repo_1"].summary and got["gone"].trust_level == "untrusted"
    assert got["repo_2"].summary.startswith("Incomplete: 3 ") and got["repo_2"].trust_level == "degraded"
    assert "Worst first" in got["repo_3"].summary
    clean = R.scan_summary(i.limit(0), R.run_rules(i.limit(0)), errors.limit(0), fatal.limit(0))
    assert clean.count() == 0
