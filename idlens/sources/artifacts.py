"""Artifacts from folders, tables, patches and fleets, and what prepares them."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idlens.functions import globs
from idlens.functions.text import base_name, extension
from idlens.sources import folders, keyfilter, patterns

MAX_BYTES = 2_097_152

# Folders never scanned, and names, endings and paths that are.
IGNORED_DIRS = """.git node_modules venv .venv __pycache__ dist build .next .cache target vendor .tox .mypy_cache .pytest_cache
.ruff_cache .eggs htmlcov site-packages .svn .hg .parcel-cache .turbo Pods bower_components""".split()
NAMES = """dockerfile docker-compose.yml docker-compose.yaml package.json requirements.txt pyproject.toml manifest.json .mcp.json
mcp.json mcp_config.json claude_desktop_config.json cursor_mcp.json agents.yaml agents.yml agents.json crew.py autogen_config.json
litellm_config.yaml litellm_config.yml model_gateway.yaml model_gateway.yml agents.md agent.md claude.md skill.md .cursorrules
.windsurfrules copilot-instructions.md azure-pipelines.yml .gitlab-ci.yml cdk.json cdk.context.json pulumi.yaml renovate.json
renovate.json5 .renovaterc .renovaterc.json .renovaterc.json5 dependabot.yml dependabot.yaml sshd_config sshd common-auth
system-auth password-auth id_rsa id_dsa id_ecdsa id_ed25519 .pgpass .my.cnf .s3cfg kubeconfig credentials jenkinsfile
bitbucket-pipelines.yml .clinerules .npmrc .pypirc .netrc gradle.properties .yarnrc .git-credentials""".split()
EXTENSIONS = """.env .txt .json .yaml .yml .toml .ini .cfg .conf .md .mdx .prompt .ipynb .cursorrules .windsurfrules .pkl .pickle
.pt .pth .safetensors .py .js .ts .tsx .jsx .go .rb .php .java .cs .tf .bicep .sh .bash .zsh .ps1 .cloud-init .pem .key .ppk .p12
.pfx .tfvars .properties .xml .mdc""".split()
CREDENTIAL_PATHS = r"\.cargo/(?:credentials|config)(?:\.toml)?$|\.gradle/(?:init\.gradle|gradle\.properties)$|\.aws/credentials$|\.kube/config$"


def normalize_text(content: Column) -> Column:
    """UTF-8 with replacement signs; CRLF and CR become LF."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def read_artifacts(spark: SparkSession, root: str, repo: str | None = None, scan_id: str = "s1") -> DataFrame:
    """All files below a folder, hidden ones too; links are not followed and ignored folders never entered.

    ``repo`` names the repository; without it each folder of the first level is one, and files beside them belong to a
    repository of an empty name. Sizes and paths are judged from the listing, so files above the size gate are never
    opened, and filters on ``file`` (the path below ``root``) reach the source too.
    """
    folders.register(spark)
    files = spark.read.format(folders.NAME).option("prune", json.dumps(IGNORED_DIRS)).load(root).where(F.col("length") <= MAX_BYTES)
    first = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^([^/]*)/", 1)).otherwise("")
    below = F.regexp_replace("path", "^[^/]*/", "") if repo is None else F.col("path")
    name = first if repo is None else F.lit(repo)
    return complete(files.select(F.lit(scan_id).alias("scan_id"), name.alias("repo"), below.alias("path"), normalize_text(F.col("content")).alias("content")))


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content binary) as files below ``root``, a folder that all executors share; how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, made, n = folders.Tree(root, []), set(), 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                parent = tree.full(path).rpartition("/")[0]
                if parent not in made:
                    tree.fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with tree.fs.open_output_stream(tree.full(path)) as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, root: str, scan_id: str = "s1") -> DataFrame:
    """All files in the tar and zip archives below a folder, hidden ones too; an archive is a repository of its name.

    Archives are dealt to tasks, and each is opened where it is read; members above the size gate are not.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(r"(?i)\.(?:zip|tar|tgz|tar\.gz)$"))
    repo = F.regexp_extract("path", r"([^/]+?)(?i)(?:\.zip|\.tar|\.tgz|\.tar\.gz)$", 1)

    def opened(raw: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for m in z.infolist():
                    if not m.is_dir() and m.file_size <= MAX_BYTES:
                        yield m.filename, z.read(m)
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for m in t:
                    if m.isfile() and m.size <= MAX_BYTES:
                        yield m.name.removeprefix("./"), t.extractfile(m).read()

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["repo"], pdf["content"]):
                for path, content in opened(raw):
                    yield pd.DataFrame([(name, path, content)], columns=["repo", "path", "content"])

    files = archives.select(repo.alias("repo"), "content").mapInPandas(members, "repo string, path string, content binary")
    return artifacts_from_table(files, F.col("repo"), F.col("path"), F.col("content"), scan_id)


def complete(df: DataFrame) -> DataFrame:
    return df.withColumn("n_bytes", F.octet_length("content").cast("long")).withColumn("content_sha", F.sha2(F.col("content").cast("binary"), 256))


def artifacts_from_table(df: DataFrame, repo: Column, path: Column, content: Column, scan_id: str = "s1") -> DataFrame:
    return complete(df.select(F.lit(scan_id).alias("scan_id"), repo.alias("repo"), path.alias("path"), normalize_text(content).alias("content")))


def scan_target_filter(df: DataFrame) -> DataFrame:
    name = base_name()
    telling = name.rlike(r"^\.env|\.tfstate(\.backup)?$|^dockerfile\.|^pulumi\..*ya?ml$")
    return df.where(name.isin(NAMES) | extension().isin(EXTENSIONS) | telling | F.lower(F.regexp_replace("path", r"\\", "/")).rlike(CREDENTIAL_PATHS))


def prune_dirs(df: DataFrame) -> DataFrame:
    """Drops what lies below an ignored folder; folder names compare with case."""
    parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    return df.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), F.array(*map(F.lit, IGNORED_DIRS))))


def size_gate(df: DataFrame) -> DataFrame:
    return df.where(F.col("n_bytes") <= MAX_BYTES)


def ignore_body(pattern: Column) -> tuple[Column, Column]:
    """A gitignore pattern without its signs, and whether it is rooted: a ``/`` leads it or stands inside."""
    bare = F.regexp_replace(F.regexp_replace(pattern, "^!", ""), "/+$", "")
    body = F.regexp_replace(bare, "^/", "")
    return body, F.startswith(bare, F.lit("/")) | body.contains("/")


def ignore_regex(pattern: Column) -> Column:
    """A gitignore pattern as a regex: ``*`` and ``?`` stay in a segment, ``**`` spans, a leading ``/`` anchors."""
    body, rooted = ignore_body(pattern)
    body = F.replace(F.regexp_replace(body, r"([.+^$(){}|\[\]\\])", r"\\$1"), F.lit("**/"), F.lit("\x01"))
    body = F.replace(F.replace(body, F.lit("**"), F.lit("\x02")), F.lit("*"), F.lit("[^/]*"))
    body = F.replace(F.replace(F.replace(body, F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.concat(F.when(rooted, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), body, F.lit("$"))


def apply_ignore_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Drops ignored files. For each path and each folder above it the last matching rule decides; an ignored
    folder takes its subtree. Rules are (repo, ord, pattern), met by repository and anchor."""
    pattern = F.trim("pattern")
    clean = rules.where((pattern != "") & ~pattern.startswith("#"))
    clean = clean.select("repo", "ord", globs.last_name_anchor(*ignore_body(pattern)).alias("anchor"), ignore_regex(pattern).alias("rx"), F.startswith(pattern, F.lit("!")).alias("back"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    # a folder is judged once, however many files are below it
    seen = df.select("repo", F.explode(prefixes).alias("prefix")).distinct()
    last = globs.matches(seen, clean, "prefix", globs.last_name_keys(F.col("prefix"))).groupBy("repo", "prefix").agg(F.max_by(~F.col("back"), "ord").alias("gone"))
    gone = df.select("repo", "path", F.explode(prefixes).alias("prefix")).join(last.where("gone"), ["repo", "prefix"])
    return df.join(gone.select("repo", "path").distinct(), ["repo", "path"], "left_anti")


def restrict_to_changed(df: DataFrame, changed: DataFrame) -> DataFrame:
    return df.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def split_cached(artifacts: DataFrame, cached: DataFrame, version: str, blocks: int = keyfilter.BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(misses, reused signals): the key is content, name and detector version. Signals with a secret, and those of
    custom rules, are never reused; ``cached`` has content_sha, name_key, version and the signal columns.

    Contents are never exchanged. A filter of the cached keys tells most misses from their own row; of the rest, keys
    alone are put to the cache, and those it does not hold make a second filter. A row is a miss if the first filter
    lacks its key or the second has it, so each row is on one side and every reused one is in the cache. A filter that
    errs sends a cached file to be scanned again, whose result is the same. Files without content are misses.
    """
    key, named = ["content_sha", "name_key"], artifacts.withColumn("name_key", base_name())
    current = cached.where(F.col("version") == version)
    kept = F.col("secret_fingerprint").isNull() & (F.col("detector") != "custom")
    keys = current.groupBy(*key).agg(F.bool_and(F.coalesce(kept, F.lit(False))).alias("all_kept")).where("all_kept").select(*key)
    marked = keyfilter.mark(named, key, keyfilter.build(keys, key, blocks), "_cached", blocks)
    odd = marked.where("_cached").select(*key).distinct().join(keys, key, "left_anti")
    marked = keyfilter.mark(marked, key, keyfilter.build(odd, key, blocks), "_odd", blocks)
    known = F.col("_cached") & ~F.col("_odd")
    misses = marked.where(~known).drop("name_key", "_cached", "_odd")
    rows = marked.where(known).select("scan_id", "repo", "path", *key)
    hits = current.where(kept).drop("scan_id", "repo", "path", "version")
    return misses, rows.join(hits, key).drop(*key)


def incremental_scan(artifacts: DataFrame, cached: DataFrame, version: str, detect) -> DataFrame:
    """Signals of changed artifacts by ``detect``, of the others from the cache under their new paths."""
    misses, reused = split_cached(artifacts, cached, version)
    fresh = detect(misses)
    return fresh.unionByName(reused.select(*fresh.columns))


def added_lines(patches: DataFrame) -> DataFrame:
    """(repo, sha, short_sha, author, date, path, line_no, text) of ``git log -p -U0`` texts (repo, patch_id, patch_text).

    A commit's header holds six tab-separated fields; running values per patch carry commit, path and hunk.
    """
    lines = patches.select("repo", "patch_id", F.posexplode(F.split("patch_text", "\n")).alias("at", "line"))
    upto = Window.partitionBy("repo", "patch_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^[0-9a-f]{7,64}\t[^\t]*\t[^\t]*\t[^\t]*\t[^\t]*\t"), F.split("line", "\t"))
    to = F.regexp_extract("line", r'^\+\+\+ "?(?:b/)?([^\t"]*)"?\t?$', 1)
    hunk = F.nullif(F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1), F.lit(""))
    rows = lines.withColumn("c", F.last(head, True).over(upto)).withColumn("path", F.last(F.when(F.col("line").startswith("+++ "), to), True).over(upto))
    rows = rows.withColumn("hunk", F.last(F.when(hunk.isNotNull(), F.struct("at", hunk.cast("int").alias("start"))), True).over(upto))
    is_added = F.col("line").startswith("+") & ~F.col("line").startswith("+++ ")
    in_hunk = Window.partitionBy("repo", "patch_id", "hunk.at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.count_if(is_added).over(in_hunk)).where(is_added & F.col("hunk").isNotNull() & (F.col("path") != "/dev/null"))
    c = F.col("c")
    return rows.select("repo", c[0].alias("sha"), c[1].alias("short_sha"), c[2].alias("author"), c[4].alias("date"), "path", (F.col("hunk.start") + F.col("nth") - 1).cast("int").alias("line_no"), F.substring("line", F.lit(2), F.length("line")).alias("text"))


def scan_history(lines: DataFrame, detect, max_commits: int | None = None, since: str | None = None) -> DataFrame:
    """Detectors over each commit's added snippet, with true line numbers.

    Every commit counts, unless ``since`` (an ISO date or time) or ``max_commits``, the newest ones of a repository, say
    otherwise. Dates with offsets compare as points in time; a commit whose date cannot be read is not older than any.
    """
    kept = lines
    if since:
        kept = kept.where(F.coalesce(F.try_to_timestamp("date") >= F.to_timestamp(F.lit(since)), F.lit(True)))
    if max_commits:
        # ranked among commits, not among their lines
        commits = kept.groupBy("repo", "sha").agg(F.max(F.try_to_timestamp("date")).alias("_at"), F.max("date").alias("_date"))
        newest = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc_nulls_last("_at"), F.desc("_date"), "sha"))
        kept = kept.join(commits.withColumn("_r", newest).where(F.col("_r") <= max_commits).select("repo", "sha"), ["repo", "sha"], "left_semi")
    snippet = kept.groupBy("repo", "sha", "short_sha", "author", "date", "path").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    snippet = snippet.select(F.col("sha").alias("scan_id"), "repo", "path", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"), F.col("sha").alias("commit_sha"), F.col("short_sha").alias("commit_short_sha"), F.col("author").alias("commit_author"), F.col("date").alias("commit_date"), F.transform("l", lambda x: x["line_no"]).alias("lines"))
    maps = snippet.select("scan_id", "repo", "path", "lines", *(F.col(c).alias(f"_{c}") for c in ("commit_sha", "commit_short_sha", "commit_author", "commit_date")))
    found = detect(complete(snippet.drop("lines"))).join(maps, ["scan_id", "repo", "path"])
    true_line = F.try_element_at("lines", F.col("line_no"))
    tags = F.array_union("tags", F.array(F.lit("git_history")))
    out = found.withColumn("line_no", true_line).withColumn("tags", tags)
    for c in ("commit_sha", "commit_short_sha", "commit_author", "commit_date"):
        out = out.withColumn(c, F.col(f"_{c}"))
    return out.drop("lines", "_commit_sha", "_commit_short_sha", "_commit_author", "_commit_date")


def rule_fault(rule: dict) -> str | None:
    """Why a rule of a pack is not run; None if it is."""
    if not rule.get("id"):
        return "no id"
    if rule.get("severity", "medium") not in ("low", "medium", "high", "critical"):
        return "unknown severity"
    if rule.get("type", "regex") == "structural":
        return None if rule.get("when") else "no condition"
    pattern = rule.get("pattern") or ""
    if not pattern:
        return "no pattern"
    if len(pattern) > 512:
        return "pattern over 512 characters"
    return "unsafe or invalid pattern" if patterns.refused(pattern) else None


def load_rule_pack(text: str) -> list[dict]:
    """The rules of a JSON pack that have no ``rule_fault``, a handful of rows on the driver; a pack without one is an
    error. Patterns come back in the dialect that Spark runs."""
    sound = [r for r in json.loads(text).get("rules", []) if not rule_fault(r)]
    if not sound:
        raise ValueError("no valid rule in the pack")
    return [r if r.get("type", "regex") == "structural" else r | {"pattern": patterns.translated(r["pattern"])} for r in sound]


def rule_pack_errors(spark: SparkSession, text: str) -> DataFrame:
    """(rule, error) of the rules that ``load_rule_pack`` leaves out: a bad rule costs its own detector only."""
    faults = [(str(r.get("id") or f"rule {n}"), fault) for n, r in enumerate(json.loads(text).get("rules", []), 1) if (fault := rule_fault(r))]
    return spark.createDataFrame(faults, "rule string, error string")


def host_inventory(table: DataFrame) -> DataFrame:
    """The files of a fleet table that bear on authentication: PAM and sshd settings, security modules."""
    return table.where(F.col("path").rlike(r"/pam\.d/|sshd_config|/security/|pam_\w+\.so$")).select("host", "path", "mode", "content")
