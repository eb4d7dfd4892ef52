"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Classes of equal vectors are dealt to shards of bounded size by hash. In a shard, points enter in batches: a
greedy search over the graph so far proposes neighbours, relaxed distance pruning keeps diverse edges, and
reverse edges are pruned the same way. Queries, in large parts, meet every shard by beam search; the shards' best are
merged. A shard goes to Python once a part, and there the searches of a block run in lockstep, so a step is a few
array operations. All rows are indexed.

Vectors that ``usable`` refuses and rows without an id take no part. Rows that repeat an id each take part: as queries,
which give results of their own under one query_id, and as candidates of all rows but themselves. Ties of a score go to
the smaller id. Vectors of another length than the query's are no candidates. Other columns are not read, so their names
never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import materialize
from idlens.llm.vectors import unit, usable

#: Neighbours of a query; ids a class of equal vectors keeps (one more, as a query may be among them).
TOP = 5
#: Out-degree, beam widths of build and search, relaxation of the pruning rule.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 24, 40, 64, 1.2
#: Points of a shard: eight times the square root of all, within these bounds.
SHARD_ROWS = (1024, 65_536)
#: Queries in a block of a search, and in a part, which share one copy of a shard's index.
QUERY_ROWS, PART_ROWS = 256, 16_384
#: Every so many ids is a query.
STRIDE = 50


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``width`` nearest found for each row of ``q``; -1 where there are fewer."""
    n = len(q)
    ids = np.full((n, width), -1)
    dist = np.full((n, width), np.inf)
    done = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], dist[:, 0], seen[:, entry] = entry, 2 - 2 * (q @ x[entry]), True
    while True:
        open_ = (ids >= 0) & ~done
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return ids, dist
        at = np.where(open_[live], dist[live], np.inf)
        step = np.argsort(at, axis=1, kind="stable")[:, :3]
        fresh = np.isfinite(np.take_along_axis(at, step, 1))
        here = np.where(fresh, np.take_along_axis(ids[live], step, 1), 0)
        r, c = np.nonzero(fresh)
        done[live[r], step[r, c]] = True
        near = np.where(fresh[:, :, None], graph[here], -1).reshape(len(live), -1)
        near.sort(axis=1)
        bad = (near < 0) | seen[live[:, None], near]
        bad[:, 1:] |= near[:, 1:] == near[:, :-1]
        near = np.where(bad, 0, near)
        r, c = np.nonzero(~bad)
        seen[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        d[r, c] = 2 - 2 * np.einsum("ij,ij->i", x[near[r, c]], q[live[r]])
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1), -1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(bad)], 1), order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point out of its row of ``cand`` (-1: none): the nearest one stays and rules out
    those that it is nearer to by the factor ``alpha`` than the point is."""
    out = np.full((len(points), degree), -1)
    for a in range(0, len(points), 256):
        p, c = points[a : a + 256], np.sort(cand[a : a + 256], 1)
        alive = (c >= 0) & (c != p[:, None])
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        v = x[np.where(c < 0, 0, c)]
        d = np.where(alive, 2 - 2 * np.einsum("ijk,ik->ij", v, x[p]), np.inf)
        rows = np.arange(len(p))
        for k in range(degree):
            best = np.where(alive, d, np.inf).argmin(1)
            some = alive[rows, best]
            if not some.any():
                break
            out[a : a + 256, k] = np.where(some, c[rows, best], -1)
            between = 2 - 2 * np.einsum("ijk,ik->ij", v, v[rows, best])
            alive &= ~(some[:, None] & (alpha * alpha * between <= d))
            alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of each point, entry point) over unit rows, in two passes of batches that double in size."""
    n = len(x)
    graph = np.full((n, degree), -1)
    mean = x.mean(0)
    entry = int((x @ mean).argmax())
    for first in (True, False):
        at, size = 0, 1 if first else max(1, n // 8)
        while at < n:
            size = min(size * 2, 512) if first else size
            batch = np.arange(at, min(n, at + size))
            found, _ = beam_search(x, graph, entry, x[batch], min(beam, n))
            kept = robust_prune(x, batch, np.concatenate([found, graph[batch]], 1), degree, alpha)
            graph[batch] = kept
            i, k = np.nonzero(kept >= 0)
            to, back = kept[i, k], batch[i]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            who, start, count = np.unique(to, return_index=True, return_counts=True)
            for s in range(0, len(who), 512):
                w, b, c = who[s : s + 512], start[s : s + 512], count[s : s + 512]
                extra = np.full((len(w), c.max()), -1)
                r = np.repeat(np.arange(len(w)), c)
                place = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
                extra[r, place] = back[np.repeat(b, c) + place]
                graph[w] = robust_prune(x, w, np.concatenate([graph[w], extra], 1), degree, alpha)
            at += size
    return graph, entry


def shard_count(n: int) -> int:
    return max(1, math.ceil(n / min(SHARD_ROWS[1], max(SHARD_ROWS[0], 8 * math.sqrt(n)))))


def usable_rows(df: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    return df.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))


def build_index(df: DataFrame) -> DataFrame:
    """One row a shard: vectors, graph, entry and the ids of each class, written to the shared scratch folder.

    Of equal vectors the ``TOP`` + 1 smallest ids are kept, repeated ones as often as they stand, which no answer
    needs more of. Vectors of another length than most have shards of their own.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = usable_rows(df).withColumn("r", first).where(F.col("r") <= TOP + 1)
    nodes = materialize(few.groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = shard_count(nodes.count())
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sample(frac=1, random_state=1) if len(pdf) > 2 else pdf
        raw = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
        graph, entry = build_graph(unit(raw))
        sizes = [len(i) for i in pdf["ids"]]
        one = {
            "shard": pdf["shard"].iloc[0],
            "dim": pdf["dim"].iloc[0],
            "entry": entry,
            "vectors": raw.tobytes(),
            "graph": graph.astype(np.int32).tobytes(),
            "ids": np.concatenate(pdf["ids"].to_list()).astype(np.int64).tobytes(),
            "sizes": np.array(sizes, np.int32).tobytes(),
        }
        return pd.DataFrame([one])

    # rows in a fixed order, so that a task run again builds the same graph
    made = dealt.groupBy("shard", "dim").applyInPandas(lambda pdf: build(pdf.sort_values("ids", key=lambda s: s.map(lambda i: i[0]))), "shard int, dim int, entry int, vectors binary, graph binary, ids binary, sizes binary")
    return materialize(made, "index")


def search_shard(shard: pd.Series, queries: pd.DataFrame, top: int, beam: int) -> pd.DataFrame:
    """(query, query_id, vec_id, score): each query's best in one shard, a block at a time."""
    raw = np.frombuffer(shard["vectors"], np.float64).reshape(-1, int(shard["dim"]))
    graph = np.frombuffer(shard["graph"], np.int32).reshape(-1, DEGREE)
    sizes, ids = np.frombuffer(shard["sizes"], np.int32), np.frombuffer(shard["ids"], np.int64)
    ends, x, out = np.cumsum(sizes), unit(raw), []
    for at in range(0, len(queries), QUERY_ROWS):
        block = queries.iloc[at : at + QUERY_ROWS]
        own = np.stack([np.asarray(v, np.float64) for v in block["v"]])
        near, _ = beam_search(x, graph, int(shard["entry"]), unit(own), min(beam, len(x)))
        near = near[:, : 2 * (top + 1)]
        v = raw[np.where(near < 0, 0, near)]
        norms = np.sqrt(np.einsum("ij,ij->i", own, own))[:, None] * np.sqrt(np.einsum("ijk,ijk->ij", v, v))
        score = np.einsum("ijk,ik->ij", v, own) / norms
        same = (v == own[:, None, :]).all(2)
        for number, q, row, s, equal in zip(block["query"].tolist(), block["vec_id"].tolist(), near.tolist(), score.tolist(), same.tolist()):
            best = []
            for c, y, e in zip(row, s, equal):
                if c >= 0:
                    there = ids[ends[c] - sizes[c] : ends[c]].tolist()
                    if e and q in there:  # the query's own row
                        there.remove(q)
                    best += [(-y, i) for i in there]
            out += [(number, q, i, -y) for y, i in sorted(best)[:top]]
    return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest other rows found for each of ``queries`` (vec_id, v, dim)."""
    shards = index.select("shard").distinct().agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    queries = materialize(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    parts = max(1, math.ceil(queries.count() / PART_ROWS))
    sent = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(shard: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(own):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        return search_shard(shard.iloc[0], own.sort_values(["vec_id", "query"]), top, beam)

    keys = ["shard", "dim", "part"]
    found = copies.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(df: DataFrame) -> DataFrame:
    """The query of the contract: every ``STRIDE``-th id searches all other rows by cosine.

    Unusable vectors take no part, neither as queries nor as candidates; an empty table gives no rows.
    """
    return search(build_index(df), usable_rows(df.where(F.col("vec_id") % STRIDE == 0)))
