"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of one label form a class; only classes are compared.
2. First lists are cheap: a few tables of random hyperplanes deal each label's classes to leaves of bounded size, and
   each class keeps its nearest of a leaf.
3. Descent: the members of each list meet one another (neighbours of neighbours), and better ones enter the lists.
   Only lists with a new entry are joined again, until hardly an entry is new and no link is.
4. A list full of links is saturated and enlarged: it takes further links, up to the greatest length. Those full even
   then have too many links to list: their components are compared whole, in blocks, and counted.
5. Audit: the links of bounded samples of classes with full lists, with some links, with none but near ones and with
   none at all are counted against all rows. Below the wanted recall in any sample, tables are added to those there
   are, twice as many each time, and the descent goes on; at last each label is one leaf, which compares all.

Lists cut to a length never part a component: groups and lists also give links that join all they hold at the
threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import connected_components, discard, materialize
from idlens.llm.vectors import unit, usable

THRESHOLD = 0.93
#: Length of a neighbour list, greatest length of an enlarged one, and least cosine of an entry that takes part in descent.
LIST, LONGEST, EXPLORE = 10, 40, 0.5
#: Classes a leaf holds on average and at most, and classes in a block of a comparison.
LEAF = BLOCK = 256
#: Tables at first; chance that a pair at about the threshold stands on one side of a hyperplane, and that all tables
#: miss it when there are as many as are worth having.
TABLES, TOGETHER, MISS = 4, 0.88, 1e-5
#: Lists joined in one group.
GROUP = 256
#: Share of list entries that are new in the last round of a descent, at most.
STILL = 0.001
AUDIT_ROWS, RECALL = 256, 0.999


def depth_of(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / LEAF)))


def most_tables(n: int) -> int:
    """Tables beyond which more of them hardly find a pair that those before did not."""
    depth = depth_of(n)
    return 1 if depth == 0 else math.ceil(math.log(MISS) / math.log(1 - TOGETHER**depth))


def classes(df: DataFrame) -> DataFrame:
    """(rep, label, dim, v, mult): one row for each distinct usable vector of a label; ``rep`` is its smallest id."""
    good = df.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding"))
    made = good.groupBy("label", F.col("embedding").alias("v")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    return made.select("rep", "label", F.size("v").alias("dim"), "v", "mult")


def leaves(nodes: DataFrame, tables: range) -> DataFrame:
    """(label, dim, place, leaf, part, rep): where each class stands in each table.

    Leaves that hold more than ``LEAF`` classes are dealt to parts by chance, in another way in every table.
    """
    sized = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    rows = nodes.join(sized, ["label", "dim"]).select("rep", "label", "dim", "v", "n")

    def run(batches):
        for pdf in batches:
            for (dim, n), part in pdf.groupby(["dim", "n"]):
                depth = depth_of(n)
                m = unit(part["v"]).astype(np.float32)
                codes = np.zeros((len(part), len(tables)), np.int64)
                for k, t in enumerate(tables):
                    planes = np.random.default_rng((dim, t)).standard_normal((dim, depth), np.float32)
                    codes[:, k] = (m @ planes > 0) @ (1 << np.arange(depth))
                yield part[["rep", "label", "dim"]].assign(leaf=list(codes))

    coded = rows.mapInPandas(run, f"rep long, label {nodes.schema['label'].dataType.simpleString()}, dim int, leaf array<long>")
    keys = ["label", "dim", "place", "leaf"]
    dealt = materialize(coded.select("label", "dim", "rep", F.posexplode("leaf").alias("place", "leaf")).withColumn("place", F.col("place") + tables.start), "leaves")
    parts = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / LEAF).alias("parts"))
    return dealt.join(parts, keys).select(*keys, F.pmod(F.xxhash64("rep", "place"), "parts").alias("part"), "rep")


def in_blocks(rows: DataFrame, keys: list[str], size: DataFrame) -> DataFrame:
    """Rows of groups above ``BLOCK`` dealt out to pairs of blocks (i, j); ``size`` has the m of those groups."""
    rows = rows.join(size, keys, "left").withColumn("blocks", F.ceil(F.coalesce(F.col("m"), F.lit(1)) / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("m", "blocks", "other")


def cosines(pdf: pd.DataFrame) -> np.ndarray:
    """All cosines of a group; -2 of a class with itself and, in a pair of two blocks, of classes of one block."""
    m = unit(pdf["v"])
    s = m @ m.T
    np.fill_diagonal(s, -2)
    if "block" in pdf and pdf["i"].iloc[0] != pdf["j"].iloc[0]:
        block = pdf["block"].to_numpy()
        s[block[:, None] == block[None, :]] = -2
    return s


def joining(s: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Links that span the components of ``s`` at the threshold: one fewer than a component has members."""
    near = s >= threshold
    free = near.any(axis=1)
    i: list[int] = []
    j: list[int] = []
    for start in np.flatnonzero(free):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            i += [at] * len(new)
            j += new.tolist()
            todo += new.tolist()
    return i, j


def nearest(rep: np.ndarray, s: np.ndarray, threshold: float) -> pd.DataFrame:
    """The edges that stand in a list of ``LIST`` at one of their ends, and those that join at the threshold."""
    k = min(LIST, len(rep) - 1)
    if k < 1:
        return pd.DataFrame({"a": [], "b": [], "sim": [], "joins": []})
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    i, j = np.repeat(np.arange(len(rep)), k), top.ravel()
    more = joining(s, threshold)
    joins = np.append(np.zeros(len(i), bool), np.ones(len(more[0]), bool))
    i, j = np.append(i, more[0]).astype(int), np.append(j, more[1]).astype(int)
    keep = s[i, j] >= EXPLORE
    return edge_frame(rep[i[keep]], rep[j[keep]], s[i, j][keep], joins[keep])


def edge_frame(x: np.ndarray, y: np.ndarray, sim: np.ndarray, joins: np.ndarray) -> pd.DataFrame:
    """Edges with the smaller id first, each once; one that joins anywhere joins."""
    found = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "sim": sim, "joins": joins})
    return found.sort_values("joins", ascending=False).drop_duplicates(["a", "b"])


def meetings(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Edges between the members of each list in ``pdf`` (centre, rep, sim, fresh, v), where either is fresh.

    Links join unless both ends link with the centre, by which they are connected already.
    """
    pdf = pdf.sort_values("centre")
    m, rep, fresh = unit(pdf["v"]), pdf["rep"].to_numpy(), pdf["fresh"].to_numpy(bool)
    tied = pdf["sim"].to_numpy() >= threshold
    _, start, size = np.unique(pdf["centre"].to_numpy(), return_index=True, return_counts=True)
    width = int(size.max())
    at = np.where(np.arange(width) < size[:, None], start[:, None] + np.arange(width), -1)
    upper = np.triu(np.ones((width, width), bool), 1)
    step = max(1, 4_000_000 // (width * max(width, m.shape[1])))
    parts = []
    for p in (at[k : k + step] for k in range(0, len(at), step)):
        x, there = m[p], p >= 0
        s = x @ x.transpose(0, 2, 1)
        good = (s >= EXPLORE) & upper & there[:, :, None] & there[:, None, :] & (fresh[p][:, :, None] | fresh[p][:, None, :])
        c, i, j = np.nonzero(good)
        i2, j2 = p[c, i], p[c, j]
        parts.append(edge_frame(rep[i2], rep[j2], s[c, i, j], (s[c, i, j] >= threshold) & ~(tied[i2] & tied[j2])))
    found = pd.concat(parts)
    return edge_frame(found["a"].to_numpy(), found["b"].to_numpy(), found["sim"].to_numpy(), found["joins"].to_numpy())


EDGES = "a long, b long, sim double, joins boolean"


def leaf_edges(nodes: DataFrame, tables: range, threshold: float) -> DataFrame:
    """Edges of the leaves of some tables; vectors join late, so they travel once a table."""
    rows = leaves(nodes, tables).join(nodes.select("rep", "v"), "rep")
    groups = rows.groupBy("label", "dim", "place", "leaf", "part")
    return groups.applyInPandas(lambda pdf: nearest(pdf["rep"].to_numpy(), cosines(pdf), threshold), EDGES)


def all_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges with each label as one leaf, compared whole in blocks."""
    keys = ["label", "dim"]
    large = nodes.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    groups = in_blocks(nodes.select(*keys, "rep", "v"), keys, large).groupBy(*keys, "i", "j")
    return groups.applyInPandas(lambda pdf: nearest(pdf["rep"].to_numpy(), cosines(pdf), threshold), EDGES)


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("a", "b", "sim", *more).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", *more))


def lists(edges: DataFrame, threshold: float, *more: str) -> DataFrame:
    """(a, b, sim, r): each class's nearest, ``LIST`` of them, or as many links as there are up to ``LONGEST``."""
    rows = both_ways(edges, *more).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return rows.where((F.col("r") <= LIST) | ((F.col("r") <= LONGEST) & (F.col("sim") >= threshold)))


def merged(old: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b, sim, joins, fresh) cut to the lists' length, but for those that join; ``fresh``: not in ``old``."""
    rows = old.select("a", "b", "sim", "joins", F.lit(False).alias("fresh")).union(found.select("a", "b", "sim", "joins", F.lit(True)))
    rows = rows.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("joins").alias("joins"), F.min("fresh").alias("fresh"))
    # each edge stands once at each end, so in one list, in both, or in none
    both = both_ways(rows, "joins", "fresh").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    kept = (F.col("r") <= LIST) | ((F.col("r") <= LONGEST) & (F.col("sim") >= threshold)) | F.col("joins")
    kept = both.where(kept).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim", "joins", "fresh")
    return materialize(kept.distinct(), "edges")


def descend(nodes: DataFrame, groups: int, edges: DataFrame, threshold: float) -> DataFrame:
    """Edges that the members of each list make with one another; lists without a fresh entry rest.

    So do lists with no room left: their members are of one component by them, and that is compared whole anyway.
    Many lists go to Python together, as many to a group as make up some megabytes of vectors.
    """
    own = lists(edges, threshold, "fresh")
    awake = own.groupBy("a").agg(F.max("fresh").alias("fresh"), F.count_if(F.col("sim") >= threshold).alias("n")).where("fresh").where(F.col("n") < LONGEST)
    own = own.join(awake.select("a"), "a", "left_semi").select(F.col("a").alias("centre"), F.col("b").alias("rep"), "sim", "fresh")
    local = own.join(nodes.select("rep", "v"), "rep").withColumn("group", F.pmod(F.xxhash64("centre"), F.lit(groups)))
    return local.groupBy("group").applyInPandas(lambda pdf: meetings(pdf, threshold), EDGES)


def settle(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Rounds of descent until hardly a list entry is fresh and no link is."""
    groups = max(1, nodes.count() // GROUP)
    while True:
        count = edges.agg(F.count("*"), F.count_if("fresh"), F.count_if(F.col("fresh") & (F.col("sim") >= threshold))).first()
        if not count[2] and count[1] <= STILL * count[0]:
            return edges
        last, edges = edges, merged(edges, descend(nodes, groups, edges, threshold), threshold)
        discard(last)


def counted(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(rep, comp, links): each linked class's component, and how many vectors of other classes it links with.

    Lists with room hold all links; a component with a list that never had room is compared whole, in blocks.
    """
    links = edges.where(F.col("sim") >= threshold)
    comp = materialize(connected_components(links), "comp").withColumnRenamed("node", "rep")
    full = both_ways(links).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n")).where(F.col("n") >= LONGEST)
    dense = materialize(comp.join(full, "rep", "left_semi").select("comp").distinct(), "dense")
    mult = nodes.select(F.col("rep").alias("b"), "mult")
    listed = both_ways(links).join(mult, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("mult").alias("links"))
    listed = comp.join(dense, "comp", "left_anti").join(listed, "rep").select("rep", "comp", "links")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        s = cosines(pdf) >= threshold
        return pd.DataFrame({"rep": pdf["rep"], "comp": pdf["comp"], "links": s @ pdf["mult"].to_numpy(np.int64)})

    rest = comp.join(dense, "comp", "left_semi")
    large = rest.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    members = in_blocks(rest, ["comp"], large).join(nodes.select("rep", "v", "mult"), "rep")
    whole = members.groupBy("comp", "i", "j").applyInPandas(count, "rep long, comp long, links long").groupBy("rep", "comp").agg(F.sum("links").alias("links"))
    return materialize(listed.union(whole), "links")


def audit(nodes: DataFrame, edges: DataFrame, found: DataFrame, threshold: float) -> list[tuple[str, int, int, int]]:
    """(kind, classes drawn, their true links, those found) of each kind of class; the truth is counted over all rows.

    At most ``AUDIT_ROWS`` classes are drawn of each of four kinds: lists full of links, some links, no link but a
    neighbour within a tenth of the threshold, and none.
    """
    near = both_ways(edges).groupBy(F.col("a").alias("rep")).agg(F.max("sim").alias("best"))
    kind = F.when(F.col("links") >= LIST, "full").when(F.col("links") > 0, "linked").when(F.col("best") >= threshold - 0.1, "near").otherwise("none")
    kinds = materialize(nodes.select("rep").join(found, "rep", "left").join(near, "rep", "left").select("rep", kind.alias("kind"), "links"), "kinds")
    sizes = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    # a draw by hash of about twice as many first, so that the ordering is over few rows
    few = F.pmod(F.xxhash64("rep", F.lit(26)), F.lit(1 << 30)) * F.col("n") < F.lit(2.0 * AUDIT_ROWS * (1 << 30))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("rep"))
    drawn = kinds.join(F.broadcast(sizes), "kind").where(few).withColumn("r", F.row_number().over(order))
    drawn = materialize(drawn.where(F.col("r") <= AUDIT_ROWS).select("rep", "kind", "links"), "drawn")
    # at most four times AUDIT_ROWS vectors
    sample = nodes.join(F.broadcast(drawn), "rep").select("rep", "label", "dim", "v").toPandas()
    if not len(sample):
        return []

    def run(batches):
        for pdf in batches:
            for (label, dim), part in pdf.groupby(["label", "dim"]):
                own = sample[(sample["label"] == label) & (sample["dim"] == dim)]
                if len(own):
                    s = unit(own["v"]) @ unit(part["v"]).T
                    s[own["rep"].to_numpy()[:, None] == part["rep"].to_numpy()[None, :]] = -2
                    yield pd.DataFrame({"rep": own["rep"], "true": (s >= threshold) @ part["mult"].to_numpy(np.int64)})

    true = nodes.mapInPandas(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    both = true.join(drawn, "rep").groupBy("kind").agg(F.count("*").alias("n"), F.sum("true").alias("t"), F.sum(F.coalesce("links", F.lit(0))).alias("f"))
    return [(r.kind, r.n, r.t, r.f) for r in both.orderBy("kind").collect()]


def recall(audited: list[tuple[str, int, int, int]]) -> float:
    """The least share of true links found in any sample that has some; without any, nothing was there to miss."""
    return min((f / t for _, _, t, f in audited if t), default=1.0)


def search(nodes: DataFrame, threshold: float, report: Callable[[dict], None] | None = None) -> DataFrame:
    """(rep, comp, links) of all linked classes. ``report`` is told of each effort: its tables and what the audit says."""
    most = most_tables(nodes.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    none = nodes.sparkSession.createDataFrame([], EDGES)
    edges, have = none, 0
    while True:
        want = min(most, max(TABLES, 2 * have))
        last = have >= most
        made = all_edges(nodes, threshold) if last else leaf_edges(nodes, range(have, want), threshold)
        edges = settle(nodes, merged(edges, made, threshold), threshold)
        found = counted(nodes, edges, threshold)
        said = [] if last else audit(nodes, edges, found, threshold)
        if report:
            report({"tables": have if last else want, "whole": last, "audit": said, "recall": 1.0 if last else recall(said)})
        if last or recall(said) >= RECALL:
            return found
        have = want


def links(df: DataFrame, threshold: float = THRESHOLD, report: Callable[[dict], None] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df`` (vec_id, label, embedding).

    Vectors that ``usable`` refuses, and rows with a null label or id, link with nothing; vectors of different
    lengths never meet. Repeated rows link with each other, also where they share an id. Equal cosines are ordered by
    id. An empty table gives no rows; other columns are not read, so their names never clash.
    """
    nodes = materialize(classes(df), "nodes")
    found = search(nodes, threshold, report)
    labelled = nodes.join(found, "rep", "left").select("label", "v", "mult", F.coalesce("comp", "rep").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
    good = usable("embedding") & F.col("vec_id").isNotNull()
    rows = df.select("vec_id", "label", F.when(good, F.col("embedding")).alias("v"))
    out = rows.join(labelled, ["label", "v"], "left")
    component = F.coalesce("comp", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("mult") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
