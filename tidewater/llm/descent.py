"""Embedding near-dedup: NN-descent over representatives of tight cells, exact link counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, components, save

SEED = 42
#: Neighbours that a list holds before it is enlarged.
NEIGHBOURS = 8
#: A saturated list is enlarged by this factor.
ENLARGE = 4
#: Tables of random hyperplanes that seed the graph, and vectors that a bucket holds on average at least.
TABLES, BUCKET = 12, 32
#: Vectors of a bucket or a cell that are compared as one block.
BLOCK = 128
#: What the cosine of two vectors rounded to 8 bits may be off.
SLACK = 0.02
#: Vectors that the audit compares with all others, about; they go to every task.
AUDITED = 2000
#: Rounds without more than this growth of near pairs end the descent.
SETTLED = 0.001
MOST_ROUNDS = 12


@dataclass
class Links:
    """What ``near_duplicates`` found: one row per vector, and the audited recall (1 if nothing links)."""

    rows: DataFrame
    recall: float


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def usable(vec: str, dim: int) -> Column:
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def small(vec: str) -> Column:
    """The vector rounded to 8 bits of its largest component; enough to steer the descent."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    return F.transform(vec, lambda x: F.round(x.cast("double") / top * 127).cast("byte"))


def signatures(nodes: DataFrame, dim: int, bits: int, tables: int, seed: int) -> DataFrame:
    """(node, small, t, sig): the sides of ``bits`` random hyperplanes in each table."""
    planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
    weights = (np.int64(1) << np.arange(bits)).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = matrix(batch.column(1), dim) @ planes > 0
            sigs = (side.reshape(len(side), tables, bits) * weights).sum(axis=2)
            offsets = np.arange(len(side) + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, sigs.ravel())], names=["node", "small", "sigs"])

    made = nodes.select("node", "small").mapInArrow(each, "node long, small array<byte>, sigs array<long>")
    return made.select("node", "small", F.posexplode("sigs").alias("t", "sig"))


def with_cosine(pairs: DataFrame, dim: int, keep: str) -> DataFrame:
    """The columns ``keep`` (their schema) of pairs with the cosine of their columns x and y."""
    names = [c.split()[0] for c in keep.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = (matrix(batch.column("x"), dim) * matrix(batch.column("y"), dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(cosine)], names=[*names, "cos"])

    return pairs.select(*names, "x", "y").mapInArrow(each, keep + ", cos double")


def cells(nodes: DataFrame, marks: DataFrame, buckets: DataFrame, dim: int, within: float) -> DataFrame:
    """(node, pivot, cos): every node with the pivot of its cell, which may be itself.

    A node's pivot is the least leader of its buckets that leads no pivot itself and has a cosine
    of ``within`` with it, so that all nodes of a cell link with each other.
    """
    led = marks.join(buckets.select("t", "sig", "first"), ["t", "sig"]).where("node > first.node")
    tied = with_cosine(led.select("node", F.col("first.node").alias("pivot"), F.col("small").alias("x"), F.col("first.small").alias("y")), dim, "node long, pivot long")
    ties = save(tied.where(F.col("cos") >= within - SLACK).select("node", "pivot").distinct(), "ties")
    vec = nodes.select("node", F.col("vec"))
    both = ties.join(vec.withColumnRenamed("vec", "x"), "node").join(vec.select(F.col("node").alias("pivot"), F.col("vec").alias("y")), "pivot")
    sure = save(with_cosine(both, dim, "node long, pivot long").where(F.col("cos") >= within), "sure")
    free = sure.join(sure.select(F.col("node").alias("pivot")).distinct(), "pivot", "left_anti")
    chosen = free.groupBy("node").agg(F.min(F.struct("pivot", "cos")).alias("p")).select("node", "p.pivot", "p.cos")
    return nodes.select("node").join(chosen, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("cos", F.lit(1.0)).alias("cos"))


def joined_locally(groups: DataFrame, dim: int, limit: float, top: int) -> DataFrame:
    """(v, u, cos, near): for each acting member of a group its best others among the new pairs.

    groups: (members array<struct<node, small, reach, low, k, new, act>>).  near tells whether
    members of the two cells may link, low the cosine that a pair has to exceed to matter.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            field = lambda n: flat.field(n).to_numpy(zero_copy_only=False)
            x = matrix(flat.field("small"), dim).astype(np.float32)
            node, reach, low, most, new, act = (field(n) for n in ("node", "reach", "low", "k", "new", "act"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
                if hi - lo < 2 or not new[lo:hi].any():
                    continue
                cosine = x[lo:hi] @ x[lo:hi].T
                better = (cosine > low[lo:hi, None]) & (new[lo:hi, None] | new[None, lo:hi]) & (act[lo:hi, None]) & (node[lo:hi, None] != node[None, lo:hi])
                n = int(max(top, most[lo:hi].max()))
                if hi - lo > n + 1:
                    cut = -np.partition(-np.where(better, cosine, -2), n - 1, axis=1)[:, n - 1]
                    better &= cosine >= cut[:, None]
                a, b = np.nonzero(better)
                c = cosine[a, b].astype(np.float64)
                near = angle(np.minimum(c + SLACK, 1)) <= limit + reach[lo:hi][a] + reach[lo:hi][b]
                for col, v in zip(out, (node[lo:hi][a], node[lo:hi][b], c, near), strict=True):
                    col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["v", "u", "cos", "near"])

    return groups.select("members").mapInArrow(each, "v long, u long, cos double, near boolean")


def best(pairs: DataFrame) -> DataFrame:
    """Each node's k best pairs; a pair that was there before is not new."""
    dealt = pairs.repartition("v").groupBy("v", "u").agg(F.max("cos").alias("cos"), F.max("near").alias("near"), F.min("new").alias("new"), F.max("k").alias("k"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cos"), "u"))
    limit = F.max("k").over(Window.partitionBy("v"))
    return dealt.withColumns({"k": limit, "rank": rank}).where("rank <= k").drop("rank")


class Descent:
    """The neighbour graph of the pivots, refined round by round."""

    def __init__(self, pivots: DataFrame, dim: int, limit: float, k: int) -> None:
        self.pivots, self.dim, self.limit, self.k = pivots, dim, limit, k
        self.graph: DataFrame | None = None

    def seed(self, marks: DataFrame, buckets: DataFrame) -> None:
        """Pairs of the pivots that share a bucket; buckets of many are dealt into blocks."""
        parts = F.ceil(F.col("n") / BLOCK)
        part = F.when(parts > 1, F.pmod(F.xxhash64("node", "t"), parts)).otherwise(0)
        rows = marks.join(self.pivots.select("node", "reach"), "node").join(buckets.where("n > 1").select("t", "sig", "n"), ["t", "sig"]).withColumn("part", part)
        members = F.struct("node", "small", "reach", F.lit(-1.0).alias("low"), F.lit(self.k).alias("k"), F.lit(True).alias("new"), F.lit(True).alias("act"))
        groups = rows.groupBy("t", "sig", "part").agg(F.collect_list(members).alias("members"))
        found = joined_locally(groups, self.dim, self.limit, self.k).withColumns({"new": F.lit(True), "k": F.lit(self.k)})
        old = found if self.graph is None else self.graph.union(found)
        self.graph = save(best(old), "graph")

    def near(self) -> int:
        return self.graph.where("near").count()

    def round(self, wide_only: bool) -> None:
        """Join the neighbours of each node, listed and listing, with each other."""
        graph = self.graph
        lows = graph.groupBy("v").agg(F.count("*").alias("n"), F.min("cos").alias("least"), F.max("k").alias("k"))
        state = self.pivots.select("node", "small", "reach").join(lows.withColumnRenamed("v", "node"), "node").withColumn("low", F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(-1.0)).drop("n", "least")
        # of those that list a node, about k take part; a hub's are chosen by hash
        listing = graph.groupBy("u").agg(F.count("*").alias("n"), F.max("k").alias("most"))
        some = graph.join(listing, "u").where(F.pmod(F.xxhash64("v", "u"), F.col("n")) < F.col("most"))
        around = graph.select(F.col("v").alias("c"), F.col("u").alias("node"), "new").union(some.select(F.col("u").alias("c"), F.col("v").alias("node"), "new"))
        around = around.groupBy("c", "node").agg(F.max("new").alias("new"))
        # a node of an enlarged list is in so many neighbourhoods that it acts in some of them only
        turn = F.pmod(F.xxhash64("c", "node"), F.greatest(F.lit(1), (F.col("k") / self.k).cast("int"))) == 0
        act = turn & (F.col("k") > self.k) if wide_only else turn
        members = F.struct("node", "small", "reach", "low", "k", "new", act.alias("act"))
        groups = around.join(state, "node").groupBy("c").agg(F.collect_list(members).alias("members")).where(F.exists("members", lambda m: m["new"]) & F.exists("members", lambda m: m["act"]))
        found = joined_locally(groups, self.dim, self.limit, self.k)
        found = (found.where("near") if wide_only else found).withColumns({"new": F.lit(True), "k": F.lit(0)})
        old = graph.withColumn("new", F.lit(False)).select("v", "u", "cos", "near", "new", "k")
        self.graph = save(best(old.union(found)), "graph")

    def settle(self, wide_only: bool = False) -> None:
        before = self.near()
        for done in range(MOST_ROUNDS):
            self.round(wide_only)
            now = self.near()
            if now - before <= SETTLED * before and (done or wide_only):
                break
            before = now

    def enlarge(self) -> bool:
        """Enlarge the lists that hold near pairs only; tells whether there were any."""
        full = self.graph.groupBy("v").agg(F.min("near").alias("all"), F.count("*").alias("n"), F.max("k").alias("most")).where("all and n >= most").select("v")
        full = save(full.withColumn("wide", F.lit(True)), "saturated")
        if full.isEmpty():
            return False
        wide = F.coalesce("wide", F.lit(False))
        self.graph = save(self.graph.join(full, "v", "left").select("v", "u", "cos", "near", wide.alias("new"), F.when(wide, F.col("k") * ENLARGE).otherwise(F.col("k")).alias("k")), "graph")
        return True


def cell_links(members: DataFrame, pairs: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(p, q, node, links): exact numbers of links of a node across two cells, in double precision.

    members: (node, pivot, mult, vec).  Cells are dealt into blocks, and blocks meet as rows.
    """
    used = pairs.select(F.col("p").alias("pivot")).union(pairs.select(F.col("q").alias("pivot"))).distinct()
    own = members.join(used, "pivot")
    size = own.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = own.join(size, "pivot").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0))
    blocks = save(dealt.groupBy("pivot", "part").agg(F.collect_list(F.struct("node", "mult", "vec")).alias("block")), "cells")
    left = blocks.select(F.col("pivot").alias("p"), F.col("block").alias("x"))
    right = blocks.select(F.col("pivot").alias("q"), F.col("block").alias("y"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("x", "y"):
                flat = batch.column(name).flatten()
                ends = np.cumsum(batch.column(name).value_lengths().to_numpy(zero_copy_only=False))
                sides.append((matrix(flat.field("vec"), dim), flat.field("node").to_numpy(), flat.field("mult").to_numpy(), np.r_[0, ends]))
            (a, an, am, ae), (b, bn, bm, be) = sides
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, (p, q) in enumerate(zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)):
                s, t = slice(ae[i], ae[i + 1]), slice(be[i], be[i + 1])
                linked = a[s] @ b[t].T >= threshold
                for names, n in ((an[s], linked @ bm[t]), (bn[t], am[s] @ linked)):
                    some = n > 0
                    for col, v in zip(out, (np.full(some.sum(), p), np.full(some.sum(), q), names[some], n[some]), strict=True):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["p", "q", "node", "links"])

    met = pairs.join(left, "p").join(right, "q")
    arrow_rows(pairs.sparkSession, 64)
    return met.select("p", "q", "x", "y").mapInArrow(each, "p long, q long, node long, links long")


#: Audited recall below which there is no result.
LEAST_RECALL = 0.9


def audit(nodes: DataFrame, counted: DataFrame, dim: int, threshold: float, total: int, audited: int) -> float:
    """The part of the true links that was found for about ``audited`` nodes, chosen by hash: of all their links or as the nodes' mean, the lesser."""
    spark = nodes.sparkSession
    chosen = nodes.where(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(max(1, total // audited))) == 0)
    rows = chosen.select("node", "vec").limit(4 * audited).toPandas()
    if rows.empty:
        return 1.0
    x = np.array(rows["vec"].tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    shipped = spark.sparkContext.broadcast(x / np.linalg.norm(x, axis=1, keepdims=True))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        n = np.zeros(len(asked), np.int64)
        for batch in batches:
            n += (asked @ matrix(batch.column(0), dim).T >= threshold) @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["i", "n"])

    true = nodes.select("vec", "mult").mapInArrow(each, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas().sort_values("i")["n"].to_numpy() - 1
    found = chosen.select("node").join(counted, "node").select("node", "n_links").limit(4 * audited).toPandas().set_index("node")["n_links"]
    found = rows["node"].map(found).fillna(0).to_numpy()
    some = true > 0
    if not some.any():
        return 1.0
    return float(min(found.sum() / true.sum(), (found[some] / true[some]).mean()))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, k: int = NEIGHBOURS, least_recall: float = 0.99, tries: int = 6,
) -> Links:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``, with the audited recall.

    Rows link at a cosine of ``threshold`` or more, in double precision.  Equal vectors are
    compared once.  Tight groups become cells around pivots, all of whose members link, so that
    large groups of near copies need no pairs.  NN-descent over the pivots, seeded by
    hyperplane buckets, joins neighbours of neighbours until no more near pairs appear; lists
    that are full of near pairs are enlarged.  Cells whose pivots are near meet in
    blocks, and only links that exist are counted.  About AUDITED nodes are compared with all
    others; while the recall is below ``least_recall``, the graph is seeded anew with other hyperplanes, ``tries`` times
    in all.  A result whose audited recall then is below LEAST_RECALL is not returned: that is an error.

    n_links counts the other rows linked directly, component_id is the least id that links reach.
    Null, zero and non-finite vectors, those with null components or of another length than the
    commonest, and rows with a null id link with nothing.  Repeated rows count as vectors of
    their own; other columns are dropped.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    if not 0 < threshold < 1:
        raise ValueError("the threshold has to lie between 0 and 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    common = rows.where("vec is not null").groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = max(1, common.dim) if common else 1
    rows = rows.withColumn("ok", usable("vec", dim) & F.col("vec_id").isNotNull())
    distinct = rows.where("ok").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    nodes = save(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("small", small("vec")), "nodes")
    total = nodes.count()
    limit = math.acos(threshold)
    within = math.cos(limit / 2) + 1e-6
    bits = max(1, min(30, int(math.log2(max(2, total / BUCKET)))))
    descent = None
    recall = 0.0
    for attempt in range(tries):
        arrow_rows(spark)
        marks = save(signatures(nodes, dim, bits, TABLES, SEED + attempt), "marks")
        buckets = save(marks.groupBy("t", "sig").agg(F.min(F.struct("node", "small")).alias("first"), F.count("*").alias("n")), "buckets")
        if descent is None:
            celled = save(cells(nodes, marks, buckets, dim, within), "celled")
            radius = celled.groupBy("pivot").agg(F.acos(F.least(F.min("cos"), F.lit(1.0))).alias("reach"), F.count("*").alias("n"))
            pivots = save(nodes.select("node", "small").join(radius.withColumnRenamed("pivot", "node"), "node").drop("n"), "pivots")
            members = save(celled.join(nodes.select("node", "mult", "vec"), "node"), "members")
            descent = Descent(pivots, dim, limit, k)
        descent.seed(marks, buckets)
        descent.settle()
        while descent.enlarge():
            descent.settle(wide_only=True)
        pairs = descent.graph.where("near").select(F.greatest("v", "u").alias("p"), F.least("v", "u").alias("q")).distinct()
        links = save(cell_links(members, save(pairs, "near"), dim, threshold), "links")
        inner = members.groupBy("pivot").agg(F.sum("mult").alias("inside"))
        crossed = links.groupBy("node").agg(F.sum("links").alias("across"))
        counted = save(
            members.select("node", "pivot").join(inner, "pivot").join(crossed, "node", "left").select("node", (F.col("inside") - 1 + F.coalesce("across", F.lit(0))).alias("n_links")), "counted",
        )
        recall = audit(nodes, counted, dim, threshold, total, AUDITED)
        if recall >= least_recall:
            break
    if recall < min(LEAST_RECALL, least_recall):
        raise RuntimeError(f"only {recall:.3f} of the audited links were found after {tries} seedings; ask for more tries or neighbours")
    edges = links.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    linked = components(edges.union(members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
    rooted = nodes.select("node", "vec", "least").join(linked, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").join(counted, "node").select("vec", "component_id", "n_links")
    found = rows.where("ok").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return Links(found.union(alone).select("vec_id", "n_links", "component_id", kept), recall)
