"""What the text operators share: scratch tables, Arrow access and components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold; documents are long, so batches stay small.
ARROW_ROWS = 1000
#: Bytes beyond which an Arrow batch takes no more rows.
ARROW_BYTES = 4 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Spark's setting that deletes the shuffles of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_tables: list[tuple[SparkSession, str]] = []
_lasting: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, and is a local one as in tests, a temporary folder
    of this process is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _own["dir"]


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder; it is deleted when the process ends.

    A ``lasting`` one outlives the ``tidy`` block that it is made in.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (_lasting if lasting else _tables).append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: later stages read files that outlive any executor, and
    the shuffles behind the table are deleted when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete a table that ``save`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, path)


@contextlib.contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that ``save`` writes inside the block, except those given to what it yields."""
    before, kept = len(_tables), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0] for f in df.inputFiles())
        return df

    yield keep
    inside = _tables[before:]
    del _tables[before:]
    for spark, path in inside:
        if any(k.endswith(path.rsplit("/", 1)[1]) for k in kept):
            _tables.append((spark, path))
        else:
            delete(spark, path)


Scratch = list[tuple[SparkSession, str]]


@contextlib.contextmanager
def owned(owner: Scratch) -> Iterator[None]:
    """Give ``owner`` the tables that ``save`` writes inside the block and leaves; it deletes them by ``drop``."""
    before = len(_tables)
    yield
    owner.extend(_tables[before:])
    _lasting.extend(_tables[before:])
    del _tables[before:]


def drop(owner: Scratch) -> None:
    """Delete an owner's tables, for a job that has written what it made of them."""
    for spark, path in owner:
        delete(spark, path)
        _lasting.remove((spark, path))
    owner.clear()


@atexit.register
def _clear() -> None:
    for spark, path in [*_tables, *_lasting]:
        with contextlib.suppress(Exception):
            delete(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole documents small, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Words whose hashes are made at once.
SLICE = 1 << 16


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text (separated by ASCII white space) begin and end."""
    code = np.frombuffer(raw, np.uint8)
    inside = ~((code == 32) | ((code >= 9) & (code <= 13)))
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased."""
    low, out = raw.translate(LOWER), np.zeros(len(start), np.uint64)
    for a in range(0, len(start), SLICE):
        b = min(a + SLICE, len(start))
        out[a:b] = np.fromiter(map(xxhash.xxh3_64_intdigest, low[start[a] : end[b - 1]].split()), np.uint64, b - a)
    return out


def star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b.

    Every node's neighbours are tied to the least of them.  Both steps are a
    minimum by key and a join on that key, so no neighbourhood is gathered.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (
        both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where(F.col("a") > F.col("b")).distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long).

    Returns (node, component) for every node with an edge; component is the
    least node that can be reached.  Nulls and loops are ignored.  Rounds of
    large-star and small-star steps are written to the shared folder until the
    edges stay the same; their number grows as the logarithm of the longest path.
    """
    now = save(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        then = save(star(now), "edges")
        after = mark(then)
        forget(now)
        now = then
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


#: Members of a group whose sketches one block holds.
MEET = 1024
#: Texts of a group, and distinct shingles of them, that one block of exact comparisons holds at most (a text of more is a block alone).
SIDE, WEIGHT = 256, 1 << 21
#: One more of a cluster's nodes is compared with all of it at first for so many that a block holds.
LEADS = 16
#: Pairs or counts that are worked out at once.
AT_ONCE = 1 << 21


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in pieces that split no group; rows come sorted by their first column, the group's number."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[last is None or g[0] != last, g[1:] != g[:-1]])
        last = g[-1]
        if not len(starts):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, starts[-1])]
        held = [batch.slice(starts[-1])]
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def in_groups(df: DataFrame, work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (a, b) that ``work`` finds in tables of whole groups of ``df``, whose first column is the group's number (g).

    A group's rows come by root, those of the main one first, so that groups which share nodes tie them to the same one.
    """
    spark = df.sparkSession
    arrow_rows(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            a, b = work(table)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return df.repartition("g").sortWithinPartitions("g", F.desc("main"), "root", "node").mapInArrow(each, "a long, b long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place among 0 to n - 1 that the edges (i, j) reach, for each place."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != label[label]).any():  # all the way: a place that isn't a root must not be tied anew
            label = label[label]
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def pairs_before(start: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places lo to hi - 1 with each place before them from start on."""
    o = np.arange(lo, hi) - start[lo:hi]
    i = np.repeat(np.arange(lo, hi), o)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(o) - o, o) + np.repeat(start[lo:hi], o)


def first_places(g: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each place that of the first row of its group and root; rows of one root lie together."""
    new = np.r_[True, (g[1:] != g[:-1]) | (root[1:] != root[:-1])]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def sketched(table: pa.Table, name: str = "sketch") -> np.ndarray:
    raw = table[name].to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def met(close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """Ties of roots of (g, asks, root, main, node, sketch) that have close sketches and one of which asks: fewer than roots in a group, and they connect all such."""

    def work(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        g, asks, root = (table[c].to_numpy() for c in ("g", "asks", "root"))
        sketch, n = sketched(table), len(g)
        place = first_places(g, root)
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        start = np.repeat(first, np.diff(np.r_[first, n]))
        until = np.cumsum(np.arange(n) - start)
        found_i, found_j, lo = [], [], 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            i, j = pairs_before(start, lo, hi)
            ask = (asks[i] | asks[j]) & (root[i] != root[j])
            i, j = i[ask], j[ask]
            ok = close(sketch[i], sketch[j])
            found_i.append(place[i[ok]])
            found_j.append(place[j[ok]])
            lo = hi
        label = forest(n, np.concatenate(found_i), np.concatenate(found_j))
        some = np.flatnonzero(label != np.arange(n))
        return root[some], root[label[some]]

    return work


def common_counts(flat: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values two different sets of ``left`` and of ``right`` have in common; value flat[i] is in set owner[i], once."""
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # most values are in one set only
    at, owner, values = (np.cumsum(shared) - 1)[at[shared[at]]], owner[shared[at]], values[shared]
    out = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = max(1, AT_ONCE // max(n, 1))
    for lo in range(0, len(values), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        part = np.zeros((n, min(width, len(values) - lo)), np.float32)
        part[owner[a:b], at[a:b] - lo] = 1
        out += part[left] @ part[right].T
    return out


def compared(similar: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """Ties of roots of (g, asks, root, main, node, shingles), of which one asks, where nodes are similar; they connect all such."""

    def work(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        g, asks, root = (table[c].to_numpy() for c in ("g", "asks", "root"))
        lists = table["shingles"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo, hi in zip(starts, np.r_[starts[1:], len(g)], strict=True):
            n, size = hi - lo, np.diff(offsets[lo : hi + 1])
            left, right = np.flatnonzero(asks[lo:hi]), np.arange(n)
            if not len(left) or n < 2:
                continue
            counts = common_counts(flat[offsets[lo] : offsets[hi]], np.repeat(right, size), n, left, right)
            ok = similar(counts, size[left][:, None], size[right][None, :]) & (root[lo:hi][left][:, None] != root[lo:hi][None, :])
            i, j = np.nonzero(ok)
            place = first_places(g[lo:hi], root[lo:hi])
            label = forest(n, place[left[i]], place[j])
            some = np.flatnonzero(label != right)
            found.append((root[lo:hi][some], root[lo:hi][label[some]]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    return work


def block_of(node: str, n: Column) -> Column:
    """A block's number below n for each node."""
    return F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.greatest(n.cast("long"), F.lit(1))).cast("int")


def everywhere() -> Column:
    """The numbers of all blocks of a group."""
    return F.sequence(F.lit(0), F.col("parts").cast("int") - 1)


def upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1))


def across(named: DataFrame) -> DataFrame:
    """(g, asks, root, main, node): in blocks, every node outside the main component of its group with all nodes of the group.

    named: (group, side, node, root), the nodes of a block and each node's component; the main one has the most nodes, and one
    of them is in all blocks, for others to be tied to.  Groups of one component have no rows.
    """
    named = save(named, "named")
    roots = named.groupBy("group", "root").agg(F.count("*").alias("m"), F.min("node").alias("seat"), F.max("side").alias("side"))
    apart = roots.groupBy("group").agg(F.max_by(F.struct("root", "seat"), F.struct("m", "root")).alias("most"), F.sum("m").alias("n"), F.max("m").alias("m"), F.max("side").alias("side"), F.count("*").alias("k")).where("k > 1")
    apart = save(apart.select("group", "most", F.ceil(F.col("n") / F.col("side")).alias("parts"), F.ceil((F.col("n") - F.col("m")) / F.col("side")).alias("asking")), "apart")
    rest = named.join(apart, "group").withColumn("main", F.col("root") == F.col("most.root"))
    part, ask = block_of("node", F.col("parts")), block_of("node", F.col("asking"))
    dealt = rest.withColumn("part", F.explode(F.when(F.col("node") == F.col("most.seat"), everywhere()).otherwise(F.array(part))))
    told = dealt.select("group", "root", "main", "node", "part", F.lit(False).alias("asks"), upto(F.col("asking")).alias("ask"))
    asked = rest.where("not main").select("group", "root", "main", "node", upto(F.col("parts")).alias("part"), F.lit(True).alias("asks"), ask.alias("ask"))
    return told.unionByName(asked).select(F.xxhash64("group", "part", "ask").alias("g"), "asks", "root", "main", "node")


def shared_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of (g, root, node, shingles) the number of their shingles that a node of another root of their group has."""
    g, root = (table[c].to_numpy() for c in ("g", "root"))
    lists = table["shingles"].combine_chunks()
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(g)), size)
    order = np.lexsort((root[owner], flat, g[owner]))
    value, whose, of = flat[order], root[owner][order], g[owner][order]
    starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])][: len(order)])
    ends = np.r_[starts[1:], len(order)][: len(starts)]
    several = np.repeat(whose[starts] != whose[ends - 1], ends - starts)
    return table["node"].to_numpy(), np.bincount(owner[order], weights=several, minlength=len(g)).astype(np.int64)


def able(named: DataFrame, texts: DataFrame, similar: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of (group, side, node, root, size) that can be similar to a node of another root of their group.

    All that a node has in common with any of these are the shingles that some of these have; where it would not be similar
    even to exactly those, it has no link.  A group's shingles are dealt by value, as many to a task as a block holds.
    """
    spark = named.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, root, node, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            size, flat = np.diff(batch.column(4).offsets.to_numpy()), batch.column(4).flatten().to_numpy()
            owner = np.repeat(np.arange(len(node)), size)
            part = ((flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts[owner]
            order = np.lexsort((part, owner))
            flat, owner, part = flat[order], owner[order], part[order]
            at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])][: len(order)])
            of = owner[at]
            g = group[of] ^ (part[at] * np.int64(-7046029254386353131))
            made = [pa.array(x, pa.int64()) for x in (g, root[of], node[of])]
            yield pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(np.r_[at, len(order)].astype(np.int32), pa.array(flat))], names=["g", "root", "node", "shingles"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in shared_counts(table)], names=["node", "common"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, common = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(similar(common, size, np.maximum(common, 1))))], names=["node"])

    arrow_rows(spark)
    parts = named.groupBy("group").agg(F.ceil(F.sum("size") / WEIGHT).alias("parts"), F.countDistinct("root").alias("k")).where("k > 1").drop("k")
    dealt = named.join(parts, "group").join(texts, "node").select("group", "root", "node", "parts", "shingles").mapInArrow(cut, "g long, root long, node long, shingles array<long>")
    counts = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(count, "node long, common long").groupBy("node").agg(F.sum("common").alias("common"))
    some = named.select("node", "size").join(counts, "node").select("node", "size", "common").mapInArrow(judge, "node long")
    return named.join(some, "node")


def widened(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after further ties of their roots."""
    return found if more.isEmpty() else components(found.toDF("a", "b").union(more))


def linked(
    marked: DataFrame, sketches: DataFrame, sets: Callable[[DataFrame], DataFrame],
    close: Callable[[np.ndarray, np.ndarray], np.ndarray], similar: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """(node, component) of nodes that links of similar nodes connect, among those that share a mark.

    marked: (mark long, node long), sketches: (node, sketch binary of one length, size), each node once; ``sets`` gives the
    (node, shingles array<long>, distinct ones) of some nodes.  Nodes that share a mark and whose sketches are ``close`` are
    candidates, and candidates that connect make a cluster.  A mark of more than MEET nodes is dealt into blocks, all of which have its
    least node; then nodes of different components still meet, as they do in clusters.  A cluster that one block holds has all its
    pairs compared exactly.  In a larger one every node is compared with some of its nodes first; then all pairs of nodes that lie
    in different components still are, except those of the largest component, in blocks: a node outside it meets everything of
    its cluster, but for nodes that have too few shingles in common with all other components together (see ``able``).
    ``similar(common, n, m)`` decides by the numbers of shingles; it has to hold for more in common, and for fewer shingles, where
    it holds.  So no link between candidates is lost; rows grow with the nodes and, for marks and clusters
    that stay apart though they have most shingles in common, with the nodes outside the largest component times the blocks.  Pairs are no rows, and ties are
    those of components, to the main one where it is among them: where all of a group is similar in the end, a node has few.
    """
    with tidy() as keep:
        return keep(save(_linked(marked, sketches, sets, close, similar), "linked"))


def _linked(marked, sketches, sets, close, similar) -> DataFrame:  # noqa: ANN001
    parts = F.ceil(F.col("n") / MEET)
    often = save(marked.groupBy("mark").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").select("mark", "lead", parts.alias("parts")), "often")

    def meet(dealt: DataFrame) -> DataFrame:
        return in_groups(dealt.join(sketches.select("node", "sketch"), "node").select("g", "asks", "root", "main", "node", "sketch"), met(close))

    part = F.explode(F.when(F.col("node") == F.col("lead"), everywhere()).otherwise(F.array(block_of("node", F.col("parts")))))
    dealt = marked.join(often, "mark").select("mark", "node", part.alias("part"))
    near = components(meet(dealt.select(F.xxhash64("mark", "part").alias("g"), F.lit(True).alias("asks"), F.col("node").alias("root"), F.lit(False).alias("main"), "node")))
    wide = often.where("parts > 1")
    if not wide.isEmpty():
        named = marked.join(wide, "mark").join(near, "node", "left")
        named = named.select(F.col("mark").alias("group"), F.lit(MEET).alias("side"), "node", F.coalesce("component", "node").alias("root"))
        near = widened(near, save(meet(across(named)), "wide"))
    clusters = save(near.withColumnRenamed("component", "cluster").join(sketches.select("node", "size"), "node"), "clusters")
    texts = save(sets(clusters.select("node")), "sets")

    def exact(dealt: DataFrame) -> DataFrame:
        return in_groups(dealt.join(texts, "node").select("g", "asks", "root", "main", "node", "shingles"), compared(similar))

    side = F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.lit(WEIGHT) / F.greatest("most", F.lit(1)))))
    sized = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.max("size").alias("most")).select("cluster", F.ceil(F.col("n") / side).alias("parts"), side.alias("side"), "n")
    sized = save(sized, "sized")
    first = (F.pmod(F.xxhash64("node", F.lit(11)), F.ceil(F.col("n") * LEADS / F.col("side")).cast("long")) == 0) & (F.col("side") >= LEADS)
    rest = clusters.join(sized, "cluster").withColumn("asks", (F.col("parts") == 1) | (F.col("node") == F.col("cluster")) | first)
    part = F.when(F.col("asks"), everywhere()).otherwise(F.array(block_of("node", F.col("parts"))))
    star = rest.select("cluster", F.explode(part).alias("part"), "asks", "node")
    star = star.select(F.xxhash64("cluster", "part").alias("g"), "asks", F.col("node").alias("root"), F.lit(False).alias("main"), "node")
    found = components(exact(star))

    large = sized.where("parts > 1")
    if large.isEmpty():
        return found
    named = clusters.join(large, "cluster").join(found, "node", "left")
    named = save(named.select(F.col("cluster").alias("group"), "side", "node", F.coalesce("component", "node").alias("root"), "size"), "apart")
    return widened(found, save(exact(across(able(named, texts, similar).drop("size"))), "more"))
