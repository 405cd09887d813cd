"""LM scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SLICE, arrow_rows, as_bytes, forget, save, tidy, word_bounds

#: Longest contexts, in words.
DEPTH = 4
#: Occurrences in the training texts that make a run of words a context.
LEAST_CONTEXT = 8
#: Occurrences of a context with a symbol behind it that make the symbol one of the context's own.
LEAST_SYMBOL = 2
#: Natural-log divergence of a context's next symbols from its suffix's below which it is pruned.
DIVERGENCE = 0.05
#: Weight, in tokens, of the suffix's distribution in a context's own.
SMOOTHING = 5.0
#: Taken off each stored count for the benefit of the suffix's distribution, so that rare symbols don't use up a context's mass.
DISCOUNT = 0.75
#: The base's additive constant.
ADDED = 0.1
#: Tokens that a task adds up before it hands their counts on.
HELD = 2_000_000
#: Bits of a sieve (2 to this power). It only spares the joins keys that no table has; a fuller one lets more of them through.
SIEVE = 27
#: The commonest words, and runs of words, that every task looks up for itself; the others are joined.
CACHED_WORDS, CACHED_RUNS = 200_000, 1_000_000
#: Parts, by key, in which words and runs are looked up.
PARTS = 4
#: Rows of keys that one Arrow batch may hold.
KEY_ROWS = 100_000
#: Words of more bytes are hashed one by one.
SHORT = 64


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def mix(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs of words: of the run without its last word and the run without its first one."""
    h = (run ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) + word * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


#: The empty run.
EMPTY = np.zeros(1, np.uint64)
#: Flipped in the key of a word that is looked up for its count, not as a context.
COUNTED = np.uint64(0x5851F42D4C957F2D)
#: The end of a text, as the hash of a word.
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b""))
#: A random number for each value of a byte.
BYTES = np.random.default_rng(8).integers(0, 1 << 64, 256, np.uint64)


def hash_words(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``raw``, A-Z lower-cased: a byte of all words at a time, longest words first."""
    low = raw.translate(LOWER)
    code, out = np.frombuffer(low, np.uint8), np.empty(len(lo), np.uint64)
    for a in range(0, len(lo), SLICE):
        size = hi[a : a + SLICE] - lo[a : a + SLICE]
        short = np.where(size > SHORT, 0, size).astype(np.int16)
        order = np.argsort(-short, kind="stable")
        at, h = lo[a : a + SLICE][order], short[order].astype(np.uint64)
        left = np.searchsorted(-short[order], -np.arange(short.max(initial=0)), side="left")
        for k, m in enumerate(left):
            some = (h[:m] ^ BYTES[code[at[:m] + k]]) * np.uint64(0x9FB21C651E98DF25)
            h[:m] = some ^ (some >> np.uint64(32))
        out[a + order] = h
        for i in a + np.flatnonzero(size > SHORT):
            out[i] = xxhash.xxh3_64_intdigest(low[lo[i] : hi[i]])
    return out


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined hashes of the texts' words with their ends, starts and, for each token, the number of tokens before it in its text."""
    texts = [t or b"" for t in texts]
    raw = b"\n".join(texts)
    lo, hi = word_bounds(raw)
    of = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), lo, side="right") - 1
    n = np.bincount(of, minlength=len(texts))
    x = np.insert(hash_words(raw, lo, hi), np.cumsum(n), END_HASH)
    start = np.cumsum(n + 1) - (n + 1)
    return x, start, np.arange(len(x)) - np.repeat(start, n + 1)


def runs_of(x: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For 1 to ``most`` words the hashes of the runs that end at each place; those that begin before their text mean nothing."""
    run = mix(EMPTY, x)
    yield run
    for _ in range(1, most):
        run = mix(shifted(run), run)
        yield run


def shifted(run: np.ndarray) -> np.ndarray:
    """The run that ends one place before."""
    return np.r_[np.zeros(min(1, len(run)), np.uint64), run[:-1]]


def count_words(texts: DataFrame) -> DataFrame:
    """(key, c): occurrences of each word, and of the end, in (text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(mix(EMPTY, key).view(np.int64)), pa.array(c, pa.int64())], names=["key", "c"])

        for batch in batches:
            held.append(join_texts(as_bytes(batch.column(0)))[0])
            if sum(map(len, held)) > HELD:
                yield out()
        if held:
            yield out()

    return texts.mapInArrow(each, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def hashed(df: DataFrame) -> DataFrame:
    """A table of unique keys, to be joined by a hash table of each partition; what it is joined with needs no sort."""
    return df.hint("shuffle_hash")


def fetched(df: DataFrame, name: str) -> pa.Table:
    """The rows, through a table that is deleted at once; the shuffles behind it are too."""
    saved = save(df, name)
    rows = saved.toArrow()
    forget(saved)
    return rows


@contextlib.contextmanager
def large_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of many short rows; their bytes stay limited."""
    arrow_rows(spark, KEY_ROWS)
    yield
    arrow_rows(spark)


def sieve(keys: DataFrame) -> np.ndarray:
    """Bits of the leading parts of all (key): a bounded filter that passes every key of the table.

    Keys are dealt by their first byte, so no two tasks set bits of one word.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None
        for batch in batches:
            flags = np.zeros(1 << SIEVE, np.uint8) if flags is None else flags
            flags[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - SIEVE)] = 1
        if flags is not None:
            bits = np.packbits(flags, bitorder="little").view(np.int64)
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits[at])], names=["w", "b"])

    with large_batches(keys.sparkSession):
        rows = fetched(keys.select("key").repartition(F.shiftrightunsigned("key", 56)).mapInArrow(each, "w long, b long"), "sieve")
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - SIEVE)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def count_symbols(texts: DataFrame, shipped, depth: int) -> DataFrame:  # noqa: ANN001
    """(context, key, low, n): runs (key) of a context of ``depth`` words and a symbol, without those that occur too seldom.

    ``low`` is the run without its first word.  What has no such run below it, or no such context, has no place in the tree.
    Two sieves spare most of these the shuffle; joins find the others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, lower = shipped.value
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            context, low = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            _, at, n = np.unique(mix(context, low), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(context[at].view(np.int64)), pa.array(low[at].view(np.int64)), pa.array(n, pa.int64())], names=["context", "low", "n"])

        for batch in batches:
            x, _, first = join_texts(as_bytes(batch.column(0)))
            for run in runs_of(x, depth):
                pass
            before = shifted(run)
            some = np.flatnonzero(first >= depth)
            some = some[passes(contexts, before[some])]
            some = some[passes(lower, run[some])]
            held.append((before[some], run[some]))
            if sum(len(h[0]) for h in held) > HELD:
                yield out()
        if held:
            yield out()

    def added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        context, low, n = map(np.concatenate, zip(*held, strict=True))
        key = mix(context.view(np.uint64), low.view(np.uint64))
        order = np.argsort(key)
        at = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0][: len(key)])
        return context[order[at]], low[order[at]], np.add.reduceat(n[order], at) if len(at) else n

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, most = 0, HELD
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size > most:
                held = [added(held)]
                size, most = len(held[0][0]), max(HELD, 2 * len(held[0][0]))
        if held:
            context, low, n = added(held)
            context, low, n = (x[n >= LEAST_SYMBOL] for x in (context, low, n))
            key = mix(context.view(np.uint64), low.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (context, low, n, key)], names=["context", "low", "n", "key"])

    found = texts.mapInArrow(each, "context long, low long, n long").repartition("context", "low")
    return found.mapInArrow(merge, "context long, low long, n long, key long")


@dataclass
class Tree:
    """The suffix tree as tables.

    words: (key, c) of all words and the end.  values: (key, value, n), one or two rows for each run of words that
    matters; the score of a text is its base and the values of all its runs.  A retained context's value is
    the logarithm of the weight of its suffix's distribution.  A run of a retained context and one of
    its own symbols has the logarithm of the symbol's probability less what the suffix gives it.
    """

    words: DataFrame
    values: DataFrame | None
    total: int
    distinct: int

    @property
    def whole(self) -> float:
        return self.total + ADDED * (self.distinct + 1)


def learn(texts: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE) -> Tree:
    """The suffix tree of all training texts (text)."""
    words = save(count_words(texts), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tree = Tree(words, None, total, distinct)
    if total:
        with tidy() as keep:
            tree.values = keep(_values(texts, tree, depth, divergence))
    return tree


def _values(texts: DataFrame, tree: Tree, depth: int, divergence: float) -> DataFrame:
    spark = texts.sparkSession
    end = int(mix(EMPTY, np.array([END_HASH])).view(np.int64)[0])
    words = tree.words.where(F.col("c") >= LEAST_SYMBOL)
    below = words.select("key", ((F.col("c") + ADDED) / F.lit(tree.whole)).alias("p"))
    states = words.where((F.col("c") >= LEAST_CONTEXT) & (F.col("key") != end)).select(F.col("key").alias("context"), F.col("c").alias("total"), F.lit(0).cast("long").alias("suffix"))
    levels = []
    for d in range(1, depth + 1):
        shipped = spark.sparkContext.broadcast((sieve(states.select(F.col("context").alias("key"))), sieve(below.select("key"))))
        with large_batches(spark):
            grams = save(count_symbols(texts, shipped, d), "grams")  # its shuffle is the largest; it ends before the joins begin
        shipped.destroy()
        joined = save(grams.join(hashed(states), "context").join(hashed(below.withColumnsRenamed({"key": "low", "p": "q"})), "low"), "joined")
        forget(grams)
        own = F.col("n") / F.col("total")
        judged = joined.groupBy("context", "suffix", "total").agg(F.sum(own * F.log(own / F.col("q"))).alias("apart"), F.sum(F.col("n") - DISCOUNT).alias("stored"))
        judged = save(
            judged.select("context", "suffix", "total", ((F.col("total") - F.col("stored") + SMOOTHING) / (F.col("total") + SMOOTHING)).alias("back"), (F.col("apart") >= divergence).alias("kept")),
            "judged",
        )
        p = (F.col("n") - DISCOUNT) / (F.col("total") + SMOOTHING) + F.col("back") * F.col("q")
        symbols = joined.join(hashed(judged.select("context", "back")), "context").withColumn("p", p)
        symbols = save(symbols.select("context", "key", "low", "n", "p", (F.log10("p") - F.log10("q") - F.log10("back")).alias("value")), "symbols")
        forget(joined)
        levels.append((judged, symbols))
        below = symbols.select("key", "p")
        states = symbols.where(F.col("n") >= LEAST_CONTEXT).select(F.col("key").alias("context"), F.col("n").alias("total"), F.col("low").alias("suffix"))
        if states.isEmpty():
            break
    parts, needed = [], None
    for judged, symbols in reversed(levels):  # a state's suffixes are states
        kept = judged.where("kept").select("context")
        kept = kept if needed is None else kept.union(needed).distinct()
        kept = save(judged.join(hashed(kept), "context", "left_semi"), "kept")
        needed = kept.select(F.col("suffix").alias("context")).distinct()
        own = kept.select(F.col("context").alias("key"), F.log10("back").alias("value"), F.col("total").alias("n"))
        parts.append(save(own.union(symbols.join(hashed(kept), "context", "left_semi").select("key", "value", "n")), "values"))  # a level at a time, whose tables then go
        forget(judged)
        forget(symbols)
    return functools.reduce(DataFrame.union, parts)


def commonest(df: DataFrame, of: str, most: int) -> DataFrame:
    """The rows of the largest counts, ``most`` of them or fewer; all of one magnitude or none."""
    size = F.floor(F.log2(of) * 4)
    held, least = 0, None
    for r in sorted(df.groupBy(size.alias("size")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["size"]
    return df.where(size >= least if least is not None else F.lit(False))


class Held:
    """Values by key, found through the keys' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = np.r_[keys[order], np.uint64(0)], np.r_[values[order], values.dtype.type(0)]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.at = np.searchsorted(keys[order] >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are held, and the values (0 of others)."""
        lead = (keys >> self.shift).astype(np.int64)
        at, end = self.at[lead], self.at[lead + 1]
        here = (at < end) & (self.keys[at] == keys)
        left = np.flatnonzero(~here & (at + 1 < end))
        while len(left):
            at[left] += 1
            same = self.keys[at[left]] == keys[left]
            here[left[same]] = True
            left = left[~same]
            left = left[at[left] + 1 < end[left]]
        return here, np.where(here, self.values[at], 0)


@dataclass
class Cache:
    """What every task looks up for itself: counts of the commonest words, values of the commonest runs, and a sieve of all runs."""

    words: Held
    runs: Held
    bits: np.ndarray


def cache_of(tree: Tree) -> Cache:
    def held(df: DataFrame, value: str) -> Held:
        table = fetched(df.groupBy("key").agg(F.sum(value).alias("value")), "held")
        return Held(table["key"].to_numpy(), table["value"].to_numpy())

    words = held(commonest(tree.words, "c", CACHED_WORDS), "c")
    if tree.values is None:
        return Cache(words, Held(np.zeros(0, np.int64), np.zeros(0)), np.zeros(1 << (SIEVE - 6), np.uint64))
    return Cache(words, held(commonest(tree.values, "n", CACHED_RUNS), "value"), sieve(tree.values.select("key")))


SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, more double"


def score_stored(rows: DataFrame, shipped, whole: float, depth: int) -> DataFrame:  # noqa: ANN001
    """What the cached words and runs of (doc_id, text) add up to; other words, and other runs that may have a value, are handed on.

    Those are dealt by key into a column for each part that they are looked up in.
    Words handed on count as unknown here.
    """

    columns = [f"keys{i}" for i in range(PARTS)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, done = shipped.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            x, start, first = join_texts(as_bytes(batch.column(1)))
            tokens = np.diff(np.r_[start, len(x)])
            text = np.repeat(np.arange(n), tokens)
            total = lambda weights, of: np.bincount(of, weights=weights, minlength=n)
            more, keys, texts_of, some = np.zeros(n), [], [], np.arange(len(x))
            for k, run in enumerate(runs_of(x, depth + 1)):
                if not k:
                    held, c = cache.words.find(run)
                    base, known = total(np.log10((c + ADDED) / whole), text), total(None, text[held])
                    keys.append((run[~held] ^ COUNTED).view(np.int64))
                    texts_of.append(text[~held])
                # a run of three words or more has a value only where the run without its first word has one
                some = np.flatnonzero(first >= 1) if k == 1 else some[first[some] >= k]
                some = some[passes(cache.bits, run[some])]
                held, value = cache.runs.find(run[some])
                more += total(value[held], text[some[held]])
                keys.append(run[some[~held]].view(np.int64))
                texts_of.append(text[some[~held]])
            key, of = np.concatenate(keys), np.concatenate(texts_of)
            place = key % PARTS * n + of
            order = np.argsort(place, kind="stable")
            key, ends = key[order], np.searchsorted(place[order], np.arange(PARTS * n + 1)).astype(np.int32)
            dealt = [pa.ListArray.from_arrays(ends[i * n : (i + 1) * n + 1], key) for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(done, done + n)), batch.column(0), pa.array(tokens, pa.int64()), pa.array(known),
                    pa.array(base), pa.array(more), *dealt,
                ],
                names=[*(f.split()[0] for f in SCORED.split(", ")), *columns],
            )
            done += n

    return rows.mapInArrow(each, ", ".join([SCORED, *(f"{c} array<long>" for c in columns)]))


def score(train: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, divergence: float = DIVERGENCE) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end.  The model is learnt
    from all of ``train``: contexts of up to ``depth`` words that occur LEAST_CONTEXT times and whose next symbols
    (each seen LEAST_SYMBOL times there) diverge from their suffix's, so it grows with the texts.  A state's
    distribution is its counts with the rest of its mass on its suffix's, down to the base of single
    words.  Each token is scored by the longest state before it.  That logarithm is a sum of values of
    the runs of words that end at the token or before it, so words and runs are looked up by joins with their tables, the
    commonest of them in every task.  Runs and words are known by 64-bit hashes.
    Null texts are empty; an empty training set gives every token the unknown word's probability.
    Rows are returned as often as given, null ids too; other columns are dropped.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    tree = learn(train.select(F.col(text_col).cast("string").alias("text")), depth, divergence)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = save(score_stored(rows, spark.sparkContext.broadcast(cache_of(tree)), tree.whole, depth), "scored")
    counted = tree.words.select(
        F.col("key").bitwiseXOR(F.lit(int(COUNTED.view(np.int64)))).alias("key"), F.log10((F.col("c") + ADDED) / ADDED).alias("value"), F.lit(True).alias("word"))
    lookup = counted if tree.values is None else counted.union(tree.values.select("key", "value", F.lit(False)))
    found = None
    for i in range(PARTS):  # one after the other, so that their shuffles don't lie on the disks together
        keys, known = local.select("row", F.explode(f"keys{i}").alias("key")), lookup.where(F.pmod("key", F.lit(PARTS)) == i)
        part = save(keys.join(hashed(known), "key").groupBy("row", "word").agg(F.sum("value").alias("value"), F.count("*").alias("n")), "found")
        found = part if found is None else found.union(part)
    found = found.groupBy("row").agg(
        F.sum(F.when(F.col("word"), F.col("value"))).alias("rest"), F.sum(F.when(F.col("word"), F.col("n"))).alias("seen"), F.sum(F.when(~F.col("word"), F.col("value"))).alias("gain"))
    out = local.select(*[f.split()[0] for f in SCORED.split(", ")]).join(found, "row", "left")
    base = F.col("base") + F.coalesce("rest", F.lit(0.0))
    gain = F.col("more") + F.coalesce("gain", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + gain).alias("score"),
    )
