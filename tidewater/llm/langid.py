"""Language identification of mixed-language text, word by word."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, as_bytes

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")

#: Unicode blocks by script (fixed values): first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_RANGES = sorted((lo, hi, name) for name, ranges in SCRIPTS.items() for lo, hi in ranges)
_STARTS = np.array([r[0] for r in _RANGES])
_ENDS = np.array([r[1] for r in _RANGES])

#: Labelled documents per language that the word scores are learnt from, about.
SAMPLE = 1500
#: Natural log that a change of language between two words costs.
SWITCH = 8.0
#: A language takes part for words of a script if so much of its sample's letters have that script.
SCRIPT_SHARE = 0.01
#: Distinct words that a worker remembers the scores of; it starts anew beyond that.
REMEMBERED = 120_000
#: Distinct words that a training task adds up before it hands their n-grams on.
HELD = 50_000
#: Log odds that one word can give against a language, so that one odd word doesn't decide.
WORD_LIMIT = 6.0


def script_of(char: str) -> str:
    at = int(np.searchsorted(_STARTS, ord(char), side="right")) - 1
    return _RANGES[at][2] if at >= 0 and ord(char) <= _RANGES[at][1] else "other"


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(word: str) -> Iterator[str]:
    """Character 1- to 4-grams of a word between its ends."""
    padded = f"<{word}>"
    for n in (1, 2, 3, 4):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each n-gram; columns hold the code points of its places."""
    key = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


class Model:
    """Per-word scores: log-likelihoods of character n-grams in each language, smoothed."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> None:
        self.langs = langs
        total = np.ones((5, len(langs)))
        kinds = np.ones(5)
        for gram, c in counts.items():
            total[len(gram)] += c
            kinds[len(gram)] += 1
        half = 0.5
        weight = np.arange(5)[:, None] / 10  # longer grams say more
        self.unseen = weight * np.array([np.log(half / (total[n] + half * kinds[n])) for n in range(5)])
        keys, values = [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))]
        for n in range(1, 5):
            own = [g for g in counts if len(g) == n]
            if own:
                places = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
                keys.append(gram_keys(list(places.T)))
                values.append(weight[n] * np.log((np.array([counts[g] for g in own]) + half) / (total[n] + half * kinds[n])))
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        self.keys, self.values = flat[order], np.concatenate(values)[order]
        none = np.zeros(len(langs), bool)
        self.allowed = np.array([scripts.get(r[2], none) for r in _RANGES] + [scripts.get("other", none)])
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), np.float32)
        self.sizes = np.zeros(0, np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"numbers": {}, "scores": np.zeros((0, len(self.langs)), np.float32), "sizes": np.zeros(0, np.int32)}

    def score(self, words: list[str]) -> np.ndarray:
        """Log odds of each word against its best language; a row of NaN for words without letters."""
        out = np.full((len(words), len(self.langs)), np.nan, np.float32)
        for lo in range(0, len(words), 8_000):
            letters = [letters_of(w) for w in words[lo : lo + 8_000]]
            where = np.flatnonzero([bool(w) for w in letters])
            if len(where):
                out[lo + where] = self._score([letters[i] for i in where])
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        of = np.repeat(np.arange(len(words)), length)
        total = np.zeros((len(words), len(self.langs)))
        for n in range(1, 5):
            at = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
            key = gram_keys([flat[at + i] for i in range(n)])
            row = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            known = self.keys[row] == key if len(self.keys) else np.zeros(len(key), bool)
            value = np.where(known[:, None], self.values[row], self.unseen[n]) if len(self.keys) else np.repeat(self.unseen[n : n + 1], len(key), axis=0)
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(of[at], weights=value[:, j], minlength=len(words))
        total -= total.max(axis=1, keepdims=True)
        first = flat[np.r_[0, np.cumsum(length)[:-1]] + 1].astype(np.int64)
        block = np.searchsorted(_STARTS, first, side="right") - 1
        block = np.where((block >= 0) & (first <= _ENDS[block]), block, len(_RANGES))
        allowed = self.allowed[block]
        scores = np.where(allowed, np.maximum(total, -WORD_LIMIT), -WORD_LIMIT)
        return np.where(allowed.any(axis=1, keepdims=True), scores, 0.0)

    def look_up(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Numbers of each text's words in ``scores`` and ``sizes``; the words are held one text at a time."""
        if len(self.numbers) > REMEMBERED:
            self.__dict__.update(self.__getstate__())
        numbers, known = self.numbers, len(self.numbers)
        out = []
        for text in texts:
            words = WORD.findall(text.lower())
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            out.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        if len(numbers) > known:
            fresh = list(itertools.islice(numbers, known, None))
            self.scores = np.concatenate([self.scores, self.score(fresh)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, fresh), np.int32, len(fresh))])
        return out


def viterbi(rows: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Most likely language of each word of each text: rows hold (words, languages) scores.

    All texts step together, longest first; a step keeps the language or takes the
    best one at the cost of ``switch``.
    """
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    length = np.array([len(rows[i]) for i in order])
    if not len(length) or not length[0]:
        return [np.zeros(0, np.int8) for _ in rows]
    n_langs = rows[order[0]].shape[1]
    # words of all texts in the order of the steps
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    begin = np.r_[0, np.cumsum(live)]
    flat = np.zeros((int(begin[-1]), n_langs), np.float32)
    for k, i in enumerate(order):
        flat[begin[: length[k]] + k] = rows[i]
    stay = np.ones(flat.shape, bool)
    best_before = np.zeros(len(flat), np.int8)
    delta = flat[: live[0]].copy()
    last = np.zeros(len(order), np.int8)
    for t in range(1, len(live)):
        n, lo = live[t], begin[t]
        if n < len(delta):
            last[n : len(delta)] = delta[n:].argmax(axis=1)
            delta = delta[:n]
        top = delta.argmax(axis=1)
        reach = delta[np.arange(n), top] - np.float32(switch)
        kept = delta >= reach[:, None]
        stay[lo : lo + n] = kept
        best_before[lo : lo + n] = top
        delta = np.where(kept, delta, reach[:, None]) + flat[lo : lo + n]
    last[: len(delta)] = delta.argmax(axis=1)
    path = np.zeros(len(flat), np.int8)
    now = last.copy()
    for t in range(len(live) - 1, -1, -1):
        n, lo = live[t], begin[t]
        path[lo : lo + n] = now[:n]
        if t:
            kept = stay[np.arange(lo, lo + n), now[:n]]
            now[:n] = np.where(kept, now[:n], best_before[lo : lo + n])
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(rows)
    for k, i in enumerate(order):
        out[i] = path[begin[: length[k]] + k]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn word scores from about ``sample`` labelled documents of each language.

    The sample is taken by a hash of the id, whole texts are read, and what
    reaches the driver are n-gram counts of the sample.  Rows with a null id, text or label are left out.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(1_000_003 * sample / per[lang]) + 1))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                to: Counter = Counter()
                of: Counter = Counter()
                for word, n in words.items():
                    if letters := letters_of(word):
                        of[script_of(letters[0])] += n
                        for gram in grams(letters):
                            to[gram] += n
                for found, script in ((to, False), (of, True)):
                    items = iter(found.items())
                    while some := list(itertools.islice(items, 20_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([g for g, _ in some]), pa.array([n for _, n in some]), pa.array([script] * len(some))], names=["lang", "gram", "n", "script"])
            seen.clear()

        for batch in batches:
            for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(WORD.findall(text.decode("utf-8", "replace").lower()))
                if sum(map(len, seen.values())) > HELD:
                    yield from out()
        yield from out()

    made = some.select("text", "lang").mapInArrow(each, "lang string, gram string, n long, script boolean")
    table = made.groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")).where("script or n > 2").toPandas()
    at = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for lang, gram, script, n in table.itertuples(index=False):
        (scripts if script else counts).setdefault(gram, np.zeros(len(langs)))[at[lang]] += n
    letters = sum(scripts.values(), np.zeros(len(langs)))
    return Model(langs, counts, {s: n >= SCRIPT_SHARE * np.maximum(letters, 1) for s, n in scripts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, with_spans: bool = True, added: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every row of ``docs``.

    Script ranges narrow each word to the languages written in its script, and
    Viterbi over the words' scores labels them at a cost of ``switch`` a change.
    lang_pred is the language of most letters, score its share of them (0 to 1), spans the runs of
    words of one language as (start, end, lang), in word numbers.  A null text or one without
    letters is ``und`` with score 0, and so is everything if the model has no language.
    Null ids and repeated rows are returned as given; other columns are dropped, unless ``added`` names two columns (not among
    those of ``docs``) that are then added for language and score, all columns of ``docs`` staying as they are.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shipped = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col) if added else 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value  # a worker's tasks share it, and its words, until the broadcast goes
        for batch in batches:
            texts = ((t or b"").decode("utf-8", "replace") for t in as_bytes(batch.column(text_at)))
            langs, scores, spans = [], [], []
            numbers = own.look_up(texts) if own.langs else [np.zeros(0, np.int32)] * batch.num_rows
            rows = [own.scores[n] for n in numbers]
            real = [~np.isnan(r).any(axis=1) for r in rows]
            paths = viterbi([r[k] for r, k in zip(rows, real, strict=True)], switch)
            for words, keep, path in zip(numbers, real, paths, strict=True):
                if not len(path):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    spans.append([])
                    continue
                size = own.sizes[words[keep]]
                share = np.bincount(path, weights=size, minlength=len(own.langs))
                top = int(share.argmax())
                langs.append(own.langs[top])
                scores.append(float(share[top] / size.sum()))
                if with_spans:
                    at = np.flatnonzero(np.diff(np.r_[-1, path]))
                    where = np.flatnonzero(keep)
                    ends = np.r_[at[1:], len(path)]
                    spans.append([{"start": int(where[a]), "end": int(where[b - 1]) + 1, "lang": own.langs[path[a]]} for a, b in zip(at, ends, strict=True)])
            if added:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *added])
                continue
            cols = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    if added:
        schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
        return docs.mapInArrow(each, schema)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans)
