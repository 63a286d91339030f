"""Language identification by interpolated Kneser-Ney models of characters.

Training. 4-grams of lower-cased letters (anything between two letters is one boundary) are counted by language over a
bounded sample of the labelled documents: distinct texts in the order of their hash, until a language has ``sample_chars``
characters, so each language has one text at least and copies count once. Every label is learned; that bound a language is
what makes the model's size, and so the broadcast, follow the number of labels only. Lower orders use
continuation counts, each order its own discount. A model is, for each order, an array of sorted 64-bit hashes of n-grams beside
the languages that have each and its log probability there, and the same for the back-off weights of contexts: an entry for
what a language has, none for what it has not.

Scoring. The distinct 4-grams of a slice are looked up by hash, shortest order first: where a language has the context, its
back-off weight is added, and where it has the n-gram, its probability takes the place of what shorter ones gave. A language's
cross-entropy is its mean bits a symbol, and the lowest wins. A tenth of the sample, and never all texts of a language, is kept out of the counts for calibration: it gives the logistic from
evidence to ``score``, and the cross-entropy, by length, beyond which a text is in none of the languages (``rejected``).

Defined cases: a text that is null or has no letter is ``und``, score 0 and rejected; so is every text if nothing is
labelled; with one language it is predicted for every text with a letter; ties go to the language that sorts first; labels
that are null, or whose texts have no letter, train nothing; equal texts get equal results, wherever they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm import common
from confab.llm.wordhash import mix

U = np.uint64
ORDER = 4
SAMPLE_CHARS = 4_000_000
#: Ranges of hashes in which a language's characters are summed before its sample is cut.
RANGES = 1 << 14
#: Bytes of text whose 4-grams are worked on at a time.
SLICE = 1 << 19
#: Numbers of a matrix of 4-grams and languages that is held at once.
CELLS = 1 << 22
#: Bits beyond the worst calibration text, and standard errors for short texts, at which a text is rejected.
SLACK_BITS, SLACK_ERRORS = 0.75, 6.0
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())]


@functools.cache
def letters() -> np.ndarray:
    """For each code point (those beyond the first plane count as one) its lower-cased letter, or 0."""
    out = np.zeros(0x10000, np.uint16)
    for i in range(1, 0xFFFF):
        c = chr(i)
        if c.isalpha():
            out[i] = min(ord(c.lower()[0]), 0xFFFE)
    return out


@functools.cache
def far_letters() -> np.ndarray:
    """Whether each code point beyond the first plane is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x10000, 0x110000)], bool)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts, the text each belongs to, and whether each text has a letter."""
    sep = "\0" * (ORDER - 1)
    points = np.frombuffer((sep + sep.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + len(sep)) - sizes - len(sep)
    codes = letters()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        codes[far[far_letters()[points[far] - 0x10000]]] = 0xFFFF
    is_sep = np.zeros(len(codes), bool)
    for i in range(len(sep)):
        is_sep[begin + i] = True
    before = np.concatenate(([0], codes[:-1]))
    keep = (codes != 0) | (before != 0) | is_sep
    owner = np.repeat(np.arange(len(texts)), sizes + len(sep))[keep]
    kept, sep_kept = codes[keep].astype(U), is_sep[keep]
    key = kept.copy()
    for i in range(1, ORDER):
        key[i:] |= kept[:-i] << U(16 * i)
    key, owner = key[~sep_kept], owner[~sep_kept]
    has = np.zeros(len(texts), bool)
    has[owner[(key & U(0xFFFF)) != 0]] = True
    return key, owner, has


def low(key: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols."""
    return key & U((1 << (16 * n)) - 1)


@dataclass
class Table:
    """Under each of some sorted hashes, values of a few languages: entries ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """parts: by language, distinct keys and a value of each."""
        h = np.concatenate([mix(k) for k, _ in parts])
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        return cls(hashes, np.append(first, len(h)).astype(np.int64), lang[order], np.concatenate([v for _, v in parts])[order].astype(np.float32))

    def entries(self, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all keys that are there, the places of their entries in a matrix of keys and languages, and the values."""
        h = mix(keys)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        size = self.first[at[hit] + 1] - self.first[at[hit]]
        ends = np.cumsum(size)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at[hit]] - ends + size, size)
        return np.repeat(hit * width, size) + self.lang[entry], self.value[entry]


@dataclass
class Model:
    languages: list[str]
    grams: dict[int, Table] = field(default_factory=dict)
    contexts: dict[int, Table] = field(default_factory=dict)
    unknown: np.ndarray | None = None
    #: Logistic of the evidence; worst usual cross-entropy; spread of one symbol's bits.
    logistic: tuple[float, float] = (0.0, 1.0)
    worst: float = 16.0
    spread: float = 4.0

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of each position's probability, by language."""
        width = len(self.languages)
        out = np.tile(self.unknown.astype(np.float32), (len(keys), 1))
        flat = out.reshape(-1)
        for n in range(1, ORDER + 1):
            if n > 1:  # the back-off to no n-gram at all is part of ``unknown``
                at, weight = self.contexts[n].entries(low(keys, n) >> U(16), width)
                flat[at] += weight
            at, p = self.grams[n].entries(low(keys, n), width)
            flat[at] = p
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text by language, its number of symbols, and whether it has a letter."""
        keys, owner, has = symbols(texts)
        distinct, place = np.unique(keys, return_inverse=True)
        width = len(self.languages)
        total = np.zeros((len(texts), width))
        if len(distinct) * width <= CELLS:
            p = self.log2(distinct)
            for i in range(width):
                total[:, i] = -np.bincount(owner, weights=p[:, i][place], minlength=len(texts))
            return total, np.bincount(owner, minlength=len(texts)), has
        # How often each text has each distinct 4-gram, so that a block of 4-grams serves all texts at once.
        pair, times = np.unique(place * np.int64(len(texts)) + owner, return_counts=True)
        gram, text = np.divmod(pair, max(len(texts), 1))
        step = max(1, CELLS // width)
        for at in range(0, len(distinct), step):
            p = self.log2(distinct[at : at + step])
            own = slice(*np.searchsorted(gram, (at, at + step)))
            for i in range(width):
                total[:, i] -= np.bincount(text[own], weights=p[gram[own] - at, i] * times[own], minlength=len(texts))
        return total, np.bincount(owner, minlength=len(texts)), has

    def predict(self, texts: list[str | None]) -> list[list]:
        n = len(texts)
        if not self.languages:
            return [["und"] * n, [0.0] * n, [True] * n, [None] * n]
        total, size, has = self.bits([t or "" for t in texts])
        best = total.argmin(axis=1)
        entropy = total.min(axis=1) / np.maximum(size, 1)
        score = 1 / (1 + np.exp(-np.clip(self.logistic[0] + self.logistic[1] * evidence(total), -50, 50)))
        reject = ~has | (entropy > self.worst + SLACK_BITS + SLACK_ERRORS * self.spread / np.sqrt(np.maximum(size, 1)))
        lang = [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
        return [lang, np.where(has, score, 0.0).tolist(), reject.tolist(), [e if h else None for e, h in zip(entropy.tolist(), has, strict=True)]]


def evidence(total: np.ndarray) -> np.ndarray:
    """Logarithm of how many bits the best language is ahead of the next."""
    if total.shape[1] < 2:
        return np.full(len(total), 5.0)
    two = np.partition(total, 1, axis=1)[:, :2]
    return np.log1p(two[:, 1] - two[:, 0])


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: by language, distinct packed 4-grams (ascending) and how often each occurs. Each language is worked out by itself."""
    model = Model(sorted(counts))
    if not model.languages:
        return model
    seen = np.unique(np.concatenate([np.unique(low(counts[x][0], 1)) for x in model.languages]))
    size, unknown = len(seen) + 1, []
    grams: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
    contexts: dict[int, list] = {n: [] for n in range(2, ORDER + 1)}
    for lang in model.languages:
        keys, c = counts[lang]
        own = {ORDER: (keys, c.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # in how many different contexts an n-gram follows
            k, c = np.unique(low(own[n + 1][0], n), return_counts=True)
            own[n] = (k, c.astype(np.float64))
        lower = None
        for n in range(1, ORDER + 1):
            k, c = own[n]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
            ctx_keys, ctx = np.unique(k >> U(16) if n > 1 else np.zeros(len(k), U), return_inverse=True)
            total, kinds = np.bincount(ctx, weights=c), np.bincount(ctx)
            gamma = d * kinds / total
            back = 1.0 / size if n == 1 else lower[1][np.searchsorted(lower[0], low(k, n - 1))]
            p = np.maximum(c - d, 0) / total[ctx] + gamma[ctx] * back
            lower = (k, p)
            grams[n].append((k, np.log2(p)))
            if n == 1:
                unknown.append(np.log2(gamma[0] / size))
            else:
                contexts[n].append((ctx_keys, np.log2(gamma)))
    model.unknown = np.array(unknown, np.float32)
    model.grams = {n: Table.of(parts) for n, parts in grams.items()}
    model.contexts = {n: Table.of(parts) for n, parts in contexts.items()}
    return model


def calibrate(model: Model, right: np.ndarray, ahead: np.ndarray, entropy: np.ndarray, size: np.ndarray) -> None:
    """Sets the logistic and the limits of rejection from texts that were not counted."""
    long = entropy[size >= 200] if (size >= 200).sum() >= 20 else entropy
    if len(long):
        model.worst = float(long.max())
        model.spread = float(max(1.0, (np.abs(entropy - np.median(long)) * np.sqrt(size)).mean()))
    w = np.zeros(2)
    x = np.stack([np.ones(len(ahead)), ahead], axis=1)
    for _ in range(25):  # Newton steps with a ridge, so that separable texts keep finite weights
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - right) + 0.1 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    model.logistic = (float(w[0]), float(max(w[1], 0.0)))


def sampled(labelled: DataFrame, text_col: str, lang_col: str, sample_chars: int) -> DataFrame:
    """_lang, _text and _held (kept for calibration) of the sample."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_lang is not null and _text rlike '\\\\p{L}'")
    # Texts are told apart by 64-bit hash, and only hashes and lengths are grouped.
    keyed = rows.withColumn("_h", F.xxhash64("_text"))
    distinct = keyed.groupBy("_lang", "_h").agg(F.max(F.length("_text")).cast("long").alias("_n"))
    distinct = distinct.withColumn("_range", F.pmod(F.col("_h"), F.lit(RANGES)))
    sums = distinct.groupBy("_lang", "_range").agg(F.sum("_n").alias("_chars"))
    before = sums.select("_lang", "_range", (F.sum("_chars").over(W.partitionBy("_lang").orderBy("_range")) - F.col("_chars")).alias("_before")).where(F.col("_before") < sample_chars)
    in_range = W.partitionBy("_lang", "_range").orderBy("_h")
    drawn = distinct.join(before, ["_lang", "_range"]).withColumn("_at", F.col("_before") + F.sum("_n").over(in_range) - F.col("_n")).where(F.col("_at") < sample_chars)
    # The first text of a language is counted; of the others a tenth is held out.
    held = (F.col("_at") > 0) & (F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(10)) == 0)
    drawn = drawn.select("_lang", "_h", held.alias("_held"))
    # What is drawn is bounded by the characters a language, so it is broadcast and no other text moves.
    return common.cut(keyed.join(F.broadcast(drawn), ["_lang", "_h"]).groupBy("_lang", "_h").agg(F.first("_held").alias("_held"), F.first("_text").alias("_text")).drop("_h"), "language-sample")


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> Model:
    """A calibrated model of the labelled documents' languages."""
    sample = sampled(labelled, text_col, lang_col, sample_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text", SLICE):
                langs = part.column("_lang").to_pylist()
                texts = part.column("_text").to_pylist()
                for lang in set(langs):
                    keys, c = np.unique(symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], names=["_lang", "k", "c"])
        common.give_back()

    got = sample.where("not _held").select("_lang", "_text").mapInArrow(count, "_lang string, k long, c long").groupBy("_lang", "k").agg(F.sum("c").alias("c")).toPandas()
    model = fit({lang: (g["k"].to_numpy().astype(np.int64).view(U), g["c"].to_numpy()) for lang, g in got.sort_values(["_lang", "k"]).groupby("_lang")})
    if not model.languages:
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text", SLICE):
                m = shared.value
                total, size, has = m.bits(part.column("_text").to_pylist())
                right = np.array([m.languages[b] == x for b, x in zip(total.argmin(axis=1), part.column("_lang").to_pylist(), strict=True)], float)
                cols = [right, evidence(total), total.min(axis=1) / np.maximum(size, 1), size.astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in cols], names=["r", "a", "e", "n"])

    got = sample.where("_held").select("_lang", "_text").mapInArrow(judge, "r double, a double, e double, n double").toPandas().sort_values(["n", "e", "a", "r"])
    if len(got):
        calibrate(model, *(got[c].to_numpy() for c in ("r", "a", "e", "n")))
    return model


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score, rejected and cross_entropy. One narrow pass; the model is a bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]

    def work():
        return lambda batch: [pa.array(x, k) for x, k in zip(shared.value.predict(batch.column(text_col).to_pylist()), kinds, strict=True)]

    return common.add_columns(docs, text_col, fields, work, SLICE)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(id_col.cast("string")) % 5


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; learned from the labelled ones outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")
