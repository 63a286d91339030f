"""Benchmark decontamination by winnowing.

The hash of every run of ``GRAM`` words is taken, and of each ``SPAN - GRAM + 1`` consecutive hashes the smallest is kept.
Two texts that share ``SPAN`` consecutive words then share a kept hash, whatever stands around it, so joining the kept
hashes of documents and benchmark finds every such span. Each joint hash is extended to the windows of ``SPAN`` words that
cover it, and those that are windows of the benchmark word for word (64-bit hashes of all their words) are hits. The index has
each window once, and items that share the same windows as one set, so a passage of a thousand items costs a document no more
than one of a single item.

A benchmark of at most ``block_bytes`` of text is indexed once and broadcast, and documents are mapped where they lie: no shuffle, no
state that grows with documents, and copies or frequent passages cost no more than other text. A larger one stays where it is:
its kept hashes and its windows are tables, the documents' kept hashes are joined to the first, the windows around those that
are there to the second, and what is hit comes back to the documents by a hash of their text. A map of bits of the kept hashes,
of bounded size, keeps most hashes of documents from moving. Either way gives the same rows.

Defined cases: a null text has no words; null item ids mark hits but are not listed; items with the same id are one item;
an item of fewer than ``SPAN`` words, but not none, is one window of its own length; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm import common, wordhash as wh

U = np.uint64

SPAN, GRAM = 10, 5
BLOCK_BYTES = 16 << 20

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]


class Index:
    """Kept hashes and windows of one block of benchmark items, each once and sorted, with the items that have a window."""

    def __init__(self, items: list[tuple[str | None, str]], span: int, gram: int):
        self.span, self.gram = span, gram
        self.ids = [i for i, _ in items]
        data, offsets = common.buffers(pa.array([t for _, t in items], pa.string()))
        low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
        words = wh.word_hashes(low, starts, ends)
        sizes, owner = np.diff(first), wh.owners(first)
        kept = winnow(words, first, span, gram)
        kept = kept[sizes[owner[kept]] >= span] if len(kept) else kept
        self.hashes = np.unique(wh.mix(wh.grams(words, gram))[kept])
        #: The distinct lists of items, by number.
        self.sets: list[np.ndarray] = []
        self.numbers: dict[bytes, int] = {}
        windows = window_hashes(words, span)
        begin = np.flatnonzero(np.arange(len(windows)) + span <= np.repeat(first[1:], sizes)[: len(windows)])
        self.windows, self.window_sets = self.grouped(windows[begin], owner[begin])
        #: Items that are one short window: by length, sorted hashes and sets of items.
        self.short = {}
        for n in np.unique(sizes[(sizes > 0) & (sizes < span)]):
            item = np.flatnonzero(sizes == n)
            self.short[int(n)] = self.grouped(wh.mix(wh.grams(words, int(n)))[first[:-1][item]], item)

    def grouped(self, hashes: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes, and for each the number of the set of its items."""
        order = np.lexsort((item, hashes))
        h, i = hashes[order], item[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]))) if len(h) else np.zeros(0, bool)
        h, i = h[new], i[new]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        sets = np.zeros(len(at), np.int64)
        for k, (a, b) in enumerate(zip(at.tolist(), np.append(at, len(h))[1:].tolist(), strict=True)):
            own = i[a:b]
            sets[k] = self.numbers.setdefault(own.tobytes(), len(self.sets))
            if sets[k] == len(self.sets):
                self.sets.append(own)
        return h[at], sets


def window_hashes(words: np.ndarray, span: int) -> np.ndarray:
    return wh.mix(wh.grams(words, span))


def winnow(words: np.ndarray, first: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Positions of the k-grams that are smallest in some window of span - gram + 1; never across two texts."""
    g = wh.mix(wh.grams(words, gram))
    if not len(g):
        return np.zeros(0, np.int64)
    ok = np.arange(len(g)) + gram <= np.repeat(first[1:], np.diff(first))[: len(g)]
    g[~ok] = wh.NONE
    width = min(span - gram + 1, len(g))
    n = len(g) - width + 1
    least = g[:n].copy()
    for i in range(1, width):
        np.minimum(least, g[i : i + n], out=least)
    kept = np.zeros(len(g), bool)
    for i in range(width):
        kept[i : i + n] |= g[i : i + n] == least
    return np.flatnonzero(kept & ok)


def lookup(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the sorted table of distinct values, and where."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    hit = np.flatnonzero(table[at] == hashes)
    return hit, at[hit]


def matches(words: np.ndarray, first: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and set of items of every window of the index that occurs."""
    out = []
    span, sizes = index.span, np.diff(first)
    begin, end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    kept = winnow(words, first, span, index.gram)
    if len(kept) and len(index.hashes):
        p = kept[lookup(wh.mix(wh.grams(words, index.gram))[kept], index.hashes)[0]]
        if len(p):
            a = np.unique(np.concatenate([q[(q >= begin[p]) & (q + span <= end[p])] for q in (p - back for back in range(span - index.gram + 1))]))
            hit, at = lookup(window_hashes(words, span)[a], index.windows)
            out.append((a[hit], np.full(len(hit), span), index.window_sets[at]))
    for n, (hashes, sets) in index.short.items():
        hit, at = lookup(wh.mix(wh.grams(words, n)), hashes)
        ok = hit + n <= end[hit]
        out.append((hit[ok], np.full(ok.sum(), n), sets[at[ok]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def scan(batch: pa.RecordBatch, text_col: str, index: Index) -> list[pa.Array]:
    """n_words, hit_spans and item_ids of each text."""
    data, offsets = common.buffers(batch.column(text_col))
    low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
    words = wh.word_hashes(low, starts, ends)
    at, size, found_sets = matches(words, first, index)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    owner = wh.owners(first)
    n = len(first) - 1
    hit = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(words), bool)  # spans never run on into the next text
    edge[first[:-1][first[:-1] < len(words)]] = True
    run_start = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.zeros(0, np.int64)
    after = np.concatenate((hit[1:] & ~edge[1:], [False])) if len(hit) else np.zeros(0, bool)
    run_end = np.flatnonzero(hit & ~after) + 1
    got: list[list] = [[] for _ in range(n)]
    for a, b in zip(run_start.tolist(), run_end.tolist(), strict=True):
        i = owner[a]
        got[i].append({"start": a - int(first[i]), "end": b - int(first[i])})
    have: list[set] = [set() for _ in range(n)]
    if len(at):
        pair = np.unique(owner[at] * len(index.sets) + found_sets)
        for i, k in zip((pair // len(index.sets)).tolist(), (pair % len(index.sets)).tolist(), strict=True):
            have[i].update(index.ids[x] for x in index.sets[k].tolist() if index.ids[x] is not None)
    return [pa.array(np.diff(first)), pa.array(got, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in have], pa.list_(pa.string()))]


def merged(found: list[list[dict]], sizes: np.ndarray) -> pa.Array:
    """Stretches of words that windows (start, n) cover, by text."""
    out = []
    for hits, size in zip(found, sizes.tolist(), strict=True):
        change = np.zeros(size + 2, np.int64)
        np.add.at(change, [h["start"] + 1 for h in hits], 1)
        np.add.at(change, [h["start"] + h["n"] + 1 for h in hits], -1)
        edges = np.flatnonzero(np.diff(np.cumsum(change) > 0))
        out.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def benchmark_hashes(items: DataFrame, span: int, gram: int) -> DataFrame:
    """n, h and item: the kept hashes (n = 0) and the windows (n words) of items. items: item and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, offsets = common.buffers(part.column("text"))
                low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
                words = wh.word_hashes(low, starts, ends)
                sizes, owner = np.diff(first), wh.owners(first)
                kept = winnow(words, first, span, gram)
                kept = kept[sizes[owner[kept]] >= span] if len(kept) else kept
                windows = window_hashes(words, span)
                begin = np.flatnonzero(np.arange(len(windows)) + span <= np.repeat(first[1:], sizes)[: len(windows)])
                found = [(np.zeros(len(kept), np.int64), wh.mix(wh.grams(words, gram))[kept], owner[kept]), (np.full(len(begin), span), windows[begin], owner[begin])]
                for n in np.unique(sizes[(sizes > 0) & (sizes < span)]).tolist():
                    item = np.flatnonzero(sizes == n)
                    found.append((np.full(len(item), n), wh.mix(wh.grams(words, n))[first[:-1][item]], item))
                n, h, item = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(h.view(np.int64)), part.column("item").take(pa.array(item))], names=["n", "h", "item"])

    return items.mapInArrow(run, "n long, h long, item string")


#: Bits of the map of a large benchmark's hashes: 16 MB.
MAP_BITS = 1 << 27


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bytes of a map with 16 bits for each of the hashes (h), ``MAP_BITS`` at most; beyond that it lets more pass, none less."""
    bits = min(MAP_BITS, 1 << max(10, (16 * hashes.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    found = hashes.select(F.shiftright(slot, 3).alias("at"), F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 3, np.uint8)
    table[found.column("at").to_numpy()] = found.column("bit").to_numpy()
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those of the map."""
    slot = (hashes & U(8 * len(table) - 1)).astype(np.int64)
    return table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


def document_hashes(texts: DataFrame, table: np.ndarray, span: int, gram: int, short: list[int]) -> DataFrame:
    """r, at, n, h and w of texts (r, text): kept hashes that pass the map (n = 0), with the windows from at - span + gram on that cover them; runs of short lengths (n)."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    back = span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, offsets = common.buffers(part.column("text"))
                low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
                words = wh.word_hashes(low, starts, ends)
                owner = wh.owners(first)
                begin, end = first[:-1][owner], first[1:][owner]
                kept, hashes, windows = winnow(words, first, span, gram), wh.mix(wh.grams(words, gram)), window_hashes(words, span)
                kept = kept[passes(shared.value, hashes[kept])] if len(kept) else kept
                start = kept[:, None] + np.arange(-back, 1)[None, :]
                ok = (start >= begin[kept][:, None]) & (start + span <= end[kept][:, None]) if len(kept) else np.zeros(start.shape, bool)
                around = np.where(ok, windows[np.clip(start, 0, max(len(windows) - 1, 0))], U(0)) if len(windows) else np.zeros(start.shape, U)
                found = [(kept, np.zeros(len(kept), np.int64), hashes[kept] if len(kept) else np.zeros(0, U), [x[y].view(np.int64) for x, y in zip(around, ok, strict=True)], [np.flatnonzero(y) - back for y in ok])]
                for n in short:
                    h = wh.mix(wh.grams(words, n))
                    at = np.flatnonzero(np.arange(len(h)) + n <= end[: len(h)])
                    at = at[passes(shared.value, h[at])]
                    found.append((at, np.full(len(at), n), h[at], [np.zeros(0, np.int64)] * len(at), [np.zeros(0, np.int64)] * len(at)))
                for at, n, h, w, shift in found:
                    if len(at):
                        mine = owner[at]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("r").take(pa.array(mine)), pa.array(at - first[:-1][mine]), pa.array(n), pa.array(h.view(np.int64)), pa.array(w, pa.list_(pa.int64())), pa.array(shift, pa.list_(pa.int64()))],
                            names=["r", "at", "n", "h", "w", "shift"],
                        )

    return texts.mapInArrow(run, "r string, at long, n long, h long, w array<long>, shift array<long>")


def mark_joined(docs: DataFrame, items: DataFrame, text_col: str, span: int, gram: int, fields: list[T.StructField]) -> DataFrame:
    """``mark_contamination`` by joins. items: item and text."""
    table = common.cut(benchmark_hashes(items, span, gram), "benchmark-hashes")
    kept = common.cut(table.where("n = 0").select("h").distinct(), "benchmark-kept")
    windows = common.cut(table.where("n > 0").groupBy("n", "h").agg(F.collect_set("item").alias("items")), "benchmark-windows")
    short = sorted(r["n"] for r in windows.where(F.col("n") < span).select("n").distinct().collect())  # fewer than ``span``
    marks = bit_map(kept.union(windows.where(F.col("n") < span).select("h")))
    row, at, ids = (common.fresh(docs, c) for c in ("row", "at", "ids"))
    keyed = docs.withColumn(row, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    seen = common.cut(document_hashes(keyed.select(F.col(row).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), marks, span, gram, short), "document-hashes")
    around = seen.where("n = 0").join(kept, "h", "left_semi").select("r", "at", F.explode(F.arrays_zip("w", "shift")).alias("x")).select("r", (F.col("at") + F.col("x.shift")).alias("start"), F.lit(span).cast("long").alias("n"), F.col("x.w").alias("h")).distinct()
    hits = around.unionByName(seen.where("n > 0").select("r", F.col("at").alias("start"), "n", "h")).join(windows, ["n", "h"])
    found = hits.groupBy("r").agg(F.collect_set(F.struct("start", "n")).alias(at), F.collect_set("items").alias(ids))
    found = common.cut(found.select(F.col("r").alias(row), at, F.array_sort(F.array_distinct(F.flatten(ids))).alias(ids)), "hits")
    joined = keyed.join(found, row, "left")

    def work():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = common.buffers(batch.column(text_col))
            sizes = np.diff(wh.bounds(data, offsets, wh.ALNUM)[3])
            spans = merged([x or [] for x in batch.column(at).to_pylist()], sizes)
            return [pa.array(sizes), spans, pa.array([x or [] for x in batch.column(ids).to_pylist()], pa.list_(pa.string()))]

        return step

    return common.add_columns(joined, text_col, fields, work).drop(row, at, ids)


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, prefix: str = "",
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, merged, end exclusive) and item_ids (sorted as strings).

    Guarantees every shared span of ``span`` or more words. block_bytes: text of a benchmark that is indexed as a whole.
    """
    spark = docs.sparkSession
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]
    docs = common.without(docs, [f.name for f in fields])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    # Rows count too: an index has a few dozen bytes for an item, however short.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size > block_bytes:
        return mark_joined(docs, items, text_col, span, gram, fields)
    index = spark.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in items.collect()], span, gram))
    return common.add_columns(docs, text_col, fields, lambda: lambda batch: scan(batch, text_col, index.value))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') k from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
dw as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') k from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
m as (select r, i, dw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
h as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from m) group by r),
t as (select r, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from m group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (r) left join t using (r)
"""
