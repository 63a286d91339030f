"""Near-duplicate classes by order min-hash, verified by banded alignment.

Sketch. A text is its sequence of five-word shingles, each labelled with its occurrence number (so that repeats count). For
each of ``BANDS`` hash functions the ``PICKS`` labelled shingles of smallest hash are taken and kept in text order; their
hash is one sketch entry. Texts that share their shingles, in the same order, share entries; shuffled texts do not.

Similarity. Two texts are linked if the longest common subsequence L of their words, of lengths a and b, has
L / (a + b - L) >= ``SIMILARITY``. One minus this is a metric. A pair above the limit can only be shifted by a bounded number
of words, which is the band of the alignment.

Candidates without pairs of everything. Texts of equal words are one class from the start (a hot group of copies becomes a
row before anything is compared). In a bucket (equal entries) every text is aligned with one hub, so pairs are linear in its
size. The hub is the text that meets most others over all its buckets: of a group of edited copies that is the one closest to
the original, from which the others differ half as much as from each other. Where an alignment fails, the bucket's texts meet
again by a finer sketch: order min-hash of single words with more picks (``FINE``), whose entries are shared with a probability
of some s ** picks at edit similarity s. Texts that merely share a frequent passage, and copies that are edited too much, hardly
share one, so these buckets hold little but what belongs together. In them hubs are aligned with the texts of other classes only;
then the hub and its class leave the bucket, and the rest has a further hub, for as long as rounds find links. Hubs find most
links at the price of a row a text, but not those of texts that are both far from them. So at the end all texts of such buckets,
whichever these were, meet by their rarest words. Counting occurrences, texts of a and b words that reach the limit have L words in common,
so each has one of the common words among its (1 - SIMILARITY) * a + 1 rarest, in whatever order all texts are held against. Texts of
different classes that share such a word are aligned, if what follows it is long enough in both: of all these texts no two that
reach the limit stay apart, in one bucket or not. A frequent passage comes last in that order, so texts that share no more are no pair.

A pair shares an entry of the first sketch with a probability of some 1 - (1 - J ** PICKS) ** BANDS, J being the Jaccard
similarity of their shingles, and one of the finer with 0.999 (texts of fewer than ``LONG`` words) and 0.94 at similarity 0.8,
0.9999 at 0.9. The tests measure what all this finds by similarity.

Links, sketches and classes stay distributed, and steps hand over by files in the shared folder, so a lost executor costs
only its own tasks.

Defined cases: null texts are compared with nothing and are classes of their own (class id: their own id); texts without
words are one class if equal; a text of one to four words is one shingle; the class id is the smallest id in the class, null
only if all are null; ties and repeated rows fall into the same class; words are compared by lower-cased letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm import common, wordhash as wh

U = np.uint64
SHINGLE, BANDS, PICKS, SIMILARITY = 5, 32, 2, 0.8
#: Bits of the map that keeps texts from moving that no bucket wants: 16 MB.
FILTER_BITS = 1 << 27
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20
#: Pairs that are few enough to be sent to every executor.
FEW_PAIRS = 1 << 20
#: The finer sketch: bands and picks of single words, for all texts and for those of ``LONG`` words and more.
FINE, FINE_LONG, LONG = (16, 4), (96, 16), 48
#: Bits of the table of counts by which words are rare: 1 MB. Words that share a place only cost further pairs.
RARE_BITS = 20


# ---- one text


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the text's shingles, in order."""
    return wh.mix(wh.grams(words, min(size, len(words)))) if len(words) else np.zeros(0, U)


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence number)."""
    order = np.argsort(s, kind="stable")
    x = s[order]
    new = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
    at = np.arange(len(x))
    number = np.empty(len(x), U)
    number[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U)
    return wh.mix(s + number * wh.RADIX)


def seeds(bands: int) -> np.ndarray:
    return wh.mix(np.arange(1, bands + 1, dtype=U) * wh.LINK) | U(1)


def sketch(s: np.ndarray, odd: np.ndarray, picks: int) -> np.ndarray:
    """One entry per hash function."""
    g = labelled(s)
    k = min(picks, len(g))
    at = np.empty((k, len(odd)), np.int64)
    for j in range(0, len(odd), step := max(1, (1 << 20) // max(len(g), 1))):  # a bounded matrix at a time
        hashes = odd[j : j + step, None] * g[None, :]
        if k > 4:
            at[:, j : j + step] = np.argpartition(hashes, k - 1, axis=1)[:, :k].T
            continue
        for row in at:
            row[j : j + step] = least = hashes.argmin(axis=1)
            hashes[np.arange(len(least)), least] = wh.NONE
    at.sort(axis=0)
    out = odd.copy()
    for row in at:
        out = wh.mix(out + g[row]) * wh.LINK
    return wh.mix(out)


def text_key(words: np.ndarray, raw: bytes) -> int:
    """63 bits of the sequence of words; of the bytes where there is no word."""
    if not len(words):
        import hashlib

        return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 1
    up, _ = wh.powers(len(words))
    return int(wh.mix(wh.mix((words * up).sum(dtype=U, keepdims=True)) + U(len(words)))[0] >> U(1))


def text_keys(texts: pa.Array) -> list[int | None]:
    """``text_key`` of each text; null of a null text."""
    data, offsets = common.buffers(texts)
    low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
    words = wh.word_hashes(low, starts, ends)
    return [text_key(words[first[i] : first[i + 1]], data[offsets[i] : offsets[i + 1]].tobytes()) if ok else None for i, ok in enumerate(texts.is_valid().to_pylist())]


def common_subsequence(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of matches whose places differ by at most ``band``, 64 places of ``a`` a machine word."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    width = (1 << (2 * band + 1)) - 1
    row = full
    for j, x in enumerate(b):
        if x in places:
            near = width << (j - band) if j >= band else width >> (band - j)
            if match := row & places[x] & near:
                row = ((row + match) | (row - match)) & full
    return head + tail + len(a) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """L / (a + b - L); below ``least`` an upper bound of it may be returned instead."""
    total = len(a) + len(b)
    need = least * total / (1 + least)
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    most = int(np.minimum(ca[ia], cb[ib]).sum())
    if most < need:
        return most / (total - most)
    n = common_subsequence(a.tolist(), b.tolist(), int(total - 2 * need) + 1)
    return n / (total - n)


def parity_map(words: np.ndarray) -> bytes:
    """For each of some n / 2 to n places by hash whether an odd number of the text's n labelled words falls there: a hundredth of the words' size."""
    bits = max(64, 1 << (len(words) - 1).bit_length() >> 1)
    return np.packbits(np.bincount((labelled(words) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_similar(x: bytes, y: bytes, a: int, b: int) -> float:
    """An upper bound of the similarity of texts of a and b words, by their parity maps.

    Common words cancel out, so each place in which the maps differ has a word that only one text has; L is at most half of what is left.
    """
    while len(x) != len(y):  # the larger map's halves together are the map of half its size
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little")
    n = min(a, b, (a + b - (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()) // 2)
    return n / (a + b - n)


# ---- all texts


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, picks: int) -> DataFrame:
    """id, k (null for null texts), sketch (empty for texts without words), n (words)."""
    fields = [T.StructField("k", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]
    odd = seeds(bands)

    def work():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("text")
            data, offsets = common.buffers(texts)
            low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
            words = wh.word_hashes(low, starts, ends)
            keys, entries, sizes = [], [], []
            for i, ok in enumerate(texts.is_valid().to_pylist()):
                own = words[first[i] : first[i + 1]]
                keys.append(text_key(own, data[offsets[i] : offsets[i + 1]].tobytes()) if ok else None)
                entries.append(sketch(shingles(own, size), odd, picks).view(np.int64) if len(own) else np.zeros(0, np.int64))
                sizes.append(len(own))
            return [pa.array(keys, pa.int64()), pa.array(entries, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]

        return step

    return common.add_columns(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", fields, work, SLICE).drop("text")


def few(rows: DataFrame) -> DataFrame:
    """``rows``, to be sent to every executor if they are ``FEW_PAIRS`` at most, so that a join need not move its other side. Written rows, for they are counted."""
    return F.broadcast(rows) if rows.count() <= FEW_PAIRS else rows


def likely(docs: DataFrame, wanted: DataFrame, on: str = "id") -> DataFrame:
    """The rows of ``docs`` whose id may be among those of ``wanted``: a map of bits by hash of the id, 16 an id, ``FILTER_BITS`` at most.

    What the map lets pass in error is joined in vain; beyond that size it lets more pass, none less.
    """
    bits = min(FILTER_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(on), F.lit(bits))
    found = wanted.select(F.shiftright(slot, 3).alias("at"), F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(7).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 3, np.uint8)
    table[found.column("at").to_numpy()] = found.column("bit").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))

    marked = docs.withColumn("slot", slot)
    return marked.mapInArrow(run, marked.schema).drop("slot")


def sequences(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, seq (its words), n (their number) and map (of their parities) of the wanted texts. wanted: k and the id of a document that has the text."""
    wanted = common.cut(wanted, "wanted")
    picked = likely(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted).join(few(wanted).withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).select("k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                data, offsets = common.buffers(part.column("text"))
                low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)
                words = wh.word_hashes(low, starts, ends)
                keys, out = [], []
                for i, k in enumerate(part.column("k").to_pylist()):
                    own = words[first[i] : first[i + 1]]
                    if len(own) and text_key(own, b"") == k:  # ids may repeat with other texts
                        keys.append(k)
                        out.append(own.view(np.int64))
                about = [pa.array([len(x) for x in out], pa.int64()), pa.array([parity_map(x.view(U)) for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int64())), *about], names=["k", "seq", "n", "map"])
        common.give_back()

    found = common.cut(picked.mapInArrow(run, "k long, seq array<long>, n long, map binary"), "sequences")
    # A row that is there twice gives a text twice; without such rows the sequences need not move.
    twice = found.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").head(1)
    return common.cut(found.groupBy("k").agg(*[F.first(x).alias(x) for x in ("seq", "n", "map")]), "sequences") if twice else found


def beside(pairs: DataFrame, seqs: DataFrame, *columns: str) -> DataFrame:
    """a, b, and of each text the columns of ``seqs``, as x_ and y_.

    ``FEW_PAIRS`` at most (16 MB) go to every executor, so that only what a pair needs moves; more of them meet the sequences in a shuffle.
    """
    pairs = few(pairs)
    of = lambda end, name: seqs.select(F.col("k").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return of("a", "x").join(pairs, "a").join(of("b", "y").join(pairs.select("b"), "b", "left_semi"), "b")


def aligned(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """a, b and s, the similarity of each pair (an upper bound of it below ``least``).

    The parity maps meet first, which are small. Only the sequences of pairs that these do not rule out move.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [most_similar(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("x_map", "y_map", "x_n", "y_n")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "s"])
        common.give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x_seq"), batch.column("y_seq")
            s = [similarity(x[i].values.to_numpy().view(U), y[i].values.to_numpy().view(U), least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "s"])
        common.give_back()

    bounded = beside(common.cut(pairs, "pairs"), seqs, "n", "map").select("a", "b", "x_n", "y_n", "x_map", "y_map")
    bounded = common.cut(bounded.mapInArrow(bound, "a long, b long, s double"), "bounded")
    met = beside(bounded.where(F.col("s") >= least).select("a", "b"), seqs, "seq")
    return bounded.where(F.col("s") < least).unionByName(met.select("a", "b", "x_seq", "y_seq").mapInArrow(run, "a long, b long, s double"))


def with_hub(buckets: DataFrame) -> DataFrame:
    """k, n, met, hub, hub_n, hub_met: members of buckets of two or more beside their bucket's hub. buckets: k, n and bucket."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.cut(buckets.join(sizes, "bucket"), "shared")
    shared = common.cut(shared.join(shared.groupBy("k").agg(F.sum("size").alias("met")), "k"), "met")
    first = F.max(F.struct("met", F.negative("k").alias("k"), "n")).alias("h")
    hubs = shared.groupBy("bucket").agg(first).select("bucket", F.negative("h.k").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.met").alias("hub_met"))
    return shared.join(hubs, "bucket").where("k <> hub").select("bucket", "k", "n", "met", "hub", "hub_n", "hub_met")


def towards_hub(rows: DataFrame) -> DataFrame:
    """bucket, k, n, met, hub, hub_n: texts of another class than their bucket's hub, the text of largest ``met``. rows: k, n, met, c and bucket.

    Buckets of one class are left out by their smallest and largest class, and a hub's class never meets it, so a large class adds
    no rows to the join. Nearly all buckets are of one class, so this is asked first: bucket and class alone move for it.
    """
    mixed = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    rows = likely(rows, common.cut(mixed, "mixed"), "bucket")
    first = F.max(F.struct("met", F.negative("k").alias("k"), "n", "c")).alias("h")
    hubs = rows.groupBy("bucket").agg(first, F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    hubs = hubs.select("bucket", F.negative("h.k").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.c").alias("hub_c"))
    return rows.join(hubs, "bucket").where("c <> hub_c").select("bucket", "k", "n", "met", "hub", "hub_n")


def near_length(n: str, other: str, least: float) -> Column:
    """Whether texts of so many shingles can reach the limit: L is at most the smaller number."""
    return F.least(n, other) >= F.greatest(n, other) * least - 1e-9


def fine_buckets(seqs: DataFrame) -> DataFrame:
    """k, n, met, c and bucket: the finer sketch's entries. seqs: k, met, c and seq."""
    coarse, fine = seeds(FINE[0]), wh.mix(seeds(FINE_LONG[0]) ^ U(FINE_LONG[1])) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, entries = [], []
            for seq in batch.column("seq"):
                own = seq.values.to_numpy().view(U)
                found = [sketch(own, coarse, FINE[1])]
                if len(own) >= LONG:
                    found.append(sketch(own, fine, FINE_LONG[1]))
                entries.append(np.unique(np.concatenate(found)).view(np.int64))
                sizes.append(len(own))
            if not entries:
                continue
            each = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
            about = [pa.array(x) for x in (batch.column("k").to_numpy()[each], np.array(sizes)[each], batch.column("met").to_numpy()[each], batch.column("c").to_numpy()[each])]
            yield pa.RecordBatch.from_arrays([*about, pa.array(np.concatenate(entries))], names=["k", "n", "met", "c", "bucket"])
        common.give_back()

    return seqs.select("k", "met", "c", "seq").mapInArrow(run, "k long, n long, met long, c long, bucket long")


def rareness(seqs: DataFrame) -> np.ndarray:
    """How often labelled words of a place of the table occur, in steps of a tenth; 0: once at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << RARE_BITS, np.int64)
        for batch in batches:
            for seq in batch.column("seq"):
                np.add.at(seen, labelled(seq.values.to_numpy().view(U)) >> U(64 - RARE_BITS), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["at", "n"])
        common.give_back()

    level = F.floor(F.log2(F.sum("n")) * 7).cast("byte").alias("level")
    found = seqs.select("seq").mapInArrow(run, "at int, n long").groupBy("at").agg(level).toArrow()
    table = np.zeros(1 << RARE_BITS, np.int8)
    table[found.column("at").to_numpy()] = found.column("level").to_numpy()
    return table


def rare_buckets(seqs: DataFrame, least: float) -> DataFrame:
    """k, n, bucket and at: a text's rarest labelled words, and their places in its order of rareness. Two texts that reach ``least`` share one.

    Of n words ``least`` * n at least are in the other text too, so one of any n - ``least`` * n + 1 is. Words that occur once are left out.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(rareness(seqs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            words, places, sizes = [], [], []
            for seq in batch.column("seq"):
                g = labelled(seq.values.to_numpy().view(U))
                level = table[g >> U(64 - RARE_BITS)]
                first = np.lexsort((g, level))[: len(g) - int(np.ceil(least * len(g) - 1e-9)) + 1]
                at = np.flatnonzero(level[first])
                words.append(g[first[at]].view(np.int64))
                places.append(at)
                sizes.append(len(g))
            if not words:
                continue
            each = np.repeat(np.arange(len(words)), [len(w) for w in words])
            about = [pa.array(x) for x in (batch.column("k").to_numpy()[each], np.array(sizes)[each], np.concatenate(words), np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(about, names=["k", "n", "bucket", "at"])
        common.give_back()

    return seqs.select("k", "seq").mapInArrow(run, "k long, n long, bucket long, at long")


def rest_pairs(rows: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """a and b: texts of a bucket that are of different classes and can reach the limit. rows: k, n, bucket and perhaps at; found: k and c.

    at: so many words of the text are none of the other's, if this is the first bucket that both are in. L is at most what is left of either
    text; without at, these are their lengths. A bucket's largest class never meets itself, so it adds no more than a row for each other text.
    """
    rows = rows if "at" in rows.columns else rows.withColumn("at", F.lit(0))
    rows = common.cut(rows.join(few(found), "k", "left").withColumn("c", F.coalesce("c", "k")), "rest")
    # Rows move once: the sums need no other order than the join.
    rows = rows.repartition("bucket")
    own, all_ = W.partitionBy("bucket", "c"), W.partitionBy("bucket")
    rows = rows.withColumn("own", F.count("*").over(own)).withColumn("most", F.max(F.struct("own", "c")).over(all_))
    rows = rows.withColumns({"size": F.count("*").over(all_), "low": F.min("c").over(all_), "high": F.max("c").over(all_)}).where("low < high")
    rows = rows.select("bucket", "k", "n", "c", "at", F.col("most.c").alias("top"), "size")
    of = lambda name: [F.col(x).alias(f"{x}_{name}") for x in ("k", "n", "c", "at")]
    enough = F.least(F.expr("n_x - at_x"), F.expr("n_y - at_y")) >= (F.col("n_x") + F.col("n_y")) * (least / (1 + least)) - 1e-6
    can = (F.col("c_x") != F.col("c_y")) & (F.col("large") | (F.col("k_x") > F.col("k_y"))) & enough

    def met(rows: DataFrame, x_parts: list[Column], y_parts: list[Column]) -> DataFrame:
        x = rows.where("c <> top").select("bucket", *x_parts, *of("x"))
        y = rows.select("bucket", *y_parts, (F.col("c") == F.col("top")).alias("large"), *of("y"))
        return x.join(y, ["bucket", *["part"] * len(x_parts)]).where(can).select(F.greatest("k_x", "k_y").alias("a"), F.least("k_x", "k_y").alias("b"))

    # Larger buckets are dealt out, and so move again.
    parts = F.expr("(size - 1) div 1024 + 1")
    dealt = met(rows.where("size > 1024"), [F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")], [F.pmod(F.xxhash64("k"), parts).alias("part")])
    return met(rows.where("size <= 1024"), [], []).unionByName(dealt).distinct()


def between_classes(starred: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``starred`` whose text and hub are of different classes, with the text's as c. Each text and hub are looked up once, not once a bucket."""
    of = lambda name: found.withColumnsRenamed({"k": name, "c": f"_c_{name}"})
    pairs = starred.select("k", "hub").distinct().join(of("k"), "k", "left").join(of("hub"), "hub", "left")
    return starred.join(pairs.where(F.coalesce("_c_k", "k") != F.coalesce("_c_hub", "hub")).select("k", "hub", F.coalesce("_c_k", "k").alias("c")), ["k", "hub"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """k and c, the smallest key that links lead to. edges: a, b. Labels fall along links and then along labels."""
    both = edges.select(F.col("a").alias("k"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("k"), F.col("a").alias("other"))).distinct()
    both = common.cut(both, "edges")
    labels = common.cut(both.groupBy("k").agg(F.least(F.min("other"), F.first("k")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"k": "other", "c": "c2"}), "other").groupBy("k").agg(F.min("c2").alias("c2"))
        hooked = labels.join(near, "k").select("k", "c", F.least("c", "c2").alias("n"))
        jumped = hooked.join(labels.withColumnsRenamed({"k": "n", "c": "c3"}), "n", "left").select("k", "c", F.least("n", "c3").alias("n"))
        now = common.cut(jumped, "labels")
        if not now.where("n <> c").head(1):
            return labels
        labels = now.select("k", F.col("n").alias("c"))


def joined_classes(spark: SparkSession, found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (k, c) after further links (a, b), which join whole classes."""
    of = lambda name: found.withColumnsRenamed({"k": name, "c": f"c_{name}"})
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    ends = common.cut(ends, "joined")
    fused = components(spark, ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("k").alias("c"), F.col("c").alias("now"))
    members = found.union(ends.select("a", "x")).union(ends.select("b", "y")).distinct()
    return common.cut(members.join(fused, "c", "left").select("k", F.coalesce("now", "c").alias("c")), "classes")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, picks: int = PICKS, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(id, k) of every document, and (k, class_id, class_k, class_size) of every distinct text; class_k: the text of the class's first id."""
    spark = docs.sparkSession
    signed = common.cut(signatures(docs, id_col, text_col, size, bands, picks), "signatures")
    texts = common.cut(
        signed.where("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "texts"
    )

    bucket_rows = texts.select("k", "n", F.explode("sketch").alias("bucket"))
    starred = common.cut(with_hub(bucket_rows), "buckets")
    wanted = starred.select("k").union(starred.select(F.col("hub").alias("k"))).distinct()
    seqs = sequences(docs, texts.join(wanted, "k").select("k", "id"), id_col, text_col)

    met = lambda rows: rows.where(near_length("n", "hub_n", least)).select(F.greatest("k", "hub").alias("a"), F.least("k", "hub").alias("b")).distinct()
    tested = common.cut(aligned(met(starred), seqs, least), "tested")
    found = components(spark, tested.where(F.col("s") >= least).select("a", "b"))

    # Buckets in which a text is not of its hub's class: all their texts meet again by the finer sketch.
    again = starred.join(between_classes(starred, found).select("bucket").distinct(), "bucket")
    again = again.select("k", "met").union(again.select(F.col("hub").alias("k"), F.col("hub_met").alias("met"))).distinct()
    again = common.cut(again.join(found, "k", "left").withColumn("c", F.coalesce("c", "k")), "again")
    contested = common.cut(seqs.join(few(again), "k").select("k", "met", "c", "seq"), "contested")
    left = common.cut(fine_buckets(contested), "fine")
    common.release(spark)
    while True:
        starred = common.cut(towards_hub(left), "fine-buckets")
        fresh = common.cut(aligned(met(starred).join(tested.select("a", "b"), ["a", "b"], "left_anti"), seqs, least), "tested")
        links = fresh.where(F.col("s") >= least).select("a", "b")
        tested = tested.unionByName(fresh)
        if not links.head(1):
            break
        found = joined_classes(spark, found, links)
        left = common.cut(between_classes(starred, found).select("k", "n", "met", "c", "bucket"), "fine")

    common.release(spark)
    # What no hub has joined: every pair of two classes that rare words do not rule out.
    rest = rest_pairs(rare_buckets(contested, least), found, least).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    links = common.cut(aligned(rest, seqs, least), "tested").where(F.col("s") >= least).select("a", "b")
    if links.head(1):
        found = joined_classes(spark, found, links)

    grouped = common.cut(texts.select("k", "id", "copies").join(found, "k", "left").withColumn("c", F.coalesce("c", "k")), "grouped")
    first = F.struct(F.col("id").isNull().alias("z"), "id", "k")
    ends = grouped.groupBy("c").agg(F.min(first).alias("_first"), F.sum("copies").alias("class_size")).select("c", F.col("_first.id").alias("class_id"), F.col("_first.k").alias("class_k"), "class_size")
    return signed.select("id", "k"), grouped.select("k", "c").join(ends, "c").select("k", "class_id", "class_k", "class_size")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """id_col, class_id and class_size (documents) of every document."""
    members, found = classes(docs, id_col=id_col, text_col=text_col, **settings)
    return members.join(found, "k", "left").select(
        F.col("id").alias(id_col), F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one row of its smallest id; null texts all stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    members, found = classes(docs, id_col=id_col, text_col=text_col, **settings)
    id_, key = common.fresh(docs, "id"), common.fresh(docs, "key")
    stay = found.where("k = class_k").select(F.col("class_id").alias(id_), F.col("k").alias(key))
    # Ids are spread however large a class is.
    met = docs.where(F.col(text_col).isNotNull()).join(stay, F.col(id_col).eqNullSafe(F.col(id_))).drop(id_)
    nulls = docs.where(F.col(text_col).isNull())
    if not members.where("k is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head(1):
        return met.select(*docs.columns).unionByName(nulls)
    # An id belongs to several rows, perhaps of other texts, so the text is held against the key.
    arrow = to_arrow_schema(met.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text_col, SLICE):
                same = pa.array([k == w for k, w in zip(part.column(key).to_pylist(), text_keys(part.column(text_col)), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns, schema=arrow).filter(same)
        common.give_back()

    one = met.mapInArrow(run, met.schema).dropDuplicates([key]).drop(key)
    return one.select(*docs.columns).unionByName(nulls)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its class and its class's number of documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
