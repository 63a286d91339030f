"""Language-model scores by online logistic mixing of bit predictors, beside a unigram baseline.

The model codes a text's bytes, then an end mark, bit by bit. A predictor of order k has, for each pair of the last k
bytes and the bits of the current byte so far, how often a 0 and a 1 followed in the training texts. The predictors' logits
are added with weights that a gate chooses: the number of the bit, and how often the longest context was seen. After each bit
the weights that were used move along the slope of what it cost (online logistic regression), and the mixed logit is refined
by a further adaptive stage: a lift by number of the bit and size of the logit, which moves after each bit too. Each
prediction only uses what came before, and a bit's two probabilities add up to one, so the score is the logarithm of a proper
probability of the whole text, and ``total_bits`` is the length of a code for it.

Bits that the mixture is sure of where a lane begins (a logit of ``sure`` and more, whichever value the bit then has) are coded
by that mixture as it is; they cost next to nothing and would move next to nothing. All others are coded online; with ``sure`` None
every bit is.

A text is coded in lanes of ``lane`` bytes. Contexts run on from lane to lane; weights and lifts begin anew in each, with what
was fitted on the training texts; with ``lane`` None they run on to the text's end. Lanes do not depend on each other, so all lanes of a slice take their steps together: a step
is the next byte of every lane, whose bits are coded at once. As the gate and the lift know the number of the bit, no bit
of a byte uses a weight or a lift that another bit of that byte moves: the result is that of one bit after the other.

Counts cover every training text and grow with the corpus. With contexts of four bytes a symbol's probability depends on
five bytes, a gram. Texts are dealt into pieces of some ``PIECE`` bytes; the distinct grams of each piece are counted and
summed by Spark into one distributed table, a row a gram of the corpus, with the exact counts of orders 3 and 4 on its path
of bits (contexts that share three bytes are worked on together, at most 65536 rows). Orders 1 and 2 have at most 2 ** 24
grams, far fewer in UTF-8, whatever the corpus; they are broadcast. Where lanes begin is fitted by passes over all grams of
that table (Newton steps by gate, then by lift, sums in Spark). A piece's grams meet their logits of the long orders, one
byte each, in an equi-join, and come to the piece's texts by its number.

Baseline counts of words are not bounded, so they are never broadcast: a task sends each word's postings (text, frequency)
once a slice, these meet the counts in an equi-join that splits hot words, and come back as sums by text.

Defined cases: null text is empty and scores its end mark; with no training texts all counts are 0 and bits are fair; null
ids are never held out and come back null; repeated rows come back once each; tokens are told apart by 64-bit hashes; a text
without bytes has no ``bits_per_byte``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm import common, wordhash as wh
from confab.llm.language import fold

U = np.uint64
ORDERS = (1, 2, 3, 4)
#: Gates: number of the bit, and level of the longest context's count.
BITS, LEVELS = 8, 8
GATES = BITS * LEVELS
#: Sizes of the mixed logit that have a lift of their own, and how many there are to a unit.
LIFTS, PER_UNIT = 21, 2
#: Largest logit; logits travel in units of 1 / SCALE.
TOP, SCALE = 10.4, 12.0
#: Bytes of a lane, lanes that take their steps together (what they learn fits a core's cache), and steps that are laid out at once.
LANE, LANES, STEPS = 4096, 1024, 64
#: Logit of the mixture a lane begins with, from which a bit is coded by it as it is.
SURE = 5.0
#: Steps of the weights and of the lifts after a bit: at first, and at the least.
RATE, LEAST_RATE, LIFT_RATE = 0.02, 0.005, 0.02
SLICE = 1 << 20
#: Compression of the pieces' texts, which are written once and moved once.
LEVEL = 4
#: Bytes, and rows, of the texts whose distinct grams meet the corpus's counts together.
PIECE, PIECE_ROWS = 16 << 20, 1 << 20
#: Passes over the corpus's grams that fit the weights, and the pull towards where they begin.
PASSES, START, RIDGE, ENOUGH = 8, 0.3, 1.0, 1e-3
#: Distinct pairs that a task holds before it passes them on.
HELD = 1 << 20


# ---- bytes and contexts


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-byte grams (context above, symbol lowest) of every scored position, and where each text's positions begin.

    Four zero bytes stand before and after each text; the first one after it is its end mark.
    """
    sizes = np.diff(offsets)
    n = len(sizes)
    gap = len(ORDERS)
    padded = np.zeros(len(data) + gap * (n + 1), np.uint8)
    owner_shift = np.repeat(np.arange(1, n + 1) * gap, sizes)
    padded[np.arange(len(data)) + owner_shift] = data
    wide = padded.astype(U)
    gram = wide[gap:].copy()
    for i in range(1, gap + 1):
        gram |= wide[gap - i : len(wide) - i] << U(8 * i)
    scored = np.zeros(len(gram), bool)  # gram[j] is the symbol at padded[j + gap]
    begin = offsets[:-1] + np.arange(n) * gap
    scored[np.arange(len(data)) + owner_shift - gap] = True
    scored[begin + sizes] = True
    return gram[scored], np.concatenate(([0], np.cumsum(sizes + 1)))


def level(total: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(most, np.ceil(np.log2(total + 1))).astype(np.int64)


# ---- online mixing


@dataclass
class Start:
    """Where each lane begins: weights by gate and order, and lifts by bit and size of logit."""

    weights: np.ndarray
    lifts: np.ndarray


@dataclass
class Symbols:
    """The bits of distinct grams: what the sure ones cost (natural log by gram), and logits, gate and lift of the others.

    ``first`` and ``n`` say which rows of ``logits`` (four bytes as one item), ``gate`` and ``lift`` are a gram's.
    """

    sure: np.ndarray
    first: np.ndarray
    n: np.ndarray
    logits: np.ndarray
    gate: np.ndarray
    lift: np.ndarray


def symbols(codes: np.ndarray, start: Start, sure_from: float | None = SURE) -> Symbols:
    """codes: ``coded``. All logits are those of the bit that did occur; sureness and lifts only see their size."""
    weights, lifts = start.weights.astype(np.float32), start.lifts.astype(np.float32).ravel()
    sure, n, logits_, gate_ = [], [], [], []
    for at in range(0, max(len(codes), 1), 1 << 16):
        part = codes[at : at + (1 << 16)]
        x, gate = part[:, : BITS * len(ORDERS)].reshape(-1, BITS, len(ORDERS)), part[:, BITS * len(ORDERS) :]
        mixed = np.clip((weights[gate] * (x * np.float32(1 / SCALE))).sum(axis=2), -TOP, TOP)
        known = np.abs(mixed) >= (np.inf if sure_from is None else sure_from)
        mixed += np.sign(mixed) * lifts[np.arange(BITS) * LIFTS + (np.abs(mixed) * PER_UNIT).astype(np.int64)]
        sure.append(np.where(known, -np.logaddexp(0, -np.clip(mixed, -TOP, TOP)), 0).sum(axis=1, dtype=np.float64))
        n.append(BITS - known.sum(axis=1))
        logits_.append(x[~known])
        gate_.append(gate[~known])
    n, gate = np.concatenate(n), np.concatenate(gate_).astype(np.int32)
    return Symbols(np.concatenate(sure), np.cumsum(n) - n, n, np.ascontiguousarray(np.concatenate(logits_)).view(np.int32).ravel(), gate, gate // LEVELS * LIFTS)


def lanes(known: Symbols, rows: np.ndarray, begin: np.ndarray, length: np.ndarray, start: Start) -> np.ndarray:
    """Natural log probability of each lane. begin: its first place in ``rows``, which has each position's gram; length: must descend."""
    n = len(begin)
    weights = np.tile(start.weights.astype(np.float32).ravel(), n)
    sets = weights.view(np.complex128)  # the four weights of a gate move as one item
    lifts = np.tile(start.lifts.astype(np.float32).ravel(), n)
    out = np.zeros(n)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if n else 0), side="left")
    for at in range(0, len(live), STEPS):
        count = live[at : at + STEPS]
        lane = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gram = rows.take(begin[lane] + at + np.repeat(np.arange(len(count)), count))
        size = known.n.take(gram)
        ends = np.cumsum(size)
        bit = np.repeat(known.first.take(gram) - ends + size, size) + np.arange(ends[-1])
        owner = np.repeat(lane, size)
        x = known.logits.take(bit).view(np.int8).reshape(-1, len(ORDERS)).astype(np.float32)
        x *= np.float32(1 / SCALE)
        sets_at = owner * GATES + known.gate.take(bit)
        lifts_at = owner * (BITS * LIFTS) + known.lift.take(bit)
        missed = np.empty(len(bit), np.float32)
        a = 0
        for i, b in enumerate(ends[np.cumsum(count) - 1].tolist(), at):
            where = sets_at[a:b]
            w, v = sets.take(where).view(np.float32).reshape(-1, len(ORDERS)), x[a:b]
            parts = w * v
            mixed = parts[:, 0] + parts[:, 1]
            mixed += parts[:, 2]
            mixed += parts[:, 3]
            np.clip(mixed, -TOP, TOP, out=mixed)
            miss = 1 / (1 + np.exp(mixed))
            miss *= np.float32(max(LEAST_RATE, RATE / (1 + i) ** 0.5))
            v *= np.repeat(miss, len(ORDERS)).reshape(v.shape)
            w += v
            sets[where] = w.view(np.complex128).ravel()
            slot = lifts_at[a:b] + (np.abs(mixed) * np.float32(PER_UNIT)).astype(np.int64)
            lift, sign = lifts.take(slot), np.sign(mixed)
            mixed += sign * lift
            np.clip(mixed, -TOP, TOP, out=mixed)
            miss = missed[a:b] = 1 / (1 + np.exp(mixed))
            lifts[slot] = lift + miss * sign * np.float32(LIFT_RATE)
            a = b
        out += np.bincount(owner, weights=np.log1p(-missed), minlength=n) + np.bincount(lane, weights=known.sure.take(gram), minlength=n)
    return out


def online(codes: np.ndarray, rows: np.ndarray, first: np.ndarray, start: Start, sure: float | None = SURE, lane: int | None = LANE) -> np.ndarray:
    """log10 of each text's probability. rows: each position's row of ``codes``; first: where texts begin in it."""
    n = np.diff(first)
    lane = max(1, int(n.max(initial=1))) if lane is None else lane
    count = -(-n // lane)
    owner = np.repeat(np.arange(len(n)), count)
    begin = first[owner] + (np.arange(len(owner)) - (np.cumsum(count) - count)[owner]) * lane
    length = np.minimum(lane, first[owner + 1] - begin)
    order = np.argsort(-length, kind="stable")  # lanes that still go on are a prefix
    got, known = np.zeros(len(owner)), symbols(codes, start, sure)
    for a in range(0, len(owner), LANES):
        at = order[a : a + LANES]
        got[at] = lanes(known, rows, begin[at], length[at], start)
    return np.bincount(owner, weights=got, minlength=len(n)) / np.log(10)


# ---- exact counts


def depths(keys: np.ndarray, c: np.ndarray) -> np.ndarray:
    """At row b, how often each key's context was followed by the first b bits of its symbol. keys: sorted, the symbol lowest."""
    out = np.zeros((9, len(keys)))
    for b in range(9 if len(keys) else 0):
        prefix = keys >> U(8 - b)
        new = np.concatenate(([True], prefix[1:] != prefix[:-1]))
        out[b] = np.add.reduceat(c, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def deep(grams: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams in order, their counts, and their depths in orders 3 and 4: (gram, order, bits). All grams of a three-byte context must be there."""
    at = np.argsort(grams)
    grams, c = grams[at], c[at]
    short = grams & U(0xFFFFFFFF)
    at = np.argsort(short, kind="stable")
    out = np.empty((len(grams), 2, 9), np.float32)
    out[at, 0] = depths(short[at], c[at]).T
    out[:, 1] = depths(grams, c).T
    return grams, c, out


class Low:
    """Exact counts of orders 1 and 2, as running sums over sorted keys."""

    def __init__(self, keys: np.ndarray, c: np.ndarray):
        """keys: two bytes of context and a symbol."""
        self.keys, self.sums = {}, {}
        for order in (1, 2):
            k, at = np.unique(keys & U((1 << (8 * order + 8)) - 1), return_inverse=True)
            self.keys[order] = k
            self.sums[order] = np.concatenate(([0.0], np.cumsum(np.bincount(at, weights=c, minlength=len(k)))))

    def depths(self, grams: np.ndarray, order: int) -> np.ndarray:
        k, back = np.unique(grams & U((1 << (8 * order + 8)) - 1), return_inverse=True)
        out = np.empty((9, len(k)))
        for b in range(9):
            begin = k >> U(8 - b) << U(8 - b)
            ends = (np.searchsorted(self.keys[order], x) for x in (begin, begin + (U(1) << U(8 - b))))
            begin, end = (self.sums[order][x] for x in ends)
            out[b] = end - begin
        return out[:, back]


def logits(depth: np.ndarray, bit: int) -> np.ndarray:
    return np.log((depth[bit + 1] + 0.3) / (depth[bit] - depth[bit + 1] + 0.3))


def gates(depth: np.ndarray, bit: int) -> np.ndarray:
    """depth: that of the longest context."""
    return bit * LEVELS + level(depth[bit], LEVELS - 1)


def inputs(low: Low, grams: np.ndarray, high: np.ndarray, less: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each bit of the symbols its number, its logits by order, and the gate. less: occurrences of the gram itself that do not count."""
    t = [low.depths(grams, 1), low.depths(grams, 2), high[:, 0].T.astype(np.float64), high[:, 1].T.astype(np.float64)]
    t = [np.maximum(x - less, 0) for x in t]
    for bit in range(BITS):
        yield bit, np.stack([logits(d, bit) for d in t], axis=1), gates(t[3], bit)


def in_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * SCALE), -127, 127).astype(np.int8)


def coded_high(high: np.ndarray) -> np.ndarray:
    """Of each gram the logits of its bits in orders 3 and 4, a byte each, and the levels that make its gates, half a byte each."""
    t = [high[:, i].T.astype(np.float64) for i in (0, 1)]
    out, levels = np.empty((len(high), 20), np.int8), np.empty((len(high), BITS), np.uint8)
    for bit in range(BITS):
        out[:, bit], out[:, BITS + bit] = in_bytes(logits(t[0], bit)), in_bytes(logits(t[1], bit))
        levels[:, bit] = gates(t[1], bit) - bit * LEVELS
    out[:, 16:] = (levels[:, ::2] | levels[:, 1::2] << 4).view(np.int8)
    return out


def coded(low: Low, grams: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each gram the logits of its bits by order, and their gates. high: ``coded_high``."""
    out = np.empty((len(grams), BITS * (len(ORDERS) + 1)), np.int8)
    for at in range(0, len(grams), 1 << 16):
        part = slice(at, at + (1 << 16))
        t = [low.depths(grams[part], 1), low.depths(grams[part], 2)]
        x = np.empty((len(grams[part]), BITS, len(ORDERS)), np.int8)
        levels = high[part, 16:].view(np.uint8)
        for bit in range(BITS):
            x[:, bit, 0], x[:, bit, 1], x[:, bit, 2], x[:, bit, 3] = in_bytes(logits(t[0], bit)), in_bytes(logits(t[1], bit)), high[part, bit], high[part, BITS + bit]
            out[part, BITS * len(ORDERS) + bit] = bit * LEVELS + ((levels[:, bit // 2] >> (4 * (bit % 2))) & 15)
        out[part, : BITS * len(ORDERS)] = x.reshape(len(x), -1)
    return out


def loss_sums(low: Low, weights: np.ndarray, grams: np.ndarray, c: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By gate: the loss in nats, its slope (4) and curvature (16), over all occurrences; each one's own is out of the counts it sees."""
    n = len(ORDERS)
    out = np.zeros((GATES, 1 + n + n * n))
    for _, x, gate in inputs(low, grams, high, 1):
        total = (weights[gate] * x).sum(axis=1)
        miss = 1 / (1 + np.exp(np.clip(total, -500, 500)))
        add = lambda v, gate=gate: np.bincount(gate, weights=v, minlength=GATES)
        out[:, 0] += add(c * np.logaddexp(0, -total))
        for i in range(n):
            out[:, 1 + i] += add(c * miss * x[:, i])
            for j in range(i, n):
                both = add(c * miss * (1 - miss) * x[:, i] * x[:, j])
                out[:, 1 + n + i * n + j] += both
                if i != j:
                    out[:, 1 + n + j * n + i] += both
    return out


def lift_sums(low: Low, weights: np.ndarray, grams: np.ndarray, c: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By lift: slope and curvature of the loss at no lift, over all occurrences; each one's own is out of the counts it sees."""
    out = np.zeros((BITS * LIFTS, 2))
    for bit, x, gate in inputs(low, grams, high, 1):
        total = np.clip((weights[gate] * x).sum(axis=1), -TOP, TOP)
        slot = bit * LIFTS + (np.abs(total) * PER_UNIT).astype(np.int64)
        miss = 1 / (1 + np.exp(total))
        out[:, 0] += np.bincount(slot, weights=c * miss * np.sign(total), minlength=len(out))
        out[:, 1] += np.bincount(slot, weights=c * miss * (1 - miss), minlength=len(out))
    return out


def newton(sums, passes: int = PASSES) -> np.ndarray:
    """Gated weights. sums: weights to ``loss_sums`` over all grams; each call is a pass, and a pass that gains next to nothing is the last.

    A gate whose loss rose goes half the way.
    """
    n = len(ORDERS)
    w = best = np.full((GATES, n), START)
    least, step, before = np.full(GATES, np.inf), np.zeros((GATES, n)), np.inf
    for _ in range(passes):
        got = sums(w)
        better = got[:, 0] <= least
        best = np.where(better[:, None], w, best)
        least = np.minimum(least, got[:, 0])
        if before - least.sum() <= ENOUGH * least.sum():
            break
        before = least.sum()
        slope = got[:, 1 : 1 + n] - RIDGE * (w - START)
        fresh = np.linalg.solve(got[:, 1 + n :].reshape(-1, n, n) + RIDGE * np.eye(n), slope[:, :, None])[:, :, 0]
        step = np.where(better[:, None], fresh, step / 2)
        w = np.clip(best + step, -0.5, 2.0)
    return np.round(best, 6)


# ---- counting over the corpus


class Tally:
    """Sums of counts by key, of a bounded number of keys."""

    def __init__(self):
        self.k, self.c, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether it is full, so that ``take`` is due."""
        self.k.append(keys)
        self.c.append(counts)
        self.held += len(keys)
        if self.held <= HELD:
            return False
        k, c = self.take()
        self.k, self.c, self.held = [k], [c], len(k)
        return len(k) > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate(self.k or [np.zeros(0, U)]), np.concatenate(self.c or [np.zeros(0, np.int64)])
        self.k, self.c, self.held = [], [], 0
        order = np.argsort(k, kind="stable")  # what was added is in order, which this kind makes use of
        k, c = k[order], c[order]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        return k[head], np.add.reduceat(c, head).astype(np.int64) if len(k) else c.astype(np.int64)


def counted(pieces: DataFrame, keys) -> DataFrame:
    """k and its number of occurrences, over all training texts. keys: bytes and offsets to an array of 64-bit keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def give() -> pa.RecordBatch:
            k, c = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["k", "c"])

        for batch in batches:
            for data in batch.column("slice"):
                part = unpacked(data.as_py())
                if tally.add(*np.unique(keys(*common.buffers(part.column("text").filter(part.column("train")))), return_counts=True)):
                    yield give()
        yield give()

    return pieces.select("slice").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def word_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return wh.word_hashes(*wh.bounds(data, offsets, wh.NONBLANK)[:3])


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def in_pieces(rows: DataFrame) -> DataFrame:
    """piece, part and slice: ``rows`` (id, text, train) in slices of a bounded size, packed, by number of piece. Written down so that numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, n, order = TaskContext.get().partitionId() << 20, 0, 0, 0
        held, held_size = [], 0

        def give() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([order]), pa.array([packed(whole)])], names=["piece", "part", "slice"])

        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and held_size + own > SLICE:
                    yield give()
                    held, held_size, order = [], 0, order + 1
                if size >= PIECE or n >= PIECE_ROWS:
                    if held:
                        yield give()
                    held, held_size, number, size, n, order = [], 0, number + 1, 0, 0, 0
                held.append(part)
                held_size, size, n = held_size + own, size + own, n + part.num_rows
        if held:
            yield give()

    return common.cut(rows.mapInArrow(run, "piece long, part long, slice binary"), "pieces")


def grams_of_pieces(pieces: DataFrame) -> DataFrame:
    """piece, k and c: the grams of each piece, and how often its training texts have them. A piece may give a gram in two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, tally = 0, Tally()

        def give() -> pa.RecordBatch:
            k, c = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), piece)), pa.array(k.view(np.int64)), pa.array(c)], names=["piece", "k", "c"])

        for batch in batches:
            for own, data in zip(batch.column("piece").to_pylist(), batch.column("slice"), strict=True):
                part = unpacked(data.as_py())
                if own != piece:
                    yield give()
                    piece = own
                for train in (True, False):
                    texts = part.column("text").filter(pc.equal(part.column("train"), train))
                    k, c = np.unique(layout(*common.buffers(texts))[0], return_counts=True)
                    if tally.add(k, c * train):
                        yield give()
        yield give()

    return common.cut(pieces.select("piece", "slice").mapInArrow(run, "piece long, k long, c long"), "piece-grams")


def counted_grams(needed: DataFrame) -> DataFrame:
    """k, c and deep (``deep`` as bytes) of every gram of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            k, c, high = deep(k, c.astype(np.float64))
            width = high.itemsize * 18
            ends = np.arange(len(k) + 1, dtype=np.int32) * width
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends), pa.py_buffer(high.tobytes())])], names=["k", "c", "deep"])

        k, c = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.concatenate((k, batch.column("k").to_numpy().view(U)))
            c = np.concatenate((c, batch.column("c").to_numpy()))
            context = (k >> U(8)) & U(0xFFFFFF)
            done = int(np.searchsorted(context, context[-1]))  # the last context may go on
            if done:
                yield give(k[:done], c[:done])
                k, c = k[done:], c[done:]
        if len(k):
            yield give(k, c)

    summed = needed.groupBy("k").agg(F.sum("c").alias("c")).withColumn("context", F.shiftright("k", 8).bitwiseAND(F.lit(0xFFFFFF)))
    return common.cut(summed.repartition("context").sortWithinPartitions("context").select("k", "c").mapInArrow(run, "k long, c long, deep binary"), "grams")


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Grams and depths of a batch of ``counted_grams``."""
    return batch.column("k").to_numpy().view(U), np.frombuffer(b"".join(batch.column("deep").to_pylist()), np.float32).reshape(-1, 2, 9)


def bytes_of(rows: pa.Array) -> np.ndarray:
    """A binary column of rows of one size as a matrix of bytes, without a copy."""
    n = len(rows)
    if not n:
        return np.zeros((0, 20), np.int8)
    kind = np.int64 if pa.types.is_large_binary(rows.type) else np.int32
    offsets = np.frombuffer(rows.buffers()[1], kind)[rows.offset : rows.offset + n + 1]
    return np.frombuffer(rows.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(n, -1)


def fit(grams: DataFrame) -> tuple[Low, Start]:
    """Counts of the low orders, and where lanes begin, from all of ``counted_grams``."""
    context = grams.sparkSession.sparkContext
    seen = grams.where("c > 0")
    short = seen.groupBy(F.col("k").bitwiseAND(F.lit(0xFFFFFF)).alias("k")).agg(F.sum("c").alias("c")).toArrow()
    low = Low(short.column("k").to_numpy().view(U), short.column("c").to_numpy().astype(np.float64))
    shared = context.broadcast(low)

    def sums(weights: np.ndarray, of, shape: tuple[int, int]) -> np.ndarray:
        """A pass over all grams: what ``of`` gives, added up."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    k, high = columns(batch)
                    total += of(shared.value, weights, k, batch.column("c").to_numpy().astype(np.float64), high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

        out = np.zeros(shape)
        for r in seen.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out.ravel()[r["i"]] = r["v"]
        return out

    n = len(ORDERS)
    weights = newton(lambda w: sums(w, loss_sums, (GATES, 1 + n + n * n)))
    slope, curve = sums(weights, lift_sums, (BITS * LIFTS, 2)).T
    return low, Start(weights, np.round(np.clip(slope / (curve + RIDGE), -1, 1), 6))


def gram_codes(grams: DataFrame) -> DataFrame:
    """k and code: ``coded_high`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = coded_high(columns(batch)[1])
                ends = np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(code.tobytes())])], names=["k", "code"])

    return grams.select("k", "deep").mapInArrow(run, "k long, code binary")


# ---- scores

POSTINGS = "h long, doc long, post binary"


class Places:
    """Where each of some distinct keys stands: a table of slots, in which the last key of a slot stays, and Arrow's search for the others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U(64 - max(10, (4 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << int(U(64) - self.shift), np.int32)
        own = self.slot(keys)
        self.slots[own] = np.arange(len(keys), dtype=np.int32)
        self.crowded = np.flatnonzero(self.slots[own] != np.arange(len(keys)))
        self.others = pa.array(keys[self.crowded].view(np.int64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * wh.RADIX >> self.shift).view(np.int64)

    def of(self, seen: np.ndarray) -> np.ndarray:
        """All of ``seen`` must be keys."""
        at = self.slots.take(self.slot(seen))
        missed = np.flatnonzero(self.keys.take(at) != seen)
        if len(missed):
            at[missed] = self.crowded[pc.index_in(pa.array(seen[missed].view(np.int64)), value_set=self.others).to_numpy()]
        return at


def postings(words: np.ndarray, owner: np.ndarray, base: int) -> list[pa.Array]:
    """A row for each distinct word of some texts. owner: each word's text, 16 bits. A posting is (text, frequency), 2 bytes each."""
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    del order
    new = np.concatenate(([True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1]))) if len(words) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(words)))
    words, owner = words[at], owner[at]
    extra = (tf - 1) // 0xFFFF  # a frequency that does not fit is several postings
    if extra.any():
        words, owner, last = np.repeat(words, extra + 1), np.repeat(owner, extra + 1), np.cumsum(extra + 1) - 1
        small = np.full(len(words), 0xFFFF)
        small[last] = tf - extra * 0xFFFF
        tf = small
    pairs = np.empty((len(words), 2), "<u2")
    pairs[:, 0], pairs[:, 1] = owner, tf
    head = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    ends = np.append(head, len(words)).astype(np.int32) * 4
    post = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])
    return [pa.array(words[head].view(np.int64)), pa.array(np.full(len(head), base)), post]


def score_documents(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", sure: float | None = SURE, lane: int | None = LANE) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, total_bits and bits_per_byte of every document. training: which documents are learned from.

    sure: logit from which a bit is coded by the mixture a lane begins with (None: never). lane: bytes after which learning begins anew (None: never).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    pieces = in_pieces(rows)
    needed = grams_of_pieces(pieces)
    grams = counted_grams(needed)
    common.release(docs.sparkSession)
    low, start = fit(grams)
    codes = needed.select("piece", "k").join(gram_codes(grams), "k")
    shared = docs.sparkSession.sparkContext.broadcast((low, start))
    counts = common.cut(counted(pieces, word_keys), "word-counts")
    texts = rows.where("train").count()
    common.release(docs.sparkSession)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = total + texts, kinds + (texts > 0)  # the end mark is a token of its own

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{POSTINGS}, about struct<n_tokens: long, n_bytes: long, score: double, id: {kind}>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    about_type = arrow.field("about").type

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        """Postings and scores of a piece, from its texts and the logits of its grams."""
        k, (low, start) = known.column("k").combine_chunks().to_numpy().view(U), shared.value
        number = texts.column("piece")[0].as_py() << 24
        slices, out = texts.sort_by("part").column("slice"), []

        def parts() -> Iterator[pa.RecordBatch]:
            for data in slices:
                whole = unpacked(data.as_py())
                yield from (whole.slice(at, 0xFFFF) for at in range(0, whole.num_rows, 0xFFFF))

        # Two passes over the piece, so that words and grams are never held together.
        heard, whose, texts_of, base, about, symbols_of = [], [], 0, number, [], []

        def give() -> None:
            post = postings(np.concatenate(heard or [np.zeros(0, U)]), np.concatenate(whose or [np.zeros(0, np.uint16)]), base)
            out.append(pa.RecordBatch.from_arrays([*post, pa.nulls(len(post[0]), about_type)], schema=arrow))

        for part in parts():
            data, offsets = common.buffers(part.column("text"))
            low_bytes, starts, ends, first_word = wh.bounds(data, offsets, wh.NONBLANK)
            if texts_of + part.num_rows > 0xFFFF:
                give()
                heard, whose, texts_of, base = [], [], 0, number
            heard.append(wh.word_hashes(low_bytes, starts, ends))
            whose.append((wh.owners(first_word) + texts_of).astype(np.uint16))
            texts_of += part.num_rows
            own = number + np.arange(part.num_rows)
            about.append((own, np.diff(first_word) + 1, np.diff(offsets), part.column("id").cast(about_type.field("id").type)))
            symbols_of.append(np.diff(offsets) + 1)
            number += part.num_rows
        give()
        heard, whose = [], []

        first = np.cumsum(np.concatenate([np.zeros(1, np.int64), *symbols_of]))
        places, rows, done = Places(k), np.empty(first[-1], np.int32), 0
        for part in parts():
            seen = layout(*common.buffers(part.column("text")))[0]
            rows[done : done + len(seen)] = places.of(seen)
            done += len(seen)
        code = coded(low, k, bytes_of(known.column("code").combine_chunks()))
        # All lanes of the piece step together.
        score, done = online(code, rows, first, start, sure, lane), 0
        for own, n_tokens, n_bytes, ids in about:
            text = pa.StructArray.from_arrays([pa.array(n_tokens), pa.array(n_bytes), pa.array(score[done : done + len(ids)]), ids], fields=list(about_type))
            out.append(pa.RecordBatch.from_arrays([pa.array(wh.mix(own.astype(U)).view(np.int64)), pa.array(own), pa.nulls(len(own), pa.binary()), text], schema=arrow))
            done += len(ids)
        return pa.Table.from_batches(out, schema=arrow)

    met = pieces.groupBy("piece").cogroup(codes.groupBy("piece")).applyInArrow(run, schema).join(counts.withColumnsRenamed({"k": "h"}), "h", "left")
    about_text = ("n_tokens", "n_bytes", "score", "id")
    out = f"doc long, b double, known long, n_tokens long, n_bytes long, score double, id {kind}"
    out_arrow = to_arrow_schema(_parse_datatype_string(out))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each text in a batch; rows that describe a text pass."""
        for batch in batches:
            about = batch.filter(pc.is_null(batch.column("post")))
            if about.num_rows:
                m = about.num_rows
                yield pa.RecordBatch.from_arrays([about.column("doc"), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()), *about.column("about").flatten()], schema=out_arrow)
            words = batch.filter(pc.is_valid(batch.column("post")))
            if not words.num_rows:
                continue
            post = words.column("post")
            packed = np.frombuffer(b"".join(post.to_pylist()), "<u2").reshape(-1, 2).astype(np.int64)
            size = pc.binary_length(post).to_numpy() // 4
            c = pc.fill_null(words.column("c"), 0).to_numpy()
            doc = np.repeat(words.column("doc").to_numpy(), size) + packed[:, 0]
            k, at = np.unique(doc, return_inverse=True)
            b = np.bincount(at, weights=packed[:, 1] * np.repeat(np.log10(c + 0.5), size), minlength=len(k))
            known = np.bincount(at, weights=packed[:, 1] * np.repeat(c > 0, size), minlength=len(k)).astype(np.int64)
            n = len(k)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(known), *[pa.nulls(n, out_arrow.field(c).type) for c in about_text]], schema=out_arrow)

    sums = met.select("doc", "post", "about", "c").mapInArrow(add, out).groupBy("doc").agg(
        F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), *[F.max(c).alias(c) for c in about_text]
    )
    end = float(np.log10(texts + 0.5))
    norm = float(np.log10(total + 0.5 * (kinds + 1)))
    return sums.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + int(texts > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("b") + end - F.col("n_tokens") * norm).alias("base_score"), "score", (-F.col("score") * np.log2(10)).alias("total_bits"),
        F.when(F.col("n_bytes") > 0, -F.col("score") * np.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op9_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; learned from all but one fold of them."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    scored = score_documents(docs, ~held)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "total_bits", "bits_per_byte")
