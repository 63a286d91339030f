"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors, with windows as wide as the data ask for.

Equal vectors are one class, which keeps its smallest ids: no query needs more than it returns, so a hot vector is one row.
For each of ``CURVES`` orderings the classes are projected by a random rotation to ``DIMS`` axes, shifted by a random offset and
given their place on a Hilbert curve of ``BITS`` bits an axis. Spark deals the keys out by ranges and sorts them; counts of the ranges
(one number a partition) turn places into ranks, and ranks into blocks of ``BLOCK`` classes. A query's window is the blocks
within ``reach`` of its own; the windows of all orderings are searched block by block, the distance of every class in a window
is computed on the original vectors, and what each block finds is merged by query.

How wide a window must be depends on the vectors: where they lie near a few dimensions, neighbours stand close on some
curve; where they fill all dimensions evenly, no curve keeps them together. So the width is measured. A bounded sample of
queries (``SAMPLE``, by hash of the id) is held against all vectors, one pass, and the ranks of their true neighbours say for
each number of orderings how wide windows must be to hold ``SURE`` of them. The cheapest number of orderings is taken. If even
that would compare each query with as many rows as there are, one ordering with the whole table as window does the same work
and is exact: then each query meets every block. Nothing caps the rows of a window.

A group of the search holds one block and the queries of ``CHUNK`` neighbouring blocks, so its size is bounded however many
queries there are.

Defined cases: rows whose vector is null, zero, or has null or non-finite components, or whose id is null, take no part, nor
do vectors of another length than most have (ties: the smaller length); rows that repeat an id and a vector count once; a query
never finds a row of its own id; equal distances go to the smaller id; fewer candidates than asked for are all returned; empty
tables, and tables without queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.llm import common

U = np.uint64
NEAREST, CURVES, DIMS, BITS, SEED = 10, 4, 8, 7, 11
#: Classes of a block, and neighbouring blocks whose queries are searched together.
BLOCK, CHUNK = 1024, 32
#: Queries that set the width of windows, and the share of their neighbours that windows must hold.
SAMPLE, SURE = 128, 0.97
#: Standard deviations around the mean that the grid spans.
SPREAD = 3.0
#: Queries whose distances to a block are held at once.
STEP = 512


# ---- orderings


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (coordinates below 2 ** bits)."""
    x = [c.astype(U) for c in cells.T]
    high = [U(1 << b) for b in range(bits - 1, 0, -1)]
    for q in high:  # undo the turns and flips of each level
        for i in range(len(x)):
            on = (x[i] & q) != 0
            t = np.where(on, U(0), (x[0] ^ x[i]) & (q - U(1)))
            x[0] = x[0] ^ np.where(on, q - U(1), t)
            if i:
                x[i] = x[i] ^ t
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros(len(cells), U)
    for q in high:
        t ^= np.where((x[-1] & q) != 0, q - U(1), U(0))
    out = np.zeros(len(cells), U)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << U(1) | (c ^ t) >> U(b) & U(1)
    return out


def rotations(width: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes of each ordering (curve, width, dims) and its shift as a share of the grid's half (curve, dims)."""
    rng = np.random.default_rng(seed)
    axes = [np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0] for _ in range(curves)]
    return np.stack(axes), rng.random((curves, min(dims, width)))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = vectors.flatten() if len(vectors) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def spreads(classes: DataFrame, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the classes on every axis."""
    curves, width, dims = axes.shape
    flat = axes.transpose(1, 0, 2).reshape(width, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, flat.shape[1]))
        for batch in batches:
            y = matrix(batch.column("vec"), width) @ flat
            sums += np.stack([np.full(y.shape[1], len(y)), y.sum(axis=0), (y * y).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.shape[1])), *map(pa.array, sums)], names=["axis", "n", "s", "q"])

    rows = classes.select("vec").mapInArrow(run, "axis long, n double, s double, q double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("axis").collect()
    n, s, q = (np.array([r[c] for r in rows]) for c in ("n", "s", "q"))
    mean = s / n
    return mean.reshape(curves, dims), np.sqrt(np.maximum(q / n - mean**2, 1e-300)).reshape(curves, dims)


def ranked(classes: DataFrame, axes: np.ndarray, shift: np.ndarray, bits: int) -> DataFrame:
    """curve, rank and k: the place of each class in each ordering."""
    curves, width, _ = axes.shape
    mean, sd = spreads(classes, axes)
    half = float(1 << (bits - 1))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), width)
            for c in range(curves):
                y = ((x @ axes[c] - mean[c]) / sd[c] / SPREAD + 1) / 2
                cells = np.floor((np.clip(y, 0, 1) + shift[c]) * (half - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c)), pa.array(hilbert(cells, bits).view(np.int64)), batch.column("k")], names=["curve", "key", "k"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("k"), pa.array(np.full(batch.num_rows, part)), pa.array(seen + np.arange(batch.num_rows))], names=["curve", "k", "part", "at"])
            seen += batch.num_rows

    order = ["curve", "key", "k"]
    placed = classes.select("k", "vec").mapInArrow(keys, "curve long, key long, k long").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = common.cut(placed.mapInArrow(number, "curve long, k long, part long, at long"), "orderings")
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = np.concatenate(([0], np.cumsum([totals.get(p, 0) for p in range(max(totals) + 1)])))
    each = int(before[-1]) // curves
    rank = F.get(F.lit(before.tolist()), F.col("part").cast("int")) + F.col("at") - F.col("curve") * each
    return placed.select("curve", rank.alias("rank"), "k")


# ---- classes of equal vectors


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def equal_classes(vectors: DataFrame, ids: int) -> DataFrame:
    """k, vec and ids (so many of the smallest, in order) of each distinct vector. vectors: id and vec."""
    place = F.dense_rank().over(W.partitionBy("h", "vec").orderBy("id"))
    least = vectors.withColumn("h", F.xxhash64("vec")).withColumn("place", place).where(F.col("place") <= ids)
    kept = least.groupBy("h", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return common.cut(kept.select(F.monotonically_increasing_id().alias("k"), "h", "vec", "ids"), "classes")


# ---- distances


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row and distance of each query's nearest rows; ties go to the smaller id."""
    out = []
    norms = (rows * rows).sum(axis=1)
    for at in range(0, len(queries), STEP):
        q = queries[at : at + STEP]
        own = (q * q).sum(axis=1)[:, None]
        about = own + norms - 2 * (q @ rows.T)
        kth = np.partition(about, min(most, len(rows)) - 1, axis=1)[:, min(most, len(rows)) - 1]
        # What rounding can hide is taken along, and measured by plain differences.
        i, j = np.nonzero(about <= (kth + 1e-12 * (own[:, 0] + norms.max()))[:, None])
        square = (q[i] - rows[j]) ** 2
        d = np.sqrt(np.add.accumulate(square, axis=1)[:, -1])
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - first[i] < most
        out.append((i[keep] + at, j[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best(found: DataFrame, most: int) -> DataFrame:
    """Of q, c, id and d the rows of each query's nearest classes; a class that several windows hold may come as often."""
    place = F.dense_rank().over(W.partitionBy("q").orderBy("d", "id", "c"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


# ---- width of windows


def sampled_gaps(classes: DataFrame, ranks: DataFrame, asked: DataFrame, curves: int, width: int, most: int, sample: int) -> np.ndarray:
    """Of each true neighbour of some queries, how many ranks it is away in each ordering (neighbour, curve). Sample, bound: queries."""
    some = classes.join(asked.select("k").distinct(), "k").orderBy(F.xxhash64("k"), "k").limit(sample).select("k", "vec").collect()
    if not some:
        return np.zeros((0, curves), np.int64)
    q, names = np.array([r["vec"] for r in some]), [r["k"] for r in some]
    shared = classes.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, first = batch.column("k").to_numpy(), batch.column("id").to_numpy()
            i, j, d = nearest(shared.value, matrix(batch.column("vec"), width), first, most)
            rows = np.rec.fromarrays((i, k[j], first[j], d), names="q,c,id,d")
            kept = rows if kept is None else np.concatenate((kept, rows))
            kept = kept[np.lexsort((kept["id"], kept["d"], kept["q"]))]
            kept = kept[np.arange(len(kept)) - np.searchsorted(kept["q"], kept["q"]) < most]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kept[c])) for c in ("q", "c", "id", "d")], names=["q", "c", "id", "d"])

    true = best(classes.select("k", "vec", F.get("ids", 0).alias("id")).mapInArrow(run, "q long, c long, id long, d double"), most)
    places = true.select("q", "c").join(ranks.withColumnRenamed("k", "c"), "c").collect()
    at = np.full((len(names), curves), -1)
    number = {k: i for i, k in enumerate(names)}
    for r in places:
        if number.get(r["c"]) == r["q"]:
            at[r["q"], r["curve"]] = r["rank"]
    gaps: dict[tuple[int, int], list[int]] = {}
    for r in places:
        if number.get(r["c"]) != r["q"]:
            gaps.setdefault((r["q"], r["c"]), [0] * curves)[r["curve"]] = abs(r["rank"] - int(at[r["q"], r["curve"]]))
    return np.array(sorted(gaps.values()), np.int64).reshape(-1, curves)


def windows(gaps: np.ndarray, total: int, block: int, sure: float) -> tuple[int, int]:
    """How many orderings to search, and how many blocks to either side: what compares a query with fewest rows and holds the share ``sure``."""
    whole = -(-total // block)
    options = [(total, 1, whole)]
    for c in range(1, gaps.shape[1] + 1) if len(gaps) else ():
        need = int(np.sort(gaps[:, :c].min(axis=1))[min(len(gaps) - 1, int(np.ceil(sure * len(gaps))))])
        reach = -(-need // block)
        options.append((c * min((2 * reach + 1) * block, total), c, reach))
    _, curves, reach = min(options)
    return curves, reach


# ---- search


def search(classes: DataFrame, ranks: DataFrame, asked: DataFrame, *, curves: int, reach: int, total: int, width: int, most: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """q, c, id and d: what the windows hold of the nearest classes to each asked one, block by block. asked: k."""
    last = (total - 1) // block
    used = ranks.where(F.col("curve") < curves).withColumn("own", F.floor(F.col("rank") / block))
    near = lambda at: (F.greatest(F.lit(0), at - reach), F.least(F.lit(last), at + reach))
    low, high = near(F.col("own"))
    rows = used.join(classes.select("k", "vec", F.get("ids", 0).alias("id")), "k")
    rows = rows.select("curve", F.col("own").alias("block"), F.explode(F.sequence(F.floor(low / chunk), F.floor(high / chunk))).alias("chunk"), "k", "id", "vec")
    queries = used.join(asked.select("k").distinct(), "k").join(classes.select("k", "vec"), "k")
    queries = queries.select(F.col("curve").alias("by"), F.explode(F.sequence(low, high)).alias("at"), F.floor(F.col("own") / chunk).alias("group"), F.col("k").alias("q"), F.col("vec").alias("asked"))

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["q", "c", "id", "d"]
        if not held.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        k, first = held.column("k").to_numpy(), held.column("id").to_numpy()
        i, j, d = nearest(matrix(wanted.column("asked").combine_chunks(), width), matrix(held.column("vec").combine_chunks(), width), first, most)
        return pa.table([wanted.column("q").to_numpy()[i], k[j], first[j], d], names=names)

    return rows.groupBy("curve", "block", "chunk").cogroup(queries.groupBy("by", "at", "group")).applyInArrow(run, "q long, c long, id long, d double")


def nearest_neighbours(
    vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = NEAREST, curves: int = CURVES, dims: int = DIMS, bits: int = BITS,
    block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE, sure: float = SURE, seed: int = SEED,
) -> DataFrame:
    """query_id, rank (from 1), id_col and score (distance) of each query's nearest rows. queries: which rows are asked for; ids are whole numbers."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    widths = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    out = f"query_id long, rank int, {id_col} long, score double"
    if not widths:
        return spark.createDataFrame([], out)
    width = widths[0]["width"]
    rows = rows.where(F.size("vec") == width)
    classes = equal_classes(rows.select("id", "vec"), most + 1)
    asked = rows.where("asked").select("id", "vec").withColumn("h", F.xxhash64("vec")).join(classes.select("h", "vec", "k"), ["h", "vec"]).select("k", "id").distinct()
    asked = common.cut(asked, "asked")
    total = classes.count()
    axes, shift = rotations(width, curves, dims, seed)
    ranks = ranked(classes, axes, shift, bits)
    gaps = sampled_gaps(classes, ranks, asked, curves, width, most + 1, sample)
    used, reach = windows(gaps, total, block, sure)
    found = best(search(classes, ranks, asked, curves=used, reach=reach, total=total, width=width, most=most + 1, block=block, chunk=chunk), most + 1)
    # A query's nearest classes, a few dozen ids, as one list; each query of a class leaves itself out.
    each = found.select("q", "c", "d").distinct().join(classes.select(F.col("k").alias("c"), "ids"), "c").select("q", "d", F.explode("ids").alias("id"))
    lists = each.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, most + 1).alias("near"))
    own = asked.join(lists.withColumnRenamed("q", "k"), "k").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, most).alias("near"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("near")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias(id_col), F.col("col.d").alias("score"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
with v as (select vec_id, cast(embedding as double[]) e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score, vec_id) as integer) rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
