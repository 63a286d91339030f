"""Importance resampling of documents towards a target: hashed word runs, array-scored weights, and a rank by exact counts of scores.

Features of a text are all runs of one to ``GRAMS`` consecutive words, repeats counted, each in the bucket of its CRC-32. Two
passes over the texts: the first counts every bucket over all documents and over all target texts, an array of ``BUCKETS``
sums a task, added up by Spark; the second sums the buckets' gains (whole thousandths of the log ratio of target and corpus,
one array of ``BUCKETS`` numbers, whatever the corpus) over each document's features. A document's score is its weight plus Gumbel
noise from a hash of its id, so taking the highest scores draws without replacement in proportion to the weights.

The draw needs no sort of all documents. Documents are counted by score; that histogram is dealt out by ranges of scores, and
running sums within a range with the ranges' own totals (one number a partition, the only thing the driver sees) say how many
documents stand above each score. The lowest score with fewer than the quota above it is the cutoff. What stands below it is
done; the others, a little more than the quota, are numbered by id within their score, and places add up to ranks.

Defined cases: a null text has no words; a null id counts as an empty one and comes last among ties; repeated rows tie and take
any order among themselves; with no target texts the gains come from the corpus alone; empty tables give no rows; no document is
drawn where the quota's floor is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm import common, crc, wordhash as wh

BUCKETS, GRAMS, UNIT = 10_000, 3, 1000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42


def runs_of_words(texts: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Where each text's words begin (one entry more than texts), and for each length of runs their first words and buckets."""
    data, offsets = common.buffers(texts)
    low, starts, ends, first = wh.bounds(data, offsets, wh.ALNUM)

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, last = ends - starts + 1, np.repeat(first[1:], np.diff(first))  # with the blank before a word
        blank = crc.of_runs(low, starts, ends, np.full(len(starts), zlib.crc32(b" "), np.uint32))
        at, c = np.arange(len(starts)), crc.of_runs(low, starts, ends)
        for k in range(grams):
            if k:
                go = at + k < last[at]
                at, c = at[go], c[go]
                c = crc.joined(c, blank[at + k], size[at + k])
            yield at, (c % np.uint32(buckets)).astype(np.int64)

    return first, each()


def bucket_counts(docs: DataFrame, text_col: str, *, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts are in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                for _, bucket in runs_of_words(part.column("text"), grams, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the log ratio of its smoothed shares in target and corpus, in whole units of 1 / ``UNIT``, floors down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, target_text_col: str, *, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """``gains`` of all buckets, from all texts of both tables; two arrays of ``buckets`` sums reach the driver."""
    out = []
    for rows, column in ((docs, text_col), (target, target_text_col)):
        total = np.zeros(buckets, np.int64)
        for r in bucket_counts(rows, column, grams=grams, buckets=buckets).collect():
            total[r["bucket"]] = r["n"]
        out.append(total)
    return gains(*out)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str, *, grams: int = GRAMS, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_features and weight, the sum of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    fields = [T.StructField(f"{prefix}{c}", T.LongType()) for c in ("n_words", "n_features", "weight")]

    def work():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            first, each = runs_of_words(batch.column(text_col), grams, len(shared.value))
            n, sums = np.zeros((2, first[-1] + 1), np.int64)
            for at, bucket in each:
                n[at] += 1
                sums[at] += shared.value[bucket]
            whole = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
            return [pa.array(x) for x in (np.diff(first), whole(n), whole(sums))]

        return step

    return common.add_columns(docs, text_col, fields, work)


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise of an id, in whole units of 1 / ``UNIT``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0)))


def standings(scored: DataFrame) -> DataFrame:
    """score, n (rows of ``scored`` with it) and above (rows with a higher score)."""
    down = F.col("score").desc()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            above = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above), pa.array(np.full(len(n), part))], names=["score", "n", "above", "part"])

    counts = scored.groupBy("score").agg(F.count("*").alias("n"))
    ranges = common.cut(counts.repartitionByRange(down).sortWithinPartitions(down).mapInArrow(run, "score long, n long, above long, part long"), "standings")
    totals = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before = [sum(n for p, n in totals.items() if p < part) for part in range(max(totals, default=0) + 1)]
    return ranges.select("score", "n", (F.col("above") + F.get(F.lit(before), F.col("part").cast("int"))).alias("above"))


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    Of the documents of at least ``least_words`` words, ``percent`` in a hundred (floor) are drawn.
    """
    gain = bucket_gains(docs, target, text_col, target_text_col, grams=grams, buckets=buckets)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = common.cut(weighted(rows, gain, "text", grams=grams).select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    quota = able.count() * percent // 100
    high = standings(able).where(F.col("above") < quota)
    cutoff = high.agg(F.min("score")).first()[0] if quota else None
    at_least = F.col("n_words") >= least_words if cutoff is None else (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    order = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    rank = F.col("above") + F.row_number().over(order)
    drawn = able.where(at_least).join(high.select("score", "above"), "score").withColumn("rank", F.when(rank <= quota, rank))
    names = ["n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(~at_least) if cutoff is not None else scored
    out = rest.withColumn("rank", F.lit(None).cast("long"))
    if cutoff is not None:
        out = out.unionByName(drawn.drop("above"))
    return out.select(F.col("id").alias(id_col), *names)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, drawn towards the benchmark's texts."""
    out = resample(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


ORACLE = r"""
with recursive bits(b, c, k) as (select range, range::uinteger, 0 from range(256) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::uinteger) else c >> 1 end, k + 1 from bits where k < 8),
byte as (select list(c order by b) t from bits where k = 8),
d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
df as (select r, array_to_string(w[i : i + k - 1], ' ') f, count(*) n from (select r, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select unnest([1, 2, 3]) k)) group by all),
bf as (select array_to_string(w[i : i + k - 1], ' ') f, count(*) n from (select w, k, unnest(range(1, len(w) - k + 2)) i from b, (select unnest([1, 2, 3]) k)) group by all),
names as materialized (select f, hex(encode(f)) h from (select f from df union select f from bf)),
hashed as (select f, xor(4294967295::uinteger, list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::uinteger), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::integer + 1]), 4294967295::uinteger)) % 10000 u from names, byte),
corpus as (select u, sum(n) s from df join hashed using (f) group by u),
target as (select u, sum(n) t from bf join hashed using (f) group by u),
total as (select coalesce((select sum(s) from corpus), 0)::double s, coalesce((select sum(t) from target), 0)::double t),
gain as (select range u, floor(1000 * ln((coalesce(t.t, 0) + 1)::double * (total.s + 10000) / ((coalesce(c.s, 0) + 1)::double * (total.t + 10000))))::bigint g from range(10000) left join corpus c on c.u = range left join target t on t.u = range, total),
sums as (select r, sum(n)::bigint n_features, sum(n * g)::bigint weight from df join hashed using (f) join gain using (u) group by r),
scored as (select doc_id, d.r, len(w)::bigint n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1 : 8])::bigint + 0.5) / 4294967296::double)))::bigint score from d left join sums s on s.r = d.r),
ranks as (select r, row_number() over (order by score desc, doc_id nulls last) rank, count(*) over () n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 5 * n // 100 then rank end rank, n_words from scored left join ranks using (r)
"""
