"""Document fingerprints by consistent weighted sampling.

A text is its words weighted by how often they occur. For each of ``SAMPLES`` independent draws a word of weight S has, from
its hash alone, r and c from Gamma(2, 1) and b uniform; t = floor(ln S / r + b), and the word of least
ln c - r (t - b) - r is the sample (word, t). Two texts draw the same sample with a probability equal to their generalised
Jaccard similarity, sum of minima over sum of maxima of weights; the share of equal samples estimates it.

A sample is one 62-bit integer whose upper half orders by that value and whose lower half names (word, t), so a draw is a
minimum of integers that generated code and map-side combination handle.

The neighbour of each document is found without sorting everything in one place: ids are cut into ranges at quantiles, the
first document of each range is also handed to the range before it, and a window by range does the rest. Text is shuffled
once, by range; counting words and drawing samples reuse that partitioning.

Defined cases: null text is empty; texts without words have the empty fingerprint, alike (1.0) to each other and unlike
(0.0) all others; rows of equal id follow each other in order of their text, null ids come first; a sole document is its own
next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm import common

SAMPLES = 32
#: Ids that bounds of ranges are taken from where ids are no numbers.
BOUNDS = 10_000
#: Anything else in a lower-cased text separates words.
BETWEEN = r"[\x00-/:-`{-\x7f]+"


def sample(word: Column, log_weight: Column, j: int) -> Column:
    """Draw ``j`` of a word (its 64-bit hash) as an ordered integer."""
    x = F.xxhash64(word, F.lit(j))
    y = F.xxhash64(x, F.lit(-j - 1))
    unit = lambda v, at: (F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)
    r = -F.ln(unit(x, 0) * unit(x, 21))
    c = -F.ln(unit(x, 42) * unit(y, 0))
    b = unit(y, 21)
    t = F.floor(log_weight / r + b)
    value = F.ln(c) - r * (t + 1.0 - b)
    order = F.greatest(F.lit(0.0), F.least(F.lit(127.999), value + 100.0)) * float(1 << 24)
    name = F.xxhash64(word, t).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(order.cast("long"), 31).bitwiseOR(name)


def draw(weighted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys and fingerprint (array of samples). weighted: keys, word (hash), weight."""
    logs = weighted.select(*keys, "word", F.ln("weight").alias("_log"))
    drawn = logs.groupBy(*keys).agg(*(F.min(sample(F.col("word"), F.col("_log"), j)).alias(f"_s{j}") for j in range(samples)))
    return drawn.select(*keys, F.array(*(f"_s{j}" for j in range(samples))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; a null fingerprint is that of a text without words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a).cast("double")
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def printed(fingerprint: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))), ""), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def ranges(rows: DataFrame, id_col: str, n: int) -> Column:
    """Number of the id's range, of at most ``n``. Found in two steps over sorted bounds.

    Bounds are quantiles of numeric ids; of other ids, the ids that a regular sample of ``BOUNDS`` of their hashes picks. They
    only say how even the ranges are.
    """
    if n <= 1:
        return F.lit(0)
    if isinstance(rows.schema[id_col].dataType, T.NumericType):
        bounds = rows.select(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n)).first()[0]
    else:
        least = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.xxhash64(id_col).alias("h")).distinct().orderBy("h").limit(BOUNDS)
        found = sorted(r["i"] for r in least.collect())
        bounds = [found[len(found) * i // n] for i in range(1, n)] if found else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda v: v <= F.col(id_col)))
    literal = lambda values: F.array(*map(F.lit, values))
    coarse = below(literal(bounds[::step]))
    fine = F.when(coarse > 0, (coarse - 1) * step + below(F.slice(literal(bounds), (coarse - 1) * step + 1, F.lit(step)))).otherwise(F.lit(0))
    return F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(fine)


def with_next(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """rows with _range, _late (a copy of a following range's first row), _row (unique in its range) and _next, the next text.

    rows: id_col and text.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("_range", ranges(rows, id_col, n))
    # One row per range reaches the driver: which id a range begins with, and which range is before it.
    firsts = sorted(((r["_range"], r["i"], r["z"]) for r in placed.groupBy("_range").agg(F.min(id_col).alias("i"), F.max(F.col(id_col).isNull()).alias("z")).collect()), key=lambda r: r[0])
    if not firsts:
        return placed.select(*placed.columns, F.lit(False).alias("_late"), F.lit(0).alias("_row"), F.lit(None).cast("string").alias("_next"))
    # The target is declared not null: a filter on one of two uses would keep them from sharing their exchange of text.
    schema = T.StructType([T.StructField("_head", rows.schema[id_col].dataType), T.StructField("_to", T.IntegerType(), False)])
    heads = spark.createDataFrame([(None if z else i, firsts[k - 1][0]) for k, (_, i, z) in enumerate(firsts)], schema)
    copies = placed.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("_head"))).withColumn("_range", F.col("_to")).drop("_head", "_to").withColumn("_late", F.lit(True))
    w = W.partitionBy("_range").orderBy("_late", F.asc_nulls_first(id_col), "text")
    # As many partitions as ranges: what a task counts in then fits its memory.
    spread = placed.withColumn("_late", F.lit(False)).unionByName(copies).repartition(n, "_range")
    return spread.withColumn("_row", F.row_number().over(w)).withColumn("_next", F.lead("text").over(w))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id and fingerprint (array of samples, null without words) of every document: the plain operator."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    terms = rows.select("_id", "_key", F.explode(words(F.col("text"))).alias("w")).groupBy("_id", "_key", F.xxhash64("w").alias("word")).agg(F.count("*").cast("double").alias("weight"))
    drawn = draw(terms.dropDuplicates(["_key", "word"]), ["_key"], samples)
    return rows.join(drawn, "_key", "left").select(F.col("_id").alias(id_col), "fingerprint")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document's beginning, and how alike they are."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    placed = with_next(rows, id_col, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = placed.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.left("text", n - half), F.coalesce(F.left("_next", half), F.lit(""))))
    keys = ["_range", "_row", "_side"]
    both = edited.select("_range", "_row", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("text").alias("t")), F.struct(F.lit(1).alias("s"), F.col("_edited").alias("t")))).alias("x"))
    terms = both.select("_range", "_row", F.col("x.s").alias("_side"), F.explode(words(F.col("x.t"))).alias("w")).select(*keys, F.xxhash64("w").alias("word"))
    drawn = draw(terms.groupBy(*keys, "word").agg(F.count("*").cast("double").alias("weight")), keys, samples)
    side = lambda k, name: F.max(F.when(F.col("_side") == k, F.col("fingerprint"))).alias(name)
    prints = drawn.groupBy("_range", "_row").agg(side(0, "_own"), side(1, "_edit"))
    thin = edited.select("_range", "_row", "_late", id_col, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"))
    joined = thin.join(prints, ["_range", "_row"], "left").withColumn("_following", F.lead("_own").over(W.partitionBy("_range").orderBy("_row")))
    return joined.where("not _late").select(
        id_col, "n_chars", "edited_sha256", printed(F.col("_own")).alias("fingerprint"), printed(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"), likeness(F.col("_own"), F.col("_following")).alias("near_next"),
    )


def op4_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    return compare_with_edits(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
