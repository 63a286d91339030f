"""Substring search by an index of three-letter runs: few files are read for a rare query, and the rows are those of a scan.

The index is a table of (run, id), a row for each distinct run of three lower-cased characters of a text, in folders by a hash of the
run and sorted by it, so that the statistics of Parquet files skip most of a folder as well. A query's runs name the folders to
open; rows that have all of them are candidates, and only these are held against the query itself. Common runs have long lists: they
are rows like others, spread over files, and no list is ever one row. A query of fewer than three characters is a scan.

Defined cases: null texts are never found; the empty query finds every text; case is ignored; repeated rows are found as often as
they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, BUCKETS = 3, 64


def runs(text: Column) -> Column:
    """Distinct runs of ``SIZE`` characters, lower-cased; none of a shorter text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - SIZE + 1))
    return F.when(F.length(low) >= SIZE, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(SIZE)))))


def bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, path: str, *, id_col: str = "id", text_col: str = "text") -> None:
    """Writes the index of ``rows`` to ``path``."""
    spread = rows.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col))).alias("run")).distinct().withColumn("bucket", bucket(F.col("run")))
    spread.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "run", "id").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def postings(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """run and id of the query's runs; None if it is too short."""
    low = query.lower()
    wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    if not wanted:
        return None
    folders = [r["b"] for r in spark.createDataFrame([(w,) for w in wanted], "run string").select(bucket(F.col("run")).alias("b")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(folders) & F.col("run").isin(wanted)).select("run", "id")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """id of the rows that have all runs of the query."""
    found = postings(spark, path, query)
    if found is None:
        return None
    low = query.lower()
    return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})).select("id")


def search(rows: DataFrame, path: str, query: str, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The rows whose text has the query in it, by the index at ``path``."""
    ids = candidates(rows.sparkSession, path, query)
    held = rows if ids is None else rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")
    return held.where(F.lower(text_col).contains(query.lower()))
