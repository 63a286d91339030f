"""The substring index against a scan, and how much of it a query opens."""

import random

import pytest

from confab.sources import search


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["install", "Prompt", "привет", "😀😀😀", "aaa", "x1-y2", "naïve", "the"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(400)] + [(500, None), (501, ""), (502, "ab"), (503, "aaaaaa"), (503, "aaaaaa"), (504, "zqzqz rare")]
    df, path = spark.createDataFrame(rows, "id long, text string"), f"file://{tmp_path_factory.mktemp('search')}/index"
    search.build(df, path)
    return df, path, rows


@pytest.mark.parametrize("query", ["install", "PROMPT", "ll pr", "aaa", "aaaa", "привет 😀", "😀😀", "ab", "", "zqz", "nothing like it", "the the", "ïve", "zqzz"])
def test_the_rows_are_those_of_a_scan(indexed, query):
    df, path, rows = indexed
    want = sorted(i for i, t in rows if t is not None and query.lower() in t.lower())
    assert sorted(r.id for r in search.search(df, path, query).collect()) == want


def test_rare_queries_open_few_files_and_rows(spark, indexed):
    _, path, _ = indexed
    all_files = len(spark.read.parquet(path).inputFiles())

    def opened(query):
        found = search.postings(spark, path, query)
        return len({r[0] for r in found.selectExpr("input_file_name() as f").distinct().collect()}), found.count()

    files, rows = opened("zqz")
    assert files == 1 and rows == 1 and all_files > 20
    assert opened("install")[1] > 500
    assert search.candidates(spark, path, "zqz").count() == 1 and search.candidates(spark, path, "ab") is None
