"""Secret scanning of texts with many matches: spans, redaction and overlaps across blocks, against plain versions."""

import random
import re
import time

from pyspark.sql import functions as F

from confab.llm import secrets

SPAN = "array<struct<start:int,end:int>>"


def plain_found(text):
    return [(m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]


def plain_redacted(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_matches_across_blocks(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["token=abcdefgh1 ", "é ", "secret: x ", "API_KEY='zzzzzzzz.9' ", "😀"]) for _ in range(n)) for n in (0, 1, 127, 128, 129, 256, 3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", secrets.found(F.col("text"), secrets.ASSIGN, "value8").alias("s")).orderBy("i").collect()
    assert [[(s.start, s.end) for s in r.s] for r in rows] == [plain_found(t) for t in texts]


def test_redaction_across_blocks(spark):
    rng = random.Random(2)
    cases = []
    for n in (0, 1, 2, 127, 128, 129, 700):
        at, spans = 0, []
        for _ in range(n):
            a = max(0, at + rng.choice([-3, 0, 1, 5]))  # overlapping, touching and apart
            spans.append((a, a + rng.randint(1, 9)))
            at = max(at, spans[-1][1])
        cases.append(("".join(rng.choice("abé😀 ") for _ in range(at + rng.randint(0, 4))), sorted(spans)))
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], f"i int, t string, s {SPAN}")
    assert [r[0] for r in df.orderBy("i").select(secrets.redacted(F.col("t"), F.col("s"))).collect()] == [plain_redacted(t, s) for t, s in cases]


def test_untouched_spans(spark):
    rng = random.Random(3)
    cases = []
    for n, m in ((0, 0), (0, 5), (5, 0), (200, 150), (300, 40), (3, 400)):
        own, at = [], 0
        for _ in range(n):
            at += rng.randint(0, 6)
            own.append((at, at := at + rng.randint(1, 5)))
        others = sorted((a := rng.randint(0, 6 * max(n, m)), a + rng.randint(1, 12)) for _ in range(m))
        cases.append((own, others))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], f"i int, a {SPAN}, b {SPAN}")
    got = [[tuple(s) for s in r[0]] for r in df.orderBy("i").select(secrets.untouched(F.col("a"), F.col("b"))).collect()]
    assert got == [[s for s in own if not any(o[0] < s[1] and s[0] < o[1] for o in others)] for own, others in cases]


def test_time_grows_with_the_matches(spark):
    def took(n):
        df = spark.createDataFrame([("password=abcdefgh%d x " % (n % 7) * n,)], "text string")
        began = time.time()
        (got,) = df.select(F.size(secrets.found(F.col("text"), secrets.ASSIGN, "value8"))).first()
        assert got == n
        return time.time() - began

    took(10)
    small, large = took(10_000), took(100_000)
    assert large < 30 * small + 5  # a hundred times, were it quadratic
