"""Nearest neighbours, importance resampling and spelling variants against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confab.llm import crc, neighbours, resampling, spelling

DOC = "doc_id long, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- CRC-32


def test_crc_of_runs_and_of_joined_runs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 200, 5000, 70_000])) for _ in range(2))
        data = np.frombuffer(a + b, np.uint8)
        one, two = crc.of_runs(data, np.array([0, len(a)]), np.array([len(a), len(a + b)]))
        assert (one, two) == (zlib.crc32(a), zlib.crc32(b))
        assert crc.joined(np.array([one]), np.array([two]), np.array([len(b)]))[0] == zlib.crc32(a + b)
        assert crc.of_runs(data, np.array([len(a)]), np.array([len(a + b)]), np.array([one]))[0] == zlib.crc32(a + b)


# ---- 11: nearest neighbours


def plain_nearest(rows, most):
    out = []
    for q, x in rows:
        if q % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y in rows if i != q)[:most]
            out += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    return out


def test_hilbert_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = neighbours.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return [tuple(r) for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, **settings).collect()]


def test_vectors_without_structure_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = sorted(found(spark, rows, block=64, chunk=4))
    want = sorted(plain_nearest([(i, [float(np.float32(c)) for c in v]) for i, v, _ in rows], 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_structured_vectors_need_few_rows(spark, monkeypatch):
    """Vectors near a curved surface: windows hold a small part of the table, and recall stays above 0.9."""
    rng = np.random.default_rng(3)
    u = rng.random((8000, 2))
    x = np.concatenate([np.sin(3 * u), np.cos(2 * u), u], axis=1) @ rng.standard_normal((6, 32)) + rng.standard_normal((8000, 32)) * 1e-4
    used = []
    windows = neighbours.windows
    monkeypatch.setattr(neighbours, "windows", lambda *a: used.append(windows(*a)) or used[-1])
    got = found(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], block=64, sample=40)
    (curves, reach), x = used[0], x.astype(np.float32).astype(np.float64)
    assert curves * (2 * reach + 1) * 64 < 0.25 * len(x)
    true = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, len(x), 100)}
    hits = Counter(q for q, _, i, _ in got if i in true[q])
    assert len(got) == 800 and sum(hits.values()) >= 0.9 * 800


def test_hot_vector_ties_and_unusable_rows(spark):
    hot, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(i, hot, 0) for i in range(400, 100, -1)] + [(100, [1.0, 3.0], 1), (500, [1.0, 1.0], 1), (500, [1.0, 1.0], 1)]
    rows += [(0, None, 0), (1, [0.0, 0.0], 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (None, hot, 0), (600, [1.0], 0), (5, [], 0)]
    got = found(spark, rows)
    by = {q: [(i, d) for a, _, i, d in sorted(got) if a == q] for q in (100, 200, 300, 400, 500)}
    assert {r[0] for r in got} == set(by)
    assert by[200] == [(i, 0.0) for i in range(101, 111)]
    assert by[400] == [(i, 0.0) for i in range(101, 111)]
    assert by[100] == [(i, 1.0) for i in range(101, 111)] and by[500] == by[100]


def test_few_vectors_no_queries_and_empty_tables(spark):
    assert sorted(found(spark, [(100, [1.0], 0), (1, [3.0], 0)])) == [(100, 1, 1, 2.0)]
    assert found(spark, [(100, [1.0], 0)]) == [] and found(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == [] and found(spark, [(100, None, 0)]) == []
    clash = spark.createDataFrame([(100, [1.0, 0.0], 1, 2, 3), (7, [1.0, 1.0], 1, 2, 3)], "vec_id int, embedding array<double>, k int, rank int, q int")
    assert [tuple(r) for r in neighbours.nearest_neighbours(clash, F.col("vec_id") == 100).collect()] == [(100, 1, 7, 1.0)]


# ---- 12: importance resampling


def plain_resampling(docs, target, percent=5, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    features = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    own = [(i, len(words(t)), features(words(t))) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((k for k, r in enumerate(rows) if r[1] >= least), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: at + 1 for at, k in enumerate(able[: percent * len(able) // 100])}
    return [(*r, rank.get(k)) for k, r in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def resampled(spark, docs, target, **settings):
    return [tuple(r) for r in resampling.resample(spark.createDataFrame(docs, DOC), spark.createDataFrame([(x,) for x in target], "text string"), **settings).collect()]


AWKWARD = [None, "", " ", "...", "Aé", "a\x00b c", "Ünïcödé 😀 text", "w" * 5000 + " end", "many words " * 3000, "same text here " * 9, "same text here " * 9]


def test_draw_against_a_plain_version(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(known) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    target = [" ".join(rng.choice(known[:40]) for _ in range(30)) for _ in range(10)] + [None, ""]
    for percent in (5, 37, 100):
        assert order(resampled(spark, docs, target, percent=percent)) == order(plain_resampling(docs, target, percent))


def test_ties_go_by_id_and_copies_are_all_scored(spark):
    docs = [(7, "one two " * 20)] * 30 + [(3, "one two " * 20)] * 30 + [(None, "one two " * 20)] * 40
    got = resampled(spark, docs, ["two"], percent=50)
    assert order(got) == order(plain_resampling(docs, ["two"], 50))


def test_nothing_to_draw(spark):
    assert resampled(spark, [], ["x"]) == [] and resampled(spark, [], []) == []
    docs = [(i, "a few words only") for i in range(30)]
    assert order(resampled(spark, docs, [])) == order(plain_resampling(docs, []))
    clash = spark.createDataFrame([(1, "x y", 2, 3)], "doc_id long, text string, score int, weight int")
    assert resampling.resample(clash, clash).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_standings_count_what_stands_above(spark):
    scores = [random.Random(5).randint(-50, 50) for _ in range(2000)] + [7] * 1000
    got = {r["score"]: (r["n"], r["above"]) for r in resampling.standings(spark.createDataFrame([(s,) for s in scores], "score long")).collect()}
    assert got == {s: (scores.count(s), sum(x > s for x in scores)) for s in set(scores)}


# ---- 13: spelling variants


def plain_variants(docs):
    count = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    letters = sorted({x for w in n for x in w})
    out = {}
    for w in n:
        less = {w[:i] + w[i + 1 :] for i in range(len(w))}
        more = {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters}
        near = [x for x in less | more if x != w and x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = (form, len(near), n.get(form))
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n[w], k, m) for w, (f, k, m) in out.items()}


def variants(spark, docs, **settings):
    rows = spelling.variants(spark.createDataFrame(docs, DOC), **settings).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def word_docs(rng):
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)]

    def one():
        w = rng.choice(base[: 1 + int(len(base) * rng.random() ** 4)])
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abéÿÀ") + w[i:], w[:i] + rng.choice("abÉ×") + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    return [(i, rng.choice([" ", ", ", "-", "1", "ā"]).join(one() for _ in range(40))) for i in range(300)]


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0xF << 60])  # the second makes nearly all keys collide
def test_variants_against_a_plain_version(spark, mask):
    docs = word_docs(random.Random(6))
    want = plain_variants(docs)
    assert variants(spark, docs, mask=mask) == want
    assert sum(f is not None for f, *_ in want.values()) > 50 and any(want[f][0] for f, *_ in want.values() if f)


def test_chains_of_forms_end_at_a_root(spark):
    docs = [(i, " ".join(["aaaaaaa"] * 2 + ["aaaaaab"] * 20 + ["aaaaacb"] * 200 + ["aaaadcb"] * 2000)) for i in range(1)]
    got = variants(spark, docs, damage=1 << 31)
    assert got["aaaaaaa"] == ("aaaaaab", "aaaadcb", 2, 1, 20) and got["aaaadcb"] == (None, "aaaadcb", 2000, 1, None)


def test_words_of_awkward_texts(spark):
    docs = [(i if i != 3 else None, t) for i, t in enumerate(AWKWARD)] + [(20, "z" * 300 + " " + "z" * 300 + " Ärgerlich ärgerlich ÄRGERLICH")] * 2
    assert variants(spark, docs) == plain_variants(docs)
    assert variants(spark, []) == {} and variants(spark, [(1, "short words only")]) == {}


def test_letters_there_and_back():
    words = ["", "abc", "éa", "ÿÀ", "aéb×÷"]
    latin, first = spelling.latin1(pa.array(words))
    assert [latin[a:b].tobytes().decode("latin-1") for a, b in zip(first, first[1:])] == words
    assert spelling.utf8(latin, first[1:]).to_pylist() == words
