"""Secret scanning: fixed patterns, and a battery of randomness tests over strings that look encoded.

Patterns give the base spans. For the battery, unbroken runs of encoded-looking characters with a digit are candidates; the
encoding (hex, base32, base64, base64url) is inferred from the characters a run has. A candidate must look random: its
symbols uniform (chi-squared), the runs above and below the middle of the alphabet as many as chance gives (Wald-Wolfowitz),
neighbours uncorrelated (lag-1 serial correlation); any of the three rejecting uniform randomness at ``BATTERY_P`` drops it.
What is left is held against ordinary text, by two tests that know the length. Under text whose symbols are skewed by ``SKEW``
(its divergence from uniform a symbol) the chi-squared statistic is noncentral with a mean that grows with length, so its lower
tail is a p-value. In words and numbers that are strung together a character is seldom of another kind (digit, capital, small
letter) than the one before, so the upper tail of the number of changes of kind, at ``CHANGE`` a place, is another. Fisher's
product of both is a candidate's p. Benjamini-Hochberg at ``FDR`` over the distinct candidates of an encoding and length class,
from counts of p-values by bin, sets the limit; candidates below it are ``random`` spans unless a base span touches them.

All of it is DataFrame expressions; a corpus-wide count of at most 24 x 401 bins is the only thing collected. No shuffle of
text (of candidates only hashes move): a hot source or huge groups of copies are just rows.

Defined cases: null text is empty; an empty table gives no rows; offsets are code points, ends exclusive; equal texts get
equal spans; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)()"
HEX = r"(?<![0-9a-f])([0-9a-f]{32,})()"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2})()"
KINDS = ["assign", "access", "hex", "random"]

#: Encodings: characters in the order of their values, and how skewed ordinary text is in them (size of the alphabet times the
#: sum of squared frequencies, less 1: 0.6 for decimal digits read as hex; 3.2 for lower-case English read as base64, 2 with capitals).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SKEW = {"hex": 0.6, "HEX": 0.6, "base32": 0.8, "base36": 1.2, "base64": 2.0, "base64url": 2.0}
#: How often a character of ordinary strings of words and numbers is of another kind than the one before.
CHANGE = 0.2
BATTERY_P, FDR = 1e-4, 0.01
BINS, PER_DECADE = 400, 10
#: Upper length of each class; the last is open.
CLASSES = [31, 63, 127]


#: Items that are folded at a time: within a block an array is built by appending, which copies it.
BLOCK = 128


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(items: Column, state: Column, kind: str, step, prepare=None) -> Column:
    """Items in order, each made into an array by ``step`` of a running state, all on end; work grows in proportion to the items.

    step: (state, item, what ``prepare`` makes of a block) to (state, array). kind: the items' type. prepare: (state, block) to a value.
    """
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def block_of(before: Column, block: Column) -> Column:
        def fold(context: Column) -> Column:
            def one(acc: Column, x: Column) -> Column:
                after, made = step(acc["state"], x, context)
                return F.struct(after.alias("state"), F.concat(acc["out"], made).alias("out"))

            return F.aggregate(block, F.struct(before.alias("state"), empty.alias("out")), one)

        return bound(F.lit(0) if prepare is None else prepare(before, block), fold)

    def whole(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.lit(1), F.size(all_)) - 1) / BLOCK).cast("int"))
        start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("outs"))
        add = lambda acc, i: bound(block_of(acc["state"], F.slice(all_, i * BLOCK + 1, F.lit(BLOCK))), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))
        return F.flatten(F.aggregate(blocks, start, add)["outs"])

    return bound(items, whole)


def found(text: Column, pattern: str, keep: str) -> Column:
    """array<struct<start,end,text>> of the leftmost non-overlapping matches for which ``keep`` holds.

    keep: a rule of ``_keep``. Splitting by the same pattern gives what lies between matches, so
    running lengths are offsets.
    """
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("g"), F.split(text, pattern).alias("before"))

    def step(at: Column, x: Column, _: Column) -> tuple[Column, Column]:
        start = at + F.length(x["before"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"), x["g"].alias("g")))
        # arrays_zip pads the matches, of which there is one less than of pieces, with a null
        return end, F.when(x["m"].isNull(), F.slice(one, 1, 0)).otherwise(one)

    all_ = in_blocks(zipped, F.lit(0), "struct<start:int,end:int,text:string,g:string>", step)
    return F.transform(F.filter(all_, lambda x: _keep(keep, x)), lambda x: F.struct(x["start"], x["end"], x["text"]))


def _keep(rule: str, x: Column) -> Column:
    return {"value8": F.length(x["g"]) >= 8, "match16": F.length(x["text"]) >= 16, "all": F.lit(True)}[rule]


def gated(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind. A cheap test that every match passes spares most texts the pattern."""
    low = F.lower(text)
    words = F.lit(False)
    for w in ("passw", "secret", "token", "apikey", "api_key"):
        words = words | low.contains(w)
    return {
        "assign": gated(words, found(text, ASSIGN, "value8")),
        "access": gated(text.contains("AKIA"), found(text, ACCESS, "match16")),
        "hex": gated(text.rlike("[0-9a-f]{32}"), found(text, HEX, "all")),
    }


#: Coefficients of a Chebyshev fit of ln(erfc(x) / t) + x * x in t = 1 / (1 + x / 2), lowest power first: a fixed table.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def upper(z: Column) -> Column:
    """Upper tail of the normal distribution, with a relative error below 2e-7 in the tail."""
    x = F.least(F.lit(37.0), F.abs(z)) / 2**0.5
    t = 1.0 / (1.0 + x / 2.0)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + t * series
    tail = t * F.exp(series - x * x) / 2.0
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def encoding(s: Column) -> Column:
    """The inferred encoding of a candidate (padding removed), or null."""
    capital, lower, digit = s.rlike("[A-Z]"), s.rlike("[a-z]"), s.rlike("[0-9]")
    return (
        F.when(s.rlike("^[0-9a-f]+$") & lower & digit, F.lit("hex")).when(s.rlike("^[0-9A-F]+$") & capital & digit, F.lit("HEX"))
        .when(s.rlike("^[A-Z2-7]+$") & capital & digit, F.lit("base32")).when(s.rlike("^[a-z0-9]+$") & lower & digit, F.lit("base36"))
        .when(s.rlike("^[A-Za-z0-9+/]+$") & capital & lower & digit, F.lit("base64")).when(s.rlike("^[A-Za-z0-9_-]+$") & capital & lower & digit, F.lit("base64url"))
    )


#: Characters by kind: digits and signs, small letters, capitals.
KINDS_FROM = "".join(chr(c) for c in range(0x21, 0x7F))
KINDS_TO = "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" for c in KINDS_FROM)


def by_encoding(enc: Column, value) -> Column:
    out = F.lit(None)
    for name in ALPHABETS:
        out = F.when(enc == name, value(name)).otherwise(out)
    return out


def tested(candidates: Column) -> Column:
    """array<struct<start,end,size,enc,key,random,p>> of the candidates that have an encoding."""
    named = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.rtrim(c["text"], F.lit("=")).alias("s")))
    named = F.transform(named, lambda c: F.struct(c["start"], c["end"], c["s"], encoding(c["s"]).alias("enc"), F.length(c["s"]).cast("double").alias("n")))
    named = F.filter(named, lambda c: c["enc"].isNotNull())

    def counts(c: Column) -> Column:
        chars = F.filter(F.split(c["s"], ""), lambda x: x != "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a + F.pow((c["n"] - F.length(F.replace(c["s"], x, F.lit("")))).cast("double"), F.lit(2.0)))
        alphabet = by_encoding(c["enc"], lambda e: F.lit(ALPHABETS[e]))
        values = F.transform(chars, lambda x: F.position(x, alphabet).cast("double"))
        halves = by_encoding(c["enc"], lambda e: F.translate(c["s"], ALPHABETS[e], "0" * (len(ALPHABETS[e]) // 2) + "1" * (len(ALPHABETS[e]) // 2)))
        kinds = F.translate(c["s"], KINDS_FROM, KINDS_TO)
        changes = sum((c["n"] - F.length(F.replace(kinds, F.lit(a + b), F.lit(""))) for a in "0aA" for b in "0aA" if a != b), F.lit(0.0)) / 2.0
        return F.struct(
            c["start"], c["end"], c["n"], c["enc"], F.xxhash64(c["s"]).alias("key"), changes.alias("changes"), by_encoding(c["enc"], lambda e: F.lit(float(len(ALPHABETS[e])))).alias("a"), by_encoding(c["enc"], lambda e: F.lit(SKEW[e])).alias("skew"),
            squares.alias("squares"), halves.alias("h"), values.alias("v"),
        )

    def statistics(c: Column) -> Column:
        n, a, h, v = c["n"], c["a"], c["h"], c["v"]
        turns = (n - F.length(F.replace(h, F.lit("01"), F.lit(""))) + n - F.length(F.replace(h, F.lit("10"), F.lit("")))) / 2.0
        ones = F.length(F.replace(h, F.lit("0"), F.lit(""))).cast("double")
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        return F.struct(
            c["start"], c["end"], n.alias("n"), c["enc"], c["key"], c["changes"], (a - 1.0).alias("df"), (n * c["skew"]).alias("shift"), (a / n * c["squares"] - n).alias("chi"), (turns + 1.0).alias("runs"), ones.alias("n1"), (n - ones).alias("n0"),
            mean.alias("mean"), v.alias("v"),
        )

    def tests(c: Column) -> Column:
        n, df, chi = c["n"], c["df"], c["chi"]
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        want = 2.0 * c["n0"] * c["n1"] / n + 1.0
        spread = (want - 1.0) * (want - 2.0) / (n - 1.0)
        z_runs = F.when(spread > 0, (c["runs"] - want) / F.sqrt(spread)).otherwise(F.lit(30.0))
        centred = F.transform(c["v"], lambda x: x - c["mean"])
        square = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x)
        lag = F.aggregate(F.zip_with(centred, F.slice(centred, 2, F.size(centred)), lambda x, y: x * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        z_lag = F.when(square > 0, lag / square * F.sqrt(n)).otherwise(F.lit(30.0))
        least = F.least(upper(z_chi), 2.0 * upper(F.abs(z_runs)), 2.0 * upper(F.abs(z_lag)))
        even = upper((df + c["shift"] - chi) / F.sqrt(2.0 * (df + 2.0 * c["shift"])))
        mixed = upper((c["changes"] - 0.5 - CHANGE * (n - 1.0)) / F.sqrt(CHANGE * (1.0 - CHANGE) * (n - 1.0)))
        both = F.greatest(F.lit(1e-80), even * mixed)
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), n.cast("int").alias("size"), by_encoding(c["enc"], lambda e: F.lit(list(ALPHABETS).index(e))).alias("enc"), c["key"].alias("key"),
            (least >= BATTERY_P / 3).alias("random"), (both * (1.0 - F.ln(both))).alias("p"),
        )

    return F.transform(F.transform(F.transform(named, counts), statistics), tests)


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        out = F.when(n <= most, F.lit(i)).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """Tenths of a decade below 1: a candidate of bin b has p <= 10 ** (-b / PER_DECADE)."""
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * PER_DECADE))).cast("int")


def limits(rows: list[tuple[int, int, int]], fdr: float, groups: int = len(CLASSES) + 1) -> list[int]:
    """The least bin that is a discovery, by group. rows: (group, bin, count)."""
    out = [BINS + 1] * groups
    for k in range(len(out)):
        count = [0] * (BINS + 1)
        for c, b, n in rows:
            if c == k:
                count[b] += n
        total = sum(count)
        below = 0
        for b in range(BINS, -1, -1):
            below += count[b]
            if count[b] and 10 ** (-b / PER_DECADE) <= fdr * below / total:
                out[k] = b
    return out


def group_of(t: Column) -> Column:
    """Number of a candidate's encoding and length class."""
    return t["enc"] * (len(CLASSES) + 1) + length_class(t["size"])


def untouched(spans: Column, others: Column) -> Column:
    """struct<start,end> of the spans that none of the others overlaps. spans: not overlapping, by start.

    All stand in one array by where they begin. On the way up, a span is touched by what has begun and not ended; on the way down, by what
    begins before its end.
    """
    kind = "start:int,end:int,own:boolean"
    of = lambda a, own: F.transform(a, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.lit(own).alias("own")))
    one = lambda x, free: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["own"].alias("own"), free.alias("free")))
    none = lambda a: F.slice(a, 1, 0)

    def up(ended: Column, x: Column, _: Column) -> tuple[Column, Column]:
        return F.when(x["own"], ended).otherwise(F.greatest(ended, x["end"])), one(x, ~x["own"] | (ended <= x["start"]))

    def down(begun: Column, x: Column, _: Column) -> tuple[Column, Column]:
        free = x["own"] & x["free"] & (begun >= x["end"])
        return F.when(x["own"], begun).otherwise(x["start"]), F.when(free, one(x, free)).otherwise(none(one(x, free)))

    events = F.array_sort(F.concat(of(spans, True), of(others, False)))
    risen = in_blocks(events, F.lit(-1), f"struct<{kind},free:boolean>", up)
    fallen = F.reverse(in_blocks(F.reverse(risen), F.lit(2**31 - 1), f"struct<{kind},free:boolean>", down))
    kept = F.transform(fallen, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    plain = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), plain).otherwise(kept)


def scan(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR, prefix: str = "") -> DataFrame:
    """``docs`` with spans: array<struct<start,end,kind>>, by start and then kind."""
    name = prefix + "spans"
    base = common.without(docs, [name])
    held = common.fresh(base, "tested")
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidates = gated(text.rlike("[A-Za-z0-9+/_-]{20}") & text.rlike("[0-9]"), found(text, CANDIDATE, "all"))
    seen = base.select(candidates.alias("c")).where(F.size("c") > 0).select(F.explode(tested(F.col("c"))).alias("t"))
    distinct = seen.where("t.random").select(group_of(F.col("t")).alias("k"), p_bin(F.col("t.p")).alias("b"), "t.key").distinct()
    bins = distinct.groupBy("k", "b").agg(F.count("*").alias("n")).collect()
    most = limits([(r["k"], r["b"], r["n"]) for r in bins], fdr, len(ALPHABETS) * (len(CLASSES) + 1))

    spans = base_spans(text)
    kinds = lambda s, kind: F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end")))
    fixed = F.concat(*(kinds(s, k) for k, s in spans.items()))
    marked = base.withColumn(held, tested(candidates)).withColumn(name, fixed)
    limit = lambda t: F.element_at(F.array(*map(F.lit, most)), group_of(t) + 1)
    hits = untouched(F.filter(held, lambda t: t["random"] & (p_bin(t["p"]) >= limit(t))), F.col(name))
    joined = F.array_sort(F.concat(name, kinds(hits, "random")))
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["order"] + 1)
    return marked.withColumn(name, F.transform(joined, lambda x: F.struct(x["start"], x["end"], kind(x).alias("kind")))).drop(held)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal stretch that spans (by start) cover replaced by ``mark``."""
    last = F.array_max(F.transform(spans, lambda s: s["end"]))

    def stretch(at: Column, block: Column) -> Column:
        """The block's part of the text, and where it begins: pieces are cut out of it, not out of the whole text."""
        upto = F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))
        return F.struct(F.substring(text, at + 1, upto - at).alias("t"), at.alias("from"))

    def step(at: Column, s: Column, part: Column) -> tuple[Column, Column]:
        pieces = F.array(F.substring(part["t"], at - part["from"] + 1, s["start"] - at), F.lit(mark))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, pieces).otherwise(F.slice(pieces, 1, 0))

    pieces = in_blocks(spans, F.lit(0), "string", step, stretch)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text))))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document."""
    docs = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return docs.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), n("random"))
