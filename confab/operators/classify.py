"""Classifiers over chains (``collected`` rows), each giving score, matched and reasoning, and their cascade."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab import config as K
from confab.functions import text as X
from confab.operators.calls import AnswerStore, Call, answered
from confab.operators.chains import joined_text
from confab.sources.storage import cut


def result(score: Column, matched: Column, reasoning: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), matched.alias("matched"), reasoning.alias("reasoning"))


def failed(reason: str) -> Column:
    return result(F.lit(0.0), F.lit(False), F.lit(reason))


def with_texts(chained: DataFrame) -> DataFrame:
    """``chained`` with the joined texts that classifiers read, each made once: _text, _low and _full (without blank messages, lower-cased)."""
    chain = F.col("chain")
    return chained.withColumns({"_text": joined_text(chain), "_full": F.lower(joined_text(chain, " \n ", blank=False))}).withColumn("_low", F.lower("_text"))


TEXT_COLUMNS = ["_text", "_low", "_full"]


def keyword(low: Column, keywords: str | None) -> Column:
    """low: the chain's lower-cased text."""
    words = X.split_list(keywords)
    if not words:
        return failed("no keywords")
    hits = F.array(*(F.when(low.contains(w), F.lit(w)) for w in words))
    found = F.array_compact(hits)
    n = F.size(found)
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.55) + F.greatest(F.lit(0), n - 1) * F.lit(0.12)))
    return result(score, n > 0, F.when(n > 0, F.concat(F.lit("keywords: "), F.array_join(found, ", "))).otherwise(F.lit("no keyword found")))


def regex(spark: SparkSession, text: Column, pattern: str | None) -> Column:
    """text: the chain's text."""
    if not (pattern or "").strip():
        return failed("no pattern")
    if not X.is_valid_pattern(spark, pattern):
        return failed("invalid pattern")
    hit = text.rlike("(?i)" + pattern)
    return result(F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)), hit, F.when(hit, F.lit("pattern found")).otherwise(F.lit("pattern not found")))


def linear_features(chain: Column, low: Column) -> dict[str, Column]:
    """Named features of a chain, all between 0 and 1. low: its text without blank messages, lower-cased."""
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    replies = F.aggregate(chain, F.lit(0), lambda n, m: n + F.coalesce(m["reply_count"], F.lit(0)))
    out = {
        "text_length_norm": F.least(F.lit(1.0), X.utf16_length(low) / 500.0), "reply_count_norm": F.least(F.lit(1.0), replies / 5.0),
        "has_topic": one(F.exists(chain, lambda m: m["topic_id"].isNotNull())), "is_not_bot": one(F.exists(chain, lambda m: ~F.coalesce(m["is_bot"], F.lit(False)))),
    }
    return out | {name: one(X.contains_any(low, words)) for name, words in K.LINEAR_MARKERS.items()}


def linear_model(chained: DataFrame, config: dict | str | None, name: str) -> DataFrame:
    """Adds the result ``name``: a weighted sum of features in the order of the configuration, squashed; the reasoning names the five largest terms.

    chained: ``with_texts``. Features, sum and score are columns of steps of their own, so each is worked out once.
    """
    try:
        config = json.loads(config) if isinstance(config, str) else config
    except ValueError:
        return chained.withColumn(name, failed("invalid model config"))
    if not isinstance(config, dict):
        return chained.withColumn(name, failed("no model config"))
    weights = config.get("features")
    if not isinstance(weights, dict):
        return chained.withColumn(name, failed("features must be an object"))
    features = linear_features(F.col("chain"), F.col("_full"))
    values = F.array(*(features.get(n, F.lit(0.0)) for n in weights))
    df = chained.withColumn("_v", values)
    raw = F.lit(float(config.get("bias", 0.0)))
    for i, w in enumerate(weights.values()):
        raw = raw + F.lit(float(w)) * F.col("_v")[i]
    df = df.withColumn("_raw", raw)
    squashed = X.clamp01(F.col("_raw")) if str(config.get("normalization", "sigmoid")).lower() == "clamp" else X.sigmoid(F.col("_raw"))
    df = df.withColumn("_squashed", squashed)
    threshold = float(config.get("threshold", K.LINEAR_DEFAULT_THRESHOLD))
    named = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, (n, w) in enumerate(weights.items())))
    terms = F.zip_with(named, "_v", lambda t, v: F.struct((-F.abs(t["w"] * v)).alias("o"), t["i"].alias("i"), t["n"].alias("n"), v.alias("v"), (t["w"] * v).alias("t")))
    top = F.transform(F.slice(F.array_sort(terms), 1, 5), lambda t: F.concat(t["n"], F.lit("="), X.three_decimals(t["v"]), F.lit(" -> "), X.three_decimals(t["t"])))
    said = F.concat(F.lit("score="), X.three_decimals(F.col("_squashed")), F.lit(" raw="), X.three_decimals(F.col("_raw")), F.lit(" | top: "), F.array_join(top, ", "))
    return df.withColumn(name, result(F.col("_squashed"), F.col("_squashed") >= threshold, said)).drop("_v", "_raw", "_squashed")


def chain_prompt(chain: Column, before: str | None = None) -> Column:
    """before: what a classifier's own prompt says, in front of the chain."""
    lines = F.transform(chain, lambda m: F.concat(F.lit("["), F.coalesce(m["sender_name"], F.lit("Unknown")), F.when(m["is_bot"], F.lit(" [BOT]")).otherwise(F.lit("")), F.lit("]: "), X.text_or_empty(m["text"]), F.lit("\n\n")))
    return F.concat(F.lit((f"{before}\n\n" if before else "") + "Message chain to classify:\n\n"), F.array_join(lines, ""))


def prompt_text(prompt: Column) -> Column:
    """What follows the first marker phrase that a prompt has."""
    out = prompt
    for marker in reversed(K.PROMPT_MARKERS):
        at = F.locate(marker, prompt)
        out = F.when(at > 0, X.trim_control(F.substring(prompt, at + len(marker), F.length(prompt)))).otherwise(out)
    return out


def mock_signals(prompt: DataFrame, column: str) -> DataFrame:
    """Adds what the stand-in model sees in a prompt, as columns with a leading underscore."""
    df = prompt.withColumn("_x", prompt_text(F.col(column))).withColumn("_low", F.lower("_x")).withColumn("_len", X.utf16_length(F.col("_low")))
    df = df.withColumns({f"_{k}": F.col("_x" if k == "list" else "_low").rlike(p) for k, p in K.MOCK_PATTERNS.items()} | {"_topic": X.contains_any(F.col("_low"), K.MOCK_TOPICS), "_marks": X.count_char(F.col("_x"), "?")})
    s = lambda k: F.col(f"_{k}")
    evidence = s("action") | s("release") | s("benchmark")
    strong = [s("guide"), s("code"), s("list"), s("url") & evidence, s("release") & (s("benchmark") | (s("len") >= 420)), (s("len") >= 520) & (s("release") | s("guide") | s("benchmark"))]
    return df.withColumn("_strong", reduce(lambda a, b: a + b, (c.cast("int") for c in strong)))


MOCK_COLUMNS = ["_x", "_low", "_len", *(f"_{k}" for k in K.MOCK_PATTERNS), "_topic", "_marks", "_strong"]


def mock_llm(prompts: DataFrame, column: str, name: str = "mock") -> DataFrame:
    """Adds the stand-in model's verdict on the prompt in ``column``; deterministic, so that cascades can be tested."""
    df = mock_signals(prompts, column)
    s = lambda k: F.col(f"_{k}")
    plain = ~s("code") & ~s("guide") & ~s("list")
    steps = [
        (s("topic"), 0.12), (s("guide"), 0.26), (s("release"), 0.14), (s("url"), 0.10), (s("code"), 0.22), (s("list"), 0.18), (s("action"), 0.12), (s("benchmark"), 0.10),
        (s("len") >= 420, 0.12), ((s("len") >= 240) & (s("len") < 420), 0.05), (s("strong") >= 3, 0.12), (s("question") & ~s("action") & plain, -0.22),
        ((s("marks") >= 2) & (s("strong") < 2), -0.12), (s("chatter") & ~s("url") & ~s("code") & ~s("guide"), -0.28), (s("promo") & plain, -0.28), (s("casual") & plain, -0.12),
        ((s("len") < 160) & plain & ~s("url"), -0.30),
    ]
    total = F.lit(0.0)
    for c, v in steps:
        total = total + F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    df = df.withColumn("_score", X.clamp01(total))
    evidence = s("action") | s("release") | s("benchmark")
    structure = ~plain | (s("url") & evidence) | (s("release") & s("benchmark") & (s("len") >= 420))
    matched = (s("score") >= 0.80) & (s("strong") >= 2) & structure & ~(s("chatter") & plain) & ~(s("promo") & plain)
    said = F.concat(F.lit("stand-in: strong="), s("strong").cast("string"), F.lit(" length="), s("len").cast("string"))
    # The answer states three decimals, and that is what is read back.
    return df.withColumn(name, result(X.three_decimals(s("score")).cast("double"), matched, said)).drop(*MOCK_COLUMNS, "_score")


ANSWER = "struct<score:string,matched:string,reasoning:string>"


def parse_answer(content: Column) -> Column:
    """A model's JSON answer, fenced or not, read leniently; what cannot be read scores 0.30 and never matches."""
    parsed = F.from_json(X.fenced_json(content), ANSWER, {"mode": "PERMISSIVE"})
    readable = parsed.isNotNull() & X.fenced_json(content).rlike(r"^\s*\{")
    score = F.coalesce(parsed["score"].try_cast("double"), F.lit(0.0))
    flag = F.coalesce(parsed["matched"].try_cast("boolean"), score >= K.CASCADE_THRESHOLD)
    good = result(score, flag, F.coalesce(parsed["reasoning"], F.lit("no reasoning given")))
    return F.when(readable, good).otherwise(result(F.lit(0.30), F.lit(False), F.concat(F.lit("unreadable answer: "), X.truncate(content, 200))))


def model_scores(prompts: DataFrame, column: str, call: Call, name: str, **settings) -> DataFrame:
    """Adds a model's result on the prompt in ``column``; where the model gave no answer, a failed one that says why. settings: of ``calls.answered``."""
    asked = answered(prompts, column, call, answer="_answer", error="_error", **settings)
    return asked.withColumn(name, F.when(F.col("_answer").isNull(), result(F.lit(0.0), F.lit(False), F.coalesce("_error", F.lit("the model gave no answer")))).otherwise(parse_answer(F.col("_answer")))).drop("_answer", "_error")


def resolved(classifiers: DataFrame, providers: DataFrame, prompts: DataFrame, default: str) -> DataFrame:
    """classifier_id, provider, prompt (the default if it has none) and error of model classifiers. Configuration tables, so small."""
    p = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider"), F.lit(True).alias("_known"))
    q = prompts.select(F.col("id").alias("prompt_id"), F.col("content").alias("_content"))
    error = F.when(F.col("provider_id").isNull(), F.lit("no provider")).when(F.col("_known").isNull(), F.lit("provider not found"))
    met = classifiers.withColumnRenamed("id", "classifier_id").join(p, "provider_id", "left").join(q, "prompt_id", "left")
    return met.select("classifier_id", "provider", F.coalesce("_content", F.lit(default)).alias("prompt"), error.alias("error"))


def cascade(results: list[tuple[str, Column]]) -> Column:
    """Selected and best result of classifiers in order of cost, and all that were asked. results: (type, result struct).

    A null result was not asked for. A result passes if it matched with at least the cascade's threshold. A passing model, or a passing other of 0.90 or
    more, ends the cascade; ties go to the first.
    """
    asked = lambda i, kind, r: F.when(r.isNotNull(), F.struct(F.lit(i).alias("pos"), F.lit(kind).alias("type"), r["score"].alias("score"), r["matched"].alias("matched"), r["reasoning"].alias("reasoning")))
    rows = F.array_compact(F.array(*(asked(i, kind, r) for i, (kind, r) in enumerate(results))))
    passes = lambda r: r["matched"] & (r["score"] >= K.CASCADE_THRESHOLD)
    ends = lambda r: passes(r) & ((r["type"] == "LLM") | (r["score"] >= K.EARLY_STOP))
    stop = F.coalesce(F.array_min(F.transform(F.filter(rows, ends), lambda r: r["pos"])), F.lit(len(results)))
    seen = F.filter(rows, lambda r: r["pos"] <= stop)
    first_best = lambda a: F.array_max(F.transform(a, lambda r: F.struct(r["score"].alias("score"), (-r["pos"]).alias("neg"), r["type"].alias("type"), r["reasoning"].alias("reasoning"))))
    return F.struct(first_best(F.filter(seen, passes)).alias("selected"), first_best(seen).alias("best"), F.size(seen).alias("evaluated"), seen.alias("attempts"))


def in_cost_order(classifiers: list[dict]) -> list[dict]:
    """Active classifiers, cheapest first, then by their order (100 if none)."""
    rank = lambda c: (K.COST_RANK.get((c.get("type") or "").upper(), 10 if c.get("type") else 99), 100 if c.get("order") is None else c["order"])
    return sorted((c for c in classifiers if c.get("status", "ACTIVE") == "ACTIVE"), key=rank)


def classify(chained: DataFrame, classifiers: list[dict], call: Call | Mapping[object, Call] | None = None, *, store: AnswerStore | None = None, away: str = "error") -> DataFrame:
    """``chained`` with verdict, the cascade over the configured classifiers.

    Classifiers are asked in order of cost, and each only on the chains that no earlier one has ended. ``call`` is the model of
    LLM classifiers, or one by the classifier's ``provider_id`` (``calls``); without one the stand-in answers. A classifier's ``prompt`` stands in front of
    the chain; one whose provider is unknown fails, and says so.
    """
    spark = chained.sparkSession
    rows, results = with_texts(chained).withColumn("_open", F.lit(True)), []
    for i, c in enumerate(in_cost_order(classifiers)):
        kind, name = c["type"].upper(), f"_r{i}"
        before, own_call = c.get("prompt"), call.get(c.get("provider_id")) if isinstance(call, Mapping) else call
        if kind == "LLM" and isinstance(call, Mapping) and own_call is None:
            rows = rows.withColumn(name, failed("no provider" if c.get("provider_id") is None else "provider not found"))
        elif kind == "LLM" and own_call is not None:
            # The model only gets what is still open; what came before is written, so it is not worked out for both parts.
            rows = cut(rows, "cascade")
            asked = rows.where("_open").withColumn("_prompt", chain_prompt(F.col("chain"), before))
            asked = model_scores(asked, "_prompt", own_call, name, model=str(c.get("model") or c.get("provider_id") or ""), store=store, away=away).drop("_prompt")
            rows = asked.unionByName(rows.where("not _open"), allowMissingColumns=True)
        elif kind == "LLM":
            rows = mock_llm(rows.withColumn("_prompt", chain_prompt(F.col("chain"), before)), "_prompt", name).drop("_prompt")
        elif kind == "LINEAR_MODEL":
            rows = linear_model(rows, c.get("config"), name)
        else:
            made = {"KEYWORD": lambda c=c: keyword(F.col("_low"), c.get("keywords")), "REGEX": lambda c=c: regex(spark, F.col("_text"), c.get("pattern"))}
            rows = rows.withColumn(name, made[kind]() if kind in made else failed("unknown type"))
        rows = rows.withColumn(name, F.when(F.col("_open"), F.col(name)))
        own = F.col(name)
        ends = F.coalesce(own["matched"] & (own["score"] >= (K.CASCADE_THRESHOLD if kind == "LLM" else max(K.CASCADE_THRESHOLD, K.EARLY_STOP))), F.lit(False))
        rows = rows.withColumn("_open", F.col("_open") & ~ends)
        results.append((kind, own))
    helpers = [*TEXT_COLUMNS, "_open", *(f"_r{i}" for i in range(len(results)))]
    return rows.withColumn("verdict", cascade(results or [("", F.lit(None).cast("struct<score:double,matched:boolean,reasoning:string>"))])).drop(*helpers)
