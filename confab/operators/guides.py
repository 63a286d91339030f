"""Guides from chains: titles, tags, prompts, the local fallback, and what they are estimated to cost."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab import config as K
from confab.functions import text as X
from confab.operators import chains
from confab.operators.calls import AnswerStore, Call, answered
from confab.sources.storage import cut


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which Spark has no expression for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fallback_tags(source: Column, normalised: Column) -> Column:
    """Tags that the source's words, product names and capitalised phrases suggest: at most six, in that order."""
    low = F.lower(X.text_or_empty(normalised))
    known = F.filter(F.array(*(F.when(X.contains_any(low, words), F.lit(tag)) for words, tag in K.FALLBACK_TAGS)), lambda t: t.isNotNull())
    products = F.regexp_extract_all(X.text_or_empty(source), F.lit(K.PRODUCT_TAG), F.lit(1))
    phrases = F.filter(F.transform(F.regexp_extract_all(X.text_or_empty(source), F.lit(K.CAPITALISED_TAG), F.lit(1)), X.trim_control), lambda v: (F.length(v) >= 3) & ~v.startswith("ROOT") & ~v.startswith("THREAD"))
    # Known tags are never cut; the others only fill up to six.
    known = F.array_distinct(known)
    filled = F.concat(known, F.slice(F.array_except(F.array_distinct(F.concat(products, phrases)), known), F.lit(1), F.greatest(F.lit(0), 6 - F.size(known))))
    return F.when(X.is_blank(source) | (F.size(filled) == 0), F.array(F.lit(K.DEFAULT_TAG))).otherwise(filled)


def normalised_tags(tags: Column, fallback: Column) -> Column:
    """Trimmed, cut to 40 characters, distinct, at most six; fewer than three are filled up from ``fallback``."""
    clean = F.filter(F.transform(F.coalesce(tags, F.expr("cast(array() as array<string>)")), lambda t: X.trim_control(F.substring(X.trim_control(t), 1, 40))), lambda t: t.isNotNull() & (t != ""))
    clean = F.slice(F.array_distinct(clean), 1, 6)
    return F.when(F.size(clean) < 3, F.slice(F.array_distinct(F.concat(clean, fallback)), 1, 6)).otherwise(clean)


def estimate(chain: Column, prompt_length: int, content: Column, title: Column) -> Column:
    """Estimated tokens in and out, and their price."""
    chars = F.aggregate(chain, F.lit(prompt_length), lambda n, m: n + X.utf16_length(X.text_or_empty(m["text"])))
    tokens_in = F.floor(chars / 3).cast("long")
    tokens_out = F.greatest(F.floor((X.utf16_length(X.text_or_empty(content)) + X.utf16_length(X.text_or_empty(title))) / 3).cast("long"), F.lit(200).cast("long"))
    return F.struct(tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), ((tokens_in + tokens_out) * F.lit(K.TOKEN_PRICE)).alias("cost"))


def fallback_title(chain: Column) -> Column:
    """The chain's first text, cut to 90 characters."""
    texts = F.transform(F.filter(chain, lambda m: ~X.is_blank(m["text"])), lambda m: X.trim_control(m["text"]))
    return F.coalesce(X.truncate(F.get(texts, F.lit(0)), 90), F.lit("Local draft"))


def fallback_guide(chained: DataFrame) -> DataFrame:
    """Adds guide: title, content, confidence and tags of a draft made without a model, from ``chain`` and ``verdict``."""
    chain, best = F.col("chain"), F.coalesce("verdict.selected", "verdict.best")
    lines = F.transform(chain, lambda m: F.concat(F.lit("- **"), X.sender_or_unknown(m["sender_name"]), F.lit("**: "), F.when(X.is_blank(m["text"]), F.lit("[empty]")).otherwise(X.trim_control(m["text"]))))
    df = chained.withColumn("_title", fallback_title(chain))
    content = F.concat(F.lit("# "), F.col("_title"), F.lit("\n\n- score: "), X.three_decimals(best["score"]), F.lit("\n- reasoning: "), best["reasoning"], F.lit("\n\n## Messages\n\n"), F.array_join(lines, "\n"))
    guide = F.struct(F.col("_title").alias("title"), content.alias("content"), F.lit(0.55).alias("confidence"), F.array(F.lit("local draft"), F.lit("AI"), F.lit("draft")).alias("tags"))
    return df.withColumn("guide", guide).drop("_title")


def whole_guide(title: Column, content: Column, markdown: Column, confidence: Column, tags: Column, error: Column) -> Column:
    kinds = {"title": title, "content": content, "markdown": markdown, "confidence": confidence.cast("double"), "tags": tags.cast("array<string>"), "error": error.cast("string")}
    return F.struct(*(c.alias(n) for n, c in kinds.items()))


def local_guide(rows: DataFrame) -> DataFrame:
    """``rows`` with the draft that needs no model as a whole guide."""
    g, none = F.col("guide"), F.lit(None)
    return fallback_guide(rows).withColumn("guide", whole_guide(g["title"], g["content"], g["content"], g["confidence"], g["tags"], none))


def no_guide(title: str, error: Column, tags: Column | None = None) -> Column:
    """What stands for a guide that could not be made."""
    tags = F.array(F.lit("AI"), F.lit("error"), F.lit("provider")) if tags is None else tags
    return whole_guide(F.lit(f"Guide not made: {title}"), error, F.concat(F.lit("## Guide not made\n\n"), error), F.lit(0.0), tags, error)


#: What a generator is told, unless a prompt of one's own says it.
INSTRUCTIONS = """Turn the conversation below into a practical guide. Answer with one JSON object: title, content (plain text), contentMarkdown, confidence (0 to 1) and tags (3 to 6, short).
Name the product, application or service if the conversation makes it clear. Keep links, commands, versions, prices and dates as they are.
ROOT, PARENT_REPLY, DIRECT_REPLY and THREAD_REPLY are the conversation itself; SAME_TOPIC_NEARBY, SAME_AUTHOR_NEARBY and TIMELINE_NEARBY only add to it.
If no useful guide comes of it, let confidence be below 0.5."""


def generation_prompts(messages: DataFrame, chain: DataFrame, rows: DataFrame, prompt: dict | None = None) -> DataFrame:
    """id and prompt of each of ``rows`` (id, verdict): instructions, the verdict, the root, and the chain's messages with how they stand to the root."""
    own = (prompt or {}).get("content")
    told = INSTRUCTIONS if own is None else own.replace("{{language}}", "English").replace("{{format}}", "markdown")
    said = ["id", "telegram_message_id", "reply_to_message_id", "topic_id", "topic_name", "sender_name", "text", "is_bot"]
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    near = chain.join(rows.select(F.col("id").alias("root_id")), "root_id", "left_semi")
    m = chains.chain_relations(messages, near).join(messages.select(*said), "id")
    line = F.concat(
        F.lit("- relation: "), "relation", F.lit("\n  sender: "), F.coalesce("sender_name", F.lit("Unknown")), F.when(F.coalesce("is_bot", F.lit(False)), F.lit(" [BOT]")).otherwise(F.lit("")), F.lit("\n  number: "), text(F.col("telegram_message_id")),
        F.lit("\n  reply to: "), text(F.col("reply_to_message_id")), F.lit("\n  topic: "), text(F.col("topic_id")), F.lit(" "), text(F.col("topic_name")), F.lit("\n  text: "), X.text_or_empty(F.col("text")), F.lit("\n\n"),
    )
    lines = m.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    r = F.coalesce("verdict.selected", "verdict.best")
    head = F.concat(F.lit(f"{told}\n\nClassification:\n- score: "), X.three_decimals(r["score"]), F.lit("\n- reasoning: "), r["reasoning"], F.lit("\n\nMain message: "), text(F.col("id")), F.lit("\n\nSource message chain:\n\n"))
    joined = rows.select("id", "verdict").join(lines.withColumnRenamed("root_id", "id"), "id")
    return joined.select("id", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("prompt"))


def generated(messages: DataFrame, chain: DataFrame, rows: DataFrame, generate: Call, *, prompt: dict | None = None, model: str = "", store: AnswerStore | None = None, away: str = "error") -> DataFrame:
    """``rows`` (id, chain, verdict) with the generator's guide; where it gave none, one that says why (``error``)."""
    asked = answered(cut(generation_prompts(messages, chain, rows, prompt), "prompts"), "prompt", generate, model=model, store=store, away=away, prompts=1)
    p = parse_guide(F.col("answer"), fallback_tags(F.col("prompt"), compatible("prompt")))
    asked = asked.withColumn("_p", p).withColumn("_tags", fallback_tags(F.col("prompt"), compatible("prompt")))
    p = F.col("_p")
    guide = F.when(F.col("answer").isNull(), no_guide("the generator failed", F.coalesce("error", F.lit("unknown error")), F.col("_tags"))).otherwise(
        whole_guide(p["title"], p["content"], p["markdown"], p["confidence"], p["tags"], F.lit(None))
    )
    return rows.join(asked.select("id", guide.alias("guide")), "id")


GUIDE = "struct<title:string,content:string,contentMarkdown:string,confidence:string,tags:array<string>>"


def parse_guide(answer: Column, fallback: Column) -> Column:
    """A model's guide, read leniently; an answer that is no JSON becomes the content as it is."""
    body = X.fenced_json(answer, braces=True)
    p = F.from_json(body, GUIDE)
    fields = lambda t, c, m, k, tags: F.struct(t.alias("title"), c.alias("content"), m.alias("markdown"), k.alias("confidence"), tags.alias("tags"))
    content = F.coalesce(p["content"], F.lit(""))
    good = fields(F.coalesce(p["title"], F.lit("Untitled Guide")), content, F.when(X.is_blank(p["contentMarkdown"]), content).otherwise(p["contentMarkdown"]), F.coalesce(p["confidence"].try_cast("double"), F.lit(0.5)), normalised_tags(p["tags"], fallback))
    raw = fields(X.message_title(answer), answer, answer, F.lit(0.5), fallback)
    return F.when(p.isNotNull() & body.rlike(r"^\s*\{"), good).otherwise(raw)


def mock_guide(source: Column) -> Column:
    """The stand-in model's guide: a title, a summary of 420 characters and up to five highlights."""
    lines = F.transform(F.split(source, r"\R"), lambda x: X.trim_control(F.regexp_replace(x, r"^\[[^\]]+\]:\s*", "")))
    title = F.coalesce(X.truncate(F.get(F.filter(lines, lambda x: F.length(x) >= 12), F.lit(0)), 90), F.lit("A note from the discussion"))
    summary = X.truncate(X.trim_control(F.regexp_replace(source, r"\s+", " ")), 420)
    points = F.transform(F.slice(F.filter(lines, lambda x: x != ""), 1, 5), lambda x: F.concat(F.lit("- "), X.truncate(x, 160)))
    return F.struct(title.alias("title"), summary.alias("summary"), F.array_join(points, "\n").alias("highlights"), F.when(X.utf16_length(source) >= 280, F.lit(0.78)).otherwise(F.lit(0.66)).alias("confidence"))


def publishes(mode: str, confidence: Column) -> Column:
    return F.lit(mode == "AUTO_PUBLISH") & (confidence > K.AUTO_PUBLISH_CONFIDENCE)
