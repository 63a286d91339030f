"""Signal score of a message: a fixed sum of what its text and context show, and the gate on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab import config as K
from confab.functions import text as X


def length_score(n: Column) -> Column:
    out = F.lit(0.0)
    for least, value in reversed(K.LENGTH_STEPS):
        out = F.when(n >= least, F.lit(value)).otherwise(out)
    return out


def signal_terms(messages: DataFrame) -> DataFrame:
    """Adds one double column per term, in the order of the sum; penalties that do not apply are null."""
    m = messages.withColumn("_t", X.trim_control(X.text_or_empty(F.col("text")))).withColumn("_n", X.utf16_length(F.col("_t")))
    t = F.col("_t")
    hits = {"guideMarkers": t.rlike(K.GUIDE), "questionMarkers": t.rlike(K.QUESTION), "sourceMarkers": t.rlike(K.SOURCE), "links": t.rlike(K.URL)}
    m = m.withColumns({f"_{k}": c for k, c in hits.items()})
    flags = {k: F.col(f"_{k}") for k in hits} | {
        "code": t.rlike(K.CODE), "listStructure": t.rlike(K.LIST), "replyContext": F.col("reply_to_message_id").isNotNull(),
        "activeDiscussion": F.coalesce(F.col("reply_count") > 0, F.lit(False)), "topicContext": F.col("topic_id").isNotNull(),
    }
    hits_any = F.lit(False)
    for k in hits:
        hits_any = hits_any | F.col(f"_{k}")
    ack = F.lower(t).isin(K.ACKNOWLEDGEMENTS)
    short = ~ack & (F.col("_n") > 0) & (F.col("_n") < 8) & ~hits_any
    columns = {k: F.when(c, F.lit(K.SIGNAL_WEIGHTS[k])).otherwise(F.lit(0.0)) for k, c in flags.items()} | {
        "length": length_score(F.col("_n")), "humanAuthored": F.when(F.coalesce("is_bot", F.lit(False)), F.lit(K.BOT)).otherwise(F.lit(K.HUMAN)),
        "ackPenalty": F.when(ack, F.lit(K.ACK_PENALTY)), "shortPenalty": F.when(short, F.lit(K.SHORT_PENALTY)),
        "emptyPenalty": F.when(~ack & ~short & X.is_blank(t), F.lit(K.EMPTY_PENALTY)),
    }
    return m.withColumns(columns).drop("_t", "_n", *(f"_{k}" for k in hits))


TERMS = [*K.SIGNAL_WEIGHTS, "length", "humanAuthored", "ackPenalty", "shortPenalty", "emptyPenalty"]


def signal_score(messages: DataFrame, *, breakdown: bool = False) -> DataFrame:
    """``messages`` with signal_score, and with signal_breakdown (map of the terms that apply) if asked for."""
    m = signal_terms(messages)
    total = F.lit(0.0)
    for name in TERMS:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    m = m.withColumn("signal_score", X.clamp01(total))
    if breakdown:
        entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in TERMS)), lambda e: e["value"].isNotNull())
        m = m.withColumn("signal_breakdown", F.map_from_entries(entries))
    return m.drop(*TERMS)


def passing(scored: DataFrame, threshold: float = K.SIGNAL_THRESHOLD) -> DataFrame:
    return scored.where(F.col("signal_score") >= threshold)
