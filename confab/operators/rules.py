"""Pre-filters and the ordered rule engine. Configuration is compiled into expressions once, on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab import config as K
from confab.functions import text as X

YES, NO = "Да", "Нет"


@dataclass(frozen=True)
class Rule:
    order: int
    id: int
    name: str
    action: str
    conditions: str


def seed_rules() -> list[Rule]:
    return [Rule(*r) for r in K.RULES]


def conditions_of(text: str | None) -> list[tuple[str, str]]:
    """(type, value) of each condition; anything that is no JSON array has none."""
    try:
        parsed = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(parsed, list):
        return []
    return [(str(c.get("type", "")).upper(), str(c.get("value", ""))) for c in parsed if isinstance(c, dict)]


def _whole(value: str, default: int) -> int:
    try:
        return int(value.strip())
    except ValueError:
        return default


def condition(spark: SparkSession, kind: str, value: str) -> Column:
    """One condition over text, group_id, is_bot and topic_id; an unknown kind never holds."""
    text = X.text_or_empty(F.col("text"))
    low = F.lower(text)
    if kind == "TEXT_CONTAINS":
        return low.contains(value.lower()) if value else F.lit(False)
    if kind == "KEYWORD_MATCH":
        return X.contains_any(low, X.split_list(value, ",;"))
    if kind == "REGEX_MATCH":
        return text.rlike("(?i)" + value) if X.is_valid_pattern(spark, value) else F.lit(False)
    if kind == "LENGTH_GT":
        return X.utf16_length(text) > _whole(value, 0)
    if kind == "LENGTH_LT":
        return X.utf16_length(text) < _whole(value, 2**31 - 1)
    if kind == "SENDER_IS_BOT":
        return F.coalesce("is_bot", F.lit(False)) == (value.strip().lower() == "true")
    if kind == "HAS_TOPIC":
        return F.col("topic_id").isNotNull()
    if kind == "GROUP_MATCH":
        return F.coalesce(F.col("group_id") == _whole(value, -1), F.lit(False))
    return F.lit(False)


def evaluate(messages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``messages`` with rule_passes, rule_reason and rule_checks: array<struct<name,action,matched,detail>>.

    Rules are tried in order. The first exclusion that holds ends it; of the inclusions the last that holds gives the reason,
    and none is needed to pass.
    """
    spark = messages.sparkSession
    rules = sorted(seed_rules() if rules is None else rules, key=lambda r: r.order)
    kind = "array<struct<name:string,action:string,matched:boolean,detail:string>>"
    if not rules:
        return messages.withColumns({"rule_passes": F.lit(True), "rule_reason": F.lit("no active rules"), "rule_checks": F.expr(f"cast(array() as {kind})")})
    out, checks = messages, []
    for i, rule in enumerate(rules):
        parsed = conditions_of(rule.conditions)
        holds, detail = F.lit(bool(parsed)), []
        for k, (what, value) in enumerate(parsed):
            out = out.withColumn(f"_c{i}_{k}", condition(spark, what, value))
            holds = holds & F.col(f"_c{i}_{k}")
            detail.append(F.concat(F.lit(f"{what}({value})="), F.when(F.col(f"_c{i}_{k}"), F.lit(YES)).otherwise(F.lit(NO))))
        text = F.concat_ws(" + ", *detail) if detail else F.lit("")
        out = out.withColumn(f"_c{i}", holds)
        checks.append(F.struct(F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"), F.col(f"_c{i}").alias("matched"), text.alias("detail")))
    # How many checks are made. It stands in no lambda, where it would be worked out again for every check of a message.
    ends = [F.when(F.col(f"_c{i}"), F.lit(i + 1)) for i, rule in enumerate(rules) if rule.action.upper() == "EXCLUDE"]
    out = out.withColumn("_stop", F.coalesce(*ends, F.lit(None).cast("int")))
    out = out.withColumn("rule_checks", F.slice(F.array(*checks), F.lit(1), F.coalesce("_stop", F.lit(len(rules)))))
    hit = F.element_at(F.filter("rule_checks", lambda c: c["matched"]), -1)
    any_hit = F.exists("rule_checks", lambda c: c["matched"])
    said = F.concat(F.lit('rule "'), hit["name"], F.lit('": '), hit["detail"])
    includes = any(r.action.upper() == "INCLUDE" for r in rules)
    default = "no inclusion holds, passed on to scoring" if includes else "only exclusions are active and none holds"
    reason = F.when(F.col("_stop").isNotNull(), F.concat(F.lit("rejected: "), said)).when(any_hit, F.concat(F.lit("passed: "), said)).otherwise(F.lit(default))
    helpers = [c for c in out.columns if c.startswith("_c") and c not in messages.columns]
    return out.withColumns({"rule_passes": F.col("_stop").isNull(), "rule_reason": reason}).drop("_stop", *helpers)


def result_json(passes: Column, reason: Column, most: int = 4000) -> Column:
    """What is stored of an evaluation: a JSON text, cut and dotted if it is longer."""
    return X.truncate(F.to_json(F.struct(passes.alias("passed"), reason.alias("reason"))), most)


def prefilter(messages: DataFrame, groups: DataFrame | None = None, settings: dict | None = None) -> DataFrame:
    """``messages`` with skip_reason, null where a message goes on: disabled group, bot, too short, first blacklisted word."""
    s = K.SETTINGS if settings is None else settings
    low = F.lower(X.text_or_empty(F.col("text")))
    reason = F.lit(None).cast("string")
    words = X.split_list(s["blacklist"])
    for w in reversed(words):
        reason = F.when(low.contains(w), F.lit(f"blacklisted: {w}")).otherwise(reason)
    reason = F.when(X.utf16_length(X.text_or_empty(F.col("text"))) < s["min_length"], F.lit("too short")).otherwise(reason)
    if s["skip_bots"]:
        reason = F.when(F.coalesce("is_bot", F.lit(False)), F.lit("bot")).otherwise(reason)
    if groups is None:
        return messages.withColumn("skip_reason", reason)
    on = groups.select(F.col("id").alias("_g"), F.col("enabled").alias("_on"))
    joined = messages.join(on, F.col("group_id") == F.col("_g"), "left")
    return joined.withColumn("skip_reason", F.when(~F.coalesce("_on", F.lit(False)), F.lit("group disabled")).otherwise(reason)).drop("_g", "_on")
