"""The message pipeline as one pass over all messages: gates, rules, score, chain, classifiers, guide, and what they leave.

Cheap stages filter before expensive ones: chains are only built for messages whose score passes, classifiers only see
chains, and a generator is only asked for chains that a classifier has selected.

In ``independent`` mode each root is judged on the snapshot. In ``sequential`` mode the result is that of draining the queue one by
one, in the order of dates and ids: a root that gets its guide uses up the messages of its chain that are still UNPROCESSED, and these are
never roots of their own (QUEUED ones were asked for, so they stay). Rounds settle every undecided root that no undecided earlier
root's chain could use up, so the work of a round is one join, whatever a group's size; a root whose guide fails uses up nothing.

A guide comes from ``generate`` (``calls``: answers are stored before they are used, so that no retry calls twice) if there is a provider, else
from the local fallback; without either, or where the generator fails, the guide is FAILED and its root is in ERROR.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab import config as K
from confab.functions import text as X
from confab.operators import chains as C
from confab.operators import classify, guides, rules, scoring
from confab.operators.calls import AnswerStore, Call, timed
from confab.sources.storage import cut

CLASSIFIERS = [
    {"id": 1, "name": "keywords", "type": "KEYWORD", "keywords": K.KEYWORDS, "order": 1, "status": "ACTIVE"},
    {"id": 2, "name": "how-to pattern", "type": "REGEX", "pattern": r"\bhow to\b|\bstep \d+", "order": 2, "status": "ACTIVE"},
    {"id": 3, "name": "linear model", "type": "LINEAR_MODEL", "config": K.LINEAR_MODEL, "order": 3, "status": "ACTIVE"},
]
#: Characters of a trace's input, output and error; the name that stands for the local fallback.
TRACE_TEXT, LOCAL = 2000, "local-fallback"


@dataclass
class Outcome:
    """What a run leaves, as new rows.

    statuses: id, outcome, reason, signal_score, classifier_score, rule_result_json, signal_breakdown (JSON), guide_id (the root of the guide that the message led to or was used for).
    guides, sources, usage: of the roots that were selected. traces: a row for each stage, and each classifier, that a message reached.
    taken: id and root_message_id of messages that a guide has used up (sequential mode).
    """

    statuses: DataFrame
    guides: DataFrame
    sources: DataFrame
    usage: DataFrame
    traces: DataFrame
    taken: DataFrame


def gated(messages: DataFrame, groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Messages that may be processed, with what gates, rules and score say: outcome is null where they go on. roots: id, if only some may."""
    open_ = messages.where(F.col("processing_status").isin("UNPROCESSED", "QUEUED"))
    open_ = open_ if roots is None else open_.join(roots.select("id"), "id", "left_semi")
    m = scoring.signal_score(rules.evaluate(rules.prefilter(open_, groups)), breakdown=True)
    m = m.withColumns({"rule_result_json": rules.result_json(F.col("rule_passes"), F.col("rule_reason")), "signal_breakdown": X.truncate(F.to_json("signal_breakdown"), 2000)})
    reason = F.coalesce(F.col("skip_reason"), F.when(~F.col("rule_passes"), F.col("rule_reason")), F.when(F.col("signal_score") < K.SIGNAL_THRESHOLD, F.lit("low score")))
    return m.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNotNull(), F.lit("SKIPPED")))


def in_order() -> Column:
    """Where a message stands in the queue."""
    return F.struct("message_date", "id")


def accepted_in_order(successes: DataFrame, holds: DataFrame, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Roots that succeed when roots are taken in order. successes: id, message_date. holds: root_id, id (what a root would use up).

    settle: told of the roots whose turn has come, round by round, and gives those that did succeed; the others use up nothing.
    """
    order = successes.select("id", in_order().alias("o"))
    edges = (
        holds.where("root_id <> id").join(order.select(F.col("id").alias("root_id"), F.col("o").alias("_a")), "root_id").join(order.withColumnRenamed("o", "_b"), "id")
        .where(F.col("_a") < F.col("_b")).select(F.col("root_id").alias("earlier"), F.col("id").alias("later"))
    )
    edges, undecided = cut(edges, "holds"), cut(successes.select("id"), "undecided")
    accepted = undecided.where("false")
    while undecided.head(1):
        live = edges.join(undecided.select(F.col("id").alias("earlier")), "earlier", "left_semi")
        free = cut(undecided.join(live.select(F.col("later").alias("id")).distinct(), "id", "left_anti"), "accepted")
        good = free if settle is None else settle(free)
        accepted = accepted.unionByName(good)
        held = edges.join(good.select(F.col("id").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("id")).distinct()
        undecided = cut(undecided.join(free, "id", "left_anti").join(held, "id", "left_anti"), "undecided")
    return accepted


def used_up(messages: DataFrame, chain: DataFrame, accepted: DataFrame) -> DataFrame:
    """id and root_message_id: unprocessed messages behind an accepted root in the queue that its chain holds; of several roots the first."""
    dated = messages.select("id", in_order().alias("o"), "processing_status")
    root = accepted.select(F.col("id").alias("root_id")).join(dated.select(F.col("id").alias("root_id"), F.col("o").alias("_root")), "root_id")
    met = chain.select("root_id", "id").join(root, "root_id").join(dated.where("processing_status = 'UNPROCESSED'"), "id")
    return met.where(F.col("o") > F.col("_root")).groupBy("id").agg(F.min_by("root_id", "_root").alias("root_message_id"))


def run(
    messages: DataFrame, groups: DataFrame, *, roots: DataFrame | None = None, classifiers: list[dict] | None = None, sequential: bool = False, mode: str = K.SETTINGS["publication_mode"],
    call: Call | Mapping[object, Call] | None = None, generate: Call | None = None, provider: dict | None = None, prompt: dict | None = None, fallback: bool = True,
    store: AnswerStore | None = None, away: str = "error",
) -> Outcome:
    """One pass over all open messages (of ``roots``, if given).

    call: the model of LLM classifiers, or one by provider. generate: the model of guides. provider: id and model of the active one, None if there is none.
    prompt: id and content of the guide prompt. fallback: whether guides are made locally without a provider. store, away: of ``calls.answered``.
    """
    classifiers = CLASSIFIERS if classifiers is None else classifiers
    times: dict[str, tuple[float, float]] = {}
    # Tables that are used again below are written once, so nothing upstream of them runs twice.
    first = timed(gated(messages, groups, roots), "gated", times)
    chain = timed(C.chains(messages, first.where("outcome is null")), "chains", times)
    judged = classify.classify(C.collected(messages, chain), classifiers, call, store=store, away=away)
    verdict = timed(judged.select(F.col("root_id").alias("id"), "chain", "verdict"), "verdicts", times)
    selected = verdict.where("verdict.selected is not null")
    length = len((prompt or {}).get("content") or "")

    def drafted(rows: DataFrame) -> DataFrame:
        if provider is not None and generate is not None:
            made = guides.generated(messages, chain, rows, generate, prompt=prompt, model=str(provider.get("model") or ""), store=store, away=away)
        elif provider is None and fallback:
            made = guides.local_guide(rows)
        else:
            made = rows.withColumn("guide", guides.no_guide("no active provider", F.lit("no active provider")))
        made = made.withColumn("cost", guides.estimate(F.col("chain"), length, F.col("guide.content"), F.col("guide.title")))
        return timed(made.select("id", "chain", "guide", "cost"), f"drafts-{len(parts)}", times)

    parts: list[DataFrame] = []
    if sequential:

        def settle(free: DataFrame) -> DataFrame:
            parts.append(drafted(selected.join(free, "id", "left_semi")))
            return parts[-1].where("guide.error is null").select("id")

        dated = selected.select("id").join(messages.select("id", "message_date"), "id")
        waiting = messages.where("processing_status = 'UNPROCESSED'").select("id")
        accepted_in_order(dated, chain.select("root_id", "id").join(waiting, "id", "left_semi"), settle)
    if not parts:
        parts.append(drafted(selected.where("false") if sequential else selected))
    drafts = reduce(DataFrame.unionByName, parts)
    good = drafts.where("guide.error is null").select("id")
    taken = cut(used_up(messages, chain, good) if sequential else first.select("id", F.col("id").alias("root_message_id")).where("false"), "taken")

    after = (
        first.select("id", "group_id", "outcome", "reason", "signal_score", "rule_passes", "rule_reason", "rule_checks", "skip_reason", "rule_result_json", "signal_breakdown")
        .join(verdict.select("id", "verdict", F.size("chain").alias("chain_size")), "id", "left").join(drafts.select("id", "guide", "cost"), "id", "left").join(taken, "id", "left")
    )
    names = F.array(*(F.lit(c.get("name") or c.get("type") or "") for c in classify.in_cost_order(classifiers))) if classifiers else F.array(F.lit(""))
    chosen = F.coalesce("verdict.selected", "verdict.best")
    said = F.concat(F.get(names, -chosen["neg"]), F.lit(": "), chosen["reasoning"])
    used = F.col("root_message_id").isNotNull()
    unless_used = lambda c: F.when(~used, F.col(c) if isinstance(c, str) else c)
    statuses = after.select(
        "id", F.when(used, F.lit("GUIDE_FOUND")).when(F.col("guide.error").isNotNull(), F.lit("ERROR")).when(F.col("guide").isNotNull(), F.lit("GUIDE_FOUND")).otherwise(F.lit("SKIPPED")).alias("outcome"),
        F.when(used, F.lit("used by an earlier guide")).otherwise(F.coalesce("reason", said, F.lit("no active classifiers"))).alias("reason"),
        unless_used("signal_score").alias("signal_score"), unless_used(chosen["score"]).alias("classifier_score"), unless_used("rule_result_json").alias("rule_result_json"), unless_used("signal_breakdown").alias("signal_breakdown"),
        F.coalesce("root_message_id", F.when(F.col("guide").isNotNull(), F.col("id"))).alias("guide_id"),
    )
    by_local = provider is None and fallback
    model, provider_id = LOCAL if by_local else (provider or {}).get("model"), (provider or {}).get("id")
    who = {"provider_id": F.lit(provider_id).cast("long"), "model": F.lit(model).cast("string"), "prompt_id": F.lit((prompt or {}).get("id")).cast("long")}
    ids = F.array(*(F.lit(c.get("id")).cast("long") for c in classify.in_cost_order(classifiers))) if classifiers else F.array(F.lit(None).cast("long"))
    made = drafts.join(verdict.select("id", F.get(ids, -F.col("verdict.selected.neg")).alias("classifier_id")), "id")
    failed = F.col("guide.error").isNotNull()
    status = F.when(failed, F.lit("FAILED")).when(guides.publishes(mode, F.col("guide.confidence")), F.lit("PUBLISHED")).otherwise(F.lit("DRAFT"))
    tokens = {"input_tokens": F.col("cost.input_tokens"), "output_tokens": F.col("cost.output_tokens"), "total_tokens": F.col("cost.input_tokens") + F.col("cost.output_tokens"), "estimated_cost_usd": F.round("cost.cost", 6)}
    as_columns = lambda d: [c.alias(n) for n, c in d.items()]
    drafted_rows = made.select(
        F.col("id").alias("root_message_id"), "guide.title", "guide.content", F.col("guide.markdown").alias("content_markdown"), "guide.confidence", "guide.tags", status.alias("status"), F.col("guide.error").alias("generation_error"),
        "classifier_id", *as_columns(who), *as_columns(tokens),
    )
    sources = made.select(F.col("id").alias("root_message_id"), F.explode("chain").alias("m")).select("root_message_id", F.col("m.id").alias("message_id"), F.lit(True).alias("used_in_prompt"))
    task = "PIPELINE_LOCAL_FALLBACK_GUIDE" if by_local else "PIPELINE_CLASSIFY_AND_GENERATE"
    usage = made.where(~failed).select(F.lit(task).alias("task_type"), F.col("id").alias("root_message_id"), *as_columns({k: v for k, v in who.items() if k != "prompt_id"}), *as_columns(tokens))
    rows = traces(after.where(~used), classify.in_cost_order(classifiers), who, by_local, times)
    return Outcome(statuses, drafted_rows, sources, usage, rows, taken)


#: Of which written tables a stage's times are.
STAGE_TABLES = {"RULES": ("gated",), "SIGNAL_SCORING": ("gated",), "CLASSIFICATION": ("chains", "verdicts"), "GUIDE_GENERATION": ("drafts",)}


def traces(after: DataFrame, classifiers: list[dict], who: dict[str, Column], local: bool, times: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A row for each stage, and each classifier that was asked, of a message: what went in, what came out, and what it cost.

    Ids are hashes, so that a second run gives the same. Times are those of the stage's tables over all messages: a stage has no time of
    its own for one message.
    """
    kinds = {
        "stage": "string", "attempt": "int", "status": "string", "input": "string", "output": "string", "error": "string", "classifier_id": "long", "prompt_id": "long", "provider_id": "long",
        "model": "string", "input_tokens": "long", "output_tokens": "long", "cost_usd": "double", "score": "double", "confidence": "double", "reason": "string",
    }
    row = lambda **c: F.struct(*(c.get(n, F.lit(0 if n in ("attempt", "input_tokens", "output_tokens", "cost_usd") else None)).cast(k).alias(n) for n, k in kinds.items()))
    cut_text = lambda c: X.truncate(c, TRACE_TEXT)
    of = lambda values, pos: F.get(F.array(*values), pos) if values else F.lit(None)
    at_rules = F.col("skip_reason").isNull()
    at_score = at_rules & F.col("rule_passes")
    at_class = at_score & F.col("outcome").isNull()
    checks = F.array_join(F.transform("rule_checks", lambda c: F.concat(c["name"], F.lit(":"), c["action"], F.lit(" ["), c["detail"], F.lit("]"))), "; ")
    score, least = F.col("signal_score"), F.lit(K.SIGNAL_THRESHOLD)
    high = score >= least
    number = lambda c: c.cast("string")
    rules_row = row(
        stage=F.lit("RULES"), status=F.when(F.col("rule_passes"), F.lit("PASSED")).otherwise(F.lit("REJECTED")), input=cut_text(F.when(F.size("rule_checks") > 0, checks).otherwise(F.lit("no checks"))),
        output=cut_text(F.col("rule_result_json")), score=F.col("rule_passes").cast("double"), reason=F.col("rule_reason"),
    )
    score_row = row(
        stage=F.lit("SIGNAL_SCORING"), status=F.when(high, F.lit("PASSED")).otherwise(F.lit("SKIPPED")), input=cut_text(F.col("signal_breakdown")), output=F.concat(F.lit("totalScore="), number(score), F.lit(" threshold="), number(least)),
        score=score, reason=F.concat(F.lit("Score "), number(score), F.when(high, F.lit(" above threshold ")).otherwise(F.lit(" below threshold ")), number(least)),
    )

    def asked(a: Column) -> Column:
        name, number_of = of([F.lit(c.get("name") or c["type"]) for c in classifiers], a["pos"]), of([F.lit(c.get("id")).cast("long") for c in classifiers], a["pos"])
        by = of([F.lit(c.get("provider_id")).cast("long") for c in classifiers], a["pos"])
        text = lambda c: F.coalesce(number(c), F.lit("null"))
        about = F.concat(F.lit("classifierType="), a["type"], F.lit(" | classifierId="), text(number_of), F.lit(" | classifierName="), name, F.lit(" | chainSize="), number(F.col("chain_size")), F.lit(" | providerId="), text(by))
        return row(
            stage=F.lit("CLASSIFICATION"), attempt=a["pos"], status=F.when(a["matched"] & (a["score"] >= K.CASCADE_THRESHOLD), F.lit("PASSED")).otherwise(F.lit("SKIPPED")), input=cut_text(about),
            output=cut_text(F.to_json(F.struct(a["score"], a["matched"], a["reasoning"]))), classifier_id=number_of, prompt_id=of([F.lit(c.get("prompt_id")).cast("long") for c in classifiers], a["pos"]), provider_id=by, score=a["score"],
            reason=F.concat(name, F.lit(": "), a["reasoning"]),
        )

    none = F.array(row(stage=F.lit("CLASSIFICATION"), status=F.lit("SKIPPED"), reason=F.lit("no active classifiers")))
    class_rows = F.transform("verdict.attempts", asked) if classifiers else none
    guide, error = F.col("guide"), F.col("guide.error")
    text = lambda c: F.coalesce(number(c), F.lit("null"))
    made_by = F.concat(F.lit("providerId="), F.coalesce(number(who["provider_id"]), F.lit("LOCAL_FALLBACK" if local else "null")), F.lit(" | model="), text(who["model"]), F.lit(" | promptId="), text(who["prompt_id"]), F.lit(" | chainSize="), number(F.col("chain_size")), F.lit(" | classifierScore="), number(F.col("verdict.selected.score")))
    guide_row = row(
        stage=F.lit("GUIDE_GENERATION"), status=F.when(error.isNotNull(), F.lit("FAILED")).otherwise(F.lit("COMPLETED")), input=cut_text(made_by), output=cut_text(F.to_json(guide)), error=cut_text(error),
        classifier_id=of([F.lit(c.get("id")).cast("long") for c in classifiers], -F.col("verdict.selected.neg")), input_tokens=F.col("cost.input_tokens"), output_tokens=F.col("cost.output_tokens"), cost_usd=F.round("cost.cost", 6),
        confidence=guide["confidence"], reason=F.concat(F.lit("LOCAL_FALLBACK | Title: " if local else "Title: "), guide["title"]), **who,
    )
    empty = F.filter(F.array(rules_row), lambda r: F.lit(False))
    when = lambda c, rows: F.when(c, rows).otherwise(empty)
    stages = F.concat(when(at_rules, F.array(rules_row)), when(at_score, F.array(score_row)), when(at_class, F.coalesce(class_rows, empty)), when(guide.isNotNull(), F.array(guide_row)))
    rows = after.select("id", "group_id", F.explode(stages).alias("s"))
    out = rows.select(F.sha2(F.concat_ws("|", "id", "s.stage", "s.attempt"), 256).alias("trace_id"), F.col("id").alias("message_id"), "group_id", *(f"s.{n}" for n in kinds))
    began, ended = F.lit(None).cast("double"), F.lit(None).cast("double")
    for stage, tables in STAGE_TABLES.items():
        own = [t for name, t in (times or {}).items() if name.partition("-")[0] in tables]
        if own:
            began = F.when(F.col("stage") == stage, F.lit(min(a for a, _ in own))).otherwise(began)
            ended = F.when(F.col("stage") == stage, F.lit(max(b for _, b in own))).otherwise(ended)
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return out.withColumns({"started_at": at(began), "finished_at": at(ended), "duration_ms": F.round((ended - began) * 1000).cast("long")})


def next_messages(messages: DataFrame, outcome: Outcome) -> DataFrame:
    """The snapshot of messages after a run: statuses, scores, reasons, rule results and the guide that each message led to or was used for.

    The id of a guide is that of its root, so a second run over the same messages gives the same. Other messages stay as they are.
    """
    names = ("outcome", "reason", "signal_score", "classifier_score", "rule_result_json", "signal_breakdown", "guide_id")
    s = outcome.statuses.select("id", *(F.col(c).alias(f"_{c}") for c in names))
    joined = messages.join(s, "id", "left")
    have = lambda c, kind: F.col(c) if c in messages.columns else F.lit(None).cast(kind)
    ran = F.col("_outcome").isNotNull()
    new = {
        "processing_status": F.coalesce("_outcome", "processing_status"), "guide_id": F.when(ran, F.col("_guide_id")).otherwise(have("guide_id", "long")),
        "signal_score": F.when(ran, F.col("_signal_score")).otherwise(have("signal_score", "double")), "classifier_score": F.when(ran, F.col("_classifier_score")).otherwise(have("classifier_score", "double")),
        "classifier_reason": F.when(ran, F.col("_reason")).otherwise(have("classifier_reason", "string")), "rule_result_json": F.when(ran, F.col("_rule_result_json")).otherwise(have("rule_result_json", "string")),
        "signal_breakdown": F.when(ran, F.col("_signal_breakdown")).otherwise(have("signal_breakdown", "string")),
    }
    return joined.withColumns(new).select(*messages.columns, *(c for c in new if c not in messages.columns))


def providers_after(providers: DataFrame, outcome: Outcome) -> DataFrame:
    """``providers`` as the last guide of each left it: ACTIVE, or ERROR with what went wrong. providers: id, status."""
    last = outcome.guides.where("provider_id is not null").groupBy("provider_id").agg(F.max_by(F.struct(F.col("generation_error").alias("e")), "root_message_id").alias("_last"))
    joined = providers.join(last, F.col("id") == F.col("provider_id"), "left").drop("provider_id")
    error = F.col("_last.e")
    status = F.when(F.col("_last").isNull(), F.col("status")).when(error.isNotNull(), F.lit("ERROR")).otherwise(F.lit("ACTIVE"))
    return joined.withColumns({"status": status, "last_error": X.truncate(error, 4000)}).drop("_last")


def simulated(texts: DataFrame, column: str) -> DataFrame:
    """The interface's dry run on a text, without its random part: a score from length, numbering and a keyword."""
    t = F.coalesce(F.col(column), F.lit(""))
    score = F.lit(0.3) + F.least(F.length(t) / 5000.0, F.lit(0.25)) + F.when(t.rlike(r"\d+\."), F.lit(0.30)).otherwise(F.lit(0.0)) + F.when(F.lower(t).rlike("guide|how to|гайд|инструкц"), F.lit(0.15)).otherwise(F.lit(0.0))
    return texts.withColumn("simulated_score", score).withColumn("simulated_pass", F.col("simulated_score") >= 0.6)
