"""Hand-made cases: edges of scores and rules, classifiers, chains, changes, streaming."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from confab import config as K
from confab.functions import text as X
from confab.operators import chains, classify, guides, listing, mutations, rules, scoring
from confab.plans import pipeline
from confab.streaming import ingest

MESSAGE = "id long, telegram_message_id long, group_id long, reply_to_message_id long, topic_id long, message_date timestamp_ntz, sender_telegram_user_id long, is_bot boolean, text string, sender_name string, reply_count int"


def message(**kw):
    base = dict(id=1, telegram_message_id=101, group_id=1, reply_to_message_id=None, topic_id=None, message_date=dt.datetime(2026, 6, 10, 10), sender_telegram_user_id=900, is_bot=False, text="text", sender_name="Ann", reply_count=0)
    return tuple((base | kw).values())


def table(spark, *rows):
    return spark.createDataFrame([message(**r) for r in rows], MESSAGE)


def scores(spark, *rows):
    df = scoring.signal_score(table(spark, *(r | {"id": i} for i, r in enumerate(rows))), breakdown=True)
    return {r.id: r for r in df.collect()}


def test_signal_scores(spark):
    guide = "Гайд по настройке\n1. Открыть сайт https://example.com\n2. Взять ключ\n3. Запустить\nГотово"
    got = scores(spark, {"text": guide, "reply_count": 3}, {"text": "спасибо"}, {"text": "подскажите, где взять gpt аккаунт?"})
    assert got[0].signal_score > 0.45 and got[1].signal_score < 0.2 and got[2].signal_score >= 0.30


@pytest.mark.parametrize(
    "text, penalty",
    [(None, "emptyPenalty"), ("", "emptyPenalty"), (" \n ", "emptyPenalty"), ("\u2003", "shortPenalty"), ("  OK ", "ackPenalty"), ("abcdef?", None), ("abcdefg", "shortPenalty"), ("abcdefgh", None)],
)
def test_one_penalty_at_most(spark, text, penalty):
    b = scores(spark, {"text": text})[0].signal_breakdown
    assert [k for k in b if k.endswith("Penalty")] == ([penalty] if penalty else [])


def test_length_steps(spark):
    sizes = [31, 32, 119, 120, 249, 250, 499, 500]
    got = scores(spark, *({"text": "x" * n} for n in sizes))
    assert [got[i].signal_breakdown["length"] for i in range(len(sizes))] == [0.0, 0.04, 0.04, 0.08, 0.08, 0.12, 0.12, 0.16]


def test_utf16_length(spark):
    assert spark.range(1).select(X.utf16_length(F.lit("😀ab"))).first()[0] == 4


def rule(order, action, conditions, name=None):
    return rules.Rule(order, order, name or f"r{order}", action, conditions if isinstance(conditions, str) else json.dumps([{"type": k, "value": v} for k, v in conditions]))


@pytest.mark.parametrize("bad", ["[]", "{}", "not json", '[{"type":"NO_SUCH","value":"x"}]', '[{"type":"REGEX_MATCH","value":"("}]'])
def test_rules_that_never_match(spark, bad):
    r = rules.evaluate(table(spark, {}), [rule(1, "EXCLUDE", bad)]).first()
    assert r.rule_passes and not r.rule_checks[0].matched


def test_rule_order_and_reasons(spark):
    yes, no = [("LENGTH_GT", "abc")], [("LENGTH_LT", "1")]
    r = rules.evaluate(table(spark, {}), [rule(1, "EXCLUDE", yes), rule(2, "INCLUDE", yes)]).first()
    assert not r.rule_passes and len(r.rule_checks) == 1
    r = rules.evaluate(table(spark, {}), [rule(1, "INCLUDE", yes, "first"), rule(2, "INCLUDE", yes, "second"), rule(3, "EXCLUDE", no)]).first()
    assert r.rule_passes and len(r.rule_checks) == 3 and "second" in r.rule_reason
    assert rules.evaluate(table(spark, {}), []).first().rule_passes


def test_seed_rules_against_plain_evaluator(spark):
    texts = ["ок", "где взять ключ?", "gpt limits", "x" * 30, "длинный вопрос про то, как это вообще работает?", None, "how to install"]
    rows = [{"id": i, "text": t, "is_bot": b} for i, (t, b) in enumerate(itertools.product(texts, (False, True)))]
    got = {r.id: r for r in rules.evaluate(table(spark, *rows)).collect()}
    import re

    def holds(kind, value, m):
        t = m["text"] or ""
        if kind == "LENGTH_LT":
            return len(t) < int(value)
        if kind == "LENGTH_GT":
            return len(t) > int(value)
        if kind == "SENDER_IS_BOT":
            return m["is_bot"] == (value == "true")
        if kind == "KEYWORD_MATCH":
            return any(w.strip().lower() in t.lower() for w in re.split("[,;]", value))
        return re.search(re.sub(r"\\w\*\\b", r"[a-zA-Z0-9_]*\\b", value.replace("(?iu)", "")), t, re.I) is not None

    for m in rows:
        checks, passes = [], True
        for r in sorted(rules.seed_rules(), key=lambda r: r.order):
            hit = all(holds(k, v, m) for k, v in rules.conditions_of(r.conditions))
            checks.append(hit)
            if hit and r.action == "EXCLUDE":
                passes = False
                break
        assert (got[m["id"]].rule_passes, [c.matched for c in got[m["id"]].rule_checks]) == (passes, checks), m


def chain_of(spark, rows, root=None, **config):
    m = table(spark, *rows)
    roots = m if root is None else m.where(F.col("id") == root)
    out = {}
    for r in chains.chains(m, roots, K.CHAIN | config).orderBy("root_id", "position").collect():
        out.setdefault(r.root_id, []).append(r.id)
    return out


def at(minute, second=0):
    return dt.datetime(2026, 6, 10, 10, minute, second)


CONVERSATION = [
    dict(id=10, telegram_message_id=100, sender_telegram_user_id=901, message_date=at(0)), dict(id=11, telegram_message_id=101, reply_to_message_id=100, topic_id=55, message_date=at(2)),
    dict(id=12, telegram_message_id=102, reply_to_message_id=101, topic_id=55, sender_telegram_user_id=902, message_date=at(3)), dict(id=13, telegram_message_id=103, reply_to_message_id=102, topic_id=55, sender_telegram_user_id=903, message_date=at(4)),
    dict(id=14, telegram_message_id=104, topic_id=77, sender_telegram_user_id=904, message_date=at(3, 30)), dict(id=15, telegram_message_id=105, topic_id=88, message_date=at(1, 30)),
]


def test_chain_of_a_reply(spark):
    assert chain_of(spark, CONVERSATION, 11)[11] == [10, 15, 11, 12, 13]


def test_chain_keeps_the_oldest(spark):
    assert chain_of(spark, CONVERSATION, 11, max_messages=2)[11] == [10, 15]


def test_window_edges(spark):
    rows = [dict(id=1, telegram_message_id=1, message_date=at(10)), dict(id=2, telegram_message_id=2, message_date=at(5)), dict(id=3, telegram_message_id=3, message_date=at(5, 1)), dict(id=4, telegram_message_id=4, message_date=at(15)), dict(id=5, telegram_message_id=5, message_date=at(15, 1))]
    assert chain_of(spark, rows, 1)[1] == [3, 1, 4]


def test_cycles_end(spark):
    rows = [dict(id=1, telegram_message_id=1, reply_to_message_id=2), dict(id=2, telegram_message_id=2, reply_to_message_id=1)]
    assert chain_of(spark, rows) == {1: [1, 2], 2: [2, 1]} or chain_of(spark, rows) == {1: [1, 2], 2: [1, 2]}


def collected(spark, *texts, **kw):
    m = table(spark, *({"id": i, "telegram_message_id": i, "text": t, "message_date": at(i)} | kw for i, t in enumerate(texts)))
    chain = spark.createDataFrame([(0, i, i) for i in range(len(texts))], "root_id long, position int, id long")
    return chains.collected(m, chain)


@pytest.mark.parametrize("hits, score", [(0, 0.0), (1, 0.55), (2, 0.67), (3, 0.79), (5, 1.0)])
def test_keyword_scores(spark, hits, score):
    words = ["alpha", "bravo", "charlie", "delta", "echo"]
    r = classify.with_texts(collected(spark, " ".join(words[:hits]) or "zzz")).select(classify.keyword(F.col("_low"), ",".join(words)).alias("r")).first().r
    assert r.score == pytest.approx(score) and r.matched == (hits > 0)


def test_bad_classifier_settings(spark):
    df = classify.with_texts(collected(spark, "text"))
    df = classify.linear_model(classify.linear_model(df, "{", "b"), '{"features": []}', "c")
    r = df.select(classify.regex(spark, F.col("_text"), "(").alias("a"), "b", "c", classify.keyword(F.col("_low"), " ").alias("d")).first()
    assert all((x.score, x.matched) == (0.0, False) for x in r)


def test_cascade_order_and_stop(spark):
    made = lambda s, m: classify.result(F.lit(s), F.lit(m), F.lit(""))
    run = lambda *r: spark.range(1).select(classify.cascade(list(r)).alias("v")).first().v
    v = run(("KEYWORD", made(0.8, True)), ("REGEX", made(0.8, True)))
    assert v.evaluated == 2 and v.selected.neg == 0
    assert run(("KEYWORD", made(0.95, True)), ("REGEX", made(1.0, True))).evaluated == 1
    assert run(("LLM", made(0.76, True)), ("REGEX", made(1.0, True))).evaluated == 1
    v = run(("KEYWORD", made(0.74, True)), ("REGEX", made(0.9, False)))
    assert v.selected is None and v.best.score == 0.9


MOCK = [
    ("lol ok bro, nice hype", False),
    ("How to call the API:\n1. Install curl\n2. Run `curl https://api.example.com/v1`\n3. Check the tokens and the context window of the model", True),
    ("Use my referral bonus, subscribe: t.me/x and get a discount https://t.me/x", False),
    ("Release notes:\n- pricing update for the API\n- context window 200k tokens\n- benchmark results improved\nDetails: https://example.com/notes, run the new endpoint", True),
]


def test_mock_model(spark):
    rows = spark.createDataFrame([(i, "gpt guide 1. x `code`\nMessage chain to classify:\n" + t) for i, (t, _) in enumerate(MOCK)], "id long, prompt string")
    got = {r.id: r.mock.matched for r in classify.mock_llm(rows, "prompt").collect()}
    assert got == {i: m for i, (_, m) in enumerate(MOCK)}


def test_answers_are_read_leniently(spark):
    answers = ['```json\n{"score": 0.9, "matched": true, "reasoning": "r"}\n```', '{"score": 0.8}', "no json at all", '{"score": "x"}']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "id long, a string")
    got = [r.r for r in rows.select("id", classify.parse_answer(F.col("a")).alias("r")).orderBy("id").collect()]
    assert [(round(r.score, 2), r.matched) for r in got] == [(0.9, True), (0.8, True), (0.3, False), (0.0, False)]


def test_tags(spark):
    df = spark.createDataFrame([("Claude and Android API via Google Play Store today",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(guides.fallback_tags(F.col("s"), guides.compatible("s"))).collect()]
    assert got[0][:3] == ["Google Play", "Android", "API"] and "Claude" in got[0] and got[1] == got[2] == [K.DEFAULT_TAG]


def test_titles_and_fences(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.message_title(F.lit("intro\n# Title\nx"))) == "Title"
    assert one(X.message_title(F.lit("\n  first line"))) == "first line"
    assert one(X.fenced_json(F.lit("text {\"a\": 1} end"), braces=True)) == '{"a": 1}'
    assert one(X.fill_template("a {{x}} {{y}}", {"x": F.lit("1")})) == "a 1 {{y}}"
    assert one(X.spliced_links(F.lit("see docs now"), F.array(F.struct(F.lit(4).alias("offset"), F.lit(4).alias("length"), F.lit("http://d").alias("url"))))) == "see [docs](http://d) now"


def test_bounds():
    assert listing.bound("2024-01-02", end=True) == dt.datetime(2024, 1, 2, 23, 59, 59, 999999)
    assert listing.bound("2024-01-02T03:00:00Z", end=False) == dt.datetime(2024, 1, 2, 3)
    with pytest.raises(ValueError):
        listing.bound("soon", end=False)


def test_reorder_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, rule_order int")
    with pytest.raises(ValueError):
        mutations.reorder(rows, [9])
    assert [r.id for r in mutations.swap_neighbours(rows, 2, up=True).orderBy("rule_order", "id").collect()] == [2, 1, 3]


def greedy(order, holds, success):
    taken, done = set(), []
    for r in order:
        if r in success and r not in taken:
            done.append(r)
            taken |= set(holds.get(r, ()))
    return set(done)


def test_sequential_acceptance_matches_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    n = 60
    success = {i for i in range(n) if rng.random() < 0.7}
    holds = {i: {j for j in range(n) if abs(i - j) < 6 and rng.random() < 0.3} | {i} for i in success}
    dated = spark.createDataFrame([(i, at(0) + dt.timedelta(seconds=i)) for i in success], "id long, message_date timestamp_ntz")
    edges = spark.createDataFrame([(r, i) for r, s in holds.items() for i in s], "root_id long, id long")
    assert {r.id for r in pipeline.accepted_in_order(dated, edges).collect()} == greedy(range(n), holds, success)


def test_pipeline_outcome(spark):
    rows = [dict(r, text="how to install the gpt prompt, step 1 of the guide https://e.com") for r in CONVERSATION]
    m = table(spark, *rows).withColumns({"processing_status": F.lit("QUEUED"), "guide_id": F.lit(None).cast("long")})
    groups = spark.createDataFrame([(1, "g", True)], "id long, title string, enabled boolean")
    out = pipeline.run(m, groups, sequential=True)
    done = {r.id for r in out.statuses.where("outcome = 'GUIDE_FOUND'").collect()}
    assert done and {r.root_message_id for r in out.guides.collect()} == done
    assert {r.stage for r in out.traces.collect()} <= {"RULES", "SIGNAL_SCORING", "CLASSIFICATION", "GUIDE_GENERATION"}
    assert out.sources.count() >= len(done) and out.usage.count() == len(done)


def test_stream_ingest_is_idempotent(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    row = dict(id=1, chat_id=-5, thread_id=0, topic_name=None, content_type="photo", text=None, sender_name=None, sender_id=3, is_bot=False, reply_to=0, date=1700000000)
    (feed / "a.json").write_text("\n".join(json.dumps(row | {"id": i}) for i in (1, 1, 2)))
    go = lambda k: ingest.ingest(spark, str(feed), str(tmp_path / "out"), str(tmp_path / k), now=F.lit("2024-01-01").cast("timestamp_ntz")).awaitTermination()
    go("c1")
    (feed / "b.json").write_text("\n".join(json.dumps(row | {"id": i}) for i in (2, 3)))
    go("c1")
    go("c2")  # everything once more, from the start
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.telegram_message_id for r in got.collect()) == [1, 2, 3]
    r = got.first()
    assert (r.sender_name, r.text, r.reply_to_message_id) == ("Unknown", "[photo]", None)
    assert ingest.unknown_groups(got, spark.createDataFrame([(7,)], "telegram_chat_id long")).first().title == "Telegram chat -5"


def test_every_task_has_its_place(spark):
    tasks = spark.createDataFrame([(i, i * 7 % 5) for i in range(333)], "id long, priority int").repartition(7)
    got = {r.place: r.id for r in listing.placed(tasks, [F.desc("priority"), F.asc("id")]).collect()}
    assert got == {n + 1: i for n, i in enumerate(sorted(range(333), key=lambda i: (-(i * 7 % 5), i)))}


def stored_messages(spark, n):
    rows = [(i, i, 1, "Ann", 5 + i % 3, False, f"how to install the api prompt, step {i}: see https://x.org", None, 0, None, None, dt.datetime(2024, 1, 1, 0, i % 60), "UNPROCESSED") for i in range(n)]
    kind = "id long, telegram_message_id long, group_id long, sender_name string, sender_telegram_user_id long, is_bot boolean, text string, reply_to_message_id long, reply_count int, topic_id long, topic_name string, message_date timestamp_ntz, processing_status string"
    return spark.createDataFrame(rows, kind)


def test_next_snapshot_has_results_and_is_repeatable(spark):
    m = stored_messages(spark, 4).withColumn("processing_status", F.when(F.col("id") == 3, F.lit("CLEARED")).otherwise(F.lit("QUEUED")))
    groups = spark.createDataFrame([(1, True)], "id long, enabled boolean")
    after = pipeline.next_messages(m, pipeline.run(m, groups)).orderBy("id").collect()
    assert [r.processing_status for r in after][3] == "CLEARED" and after[3].rule_result_json is None
    assert all(json.loads(r.rule_result_json)["passed"] is True and "links" in json.loads(r.signal_breakdown) for r in after[:3])
    assert all((r.processing_status == "GUIDE_FOUND") == (r.guide_id is not None) for r in after)
    again = pipeline.next_messages(m, pipeline.run(m, groups)).orderBy("id").collect()
    assert after == again


def test_cascade_asks_a_model_only_where_it_is_open(spark):
    asked = spark.sparkContext.accumulator(0)

    def call(prompts):
        asked.add(len(prompts))
        return ['{"score": 0.8}'] * len(prompts)

    chain = "array<struct<id:long,sender_name:string,text:string,is_bot:boolean,reply_count:int,topic_id:long>>"
    rows = [(1, [(1, "A", "gpt claude opus sonnet llm", False, 0, None)]), (2, [(2, "A", "nothing here", False, 0, None)])]
    df = spark.createDataFrame(rows, f"root_id long, chain {chain}")
    got = {r.root_id: r.verdict for r in classify.classify(df, [{"type": "KEYWORD", "keywords": K.KEYWORDS}, {"type": "LLM"}], call=call).collect()}
    assert got[1].evaluated == 1 and got[1].selected.type == "KEYWORD" and got[2].evaluated == 2 and got[2].selected.type == "LLM" and asked.value == 1


def test_related_list_of_one_guide(spark):
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None), (5, None)], "id long, group_id long")
    got = listing.related_to(g, spark.createDataFrame([(1,), (4,), (1,)], "id long")).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (4, 5)]
