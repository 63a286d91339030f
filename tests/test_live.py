"""The pipeline's generator, traces and consumption, model calls, and the live processor, against plain versions."""

import datetime as dt
import json
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from confab.functions import text as X
from confab.operators import calls, chains, classify
from confab.plans import pipeline
from confab.sources.versions import Versions
from confab.streaming import ingest, processor

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
MESSAGE = "id long, telegram_message_id long, group_id long, sender_name string, sender_telegram_user_id long, is_bot boolean, text string, reply_to_message_id long, reply_count int, topic_id long, topic_name string, message_date timestamp_ntz, processing_status string"
GOOD, WEAK = "how to install the api prompt, step 1: see https://x.org", "just a longer remark about the weather today"


def message(i, text=GOOD, *, group=1, minute=None, status="UNPROCESSED", reply=None, topic=None, sender=None):
    return (i, i, group, f"Ann {i % 3}", sender or 5 + i % 3, False, text, reply, 0, topic, None, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if minute is None else minute), status)


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def groups_of(spark, *ids):
    return spark.createDataFrame([(i, True) for i in ids], "id long, enabled boolean")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def conversation(rng, n, groups=(1,)):
    """Messages at random times: some good, some weak, replies to earlier ones, all with topics of their own or shared."""
    rows, minute = [], 0
    for i in range(n):
        minute += rng.choice([0, 1, 2, 9, 30])
        group = rng.choice(groups)
        before = [r[0] for r in rows if r[2] == group]
        reply = rng.choice(before[-6:]) if before and rng.random() < 0.4 else None
        rows.append(message(i, rng.choice([GOOD, GOOD, WEAK, "ok"]), group=group, minute=minute, reply=reply, topic=rng.choice([None, 1, 2]), sender=rng.randint(1, 4), status=rng.choice(["UNPROCESSED"] * 4 + ["QUEUED"])))
    return rows


def drained(spark, rows, groups, failing=()):
    """The queue one by one: outcome and guide of every message. failing: roots whose guide fails."""
    m, alone = messages(spark, rows), pipeline.run(messages(spark, rows), groups)
    found = by_id(alone.statuses, "outcome")
    holds = {}
    for r in chains.chains(m).collect():
        holds.setdefault(r.root_id, set()).add(r.id)
    status = {r[0]: r[12] for r in rows}
    out = {}
    for r in sorted(rows, key=lambda r: (r[11], r[0])):
        i = r[0]
        if status[i] not in ("UNPROCESSED", "QUEUED"):
            continue
        status[i] = found[i][0]
        out[i] = (status[i], i if status[i] == "GUIDE_FOUND" else None)
        if status[i] == "GUIDE_FOUND" and i in failing:
            status[i], out[i] = "ERROR", ("ERROR", i)
        elif status[i] == "GUIDE_FOUND":
            for k in holds.get(i, ()):
                if status[k] == "UNPROCESSED":
                    status[k], out[k] = "GUIDE_FOUND", ("GUIDE_FOUND", i)
    return out


# ---- model calls


class Log:
    """Lines in a file, which tasks write and the test reads."""

    def __init__(self, path):
        self.path = str(path)

    def write(self, line):
        with open(self.path, "a") as f:
            f.write(line + "\n")

    def lines(self):
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return f.read().split("\n")[:-1]


def ask(spark, texts, call, tmp_path, **settings):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, prompt string").repartition(2)
    got = calls.answered(df, "prompt", call, store=calls.FileStore(f"file://{tmp_path}/answers"), **settings)
    return [(r.answer, r.error) for r in got.orderBy("id").collect()]


def test_answers_are_asked_for_once(spark, tmp_path):
    """A forced retry, a second action and a second run do not call again."""
    log = Log(tmp_path / "calls")

    def call(prompts):
        for p in prompts:
            log.write(p)
        return [p.upper() for p in prompts]

    texts = [f"prompt {i}" for i in range(30)] + ["prompt 0"] * 5 + [None]
    want = [(t and t.upper(), None) for t in texts]
    assert ask(spark, texts, call, tmp_path) == want and sorted(log.lines()) == sorted(set(texts[:30]))
    assert ask(spark, texts, call, tmp_path) == want and len(log.lines()) == 30
    assert ask(spark, texts[:1], call, tmp_path, model="another") == want[:1] and len(log.lines()) == 31


def test_a_retried_task_finds_its_answers(spark, tmp_path):
    log, flag = Log(tmp_path / "calls"), str(tmp_path / "failed")

    def call(prompts):
        log.write(prompts[0])
        if prompts[0] == "p3" and not os.path.exists(flag):
            open(flag, "w").close()
            raise calls.Outage("lost in the middle")
        return [p.upper() for p in prompts]

    run = lambda: ask(spark, [f"p{i}" for i in range(6)], call, tmp_path, prompts=1, away="raise")
    try:
        got = run()  # a task that is run again within the job
    except Exception:
        got = run()  # or the job as a whole, where tasks are not retried
    assert got == [(f"P{i}", None) for i in range(6)]
    assert sorted(log.lines()) == sorted([f"p{i}" for i in range(6)] + ["p3"])  # only what had failed was asked again


def test_errors_are_the_row_s_own(spark, tmp_path):
    def call(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("cannot read this")
        return [None if "silent" in p else p for p in prompts]

    assert ask(spark, ["a", "bad", "silent", "b"], call, tmp_path) == [("a", None), (None, "cannot read this"), (None, "the model gave no answer"), ("b", None)]

    def away(prompts):
        raise ConnectionError("refused")

    assert ask(spark, ["x", "y"], away, tmp_path) == [(None, "refused")] * 2
    with pytest.raises(Exception, match="the model is away"):
        ask(spark, ["x"], away, tmp_path, away="raise")

    def slow(prompts):
        import time

        time.sleep(3)
        return prompts

    assert "no answer in" in ask(spark, ["z"], slow, tmp_path, seconds=0.2)[0][1]
    assert ask(spark, [], away, tmp_path) == []


def test_provider_and_prompt_reach_the_call(spark, tmp_path):
    log = Log(tmp_path / "calls")

    def model(name):
        def call(prompts):
            for p in prompts:
                log.write(f"{name}|{p.splitlines()[0]}")
            return ['{"score": 0.8, "reasoning": "%s"}' % name] * len(prompts)

        return call

    kind = "array<struct<id:long,sender_name:string,text:string,is_bot:boolean,reply_count:int,topic_id:long>>"
    df = spark.createDataFrame([(1, [(1, "A", f"text of {tmp_path}", False, 0, None)])], f"root_id long, chain {kind}")
    llm = lambda i, provider: {"id": i, "type": "LLM", "provider_id": provider, "prompt": f"prompt {i}", "order": i}
    got = classify.classify(df, [llm(1, 9), llm(2, None), llm(3, 7)], {7: model("seven"), 8: model("eight")}).first().verdict
    assert [a.reasoning for a in got.attempts] == ["provider not found", "no provider", "seven"] and log.lines() == ["seven|prompt 3"]


# ---- generator, statuses, traces


def guide_answer(title="A guide", confidence=0.9):
    return json.dumps({"title": title, "content": "text", "contentMarkdown": "# text", "confidence": confidence, "tags": ["a", "b", "c"]})


def test_generator_makes_guides_once(spark, tmp_path):
    log = Log(tmp_path / "calls")

    def generate(prompts):
        for p in prompts:
            log.write(p.split("Main message: ")[1].split("\n")[0])
        return [guide_answer() if "Main message: 2\n" not in p else "no json" for p in prompts]

    rows = [message(i, minute=60 * i) for i in range(4)] + [message(9, "ok")]
    settings = dict(generate=generate, provider={"id": 4, "model": "m-1"}, prompt={"id": 6, "content": "Write in {{language}}."}, mode="AUTO_PUBLISH", store=calls.FileStore(f"file://{tmp_path}/answers"))
    out = pipeline.run(messages(spark, rows), groups_of(spark, 1), **settings)
    guides = {r.root_message_id: r for r in out.guides.collect()}
    assert sorted(guides) == [0, 1, 2, 3] and sorted(log.lines()) == ["0", "1", "2", "3"]
    assert (guides[0].title, guides[0].content_markdown, guides[0].status, guides[0].model, guides[0].provider_id, guides[0].prompt_id) == ("A guide", "# text", "PUBLISHED", "m-1", 4, 6)
    assert (guides[2].title, guides[2].content, guides[2].status) == ("no json", "no json", "DRAFT")
    # 18 characters of prompt (as it is configured), those of the chain; at least 200 tokens out
    assert guides[0].input_tokens == (len(GOOD) + len("Write in {{language}}.")) // 3 and guides[0].output_tokens == 200
    assert {(r.task_type, r.model) for r in out.usage.collect()} == {("PIPELINE_CLASSIFY_AND_GENERATE", "m-1")}
    pipeline.run(messages(spark, rows), groups_of(spark, 1), **settings).guides.count()
    assert len(log.lines()) == 4


def test_failed_guides_leave_errors(spark, tmp_path):
    def generate(prompts):
        raise ValueError("quota is used up")

    rows = [message(0), message(1, WEAK, minute=500)]
    m, groups = messages(spark, rows), groups_of(spark, 1)
    out = pipeline.run(m, groups, generate=generate, provider={"id": 4, "model": "m"}, sequential=True, store=calls.FileStore(f"file://{tmp_path}/answers"))
    assert by_id(out.statuses, "outcome", "guide_id") == {0: ("ERROR", 0), 1: ("SKIPPED", None)}
    g = out.guides.first()
    assert (g.status, g.confidence, g.generation_error, g.content) == ("FAILED", 0.0, "quota is used up", "quota is used up") and g.tags
    assert out.usage.count() == 0 and out.taken.count() == 0
    trace = out.traces.where("stage = 'GUIDE_GENERATION'").first()
    assert (trace.status, trace.error, trace.provider_id) == ("FAILED", "quota is used up", 4)
    providers = spark.createDataFrame([(4, "ACTIVE"), (5, "WARNING")], "id long, status string")
    assert by_id(pipeline.providers_after(providers, out), "status", "last_error") == {4: ("ERROR", "quota is used up"), 5: ("WARNING", None)}
    after = pipeline.next_messages(m, out)
    assert by_id(after, "processing_status", "guide_id") == {0: ("ERROR", 0), 1: ("SKIPPED", None)}
    nobody = pipeline.run(m, groups, fallback=False)
    assert nobody.guides.first().generation_error == "no active provider" and by_id(nobody.statuses, "outcome")[0] == ("ERROR",)


def test_traces_have_every_attempt(spark):
    rows = [message(0), message(1, WEAK, minute=500), message(2, "ok", minute=900)]
    classifiers = [{"id": 7, "name": "words", "type": "KEYWORD", "keywords": "nothing"}, {"id": 8, "name": "how", "type": "REGEX", "pattern": "how to"}, {"id": 9, "name": "late", "type": "LLM"}]
    out = pipeline.run(messages(spark, rows), groups_of(spark, 1), classifiers=classifiers)
    got = [(r.message_id, r.stage, r.attempt, r.status, r.classifier_id) for r in out.traces.collect()]
    assert sorted(got, key=str) == sorted([
        (0, "RULES", 0, "PASSED", None), (0, "SIGNAL_SCORING", 0, "PASSED", None), (0, "CLASSIFICATION", 0, "SKIPPED", 7), (0, "CLASSIFICATION", 1, "PASSED", 8), (0, "GUIDE_GENERATION", 0, "COMPLETED", 8),
        (1, "RULES", 0, "PASSED", None), (1, "SIGNAL_SCORING", 0, "SKIPPED", None),
    ], key=str)
    rows = {(r.message_id, r.stage, r.attempt): r for r in out.traces.collect()}
    r = rows[0, "CLASSIFICATION", 1]
    assert (r.reason, r.score, r.input) == ("how: pattern found", 1.0, "classifierType=REGEX | classifierId=8 | classifierName=how | chainSize=1 | providerId=null")
    assert json.loads(r.output) == {"score": 1.0, "matched": True, "reasoning": "pattern found"}
    r = rows[0, "GUIDE_GENERATION", 0]
    assert r.model == "local-fallback" and r.reason.startswith("LOCAL_FALLBACK | Title: how to install") and r.input_tokens == len(GOOD) // 3 and r.cost_usd == round((r.input_tokens + r.output_tokens) * 0.00002, 6)
    assert all(r.started_at <= r.finished_at and r.duration_ms >= 0 for r in rows.values())
    none = pipeline.run(messages(spark, [message(0)]), groups_of(spark, 1), classifiers=[])
    assert [(r.stage, r.status, r.reason) for r in none.traces.where("stage = 'CLASSIFICATION'").collect()] == [("CLASSIFICATION", "SKIPPED", "no active classifiers")]
    assert none.statuses.first().reason == "no active classifiers"


@pytest.mark.parametrize("seed", [1, 2])
def test_sequential_run_is_the_queue_drained(spark, seed):
    rows = conversation(random.Random(seed), 60, (1, 2))
    out = pipeline.run(messages(spark, rows), groups_of(spark, 1, 2), sequential=True)
    want = drained(spark, rows, groups_of(spark, 1, 2))
    assert by_id(out.statuses, "outcome", "guide_id") == want
    assert sum(g != i for i, (_, g) in want.items() if g is not None) > 3  # some are used up
    assert {r.message_id for r in out.traces.collect()} <= {i for i, (o, g) in want.items() if g in (None, i)}


def test_a_failed_guide_uses_up_nothing(spark, tmp_path):
    rows = conversation(random.Random(3), 40)
    groups = groups_of(spark, 1)
    want = drained(spark, rows, groups)
    failing = {g for g in list({g for i, (_, g) in want.items() if g is not None and g != i})[:2]}

    def generate(prompts):
        if any(f"Main message: {i}\n" in p for p in prompts for i in failing):
            raise ValueError("no")
        return [guide_answer()] * len(prompts)

    out = pipeline.run(messages(spark, rows), groups, sequential=True, generate=generate, provider={"id": 1, "model": "m"}, store=calls.FileStore(f"file://{tmp_path}/answers"))
    assert failing and by_id(out.statuses, "outcome", "guide_id") == drained(spark, rows, groups, failing)


# ---- the live processor


def stored(spark, table, rows):
    messages(spark, rows).withColumn("bucket", ingest.bucket(F.col("group_id"))).coalesce(1).write.mode("append").partitionBy("bucket").parquet(table)


def test_batches_leave_what_one_run_leaves(spark, tmp_path):
    rows, table, out = conversation(random.Random(5), 60), f"{tmp_path}/messages", f"{tmp_path}/results"
    groups, seen = groups_of(spark, 1), []
    for at in range(0, 60, 15):
        stored(spark, table, rows[at : at + 15])
    p = processor.Processor(spark, table, groups, out, f"{tmp_path}/checkpoint", files_per_batch=1, on_batch=seen.append)
    p.resume().awaitTermination()
    p.pause()
    assert seen == [0, 1, 2, 3]
    one = pipeline.run(messages(spark, rows), groups, sequential=True)
    got = processor.results(spark, out, "statuses")
    assert by_id(got, "outcome", "guide_id") == by_id(one.statuses, "outcome", "guide_id") and got.count() == 60
    key = lambda df: sorted((r.root_message_id, r.message_id) for r in df.collect())
    assert key(processor.results(spark, out, "sources")) == key(one.sources)
    table_of = processor.table_of(spark, out, "statuses")
    table_of.compact()
    assert table_of.read().count() == 60 and len(table_of.manifest(table_of.version())["parts"]) == 2


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    table = f"{tmp_path}/messages"
    stored(spark, table, conversation(random.Random(6), 40, tuple(range(1, 9))))
    schema = spark.read.parquet(table).schema
    b = spark.range(1).select(ingest.bucket(F.lit(3).cast("long"))).first()[0]
    read = processor.stored_messages(spark, table, schema, [b])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.group_id for r in read.select("group_id").distinct().collect()} == {g for g in range(1, 9) if spark.range(1).select(ingest.bucket(F.lit(g).cast("long"))).first()[0] == b}


def test_one_bad_message_is_isolated(spark, tmp_path):
    table, out, seen = f"{tmp_path}/messages", f"{tmp_path}/results", []
    groups = groups_of(spark, 1)
    stored(spark, table, [message(i) for i in range(6)])

    def run(messages, groups, roots):
        if roots.where("id = 4").head(1):
            raise ValueError("message 4 is broken")
        return processor.live_run(messages, groups, roots)

    p = processor.Processor(spark, table, groups, out, f"{tmp_path}/checkpoint", run=run, on_batch=seen.append)
    p.resume().awaitTermination()
    first = {r.id: r for r in processor.results(spark, out, "statuses").collect()}
    assert sorted(first) == list(range(6))
    # Message 0 uses up its neighbours of five minutes before their turn comes.
    assert all("error" not in r.reason for i, r in first.items() if i != 4) and seen == [0]
    assert first[4].outcome == "GUIDE_FOUND" or first[4].reason == "error: message 4 is broken"
    p.pause()
    stored(spark, table, [message(i, minute=1000 * i) for i in (6, 7)])
    p.resume().awaitTermination()
    everything = processor.results(spark, out, "statuses")
    assert sorted(r.id for r in everything.collect()) == list(range(8)) and seen == [0, 1]
    after = processor.state(spark.read.parquet(table), everything)
    assert after.where("processing_status = 'UNPROCESSED'").count() == 0 and after.count() == 8


def test_bad_messages_stand_alone(spark):
    rows = [message(i, minute=100 * i) for i in range(9)]

    def run(messages, groups, roots):
        bad = [r.id for r in roots.collect() if r.id in (2, 6)]
        if bad:
            raise ValueError(f"{bad[0]} is broken")
        return processor.live_run(messages, groups, roots)

    roots = spark.createDataFrame([(i,) for i in range(9)], "id long")
    parts = processor.isolated(messages(spark, rows), groups_of(spark, 1), roots, run)
    got = {}
    for p in parts:
        got |= by_id(p if not hasattr(p, "statuses") else p.statuses, "outcome", "reason")
    assert {i for i, (o, r) in got.items() if "broken" in r} == {2, 6} and {i for i, (o, _) in got.items() if o == "GUIDE_FOUND"} == set(range(9)) - {2, 6}


def test_an_outage_stops_the_query_and_skips_nothing(spark, tmp_path):
    table, out, flag = f"{tmp_path}/messages", f"{tmp_path}/results", str(tmp_path / "up")
    stored(spark, table, [message(i, f"{GOOD} number {i}", minute=100 * i) for i in range(4)])

    def call(prompts):
        if not os.path.exists(flag):
            raise ConnectionError("connection refused")
        if any("number 2" in p for p in prompts):
            raise ValueError("this prompt is refused")
        return ['{"score": 0.8, "reasoning": "fine"}'] * len(prompts)

    store = calls.FileStore(f"file://{tmp_path}/answers")
    p = processor.Processor(spark, table, groups_of(spark, 1), out, f"{tmp_path}/checkpoint", classifiers=[{"id": 1, "name": "model", "type": "LLM"}], call=call, store=store)
    with pytest.raises(Exception, match="away"):
        p.resume().awaitTermination()
    assert Versions(spark, f"{out}/statuses").version() == 0
    open(flag, "w").close()
    p.resume().awaitTermination()
    got = by_id(processor.results(spark, out, "statuses"), "outcome", "reason")
    assert {i: o for i, (o, _) in got.items()} == {0: "GUIDE_FOUND", 1: "GUIDE_FOUND", 2: "SKIPPED", 3: "GUIDE_FOUND"}
    assert got[2][1] == "model: this prompt is refused"


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table, out = f"{tmp_path}/messages", f"{tmp_path}/results"
    groups = groups_of(spark, 1)
    stored(spark, table, [message(i, minute=3 * i) for i in range(8)])
    batch = spark.read.parquet(table)
    processor.process(batch.where("id < 4"), 0, table, groups, out)
    processor.process(batch.where("id >= 4"), 1, table, groups, out)
    before = by_id(processor.results(spark, out, "statuses"), "outcome", "guide_id")
    processor.process(batch.where("id >= 4"), 1, table, groups, out)
    rows = processor.results(spark, out, "statuses")
    assert by_id(rows, "outcome", "guide_id") == before and rows.count() == 8


def test_ingested_chats_can_be_processed(spark, tmp_path):
    """From feed files to guides: what ingest stores is what the processor reads."""
    feed = tmp_path / "feed"
    feed.mkdir()
    row = dict(chat_id=-5, thread_id=0, topic_name=None, content_type="text", text=GOOD, sender_name="Ann", sender_id=3, is_bot=False, reply_to=0)
    (feed / "a.json").write_text("\n".join(json.dumps(row | {"id": i, "date": 1704067200 + 6000 * i}) for i in range(1, 4)))
    ingest.ingest(spark, str(feed), f"{tmp_path}/messages", f"{tmp_path}/c1").awaitTermination()
    groups = spark.createDataFrame([(-5, True)], "id long, enabled boolean")
    processor.Processor(spark, f"{tmp_path}/messages", groups, f"{tmp_path}/results", f"{tmp_path}/c2").resume().awaitTermination()
    assert processor.results(spark, f"{tmp_path}/results", "guides").count() == 3


# ---- text in UTF-16 units


def test_texts_are_cut_by_units(spark):
    plain = lambda t, n: t if len(t.encode("utf-16-le")) <= 2 * n else t.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "replace").replace("�", "?") + "..."
    texts = ["😀😀😀", "abc", "a😀b", "ab😀", "éàü long", "", "😀"]
    for n in (1, 2, 3, 4, 6):
        assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.truncate(F.col("t"), n)).collect()] == [plain(t, n) for t in texts]


def test_links_are_spliced_by_units(spark):
    cases = [
        ("😀 see docs", [(7, 4, "https://x.org")], "😀 see [docs](https://x.org)"), ("see 😀 docs", [(4, 2, "u"), (7, 4, "v")], "see [😀](u) [docs](v)"), ("docs 😀", [(0, 4, "u")], "[docs](u) 😀"),
        ("a😀b c", [(0, 4, "u")], "[a😀b](u) c"), ("abc", [(1, 100, "u")], "a[bc](u)"), ("abc", [(5, 1, "u")], "abc"), (None, [(0, 1, "u")], ""), ("http", [(0, 4, "http")], "http"), ("a😀b", [(2, 1, "u")], "a[😀](u)b"),
    ]
    df = spark.createDataFrame([(t, e) for t, e, _ in cases], "t string, e array<struct<offset:int,length:int,url:string>>")
    assert [r[0] for r in df.select(X.spliced_links(F.col("t"), F.col("e"))).collect()] == [w for *_, w in cases]
