"""Calls of a model from the tasks, with a store of answers, a time limit and errors by row.

An answer is stored by the hash of its prompt before it is used. A task that is run again, a second action or the next run
find it there and do not call again; only what was asked and not yet stored when an executor was lost is asked twice. Errors are not
stored, so a later run asks again. Equal prompts are asked once.

A call that raises is repeated prompt by prompt, so that one bad prompt does not spoil the others; its error becomes a column.
Where the model as a whole is away (time-outs, connections, ``Outage``) the caller chooses: an error of the row, or an exception
that fails the job, so that whoever runs it can wait and repeat.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.sources.feed import within
from confab.sources.storage import cut, shared_dir

#: Prompts to answers (None: no answer).
Call = Callable[[list[str]], list[str | None]]
#: Seconds that a call may take, and prompts of a call.
SECONDS, PROMPTS = 120.0, 16
FIELDS = "_key string, answer string, error string"


class Outage(Exception):
    """The model is away, whatever the prompt."""


AWAY = (Outage, TimeoutError, ConnectionError, OSError)


class AnswerStore(Protocol):
    """Where answers are kept; it goes to the tasks, so all executors must reach it."""

    def get(self, keys: list[str]) -> dict[str, str]: ...
    def put(self, key: str, answer: str) -> None: ...


class FileStore:
    """A file an answer in a folder that all executors share (any URI that Arrow's file systems know)."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def get(self, keys: list[str]) -> dict[str, str]:
        files, root = self._open()
        out = {}
        for key in keys:
            try:
                with files.open_input_stream(f"{root}/{key[:2]}/{key}") as f:
                    out[key] = f.read().decode()
            except FileNotFoundError:
                continue
        return out

    def put(self, key: str, answer: str) -> None:
        import uuid

        files, root = self._open()
        files.create_dir(f"{root}/{key[:2]}", recursive=True)
        draft = f"{root}/{key[:2]}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(answer.encode())
        files.move(draft, f"{root}/{key[:2]}/{key}")


def ask(call: Call, prompts: list[str], seconds: float, away: str) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt. away: ``error`` or ``raise``."""
    try:
        got = within(seconds, lambda: call(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return [(a, None if a is not None else "the model gave no answer") for a in got]
    except AWAY as error:
        if away == "raise":
            raise Outage(f"the model is away: {error}") from error
        return [(None, str(error) or type(error).__name__)] * len(prompts)
    except Exception as error:
        if len(prompts) == 1:
            return [(None, str(error) or type(error).__name__)]
        return [x for p in prompts for x in ask(call, [p], seconds, away)]


def answered(
    rows: DataFrame, prompt: str, call: Call, *, model: str = "", store: AnswerStore | None = None, seconds: float = SECONDS, prompts: int = PROMPTS, away: str = "error",
    answer: str = "answer", error: str = "error",
) -> DataFrame:
    """``rows`` with the model's answer to the text in ``prompt``, and why there is none. model: part of the key. store: a folder of the shared one if None."""
    spark = rows.sparkSession
    store = FileStore(f"{shared_dir(spark)}/answers") if store is None else store
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\x1f", F.lit(model), F.col(prompt)), 256))
    asked = keyed.where(F.col(prompt).isNotNull()).groupBy("_key").agg(F.first(prompt).alias("_prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), prompts):
                part = pdf.iloc[at : at + prompts]
                keys, texts = part["_key"].tolist(), part["_prompt"].tolist()
                known = store.get(keys)
                fresh = [i for i, k in enumerate(keys) if k not in known]
                errors: dict[str, str | None] = {}
                for i, (said, why) in zip(fresh, ask(call, [texts[i] for i in fresh], seconds, away) if fresh else [], strict=True):
                    errors[keys[i]] = why
                    if said is not None:
                        store.put(keys[i], said)
                        known[keys[i]] = said
                yield pd.DataFrame({"_key": keys, "answer": [known.get(k) for k in keys], "error": [errors.get(k) for k in keys]})

    # Written once, so that no later action calls again, whatever it reads.
    got = cut(asked.mapInPandas(run, FIELDS), "answers").withColumnsRenamed({"answer": answer, "error": error})
    return keyed.join(got, "_key", "left").drop("_key")


def timed(df: DataFrame, name: str, times: dict[str, tuple[float, float]]) -> DataFrame:
    """``df`` written and read back (``cut``); its begin and end, in seconds, go to ``times``."""
    began = time.time()
    out = cut(df, name)
    times[name] = (began, time.time())
    return out
