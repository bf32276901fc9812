"""Model calls as a replaceable step: rows in, annotated rows out, with a cache by id and version.

An annotator is a Python function from a list of texts to a list of JSON-like values; it runs in
batches inside tasks. Its results are a table, so that the engine works offline from results.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandgraph.functions.prompts import Prompt


class Miscounted(ValueError):
    """A call that didn't give one answer a text."""


def _answers(call: Callable[[list[str]], list], texts: list[str], retries: int, backoff: float, patience: float | None, runner: ThreadPoolExecutor | None) -> list[dict]:
    """One answer a text, after at most `retries` more tries, each after twice the wait of the one before.

    A call that takes longer than `patience` seconds counts as failed and isn't waited for. A wrong
    number of answers isn't tried again as it stands: nothing says which text an answer belongs to.
    """
    for left in range(retries, -1, -1):
        try:
            values = call(texts) if runner is None else runner.submit(call, texts).result(timeout=patience)
            if len(values) != len(texts):
                raise Miscounted(f"{len(values)} answers to {len(texts)} texts")
            return values
        except Miscounted:
            raise
        except Exception as error:
            if not left and isinstance(error, FutureTimeout) and patience is not None:
                raise TimeoutError(f"no answer in {patience} s") from error
            if not left:
                raise
            time.sleep(backoff * 2 ** (retries - left))
    raise AssertionError


def annotate(
    rows: DataFrame, call: Callable[[list[str]], list], schema: str, version: str, batch: int = 256, id_col: str = "id", text_col: str = "text",
    concurrent: int = 1, retries: int = 0, backoff: float = 0.5, patience: float | None = None,
) -> DataFrame:
    """(id, prompt_ver, ok, error, seconds, tokens, and the schema's columns).

    Answers are matched to texts by their place; a call that gives too few or too many of them counts as
    failed. A batch that fails is asked row by row; a row that fails has its error and nulls, and the
    others go on. A row without text isn't asked: it is a failure of its own. seconds is a row's share of
    its call's time; tokens is what the call reports under that name, else null.

    Each task has at most `concurrent` calls under way; all tasks together that times the cores. A failed
    call is tried `retries` more times with growing waits; `patience` is the longest wait for an answer.
    """
    names = [f.name for f in StructType.fromDDL(schema)]

    def one(texts: list[str], runner: ThreadPoolExecutor | None) -> list[tuple]:
        began = time.monotonic()
        try:
            values = _answers(call, texts, retries, backoff, patience, runner)
            share = (time.monotonic() - began) / len(texts)
            return [(True, None, share, v.get("tokens"), *[v.get(n) for n in names]) for v in values]
        except Exception as error:  # any failure of a foreign call is that row's result
            if len(texts) == 1:
                return [(False, str(error), time.monotonic() - began, None, *[None] * len(names))]
            return [x for t in texts for x in one([t], runner)]

    def told(piece: pd.DataFrame, runner: ThreadPoolExecutor | None) -> pd.DataFrame:
        texts = piece["text"].tolist()
        asked = [t for t in texts if t is not None]
        answers = iter(one(asked, runner) if asked else [])
        out = pd.DataFrame([next(answers) if t is not None else (False, "no text", 0.0, None, *[None] * len(names)) for t in texts], columns=["ok", "error", "seconds", "tokens", *names])
        out["tokens"] = out["tokens"].astype("Int64")
        out.insert(0, "id", piece["id"].to_numpy())
        out.insert(1, "prompt_ver", version)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # calls that outlast their patience keep their thread, so those that wait have threads of their own
        with ThreadPoolExecutor(concurrent) as pieces:
            runner = ThreadPoolExecutor() if patience is not None else None
            try:
                for part in batches:
                    cuts = [part.iloc[at : at + batch] for at in range(0, len(part), batch)]
                    yield from pieces.map(lambda piece: told(piece, runner), cuts) if concurrent > 1 else (told(piece, runner) for piece in cuts)
            finally:
                if runner is not None:
                    runner.shutdown(wait=False, cancel_futures=True)

    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {kind}, prompt_ver string, ok boolean, error string, seconds double, tokens long, {schema}")


def ask(rows: DataFrame, prompt: Prompt, *columns: Column, call: Callable | None = None, id_col: str = "id", parallel: int | None = None, **how: object) -> DataFrame:
    """Annotate rows by a prompt whose message is built from columns. parallel is the number of tasks that
    ask at a time; how is passed on to `annotate`."""
    asked = rows.select(F.col(id_col).alias("id"), prompt.message(*columns).alias("text"))
    return annotate(asked.repartition(parallel) if parallel else asked, call or prompt.offline, prompt.schema, prompt.version, **how)


def usage_log(annotated: DataFrame, stage: str) -> DataFrame:
    """(stage, tokens, seconds) of every call, for strandgraph.operators.workflow.usage_by_stage."""
    return annotated.where("error is null or error <> 'no text'").select(F.lit(stage).alias("stage"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "seconds")


def missing(rows: DataFrame, done: DataFrame, version: str, id_col: str = "id") -> DataFrame:
    """The rows that this version hasn't annotated yet."""
    have = done.where((F.col("prompt_ver") == version) & F.col("ok")).select(F.col("id").alias(id_col))
    return rows.join(have, id_col, "left_anti")


def fill(rows: DataFrame, done: DataFrame, prompt: Prompt, *columns: Column, id_col: str = "id", force: bool = False, **how: object) -> DataFrame:
    """Annotations of the rows that `done` has none of in the prompt's version, or of all with force.

    Rows that failed before are asked again; a failure is its row's own and the others go on.
    """
    todo = rows if force else missing(rows, done, prompt.version, id_col)
    return ask(todo, prompt, *columns, id_col=id_col, **how)


def hashed_embedding(texts: list[str], dim: int = 64) -> list[dict]:
    """An offline stand-in for an embedding model: hashed words, signed."""
    out = []
    for text in texts:
        vector = [0.0] * dim
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            vector[h % dim] += 1.0 if h >> 63 else -1.0
        out.append({"vector": vector})
    return out
