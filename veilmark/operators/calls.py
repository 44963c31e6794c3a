"""Calls of a model over a column: one client for each partition, made on the executor where it is used, each
distinct prompt of a batch asked once, and a bounded number of tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import json_values as J
from veilmark.operators.models import ModelError

#: A single-turn call: prompt in, text out. Made by a factory, so that it may hold what cannot be pickled.
Client = Callable[[str], str]


def answered(client: Client, prompt: str, check: Callable[[str], Any] | None = None, tries: int = 1) -> str:
    """The first answer that is text and passes the check. After ``tries`` of them a ``ModelError`` that says nothing of
    the prompt or the answers."""
    for _ in range(tries):
        try:
            out = client(prompt)
            if isinstance(out, str):
                if check is not None:
                    check(out)
                return out
        except (ModelError, J.Rejected, ValueError, OSError):
            continue
    raise ModelError(f"no valid answer in {tries}")


def exact_fields(keys: set[str], extra: bool = False) -> Callable[[str], dict]:
    """A check: the answer is a strict JSON object with just these fields (at least these, if ``extra``)."""
    return lambda text: J.exact_object(J.parse(text), keys, extra)


def asked(df: DataFrame, prompt: str, answer: str, factory: Callable[[], Client], check: Callable[[str], Any] | None = None, tries: int = 1, failed_as_null: bool = False) -> DataFrame:
    """``df`` with a column more. Null prompts are not asked. A call that fails ends the job, so that no failure is taken
    for an answer; or is null with ``failed_as_null``. Tasks may run twice, and so may calls."""
    # Arrow batches as they come; other columns pass through untouched.
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != answer), f"`{answer}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            client = client or factory()
            said: dict[str, str | None] = {}
            for p in pd.unique(pd.Series(batch["_prompt"].to_pylist(), dtype=object).dropna()):
                try:
                    said[p] = answered(client, p, check, tries)
                except ModelError:
                    if not failed_as_null:
                        raise
                    said[p] = None
            out = pa.array([said.get(p) for p in batch["_prompt"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*batch.schema.names[:-1], answer])

    return df.select(*(c for c in df.columns if c != answer), F.col(prompt).alias("_prompt")).mapInArrow(run, schema)
