"""Redaction of a stream of steps, with the detectors of the batch. Numbering depends on what a trace has shown
so far, so each trace keeps its aliases as state; steps of a trace are numbered in order of (step, text, start)
within a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilmark.functions.text import CATEGORY_PREFIX
from veilmark.operators.spans import standin, structured_spans

Span = tuple[int, int, str]
Detector = Callable[[str], list[Span]]
OUT = "trace_id string, step int, detail string"
STATE = "category array<string>, norm array<string>"


def resolved(*ranked: list[Span]) -> list[Span]:
    """Without overlaps: all of the first list before the next; in each, longer before shorter, then earlier."""
    kept: list[Span] = []
    for spans in ranked:
        for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                kept.append(s)
    return sorted(kept)


def _norm(value: str) -> str:
    return "".join(c for c in value.lower() if c.isascii() and c.isalnum()) or value.strip().lower()


def _prefix(category: str) -> str:
    return CATEGORY_PREFIX.get(category) or re.sub("[^A-Za-z0-9]+", "_", category.upper()).strip("_") or "PII"


def aliased(text: str | None, known: dict[tuple[str, str], int], count: dict[str, int], learned: Detector = standin) -> str | None:
    """The text with its trace's tokens; what is new to the trace is numbered and added to ``known`` and ``count``."""
    if text is None:
        return None
    done, at = [], 0
    for a, b, c in resolved(structured_spans(text), learned(text)):
        k = c, _norm(text[a:b])
        if k not in known:
            count[c] = known[k] = count.get(c, 0) + 1
        done += [text[at:a], f"[{_prefix(c)}_{known[k]}]"]
        at = b
    return "".join([*done, text[at:]])


def redacted(steps: DataFrame, learned: Detector = standin, idle_ms: int = 0) -> DataFrame:
    """``steps``: a stream of trace_id, step, detail. Append mode. A trace's aliases are kept for as long as the query
    runs, or until it has been silent for ``idle_ms`` (more than 0); if it speaks again, it is a new trace."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[tuple[str, str], int] = {}
        count: dict[str, int] = {}
        for c, n in zip(*(state.get if state.exists else ([], []))):
            count[c] = known[c, n] = count.get(c, 0) + 1
        before = len(known)
        rows = pd.concat(list(batches)).sort_values(["step", "detail"], na_position="first")
        out = [(key[0], step, aliased(text, known, count, learned)) for step, text in zip(rows["step"], rows["detail"])]
        if len(known) > before or not state.exists:
            state.update(([c for c, _ in known], [n for _, n in known]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["trace_id", "step", "detail"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return steps.select("trace_id", "step", "detail").groupBy("trace_id").applyInPandasWithState(each, OUT, STATE, "append", timeout)
