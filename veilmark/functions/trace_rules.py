"""The rules of a valid trace over plain values, for the loops that work on one trace at a time. The same rules as
``operators.validate`` has over tables, under the same names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from typing import Any, NamedTuple

from veilmark.functions import json_values as J

ROLES, KINDS = ("system", "user", "assistant", "tool"), ("message", "tool_call", "tool_result")

# Arguments of the known tools (name, type, required).
TOOL_ARGUMENTS = {
    "search_documents": (("case_id", "string", True), ("query", "string", True), ("limit", "integer", False)),
    "read_section": (("case_id", "string", True), ("chunk_id", "string", True)),
    "compare_documents": (("case_id", "string", True), ("left_chunk_id", "string", True), ("right_chunk_id", "string", True)),
    "draft_memo": (("trace_id", "string", True), ("title", "string", True), ("body", "string", True), ("artifact_directory", "string", True)),
}

#: Says whether the arguments of a tool are in order; may also raise ``Rejected``.
ToolCheck = Callable[[dict], bool | None]


class Segment(NamedTuple):
    segment_id: str
    role: str
    kind: str
    payload: Any
    tool_name: str | None = None
    call_id: str | None = None


def arguments_fit(tool: str | None, arguments: dict) -> bool:
    """Arguments of a known tool must have its fields, of the right types; other tools take anything."""
    fields = TOOL_ARGUMENTS.get(tool)
    if fields is None:
        return True
    types = {name: kind for name, kind, _ in fields}
    if arguments.keys() - types.keys() or any(needed and name not in arguments for name, _, needed in fields):
        return False
    fine = {"string": lambda v: isinstance(v, str) and v.strip() != "", "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 1}
    return all(fine[types[name]](v) for name, v in arguments.items())


def _said(x: str | None) -> bool:
    return isinstance(x, str) and x.strip() != ""


def _own_rule(s: Segment, tools: Mapping[str, ToolCheck]) -> str | None:
    """The first rule that a segment breaks by itself."""
    field = {"message": "text", "tool_call": "arguments", "tool_result": "result"}.get(s.kind)
    if s.role not in ROLES or field is None:
        return "V3"
    if not isinstance(s.payload, dict):
        return "V4"
    only = s.payload.keys() == {field}
    if s.kind == "message":
        return None if only and isinstance(s.payload["text"], str) and s.role != "tool" and s.tool_name is None and s.call_id is None else "V5"
    rule = "V7" if s.kind == "tool_call" else "V9"
    if not (only and _said(s.tool_name) and _said(s.call_id)) or s.role != ("assistant" if s.kind == "tool_call" else "tool"):
        return rule
    if s.kind == "tool_call":
        if not isinstance(s.payload["arguments"], dict):
            return "V7"
        check = tools.get(s.tool_name)
        if not arguments_fit(s.tool_name, s.payload["arguments"]) or check is not None and check(dict(s.payload["arguments"])) is False:
            return "V8"
    return None


def trace_error(trace_id: str | None, segments: Sequence[Segment], original: Sequence[Segment] | None = None, tools: Mapping[str, ToolCheck] | None = None) -> str | None:
    """The first rule, by segment, that a trace breaks; V11 against the original it was made from."""
    if not _said(trace_id) or not segments:
        return "V1"
    seen, called, open_ = Counter(s.segment_id for s in segments), {}, set()
    for s in segments:
        if not _said(s.segment_id) or seen[s.segment_id] > 1:
            return "V2"
        if rule := _own_rule(s, tools or {}):
            return rule
        if s.kind == "message" and open_:
            return "V6"
        if s.kind == "tool_call":
            if s.call_id in called:
                return "V7"
            called[s.call_id] = s.tool_name
            open_.add(s.call_id)
        elif s.kind == "tool_result":
            if s.call_id not in open_ or called[s.call_id] != s.tool_name:
                return "V9"
            open_.remove(s.call_id)
    if open_:
        return "V10"
    if original is not None:
        envelope = [s._replace(payload=None) for s in segments] == [s._replace(payload=None) for s in original]
        if not envelope or any(J.shape_error(a.payload, b.payload, False) for a, b in zip(original, segments)):
            return "V11"
    return None
