"""Tool calls as text: ``[TOOL: name(key="value", other=1)]``."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = re.compile(r"\[TOOL:\s*([A-Za-z_]\w*)\s*(\(|\])")
_KEY = re.compile(r"\s*,?\s*([A-Za-z_]\w*)\s*=\s*")
_SCHEMA = "array<struct<name: string, args: map<string, string>>>"


def escape(value: Column) -> Column:
    """Backslash, quote, line feed and tab escaped."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def render_call(name: Column, args: Column, cap: int | None = None) -> Column:
    """A call of ``name`` with the string map ``args``, keys sorted; values that read as literals stay bare."""
    entries = F.array_sort(F.map_entries(args))
    cut = lambda v: F.substring(v, 1, cap) if cap else v
    bare = lambda v: v.rlike(r"^(?:true|false|null|-?\d+(?:\.\d+)?)$")
    one = lambda e: F.concat(e["key"], F.lit("="), F.when(bare(e["value"]), e["value"]).otherwise(F.concat(F.lit('"'), escape(cut(e["value"])), F.lit('"'))))
    return F.concat(F.lit("[TOOL: "), name, F.lit("("), F.array_join(F.transform(F.coalesce(entries, F.array()), one), ", "), F.lit(")]"))


def literal(text: str) -> Any:
    """A bare value: true, false, null, integer, float, else the text itself."""
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_calls(text: str | None) -> list[tuple[str, dict[str, Any]]]:
    """(name, typed arguments) of every well-formed call in a text; quotes and escapes are respected."""
    out: list[tuple[str, dict[str, Any]]] = []
    for m in _OPEN.finditer(text or ""):
        args: dict[str, Any] = {}
        at = m.end()
        if m.group(2) == "]":
            out.append((m.group(1), args))
            continue
        while k := _KEY.match(text, at):
            at = k.end()
            if at < len(text) and text[at] == '"':
                value, at = [], at + 1
                while at < len(text) and text[at] != '"':
                    if text[at] == "\\" and at + 1 < len(text):
                        at += 1
                        value.append({"n": "\n", "t": "\t", '"': '"', "\\": "\\"}.get(text[at], "\\" + text[at]))
                    else:
                        value.append(text[at])
                    at += 1
                at += 1
                args[k.group(1)] = "".join(value)
            else:
                end = at
                while end < len(text) and text[end] not in ",)":
                    end += 1
                args[k.group(1)] = literal(text[at:end].strip())
                at = end
        if re.compile(r"\s*\)\s*\]").match(text, at):
            out.append((m.group(1), args))
    return out


def calls_of(text: Column) -> Column:
    """``parse_calls`` over Arrow batches; values come back as strings, an empty list for null."""

    def show(v: Any) -> str | None:
        return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [{"name": n, "args": {k: show(v) for k, v in a.items()}} for n, a in parse_calls(t)])

    return F.pandas_udf(run, _SCHEMA)(text)
