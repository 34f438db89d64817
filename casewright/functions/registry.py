"""Registration of functions and rules by contract, for use in SQL."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, SparkSession


@dataclass(frozen=True)
class Tool:
    """A registered function: its name, what it takes, and what runs it on columns."""

    name: str
    description: str
    run: Callable[..., Column]
    takes: tuple[str, ...] = ()
    effects: str = "none"


@dataclass
class Registry:
    """Tools by name; a call with unknown or missing arguments is an error text, never an exception."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", tool.name) or tool.name in self.tools:
            raise ValueError(f"bad or taken name: {tool.name}")
        self.tools[tool.name] = tool

    def call(self, name: str, **args: Any) -> Column | str:
        if name not in self.tools:
            return f"unknown tool: {name}"
        tool = self.tools[name]
        if faults := [f"missing {a}" for a in tool.takes if a not in args] + [f"unknown {a}" for a in args if a not in tool.takes]:
            return f"{name}: {', '.join(faults)}"
        try:
            return tool.run(**args)
        except Exception as e:  # noqa: BLE001 (the contract: a failed call is a text)
            return f"{name} failed: {e}"


def load_modules(folder: str) -> tuple[list[Tool], list[tuple[str, str]]]:
    """(tools, faults) of a folder of ``*.py`` files that each define ``TOOLS``; bad modules are reported and left out."""
    tools: list[Tool] = []
    faults: list[tuple[str, str]] = []
    for path in sorted(Path(folder).glob("*.py")):
        spec = importlib.util.spec_from_file_location(f"_plugin_{path.stem}", path)
        try:
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if not all(isinstance(t, Tool) for t in module.TOOLS):
                raise TypeError("TOOLS holds something else than tools")
            tools += module.TOOLS
        except Exception as e:  # noqa: BLE001
            faults.append((path.name, str(e)))
    return tools, faults


def rule_faults(rule: dict[str, Any]) -> list[str]:
    """What is wrong with a declared rule: fields, pattern, exit code."""
    out = [f"missing {k}" for k in ("id", "pattern", "classification") if not rule.get(k)]
    try:
        if len(rule.get("pattern") or "") > 1000:
            out.append("pattern is too long")
        re.compile(rule.get("pattern") or "")
    except re.error as e:
        out.append(f"bad pattern: {e}")
    code = rule.get("exit_code")
    if code is not None and (isinstance(code, bool) or not isinstance(code, int) or not 0 <= code <= 255):
        out.append("exit code beyond 0 to 255")
    return out


def schema_faults(value: Any, schema: dict[str, Any], at: str = "value") -> list[str]:
    """What a value breaks of a JSON schema (type, required, properties, items, enum); booleans are no numbers."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: no {kind}"]
    out = [f"{at}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in schema.get("properties", {}):
                out += schema_faults(v, schema["properties"][k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += schema_faults(v, schema["items"], f"{at}[{k}]")
    return out


def register_views(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """Temporary views over the Parquet tables of a folder, so that operators and SQL compose."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
