"""Messages of chats: flattening, reduction, calls in their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.text import escape_roles, strip

# How an untrusted tool result is fenced.
FENCE = ("--- tool result (untrusted) ---", "--- end tool result ---")
LINES = r"\r\n|[\n\r]"


def simple_calls(text: Column) -> Column:
    """(name, query) of every ``[TOOL: name(query="...")]`` or ``(pattern="...")`` in a text, in order."""
    form = r"""(?i)\[TOOL:\s*(\w+)\s*\(\s*(?:query|pattern)\s*=\s*"([^"]*)"\s*\)\s*\]"""
    found = F.regexp_extract_all(text, F.lit(f"({form})"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, form, 1).alias("name"), F.regexp_extract(x, form, 2).alias("query")))


def flatten(messages: Column) -> Column:
    """One prompt of messages (``role``, ``content``): system texts first, then turns as ``role: content``, tool results fenced;
    lines of turns that look like a role are indented. No message gives the empty text."""
    system = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: F.coalesce(m["content"], F.lit("")))

    def turn(m: Column) -> Column:
        content = escape_roles(F.coalesce(m["content"], F.lit("")))
        fenced = F.concat(F.lit(FENCE[0] + "\n"), content, F.lit("\n" + FENCE[1]))
        return F.when(m["role"] == "tool", fenced).otherwise(F.concat(m["role"], F.lit(": "), content))

    return F.array_join(F.concat(system, F.transform(F.filter(messages, lambda m: m["role"] != "system"), turn)), "\n\n")


def _heads(lines: Column, width: int) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.substring(strip(x), 1, width)), " | ")


def command_summary(output: Column, head: int = 5, last: int = 10) -> Column:
    """What a command result in JSON comes to: exit code, first and last lines of its output, first lines of its errors;
    the first 600 characters of a text that is no such result."""
    code = F.get_json_object(output, "$.exit_code")
    timed = F.when(F.get_json_object(output, "$.timed_out") == "true", F.lit(" (timed out)")).otherwise(F.lit(""))
    split = lambda name: F.filter(F.split(F.coalesce(F.get_json_object(output, f"$.{name}"), F.lit("")), LINES), lambda x: F.length(x) > 0)
    out, err = split("stdout"), split("stderr")
    n = F.size(out)
    omitted = F.array(F.concat(F.lit("... ("), (n - head - last).cast("string"), F.lit(" lines omitted)")))
    shown = F.when(n > head + last, F.concat(F.slice(out, 1, head), omitted, F.slice(out, F.greatest(n - last + 1, F.lit(1)), last))).otherwise(out)
    parts = F.array(
        F.concat(F.lit("exit_code="), code, timed), F.when(n > 0, F.concat(F.lit("stdout: "), _heads(shown, 160))), F.when(F.size(err) > 0, F.concat(F.lit("stderr: "), _heads(F.slice(err, 1, 5), 160)))
    )
    return F.when(code.isNull(), F.substring(output, 1, 600)).otherwise(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"))


def reduce_message(content: Column, latest: Column, verbatim: int = 4000) -> Column:
    """A message as an older turn is kept: a command result by its summary, more than six lines by the first three, else its
    first 600 characters. The latest message stays whole up to ``verbatim`` characters, else says what it was reduced from."""
    lines = F.split(F.regexp_replace(content, r"[\r\n]$", ""), LINES)
    n = F.size(lines)
    long = F.concat(_heads(F.slice(lines, 1, 3), 120), F.lit(" ... ("), (n - 3).cast("string"), F.lit(" more lines)"))
    command = F.ltrim(content).startswith("{") & content.contains("exit_code")
    short = F.when(command, command_summary(content)).when(n > 6, long).otherwise(F.substring(content, 1, 600))
    told = F.concat(short, F.lit("\n(latest, reduced from "), F.length(content).cast("string"), F.lit(" chars)"))
    return F.when(latest & (F.length(content) <= verbatim), content).when(latest & (F.length(short) < F.length(content)), told).otherwise(short)


def failure_text(ok: Column, error: Column, output: Column) -> Column:
    """What a tool result says of its failure: error and output where it failed, errors and output of a command whose exit code
    isn't zero, else null."""
    both = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit("\n"), F.coalesce(b, F.lit("")))
    code = F.get_json_object(output, "$.exit_code")
    return F.when(~F.coalesce(ok, F.lit(False)), both(error, output)).when(code.isNotNull() & (code != "0"), both(F.get_json_object(output, "$.stderr"), F.get_json_object(output, "$.stdout")))


def unquote_path(path: Column) -> Column:
    r"""A C-quoted path as text: octal escapes of UTF-8 bytes, ``\"``, ``\\``, ``\t``, ``\n``; others as they are.

    Escapes become hexadecimal bytes, all other characters their UTF-8 bytes, and the whole is decoded at once."""
    body = F.regexp_extract(path, r'(?s)^"(.*)"$', 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(\\[0-7]{3}|\\.|[^\\])"), F.lit(1))
    named = F.create_map(*(F.lit(x) for pair in (("\\t", "09"), ("\\n", "0A"), ('\\"', "22"), ("\\\\", "5C")) for x in pair))
    octal = lambda p: F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")
    raw = F.transform(parts, lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), octal(p)).otherwise(F.coalesce(F.try_element_at(named, p), F.hex(F.to_binary(p, F.lit("utf-8"))))))
    return F.when(path.rlike(r'(?s)^".*"$'), F.make_valid_utf8(F.unhex(F.array_join(raw, "")).cast("string"))).otherwise(path)


def bounded(value: Column, limit: int = 200) -> Column:
    """The first ``limit`` characters of a value's text."""
    return F.substring(value, 1, limit)


def prompt(sections: list[tuple[str, Column]], limit: int = 6000) -> Column:
    """Headed sections one after the other, empty ones left out, cut to ``limit`` characters."""
    parts = [F.when(F.length(strip(c)) > 0, F.concat(F.lit(f"{name}:\n"), strip(c))) for name, c in sections]
    return F.substring(F.concat_ws("\n\n", *parts), 1, limit)


def grounded(answer: Column) -> tuple[Column, Column]:
    """(text, sources) of an answer in JSON: its text parts strung together; its sources (``uri``, ``title``), the first of each address."""
    parsed = F.from_json(answer, "parts ARRAY<STRUCT<text: STRING>>, sources ARRAY<STRUCT<uri: STRING, title: STRING>>")
    text = F.array_join(F.transform(F.coalesce(parsed["parts"], F.array()), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    named = F.filter(F.coalesce(parsed["sources"], F.array()), lambda s: F.length(s["uri"]) > 0)
    first = F.filter(named, lambda s, k: F.array_position(F.transform(named, lambda x: x["uri"]), s["uri"]) == k + 1)
    return text, first


def is_page(content_type: Column) -> Column:
    """Whether a content type is text that a page reader reads."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return kind.startswith("text/") | kind.contains("json") | kind.contains("xml") | kind.contains("+html")


def label_fault(label: Column) -> Column:
    """Why a label can't name a file, or null: empty, or with a slash, backslash, colon or only dots."""
    name = F.trim(F.coalesce(label, F.lit("")))
    return F.when(name == "", F.lit("empty")).when(name.rlike(r"[/\\:]"), F.lit("separator")).when(name.rlike(r"^\.+$"), F.lit("dots"))
