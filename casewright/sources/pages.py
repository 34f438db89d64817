"""HTML pages as text and links, and code as facts; Arrow batches, standard library only."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters and links that a page keeps; what is beyond is flagged as cut (part of the record's format).
TEXT_CHARS, LINKS, LABEL_CHARS = 20_000, 50, 120
_SKIPPED = {"script", "style", "noscript", "template"}


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.in_title, self.anchor = base, 0, False, None
        self.title, self.text, self.links = "", [], []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.anchor = [urljoin(self.base, href), ""]
            self.links.append(self.anchor)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        said = data.strip()
        if self.in_title:
            self.title += said
        elif said and not self.skip:
            self.text.append(said)
            if self.anchor is not None and not self.anchor[1]:  # the first text after a link is its label
                self.anchor[1] = said


def page_facts(html: str | None, base: str | None) -> tuple[str, str, bool, list[dict[str, str]]]:
    """(title, visible text, whether it was cut, links with labels) of one page; null counts as an empty page."""
    p = _Page(base or "")
    p.feed(html or "")
    p.close()
    text = " ".join(" ".join(p.text).split())
    return " ".join(p.title.split()), text[:TEXT_CHARS], len(text) > TEXT_CHARS, [{"url": u, "text": t[:LABEL_CHARS]} for u, t in p.links[:LINKS]]


def extract_pages(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key``, ``title``, ``text``, ``truncated``, ``links`` of every page."""
    source = df.select(F.col(key).alias(key), F.col(url).alias("_u"), F.col(html).alias("_h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            facts = [page_facts(h, u) for h, u in zip(b["_h"], b["_u"])]
            yield pd.DataFrame({key: b[key], "title": [f[0] for f in facts], "text": [f[1] for f in facts], "truncated": [f[2] for f in facts], "links": [f[3] for f in facts]})

    return source.mapInPandas(run, f"`{key}` {source.schema[0].dataType.simpleString()}, title string, text string, truncated boolean, links array<struct<url: string, text: string>>")


# Forms of definitions and imports in scripts, and of definitions in other sources.
SCRIPT_FORMS = [
    ("function", re.compile(r"^\s*export\s+default\s+function\s+(\w+)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)")),
    ("class", re.compile(r"^\s*(?:export\s+)?class\s+(\w+)")),
    ("variable", re.compile(r"^\s*(?:export\s+)?const\s+(\w+)\s*=")),
    ("variable", re.compile(r"^\s*(?:export\s+)?let\s+(\w+)\s*=")),
    ("interface", re.compile(r"^\s*(?:export\s+)?interface\s+(\w+)")),
    ("type", re.compile(r"^\s*(?:export\s+)?type\s+(\w+)\s*=")),
]
SCRIPT_IMPORT = re.compile(r"""(?:import\s+.*?from\s+|require\(\s*)['"]([^'"]+)['"]""")
OTHER_FORM = re.compile(r"^\s*(?:pub\s+)?(?:def|function|class|interface|struct|func|fn)\s+(\w+)")
#: Language of a file by its suffix; any other suffix is read as text.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mjs": "javascript"}


def code_facts(path: str, text: str) -> list[tuple[str, str, str, int, str]]:
    """(fact, name, kind, line, detail) of a source text: definitions, references, imports and a diagnostic for broken syntax."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "text")
    out: list[tuple[str, str, str, int, str]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # the last two: nested too deep
            return [("diagnostic", path, "syntax", getattr(e, "lineno", 0) or 0, str(e))]
        owners = {id(c): n for n in ast.walk(tree) if isinstance(n, ast.ClassDef) for c in n.body}
        top = {id(c) for c in tree.body}
        for n in ast.walk(tree):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("definition", n.name, "method" if id(n) in owners else "function", n.lineno, language))
            elif isinstance(n, ast.ClassDef):
                out.append(("definition", n.name, "class", n.lineno, language))
            elif isinstance(n, ast.Assign | ast.AnnAssign) and id(n) in top:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        out.append(("definition", t.id, "variable", n.lineno, language))
            elif isinstance(n, ast.Import):
                out += [("import", a.name, "module", n.lineno, a.asname or "") for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.append(("import", "." * n.level + (n.module or ""), "module", n.lineno, ",".join(a.name for a in n.names)))
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                out.append(("reference", n.id, "name", n.lineno, language))
            elif isinstance(n, ast.Attribute):
                out.append(("reference", n.attr, "attribute", n.lineno, language))
        return out
    for k, line in enumerate(text.splitlines(), 1):
        defined = set()
        if language == "javascript":
            for kind, form in SCRIPT_FORMS:
                if m := form.match(line):
                    out.append(("definition", m.group(1), kind, k, language))
                    defined.add(m.group(1))
                    break
            if m := SCRIPT_IMPORT.search(line):
                out.append(("import", m.group(1), "module", k, ""))
        elif m := OTHER_FORM.match(line):
            out.append(("definition", m.group(1), "symbol", k, language))
            defined.add(m.group(1))
        out += [("reference", w, "word", k, language) for w in re.findall(r"[A-Za-z_]\w*", line) if w not in defined]
    return out


def extract_code(df: DataFrame, path: str, text: str) -> DataFrame:
    """``path``, ``fact``, ``name``, ``kind``, ``line``, ``detail`` of every source text; null texts give nothing."""
    source = df.select(F.col(path).alias("path"), F.col(text).alias("_t")).where("path IS NOT NULL AND _t IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *f) for p, t in zip(b["path"], b["_t"]) for f in code_facts(p, t)]
            yield pd.DataFrame(rows, columns=["path", "fact", "name", "kind", "line", "detail"])

    return source.mapInPandas(run, "path string, fact string, name string, kind string, line int, detail string")


def importers(facts: DataFrame, module: str) -> DataFrame:
    """Files that import a module, one inside it, or one that ends with it."""
    n = F.col("name")
    return facts.where((F.col("fact") == "import") & ((n == module) | n.endswith("." + module) | n.startswith(module + "."))).select("path", "name", "line").distinct()


def definitions(facts: DataFrame, name: str, exact: bool = True, kind: str | None = None) -> DataFrame:
    """Definitions by exact name or by part of it whatever the case."""
    hit = F.col("name") == name if exact else F.lower("name").contains(name.lower())
    return facts.where((F.col("fact") == "definition") & hit & (F.col("kind") == kind if kind else F.lit(True)))


def references(facts: DataFrame, name: str) -> DataFrame:
    """Places that use a name."""
    return facts.where((F.col("fact") == "reference") & (F.col("name") == name)).select("path", "line", "kind").distinct()
