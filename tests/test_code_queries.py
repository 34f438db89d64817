"""Documents read as text, Python and JavaScript by the registered queries."""

from casewright.queries import QUERIES

TEXTS = [
    (1, "import os\nfrom os.path import join\nX = 1\ndef load(a):\n    return join(a, X)\nload(X)\n"),
    (2, "import { load } from 'os'\nexport const reload = (x) => load(x)\n"),
    (3, "The reader was slow."),
    (4, "-" * 100_000 + "1"),
    (5, None),
]


def test_code_queries(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda name, *columns: {tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert {"definition", "reference"} == {f for (f,) in rows("code_facts", "fact")}
    python = rows("python_facts", "path", "fact", "name", "line")
    assert {("1.py", "import", "os", 1), ("1.py", "import", "os.path", 2), ("1.py", "definition", "load", 4), ("1.py", "definition", "X", 3), ("1.py", "reference", "load", 6)} <= python
    assert {p for p, f, _, _ in python if f == "diagnostic"} == {"2.py", "3.py", "4.py"}
    script = rows("script_facts", "path", "fact", "name", "line")
    assert {("2.js", "import", "os", 1), ("2.js", "definition", "reload", 2), ("2.js", "reference", "load", 2)} <= script
    assert rows("code_importers", "path", "line") == {("1.py", 1), ("1.py", 2), ("2.js", 1)}
    assert {("1.py", 6), ("1.js", 6), ("1.txt", 6), ("2.js", 2), ("2.txt", 2)} <= rows("code_references", "path", "line")
    assert {("1.py", "load"), ("1.txt", "load"), ("2.js", "reload")} == rows("code_definitions", "path", "name")
