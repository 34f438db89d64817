"""Residue and text about residue."""

import pytest

from casewright.llm.residue import residue_values, tokens_of

RESIDUE = [
    "The failure in {{ test_name }} is caused by <fix>.", "__DIAGNOSIS__ broke because of {% fix %}; see [INSERT SUMMARY HERE] for details.", "{3}", "<TARGET>", "Fix #{goal} in [your owner]", "TBD (agent-a)", "to be filled in later ...", "Enter your target here",
    "Put the diagnosis (max. 200 characters)", "Lorem ipsum dolor sit amet, porta dolor officia ipsum", "asdf qwer zxcv", "yada yada yada", "xxxxxxx", "------", "sample copy - replace me", "404 | Not Found | Go back to the home page", "HTTP Status 502 – Bad Gateway. Request id 5b97bf13",
    "Erreur 500 : une erreur interne est survenue, veuillez réessayer plus tard.", "Please enable JavaScript for host.example", "NOTICE: TURN ON SCRIPTS AND RELOAD.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "<noscript>This page requires scripts. Activate them in your settings.</noscript>",
]
WRITTEN = [
    "The renderer printed {{ digest }} literally because flush_firelmel was called without the ranmarba context.", "A literal {0} reaches the report since load_corsallu formats the journal twice in tools/corpelmar/loader.rs.", "Test order dependency.", "Clock skew between two hosts.",
    "helnordro_ticket answers 404 Not Found for every unsigned loader after a clean checkout; the route table lost kazanvel.router.", "Return a proper 404 page from lorulfi_session instead of BrokenPipeError", "Expand ${kanorbri} in tests/marmelmi/shard.py before load_versorrel runs",
    "Show a notice in tamvelnor_fixture when JavaScript is disabled on arm boards", "The fixture of test_close holds lorem ipsum text of 393 entries, longer than flush_quisalfen allows.", "Write a summary of the session", "The TBD marker in src/a/queue.py is parsed as a date", "Behebe den Fehler in test_a, der nach dem Neustart auftritt",
]


def found(spark, values):
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(values)], "rec_key int, value string, coverage string")
    return {r["rec_key"] for r in residue_values(df, ["rec_key"], "value").collect()}


def test_residue_and_written(spark):
    values = [*RESIDUE, *WRITTEN, *WRITTEN]
    got = found(spark, values)
    assert [values[k] for k in sorted(set(range(len(RESIDUE))) - got)] == []
    assert [values[k] for k in sorted(got - set(range(len(RESIDUE))))] == []


def test_nulls_blank_long_repeated_and_empty(spark):
    long = "lorem ipsum dolor sit amet " * 20_000
    assert found(spark, [None, "", "  \n\t", long, long + "load_x_y fails " * 50_000, "TBD", "TBD"]) == {3, 5, 6}
    assert found(spark, []) == set()


def test_slots_of_any_length_and_many_exemplars(spark):
    """Neither the length of a slot nor the number of exemplars that a window is made of decides."""
    name = "the name of whoever looked at this last " * 12
    values = [f"Fix {{{{ {name} }}}} in <{name}>", f"[your {name}]", "The {{ a }} of {{ b }}", "untitled", "gizmo gizmo gizmo gizmo", "{{ " * 20_000, "[your " * 20_000 + "load_x fails"]
    assert found(spark, values) == set(range(7))  # the last but one is punctuation, the last one word again and again


@pytest.mark.parametrize("times", [1, 40])
def test_same_result_on_a_larger_table_of_the_same_mix(spark, times):
    """A frequent word that no exemplar holds weighs what its own frequency says, however large the table is."""
    notice = "Please enable JavaScript in your browser, gizmo"
    mix = [notice, *(f"The gizmo of load_{k} stops" for k in range(30)), *(f"Clock skew between {w} hosts" for w in "two three four five six".split())]
    assert found(spark, mix * times) == {k for k, v in enumerate(mix * times) if v == notice}


def test_counts_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr("casewright.llm.residue.COUNTED", 1)
    assert found(spark, [*RESIDUE, *WRITTEN, *WRITTEN]) == set(range(len(RESIDUE)))


@pytest.mark.parametrize(("text", "tokens"), [("Fix {{x}} in <name>", ["fix", "<slot>", "in", "<slot>"]), ("load_a at tests/b.py 12", ["<ident>", "at", "<ident>", "<num>"]), ("", []), ("页面", ["页", "面"])])
def test_tokens(text, tokens):
    assert tokens_of(text) == tokens
