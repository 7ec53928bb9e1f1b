"""Registered queries of the subpackage against their SQL twins, and what all must keep to."""

import pathlib

import pytest

import __spark_entry__ as entry
import closebook.llm
from closebook.llm.queries import ORACLES, QUERIES
from tests.oracle import connect

ROOT = pathlib.Path(closebook.llm.__file__).parent


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, folder, name):
    rel = connect(folder).execute(ORACLES[name])
    columns = sorted(d[0] for d in rel.description)
    found = [d[0] for d in rel.description]
    want = sorted(tuple(r[found.index(c)] for c in columns) for r in rel.fetchall())
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.parent.rglob("*.py"):
        if ROOT not in path.parents:
            assert "closebook.llm" not in path.read_text(), path


def test_no_lineage_is_cut_locally():
    for path in [*ROOT.glob("*.py"), ROOT.parent.parent / "corpus_pipeline.py"]:
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", "tempfile", "groupByKey"):
            assert word not in text, (path, word)
