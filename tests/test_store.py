"""The store by file: what it parses again, and that it holds what a fresh parse gives."""

import pytest
from pyspark.sql import functions as F

from plantlens.plans.project import Project
from plantlens.plans.store import Store
from tests.test_project import unit


def frame(spark, rows):
    return spark.createDataFrame(rows, "project_id string, path string, ext string, content string")


def fb(name, kind):
    return unit(name, f"FUNCTION_BLOCK {name}\nVAR\n\tx : {kind};\nEND_VAR\n")


GVL = ("p", "G.TcGVL", "tcgvl", '<TcPlcObject><GVL Name="G"><Declaration><![CDATA[VAR_GLOBAL\n\tx : A;\nEND_VAR]]></Declaration></GVL></TcPlcObject>')


def same(got, want):
    for name in Store.PARSERS:
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(a.columns) == sorted(b.columns)
        columns = [c for c in b.columns if not c.endswith("_xml")]
        assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect())), name


def parsed(spark, store, g):
    return sorted(r.path for r in spark.read.parquet(store._at("pous", g)).select("path").collect())


def test_only_changed_files_are_parsed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = frame(spark, [fb("A", "INT"), fb("B", "INT"), fb("C", "B"), GVL, ("q", *fb("A", "REAL")[1:])])
    same(store.update(first), Project(first))
    assert len(parsed(spark, store, 0)) == 4
    second = frame(spark, [fb("A", "DINT"), fb("C", "B"), fb("D", "A"), GVL, ("q", *fb("A", "REAL")[1:])])  # A of p changed, B went, D came
    same(store.update(second), Project(second))
    assert parsed(spark, store, 1) == [fb("A", "")[1], fb("D", "")[1]]
    same(store.update(second), Project(second))  # nothing changed
    assert store.generations() == [0, 1]
    gone = frame(spark, [fb("C", "B")])
    same(store.update(gone), Project(gone))
    assert parsed(spark, store, 2) == []
    same(store.update(second), Project(second))  # back again: parsed again


def test_an_update_that_was_stopped_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    first, second = frame(spark, [fb("A", "INT")]), frame(spark, [fb("A", "DINT"), fb("B", "A")])
    store.update(first)
    monkeypatch.setitem(Store.PARSERS, "duts", lambda files: files.select(F.raise_error(F.lit("stopped")).cast("string").alias("x")))
    with pytest.raises(Exception, match="stopped"):
        store.update(second)
    monkeypatch.undo()
    assert store.generations() == [0]
    same(store._project(first), Project(first))
    same(store.update(second), Project(second))


def test_generations_are_made_one_and_old_ones_go(spark, tmp_path):
    store = Store(spark, str(tmp_path), most=2)
    for n in range(3):
        files = frame(spark, [fb(f"A{k}", "INT") for k in range(n + 1)])
        got = store.update(files)
    same(got, Project(files))
    assert store.generations() == [0, 1, 2, 3] and {r.parsed for r in store.ledger().collect()} == {3} and len(parsed(spark, store, 3)) == 3
    store.prune(kept=1)
    assert store._numbers("pous") == store._numbers("ledger") == [3]
    same(store._project(files), Project(files))


def test_no_files(spark, tmp_path):
    store, none = Store(spark, str(tmp_path)), frame(spark, [])
    for _ in range(2):
        assert store.update(none).pous.isEmpty()
    null = frame(spark, [("p", "A.TcPOU", "tcpou", None), fb("B", "INT")])
    assert [r.name for r in store.update(null).pous.collect()] == ["B"]
    assert store.update(none).variables.isEmpty()
