"""Groups of sets just below the threshold: what leaves the tasks follows their members, not
their pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.group import GroupedData

from plantlens.llm import ngram_join, setjoin
from tests.llm.test_operators import components


def cohort(n, linked=()):
    """Texts of one template with 7 own words each, of which any two texts have one place in
    common at most: 0.70 to 0.72 of their shingles are shared by any two. Those in linked
    differ from the text before them in one word."""
    out = []
    for i in range(n):
        words = [f"word{k}" for k in range(400)]
        for k in range(7):
            words[5 * (11 * k + (i // 11 * k + i) % 11) + 2] = f"own{i}at{k}"
        if i in linked:
            words = [*out[-1][:390], f"own{i}", *out[-1][391:]]
        out.append(words)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("chunk", [1 << 11, 32])
def test_pairs_below_the_threshold_do_not_leave_the_tasks(spark, monkeypatch, chunk):
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    rows, made, whole = cohort(100, linked=(7, 8, 31)), {}, GroupedData.applyInArrow

    def counted(self, func, schema):
        n = made.setdefault(schema, spark.sparkContext.accumulator(0))

        def run(group: pa.Table) -> pa.Table:
            out = func(group)
            n.add(out.num_rows)
            return out

        return whole(self, run, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    got = ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)
    assert sum(r.component_id != r.doc_id for r in got) == 3
    made = {schema: n.value for schema, n in made.items()}
    members = made["token long, key long, size int, leader long"]
    pairs = sum(n for schema, n in made.items() if schema.startswith("a long, b long"))
    assert pairs < 100 and sum(made.values()) < 2 * members, made


def test_only_links_that_join_components_leave_a_block(spark):
    """200 sets that all link with each other, each a component of its own, in one block."""
    mini = bytes(64)
    rows = [(1, k, 300, k, mini, k) for k in range(200)]
    members = spark.createDataFrame(rows, "token long, key long, size int, component long, mini binary, value long")

    def check(values, i, j):
        return np.ones(len(i), bool)

    got = setjoin.links_in_blocks(setjoin.in_chunks(members), 75, 100, check).collect()
    assert len(got) == 199
    # what can't be checked is left open, each pair of it
    members = members.selectExpr("token", "key", "size", "component", "mini", "if(key < 3, null, value) value")
    got = setjoin.links_in_blocks(setjoin.in_chunks(members), 75, 100, check).collect()
    assert sum(r.open for r in got) == 3 + 3 * 197 and sum(not r.open for r in got) == 196
