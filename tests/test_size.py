"""Work is dealt by the size of the texts, and nothing is derived twice or sent to the driver."""

import pytest
from pyspark.sql import functions as F

from plantlens.operators import alarms, closure, compliance, declarations, packml
from plantlens.plans.project import Project
from plantlens.plans.store import Store
from plantlens.sources import virtual as v

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_declarations_are_dealt_by_bytes(spark):
    text = "FUNCTION_BLOCK A\nVAR\n\t// note\n\tn : INT; // own\n\ts : STRING := '//'; (* c *)\nEND_VAR\n"
    owner = spark.createDataFrame([("p", "pou", f"A{i}", text) for i in range(40)], "project_id string, owner_kind string, owner string, declaration string")
    found = declarations.variables(owner, task=2 * len(text))
    assert found.rdd.getNumPartitions() == 20 and found.count() == 80
    assert {(r.name, r.initial_value, r.comment, r.leading_comment) for r in found.collect()} == {("n", None, "own", "note"), ("s", "'//'", "c", None)}


def test_comments_of_owners_that_have_none(spark):
    lines = {"plain": "VAR\n\n\ta : INT;\nEND_VAR", "noted": "VAR\n\t(* x\n y *)\n\ta : INT;\n\tb : INT;\nEND_VAR"}
    owner = spark.createDataFrame([("p", "pou", k, x) for k, x in lines.items()], "project_id string, owner_kind string, owner string, declaration string")
    assert {(r.owner, r.name, r.leading_comment) for r in declarations.variables(owner).collect()} == {("plain", "a", None), ("noted", "a", "x\ny"), ("noted", "b", None)}


def _above(df, generator):
    """The part of the plan that works on the rows of a generator."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index(f"Generate {generator}")]


def test_a_whole_declaration_is_not_looked_at_by_line(spark):
    owner = spark.createDataFrame([("p", "pou", "A", "VAR\n\t// note\n\ta : INT;\nEND_VAR")], "project_id string, owner_kind string, owner string, declaration string")
    found = declarations.variables(owner, task=None)
    assert "declaration" not in _above(found, "posexplode(split(declaration") and found.first().leading_comment == "note"


@pytest.mark.parametrize("tiers,generator", [(alarms.severities, "posexplode"), (alarms.all_severities, "explode")])
def test_a_whole_block_is_not_looked_at_by_name(spark, tiers, generator):
    code = "_AlarmsPresentProcess := ALM_A.Latched\n\tOR ALM_B.Latched;\n_AlarmsPresentCritical := ALM_A.Latched OR ALM_C.Latched;\n"
    found = tiers(spark.createDataFrame([("p", "em", 0, code)], "project_id string, pou_lc string, body_ord int, code string"))
    assert "regexp_extract(block" not in _above(found, f"{generator}(regexp_extract_all(block")
    want = {("alm_a", "Process"), ("alm_b", "Process"), ("alm_c", "Critical")} | ({("alm_a", "Critical")} if tiers is alarms.all_severities else set())
    assert {(r.alarm_lc, r.severity) for r in found.collect()} == want


def test_tokens_of_a_statement_are_found_once(spark):
    df = spark.range(1).select(packml.written_moves(F.concat(F.lit("A: GotoState(B);"), F.col("id"))).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1 and df.first().m[0].to == "B"


@pytest.mark.parametrize("files", [v.parts, v.packaged, v.constructed, v.faulty, v.linked_parts])
def test_units_are_rendered_by_all_cores(spark, files):
    assert files(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_reach_sends_no_edges_to_the_driver(spark):
    row = lambda names, *rows: spark.createDataFrame(rows, names)
    step, seen = row("project_id string, name_lc string, to_lc string", ("p", "a", "b"), ("p", "a", "c")), row("project_id string, root_lc string, name_lc string", ("p", "a", "a"), ("p", "a", "c"))
    ahead = closure._ahead(seen.where("name_lc = 'a'"), step, seen)
    assert "Broadcast" not in _plan(ahead) and [tuple(r) for r in ahead.collect()] == [("p", "a", "b")]


def test_calls_write_no_inherited_variables(spark):
    p = Project(v.callers(spark, SF).union(v.parts(spark, SF)))
    assert p.calls.count() > 0 and "all_variables" not in p.__dict__


def test_levels_are_columns_before_they_are_rows(spark):
    p = Project(v.faulty(spark, SF))
    plan = p.unit_rules._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate inline") :].split("\n", 1)[0]
    assert "CASE WHEN" not in generate and p.unit_rules.count() == p.pous.count() * len(compliance.module_rules())


def test_a_store_parses_each_changed_file_once(spark, tmp_path, monkeypatch):
    parsed = []
    monkeypatch.setattr("plantlens.plans.store.file_variables", lambda *t, f=__import__("plantlens.plans.store", fromlist=["x"]).file_variables, **k: (parsed.append(["from_xml" in _plan(x).lower() or "xmltostructs" in _plan(x).lower() for x in t]) if "task" not in k else None, f(*t, **k))[1])
    Store(spark, str(tmp_path)).update(v.parts(spark, SF))
    assert parsed == [[False] * 3]


ODD = """FUNCTION_BLOCK A
	nBefore : INT;
var_input constant
	a : REFERENCE  TO FB_A;
	b, c : INT;
	sText : STRING(20) := 'x;y:z''';;
END_VAR *)
	nBetween : INT;
VAR
	p AT %I* : pointer to INT := 5 ;

	rows : Array [0..3] OF FB_R(n := (1 + 2));
	END_VARX : INT;
VAR_TEMP RETAIN
	t : ARRAYTYPE;
	empty : ;
VAR PERSISTENT
	last : INT"""


def test_owners_without_comments_are_read_without_a_sort(spark):
    text = {"odd": ODD, "none": "", "open": "VAR", "lists": "VAR\n\ta : INT;\nEND_VAR\nVAR\nEND_VAR\nVAR_OUTPUT\n\ta2 : BOOL;\nEND_VAR"}
    owner = lambda end: spark.createDataFrame([("p", "pou", k, x + end) for k, x in text.items()], "project_id string, owner_kind string, owner string, declaration string")
    plain, noted = owner(""), owner("\n// ends\n")  # a comment at the end belongs to no variable
    key = ["project_id", "owner_kind", "owner"]
    assert "Window" not in _plan(declarations._plain_lines(plain, key))
    found = {tuple(r) for r in declarations.variables(plain, task=None).collect()}
    assert len(found) == 9 and found == {tuple(r) for r in declarations.variables(noted, task=None).collect()}
