"""Rules that look from a unit to others, on a hand-written project."""

import pytest

from plantlens.operators import compliance
from plantlens.plans.project import Project
from tests.test_project import unit


def method(name, decl):
    return f'<Method Name="{name}"><Declaration><![CDATA[{decl}]]></Declaration><Implementation><ST></ST></Implementation></Method>'


def holds(name, kind):
    return unit(name, f"FUNCTION_BLOCK {name}\nVAR\n\tfb : {kind};\nEND_VAR\n")


PARAMS = "METHOD {} : BOOL\nVAR_INPUT\n\ta : INT;\n\tb : {};\nEND_VAR\nVAR\n\tlocal : REAL;\nEND_VAR\n"


@pytest.fixture(scope="module")
def project(spark):
    base = "".join([method("Same", PARAMS.format("Same", "REAL")), method("Typed", PARAMS.format("Typed", "REAL")), method("Gives", "METHOD Gives : INT"), method("Must", "METHOD PUBLIC ABSTRACT Must")])
    child = "".join([method("same", PARAMS.format("same", "real").replace("local", "other")), method("Typed", PARAMS.format("Typed", "LREAL")), method("Own", "METHOD Own")])
    rows = [
        unit("Base", "FUNCTION_BLOCK ABSTRACT Base\n", methods=base),
        unit("Child", "FUNCTION_BLOCK Child EXTENDS Base\n", methods=child),
        unit("Good", "FUNCTION_BLOCK Good EXTENDS Base\n", methods=method("Must", "METHOD Must") + method("Same", PARAMS.format("Same", "REAL"))),
        unit("Returns", "FUNCTION_BLOCK Returns EXTENDS Base\n", methods=method("Gives", "METHOD Gives : DINT") + method("must", "METHOD must")),
        unit("Stranger", "FUNCTION_BLOCK Stranger EXTENDS Elsewhere\n"),
        holds("Wrong", "Base"), holds("Loop1", "Loop2"), holds("Loop2", "Loop1"),
        *[holds(f"D{i}", f"D{i + 1}") for i in range(1, 7)], unit("D7", "FUNCTION_BLOCK D7\nVAR\n\tn : INT;\nEND_VAR\n"),
        unit("I_Root", "INTERFACE I_Root\n", methods=method("Far", "METHOD Far")), unit("I_A", "INTERFACE I_A EXTENDS I_Root\n", methods=method("Go", "METHOD Go")), unit("I_B", "INTERFACE I_B EXTENDS I_Root\n"),
        unit("Two", "FUNCTION_BLOCK Two IMPLEMENTS I_A, I_B\n", methods=method("go", "METHOD go")), unit("Lacks", "FUNCTION_BLOCK Lacks IMPLEMENTS I_A, I_Unknown\n"),
    ]
    p, path, ext, text = rows[-1]
    rows[-1] = (p, path, ext, text + "\n")
    other = ("q", *unit("Child", "FUNCTION_BLOCK Child EXTENDS Base\n")[1:])  # its parent is in another project
    return Project(spark.createDataFrame([*rows, other], "project_id string, path string, ext string, content string"))


def test_levels(project):
    got = {(r.project_id, r.module, r.rule_id): r.level for r in project.rules.collect()}
    of = lambda rule: {m: x for (p, m, r), x in got.items() if p == "p" and r == rule and x not in "N"}
    assert of("oop.override_signature") == {"Child": "F", "Good": "P", "Returns": "F", "I_A": "P", "I_B": "P"}
    assert of("oop.abstract_contract") == {"Child": "F", "Good": "P", "Returns": "P"}
    bad = lambda rule: {m for m, x in of(rule).items() if x != "P"}
    assert bad("oop.abstract_instantiation") == {"Wrong"} and len(of("oop.abstract_instantiation")) == 20
    assert of("oop.diamond_inheritance") == {"Two": "W", "Lacks": "P"}
    assert of("oop.interface_contract") == {"Two": "P", "Lacks": "F"}
    assert bad("oop.composition_depth") == {"D1"}
    assert len(of("structure.file_ending")) == 20 and len(bad("structure.file_ending")) == 19 and of("structure.file_ending")["Lacks"] == "P"
    assert {got["q", "Child", r] for r in ("oop.override_signature", "oop.abstract_contract", "oop.interface_contract")} == {"N"}
    detail = {(r.module, r.rule_id): r.detail for r in project.rules.where("project_id = 'p'").collect()}
    assert detail["Child", "oop.override_signature"] == "1: Typed" and detail["Returns", "oop.override_signature"] == "1: Gives" and detail["Good", "oop.override_signature"] is None
    assert detail["Child", "oop.abstract_contract"] == "1: must" and detail["Lacks", "oop.interface_contract"] == "1: go" and detail["Two", "oop.diamond_inheritance"] == "1: i_root"
    assert detail["Wrong", "oop.abstract_instantiation"] == "1: fb" and detail["Two", "OOP-004"] == "I_A, I_B" and detail["D1", "oop.composition_depth"] is None
    per_unit = {}
    for p, m, _ in got:
        per_unit[p, m] = per_unit.get((p, m), 0) + 1
    assert set(per_unit.values()) == {45}


def test_project_rules(spark):
    g = "{12345678-1234-1234-1234-1234567890AB}"
    case = "CASE eState OF\nE_S.Idle:\n\teState := E_S.Run;\nEND_CASE\n"
    gvl = lambda p, kind: (p, "O.TcGVL", "tcgvl", f'<TcPlcObject><GVL Name="Objects"><Declaration><![CDATA[VAR_GLOBAL\n\tX : {kind};\nEND_VAR]]></Declaration></GVL></TcPlcObject>')
    of = lambda p, row: (p, *row[1:])
    machine = unit("M", "FUNCTION_BLOCK M\nVAR\n\tsm : DM_StateMachine('n', E_S.Idle);\nEND_VAR\n")
    cases = unit("C", f"FUNCTION_BLOCK C\nVAR\n\teState : E_S;\nEND_VAR\n// {g}", case)
    twin = unit("T", f"FUNCTION_BLOCK T\n// {g.lower()}")
    rows = [of("formal", machine), gvl("formal", "M"), of("formal", cases), of("unplaced", machine), of("unplaced", cases), of("unplaced", twin), gvl("unplaced", "C"), of("none", twin), gvl("none", "T")]
    got, detail = ({(r.project_id, r.rule_id): r[k] for r in Project(spark.createDataFrame(rows, "project_id string, path string, ext string, content string")).project_rules.collect()} for k in ("level", "detail"))
    assert {p: got[p, "GAMP-P04"] for p in ("formal", "unplaced", "none")} == {"formal": "P", "unplaced": "W", "none": "N"}
    assert {p: got[p, "xml.guid_uniqueness"] for p in ("formal", "unplaced", "none")} == {"formal": "P", "unplaced": "F", "none": "P"}
    assert detail["unplaced", "xml.guid_uniqueness"] == f"1: {g[1:-1].lower()} (c, t)" and detail["none", "xml.guid_uniqueness"] is None
    assert {p: detail[p, "GAMP-P04"] for p in ("formal", "unplaced", "none")} == {"formal": "1 declared, 1 by cases", "unplaced": "1 by cases", "none": None}


def test_names_of_a_whole_project_are_the_first_ones(spark):
    rows = spark.range(0, 3000, 1, 7).selectExpr("id % 2 AS g", "id AS o", "concat('n', id) AS name")
    got = {r.g: (r.n, r.names) for r in compliance.first_names(rows, ["g"], ["o"], "name", 3).collect()}
    assert got == {0: (1500, "n0, n2, n4"), 1: (1500, "n1, n3, n5")}
    assert compliance.first_names(rows.where("g > 1"), ["g"], ["o"], "name", 3).isEmpty()
    assert "WindowGroupLimit" in compliance.first_names(rows, ["g"], ["o"], "name", 3)._jdf.queryExecution().executedPlan().toString()


def test_empty_project(spark):
    p = Project(spark.createDataFrame([], "project_id string, path string, ext string, content string"))
    assert p.rules.isEmpty() and p.project_rules.isEmpty()
