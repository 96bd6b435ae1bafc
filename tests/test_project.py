"""Declarations, closures and derived relations on hand-written sources."""

import pytest
from pyspark.sql import functions as F

from plantlens.operators import alarms, callgraph, closure, compliance, declarations, io, statemachines
from plantlens.plans import store
from plantlens.plans.project import Project
from plantlens.sources import files as source


def unit(name, decl, body="", methods=""):
    return ("p", f"{name}.TcPOU", "tcpou", f'<TcPlcObject><POU Name="{name}"><Declaration><![CDATA[{decl}]]></Declaration><Implementation><ST><![CDATA[{body}]]></ST></Implementation>{methods}</POU></TcPlcObject>')


def method(name, body):
    return f'<Method Name="{name}"><Declaration><![CDATA[METHOD PRIVATE {name} : BOOL]]></Declaration><Implementation><ST><![CDATA[{body}]]></ST></Implementation></Method>'


@pytest.fixture(scope="module")
def project(spark):
    case = "CASE eState OF\nE_S.Idle:\n\tIF __bGo THEN\n\t\teState := E_S.Run;\n\tEND_IF\nE_S.Run:\n\teState := E_S.Idle;\n\teState := E_S.Idle;\nEND_CASE\neState := E_S.Fault;\n"
    rows = [
        unit("CM_Base", "FUNCTION_BLOCK CM_Base\nVAR\n\t(* two\n\tlines *)\n\tnA : INT := 1; // first\n\tsText : STRING(80) := 'a // b'; (* note *)\n\tx, y : INT;\n\tALM_Hot : DM_TriggeredLatch;\nEND_VAR\n", methods=method("_Alarms", "_AlarmsPresentProcess := ALM_Hot.Latched;\nALM_Hot.Trigger := nA > 1;")),
        unit("CM_Child", "FUNCTION_BLOCK CM_Child EXTENDS CM_Base\nVAR_INPUT\n\tnA : INT := 2;\n\tbIn AT %I* : BOOL;\nEND_VAR\nVAR\n\taList : ARRAY[1..3] OF REAL;\n\trOther : REFERENCE TO CM_Base;\n\tfbX : FB_X('n', E_S.Idle);\nEND_VAR\n", body="Other(); SUPER^.Run(); fbX(); // fbX()\nfbX();", methods=method("_Alarms", "_AlarmsPresentCritical := ALM_Hot.Latched;\nALM_Hot.TriggerDelay_ms := 50;")),
        unit("FB_X", "FUNCTION_BLOCK FB_X\nVAR\n\teState : E_S;\nEND_VAR\n", body=case),
        unit("Loop_A", "FUNCTION_BLOCK Loop_A EXTENDS Loop_B\n"), unit("Loop_B", "FUNCTION_BLOCK Loop_B EXTENDS Loop_A\n"),
        ("p", "bad.TcPOU", "tcpou", "<TcPlcObject><POU Name="), ("p", "dtd.TcPOU", "tcpou", "<!DOCTYPE x><TcPlcObject><POU Name=\"Evil\"/></TcPlcObject>"),
        ("p", "E_S.TcDUT", "tcdut", '<TcPlcObject><DUT Name="E_S"><Declaration><![CDATA[TYPE E_S :\n(\n\tIdle := 0, // rest\n\tRun,\n\tFault := 9\n) INT;\nEND_TYPE]]></Declaration></DUT></TcPlcObject>'),
        ("p", "Objects.TcGVL", "tcgvl", '﻿<TcPlcObject><GVL Name="MyObjects"><Declaration><![CDATA[VAR_GLOBAL\n\tC1 : CM_Child;\nEND_VAR\nVAR_GLOBAL CONSTANT\n\tnMax : INT := 3;\nEND_VAR]]></Declaration></GVL></TcPlcObject>'),
    ]
    return Project(spark.createDataFrame(rows, "project_id string, path string, ext string, content string"))


def test_units_and_broken_files(project):
    got = {r.name: (r.pou_type, r.extends_type) for r in project.pous.collect()}
    assert got == {"CM_Base": ("FunctionBlock", None), "CM_Child": ("FunctionBlock", "CM_Base"), "FB_X": ("FunctionBlock", None), "Loop_A": ("FunctionBlock", "Loop_B"), "Loop_B": ("FunctionBlock", "Loop_A")}


def test_variables(project):
    v = {(r.owner, r.name): r for r in project.variables.collect()}
    assert v["CM_Base", "nA"].initial_value == "1" and v["CM_Base", "nA"].comment == "first" and "two" in v["CM_Base", "nA"].leading_comment
    assert v["CM_Base", "sText"].initial_value == "'a // b'" and v["CM_Base", "sText"].data_type == "STRING(80)"
    assert ("CM_Base", "x") not in v and ("CM_Base", "y") not in v
    child = v["CM_Child", "aList"]
    assert child.is_array and child.array_bounds == "1..3" and child.data_type == "REAL"
    assert v["CM_Child", "rOther"].is_reference and v["CM_Child", "fbX"].constructor_args == "'n', E_S.Idle" and v["CM_Child", "bIn"].at_binding == "%I*"
    assert v["MyObjects", "C1"].scope == "Global" and v["MyObjects", "nMax"].scope == "Constant"


def test_overlay_cycles_and_tree(project):
    over = {r.name: (r.initial_value, r.declared_in) for r in project.all_variables.where("pou_lc = 'cm_child'").collect()}
    assert over["nA"] == ("2", "cm_child") and over["sText"][1] == "cm_base"
    assert project.chains.where("cyclic").select("pou_lc").distinct().count() == 2
    assert {(r.path, r.is_reference) for r in project.tree.collect()} == {("C1", False), ("C1.rOther", True), ("C1.fbX", False)}


def test_alarm_precedence(project):
    got = {(r.pou, r.alarm): r for r in project.unit_alarms.collect()}
    assert got["CM_Child", "ALM_Hot"].severity == "Critical" and got["CM_Child", "ALM_Hot"].trigger == "nA > 1" and got["CM_Child", "ALM_Hot"].delay_ms == 50
    assert got["CM_Base", "ALM_Hot"].severity == "Process"
    placed = project.alarms.select("variable_path", "is_definition_only").collect()
    assert ("C1.ALM_Hot", False) in {tuple(r) for r in placed}


def struct(name, members):
    return ("p", f"{name}.TcDUT", "tcdut", f'<TcPlcObject><DUT Name="{name}"><Declaration><![CDATA[TYPE {name} :\nSTRUCT\n{members}END_STRUCT\nEND_TYPE]]></Declaration></DUT></TcPlcObject>')


def test_alarms_in_structs_deep_members_and_by_use(spark):
    latch = "DM_TriggeredLatch"
    nested = [struct(f"ST_{k}", f"\tALM_L{k} : {latch};\n\ts{k + 1} : ST_{k + 1};\n") for k in range(1, 7)]
    rows = [
        *nested, struct("ST_7", "\tn : INT;\n"), struct("ST_Devices", "\tdev : CM_Dev;\n"),
        unit("CM_Dev", f"FUNCTION_BLOCK CM_Dev\nVAR\n\tALM_Dev : {latch};\n\tsub : CM_Sub;\nEND_VAR\n"),
        unit("CM_Sub", f"FUNCTION_BLOCK CM_Sub\nVAR\n\tALM_Sub : {latch};\nEND_VAR\n", methods=method("_Alarms", "_AlarmsPresentAdvisory := ALM_Sub.Latched;")),
        unit("EM_A", f"FUNCTION_BLOCK EM_A\nVAR\n\tALM_Own : {latch};\n\ts1 : ST_1;\n\tdevices : ST_Devices;\n\trOther : REFERENCE TO CM_Dev;\n\tlib : FB_Library;\nEND_VAR\n",
             "lib.ALM_Lib.Trigger := bFirst;\nlib.ALM_Lib.Trigger := bLast;\nlib.ALM_Lib.TriggerDelay_ms := 70;\nx := lib.ALM_Held.Inhibit;\nx := s1.ALM_L1.Latched; // lib.ALM_Not.Latched", method("_Alarms", "_AlarmsPresentCritical := s1.ALM_L1.Latched OR lib.ALM_Lib.Latched;")),
        unit("EM_Unused", "FUNCTION_BLOCK EM_Unused\nVAR\n\ts6 : ST_6;\nEND_VAR\n"),
        ("p", "O.TcGVL", "tcgvl", '<TcPlcObject><GVL Name="MyObjects"><Declaration><![CDATA[VAR_GLOBAL\n\tA : EM_A;\nEND_VAR]]></Declaration></GVL></TcPlcObject>'),
    ]
    p = Project(spark.createDataFrame(rows, "project_id string, path string, ext string, content string"))
    found = p.placed_alarms.collect()
    got = {r.variable_path: r for r in found}
    inside = {"A.s1.ALM_L1", "A.s1.s2.ALM_L2", "A.s1.s2.s3.ALM_L3", "A.s1.s2.s3.s4.ALM_L4", "A.s1.s2.s3.s4.s5.ALM_L5"}  # five levels of structs
    deep = {"A.devices.dev.ALM_Dev", "A.devices.dev.sub.ALM_Sub", "A.rOther.ALM_Dev", "A.rOther.sub.ALM_Sub"}
    assert len(found) == len(got) and set(got) == {"A.ALM_Own", "A.lib.ALM_Lib", "A.lib.ALM_Held", "EM_Unused.s6.ALM_L6"} | inside | deep
    assert {k for k, r in got.items() if r.is_definition_only} == {"EM_Unused.s6.ALM_L6"}
    assert got["A.s1.ALM_L1"].severity == "Critical" and got["A.s1.ALM_L1"].pou == "EM_A" and got["A.devices.dev.ALM_Dev"].pou == "CM_Dev"
    assert got["A.rOther.sub.ALM_Sub"].severity == "Advisory" and (got["A.lib.ALM_Held"].severity, got["A.lib.ALM_Held"].reason) == ("Unresolved", "Missing")
    assert (got["A.lib.ALM_Lib"].severity, got["A.lib.ALM_Lib"].trigger, got["A.lib.ALM_Lib"].delay_ms, got["A.lib.ALM_Lib"].module_path) == ("Critical", "bLast", 70, "A.lib")
    counts = {r.path: r.n_alarms for r in alarms.subtree_counts(p.tree, p.placed_alarms).collect()}
    assert counts["A"] == 12 and counts["A.rOther"] == 2
    total = p.summary().first()
    assert total.n_alarms == 13 and total.n_critical == 2 and total.n_advisory == 2


def test_state_machine(project):
    assert {(r.from_state, r.to_state, r.guard) for r in project.transitions.collect()} == {("Idle", "Run", "bGo"), ("Run", "Idle", None)}
    assert {(r.state, r.value, r.has_branch, r.is_error) for r in project.states.collect()} == {("Idle", "0", True, False), ("Run", None, True, False), ("Fault", "9", False, True)}
    assert statemachines.primary(project.states).first().n == 3


def test_calls(spark, project, tmp_path):
    assert {(r.source, r.target, r.weight) for r in project.calls.collect()} == {("CM_Child", "CM_Base", 1), ("CM_Child", "FB_X", 2)}
    edge = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1)], "source string, target string, weight long")
    assert {r.name_lc for r in closure.reachable(edge, "A", str(tmp_path)).collect()} == {"a", "b", "c"}
    assert callgraph.from_root(edge, "a", str(tmp_path)).count() == 3
    many = spark.createDataFrame([("p", "a", "b", 1), ("p", "b", "a", 1), ("q", "A", "c", 1), ("q", "b", "d", 1)], "project_id string, source string, target string, weight long")
    assert {tuple(r) for r in closure.reachable(many, "a", str(tmp_path)).collect()} == {("p", "a"), ("p", "b"), ("q", "a"), ("q", "c")}
    assert {tuple(r)[:3] for r in callgraph.from_root(many, "a", str(tmp_path)).select("project_id", "source", "target").collect()} == {("p", "a", "b"), ("p", "b", "a"), ("q", "A", "c")}
    roots = spark.createDataFrame([("p", "B"), ("q", "b"), ("q", "x")], "project_id string, root string")
    assert {tuple(r) for r in closure.reached(many, roots, str(tmp_path)).collect()} == {("p", "b", "b"), ("p", "b", "a"), ("q", "b", "b"), ("q", "b", "d"), ("q", "x", "x")}
    assert callgraph.mermaid(edge, 2).where("seq = 2").count() == 2


def test_rules(project):
    got = {(r.module, r.rule_id): r.level for r in project.rules.collect()}
    assert got["Loop_A", "oop.extends_cycle"] == "F" and got["CM_Child", "oop.extends_cycle"] == "P" and got["CM_Base", "oop.extends_cycle"] == "N"
    assert got["CM_Child", "OOP-003"] == "P" and got["CM_Base", "ISA-001"] == "P" and got["FB_X", "ISA-001"] == "W"
    scored = compliance.scores(project.rules, "module")
    assert scored.where("score < 0 or score > 1").count() == 0 and compliance.overall(scored, "module").count() == 5


def test_guids_and_overrides(spark, project):
    g = "{12345678-1234-1234-1234-1234567890AB}"
    pou = spark.createDataFrame([("p", "a", g, ""), ("p", "b", "", g.lower()), ("p", "c", "{0}", "")], "project_id string, name_lc string, declaration string, implementation string")
    assert compliance.guid_uniqueness(pou).first().n_units == 2
    over = spark.createDataFrame([("alm_hot", "cm_child", " own ", None), ("ALM_Hot", None, "any", "call")], "alarm string, owner string, description string, action string")
    got = {r.pou: (r.description, r.action) for r in alarms.overridden(alarms.described(project.unit_alarms), over).collect()}
    assert got["CM_Child"] == ("own", "call") and got["CM_Base"] == ("any", "call")


def test_reading_folders(spark, tmp_path):
    (tmp_path / "src" / "bin").mkdir(parents=True)
    (tmp_path / "src" / "A.TcPOU").write_text(unit("A", "PROGRAM A\n")[3])
    (tmp_path / "src" / "bin" / "B.TcPOU").write_text(unit("B", "PROGRAM B\n")[3])
    p = Project.read(spark, str(tmp_path))
    assert [r.name for r in p.pous.collect()] == ["A"] and p.pous.first().pou_type == "Program"
    first = source.fingerprint(p.files).first()
    assert first.n_files == 1 and len(first.fingerprint) == 64
    assert store.get_or_build(p, str(tmp_path / "store"), "variables").count() == 0
    with pytest.raises(source.BlankPath):
        Project.read(spark, " ")
    with pytest.raises(source.MissingFolder):
        Project.read(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(source.NoSources):
        Project.read(spark, str(tmp_path / "empty"))


def test_streamed_sources(spark, tmp_path):
    from plantlens.streaming import watch

    (tmp_path / "in" / "one").mkdir(parents=True)
    (tmp_path / "in" / "one" / "A.TcPOU").write_text(unit("A", "PROGRAM A\n")[3])
    watch.units(watch.sources(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("project_id", "name").collect()] == [("one", "A")]


def test_enum_members(project):
    assert [(r.name, r.value, r.comment) for r in project.enum_values.orderBy("ord").collect()] == [("Idle", "0", "rest"), ("Run", None, None), ("Fault", "9", None)]
    assert declarations.actions(project.pous).count() == 0 and project.coverage().where(F.col("kind") == "method").first().captured == 2


def test_boxes_at_any_depth_and_their_links(spark):
    box = lambda name, sku, inner="": f'<Box Id="1"><Name>{name}</Name><EtherCAT Type="{sku}"><Pdo Name="Ch {name}" InOut="0"><Entry Name="In &amp; out" Index="#x6000"><Type>BOOL</Type></Entry></Pdo></EtherCAT>{inner}<Tail/></Box>'
    link = lambda a, b: f'<Link VarA="{a}" VarB="{b}"/>'
    deep = f'<Root><Device><Box/>{box("A", "EK1100", box("B", "EL1008", box("C", "EL1904")) + box("D", "EL2008"))}</Device>{box("E", "EL9011")}<Mappings><OwnerB>{link("B^Ch B^In &amp; out", "PlcTask Inputs^CM_X.bIn")}{link("c^Ch C^In &amp; out", "a^b")}{link("Ch D^In &amp; out", "PlcTask^nobody")}{link("D^Ch D", "PlcTask^whole")}</OwnerB></Mappings></Root>'
    alone = f'<Root>{box("__FILENAME__", "EL3001")}<Mappings>{link("Ch __FILENAME__^In &amp; out", "PlcTask Outputs^x")}{link("B^Ch B^In &amp; out", "PlcTask^first")}</Mappings></Root>'
    late = f'<Root><OwnerA>{link("B^Ch B^In &amp; out", "PlcTask^last")}</OwnerA><OwnerA>{link("Z^Ch^s", "y")}{link("B", "y")}</OwnerA></Root>'
    files = spark.createDataFrame([("p", "h/deep.xti", "xti", deep), ("p", "h/Alone.xti", "xti", alone), ("p", "p.tsproj", "tsproj", late), ("q", "h/none.xti", "xti", "<Root/>"), ("q", "h/bad.xti", "xti", "</Box><Box><Name>open")], "project_id string, path string, ext string, content string")
    p = Project(files)
    got = {r.box: (r.parent, r.level, r.sku, r.is_coupler, r.is_safety) for r in p.all_boxes.where("project_id = 'p' and box <> 'deep'").collect()}
    assert got == {"A": (None, 1, "EK1100", True, False), "B": ("A", 2, "EL1008", False, False), "C": ("B", 3, "EL1904", False, True), "D": ("A", 2, "EL2008", False, False), "E": (None, 1, "EL9011", False, False), "Alone": (None, 1, "EL3001", False, False)}
    links = {(r.box, r.channel, r.signal): r.symbol for r in io.links(files, p.all_boxes).collect()}
    assert links == {("B", "Ch B", "In & out"): "last", ("C", "Ch C", "In & out"): "a.b", ("Alone", "Ch __FILENAME__", "In & out"): "x"}
    assert {r.channel for r in p.channels.collect()} == {f"Ch {x}" for x in ("A", "B", "C", "D", "E", "__FILENAME__")}


def test_machines_of_instances(spark):
    enum = ("p", "E_S.TcDUT", "tcdut", "<TcPlcObject><DUT Name=\"E_S\"><Declaration><![CDATA[TYPE E_S :\n(\n\tInit := 0,\n\tRun := 1,\n\tTimeoutFault := 2\n);\nEND_TYPE]]></Declaration></DUT></TcPlcObject>")
    gvl = ("p", "Objects.TcGVL", "tcgvl", '<TcPlcObject><GVL Name="Objects"><Declaration><![CDATA[VAR_GLOBAL\n\tA : FB_M;\n\tB : FB_M;\n\tC : FB_D;\nEND_VAR]]></Declaration></GVL></TcPlcObject>')
    code = "sm.GotoState(StateNext := E_S.Init);\nCASE sm.State OF\nsm.GotoState(StateNext := E_S.Init);\nE_S.Init:\n\tsm.GotoState(StateNext := E_S.Run, TimeoutNext := T_Wait(1, 2) + T#2s); other.GotoState(StateNext := E_S.Init);\n\tsm.GotoState( StateNext:=E_S.TimeoutFault );\nEND_CASE\nCASE eOwn OF\nE_S.Init:\n\teOwn := E_S.Run;\nE_S.Run:\nEND_CASE\n"
    units = [unit("FB_M", "FUNCTION_BLOCK FB_M\nVAR\n\tsm : DM_StateMachine('Main one', E_S.Init, E_S.Run);\n\teOwn : E_S;\n\tidle : DM_StateMachine('Without a case', E_S.Run);\n\tlost : DM_StateMachine('No states');\nEND_VAR\n", code)]
    units += [unit("FB_D", "FUNCTION_BLOCK FB_D\nVAR\n\teZ : E_S;\n\teA : E_S;\nEND_VAR\n", "CASE eZ OF\nE_S.Init:\n\teZ := E_S.Run;\nEND_CASE\nCASE eA OF\nE_S.Run:\n\teA := E_S.Init;\nEND_CASE\n")]
    p = Project(spark.createDataFrame([("p", *r[1:]) for r in units] + [enum, gvl], "project_id string, path string, ext string, content string"))
    got = sorted((r.path, r.selector, r.kind, r.display_name, r.enum_type, r.initial_state, r.transition_state) for r in p.machine_instances.collect())
    of_m = [("idle", "wrapped", "Without a case", "E_S", "E_S.Run", None), ("sm", "wrapped", "Main one", "E_S", "E_S.Init", "E_S.Run")]
    assert got == [*[("A", *x) for x in of_m], *[("B", *x) for x in of_m], ("C", "eA", "direct", None, "E_S", None, None)]
    moves = sorted((r.from_state, r.to_state, r.timeout or "") for r in p.transitions.where("selector = 'sm'").collect())
    assert moves == [("?", "Init", ""), ("Init", "Run", "T_Wait(1, 2) + T#2s"), ("Init", "TimeoutFault", "")]
    flags = {r.state: (r.is_initial, r.is_transition, r.is_error, r.is_timeout) for r in p.states.where("selector = 'sm'").collect()}
    assert flags == {"Init": (True, False, False, False), "Run": (False, True, False, False), "TimeoutFault": (False, False, True, True)}


def test_states_of_constructors_that_go_on(spark):
    rows = [("p", "u", "sm", "sm", 0, 1, "DM_StateMachine('n',", None, None), ("p", "u", "initialstate", "InitialState", 0, 2, "= E_S.First,", None, None), ("p", "u", "transitionstate", "TransitionState", 0, 3, "= E_S.Second)", None, None), ("p", "v", "sm", "sm", 0, 1, "DM_StateMachine", None, None)]
    df = spark.createDataFrame(rows, "project_id string, pou_lc string, name_lc string, name string, ord_level int, ord int, data_type string, constructor_args string, initial_value string")
    got = {r.pou_lc: (r.display_name, r.initial_state, r.transition_state, r.enum_type) for r in statemachines.wrappers(df).collect()}
    assert got == {"u": ("n", "E_S.First", "E_S.Second", "E_S"), "v": (None, None, None, None)}
