"""Texts far longer than ordinary ones end no session: the patterns don't recurse."""

import pytest
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.operators import alarms, compliance, contracts, declarations, io, packml

MB = 1 << 20


@pytest.mark.parametrize("line, name, kind, initial", [
    ("a : ARRAY[0..9] OF INT := [" + "1," * (MB // 2) + "1]; // tail", "a", "INT", "[" + "1," * (MB // 2) + "1]"),
    ("s : STRING := '" + "x" * MB + "'; // tail", "s", "STRING", "'" + "x" * MB + "'"),
    ("f : FB := (" + "(" + "y" * MB + ")", None, None, None), ("b : BOOL; // " + "c" * MB, "b", "BOOL", None),
    ("t : " + "''" * (MB // 2) + " INT;", "t", None, None), ("/" * 3 + "d" * MB, None, None, None), ("e/" * (MB // 2), None, None, None),
])
def test_long_declarations(spark, line, name, kind, initial):
    owners = spark.createDataFrame([("p", "pou", "U", f"FUNCTION_BLOCK U\nVAR\n{line}\nlast : INT := 1;\nEND_VAR")], "project_id string, owner_kind string, owner string, declaration string")
    got = {r.name: r for r in declarations.variables(owners).collect()}
    assert got["last"].initial_value == "1"
    if kind:
        assert (got[name].data_type, got[name].initial_value) == (kind, initial) and (got[name].comment or "t").startswith(("t", "c"))


def test_long_code_and_blank_lines(spark):
    rows = [(1, "a'" + "x" * MB + "'b"), (2, "'" + "$'" * (MB // 2) + "'z"), (3, "//" + "x" * MB), (4, "(*" + "x" * MB + "*)q"), (5, "\n" * MB), (6, "a\n \t\n\r\n \r\nb"), (7, "a\n\n\nb"), (8, "'" + "x" * MB)]
    df = spark.createDataFrame(rows, "k int, code string")
    got = {r.k: r for r in df.select("k", fx.stripped(F.col("code")).alias("code"), fx.blank_run(F.col("code")).alias("blank")).collect()}
    assert [got[k].code for k in (1, 2, 3, 4)] == ["a''b", "''z", " ", " q"] and got[8].code == rows[-1][1]
    assert [got[k].blank for k in (5, 6, 7)] == [True, True, False]
    assert "style.excessive_blank_lines" in compliance.module_rules()


def test_channels_and_their_declarations(spark):
    pdo = lambda name, out, *entries: (name, None, out, [(n, i, "1", t, None) for n, i, t in entries])
    box = spark.createDataFrame(
        [("p", "B1", "EL1008", False, "b1.xti", [pdo("Ch 1", "0", ("Input", "#x6000", "BIT"), ("Status__Error", "#x6000", "BIT")), pdo("Ch 2", "1", ("Output", "#x7000", "BOOL"), ("Toggle", "#x1800", "BIT")), pdo("Ch 3", "1", ("Value", "", "INT"), ("Output", "", "BIT"))]),
         ("p", "S1", "EL1904", True, "s1.xti", [pdo("Ch 1", "0", ("Input", "0x6001", "BOOL"), ("Value", "#x1A00", "INT"))])],
        "project_id string, box string, sku string, is_safety boolean, files string, pdos array<struct<_Name: string, _Index: string, _InOut: string, Entry: array<struct<_Name: string, _Index: string, _Sub: string, Type: string, _BitLen: int>>>>",
    )
    link = spark.createDataFrame([("p", "B1", "Ch 1", "Input", "CM_A.bIn"), ("p", "B1", "Ch 1", "Status__Error", "bFault"), ("p", "B1", "Ch 3", "Value", "Nowhere.x")], "project_id string, box string, channel string, signal string, symbol string")
    variable = spark.createDataFrame([("p", "gvl", "io", "bfault", 0, "BOOL", "%I*", " broken "), ("p", "gvl", "io", "bfree", 1, "BOOL", "%Q1.0", None)], "project_id string, owner_kind string, owner_lc string, name_lc string, ord int, data_type string, at_binding string, comment string")
    unit = spark.createDataFrame([("p", "cm_a", "bin", 0, "BOOL", "%I*", None), ("p", "cm_a", "bfault", 1, "INT", None, None), ("p", "cm_a", "brest", 2, "BYTE", "%MB4", "kept")], "project_id string, pou_lc string, name_lc string, ord int, data_type string, at_binding string, comment string")
    mapped = spark.createDataFrame([("p", "bFault", "BOOL", "%I*", "gvl", "IO", " broken ", "Input"), ("p", "bFree", "BOOL", "%Q1.0", "gvl", "IO", None, "Output"), ("p", "bIn", "BOOL", "%I*", "pou", "CM_A", None, "Input"), ("p", "bRest", "BYTE", "%MB4", "pou", "CM_A", "kept", "Memory")], "project_id string, variable string, data_type string, at_binding string, source_kind string, source string, comment string, direction string")
    channel = io.channels(box)
    assert {(r.box, r.channel, r.signal): (r.direction, r.is_primary) for r in channel.collect()} == {
        ("B1", "Ch 1", "Input"): ("Input", True), ("B1", "Ch 1", "Status__Error"): ("Input", False), ("B1", "Ch 2", "Output"): ("Output", True), ("B1", "Ch 2", "Toggle"): ("Output", False),
        ("B1", "Ch 3", "Value"): ("Output", False), ("B1", "Ch 3", "Output"): ("Output", False), ("S1", "Ch 1", "Input"): ("Input", True), ("S1", "Ch 1", "Value"): ("Unknown", True),
    }
    got = sorted(tuple(r)[1:] for r in io.unified(channel, link, mapped, variable, unit).collect())
    assert got == sorted([
        ("linked", "CM_A.bIn", "BOOL", "%I*", "Input", "EL1008", "B1", "Ch 1", "Input", "#x6000", "", "b1.xti"), ("linked", "bFault", "BOOL", "%I*", "Input", "EL1008", "B1", "Ch 1", "Status__Error", "#x6000", "broken", "b1.xti"),
        ("linked", "Nowhere.x", "INT", "", "Output", "EL1008", "B1", "Ch 3", "Value", "", "", "b1.xti"), ("unused-channel", "", "BOOL", "", "Output", "EL1008", "B1", "Ch 2", "Output", "#x7000", "", "b1.xti"),
        ("unused-channel", "", "BOOL", "", "Input", "EL1904", "S1", "Ch 1", "Input", "0x6001", "", "s1.xti (safety / FSOE-mapped)"),
        ("software-only", "IO.bFree", "BOOL", "%Q1.0", "Output", "", "", "", "", "", "", "PLC declaration (no hardware link)"), ("software-only", "CM_A.bRest", "BYTE", "%MB4", "Memory", "", "", "", "", "", "kept", "PLC declaration (no hardware link)"),
    ])


LONG_TEXTS = ["x" * MB, "a." * (MB // 2), "a.ALM_b." * (MB // 8), "(" * MB, "'" * MB, " " * MB, "a " * (MB // 2), "x.ALM_y.Trigger := " * (MB // 20), "a:" * (MB // 2), "E_a." * (MB // 4), "GotoState(" * (MB // 10), "\t\n" * (MB // 2), "{" + "a" * MB, "<Property" * (MB // 9)]


@pytest.mark.parametrize("text", LONG_TEXTS)
def test_patterns_end_on_long_texts(spark, text):
    body = spark.createDataFrame([("p", "u", 0, text + ";\nq.ALM_z.Trigger := bOn;\nHeld: GotoState(E_S.Idle);")], "project_id string, pou_lc string, ord int, code string")
    pou = spark.createDataFrame([("p", "U", "u")], "project_id string, name string, name_lc string")
    none = spark.createDataFrame([], "project_id string, pou_lc string, method_lc string, body string")
    chain = spark.createDataFrame([], "project_id string, pou_lc string, level int, ancestor string, ancestor_lc string, known boolean, cyclic boolean")
    node = spark.createDataFrame([("p", "u", "U", "R")], "project_id string, type_lc string, type_name string, path string")
    found = {r.variable_path for r in alarms.inferred_from_usage(body, pou, none, chain, node).collect()}
    assert "R.q.ALM_z" in found or text[0] in "'({"
    moves = body.select(packml.written_moves(F.col("code")).alias("m")).first().m
    assert ("Held", "Idle") in {(m["from"], m["to"]) for m in moves}
    compliance.raw_features(body.select("project_id", F.lit("u").alias("path"), F.lit("tcpou").alias("ext"), F.col("code").alias("content"))).collect()


def test_latches_by_use(spark):
    rows = [("x.ALM_a.Trigger := b1 ; x.ALM_a . Trigger:=b2;", ("x.ALM_a", "b2")), ("IF a.b.ALM_c.Latched THEN ALM_no.Trigger := 1; y := x.ALM_; z := s.ALM_d.Other;", ("a.b.ALM_c", None)), ("for i := [1..x.ALM_r.Update] do ;", ("x.ALM_r", None)), ("x.ALM_t.Trigger := unended", ("x.ALM_t", None))]
    for code, (used, trigger) in rows:
        body = spark.createDataFrame([("p", "u", 0, code)], "project_id string, pou_lc string, ord int, code string")
        pou = spark.createDataFrame([("p", "U", "u")], "project_id string, name string, name_lc string")
        none = spark.createDataFrame([], "project_id string, pou_lc string, method_lc string, body string")
        chain = spark.createDataFrame([], "project_id string, pou_lc string, level int, ancestor string, ancestor_lc string, known boolean, cyclic boolean")
        node = spark.createDataFrame([("p", "u", "U", "R")], "project_id string, type_lc string, type_name string, path string")
        assert [(r.variable_path, r.trigger) for r in alarms.inferred_from_usage(body, pou, none, chain, node).collect()] == [(f"R.{used}", trigger)]


def test_moves_are_read_as_tokens(spark):
    code = "A: sm.GotoState( E_S . B ); C: xGotoState(D, 1); E: _eState := F.G; H: IF q THEN _eState:=E_K.L; END_IF; M: _eState := E_N; O : y := 1; GotoState(P); Q: _eState := R; GotoState(T)"
    got = spark.createDataFrame([(code,)], "code string").select(packml.written_moves(F.col("code")).alias("m")).first().m
    assert [(m["from"], m["to"]) for m in got] == [("A", "B"), ("E", "F"), ("H", "L"), ("M", "E_N"), ("Q", "R")]


def test_rules_on_the_whole_file(spark):
    file = lambda text: ("p", "U.TcPOU", "tcpou", text)
    of = lambda text: compliance.raw_features(spark.createDataFrame([file(text)], "project_id string, path string, ext string, content string")).first()
    x = of('<POU>\r\n\ta\n b\n\n<Property Name="P"><Declaration><![CDATA[PROPERTY P\nVAR\nEND_VAR]]></Declaration><Get/></Property><Property Name="Q"><Declaration><![CDATA[PROPERTY Q : INT]]></Declaration><Get><Declaration><![CDATA[VAR\nEND_VAR]]></Declaration></Get></Property>')
    assert (x.n_tabbed, x.n_spaced, x.blank_run, x.n_var_properties, x.n_guid_like) == (1, 1, False, 1, 0)
    x = of("{12345678-1234-1234-1234-1234567890AB}{12345678-1234-1234-1234-1234567890A}\r\n\r\n \t\n\nq")
    assert (x.n_guid_like, x.n_guids, x.blank_run) == (2, 1, True)


def test_composition_counts_no_paths(spark):
    layers = [("p", "pou", f"l{k}n{a}", f"l{k + 1}n{b}") for k in range(6) for a in range(30) for b in range(30)] + [("q", "pou", *e) for e in (("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "e"), ("f", "g"))]
    variable = spark.createDataFrame(layers, "project_id string, owner_kind string, owner_lc string, data_type string")
    pou = spark.createDataFrame(sorted({(p, x) for p, _, *e in layers for x in e}), "project_id string, name_lc string")
    got = {(r.project_id, r.pou_lc): r.depth for r in contracts.composition_depth(pou, variable).collect()}
    assert all(got["p", f"l{k}n{a}"] == 7 - k for k in range(6) for a in range(30))
    assert {k: v for k, v in got.items() if k[0] == "q"} == {("q", "a"): 3, ("q", "b"): 3, ("q", "c"): 4, ("q", "d"): 3, ("q", "e"): 2, ("q", "f"): 2}
