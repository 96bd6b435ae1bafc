"""Artefacts of safety projects on hand-written files."""

from plantlens.operators import safety
from plantlens.plans.project import Project

BUILD = f'<Project xmlns="{safety.BUILD}">'


def project(spark, **content):
    rows = [("p", k, k.rsplit(".", 1)[-1].lower(), text) for k, text in content.items()]
    return Project(spark.createDataFrame(rows, "project_id string, path string, ext string, content string"))


def test_kinds_and_status(spark):
    p = project(spark, **{
        "a/SAFETY/x.xml": "﻿<?xml version='1.0'?>\n<n:TargetSystemConfig xmlns:n='u'><AmsNetID> 1.2 </AmsNetID><amsnetid>9</amsnetid></n:TargetSystemConfig>", "a/TwinSAFE1/cut.xml": "<TargetSystemConfig><a>",
        "safety.xml": "<TargetSystemConfig/>", "safety/o.xml": "<TargetSystemConfigs/>", "safety/null.xml": None, "safety/c.xml": "<!-- <TargetSystemConfig> --><x/>",
        "l.SAL": "", "n.sal": None, "d.sal.diagram": "<a></b>", "e.diagram": "<a/>", "s.sds": "<!DOCTYPE a><a/>",
    })
    got = {r.path: (r.category, r.status, r.name, list(r.metadata)) for r in p.safety_artifacts.collect()}
    told = ["target-system-type=unknown", "target-system-subtype=unknown", "software-version=unknown", "fsoe-address=unknown", "ams-net-id=1.2"]
    failed = lambda kind, name: (kind, "ParseFailed", name, [])
    assert got == {
        "a/SAFETY/x.xml": ("SafetyConfiguration", "Parsed", "x", told), "a/TwinSAFE1/cut.xml": failed("SafetyConfiguration", "cut"), "l.SAL": failed("SafetyLogic", "l"), "n.sal": failed("SafetyLogic", "n"),
        "d.sal.diagram": failed("SafetyDiagram", "d.sal"), "s.sds": failed("SafetyAliasDevice", "s"),
    }


def test_links(spark):
    p = project(spark, **{
        "S/p.splcproj": BUILD + '<None Include=" L\\A.sal "/><None Include="l/a.SAL"/><none Include="B.sal"/><None/><None Include=".\\D.sds"/><None Include="..\\E.sal"/></Project>', "S/q.splcproj": '<Project><None Include="L/A.sal"/></Project>',
        "S/L/a.sal": '<A name=""/>', "S/L/a.sal.diagram": "<v/>", "S/L/b.sal.diagram": "<v/>", "S/d.sds": "<d/>", "E.sal": "<e/>",
    })
    got = {(r.path, r.related): (r.target, r.target_category) for r in p.safety_links.collect()}
    assert got == {
        ("S/p.splcproj", "L/A.sal"): ("S/L/a.sal", "SafetyLogic"), ("S/p.splcproj", "./D.sds"): ("S/d.sds", "SafetyAliasDevice"), ("S/p.splcproj", "../E.sal"): (None, None),
        ("S/L/a.sal.diagram", "a.sal"): ("S/L/a.sal", "SafetyLogic"), ("S/L/b.sal.diagram", "b.sal"): (None, None),
    }
    counts = {r.path: r.metadata[-3:] for r in p.safety_artifacts.where("category = 'SafetyProject'").collect()}
    assert counts == {"S/p.splcproj": ["logic-file-count=3", "alias-device-count=1", "configuration-file-count=0"], "S/q.splcproj": ["logic-file-count=0", "alias-device-count=0", "configuration-file-count=0"]}


def test_inputs_and_outputs(spark):
    p = project(spark, **{"d.sds": "<d><IO><Name>A</Name><BitSize>1</BitSize></IO><g><io><x><DataType>INT</DataType></x></io></g><Name>late</Name></d>", "none.sds": "<IO/>"})
    assert [tuple(r)[1:] for r in p.safety_ios.orderBy("ord").collect()] == [("d.sds", 0, "A", "", "1", ""), ("d.sds", 1, "Unnamed IO", "INT", "", "")]
    assert {r.path: r.name for r in p.safety_artifacts.collect()} == {"d.sds": "A", "none.sds": "none"}


def test_long_and_no_files(spark):
    long = {f"safety/{i}.xml": x * 1_000_000 for i, x in enumerate((" ", "<", "<?", "<!--", "<!-- -->", "a"))}
    assert project(spark, **long).safety_artifacts.isEmpty()
    p = project(spark, **{"x.txt": "x"})
    assert p.safety_artifacts.isEmpty() and p.safety_links.isEmpty() and p.safety_ios.isEmpty()
