from pyspark.sql import functions as F

from plantlens.operators import declarations, drives, elements
from plantlens.plans.project import Project

DRIVE = """<?xml version="1.0"?>
<Root><TcDMDrive><OrderCode>AX5</OrderCode>
  <Loose>direct</Loose>
  <Channel ChnId=" A "><Name>Left</Name><OrderCode>X</OrderCode>
    <Block Id="1"><Block><Name>Block</Name></Block><Block Id="7"></Block></Block>
    <Parameter><PropertyName>Gain</PropertyName><Value> 3 &lt; 4 </Value></Parameter>
    <Parameter><PropertyName>Bare</PropertyName></Parameter>
    <Parameter><Other>o</Other></Parameter>
    <SerialNr><Deep a="1"/></SerialNr>
    <Hollow><Void></Void><Void2/></Hollow>
  </Channel>
  <Notes>some <b>bold</b> text</Notes>
  <Raw><![CDATA[<x>]]></Raw>
  <Empty/>
</TcDMDrive><TcDMDrive><Second>no</Second></TcDMDrive></Root>"""


def files(spark, **content):
    rows = [("p", f"{k}.x", ext, text) for k, (ext, text) in content.items()]
    return spark.createDataFrame(rows, "project_id string, path string, ext string, content string")


def test_sections_and_parameters(spark):
    p = Project(files(spark, d=("tcdmdrv", DRIVE)))
    got = {r.section_path: (r.level, list(r.attributes)) for r in p.drive_sections.collect()}
    assert got == {
        "Loose": (1, []), "Channel A": (1, ["ChnId=A"]), "Channel A/Block 1": (2, ["Id=1"]), "Channel A/Block 1/Block": (3, []), "Channel A/Block 1/Block 7": (3, ["Id=7"]),
        "Channel A/Parameter": (2, []), "Notes": (1, []), "Raw": (1, []),
    }
    params = {(r.section_path, r.ord, r.name, r.value) for r in p.drive_parameters.collect()}
    assert params == {
        ("Loose", 0, "Loose", "direct"), ("Channel A", 0, "Name", "Left"), ("Channel A", 1, "OrderCode", "X"), ("Channel A", 2, "Gain", "3 < 4"), ("Channel A", 3, "Bare", "-"),
        ("Channel A/Block 1/Block", 0, "Name", "Block"), ("Channel A/Parameter", 0, "Other", "o"), ("Notes", 0, "b", "bold"), ("Raw", 0, "Raw", "<x>"),
    }


def test_files_that_are_not_well_formed(spark):
    bad = ["<a><b></a>", "<a></a></a>", "<a>", "<a/><b/>", "text <a/>", "", None, "<a></b>", "<a b='1></a>", '<!DOCTYPE a><a x="1"/>', "<a><b></a></b>"]
    f = files(spark, **{f"f{i}": ("tcdmdrv", x) for i, x in enumerate(bad)}, good=("tcdmdrv", '<!-- <c> --><n:a z=">"><b/></n:a>'))
    got = elements.elements(f).select("path", "name", "seq", "last_seq", "parent_seq", "depth", "is_leaf").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("good.x", "a", 1, 3, None, 1, False), ("good.x", "b", 2, 2, 1, 2, True)]
    status = {r.path: (r.status, r.name) for r in drives.drives(f).collect()}
    assert status == {**{f"f{i}.x": ("ParseFailed", f"f{i}") for i in range(len(bad))}, "good.x": ("Parsed", "good")}
    assert Project(f).drive_sections.count() == 0


def test_projects_of_drives(spark):
    text = '<P><Name>Line</Name><Content Include="a\\b.x"><DependentUpon> d\\e </DependentUpon></Content><Content Include="A/B.x"/><Content Include="c"><IoItemPathName>io</IoItemPathName></Content></P>'
    r = drives.projects(files(spark, p=("tcdmproj", text), q=("tcdmproj", "<P"))).orderBy("path").collect()
    assert (r[0].name, r[0].n_included, r[0].n_dependents, r[0].n_io_paths, r[0].related) == ("Line", 3, 1, 1, ["a/b.x", "c"])
    assert (r[1].name, r[1].status, r[1].n_included, r[1].related) == ("q", "ParseFailed", 0, [])


def test_deep_elements_keep_their_parents(spark):
    n = 40
    text = "<TcDMDrive>" + "".join(f"<S{i}>" for i in range(n)) + "<v>1</v>" + "".join(f"</S{i}>" for i in reversed(range(n))) + "</TcDMDrive>"
    p = Project(files(spark, d=("tcdmdrv", f"<R>{text}</R>")))
    deepest = p.drive_sections.orderBy(F.desc("level")).first()
    assert deepest.level == n and deepest.section_path == "/".join(f"S{i}" for i in range(n))
    assert p.drive_parameters.first().section_path == deepest.section_path


def test_tasks_read_bounded_text(spark, monkeypatch):
    f = files(spark, **{f"d{i}": ("tcdmdrv", DRIVE) for i in range(40)})
    monkeypatch.setattr(elements, "TASK", 2 * len(DRIVE))
    assert elements.elements(f).rdd.getNumPartitions() == 20
    assert {r["count"] for r in drives.rows(f).groupBy("path").count().collect()} == {drives.rows(f.where("path = 'd0.x'")).count()}


def _types(spark, lines):
    text = "FUNCTION_BLOCK A\nVAR\n" + "".join(f"\t{x};\n" for x in lines) + "END_VAR\n"
    owner = spark.createDataFrame([("p", "pou", "A", text)], "project_id string, owner_kind string, owner string, declaration string")
    return [(r.name, r.data_type, r.constructor_args, r.initial_value) for r in declarations.variables(owner).orderBy("ord").collect()]


def test_brackets_in_brackets(spark):
    got = _types(spark, ["a : FB(x := F(G((1), (2))), y := 3)", "b : INT := F(G(1))", "c : FB (1) // n", "d : FB(1", "e : STRING(80)", "f : FB(1) := 2", "g : REFERENCE TO FB", "h : ARRAY [0..(2)] OF FB(n := (1))", "i : INT(0..9)", "j : FB(a)(b)", "k : POINTER TO INT := 0"])
    assert got == [
        ("a", "FB", "x := F(G((1), (2))), y := 3", None), ("b", "INT", None, "F(G(1))"), ("c", "FB", "1", None), ("d", "FB(1", None, None), ("e", "STRING(80)", None, None), ("f", "FB(1)", None, "2"),
        ("g", "FB", None, None), ("h", "FB", "n := (1)", None), ("i", "INT", "0..9", None), ("j", "FB", "a", None), ("k", "INT", None, "0"),
    ]


def test_brackets_of_a_long_line(spark):
    deep, wide = "(" * 100_000 + ")" * 100_000, "(1)," * 250_000
    got = _types(spark, [f"a : FB({deep})", f"b : FB({wide}1)", f"c : INT := {'(' * 1000}"])
    assert [(n, t, len(c or ""), len(i or "")) for n, t, c, i in got] == [("a", "FB", 200_000, 0), ("b", "FB", 1_000_001, 0), ("c", "INT", 0, 1000)]
