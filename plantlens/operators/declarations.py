"""Program units, data types and variable lists from source files, and their variables.

XML is read by from_xml in permissive mode, so that a broken file gives no row and never
fails the job. Declarations are read line by line with windows over each owner's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.sources.files import dealt

#: Bytes of declarations whose lines a task holds.
TASK = 8 << 20

_BODY = "struct<ST: string, NWL: string, FBD: string, SFC: string, CFC: string>"
POU_XML = (
    "POU struct<_Name: string, Declaration: string, Implementation: " + _BODY + ","
    " Method: array<struct<_Name: string, _FolderPath: string, Declaration: string, Implementation: struct<ST: string>>>,"
    " Property: array<struct<_Name: string, Declaration: string, Get: struct<Declaration: string, Implementation: struct<ST: string>>, Set: struct<Declaration: string, Implementation: struct<ST: string>>>>,"
    " Action: array<struct<_Name: string, Implementation: " + _BODY + ">>>"
)
HEADER = r"(?mi)^[ \t]*(FUNCTION_BLOCK|PROGRAM|FUNCTION|INTERFACE)((?:[ \t]+(?:ABSTRACT|FINAL))*)[ \t]+(\w+)(?:[ \t]+EXTENDS[ \t]+([\w.]+))?(?:[ \t]+IMPLEMENTS[ \t]+([^\n]+))?$"


def _rooted(files: DataFrame, ext: str, schema: str) -> DataFrame:
    """The parsed files of one kind; of two of one name the last path wins."""
    root = schema.split(" ", 1)[0]
    parsed = files.where(F.col("ext") == ext).select("project_id", "path", F.from_xml(fx.safe_xml(F.col("content")), schema, {"mode": "PERMISSIVE"})[root].alias("x")).where("x._Name is not null")
    last = Window.partitionBy("project_id", F.lower("x._Name")).orderBy(F.desc("path"))
    return parsed.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def pous(files: DataFrame) -> DataFrame:
    """project_id, path, name, name_lc, pou_type, is_abstract, extends_type, implements,
    attributes, declaration, implementation, language, and the raw members."""
    x = _rooted(files, "tcpou", POU_XML)
    decl = fx.newlines(F.col("x.Declaration"))
    kind = F.upper(F.regexp_extract(decl, HEADER, 1))
    part = lambda k: F.nullif(fx.strip(F.regexp_extract(decl, HEADER, k)), F.lit(""))
    body = F.col("x.Implementation")
    language = F.when(body.ST.isNotNull(), "ST").when(body.NWL.isNotNull() | body.FBD.isNotNull(), "FBD").when(body.SFC.isNotNull(), "SFC").when(body.CFC.isNotNull(), "CFC").otherwise("ST")
    return x.select(
        "project_id", "path", F.col("x._Name").alias("name"), F.lower("x._Name").alias("name_lc"),
        # a header that the grammar doesn't know leaves a function block without a parent
        F.when(kind == "PROGRAM", "Program").when(kind == "FUNCTION", "Function").when(kind == "INTERFACE", "Interface").otherwise("FunctionBlock").alias("pou_type"),
        F.coalesce(F.upper(part(2)).contains("ABSTRACT"), F.lit(False)).alias("is_abstract"), part(4).alias("extends_type"),
        F.coalesce(F.transform(F.split(part(5), ","), fx.strip), F.array().cast("array<string>")).alias("implements"),
        attributes(decl).alias("attributes"), decl.alias("declaration"), fx.newlines(body.ST).alias("implementation"), language.alias("language"),
        F.col("x.Method").alias("methods_xml"), F.col("x.Property").alias("properties_xml"), F.col("x.Action").alias("actions_xml"),
    )


def attributes(decl: Column) -> Column:
    return F.regexp_extract_all(decl, F.lit(r"\{attribute\s+'([^']*)'"), F.lit(1))


def methods(pou: DataFrame) -> DataFrame:
    """project_id, pou, pou_lc, ord, method, visibility, return_type, folder, declaration, body."""
    decl = fx.newlines(F.col("m.Declaration"))
    head = r"(?mi)^[ \t]*METHOD((?:[ \t]+(?:PUBLIC|PRIVATE|PROTECTED|INTERNAL|ABSTRACT|FINAL))*)[ \t]+(\w+)[ \t]*(?::[ \t]*([^;\n]+))?"
    words = F.upper(F.regexp_extract(decl, head, 1))
    visible = F.lit("Public")
    for v in ("Internal", "Protected", "Private"):
        visible = F.when(words.contains(v.upper()), v).otherwise(visible)
    return pou.select("project_id", "name", "name_lc", F.posexplode("methods_xml").alias("ord", "m")).select(
        "project_id", F.col("name").alias("pou"), F.col("name_lc").alias("pou_lc"), "ord", F.col("m._Name").alias("method"), F.lower("m._Name").alias("method_lc"),
        visible.alias("visibility"), F.nullif(fx.strip(F.regexp_extract(decl, head, 3)), F.lit("")).alias("return_type"),
        F.coalesce(words.contains("ABSTRACT"), F.lit(False)).alias("is_abstract"), F.col("m._FolderPath").alias("folder"), decl.alias("declaration"), fx.newlines(F.col("m.Implementation.ST")).alias("body"),
    )


def properties(pou: DataFrame) -> DataFrame:
    return pou.select("project_id", F.col("name").alias("pou"), F.col("name_lc").alias("pou_lc"), F.posexplode("properties_xml").alias("ord", "p")).select(
        "project_id", "pou", "pou_lc", "ord", F.col("p._Name").alias("property"),
        F.nullif(fx.strip(F.regexp_extract(fx.newlines(F.col("p.Declaration")), r"(?i)PROPERTY\s+(?:\w+\s+)*?(\w+)\s*:\s*([^;\n]+)", 2)), F.lit("")).alias("data_type"),
        F.col("p.Get").isNotNull().alias("has_get"), F.col("p.Set").isNotNull().alias("has_set"), F.coalesce("p.Declaration", F.lit("")).alias("declaration"),
        fx.newlines(F.col("p.Get.Implementation.ST")).alias("get_body"), fx.newlines(F.col("p.Set.Implementation.ST")).alias("set_body"),
    )


def actions(pou: DataFrame) -> DataFrame:
    return pou.select("project_id", F.col("name").alias("pou"), F.col("name_lc").alias("pou_lc"), F.posexplode("actions_xml").alias("ord", "a")).select(
        "project_id", "pou", "pou_lc", "ord", F.col("a._Name").alias("action"), F.when(F.col("a.Implementation.ST").isNotNull(), "ST").otherwise("FBD").alias("language"), fx.newlines(F.col("a.Implementation.ST")).alias("body"),
    )


def bodies(pou: DataFrame) -> DataFrame:
    """project_id, pou, pou_lc, ord, kind, code of every body of a unit, in order."""
    get = lambda df, kind, code, base: df.select("project_id", "pou", "pou_lc", (F.col("ord") + base).alias("ord"), F.lit(kind).alias("kind"), F.col(code).alias("code"))
    own = pou.select("project_id", F.col("name").alias("pou"), F.col("name_lc").alias("pou_lc"), F.lit(0).alias("ord"), F.lit("implementation").alias("kind"), F.col("implementation").alias("code"))
    props = properties(pou)
    return own.union(get(methods(pou), "method", "body", 1)).union(get(actions(pou), "action", "body", 10_000)).union(get(props, "getter", "get_body", 20_000)).union(get(props, "setter", "set_body", 30_000)).where("code <> ''")


def duts(files: DataFrame) -> DataFrame:
    x = _rooted(files, "tcdut", "DUT struct<_Name: string, Declaration: string>")
    decl = fx.newlines(F.col("x.Declaration"))
    kind = F.when(decl.rlike(r"(?mi)^\s*(TYPE\s+\w+\s*:\s*)?STRUCT\s*$"), "Struct").when(decl.rlike(r"(?mi)^\s*(TYPE\s+\w+\s*:\s*)?UNION\s*$"), "Union").when(decl.rlike(r"(?s):\s*\(.*\)"), "Enum").otherwise("Alias")
    base = F.when(kind == "Enum", F.regexp_extract(decl, r"(?s)\)\s*(\w+)\s*(?::=[^;]*)?;", 1)).when(kind == "Alias", fx.strip(F.regexp_extract(decl, r"(?i)TYPE\s+\w+\s*:\s*([^;]+);", 1)))
    return x.select("project_id", "path", F.col("x._Name").alias("name"), F.lower("x._Name").alias("name_lc"), kind.alias("dut_type"), F.nullif(base, F.lit("")).alias("base_type"), attributes(decl).alias("attributes"), decl.alias("declaration"))


def enum_values(dut: DataFrame) -> DataFrame:
    """project_id, dut, dut_lc, ord, name, value (text), comment."""
    inside = F.regexp_extract("declaration", r"(?s)\(\s*\n(.*)\n\s*\)", 1)
    member = r"^\s*(\w+)\s*(?::=\s*([^,/(]+?))?\s*,?\s*(?://\s*(.*)|\(\*\s*(.*?)\s*\*\))?\s*$"
    rows = dut.where("dut_type = 'Enum'").select("project_id", F.col("name").alias("dut"), F.col("name_lc").alias("dut_lc"), F.posexplode(F.filter(F.split(inside, "\n"), lambda x: x.rlike(member))).alias("ord", "line"))
    get = lambda k: F.nullif(fx.strip(F.regexp_extract("line", member, k)), F.lit(""))
    return rows.select("project_id", "dut", "dut_lc", "ord", get(1).alias("name"), get(2).alias("value"), F.coalesce(get(3), get(4)).alias("comment"))


def gvls(files: DataFrame) -> DataFrame:
    x = _rooted(files, "tcgvl", "GVL struct<_Name: string, Declaration: string>")
    decl = fx.newlines(F.col("x.Declaration"))
    return x.select("project_id", "path", F.col("x._Name").alias("name"), F.lower("x._Name").alias("name_lc"), decl.rlike(r"\{attribute\s+'qualified_only'").alias("qualified_only"), decl.alias("declaration"))


def scope_of(words: Column) -> Column:
    """CONSTANT before PERSISTENT before the block's kind; Local else."""
    w = F.upper(words)
    kind = F.when(w.startswith("VAR_IN_OUT"), "InOut").when(w.startswith("VAR_INPUT"), "Input").when(w.startswith("VAR_OUTPUT"), "Output").when(w.startswith("VAR_STAT"), "Stat").when(w.startswith("VAR_TEMP"), "Temp").when(w.startswith("VAR_GLOBAL"), "Global").otherwise("Local")
    return F.when(w.contains("CONSTANT"), "Constant").when(w.contains("PERSISTENT"), "Persistent").otherwise(kind)


BLOCK = r"(?i)^\s*(VAR(?:_INPUT|_OUTPUT|_IN_OUT|_STAT|_TEMP|_GLOBAL)?(?:\s+(?:CONSTANT|PERSISTENT|RETAIN))?)\s*$"
#: Up to a `//` that stands outside of string literals. Here and below a group that repeats is
#: possessive, as Java's matcher works on other groups by recursion and long lines would end it.
CODE = r"^((?:[^'/]++|'[^']*+'|/(?!/))*+)"


def brackets(text: Column) -> Column:
    """open: where the first round bracket stands, close: where the one that ends it stands,
    assign: where the first `:=` outside of all brackets stands; places count from 0, each is
    null where there is none. Brackets may be as deep as they like: the text is cut at brackets
    and assignments, and the running depth is folded over the pieces."""
    piece = F.split(text, r"(?=[()])|(?<=[()])|(?=:=)")
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), none.alias("base"), none.alias("open"), none.alias("close"), none.alias("assign"))

    def step(a: Column, x: Column) -> Column:
        opens, closes = x == "(", x == ")"
        depth = a.depth + F.when(opens, 1).when(closes, -1).otherwise(0)
        first = opens & a.open.isNull()
        return F.struct(
            depth.alias("depth"), (a.at + F.length(x)).alias("at"), F.when(first, a.depth).otherwise(a.base).alias("base"), F.when(first, a.at).otherwise(a.open).alias("open"),
            F.when(closes & a.close.isNull() & (depth == a.base), a.at).otherwise(a.close).alias("close"), F.when(a.assign.isNull() & (a.depth == 0) & x.startswith(":="), a.at).otherwise(a.assign).alias("assign"),
        )

    found = F.aggregate(piece, start, step, lambda a: F.struct(a.open.alias("open"), a.close.alias("close"), a.assign.alias("assign")))
    flat = F.struct(none.alias("open"), none.alias("close"), F.nullif(F.instr(text, ":=") - 1, F.lit(-1)).alias("assign"))
    return F.when(text.contains("("), found).otherwise(flat)


def _block(line: Column) -> Column:
    """The scope that a line opens, "" where it ends one; else null."""
    head = F.regexp_extract(line, BLOCK, 1)
    return F.when(F.upper(line).contains("VAR"), F.when(head != "", scope_of(head)).when(line.rlike(r"(?i)^\s*END_VAR\b"), ""))


def _plain_lines(owners: DataFrame, key: list[str]) -> DataFrame:
    """The lines in VAR blocks of owners without any comment: an owner's text is cut at the lines that
    open and end blocks, so that its lines have their scope without a sort."""
    x = owners.select(*key, F.split("declaration", "\n").alias("lines"))
    marks = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), _block(line).alias("scope"))), lambda m: m.scope.isNotNull())
    x = x.withColumn("marks", marks)
    end = lambda j: F.coalesce(F.get("marks", j + 1).at, F.size("lines"))
    blocks = F.transform("marks", lambda m, j: F.struct(m.at.alias("at"), m.scope.alias("scope"), F.slice("lines", m.at + 2, end(j) - m.at - 1).alias("held")))
    x = x.select(*key, F.inline(F.filter(blocks, lambda b: b.scope != ""))).select(*key, "at", "scope", F.posexplode("held").alias("k", "line"))
    code = F.when(F.col("line").contains("'"), F.regexp_extract("line", CODE, 1)).otherwise(F.col("line"))
    return x.select(*key, (F.col("at") + 1 + F.col("k")).alias("ord"), "line", code.alias("code"), "scope", F.lit(None).cast("string").alias("leading_comment"))


def _noted_lines(owners: DataFrame, key: list[str]) -> DataFrame:
    """The lines in VAR blocks of owners with comments, and the comment lines before each."""
    line = owners.select(*key, F.posexplode(F.split("declaration", "\n")).alias("ord", "line"))
    w = Window.partitionBy(*key).orderBy("ord")
    has = lambda *marks: reduce(Column.__or__, [F.col("line").contains(m) for m in marks])
    marks = lambda p: F.size(F.split("line", p)) - 1
    depth = F.when(has("(*", "*)"), marks(r"\(\*") - marks(r"\*\)")).otherwise(0)
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("open", F.coalesce(F.sum(depth).over(up_to), F.lit(0)) > 0)
    line = line.withColumn("block", F.when(~F.col("open"), _block(F.col("line"))))
    line = line.withColumn("scope", F.last("block", ignorenulls=True).over(w))
    # inline block comments become the comment; what is inside of a longer one is no code
    whole = F.regexp_replace("line", r"\(\*.*?\*\)", "")
    code = F.when(F.col("open"), F.when(F.col("line").contains("*)"), F.regexp_replace("line", r"^.*?\*\)", "")).otherwise("")).when(has("(*"), F.regexp_replace(whole, r"\(\*.*$", "")).otherwise(F.col("line"))
    note = F.when(F.col("open") | F.col("line").rlike(r"^\s*(//|\(\*)"), fx.strip(F.regexp_replace("line", r"//|\(\*|\*\)", "")))
    line = line.withColumn("code", F.when(has("'", "//"), F.regexp_extract(code, CODE, 1)).otherwise(code)).withColumn("note", note)
    line = line.withColumn("solid", ((fx.strip("code") != "") | F.col("block").isNotNull()).cast("int"))
    line = line.withColumn("run", F.coalesce(F.sum("solid").over(up_to), F.lit(0)))
    lead = F.array_join(F.collect_list(F.when(F.col("solid") == 0, F.col("note"))).over(Window.partitionBy(*key, "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), "\n")
    line = line.withColumn("leading_comment", F.nullif(fx.strip(lead), F.lit("")))
    return line.where("scope <> '' and block is null").select(*key, "ord", "line", "code", "scope", "leading_comment")


def variables(owners: DataFrame, task: int | None = TASK) -> DataFrame:
    """Variables of owners (project_id, owner_kind, owner, declaration): ord, name, data_type,
    scope, initial_value, comment, leading_comment, is_reference, is_pointer, is_array,
    array_bounds, at_binding, constructor_args.

    A line of a VAR block declares one variable. Comment lines before it are its leading
    comment. Owners are dealt by `task` bytes, for which they are read twice (None: as they
    come). A declaration of several names, or a block header with two qualifiers, isn't
    recognised, as in the analyser whose results these match."""
    key = ["project_id", "owner_kind", "owner"]
    owners = owners.select(*key, "declaration")
    owners = dealt(owners, key, "declaration", task) if task else owners
    noted = F.col("declaration").contains("//") | F.col("declaration").contains("(*")
    found = _noted_lines(owners.where(noted), key).union(_plain_lines(owners.where(~noted), key))
    bare_code = fx.strip("code")
    stmt = F.when(bare_code.endswith(";"), F.substr(bare_code, F.lit(1), F.length(bare_code) - 1)).otherwise(F.regexp_replace(bare_code, r";\s*$", ""))
    found = found.where("code like '%:%'").withColumn("stmt", stmt)
    left = fx.strip(F.substring_index("stmt", ":", 1))
    right = fx.strip(F.regexp_extract("stmt", r"^[^:]*:(.*)$", 1))
    name = F.regexp_extract(left, r"^([A-Za-z_]\w*)\s*(?i:AT\s+%.*)?$", 1)
    at = F.when(left.contains("%"), F.regexp_extract(left, r"(?i)\bAT\s+(%[IQM]\*?[\d.]*)", 1)).otherwise("")
    found = found.withColumn("name", name).withColumn("at_binding", F.nullif(at, F.lit(""))).withColumn("right", right).where("name <> '' and right <> ''")
    begins = F.upper(F.left("right", F.lit(9)))  # most types have none of these words, and need no pattern then
    ref, ptr, arr = (begins.startswith(word) & F.col("right").rlike(p) for word, p in (("REFERENCE", r"(?i)^REFERENCE\s+TO\b"), ("POINTER", r"(?i)^POINTER\s+TO\b"), ("ARRAY", r"(?i)^ARRAY\s*\[")))
    bare = F.when(ref | ptr | arr, fx.strip(F.regexp_replace("right", r"(?i)^(REFERENCE\s+TO|POINTER\s+TO|ARRAY\s*\[[^\]]*\]\s*OF)\s+", ""))).otherwise(F.col("right"))
    found = found.withColumn("bare", bare).withColumn("at", brackets(F.col("bare")))
    is_text = F.col("bare").rlike(r"(?i)^W?STRING\s*\(\s*\w+\s*\)$")
    valued, has_args = F.col("at.assign").isNotNull(), F.col("at.assign").isNull() & (F.col("at.open") > 0) & F.col("at.close").isNotNull() & ~is_text
    piece = lambda start, end: fx.strip(F.substr("bare", start + 1, end - start))
    typed = F.when(valued, piece(F.lit(0), F.col("at.assign"))).when(has_args, piece(F.lit(0), F.col("at.open"))).otherwise(F.col("bare"))
    said = lambda mark, pattern: F.when(F.col("line").contains(mark), F.nullif(fx.strip(F.regexp_extract("line", pattern, 1)), F.lit("")))
    remark = F.coalesce(said("//", r"^(?:[^'/]++|'[^']*+'|/(?!/))*+//(.*)$"), said("(*", r"\(\*(.*?)\*\)"))
    return found.select(
        *key, F.lower("owner").alias("owner_lc"), F.col("ord").cast("int").alias("ord"), "name", F.lower("name").alias("name_lc"),
        typed.alias("data_type"), "scope", F.when(valued, F.nullif(piece(F.col("at.assign") + 2, F.length("bare")), F.lit(""))).alias("initial_value"), remark.alias("comment"), "leading_comment",
        ref.alias("is_reference"), ptr.alias("is_pointer"), arr.alias("is_array"), F.when(arr, F.regexp_extract("right", r"\[([^\]]*)\]", 1)).alias("array_bounds"), "at_binding",
        F.when(has_args, piece(F.col("at.open") + 1, F.col("at.close"))).alias("constructor_args"),
    )


def owners(pou: DataFrame, gvl: DataFrame, dut: DataFrame) -> DataFrame:
    """Whatever declares variables: units, variable lists, and structs' and unions' members
    (their lines are given a block of their own)."""
    members = F.regexp_replace("declaration", r"(?mi)^\s*(?:TYPE\s+\w+\s*:\s*)?(?:STRUCT|UNION)\s*$", "VAR")
    members = F.regexp_replace(members, r"(?mi)^\s*END_(?:STRUCT|UNION).*$", "END_VAR")
    pick = lambda df, kind, d: df.select("project_id", F.lit(kind).alias("owner_kind"), F.col("name").alias("owner"), d.alias("declaration"))
    d = F.col("declaration")
    return pick(pou, "pou", d).union(pick(gvl, "gvl", d)).union(pick(dut.where("dut_type in ('Struct', 'Union')"), "dut", members))


def all_owners_variables(pou: DataFrame, gvl: DataFrame, dut: DataFrame, task: int | None = TASK) -> DataFrame:
    """variables() of all owners; a variable list's are Global unless Constant."""
    found = variables(owners(pou, gvl, dut), task)
    return found.withColumn("scope", F.when((F.col("owner_kind") == "gvl") & (F.col("scope") != "Constant"), "Global").otherwise(F.col("scope")))
