"""A virtual project: the benchmark tables rendered as source text, by column functions.

Queries over it parse the text and derive relations, and their SQL computes the same from
the tables alone, so that each is an independent round trip. A file gathers what belongs to
one key of a table, as a source file does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.operators import packml

PROJECT = "virtual"
TIERS = {"AUTOMOBILE": "Critical", "BUILDING": "Process", "FURNITURE": "Advisory", "HOUSEHOLD": "Information"}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Rows that each become a file (as many as `table` has), in tasks of up to 20,000 rows: a
    table of short rows is read by few tasks, however long the files are."""
    n = (rows if table is None else table).count()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 20_000)))


def _cdata(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}><![CDATA["), text, F.lit(f"]]></{tag}>"))


def pou_file(name: Column, declaration: Column, body: Column | None = None, methods: Column | None = None) -> list[Column]:
    """path, ext and content of a unit's file."""
    code = F.concat(F.lit("<Implementation>"), _cdata("ST", body), F.lit("</Implementation>")) if body is not None else F.lit("")
    content = F.concat(F.lit('<TcPlcObject><POU Name="'), name, F.lit('">'), _cdata("Declaration", declaration), code, methods if methods is not None else F.lit(""), F.lit("</POU></TcPlcObject>"))
    return _file(name, "TcPOU", content)


def method(name: str, body: Column) -> Column:
    return F.concat(F.lit(f'<Method Name="{name}">'), _cdata("Declaration", F.lit(f"METHOD PRIVATE {name} : BOOL\n")), F.lit("<Implementation>"), _cdata("ST", body), F.lit("</Implementation></Method>"))


def _file(name: Column, ext: str, content: Column) -> list[Column]:
    return [F.lit(PROJECT).alias("project_id"), F.concat(name, F.lit(f".{ext}")).alias("path"), F.lit(ext.lower()).alias("ext"), content.alias("content")]


def _joined(rows: DataFrame, key: str, order: str, text: Column, out: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("x")))), lambda r: r.x), "").alias(out))


def _fixed(spark: SparkSession, name: str, declaration: str, body: str = "") -> DataFrame:
    return spark.range(1).select(*pou_file(F.lit(name), F.lit(declaration), F.lit(body)))


def plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as units, with the roots' variable list."""
    n, s, r = (_t(spark, sf_dir, x) for x in ("nation", "supplier", "region"))
    nations = _joined(n, "n_regionkey", "n_nationkey", F.concat(F.lit("\tN"), "n_nationkey", F.lit(" : EM_N"), "n_nationkey", F.lit(";\n")), "members")
    um = r.join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    name = F.concat(F.lit("UM_R"), "r_regionkey")
    ums = um.select(*pou_file(name, F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n"), F.coalesce("members", F.lit("")), F.lit("END_VAR\n")), F.lit("")))
    root = r.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r_regionkey")), lambda k: F.concat(F.lit("\tR"), k, F.lit(" : UM_R"), k, F.lit(";\n"))), "").alias("x"))
    objects = root.select(*_file(F.lit("Objects"), "TcGVL", F.concat(F.lit('<TcPlcObject><GVL Name="Objects">'), _cdata("Declaration", F.concat(F.lit("{attribute 'qualified_only'}\nVAR_GLOBAL\n"), "x", F.lit("END_VAR\n"))), F.lit("</GVL></TcPlcObject>"))))
    return ums.union(objects).union(equipment(spark, sf_dir, n, s)).union(controls(spark, s)).union(_bases(spark))


def equipment(spark: SparkSession, sf_dir: str, n: DataFrame, s: DataFrame) -> DataFrame:
    """Nations: members are suppliers and the alarms of customers."""
    c = _t(spark, sf_dir, "customer")
    suppliers = _joined(s, "s_nationkey", "s_suppkey", F.concat(F.lit("\tS"), "s_suppkey", F.lit(" : CM_S"), "s_suppkey", F.lit(";\n")), "members")
    alarm = F.concat(F.lit("ALM_Cust"), "c_custkey")
    declared = _joined(c, "c_nationkey", "c_custkey", F.concat(F.lit("\t"), alarm, F.lit(" : DM_TriggeredLatch;\n")), "alarms")
    tier = F.lit(None)
    for segment, t in TIERS.items():
        tier = F.when(F.col("c_mktsegment") == segment, t).otherwise(tier)
    tiered = c.withColumn("tier", tier).where("tier is not null").groupBy("c_nationkey", "tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("ALM_Cust"), k, F.lit(".Latched"))), "\n\tOR ").alias("x"))
    blocks = _joined(tiered, "c_nationkey", "tier", F.concat(F.lit("_AlarmsPresent"), "tier", F.lit(" := "), "x", F.lit(";\n")), "tiers")
    trigger = F.when(F.col("c_custkey") % 2 == 0, F.concat(alarm, F.lit(".Trigger := nLevel > "), F.col("c_custkey") % 100, F.lit(";\n"))).otherwise("")
    delay = F.when(F.col("c_custkey") % 3 == 0, F.concat(alarm, F.lit(".TriggerDelay_ms := "), F.col("c_custkey") * 10, F.lit(";\n"))).otherwise("")
    triggers = _joined(c, "c_nationkey", "c_custkey", F.concat(trigger, delay), "triggers")
    x = n
    for part, key in ((suppliers, "s_nationkey"), (declared, "c_nationkey"), (blocks, "c_nationkey"), (triggers, "c_nationkey")):
        x = x.join(part.withColumnRenamed(key, "k"), F.col("n_nationkey") == F.col("k"), "left").drop("k")
    name, m = F.concat(F.lit("EM_N"), "n_nationkey"), F.col("n_nationkey") % 5
    parent = F.when(m == 0, " EXTENDS EM_BASECLASS").when(m == 1, "").otherwise(" EXTENDS EM_Equipment")
    text = lambda col: F.coalesce(col, F.lit(""))
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, parent, F.lit("\nVAR\n"), text("members"), text("alarms"), F.lit("END_VAR\n"))
    body = F.when(m == 1, "").otherwise(F.concat(F.when(m == 0, "").otherwise(text("tiers")), text("triggers")))
    return x.select(*pou_file(name, decl, F.lit(""), F.when(m == 1, "").otherwise(method("_Alarms", body))))


def controls(spark: SparkSession, s: DataFrame) -> DataFrame:
    name = F.concat(F.lit("CM_S"), "s_suppkey")
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit(" EXTENDS CM_L"), F.col("s_suppkey") % 7, F.lit("\nVAR_INPUT\n\tbRun : BOOL;\nEND_VAR\n"))
    return s.select(*pou_file(name, decl, F.lit("")))


def _bases(spark: SparkSession) -> DataFrame:
    k = spark.range(7).withColumn("k", F.col("id").cast("int"))
    name = F.concat(F.lit("CM_L"), "k")
    parent = F.when(F.col("k") == 0, "CM_BASECLASS").otherwise(F.concat(F.lit("CM_L"), F.col("k") - 1))
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit(" EXTENDS "), parent, F.lit("\nVAR\n\tnLevel : INT := "), "k", F.lit("; // level\n\tnOwn"), "k", F.lit(" : INT;\nEND_VAR\n"))
    return k.select(*pou_file(name, decl, F.lit(""))).union(_fixed(spark, "EM_Equipment", "FUNCTION_BLOCK EM_Equipment\nVAR\n\tnState : INT;\nEND_VAR\n"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units, and the enum of their types."""
    p = _dealt(_t(spark, sf_dir, "part"))
    name = F.concat(F.lit("FB_P"), "p_partkey")
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n\t// size of the part\n\tnSize : INT := "), "p_size", F.lit(";\n\trPrice : LREAL := "), F.format_string("%.2f", "p_retailprice"), F.lit("; // "), "p_name", F.lit("\n\teType : E_PType;\nEND_VAR\n"))
    units = p.select(*pou_file(name, decl, F.lit("")))
    types = p.select("p_type").distinct().agg(F.array_sort(F.collect_list("p_type")).alias("t"))
    members = F.array_join(F.transform("t", lambda x, i: F.concat(F.lit("\t"), x, F.lit(" := "), i)), ",\n")
    enum = types.select(*_file(F.lit("E_PType"), "TcDUT", F.concat(F.lit('<TcPlcObject><DUT Name="E_PType">'), _cdata("Declaration", F.concat(F.lit("TYPE E_PType :\n(\n"), members, F.lit("\n) INT;\nEND_TYPE\n"))), F.lit("</DUT></TcPlcObject>"))))
    return units.union(enum)


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose code calls a part for each line item, and the parts they call."""
    li = _t(spark, sf_dir, "lineitem")
    call = F.concat(F.lit("P"), "l_partkey", F.lit("(nQty := "), F.col("l_quantity").cast("int"), F.lit("); // P0(x)\n"))
    body = _joined(li, "l_suppkey", "l_partkey", call, "body")
    decl = _joined(li.select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", F.concat(F.lit("\tP"), "l_partkey", F.lit(" : FB_P"), "l_partkey", F.lit(";\n")), "members")
    name = F.concat(F.lit("CM_S"), "l_suppkey")
    return body.join(decl, "l_suppkey").select(*pou_file(name, F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n"), "members", F.lit("END_VAR\n")), F.col("body")))


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as units with a state machine over the changes of their orders' status."""
    o = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    change = o.select("o_custkey", F.lag("o_orderstatus").over(w).alias("a"), F.col("o_orderstatus").alias("b")).where("a <> b").distinct()
    lines = change.groupBy("o_custkey", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: F.concat(F.lit("\tIF __bTo"), b, F.lit(" THEN\n\t\teStatus := E_OrderStatus."), b, F.lit(";\n\tEND_IF\n"))), "").alias("x"))
    body = _joined(lines, "o_custkey", "a", F.concat(F.lit("E_OrderStatus."), "a", F.lit(":\n"), "x"), "body")
    name = F.concat(F.lit("FB_C"), "o_custkey")
    units = body.select(*pou_file(name, F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n\teStatus : E_OrderStatus;\nEND_VAR\n")), F.concat(F.lit("CASE eStatus OF\n"), "body", F.lit("END_CASE\n"))))
    t = o.select("o_orderstatus").distinct().agg(F.array_sort(F.collect_list("o_orderstatus")).alias("t"))
    members = F.array_join(F.transform("t", lambda x, i: F.concat(F.lit("\t"), x, F.lit(" := "), i)), ",\n")
    return units.union(t.select(*_file(F.lit("E_OrderStatus"), "TcDUT", F.concat(F.lit('<TcPlcObject><DUT Name="E_OrderStatus">'), _cdata("Declaration", F.concat(F.lit("TYPE E_OrderStatus :\n(\n"), members, F.lit("\n) INT;\nEND_TYPE\n"))), F.lit("</DUT></TcPlcObject>")))))


def packaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units with state handlers, commands, modes and state changes of PackML, each
    chosen by the part's key and its own place in the standard's tables."""
    k = F.col("p_partkey")
    here = lambda i, n: (k + i) % n == 0
    some = lambda rows: F.concat(*[F.when(cond, F.lit(text)).otherwise("") for cond, text in rows])
    handlers = F.concat(*[F.when(here(i, 3), method(f"_{s}", F.when(k % 2 == 0, "SUPER^.Run();").otherwise("nRun := 1;"))).otherwise("") for i, s in enumerate(packml.STATES)])
    declared = some([(here(i, 4), f"\t{c} : BOOL;\n") for i, (c, _) in enumerate(packml.COMMANDS)])
    commands = some([(here(i, 3), f"IF HMIPanel.{c} THEN nLast := {i}; END_IF\n") for i, (c, _) in enumerate(packml.COMMANDS)])
    modes = some([(here(i, 2), f"eMode := E_ModuleModes.{m};\n") for i, m in enumerate(packml.MODES)])
    moves = some([(here(i, 4), f"{'Execute' if a == 'Any' else a}:\n\t" + (f"_eState := E_State.{b};\n" if i % 2 else f"fbStates.GotoState(E_State.{b});\n")) for i, (a, b, _) in enumerate(packml.TRANSITIONS)])
    name = F.concat(F.lit("FB_M"), k)
    body = F.concat(commands, modes, some([(k % 5 == 0, "bAny := _AlarmsPresentProcess;\n")]), F.lit("CASE _eState OF\n"), moves, F.lit("END_CASE\n"))
    return _dealt(_t(spark, sf_dir, "part")).select(*pou_file(name, F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR_INPUT\n"), declared, F.lit("END_VAR\n")), body, handlers))


def io_files(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Events as bound variables, `size` of them in a list, and users as hardware boxes with
    links. Each file holds three boxes, one within the other, its links name their box; every
    fourth box has a file of its own, whose links don't."""
    e = _t(spark, sf_dir, "events").withColumn("g", F.expr(f"event_id div {size}"))
    at = F.when(F.col("event_type").isin("view", "click"), "%I*").when(F.col("event_type").isin("purchase", "error"), "%Q*").otherwise("%M*")
    decl = _joined(e, "g", "event_id", F.concat(F.lit("\tev"), "event_id", F.lit(" AT "), at, F.lit(" : BOOL;\n")), "x")
    name = F.concat(F.lit("GVL_IO"), "g")
    gvl = decl.select(*_file(name, "TcGVL", F.concat(F.lit('<TcPlcObject><GVL Name="'), name, F.lit('">'), _cdata("Declaration", F.concat(F.lit("VAR_GLOBAL\n"), "x", F.lit("END_VAR\n"))), F.lit("</GVL></TcPlcObject>"))))
    kind = e.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("value") >= 250, F.struct("event_id", "g"))).alias("on"), F.min("value").alias("least"))
    entry = F.concat(F.lit('<Pdo Name="'), "event_type", F.lit('" Index="#x1A00" InOut="0"><Entry Name="Input" Index="#x6000" Sub="1"><Type>'), F.when(F.col("least") < 50, "BOOL").otherwise("INT"), F.lit("</Type></Entry></Pdo>"))
    pdos = _joined(kind, "user_id", "event_type", entry, "pdos")
    box, nested = F.concat(F.lit("Box"), "user_id"), F.col("user_id") % 4 != 3
    link = F.concat(F.lit('<Link VarA="'), F.when(nested, F.concat(box, F.lit("^"))).otherwise(""), "event_type", F.lit('^Input" VarB="PlcTask Inputs^GVL_IO'), F.col("on.g"), F.lit(".ev"), F.col("on.event_id"), F.lit('"/>'))
    links = _joined(kind.where("on is not null"), "user_id", "event_type", link, "links")
    opened = F.concat(F.lit("<Box><Name>"), box, F.lit('</Name><EtherCAT Type="EL1008" Desc="EL1008" ProductCode="1">'), "pdos", F.lit("</EtherCAT>"))
    each = pdos.join(links, "user_id", "left").select("user_id", opened.alias("opened"), F.coalesce("links", F.lit("")).alias("links"), F.concat(F.lit("Boxes"), F.expr("user_id div 4"), F.when(nested, "").otherwise("b")).alias("file"))
    file = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("user_id", "opened", "links"))).alias("x"))  # three boxes at most
    content = F.concat(
        F.lit("<TcSmItem>"), F.array_join(F.transform("x", lambda x: x.opened), ""), F.repeat(F.lit("<After/></Box>"), F.size("x")), F.lit('<Mappings><OwnerA><OwnerB Name="TIID^Device 1">'), F.array_join(F.transform("x", lambda x: x.links), ""),
        F.lit("</OwnerB></OwnerA></Mappings></TcSmItem>"),
    )
    return gvl.union(file.select(*_file(F.col("file"), "xti", content)))


def placed_machines(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Customers as units with a wrapped machine over the changes of their orders' status: it
    begins with the first status, its transition state is the last by name; each instance is
    placed in one of the root lists of up to `size` instances."""
    o = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    change = o.select("o_custkey", F.lag("o_orderstatus").over(w).alias("a"), F.col("o_orderstatus").alias("b")).where("a <> b").distinct()
    state, key = lambda c: F.concat(F.lit("E_OrderStatus."), c), F.col("o_custkey")
    wait = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(", TimeoutNext := T#"), key % 50, F.lit("s")))
    goto = F.concat(F.lit("\tsmOrders.GotoState(StateNext := "), state(F.col("b")), wait, F.lit(");\n"))
    lines = change.groupBy("o_custkey", "a").agg(F.array_join(F.array_sort(F.collect_list(goto)), "").alias("x"))
    body = _joined(lines, "o_custkey", "a", F.concat(state(F.col("a")), F.lit(":\n"), "x"), "body")
    ends = o.groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("first"), F.max("o_orderstatus").alias("last"))
    name = F.concat(F.lit("FB_W"), key)
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n\tsmOrders : DM_StateMachine('Orders of "), key, F.lit("', "), state(F.col("first")), F.lit(", "), state(F.col("last")), F.lit(");\nEND_VAR\n"))
    units = body.join(ends, "o_custkey").select(*pou_file(name, decl, F.concat(F.lit("CASE smOrders.State OF\n"), "body", F.lit("END_CASE\n"))))
    placed = _joined(body.withColumn("g", F.expr(f"o_custkey div {size}")), "g", "o_custkey", F.concat(F.lit("\tW"), key, F.lit(" : "), name, F.lit(";\n")), "x")
    root = F.concat(F.lit("Objects"), "g")
    roots = placed.select(*_file(root, "TcGVL", F.concat(F.lit('<TcPlcObject><GVL Name="'), root, F.lit('">'), _cdata("Declaration", F.concat(F.lit("VAR_GLOBAL\n"), "x", F.lit("END_VAR\n"))), F.lit("</GVL></TcPlcObject>"))))
    return units.union(roots).union(machines(spark, sf_dir).where("ext = 'tcdut'"))


def library_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    ref = F.concat(F.lit('<PlaceholderReference Include="Lib'), "n_nationkey", F.lit('"><DefaultResolution>Lib'), "n_nationkey", F.lit(", 1."), "n_nationkey", F.lit(".0 (Vendor"), "n_regionkey", F.lit(")</DefaultResolution><Namespace>NS"), "n_nationkey", F.lit("</Namespace></PlaceholderReference>"))
    one = n.withColumn("one", F.lit(1))
    return _joined(one, "one", "n_nationkey", ref, "x").select(*_file(F.lit("Virtual"), "plcproj", F.concat(F.lit("<Project><PropertyGroup><RootNamespace>Virtual</RootNamespace></PropertyGroup><ItemGroup>"), "x", F.lit("</ItemGroup></Project>"))))


def drive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as drives: a channel with a group and a block for each kind of their events. Every
    fifth channel has no id; every seventh file is cut. Projects list up to 100 drives each."""
    u = F.col("user_id")
    kind = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    one = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    group = F.concat(
        F.lit("<Group><!-- <Group> -->"), one("Name", F.col("event_type")), F.lit("<Parameter><PropertyName>count</PropertyName><Value>"), F.col("n"), F.lit("</Value></Parameter><Unused><Void/></Unused>"),
        F.lit('<d:Block Id="'), F.col("n"), F.lit('" Note="">'), one("Limit", F.concat(F.lit("&lt;"), F.col("n") * 2)), F.lit("</d:Block><SerialNr><Block Id='9'/></SerialNr></Group>"),
    )
    drive = F.concat(F.lit('<TcDMDrive><OrderCode>AX'), u, F.lit("</OrderCode><Name>Axis</Name><Channel ChnId=\""), F.when(u % 5 == 0, "").otherwise(F.concat(F.lit("C"), u % 3)), F.lit('">'), F.col("groups"), F.lit("</Channel><Idle><Mode></Mode></Idle></TcDMDrive>"))
    link = F.concat(F.lit("<TcLink>"), one("TcPrjPath", F.concat(F.lit("..\\line\\"), u, F.lit(".tsproj"))), one("IoItemPathName", F.concat(F.lit("TIID^Drive "), u)), F.lit("</TcLink>"))
    content = F.concat(F.lit('<?xml version="1.0"?>\n<Item xmlns:d="urn:d">'), one("ItemName", F.concat(F.lit("Drive "), u)), one("ItemId", u), drive, link, F.when(u % 7 == 3, "").otherwise("</Item>"))
    drives = _joined(kind, "user_id", "event_type", group, "groups").select("user_id", content.alias("content"))
    files = drives.select(*_file(F.concat(F.lit("Drive"), u), "tcdmdrv", F.col("content")))
    entry = F.concat(F.lit('<Content Include="Sub\\Drive'), u, F.lit('.tcdmdrv">'), F.when(u % 2 == 0, F.concat(F.lit("<DependentUpon>P.tcdmproj</DependentUpon><IoItemPathName>TIID^"), u, F.lit("</IoItemPathName>"))).otherwise(""), F.lit("</Content>"))
    project = _joined(kind.select("user_id", F.expr("user_id div 100").alias("g")).distinct(), "g", "user_id", entry, "x")
    return files.union(project.select(*_file(F.concat(F.lit("Drives"), "g"), "tcdmproj", F.concat(F.lit("<Project><SchemaVersion>2.0</SchemaVersion>"), "x", F.lit("</Project>")))))


def constructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units whose variables have constructors and values with brackets in brackets."""
    p = _dealt(_t(spark, sf_dir, "part"))
    k, name = F.col("p_partkey"), F.concat(F.lit("FB_K"), "p_partkey")
    line = lambda *parts: F.concat(F.lit("\t"), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit(";\n"))
    decl = F.concat(
        F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n"), line("fbSize : FB_Size(nSize := MAX(MIN(ABS(-(", F.col("p_size"), ")), 99), 1), nKey := ", k, ")"),
        line("rRate : LREAL := SCALE((nA + 1) * (", k, "), 2)"), line("aRows : ARRAY [0..(", k, ")] OF FB_Row(nRow := (1 + (2)))"), line("sText : STRING(", k, ") := CONCAT('a', UPPER('b'))"), F.lit("END_VAR\n"),
    )
    return p.select(*pou_file(name, decl, F.lit("")))


def linked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units, a project for each brand, with equal unit names in all of them: the
    part of place i in its brand calls those of places 2i + 1 and 2i + 2, and every tenth its
    own number's half again."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    part = _t(spark, sf_dir, "part")
    p = _dealt(part.select("p_brand", place.alias("i"), F.count(F.lit(1)).over(Window.partitionBy("p_brand")).alias("n")), part)
    to = F.filter(F.array(F.col("i") * 2 + 1, F.col("i") * 2 + 2, F.when(F.col("i") % 10 == 0, (F.col("i") / 2).cast("int"))), lambda x: x < F.col("n"))
    call = lambda head, tail: F.array_join(F.transform(F.array_distinct(to), lambda x: F.concat(F.lit(head), x.cast("string"), tail(x))), "")
    name = F.concat(F.lit("FB_L"), "i")
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, F.lit("\nVAR\n"), call("\tl", lambda x: F.concat(F.lit(" : FB_L"), x.cast("string"), F.lit(";\n"))), F.lit("END_VAR\n"))
    return p.select("p_brand", *pou_file(name, decl, call("l", lambda x: F.lit("();\n")))).withColumn("project_id", F.col("p_brand")).drop("p_brand")


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units that break rules, a project for each brand: variables bound to hardware
    and of an abstract type, overrides that return something else, interfaces half kept, long
    methods, unknown parents; every tenth part has a control module without alarms."""
    p = _dealt(_t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k")))
    k, name = F.col("k"), F.concat(F.lit("FB_D"), "k")
    count = lambda n: F.filter(F.array(*[F.lit(i) for i in range(8)]), lambda i: i < n)
    each = lambda n, head, tail: F.array_join(F.transform(count(n), lambda i: F.concat(F.lit(head), i.cast("string"), F.lit(tail))), "")
    head = F.concat(F.when(k % 3 == 0, " EXTENDS FB_DBase").when(k % 3 == 1, F.concat(F.lit(" EXTENDS FB_U"), k % 13)).otherwise(""), F.when(k % 4 == 1, " IMPLEMENTS I_D, I_E").otherwise(""))
    decl = F.concat(F.lit("FUNCTION_BLOCK "), name, head, F.lit("\nVAR\n"), each(k % 8, "\tbIn", " AT %I* : BOOL;\n"), each(k % 6, "\t_fb", " : FB_DBase;\n"), F.lit("END_VAR\n"))

    def methods(n: Column, name: str, gives: str, body: Column) -> Column:
        one = lambda i: F.concat(F.lit(f'<Method Name="{name}'), i, F.lit('">'), _cdata("Declaration", F.concat(F.lit(f"METHOD PUBLIC {name}"), i, F.lit(f" : {gives}\n"))), F.lit("<Implementation>"), _cdata("ST", body), F.lit("</Implementation></Method>"))
        return F.array_join(F.transform(count(n), lambda i: one(i.cast("string"))), "")

    none = F.lit("")
    own = F.concat(methods(F.when(k % 3 == 0, k % 7).otherwise(0), "Run", "DINT", none), methods(F.when(k % 4 == 1, k % 7).otherwise(0), "Go", "DINT", none), methods(F.when(k % 5 == 0, 1).otherwise(0), "Long", "BOOL", F.repeat(F.lit("nX := 1;\n"), 160)))
    units = p.select("p_brand", *pou_file(name, decl, F.lit(""), own))
    control = F.concat(F.lit("CM_D"), "k")
    controls = p.where(k % 10 == 0).select("p_brand", *pou_file(control, F.concat(F.lit("FUNCTION_BLOCK "), control, F.lit("\n")), F.lit("")))
    brand = p.select("p_brand").distinct()
    base = brand.select("p_brand", *pou_file(F.lit("FB_DBase"), F.lit("FUNCTION_BLOCK ABSTRACT FB_DBase\n"), F.lit(""), methods(F.lit(7), "Run", "INT", none)))
    kept = brand.select("p_brand", *pou_file(F.lit("I_D"), F.lit("INTERFACE I_D\n"), F.lit(""), methods(F.lit(7), "Go", "DINT", none)))
    return units.union(controls).union(base).union(kept).withColumn("project_id", F.col("p_brand")).drop("p_brand")


def safety_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as safety logic with diagrams and alias devices, a safety project for up to
    100 of them. Some logic is cut or isn't there; files of other kinds lie beside them."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("s_suppkey div 100").alias("g"), F.lit(PROJECT).alias("project_id"))
    k, text = F.col("k"), lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    join = lambda *parts: F.concat(*[text(x) for x in parts])
    file = lambda rows, path, ext, *parts: rows.select("project_id", path.alias("path"), F.lit(ext).alias("ext"), join(*parts).alias("content"))
    at = lambda *parts: join("Safety", F.col("g"), "/", *parts)
    network = F.repeat(F.lit("<a:Network><functionBlocks><inPort/><inPort><x/></inPort><OutPort></OutPort></functionBlocks></a:Network>"), (k % 5).cast("int"))
    logic = file(s.where("k % 6 <> 1"), at("Logic/A", k, ".sal"), "sal", '<App xmlns:a="urn:a" name=" App ', k, ' " dslVersion="1.', k % 4, '">', network, F.when(k % 7 == 3, "").otherwise("</App>"))
    shapes = F.repeat(F.lit("<networkSwimLane><inPortShape/><outportshape/><fbShape/><fbMonikerShape/></networkSwimLane>"), (k % 3).cast("int"))
    diagram = file(s.where("k % 3 <> 0"), at("Logic/A", k, ".sal.diagram"), "diagram", "<d:view xmlns:d='u'>", shapes, "</d:view>")
    io = F.array_join(F.transform(F.filter(F.array(*[F.lit(i) for i in range(4)]), lambda i: i < k % 4), lambda i: join("<IO><Name>In", i, "</Name><DataType>BOOL</DataType><BitSize>1</BitSize><BitOffsMessage>", i, "</BitOffsMessage></IO>")), "")
    device = file(s, at("Alias/D", k, ".sds"), "sds", '<Dev FileFormatVersion="3"><Name>Device ', k, "</Name><SDSID>", k + 1000, "</SDSID><Type>", k % 9, "</Type>", io, "<IO/></Dev>")
    entry = join('<None Include="Logic\\A', k, '.sal"/><None Include="logic\\a', k, '.sal"/><None Include="Alias\\D', k, '.sds"></None>')
    project = _joined(s, "g", "k", entry, "x").withColumn("project_id", F.lit(PROJECT))
    build = file(project, at("Line.splcproj"), "splcproj", '<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><SchemaVersion>2.', F.col("g"), "</SchemaVersion>", F.col("x"), '<None Include="Target.xml"/></Project>')
    target = file(project, at("Target.xml"), "xml", "<?xml version='1.0'?><!-- <x> --><TargetSystemConfig><FSOEAddress>", F.col("g"), "</FSOEAddress></TargetSystemConfig>")
    other = file(project, at("Other.xml"), "xml", "<Other><TargetSystemConfig/></Other>").union(file(project, join("Plain/T", F.col("g"), ".xml"), "xml", "<TargetSystemConfig/>"))
    return logic.union(diagram).union(device).union(build).union(target).union(other)
