"""IO bound to addresses, hardware channels with their links, and both reconciled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx

_PDO = "array<struct<_Name: string, _Index: string, _InOut: string, Entry: array<struct<_Name: string, _Index: string, _Sub: string, Type: string, _BitLen: int>>>>"
BOX = f"Name string, EtherCAT struct<_Type: string, _Desc: string, _ProductCode: string, Pdo: {_PDO}>"
LINKS = "Link array<struct<_VarA: string, _VarB: string>>"
#: Bits by type, and safety terminals by the beginning of their order code.
BITS = {"BIT": 1, "BOOL": 1, "BIT2": 2, "BYTE": 8, "USINT": 8, "SINT": 8, "WORD": 16, "UINT": 16, "INT": 16, "DWORD": 32, "UDINT": 32, "DINT": 32, "LWORD": 64, "ULINT": 64, "LINT": 64}
#: Parts of the names of signals that say how a terminal does.
NOISE = ("sync error", "txpdo toggle", "txpdo state", "wcstate", "infodata", "toggle")
SAFETY = ("EL1904", "EL2904", "EL6910", "EL1918", "EL2911", "EL6900", "EL1957")


def io_map(variable: DataFrame, all_variable: DataFrame) -> DataFrame:
    """project_id, variable, data_type, at_binding, source_kind, source, comment, direction:
    bound variables of lists, then of each unit with what it inherits."""
    lists = variable.where("owner_kind = 'gvl' and at_binding is not null").select("project_id", F.col("name").alias("variable"), "data_type", "at_binding", F.lit("gvl").alias("source_kind"), F.col("owner").alias("source"), "comment")
    units = all_variable.where("at_binding is not null").select("project_id", F.col("name").alias("variable"), "data_type", "at_binding", F.lit("pou").alias("source_kind"), F.col("pou").alias("source"), "comment")
    return lists.union(units).withColumn("direction", fx.direction(F.col("at_binding")))


def io_of_instances(mapped: DataFrame, node: DataFrame, chain: DataFrame) -> DataFrame:
    """The bound variables of each instance, by its type or any of its type's ancestors; an
    inherited one counts once for each variable and address."""
    types = node.select("project_id", "path", "type_lc").join(chain.where("not cyclic").select("project_id", F.col("pou_lc").alias("type_lc"), "ancestor_lc"), ["project_id", "type_lc"], "left")
    sources = types.select("project_id", "path", F.col("type_lc").alias("source_lc")).union(types.where("ancestor_lc is not null").select("project_id", "path", "ancestor_lc")).distinct()
    units = mapped.where("source_kind = 'pou'").withColumn("source_lc", F.lower("source"))
    return sources.join(units, ["project_id", "source_lc"]).dropDuplicates(["project_id", "path", "variable", "at_binding"]).select("project_id", "path", "variable", "data_type", "at_binding", "direction")


def box_texts(files: DataFrame) -> DataFrame:
    """project_id, path, seq, parent_seq, level, text of every box of the .xti files, at any
    depth: its own text without the boxes inside it, and the box that holds it.

    A file is cut before each opening and behind each closing tag. The running depth says how
    many boxes are open in a piece; it belongs to the last box opened at that depth. The parent
    is the last box opened one level up, an as-of join of the opening pieces with themselves."""
    text = F.regexp_replace(fx.safe_xml(F.col("content")), r"<Box(\s[^<>]*+)?(?<=/)>", "<Box></Box>")  # an empty box
    piece = files.where("ext = 'xti'").select("project_id", "path", F.posexplode(F.split(text, r"(?=<Box[\s>])|(?<=</Box>)")).alias("seq", "piece"))
    opens, closes = F.col("piece").rlike(r"^<Box[\s>]"), F.col("piece").endswith("</Box>")
    by = Window.partitionBy("project_id", "path").orderBy("seq")
    before = F.coalesce(F.sum(closes.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = piece.withColumn("opens", opens).withColumn("level", F.sum(opens.cast("int")).over(by) - before).where("level > 0")
    at_level = Window.partitionBy("project_id", "path", "level").orderBy("seq")
    piece = piece.withColumn("of", F.last(F.when(F.col("opens"), F.col("seq")), ignorenulls=True).over(at_level))
    own = piece.groupBy("project_id", "path", F.col("of").alias("seq")).agg(F.min("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x.piece), "").alias("text"))
    start = own.select("project_id", "path", "seq", "level")
    asked = start.select("project_id", "path", "seq", F.lit(None).cast("int").alias("opened"), (F.col("level") - 1).alias("level")).union(start.select("project_id", "path", "seq", F.col("seq"), "level"))
    parent = asked.withColumn("parent_seq", F.last("opened", ignorenulls=True).over(at_level)).where("opened is null").select("project_id", "path", "seq", "parent_seq")
    return own.join(parent, ["project_id", "path", "seq"])


def boxes(files: DataFrame) -> DataFrame:
    """project_id, path, box, parent, level, sku, description, product_code, pdos, is_coupler,
    is_safety of the boxes at any depth; one without a name has its file's."""
    x = box_texts(files).withColumn("b", F.from_xml("text", BOX, {"mode": "PERMISSIVE", "rowTag": "Box"}))
    named = F.nullif(fx.strip(F.coalesce(F.col("b.Name"), F.lit(""))), F.lit(""))
    name = F.when(named.isNull() | (named == "__FILENAME__"), F.regexp_extract("path", r"([^/]*?)(?:\.\w+)?$", 1)).otherwise(named)
    sku = F.upper(F.regexp_extract(F.coalesce(F.col("b.EtherCAT._Type"), F.col("b.EtherCAT._Desc")), r"([A-Za-z]{2}\d{3,4})", 1))
    x = x.withColumn("box", name)
    parent = x.select("project_id", "path", F.col("seq").alias("parent_seq"), F.col("box").alias("parent"))
    x = x.join(parent, ["project_id", "path", "parent_seq"], "left")
    safe = F.exists(F.array(*[F.lit(s) for s in SAFETY]), lambda s: F.coalesce(sku, F.lit("")).startswith(s))
    return x.select("project_id", "path", "box", "parent", "level", sku.alias("sku"), F.col("b.EtherCAT._Desc").alias("description"), F.col("b.EtherCAT._ProductCode").alias("product_code"), F.col("b.EtherCAT.Pdo").alias("pdos"), sku.startswith("EK").alias("is_coupler"), safe.alias("is_safety"))


def merged_boxes(box: DataFrame) -> DataFrame:
    """Boxes of several files by order code, product and name: the one with more channels
    stays, with all the files."""
    n = F.coalesce(F.aggregate("pdos", F.lit(0), lambda a, p: a + F.size(p.Entry)), F.lit(0))
    keys = ["project_id", "sku", "product_code", "box"]
    return box.withColumn("n_entries", n).groupBy(*keys).agg(F.max_by(F.struct("path", "description", "pdos", "is_coupler", "is_safety"), F.struct("n_entries", "path")).alias("b"), F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("files")).select(*keys, "b.*", "files")


def channels(box: DataFrame) -> DataFrame:
    """project_id, box, sku, channel, signal, data_type, bits, direction, is_primary, coe_index,
    is_safety, files, ord."""
    kept = ["project_id", "box", "sku", "is_safety", "files"]
    e = box.select(*kept, F.posexplode("pdos").alias("p", "pdo")).select(*kept, "p", "pdo", F.posexplode("pdo.Entry").alias("e", "entry"))
    e = e.where("entry._Name is not null and entry._Name <> ''")  # fillers have no name and take no place
    written = F.coalesce("entry._Index", F.lit(""))
    index, signal = F.regexp_replace(F.lower(written), "#x|0x", ""), F.lower("entry._Name")
    by_name = F.when(signal.contains("output"), "Output").when(signal.contains("input"), "Input")
    way = F.when(index.startswith("6"), "Input").when(index.startswith("7"), "Output").otherwise(F.coalesce(by_name, F.when(F.col("pdo._InOut") == "1", "Output"), F.lit("Unknown")))
    quiet = F.exists(F.array(*[F.lit(x) for x in NOISE]), lambda x: signal.contains(x)) | signal.startswith("status")
    kind = F.upper("entry.Type")
    table = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])
    w = Window.partitionBy("project_id", "box").orderBy("p", "e")
    return e.select(
        "project_id", "box", "sku", F.col("pdo._Name").alias("channel"), F.col("entry._Name").alias("signal"), kind.alias("data_type"), F.coalesce("entry._BitLen", table[kind]).alias("bits"), way.alias("direction"),
        ((written != "") & ~quiet).alias("is_primary"), written.alias("coe_index"), "is_safety", "files", (F.row_number().over(w) - 1).alias("ord"),
    )


def links(files: DataFrame, box: DataFrame) -> DataFrame:
    """project_id, box, channel, signal, symbol: the last link of each signal, .xti files first.

    A link's own side is a path. Where it begins with the name of a box that the project has,
    that is the box; else the path is within its file's box, if the file has one alone. Other
    links name no box and are left out, as are those of a whole channel."""
    found = F.regexp_extract_all(fx.safe_xml(F.col("content")), F.lit(r"<Link\s[^<>]*+>"), F.lit(0))
    closed = F.array_join(F.transform(found, lambda x: F.concat(F.rtrim(x, F.lit("/>")), F.lit("/>"))), "")
    parsed = files.where("ext in ('xti', 'tsproj')").select("project_id", "path", (F.col("ext") == "tsproj").alias("late"), F.from_xml(F.concat(F.lit("<r>"), closed, F.lit("</r>")), LINKS, {"mode": "PERMISSIVE"}).Link.alias("links"))
    part, other = F.split("l._VarA", r"\^"), F.split("l._VarB", r"\^")
    each = parsed.select("project_id", "path", "late", F.posexplode("links").alias("seq", "l")).where(F.col("l._VarB") != "")
    symbol = F.array_join(F.when((F.size(other) >= 2) & F.lower(other[0]).startswith("plctask"), F.slice(other, 2, 1 << 30)).otherwise(other), ".")
    each = each.select("project_id", "path", "late", "seq", part.alias("part"), symbol.alias("symbol")).where("size(part) >= 2").withColumn("first_lc", F.lower(F.col("part")[0]))
    known = box.groupBy("project_id", F.lower("box").alias("first_lc")).agg(F.min("box").alias("known"))
    alone = box.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("box").alias("alone")).where("n = 1")
    rows = each.join(known, ["project_id", "first_lc"], "left").join(alone, ["project_id", "path"], "left")
    skip = F.when(F.col("known").isNotNull(), 1).otherwise(0)
    rows = rows.select("project_id", "path", "late", "seq", F.coalesce("known", "alone").alias("box"), F.get("part", skip).alias("channel"), F.array_join(F.slice("part", skip + 2, F.size("part")), "^").alias("signal"), "symbol").where("box is not null and signal <> ''")
    return rows.groupBy("project_id", "box", "channel", "signal").agg(F.max_by("symbol", F.struct("late", F.lower("path"), "path", "seq")).alias("symbol"))


def unified(channel: DataFrame, link: DataFrame, mapped: DataFrame, variable: DataFrame, all_variable: DataFrame) -> DataFrame:
    """project_id, row_kind, variable, data_type, address, direction, sku, box, channel, signal,
    coe_index, comment, provenance: linked channels with the declaration of their symbol,
    spare digital channels, and bound variables that no channel is linked to.

    A symbol names a declaration of a list or a unit by its full name, or by its last part;
    lists go before units, and of one kind the first by name does."""
    what = ["data_type", "at_binding", "comment"]
    of_lists = variable.where("owner_kind = 'gvl'").select("project_id", F.lit(0).alias("rank"), F.col("owner_lc").alias("of_lc"), "name_lc", "ord", *what)
    decl = of_lists.union(all_variable.select("project_id", F.lit(1), F.col("pou_lc"), "name_lc", "ord", *what))
    first = F.min_by(F.struct(*what), F.struct("rank", "of_lc", "ord"))
    full = decl.groupBy("project_id", F.concat_ws(".", "of_lc", "name_lc").alias("full_lc")).agg(first.alias("f"))
    bare = decl.groupBy("project_id", F.col("name_lc").alias("bare_lc")).agg(first.alias("b"))
    keys = ["project_id", "box", "channel", "signal"]
    joined = channel.join(link, keys, "left").withColumn("full_lc", F.lower("symbol")).withColumn("bare_lc", F.lower(fx.last_segment(F.col("symbol"))))
    text = lambda c: F.coalesce(c, F.lit(""))
    known = lambda c: F.when(c == "Unknown", "").otherwise(c)
    # a signal in two alternative PDOs is one
    on = joined.where("symbol <> ''").dropDuplicates([*keys, "full_lc"])
    found = on.join(full, ["project_id", "full_lc"], "left").join(bare, ["project_id", "bare_lc"], "left").withColumn("d", F.coalesce("f", "b"))
    at = text(F.col("d.at_binding"))
    linked = found.select(
        "project_id", F.lit("linked").alias("row_kind"), F.col("symbol").alias("variable"), F.coalesce("d.data_type", found.data_type).alias("data_type"), at.alias("address"),
        known(F.when(F.col("d").isNotNull(), fx.direction(at)).otherwise(F.col("direction"))).alias("direction"), text("sku").alias("sku"), "box", "channel", "signal", "coe_index", fx.strip(text("d.comment")).alias("comment"), F.col("files").alias("provenance"),
    )
    none = F.lit("")
    digital = F.lower("signal").isin("input", "output") & F.col("data_type").isin("BIT", "BOOL")
    spare = joined.where(F.col("symbol").isNull() | (F.col("symbol") == "")).where(F.col("is_primary") & digital).select(
        "project_id", F.lit("unused-channel"), none, "data_type", none, known(F.col("direction")), text("sku"), "box", "channel", "signal", "coe_index", none,
        F.concat("files", F.when(F.col("is_safety"), " (safety / FSOE-mapped)").otherwise("")),
    )
    used = on.select("project_id", F.explode(F.array("full_lc", "bare_lc")).alias("k")).distinct()
    soft = mapped.withColumn("symbol", F.concat_ws(".", "source", "variable"))
    for name in ("symbol", "variable"):
        soft = soft.join(used.select("project_id", F.col("k").alias("used_lc")), (soft["project_id"] == used["project_id"]) & (F.lower(soft[name]) == F.col("used_lc")), "left_anti")
    rest = soft.select("project_id", F.lit("software-only"), "symbol", "data_type", F.col("at_binding"), "direction", none, none, none, none, none, fx.strip(text("comment")), F.lit("PLC declaration (no hardware link)"))
    return linked.union(spare).union(rest)


def fingerprint_symbols(variable: DataFrame, n: int = 10) -> DataFrame:
    """The first n plain scalar variables of each project's lists, by name."""
    scalars = ("BOOL BYTE WORD DWORD LWORD SINT USINT INT UINT DINT UDINT LINT ULINT REAL LREAL STRING WSTRING TIME LTIME TIME_OF_DAY TOD DATE DATE_AND_TIME DT").split()
    plain = variable.where("owner_kind = 'gvl' and scope <> 'Constant' and not is_reference and not is_pointer and not is_array").where(F.upper(fx.base_type(F.col("data_type"))).isin(*scalars))
    return plain.select("project_id", F.concat_ws(".", "owner", "name").alias("symbol"), "data_type").withColumn("k", F.row_number().over(Window.partitionBy("project_id").orderBy(F.lower("symbol"), "symbol"))).where(F.col("k") <= (n if n > 0 else 10)).drop("k")
