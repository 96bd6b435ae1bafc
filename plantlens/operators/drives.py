"""Drive projects and drives: what they name, and the drives' sections and parameters.

Sections are elements below the drive; what is inside of what is a comparison of intervals
(see elements), names along the path are a recursive CTE over the parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.operators import closure
from plantlens.operators.elements import FILE, attribute, attributes, elements, first_inside, first_of

#: Elements that are no sections (fixed values).
SKIPPED = ("SortId", "DriveModuleType", "OrderCode", "Name", "FirmwareVersion", "BootloaderVersion", "CatalogNo", "HardwareVersion", "SerialNr", "ProductRevision", "HasDualUseInfo", "OperatingFrequencyLimitation")


def rows(files: DataFrame) -> DataFrame:
    """project_id, path, seq, last_seq, parent_seq, level, kind (section or parameter), name,
    value, attributes of what the first drive of each file holds.

    A leaf with text, or a Parameter with a PropertyName, is a parameter of the section that
    holds it. Directly below the drive everything is a section. A section stays if it or one
    inside of it has an attribute, a parameter or text; a text alone is its own parameter."""
    e = elements(files.where("ext = 'tcdmdrv'"))
    by = Window.partitionBy(*FILE).orderBy("seq")
    ahead = Window.partitionBy(*FILE).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    drive = F.min(F.when((F.lower("name") == "tcdmdrive") & (F.col("depth") > 1), F.struct("seq", "last_seq", "depth"))).over(Window.partitionBy(*FILE))
    e = e.withColumn("drive", drive).where("seq > drive.seq and last_seq <= drive.last_seq")
    e = e.withColumn("level", F.col("depth") - F.col("drive.depth")).withColumn("property", first_inside("PropertyName")).withColumn("given", first_inside("Value")).withColumn("called", first_inside("Name"))
    name = F.lower("name")
    e = e.withColumn("gives", F.when(name == "parameter", F.col("property").isNotNull()).otherwise(F.col("is_leaf") & (F.col("value") != "")))
    skipped = name.isin(*[x.lower() for x in SKIPPED])
    e = e.withColumn("shut", F.when(F.col("level") == 1, skipped).otherwise(F.col("gives") | skipped))
    # inside of an element that is no section: some such one began earlier and ends later
    under = F.max(F.when(F.col("shut"), F.col("last_seq"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("under", F.coalesce(under > F.col("seq"), F.lit(False))).where(~F.col("under"))
    e = e.withColumn("kind", F.when(~F.col("shut"), "section").when((F.col("level") > 1) & F.col("gives"), "parameter")).where("kind is not null")
    listed = F.transform(F.array_sort(F.transform(F.filter(attributes(), lambda a: a["value"] != ""), lambda a: F.struct(F.lower(a["name"]).alias("k"), a["name"].alias("n"), a["value"].alias("v")))), lambda a: F.concat(a.n, F.lit("="), a.v))
    e = e.withColumn("attributes", F.when(F.col("kind") == "section", listed))
    filled = (F.col("kind") == "parameter") | (F.size("attributes") > 0) | (F.col("text") != "")
    inside = F.coalesce(F.last(F.when(filled, F.col("seq")), ignorenulls=True).over(ahead) <= F.col("last_seq"), F.lit(False))
    e = e.withColumn("inside", inside).where((F.col("kind") == "parameter") | F.col("inside") | (F.size("attributes") > 0) | (F.col("text") != ""))
    id_ = F.when(name == "channel", attribute("ChnId")).when(name == "block", attribute("Id")).otherwise("")
    title = F.when(id_ != "", F.concat("name", F.lit(" "), id_)).when(F.col("called").isNotNull() & (F.lower("called") != name), F.concat("name", F.lit(": "), "called")).otherwise(F.col("name"))
    fixed = F.when(name == "channel", F.regexp_replace(title, "^(?i:channel) ", "Channel ")).when(name == "block", F.regexp_replace(title, "^(?i:block) ", "Block ")).otherwise(title)
    section = F.col("kind") == "section"
    value = F.when(section, F.when(~F.col("inside"), F.nullif("text", F.lit("")))).when(name == "parameter", F.coalesce("given", F.lit("-"))).otherwise(F.col("value"))
    shown = F.when(section, fixed).when(name == "parameter", F.col("property")).otherwise(F.col("name"))
    return e.select(*FILE, "seq", "last_seq", "parent_seq", "level", "kind", shown.alias("name"), F.col("name").alias("element"), value.alias("value"), "attributes")


def sections(row: DataFrame) -> DataFrame:
    """project_id, path, seq, parent_seq, level, name, section_path, attributes of the sections
    of rows()."""
    s = row.where("kind = 'section'").select(*FILE, "seq", "parent_seq", "level", "name", "attributes")
    named = closure._sql(
        row.sparkSession,
        """WITH RECURSIVE t(project_id, path, seq, section_path) MAX RECURSION LEVEL 1000 AS (
             SELECT project_id, path, seq, name FROM {s} WHERE level = 1
             UNION ALL
             SELECT t.project_id, t.path, s.seq, concat(t.section_path, '/', s.name)
             FROM t JOIN {s} s ON t.project_id = s.project_id AND t.path = s.path AND t.seq = s.parent_seq)
           SELECT * FROM t""",
        s=s,
    )
    return s.join(named, [*FILE, "seq"])


def parameters(row: DataFrame, section: DataFrame) -> DataFrame:
    """project_id, path, section_path, ord (within the section), name, value."""
    of = F.when(F.col("kind") == "section", F.col("seq")).otherwise(F.col("parent_seq"))
    called = F.when(F.col("kind") == "section", F.col("element")).otherwise(F.col("name"))
    p = row.where("kind = 'parameter' or value is not null").select(*FILE, of.alias("of"), F.col("seq").alias("at"), called.alias("name"), "value")
    joined = p.join(section.select(*FILE, F.col("seq").alias("of"), "section_path"), [*FILE, "of"])
    return joined.withColumn("ord", F.row_number().over(Window.partitionBy(*FILE, "of").orderBy("at")) - 1).select(*FILE, "section_path", "ord", "name", "value")


def _stem(path: str = "path"):  # noqa: ANN202
    return F.regexp_extract(path, r"([^/]*?)(?:\.\w+)?$", 1)


def _path(text):  # noqa: ANN001, ANN202
    return F.nullif(fx.strip(F.replace(text, F.lit("\\"), F.lit("/"))), F.lit(""))


def drives(files: DataFrame) -> DataFrame:
    """project_id, path, name, status (Parsed or ParseFailed), item_id, item_subtype,
    child_count, drive_module_type, order_code, io_item_path, project_path of each drive file."""
    ours = files.where("ext = 'tcdmdrv'")
    e = elements(ours)
    first = lambda tag: F.min(F.when((F.lower("name") == tag) & (F.col("depth") > 1), F.struct("seq", "last_seq"))).over(Window.partitionBy(*FILE))
    e = e.withColumn("drive", first("tcdmdrive")).withColumn("link", first("tclink"))
    within = lambda c: (F.col("seq") > F.col(f"{c}.seq")) & (F.col("last_seq") <= F.col(f"{c}.last_seq"))
    found = e.groupBy(*FILE).agg(
        first_of("ItemName").alias("item_name"), first_of("ItemId").alias("item_id"), first_of("ItemSubTypeName").alias("item_subtype"), first_of("ChildCount").alias("child_count"),
        first_of("DriveModuleType", within("drive")).alias("drive_module_type"), first_of("OrderCode", within("drive")).alias("order_code"),
        first_of("IoItemPathName", within("link")).alias("io_item_path"), _path(first_of("TcPrjPath", within("link"))).alias("project_path"), F.lit("Parsed").alias("status"),
    )
    return ours.select(*FILE).join(found, FILE, "left").select(*FILE, F.coalesce("item_name", _stem()).alias("name"), F.coalesce("status", F.lit("ParseFailed")).alias("status"), "item_id", "item_subtype", "child_count", "drive_module_type", "order_code", "io_item_path", "project_path")


def projects(files: DataFrame) -> DataFrame:
    """project_id, path, name, status, schema_version, n_included, n_dependents, n_io_paths,
    related (the included paths, the first of each in any case, in order) of each drive
    project file."""
    ours = files.where("ext = 'tcdmproj'")
    e = elements(ours).withColumn("dependent", _path(first_inside("DependentUpon"))).withColumn("io", first_inside("IoItemPathName"))
    content = (F.lower("name") == "content") & (F.col("depth") > 1)
    e = e.withColumn("include", F.when(content, _path(attribute("Include"))))
    found = e.groupBy(*FILE).agg(
        first_of("Name").alias("own_name"), first_of("SchemaVersion").alias("schema_version"), F.count("include").alias("n_included"),
        F.count(F.when(content, F.col("dependent"))).alias("n_dependents"), F.count(F.when(content, F.col("io"))).alias("n_io_paths"),
        F.array_sort(F.collect_list(F.when(F.col("include").isNotNull(), F.struct("seq", "include")))).alias("inc"), F.lit("Parsed").alias("status"),
    )
    lower = F.transform("inc", lambda x: F.lower(x.include))
    related = F.transform(F.filter("inc", lambda x, i: F.array_position(lower, F.lower(x.include)) == i + 1), lambda x: x.include)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ours.select(*FILE).join(found, FILE, "left").select(*FILE, F.coalesce("own_name", _stem()).alias("name"), F.coalesce("status", F.lit("ParseFailed")).alias("status"), "schema_version", zero("n_included"), zero("n_dependents"), zero("n_io_paths"), F.coalesce(related, F.array().cast("array<string>")).alias("related"))
