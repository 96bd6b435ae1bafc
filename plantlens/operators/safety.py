"""Artefacts of safety projects: what they are, what they count, and which files they name.

Elements of all files come from one pass (see elements) and are counted by file. What a
project or a diagram names is joined to the files that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.operators.elements import FILE, attribute, elements, first_inside, first_of

#: Parts of folder names, the root of a configuration, the namespace of a project.
FOLDERS = ("safety", "splc", "twinsafe")
ROOT = "TargetSystemConfig"
BUILD = "http://schemas.microsoft.com/developer/msbuild/2003"
#: What the metadata of each kind are called, with the element they come from.
TOLD = {
    "SafetyProject": {"schema-version": "SchemaVersion", "target-system": "TargetSystem", "programming-language": "ProgrammingLanguage"},
    "SafetyAliasDevice": {"alias-type": "Type", "alias-subtype": "SubType", "vendor-id": "VendorId"},
    "SafetyConfiguration": {"target-system-type": "TargetSystemType", "target-system-subtype": "TargetSystemSubType", "software-version": "SoftwareVersion", "fsoe-address": "FSOEAddress", "ams-net-id": "AmsNetID"},
}


def category() -> Column:
    """The kind of a file by its name; null for files that are none of these. An .xml file
    counts in a folder of a safety project, if its first element is a target's configuration."""
    path = F.lower("path")
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    first = F.col("content").rlike(rf"(?is)^\W?(?:\s|<\?.*?\?>|<!--.*?-->|<!doctype[^>]*>)*+<(?:[\w.\-]+:)?{ROOT}[\s/>]")
    out = F.when(path.endswith(".splcproj"), "SafetyProject").when(path.endswith(".sal.diagram"), "SafetyDiagram").when(path.endswith(".sal"), "SafetyLogic").when(path.endswith(".sds"), "SafetyAliasDevice")
    return out.when(path.endswith(".xml") & folder.rlike("|".join(FOLDERS)) & first, "SafetyConfiguration")


def rows(files: DataFrame) -> DataFrame:
    """The elements of all safety files, with `category`."""
    ours = files.withColumn("category", category()).where("category is not null")
    return elements(ours).join(ours.select(*FILE, "category"), FILE)


def artifacts(files: DataFrame, row: DataFrame) -> DataFrame:
    """project_id, path, category, status (Parsed or ParseFailed: not well formed, empty or
    null), name (what the file says or its stem), device_id of alias devices, n_networks,
    n_blocks, n_in and n_out of logic, related (included paths, or a diagram's logic, the first
    of each in any case), metadata as `key=value`. A file that failed has neither of the last two."""
    name, below = F.lower("name"), F.col("depth") > 1
    count = lambda tag: F.count_if((name == tag.lower()) & below)
    shape, port = name.endswith("shape"), name.endswith("portshape")
    root = lambda a: F.max(F.when(F.col("depth") == 1, attribute(a)))
    included = fx.strip(F.replace(attribute("Include"), F.lit("\\"), F.lit("/")))
    listed = (F.col("name") == "None") & below & (included != "")
    told = {element for known in TOLD.values() for element in known.values()} | {"IntProjName", "Name", "SDSID", "TargetSystemObjectName"}
    found = row.groupBy(*FILE).agg(
        *[first_of(x).alias(f"of_{x}") for x in sorted(told)], root("name").alias("root_name"), root("dslVersion").alias("dsl"), root("FileFormatVersion").alias("format"), root("xmlns").alias("space"),
        count("Network").alias("n_networks"), count("functionBlocks").alias("n_blocks"), count("inPort").alias("n_in"), count("outPort").alias("n_out"), count("IO").alias("n_io"), count("networkSwimLane").alias("n_lanes"),
        F.count_if(port & below).alias("n_port_shapes"), F.count_if(shape & ~port & ~name.contains("moniker") & below).alias("n_block_shapes"), F.array_sort(F.collect_list(F.when(listed, F.struct("seq", included.alias("path"))))).alias("inc"), F.lit("Parsed").alias("status"),
    )
    c, kind = F.col, F.col("category")
    x = files.select(*FILE, category().alias("category")).where("category is not null").join(found, FILE, "left")
    inc = F.when(c("space") == BUILD, F.transform("inc", lambda i: i.path)).otherwise(F.array().cast("array<string>"))
    lower = F.transform(inc, lambda i: F.lower(i))
    ending = lambda end: F.size(F.filter(lower, lambda i: i.endswith(end))).cast("string")
    known = lambda v: F.coalesce(F.nullif(v, F.lit("")), F.lit("unknown"))
    pair = lambda k, v: F.concat(F.lit(f"{k}="), v)
    each = {k: [pair(key, known(c(f"of_{element}"))) for key, element in known_.items()] for k, known_ in TOLD.items()}
    number = lambda n: c(n).cast("string")
    metadata = {
        "SafetyProject": [*each["SafetyProject"], pair("logic-file-count", ending(".sal")), pair("alias-device-count", ending(".sds")), pair("configuration-file-count", ending(".xml"))],
        "SafetyLogic": [pair("dsl-version", known(c("dsl"))), pair("network-count", number("n_networks")), pair("function-block-container-count", number("n_blocks")), pair("in-port-count", number("n_in")), pair("out-port-count", number("n_out"))],
        "SafetyDiagram": [pair("dsl-version", known(c("dsl"))), pair("network-shape-count", number("n_lanes")), pair("function-block-shape-count", number("n_block_shapes")), pair("port-shape-count", number("n_port_shapes"))],
        "SafetyAliasDevice": [pair("file-format-version", known(c("format"))), *each["SafetyAliasDevice"], pair("io-count", number("n_io"))],
        "SafetyConfiguration": each["SafetyConfiguration"],
    }
    text, own = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for k, pairs in metadata.items():
        text = F.when(kind == k, F.array(*pairs)).otherwise(text)
    for k, n in {"SafetyProject": "of_IntProjName", "SafetyLogic": "root_name", "SafetyDiagram": "root_name", "SafetyAliasDevice": "of_Name", "SafetyConfiguration": "of_TargetSystemObjectName"}.items():
        own = F.when(kind == k, F.nullif(c(n), F.lit(""))).otherwise(own)
    logic = F.array(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?i)\.diagram$", ""))
    distinct = F.filter(inc, lambda i, at: F.array_position(lower, F.lower(i)) == at + 1)
    parsed = c("status").isNotNull()
    related = F.when(parsed & (kind == "SafetyDiagram"), logic).when(parsed & (kind == "SafetyProject"), distinct).otherwise(F.array().cast("array<string>"))
    logical = lambda n: F.when(kind == "SafetyLogic", F.coalesce(n, F.lit(0))).otherwise(0).cast("long").alias(n)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return x.select(
        *FILE, "category", F.coalesce("status", F.lit("ParseFailed")).alias("status"), F.coalesce(own, stem).alias("name"), F.when(kind == "SafetyAliasDevice", c("of_SDSID")).alias("device_id"),
        *[logical(n) for n in ("n_networks", "n_blocks", "n_in", "n_out")], related.alias("related"), F.when(parsed, text).otherwise(F.array().cast("array<string>")).alias("metadata"),
    )


def alias_ios(row: DataFrame) -> DataFrame:
    """project_id, path, ord, name, data_type, bit_size, bit_offset: the inputs and outputs of
    alias devices in the order written."""
    e = row.where("category = 'SafetyAliasDevice'")
    for column, tag in (("io_name", "Name"), ("data_type", "DataType"), ("bit_size", "BitSize"), ("bit_offset", "BitOffsMessage")):
        e = e.withColumn(column, first_inside(tag))
    io = e.where((F.lower("name") == "io") & (F.col("depth") > 1))
    at = F.row_number().over(Window.partitionBy(*FILE).orderBy("seq")) - 1
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return io.select(*FILE, at.alias("ord"), F.coalesce("io_name", F.lit("Unnamed IO")).alias("name"), text("data_type"), text("bit_size"), text("bit_offset"))


def links(artifact: DataFrame) -> DataFrame:
    """project_id, path, related, target, target_category: each file that an artefact names,
    beside the artefact that it is. The name counts from the folder of the file that holds it,
    in any case; `target` is null where there is no such artefact. A path with `..` is not followed."""
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    named = artifact.select(*FILE, F.explode("related").alias("related"), folder.alias("folder")).withColumn("at", F.lower(F.concat("folder", F.regexp_replace("related", r"^(?:\./)++", ""))))
    there = artifact.groupBy("project_id", F.lower("path").alias("at")).agg(F.min(F.struct(F.col("path").alias("target"), F.col("category").alias("target_category"))).alias("t"))
    return named.join(there, ["project_id", "at"], "left").select(*FILE, "related", "t.target", "t.target_category")
