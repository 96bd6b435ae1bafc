"""Source discovery: one scan gives a row for each file of each project.

Columns: project_id, path (relative), ext (lower case), content. Several projects are read
in one job; everything derived later is keyed by project_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import text as fx

#: Folders whose content is build output (fixed values).
EXCLUDED = ("bin", "obj", "_Boot", "_CompileInfo", ".git")
SOURCE_EXTENSIONS = ("tcpou", "tcdut", "tcgvl")


class ProjectError(ValueError):
    """The input isn't a project that can be analysed."""


class BlankPath(ProjectError):
    """No path was given."""


class MissingFolder(ProjectError):
    """The path can't be read."""


class NoSources(ProjectError):
    """The folder holds no declarations, variable lists or program units."""


def in_excluded_folder(path: Column) -> Column:
    names = "|".join(f"\\Q{x}\\E" for x in EXCLUDED)
    return path.rlike(f"(?i)(^|/)({names})/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))


def read_project(spark: SparkSession, folder: str, project_id: str | None = None) -> DataFrame:
    """All files of one project folder, build output left out."""
    if not (folder or "").strip():
        raise BlankPath("a project folder is needed")
    folder = folder.rstrip("/")
    try:
        read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    except Exception as error:  # Spark's AnalysisException where the path is missing
        raise MissingFolder(folder) from error
    path = F.substring_index(F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/+", "/"), folder.split(":")[-1] + "/", -1)
    files = read.select(F.lit(project_id or folder.rsplit("/", 1)[-1]).alias("project_id"), path.alias("path"), F.col("value").alias("content"))
    return files.where(~in_excluded_folder(F.col("path"))).withColumn("ext", extension(F.col("path"))).select("project_id", "path", "ext", "content")


def dealt(rows: DataFrame, keys: list[str], text: str, per_task: int) -> DataFrame:
    """The same rows by a hash of `keys`, in as many tasks as leave each about `per_task` bytes of
    the column `text`, and no fewer than there are cores. Spark keeps a count that is asked for;
    by itself it sizes tasks by compressed bytes, which for source text says little. `rows` is
    read twice and so should be a written table."""
    total = rows.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // per_task)), *keys)


def checked(files: DataFrame) -> DataFrame:
    """The same files, if some of them is a source."""
    if files.where(F.col("ext").isin(*SOURCE_EXTENSIONS)).isEmpty():
        raise NoSources("no .TcPOU, .TcDUT or .TcGVL file was found")
    return files


def project_names(files: DataFrame) -> DataFrame:
    """project_id, name: the first .plcproj's RootNamespace, AssemblyName or file stem, else
    the project's id."""
    tag = lambda t: F.nullif(fx.strip(F.regexp_extract("content", rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]*)\.\w+$", 1)
    first = files.where("ext = 'plcproj'").select("project_id", "path", F.coalesce(tag("RootNamespace"), tag("AssemblyName"), stem).alias("name")).groupBy("project_id").agg(F.min_by("name", "path").alias("name"))
    return files.select("project_id").distinct().join(first, "project_id", "left").select("project_id", F.coalesce("name", "project_id").alias("name"))


def fingerprint(files: DataFrame) -> DataFrame:
    """project_id, n_files, fingerprint: SHA-256 over the files' contents by path."""
    each = files.select("project_id", "path", F.concat_ws("|", "path", F.sha2(F.coalesce("content", F.lit("")), 256)).alias("line"))
    return each.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x.line), "\n"), 256).alias("fingerprint"))
