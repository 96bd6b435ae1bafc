"""Projects that arrive as files: a stream of sources analysed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantlens.plans.project import Project
from plantlens.sources import files as source

SCHEMA = "value string"


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """New files below folder/<project>/ as rows of files."""
    read = spark.readStream.schema(SCHEMA).text(folder, wholetext=True, recursiveFileLookup=True)
    rest = F.substring_index(F.input_file_name(), folder.rstrip("/") + "/", -1)
    files = read.select(F.substring_index(rest, "/", 1).alias("project_id"), F.regexp_replace(rest, "^[^/]*/", "").alias("path"), F.col("value").alias("content"))
    return files.where(~source.in_excluded_folder(F.col("path"))).withColumn("ext", source.extension(F.col("path"))).select("project_id", "path", "ext", "content")


def units(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the units of each micro-batch's files to a Parquet table. A batch is written
    under its own number, so that a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        found = Project(batch).pous.drop("methods_xml", "properties_xml", "actions_xml")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
