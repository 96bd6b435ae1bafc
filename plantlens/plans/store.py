"""Derived relations kept on disk by the sources' fingerprint, parsed relations kept by file,
and plain exports."""

from __future__ import annotations

from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators import declarations
from plantlens.plans.project import Project, cut
from plantlens.sources import files as source

VERSION, KEPT = 1, 3  # KEPT: fixed value
MOST = 20  # generations from which a store is read before it is written anew as one
FILE = ["project_id", "path"]
RELATIONS = ("pous", "variables", "tree", "alarms", "states", "transitions", "io_map", "calls")


def key(project: Project) -> str:
    """One fingerprint over all projects read together."""
    each = source.fingerprint(project.files).select(F.concat_ws(":", "project_id", "fingerprint").alias("k"))
    return each.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("k"))), 256).alias("k")).first().k


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder ended."""
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def get_or_build(project: Project, folder: str, name: str) -> DataFrame:
    """A relation from the store, derived and written there first if the sources changed; the
    newest KEPT fingerprints stay."""
    spark = project.files.sparkSession
    path = f"{folder.rstrip('/')}/v{VERSION}/fingerprint={key(project)}/{name}"
    if not _whole(spark, path):
        df = getattr(project, name)
        keep = [c for c, t in df.dtypes if not c.endswith("_xml")]
        df.select(*keep).write.mode("overwrite").parquet(path)
        prune(project, folder)
    return spark.read.parquet(path)


def prune(project: Project, folder: str, kept: int = KEPT) -> None:
    """Leaves the newest `kept` fingerprints."""
    root, fs = _path(project.files.sparkSession, f"{folder.rstrip('/')}/v{VERSION}")
    found = sorted(fs.listStatus(root), key=lambda s: -s.getModificationTime())
    for status in found[kept:]:
        fs.delete(status.getPath(), True)


def file_variables(*parsed: DataFrame, task: int | None = declarations.TASK) -> DataFrame:
    """declarations.all_owners_variables of parsed units, lists and types with the path: the
    variables of each file by itself, also where files declare owners of one name."""
    name = reduce(DataFrame.union, [df.select(*FILE, F.col("name").alias("named")) for df in parsed])
    found = declarations.all_owners_variables(*[df.withColumn("name", F.col("path")) for df in parsed], task=task).withColumnRenamed("owner", "path").join(name, FILE)
    return found.withColumnsRenamed({"named": "owner"}).withColumn("owner_lc", F.lower("owner"))


class Store:
    """Parsed relations by file, so that an update parses what changed alone.

    A ledger has a row for each file: its fingerprint and the generation that parsed it. An
    update compares the files' fingerprints with the newest ledger, parses those that are new
    or changed into a generation of their own, and writes a ledger last, which makes them
    visible; one that is stopped before leaves the store as it was, and the next one overwrites
    what it left. A relation is the rows of all generations whose file the ledger gives to
    that generation, so nothing that is written is ever changed. From more than MOST
    generations on an update writes all rows as one. One update at a time; the files given are all files."""

    PARSERS = {"pous": declarations.pous, "gvls": declarations.gvls, "duts": declarations.duts}
    RELATIONS = (*PARSERS, "variables")

    def __init__(self, spark: SparkSession, folder: str, most: int = MOST):
        self.spark, self.root, self.most = spark, f"{folder.rstrip('/')}/files-v{VERSION}", most

    def _at(self, name: str, generation: int) -> str:
        return f"{self.root}/{name}/generation={generation}"

    def _numbers(self, name: str) -> list[int]:
        root, fs = _path(self.spark, f"{self.root}/{name}")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)) if fs.exists(root) else []

    def generations(self) -> list[int]:
        """The numbers of the ledgers, the newest last."""
        return [g for g in self._numbers("ledger") if _whole(self.spark, self._at("ledger", g))]

    def ledger(self, generation: int | None = None) -> DataFrame:
        """project_id, path, fingerprint, parsed (a generation); of the newest unless asked."""
        known = [generation] if generation is not None else self.generations()[-1:]
        schema = "project_id string, path string, fingerprint string, parsed int"
        return self.spark.read.schema(schema).parquet(self._at("ledger", known[0])) if known else self.spark.createDataFrame([], schema)

    def update(self, files: DataFrame) -> Project:
        """The project of these files, from the store."""
        known = self.generations()
        g = known[-1] + 1 if known else 0
        old = self.ledger().withColumnsRenamed({"fingerprint": "before", "parsed": "then"})
        now = files.select(*FILE, F.sha2(F.coalesce("content", F.lit("")), 256).alias("fingerprint"))
        plan = now.join(old, FILE, "full").select(*FILE, "fingerprint", "before", F.when(F.col("fingerprint") == F.col("before"), F.col("then")).otherwise(F.lit(g)).alias("parsed"))
        plan.write.mode("overwrite").parquet(self._at("plan", g))
        plan = self.spark.read.schema(plan.schema).parquet(self._at("plan", g))
        if plan.where("fingerprint is distinct from before").isEmpty() and known:
            return self._project(files)
        plan = plan.where("fingerprint is not null").drop("before")  # null: the file is gone
        changed = cut(files.join(plan.where(F.col("parsed") == g).select(*FILE), FILE, "left_semi"))
        for name, parse in self.PARSERS.items():
            parse(changed).write.mode("overwrite").parquet(self._at(name, g))
        file_variables(*[self.spark.read.schema(parse(changed).schema).parquet(self._at(name, g)) for name, parse in self.PARSERS.items()]).write.mode("overwrite").parquet(self._at("variables", g))
        plan.write.mode("overwrite").parquet(self._at("ledger", g))
        if len(self._parts(self.ledger())) > self.most:
            self._compact(files, g + 1)
        return self._project(files)

    @staticmethod
    def _parts(ledger: DataFrame) -> list[int]:
        """The generations that a ledger refers to: at most MOST and one."""
        return sorted(r.parsed for r in ledger.select("parsed").distinct().collect())

    def _compact(self, files: DataFrame, g: int) -> None:
        for name in self.RELATIONS:
            self.relation(files, name).write.mode("overwrite").parquet(self._at(name, g))
        self.ledger().withColumn("parsed", F.lit(g)).write.mode("overwrite").parquet(self._at("ledger", g))

    def relation(self, files: DataFrame, name: str) -> DataFrame:
        """A parsed relation as the newest ledger has it; `files` gives its schema alone."""
        parsed = {k: parse(files) for k, parse in self.PARSERS.items()}
        ledger, schema = self.ledger(), (parsed[name] if name in parsed else file_variables(*parsed.values(), task=None)).schema
        rows = self.spark.read.schema(schema.add("generation", "integer")).option("basePath", f"{self.root}/{name}").parquet(*[self._at(name, g) for g in self._parts(ledger)])
        return rows.join(ledger.select(*FILE, F.col("parsed").alias("generation")), [*FILE, "generation"], "left_semi").drop("generation")

    def _project(self, files: DataFrame) -> Project:
        project = Project(files)
        if self._parts(self.ledger()):
            for name in self.RELATIONS:  # what Project would parse is there already
                setattr(project, name, self.relation(files, name))
            project.variables = project.variables.drop("path")
        return project

    def prune(self, kept: int = KEPT) -> None:
        """Leaves the newest `kept` ledgers and the generations that they refer to."""
        stay = self.generations()[-kept:]
        needed = {g for k in stay for g in self._parts(self.ledger(k))}
        for name in ("ledger", "plan", *self.RELATIONS):
            for g in self._numbers(name):
                if g not in (stay if name == "ledger" else needed):
                    path, fs = _path(self.spark, self._at(name, g))
                    fs.delete(path, True)


def write_report(project: Project, path: str) -> None:
    """Summary, tree and alarms as JSON lines, one folder each, for any viewer."""
    for name, df in (("summary", project.summary()), ("tree", project.tree), ("alarms", project.alarms)):
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
