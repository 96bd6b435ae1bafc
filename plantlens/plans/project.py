"""A project's relations, each a DataFrame derived lazily from the source files.

Nothing is collected. Files, parsed units and variables and the closures, which many other
relations read several times, are cut when they are first asked for: they are written to the
shared checkpoint folder, a lost executor costs a re-read, and the plans of
what is derived from them stay small.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators import alarms, artifacts, callgraph, closure, compliance, contracts, declarations, drives, io, packml, safety, statemachines
from plantlens.sources import files as source


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may have none; it gets a
    temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; it names the folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared folder and read again, so that each reader takes
    the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/relation-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Project:
    def __init__(self, files: DataFrame):
        self._files = files

    @cached_property
    def files(self) -> DataFrame:
        return cut(self._files)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, project_id: str | None = None) -> Project:
        return cls(source.checked(source.read_project(spark, folder, project_id)))

    # -- parsed ------------------------------------------------------------------------
    @cached_property
    def pous(self) -> DataFrame:
        return cut(declarations.pous(self.files))

    @cached_property
    def gvls(self) -> DataFrame:
        return cut(declarations.gvls(self.files))

    @cached_property
    def duts(self) -> DataFrame:
        return declarations.duts(self.files)

    @cached_property
    def enum_values(self) -> DataFrame:
        return declarations.enum_values(self.duts)

    @cached_property
    def methods(self) -> DataFrame:
        return declarations.methods(self.pous)

    @cached_property
    def properties(self) -> DataFrame:
        return declarations.properties(self.pous)

    @cached_property
    def bodies(self) -> DataFrame:
        return declarations.bodies(self.pous)

    @cached_property
    def variables(self) -> DataFrame:
        return cut(declarations.all_owners_variables(self.pous, self.gvls, self.duts))

    # -- closures ----------------------------------------------------------------------
    @cached_property
    def chains(self) -> DataFrame:
        return cut(closure.chains(self.pous))

    @cached_property
    def all_variables(self) -> DataFrame:
        return cut(closure.all_variables(self.pous, self.variables, self.chains))

    @cached_property
    def tree(self) -> DataFrame:
        return closure.object_tree(self.gvls, self.variables, self.all_variables, self.pous)

    # -- derived -----------------------------------------------------------------------
    @cached_property
    def latches(self) -> DataFrame:
        return alarms.latches(self.all_variables)

    @cached_property
    def unit_alarms(self) -> DataFrame:
        return alarms.alarms(self.latches, self.pous, self.methods, self.chains, self.bodies)

    @cached_property
    def places(self) -> DataFrame:
        return cut(alarms.places(self.tree, self.pous, self.duts, self.variables, self.all_variables))

    @cached_property
    def placed_alarms(self) -> DataFrame:
        """Alarms of every instance, in structs and deep members too, and those known by use."""
        found = alarms.held(self.places, self.latches, self.variables)
        return alarms.placed(found, self.pous, self.methods, self.chains, self.bodies, self.tree)

    @cached_property
    def alarms(self) -> DataFrame:
        """Alarms of every instance, resolved by name where that is unambiguous, described."""
        return alarms.described(alarms.deep_resolved(self.placed_alarms, alarms.all_severities(self.bodies)))

    @cached_property
    def selectors(self) -> DataFrame:
        return statemachines.selectors(self.bodies, self.all_variables)

    @cached_property
    def case_lines(self) -> DataFrame:
        return cut(statemachines.case_lines(self.bodies, self.selectors))

    @cached_property
    def states(self) -> DataFrame:
        return statemachines.flagged(statemachines.states(self.case_lines, self.enum_values), self.machines)

    @cached_property
    def machines(self) -> DataFrame:
        """The machines of every unit, with what they were constructed with."""
        return statemachines.machines(self.selectors, statemachines.wrappers(self.all_variables), self.pous, self.enum_values)

    @cached_property
    def machine_instances(self) -> DataFrame:
        """The machines of every instance of the tree."""
        return statemachines.of_instances(self.machines, self.tree)

    @cached_property
    def transitions(self) -> DataFrame:
        return statemachines.transitions(self.case_lines)

    @cached_property
    def io_map(self) -> DataFrame:
        return io.io_map(self.variables, self.all_variables)

    @cached_property
    def all_boxes(self) -> DataFrame:
        """The boxes of every hardware file, nested ones too."""
        return cut(io.boxes(self.files))

    @cached_property
    def boxes(self) -> DataFrame:
        return io.merged_boxes(self.all_boxes)

    @cached_property
    def channels(self) -> DataFrame:
        return io.channels(self.boxes)

    @cached_property
    def unified_io(self) -> DataFrame:
        return io.unified(self.channels, io.links(self.files, self.all_boxes), self.io_map, self.variables, self.all_variables)

    @cached_property
    def calls(self) -> DataFrame:
        # types of inherited variables alone, read once: nothing to cut
        narrow = self.variables.select("project_id", "owner_kind", "owner", "owner_lc", "ord", "name_lc", "data_type")
        return callgraph.call_edges(self.bodies, self.pous, closure.all_variables(self.pous, narrow, self.chains), self.variables)

    def calls_reached(self, root: DataFrame) -> DataFrame:
        """project_id, root_lc, name_lc of what calls lead to from each root (project_id, root)."""
        return closure.reached(cut(self.calls), root, shared_folder(self.files.sparkSession))

    @cached_property
    def libraries(self) -> DataFrame:
        return artifacts.libraries(self.files)

    @cached_property
    def drive_rows(self) -> DataFrame:
        return cut(drives.rows(self.files))

    @cached_property
    def drive_sections(self) -> DataFrame:
        """What the drives' files hold as sections, with their paths."""
        return cut(drives.sections(self.drive_rows))

    @cached_property
    def drive_parameters(self) -> DataFrame:
        return drives.parameters(self.drive_rows, self.drive_sections)

    @cached_property
    def safety_rows(self) -> DataFrame:
        return cut(safety.rows(self.files))

    @cached_property
    def safety_artifacts(self) -> DataFrame:
        return safety.artifacts(self.files, self.safety_rows)

    @cached_property
    def safety_links(self) -> DataFrame:
        """What safety projects and diagrams name, beside the artefacts that are there."""
        return safety.links(self.safety_artifacts)

    @cached_property
    def safety_ios(self) -> DataFrame:
        return safety.alias_ios(self.safety_rows)

    @cached_property
    def unit_rules(self) -> DataFrame:
        """Rules on what a unit itself holds."""
        return compliance.evaluate(compliance.features(self.pous, self.variables, self.methods, self.properties, self.chains, self.files))

    @cached_property
    def rules(self) -> DataFrame:
        """All rules on units, those that look at other units and PackML's too."""
        return self.unit_rules.union(contracts.evaluate(self.pous, self.variables, self.methods, self.chains, self.files)).union(packml.rules(self.packml))

    @cached_property
    def project_rules(self) -> DataFrame:
        """Rules on whole projects. Machines count as declared where an instance of the tree has one."""
        own = compliance.project_rules(self.pous, self.gvls, self.duts, self.variables, self.methods, closure.unresolved_types(self.chains))
        placed = self.tree.select("project_id", F.col("type_lc").alias("pou_lc")).distinct()
        formal = self.all_variables.where(F.lower("data_type").startswith(statemachines.WRAPPER)).join(placed, ["project_id", "pou_lc"], "left_semi")
        return own.union(contracts.project_rules(self.pous, self.files, formal, self.selectors.where("kind = 'direct'")))

    @cached_property
    def packml(self) -> DataFrame:
        """The PackML score of every unit."""
        return packml.score(self.packml_features)

    @cached_property
    def packml_features(self) -> DataFrame:
        return packml.features(self.pous, self.methods, self.bodies, self.variables, self.states, self.transitions)

    @cached_property
    def packml_entries(self) -> DataFrame:
        """What of the standard's states, transitions, commands, modes and error paths is there."""
        return packml.entries(self.packml_features)

    def module_info(self, name: str) -> DataFrame:
        """project_id, name, pou_type, extends_type, chain, n_variables, n_methods of a unit; no
        row if there is none (`pous` lists the names)."""
        unit = self.pous.where(F.col("name_lc") == name.lower())
        n = self.all_variables.where(F.col("pou_lc") == name.lower()).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_variables"))
        path = closure.chain_text(self.pous, self.chains).where(F.lower("name") == name.lower()).select("project_id", "chain")
        return unit.select("project_id", "name", "pou_type", "extends_type", F.coalesce(F.size("methods_xml"), F.lit(0)).alias("n_methods")).join(path, "project_id").join(n, "project_id", "left")

    def summary(self) -> DataFrame:
        """One row for each project: counts of what was found."""
        p = self.pous.groupBy("project_id").agg(
            F.count(F.lit(1)).alias("n_pous"), F.count_if(F.col("pou_type") == "FunctionBlock").alias("n_function_blocks"), F.count_if(F.col("pou_type") == "Program").alias("n_programs"), F.count_if(F.col("language") != "ST").alias("n_graphical"),
            F.sum(F.greatest(F.lit(0), F.size(F.coalesce("methods_xml", F.array())))).alias("n_methods"),
        )
        severity = [F.count_if(F.col("severity") == t).alias(f"n_{t.lower()}") for t in (*alarms.TIERS, "Unresolved")]
        parts = [
            self.duts.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_duts")), self.gvls.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_gvls")), self.variables.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_variables")),
            self.alarms.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_alarms"), *severity), self.tree.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_instances"), F.max("depth").alias("tree_depth")),
        ]
        for x in parts:
            p = p.join(x, "project_id", "left")
        return p.fillna(0)

    def coverage(self) -> DataFrame:
        """project_id, kind, captured, in_source: what was parsed beside a plain count of the
        elements in the text; a difference shows what was dropped."""
        raw = lambda tag, kind: self.files.where("ext = 'tcpou'").groupBy("project_id").agg(F.sum(artifacts.count_of(tag)).alias("in_source")).withColumn("kind", F.lit(kind))
        got = lambda df, kind: df.groupBy("project_id").agg(F.count(F.lit(1)).alias("captured")).withColumn("kind", F.lit(kind))
        kinds = {"pou": ("POU", self.pous), "method": ("Method", self.methods), "property": ("Property", self.properties), "action": ("Action", declarations.actions(self.pous))}
        out = None
        for kind, (tag, df) in kinds.items():
            one = raw(tag, kind).join(got(df, kind), ["project_id", "kind"], "left").select("project_id", "kind", F.coalesce("captured", F.lit(0)).alias("captured"), "in_source")
            out = one if out is None else out.union(one)
        return out
