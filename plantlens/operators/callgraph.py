"""Call edges between units, their weights, and the subgraph that a root reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.operators import closure

TOP_EDGES = 300  # fixed value


def calls(body: DataFrame) -> DataFrame:
    """project_id, pou, pou_lc, callee: every name that is followed by an opening bracket."""
    found = body.select("project_id", "pou", "pou_lc", F.explode(F.regexp_extract_all(fx.stripped(F.col("code")), F.lit(r"([A-Za-z_][\w.^]*)\s*\("), F.lit(1))).alias("name"))
    return found.select("project_id", "pou", "pou_lc", F.lower(F.regexp_replace("name", r"\^", "")).alias("callee"))


def call_edges(body: DataFrame, pou: DataFrame, all_variable: DataFrame, variable: DataFrame) -> DataFrame:
    """project_id, source, target, weight. A callee is, in this order: a method of the
    parent (SUPER), a function's name, a local instance, a global instance, an instance
    qualified by its variable list. Calls of oneself don't count.

    Calls are counted by name before they are resolved, so that the joins move one row for
    each name and unit and not one for each call."""
    named = calls(body).groupBy("project_id", "pou", "pou_lc", "callee").agg(F.count(F.lit(1)).alias("n"))
    named = named.withColumn("head", F.substring_index("callee", ".", 1)).withColumn("second", F.when(F.col("callee").contains("."), F.substring_index(F.expr("substring(callee, instr(callee, '.') + 1)"), ".", 1)))
    unit = pou.select("project_id", "name", "name_lc", "pou_type", F.lower("extends_type").alias("parent_lc"))
    parent = unit.select("project_id", F.col("name_lc").alias("pou_lc"), F.when(F.col("parent_lc").isNotNull(), F.col("parent_lc")).alias("super_lc"))
    function = unit.where("pou_type = 'Function'").select("project_id", F.col("name_lc").alias("head"), F.col("name_lc").alias("function_lc"))
    local = all_variable.select("project_id", "pou_lc", F.col("name_lc").alias("head"), F.lower("data_type").alias("local_lc"))
    of_lists = variable.where("owner_kind = 'gvl'")
    shared = of_lists.groupBy("project_id", F.col("name_lc").alias("head")).agg(F.min(F.lower("data_type")).alias("global_lc"))
    qualified = of_lists.select("project_id", F.col("owner_lc").alias("head"), F.col("name_lc").alias("second"), F.lower("data_type").alias("qualified_lc"))
    joined = named.join(parent, ["project_id", "pou_lc"], "left").join(function, ["project_id", "head"], "left").join(local, ["project_id", "pou_lc", "head"], "left").join(shared, ["project_id", "head"], "left").join(qualified, ["project_id", "head", "second"], "left")
    target = F.coalesce(F.when(F.col("head") == "super", F.col("super_lc")), "function_lc", "local_lc", "global_lc", "qualified_lc")
    resolved = joined.select("project_id", "pou", "pou_lc", target.alias("name_lc"), "n").where("name_lc is not null and name_lc <> pou_lc")
    return resolved.join(unit.select("project_id", "name", "name_lc"), ["project_id", "name_lc"]).groupBy("project_id", F.col("pou").alias("source"), F.col("name").alias("target")).agg(F.sum("n").alias("weight"))


def top_edges(edge: DataFrame, n: int = TOP_EDGES) -> DataFrame:
    """The n heaviest edges, of each project where edges have one."""
    w = Window.partitionBy(*[c for c in ("project_id",) if c in edge.columns]).orderBy(F.desc("weight"), F.lower("source"), F.lower("target"))
    return edge.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def from_root(edge: DataFrame, root: str, folder: str) -> DataFrame:
    """The edges both of whose ends `root` reaches, within each project where edges have one."""
    seen = closure.reachable(edge, root, folder)
    for end in ("source", "target"):
        here = edge.withColumn("name_lc", F.lower(end))
        edge = here.join(seen, seen.columns, "left_semi").drop("name_lc")
    return edge


def mermaid(edge: DataFrame, n: int = TOP_EDGES) -> DataFrame:
    """seq, line of a diagram of the top edges."""
    top = top_edges(edge, n).select("source", "target", "weight")
    node = lambda c: F.regexp_replace(F.col(c), r"\W", "_")
    lines = top.select(F.lit(2).alias("seq"), F.concat(F.lit("  "), node("source"), F.when(F.col("weight") > 1, F.concat(F.lit(" -->|x"), F.col("weight"), F.lit("| "))).otherwise(" --> "), node("target")).alias("line"))
    nodes = top.select(F.col("source").alias("name")).union(top.select("target")).distinct().select(F.lit(1).alias("seq"), F.concat(F.lit("  "), node("name"), F.lit('["'), fx.diagram_label(F.col("name")), F.lit('"]')).alias("line"))
    head = edge.sparkSession.createDataFrame([(0, "flowchart LR")], "seq int, line string")
    return head.union(nodes).union(lines)
