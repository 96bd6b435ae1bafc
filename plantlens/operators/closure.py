"""Recursive relations: inheritance chains, inherited variables, the instance tree, call reach.

Chains and trees are recursive CTEs with a path guard against cycles. Reachability runs
over cyclic graphs and is a frontier loop of anti-joins, whose rounds are written out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import text as fx

TREE_DEPTH = 20  # fixed value


def _sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(query, **tables)


def chains(pou: DataFrame) -> DataFrame:
    """project_id, pou_lc, level (1: direct parent), ancestor, ancestor_lc, known, cyclic: the
    closure of EXTENDS, with the first ancestor that no source defines."""
    spark = pou.sparkSession
    edge = pou.select("project_id", F.col("name_lc").alias("child"), F.col("extends_type").alias("parent"), F.lower("extends_type").alias("parent_lc")).where("parent is not null")
    up = _sql(
        spark,
        """WITH RECURSIVE up(project_id, pou_lc, level, ancestor, ancestor_lc, seen, cyclic) MAX RECURSION LEVEL 1000 AS (
             SELECT project_id, child, 1, parent, parent_lc, array(child), parent_lc = child FROM {edge}
             UNION ALL
             SELECT u.project_id, u.pou_lc, u.level + 1, e.parent, e.parent_lc, concat(u.seen, array(u.ancestor_lc)),
                    array_contains(concat(u.seen, array(u.ancestor_lc)), e.parent_lc)
             FROM up u JOIN {edge} e ON u.project_id = e.project_id AND u.ancestor_lc = e.child WHERE NOT u.cyclic)
           SELECT project_id, pou_lc, level, ancestor, ancestor_lc, cyclic FROM up""",
        edge=edge,
    )
    known = pou.select("project_id", F.col("name_lc").alias("ancestor_lc"), F.lit(True).alias("known"))
    return up.join(known, ["project_id", "ancestor_lc"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def chain_text(pou: DataFrame, chain: DataFrame) -> DataFrame:
    """project_id, name, chain: ancestors, topmost first, and the unit itself."""
    path = chain.where("not cyclic").groupBy("project_id", F.col("pou_lc").alias("name_lc")).agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("k"), "ancestor"))).alias("up"))
    joined = pou.select("project_id", "name", "name_lc").join(path, ["project_id", "name_lc"], "left")
    return joined.select("project_id", "name", F.array_join(F.concat(F.coalesce(F.transform("up", lambda x: x.ancestor), F.array().cast("array<string>")), F.array("name")), " > ").alias("chain"))


def unresolved_types(chain: DataFrame) -> DataFrame:
    return chain.where("not known").groupBy("project_id", "ancestor_lc").agg(F.min("ancestor").alias("type_name")).select("project_id", "type_name")


def all_variables(pou: DataFrame, variable: DataFrame, chain: DataFrame) -> DataFrame:
    """Own and inherited variables of each unit: an override keeps the first declaration's
    place and has the last one's values."""
    own = variable.where("owner_kind = 'pou'").drop("owner_kind", "owner")
    sources = pou.select("project_id", F.col("name").alias("pou"), F.col("name_lc").alias("pou_lc"), F.lit(0).alias("level"), F.col("name_lc").alias("owner_lc")).union(
        chain.where("known and not cyclic").join(pou.select("project_id", F.col("name").alias("pou"), F.col("name_lc").alias("pou_lc")), ["project_id", "pou_lc"]).select("project_id", "pou", "pou_lc", "level", F.col("ancestor_lc").alias("owner_lc"))
    )
    found = sources.join(own, ["project_id", "owner_lc"])
    values = F.struct(*[c for c in own.columns if c not in ("project_id", "owner_lc", "name_lc", "ord")], F.col("owner_lc").alias("declared_in"))
    return found.groupBy("project_id", "pou", "pou_lc", "name_lc").agg(F.min(F.struct((-F.col("level")).alias("k"), "ord")).alias("at"), F.min_by(values, F.struct("level", (-F.col("ord")).alias("o"))).alias("v")).select("project_id", "pou", "pou_lc", "name_lc", F.col("at.k").alias("ord_level"), F.col("at.ord").alias("ord"), "v.*")


def object_tree(gvl: DataFrame, variable: DataFrame, all_variable: DataFrame, pou: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """project_id, path, parent_path, instance, type_name, type_lc, layer, depth, is_reference:
    instances of function blocks below the variable lists named *Objects*. References are
    leaves."""
    fb = pou.where("pou_type = 'FunctionBlock'").select("project_id", F.col("name").alias("type_name"), F.col("name_lc").alias("type_lc"))
    typed = lambda df: df.withColumn("type_lc", F.lower("data_type")).join(fb, ["project_id", "type_lc"])
    roots = variable.where("owner_kind = 'gvl'").join(gvl.where("name_lc like '%objects%'").select("project_id", F.col("name_lc").alias("owner_lc")), ["project_id", "owner_lc"])
    root = typed(roots).select("project_id", F.col("name").alias("instance"), "type_name", "type_lc", "is_reference")
    edge = typed(all_variable).select("project_id", "pou_lc", F.col("name").alias("instance"), "type_name", "type_lc", "is_reference")
    tree = _sql(
        gvl.sparkSession,
        f"""WITH RECURSIVE tree(project_id, path, parent_path, instance, type_name, type_lc, is_reference, depth) MAX RECURSION LEVEL {depth + 1} AS (
             SELECT project_id, instance, CAST(NULL AS STRING), instance, type_name, type_lc, is_reference, 1 FROM {{root}}
             UNION ALL
             SELECT t.project_id, concat(t.path, '.', e.instance), t.path, e.instance, e.type_name, e.type_lc, e.is_reference, t.depth + 1
             FROM tree t JOIN {{edge}} e ON t.project_id = e.project_id AND t.type_lc = e.pou_lc
             WHERE t.depth < {depth} AND NOT t.is_reference)
           SELECT * FROM tree""",
        root=root, edge=edge,
    )
    return tree.withColumn("layer", fx.layer(F.col("type_name")))


def reached(edge: DataFrame, root: DataFrame, folder: str, rounds: int = 1000) -> DataFrame:
    """project_id, root_lc, name_lc of everything that calls lead to within a project from each
    of `root` (project_id, root), roots included, whether the project has them or not.

    One loop serves all roots of all projects; its joins are shuffled, as a broadcast in each round
    would pass the edges through the driver as often as there are rounds. Each round's frontier is written below `folder`,
    and no round visits what an earlier one did for the same root. More than `rounds` rounds
    are an error, as what is further away would be lost."""
    spark = edge.sparkSession
    base = f"{folder.rstrip('/')}/reach-{uuid.uuid4().hex}"
    step = edge.select("project_id", F.lower("source").alias("name_lc"), F.lower("target").alias("to_lc")).distinct()
    frontier = root.select("project_id", F.lower("root").alias("root_lc"), F.lower("root").alias("name_lc")).distinct()
    for k in range(rounds):
        frontier.write.parquet(f"{base}/round={k}")
        frontier = spark.read.schema(frontier.schema).parquet(f"{base}/round={k}")
        seen = spark.read.schema(frontier.schema).option("basePath", base).parquet(base).select("project_id", "root_lc", "name_lc")
        if frontier.isEmpty():
            return seen
        frontier = _ahead(frontier, step, seen)
    raise ValueError(f"calls lead further than {rounds} rounds")


def _ahead(frontier: DataFrame, step: DataFrame, seen: DataFrame) -> DataFrame:
    """What one step leads to from the frontier and wasn't seen yet."""
    ahead = frontier.join(step.hint("merge"), ["project_id", "name_lc"]).select("project_id", "root_lc", F.col("to_lc").alias("name_lc")).distinct()
    return ahead.join(seen.hint("merge"), ["project_id", "root_lc", "name_lc"], "left_anti")


def reachable(edge: DataFrame, root: str, folder: str, rounds: int = 1000) -> DataFrame:
    """name_lc of everything that calls lead to from `root`, itself included; where edges have
    a project_id, project_id and name_lc, from the root of that name in each project."""
    keyed = "project_id" in edge.columns
    edge = edge if keyed else edge.withColumn("project_id", F.lit(""))
    found = reached(edge, edge.select("project_id", F.lit(root).alias("root")).distinct(), folder, rounds)
    return found.select(*(["project_id"] if keyed else []), "name_lc")
