"""The registered queries over the virtual project, and the SQL that says the same from the
tables alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.operators import alarms, artifacts, callgraph, closure, compliance, declarations, drives, io, packml
from plantlens.plans.project import Project, shared_folder
from plantlens.plans.store import Store
from plantlens.sources import files as source
from plantlens.sources import virtual as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LONG = "bigint"


@_query("""SELECT 'UM_R' || r_regionkey AS name, 'FunctionBlock' AS pou_type, NULL::VARCHAR AS extends_type FROM region
  UNION ALL SELECT 'EM_N' || n_nationkey, 'FunctionBlock', CASE n_nationkey % 5 WHEN 0 THEN 'EM_BASECLASS' WHEN 1 THEN NULL ELSE 'EM_Equipment' END FROM nation
  UNION ALL SELECT 'CM_S' || s_suppkey, 'FunctionBlock', 'CM_L' || (s_suppkey % 7) FROM supplier
  UNION ALL SELECT 'CM_L' || k, 'FunctionBlock', CASE k WHEN 0 THEN 'CM_BASECLASS' ELSE 'CM_L' || (k - 1) END FROM range(7) t(k)
  UNION ALL SELECT 'EM_Equipment', 'FunctionBlock', NULL""")
def pou_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declarations.pous(v.plant(spark, sf_dir)).select("name", "pou_type", "extends_type")  # read once: nothing to cut


@_query("""SELECT 'UM_R' || n_regionkey AS owner, 'N' || n_nationkey AS name, 'EM_N' || n_nationkey AS data_type, 'Local' AS scope FROM nation
  UNION ALL SELECT 'EM_N' || s_nationkey, 'S' || s_suppkey, 'CM_S' || s_suppkey, 'Local' FROM supplier
  UNION ALL SELECT 'EM_N' || c_nationkey, 'ALM_Cust' || c_custkey, 'DM_TriggeredLatch', 'Local' FROM customer
  UNION ALL SELECT 'CM_S' || s_suppkey, 'bRun', 'BOOL', 'Input' FROM supplier
  UNION ALL SELECT 'CM_L' || k, 'nLevel', 'INT', 'Local' FROM range(7) t(k) UNION ALL SELECT 'CM_L' || k, 'nOwn' || k, 'INT', 'Local' FROM range(7) t(k)
  UNION ALL SELECT 'EM_Equipment', 'nState', 'INT', 'Local'
  UNION ALL SELECT 'Objects', 'R' || r_regionkey, 'UM_R' || r_regionkey, 'Global' FROM region""")
def variable_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).variables.select("owner", "name", "data_type", "scope")


@_query("""SELECT 'FB_P' || p_partkey AS owner, 'nSize' AS name, p_size::VARCHAR AS initial_value, NULL::VARCHAR AS comment, 'size of the part' AS leading_comment FROM part
  UNION ALL SELECT 'FB_P' || p_partkey, 'rPrice', printf('%.2f', p_retailprice), p_name, NULL FROM part
  UNION ALL SELECT 'FB_P' || p_partkey, 'eType', NULL, NULL, NULL FROM part""")
def variable_values_and_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.parts(spark, sf_dir)).variables.where("owner_kind = 'pou'").select("owner", "name", "initial_value", "comment", "leading_comment")


@_query("""SELECT 'E_PType' AS dut, p_type AS name, (row_number() OVER (ORDER BY p_type) - 1)::VARCHAR AS value FROM (SELECT DISTINCT p_type FROM part)""")
def dut_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.parts(spark, sf_dir)).enum_values.select("dut", "name", "value")


@_query("""SELECT 'Objects' AS name, true AS qualified_only, count(*) AS n_variables FROM region
  UNION ALL SELECT 'GVL_IO' || (event_id // 1000), false, count(*) FROM events GROUP BY event_id // 1000""")
def gvl_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Project(v.plant(spark, sf_dir).union(v.io_files(spark, sf_dir)).where("ext = 'tcgvl'"))
    n = p.variables.groupBy(F.col("owner_lc").alias("name_lc")).agg(F.count(F.lit(1)).alias("n_variables"))
    return p.gvls.join(n, "name_lc").select("name", "qualified_only", "n_variables")


@_query("""SELECT 'CM_S' || s_suppkey AS pou, k::INT + 1 AS level, 'CM_L' || (s_suppkey % 7 - k) AS ancestor FROM supplier, range(7) t(k) WHERE k <= s_suppkey % 7
  UNION ALL SELECT 'CM_S' || s_suppkey, (s_suppkey % 7 + 2)::INT, 'CM_BASECLASS' FROM supplier""")
def inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Project(v.plant(spark, sf_dir))
    name = p.pous.select("project_id", F.col("name_lc").alias("pou_lc"), F.col("name").alias("pou"))
    return p.chains.where("pou_lc like 'cm#_s%' escape '#'").join(name, ["project_id", "pou_lc"]).select("pou", "level", "ancestor")


@_query("""SELECT 'CM_S' || s_suppkey AS pou, 'nLevel' AS name, (s_suppkey % 7)::VARCHAR AS initial_value, 'cm_l' || (s_suppkey % 7) AS declared_in FROM supplier
  UNION ALL SELECT 'CM_S' || s_suppkey, 'nOwn' || k, NULL, 'cm_l' || k FROM supplier, range(7) t(k) WHERE k <= s_suppkey % 7
  UNION ALL SELECT 'CM_S' || s_suppkey, 'bRun', NULL, 'cm_s' || s_suppkey FROM supplier""")
def all_variables_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).all_variables.where("pou_lc like 'cm#_s%' escape '#'").select("pou", "name", "initial_value", "declared_in")


@_query("SELECT * FROM (VALUES ('CM_BASECLASS'), ('EM_BASECLASS')) t(type_name)")
def unresolved_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.unresolved_types(Project(v.plant(spark, sf_dir)).chains).select("type_name")


_TREE = """SELECT 'R' || r_regionkey AS path, 'UM_R' || r_regionkey AS type_name, 'UM' AS layer, 1 AS depth FROM region
  UNION ALL SELECT 'R' || n_regionkey || '.N' || n_nationkey, 'EM_N' || n_nationkey, 'EM', 2 FROM nation
  UNION ALL SELECT 'R' || n_regionkey || '.N' || n_nationkey || '.S' || s_suppkey, 'CM_S' || s_suppkey, 'CM', 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@_query(_TREE)
def object_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).tree.select("path", "type_name", "layer", "depth")


@_query(f"SELECT layer, count(*) AS n_instances, max(depth) AS depth FROM ({_TREE}) GROUP BY layer")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).tree.groupBy("layer").agg(F.count(F.lit(1)).alias("n_instances"), F.max("depth").alias("depth"))


_ALARM = """SELECT *, 'ALM_Cust' || c_custkey AS alarm, 'EM_N' || c_nationkey AS pou, n_nationkey % 5 AS m,
    CASE WHEN n_nationkey % 5 < 2 THEN 'Unresolved' ELSE coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Critical' WHEN 'BUILDING' THEN 'Process' WHEN 'FURNITURE' THEN 'Advisory' WHEN 'HOUSEHOLD' THEN 'Information' END, 'Unresolved') END AS severity
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_REASON = """CASE WHEN severity <> 'Unresolved' THEN 'None' WHEN m = 0 THEN 'BaseClass' WHEN m = 1 THEN 'NoMethod' WHEN c_custkey % 2 = 1 AND c_custkey % 3 > 0 THEN 'Dead' ELSE 'Missing' END"""


@_query(f"SELECT pou, alarm, severity, {_REASON} AS reason FROM ({_ALARM})")
def alarm_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).unit_alarms.select("pou", "alarm", "severity", "reason")


@_query(f"SELECT severity, count(*) AS n_alarms FROM ({_ALARM}) GROUP BY severity")
def alarm_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).unit_alarms.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alarms"))


@_query(f"""SELECT alarm, CASE WHEN m <> 1 AND c_custkey % 2 = 0 THEN 'nLevel > ' || (c_custkey % 100) END AS "trigger",
  (c_custkey * 10)::INT AS delay_ms FROM ({_ALARM}) WHERE m <> 1 AND c_custkey % 3 = 0""")
def alarm_trigger_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).unit_alarms.where("delay_ms is not null").select("alarm", "trigger", "delay_ms")


@_query(f"""SELECT 'R' || n_regionkey || '.N' || n_nationkey || '.' || alarm AS variable_path, false AS is_definition_only FROM ({_ALARM})""")
def alarm_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).placed_alarms.select("variable_path", "is_definition_only")


@_query(f"""WITH a AS ({_ALARM}) SELECT path, coalesce(n, 0) AS n_alarms FROM ({_TREE}) t LEFT JOIN
  (SELECT 'R' || n_regionkey AS p, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT 'R' || n_regionkey || '.N' || n_nationkey, count(*) FROM a GROUP BY 1) ON p = path""")
def subtree_alarm_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Project(v.plant(spark, sf_dir))
    return alarms.subtree_counts(p.tree, p.placed_alarms).select("path", "n_alarms")


@_query(f"""SELECT alarm, 'Cust' || c_custkey AS condition, (CASE severity WHEN 'Unresolved' THEN 'Alarm' ELSE severity END) || ': cust' || c_custkey ||
  CASE WHEN m = 1 OR (c_custkey % 2 = 1 AND c_custkey % 3 > 0) THEN '' ELSE '; ' || concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN 'when `nLevel > ' || (c_custkey % 100) || '` holds' END,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN 'after ' || (c_custkey * 10) || ' ms' END) END AS description FROM ({_ALARM})""")
def alarm_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.described(Project(v.plant(spark, sf_dir)).unit_alarms).select("alarm", "condition", "description")


_CHANGE = """SELECT DISTINCT o_custkey, a, b FROM (SELECT o_custkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderstatus AS b FROM orders) WHERE a <> b"""


@_query(f"SELECT 'FB_C' || o_custkey AS pou, 'eStatus' AS selector, a AS from_state, b AS to_state, 'bTo' || b AS guard FROM ({_CHANGE})")
def sm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.machines(spark, sf_dir)).transitions.select("pou", "selector", "from_state", "to_state", "guard")


@_query(f"""WITH c AS ({_CHANGE}) SELECT 'FB_C' || k.o_custkey AS pou, s AS state, (rank() OVER (PARTITION BY k.o_custkey ORDER BY s) - 1)::VARCHAR AS value, EXISTS (SELECT 1 FROM c WHERE c.o_custkey = k.o_custkey AND c.a = s) AS has_branch
  FROM (SELECT DISTINCT o_custkey FROM c) k, (SELECT DISTINCT o_orderstatus AS s FROM orders)""")
def sm_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.machines(spark, sf_dir)).states.select("pou", "state", "value", "has_branch")


@_query(f"""WITH c AS ({_CHANGE}), e AS (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first, max(o_orderstatus) AS last FROM orders GROUP BY 1), s AS (SELECT DISTINCT o_orderstatus AS s FROM orders)
  , w AS (SELECT o_custkey AS k, a, count(*) AS n FROM c GROUP BY ALL)
  SELECT 'W' || o_custkey AS path, 'smOrders' AS selector, 'Orders of ' || o_custkey AS display_name, 'E_OrderStatus' AS enum_type, s AS state, s = first AS is_initial, s = last AS is_transition, coalesce(n, 0) AS n_ways,
    CASE WHEN n > 0 AND o_custkey % 3 <> 0 THEN 'T#' || (o_custkey % 50) || 's' END AS timeout
  FROM e CROSS JOIN s LEFT JOIN w ON o_custkey = k AND s = a WHERE o_custkey IN (SELECT k FROM w)""")
def sm_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machines of instances by state: what begins them, the ways out and their timeouts."""
    p = Project(v.placed_machines(spark, sf_dir))
    keys = ["project_id", "pou", "selector"]
    ways = p.transitions.groupBy(*keys, F.col("from_state").alias("state")).agg(F.count(F.lit(1)).alias("n_ways"), F.max("timeout").alias("timeout"))
    state = p.states.join(ways, [*keys, "state"], "left").select(*keys, "state", "is_initial", "is_transition", F.coalesce("n_ways", F.lit(0)).alias("n_ways"), "timeout")
    return p.machine_instances.join(state, keys).select("path", "selector", "display_name", "enum_type", "state", "is_initial", "is_transition", "n_ways", "timeout")


_AT = "CASE WHEN event_type IN ('view', 'click') THEN 'Input' WHEN event_type IN ('purchase', 'error') THEN 'Output' ELSE 'Memory' END"


@_query(f"SELECT 'GVL_IO' || (event_id // 1000) AS source, 'ev' || event_id AS variable, {_AT} AS direction FROM events")
def io_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.io_files(spark, sf_dir)).io_map.select("source", "variable", "direction")


@_query(f"SELECT {_AT} AS direction, count(*) AS n FROM events GROUP BY 1")
def io_direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.io_files(spark, sf_dir)).io_map.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


_USER = """SELECT user_id, event_type, min(value) AS least, max(CASE WHEN value >= 250 THEN event_id END) AS linked FROM events GROUP BY ALL"""


@_query(f"SELECT 'Box' || user_id AS box, event_type AS channel, CASE WHEN least < 50 THEN 'BOOL' ELSE 'INT' END AS data_type, CASE WHEN least < 50 THEN 1 ELSE 16 END AS bits, 'Input' AS direction, (row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1)::INT AS ord FROM ({_USER})")
def hw_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.io_files(spark, sf_dir)).channels.select("box", "channel", "data_type", "bits", "direction", "ord")


@_query("""WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, CASE WHEN user_id % 4 = 3 THEN user_id END AS alone, row_number() OVER (PARTITION BY user_id // 4, user_id % 4 = 3 ORDER BY user_id) AS level, lag(user_id) OVER (PARTITION BY user_id // 4, user_id % 4 = 3 ORDER BY user_id) AS up FROM u)
  SELECT 'Box' || user_id AS box, level::INT AS level, 'Box' || up AS parent FROM n""")
def hw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of hardware files at any depth, with the boxes that hold them."""
    return Project(v.io_files(spark, sf_dir)).all_boxes.select("box", F.col("level").cast("int").alias("level"), "parent")


_PERCENT = "CASE WHEN event_type IN ('view', 'click') THEN '%I*' WHEN event_type IN ('purchase', 'error') THEN '%Q*' ELSE '%M*' END"
_SYMBOL = "'GVL_IO' || (event_id // 1000) || '.ev' || event_id"
_UNIFIED = f"""WITH u AS ({_USER})
  SELECT 'linked' AS row_kind, {_SYMBOL} AS variable, 'BOOL' AS data_type, {_PERCENT} AS address, {_AT} AS direction, 'EL1008' AS sku, 'Box' || u.user_id AS box, u.event_type AS channel, 'Input' AS signal, '#x6000' AS coe_index, '' AS comment, 'Boxes' || (u.user_id // 4) || CASE WHEN u.user_id % 4 = 3 THEN 'b' ELSE '' END || '.xti' AS provenance
  FROM u JOIN (SELECT event_id, event_type FROM events) e(event_id, kind) ON linked = event_id
  UNION ALL SELECT 'unused-channel', '', 'BOOL', '', 'Input', 'EL1008', 'Box' || user_id, event_type, 'Input', '#x6000', '', 'Boxes' || (user_id // 4) || CASE WHEN user_id % 4 = 3 THEN 'b' ELSE '' END || '.xti' FROM u WHERE linked IS NULL AND least < 50
  UNION ALL SELECT 'software-only', {_SYMBOL}, 'BOOL', {_PERCENT}, {_AT}, '', '', '', '', '', '', 'PLC declaration (no hardware link)' FROM events WHERE event_id NOT IN (SELECT linked FROM u WHERE linked IS NOT NULL)"""


@_query(_UNIFIED)
def unified_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.io_files(spark, sf_dir)).unified_io.drop("project_id")


@_query(f"SELECT row_kind, count(*) AS n FROM ({_UNIFIED}) GROUP BY 1")
def unified_io_rowkinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.io_files(spark, sf_dir)).unified_io.groupBy("row_kind").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT symbol, 'BOOL' AS data_type FROM (SELECT 'GVL_IO' || (event_id // 1000) || '.ev' || event_id AS symbol FROM events) ORDER BY lower(symbol) LIMIT 10")
def fingerprint_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.fingerprint_symbols(Project(v.io_files(spark, sf_dir)).variables).select("symbol", "data_type")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.callers(spark, sf_dir).union(v.parts(spark, sf_dir))).calls


_EDGE = "SELECT 'CM_S' || l_suppkey AS source, 'FB_P' || l_partkey AS target, count(*) AS weight FROM lineitem GROUP BY ALL"


@_query(_EDGE)
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("source", "target", "weight")


@_query(f"SELECT * FROM ({_EDGE}) ORDER BY weight DESC, lower(source), lower(target) LIMIT 300")
def call_graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.top_edges(_calls(spark, sf_dir)).select("source", "target", "weight")


@_query("SELECT 'Lib' || n_nationkey AS library, 'NS' || n_nationkey AS namespace, '1.' || n_nationkey || '.0' AS version, 'Vendor' || n_regionkey AS vendor FROM nation")
def library_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.library_file(spark, sf_dir)).libraries.select("library", "namespace", "version", "vendor")


@_query("SELECT 'virtual' AS project_id, 'Virtual' AS name")
def project_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.project_names(v.library_file(spark, sf_dir))


_FEATURE = """SELECT 'UM_R' || r_regionkey AS module, 'UM' AS layer, NULL AS parent, false AS alarms, 0 AS n_in FROM region
  UNION ALL SELECT 'EM_N' || n_nationkey, 'EM', CASE n_nationkey % 5 WHEN 0 THEN 'EM_BASECLASS' WHEN 1 THEN NULL ELSE 'EM_Equipment' END, n_nationkey % 5 <> 1, 0 FROM nation
  UNION ALL SELECT 'CM_S' || s_suppkey, 'CM', 'CM_L' || (s_suppkey % 7), false, 1 FROM supplier
  UNION ALL SELECT 'CM_L' || k, 'CM', CASE k WHEN 0 THEN 'CM_BASECLASS' ELSE 'CM_L' || (k - 1) END, false, 0 FROM range(7) t(k) UNION ALL SELECT 'EM_Equipment', 'EM', NULL, false, 0"""
_RULES = f"""WITH f AS ({_FEATURE})
  SELECT module, 'ISA-001' AS rule_id, 'P' AS level FROM f UNION ALL SELECT module, 'ISA-002', CASE WHEN layer = 'CM' THEN 'N' WHEN alarms THEN 'P' ELSE 'F' END FROM f
  UNION ALL SELECT module, 'OOP-003', CASE WHEN parent IS NOT NULL THEN 'P' ELSE 'W' END FROM f UNION ALL SELECT module, 'ISA-006', CASE WHEN parent LIKE '%BASECLASS%' THEN 'P' ELSE 'W' END FROM f
  UNION ALL SELECT module, 'IEC-005', CASE WHEN n_in > 0 THEN 'P' ELSE 'W' END FROM f UNION ALL SELECT module, 'GAMP-001', CASE WHEN n_in > 0 THEN 'P' ELSE 'W' END FROM f
  UNION ALL SELECT module, 'GAMP-003', CASE WHEN alarms THEN 'P' ELSE 'W' END FROM f UNION ALL SELECT module, 'oop.extends_cycle', CASE WHEN parent IS NULL THEN 'N' ELSE 'P' END FROM f
  UNION ALL SELECT module, 'OOP-008', CASE WHEN alarms THEN 'P' ELSE 'N' END FROM f"""


@_query(_RULES)
def compliance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that the SQL states; compliance_rules_all has all of them."""
    checked = ("ISA-001", "ISA-002", "OOP-003", "ISA-006", "IEC-005", "GAMP-001", "GAMP-003", "oop.extends_cycle", "OOP-008")
    return Project(v.plant(spark, sf_dir)).unit_rules.where(F.col("rule_id").isin(*checked)).select("module", "rule_id", "level")


@_query(f"""WITH r AS ({_RULES}), s AS (SELECT module, count(*) FILTER (level = 'P') AS n_pass, count(*) FILTER (level = 'W') AS n_warning, count(*) FILTER (level = 'F') AS n_fail FROM r WHERE rule_id IN ('ISA-001', 'ISA-002', 'ISA-006') GROUP BY module)
  SELECT module, n_pass, n_warning, n_fail, round_even(100 * (n_pass + 0.5 * n_warning) / (n_pass + n_warning + n_fail), 0)::INT AS percent, CASE WHEN n_fail > 0 THEN 'Fail' WHEN (n_pass + 0.5 * n_warning) / (n_pass + n_warning + n_fail) >= 0.9 THEN 'Pass' ELSE 'Warning' END AS level FROM s""")
def compliance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three ISA-88 rules alone, as the SQL has them; compliance_scores_all has all rules."""
    rule = Project(v.plant(spark, sf_dir)).unit_rules.where(F.col("rule_id").isin("ISA-001", "ISA-002", "ISA-006"))
    return compliance.scores(rule, "module").select("module", "n_pass", "n_warning", "n_fail", "percent", "level")


@_query("""SELECT * FROM (VALUES ('IEC-P01', 'F'), ('IEC-P02', 'W'), ('IEC-P03', 'P'), ('IEC-P04', 'W'), ('ISA-P01', 'P'), ('ISA-P02', 'P'), ('ISA-P03', 'P'), ('ISA-P04', 'P'), ('ISA-P05', 'P'), ('GAMP-P01', 'F'), ('GAMP-P02', 'W'), ('GAMP-P03', 'W'), ('GAMP-P04', 'N'), ('xml.guid_uniqueness', 'P')) t(rule_id, level)""")
def project_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).project_rules.select("rule_id", "level")


@_query(f"""WITH a AS ({_ALARM}), t AS ({_TREE}) SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + 8 AS n_pous, 1::BIGINT AS n_gvls, (SELECT count(*) FROM nation WHERE n_nationkey % 5 <> 1) AS n_methods,
  (SELECT count(*) FROM a) AS n_alarms, (SELECT count(*) FROM a WHERE severity = 'Critical') AS n_critical, (SELECT count(*) FROM t) AS n_instances, (SELECT max(depth) FROM t) AS tree_depth""")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).summary().select("n_pous", "n_gvls", "n_methods", "n_alarms", "n_critical", "n_instances", "tree_depth")


@_query("""SELECT 'pou' AS kind, n AS captured, n AS in_source FROM (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + 8 AS n)
  UNION ALL SELECT 'method', n, n FROM (SELECT count(*) FILTER (n_nationkey % 5 <> 1) AS n FROM nation) UNION ALL SELECT 'property', 0, 0 UNION ALL SELECT 'action', 0, 0""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).coverage().select("kind", F.col("captured").cast(LONG).alias("captured"), F.col("in_source").cast(LONG).alias("in_source"))


@_query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<p[\\s/>]')) AS n_p, len(regexp_extract_all(html, '(?i)<a[\\s/>]')) AS n_a, len(regexp_extract_all(html, '(?i)<div[\\s/>]')) AS n_div FROM pages""")
def page_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.tag_counts(spark.read.parquet(f"{sf_dir}/pages.parquet"), ("p", "a", "div"))


@_query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\n[ \t]*\r?\n[ \t]*\r?\n[ \t]*\r?\n') THEN 'W' ELSE 'P' END AS level FROM documents""")
def style_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(fx.blank_run(F.col("text")), "W").otherwise("P").alias("level"))


@_query()
def compliance_rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.plant(spark, sf_dir)).rules.select("module", "standard", "rule_id", "level")


@_query()
def compliance_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.scores(Project(v.plant(spark, sf_dir)).rules, "module").select("module", "standard", "n_pass", "n_warning", "n_fail", "percent", "level")


@_query()
def call_graph_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.mermaid(_calls(spark, sf_dir))


_PACKML = """st(i, s) AS (VALUES (0, 'Idle'), (1, 'Starting'), (2, 'Execute'), (3, 'Completing'), (4, 'Complete'), (5, 'Holding'), (6, 'Held'), (7, 'Unholding'), (8, 'Stopping'), (9, 'Stopped'), (10, 'Aborting'), (11, 'Aborted'), (12, 'Clearing'), (13, 'Resetting')),
  tr(j, f, t, auto) AS (VALUES (0, 'Idle', 'Starting', false), (1, 'Starting', 'Execute', true), (2, 'Execute', 'Completing', false), (3, 'Completing', 'Complete', true), (4, 'Complete', 'Resetting', false), (5, 'Execute', 'Holding', false), (6, 'Holding', 'Held', true), (7, 'Held', 'Unholding', false), (8, 'Unholding', 'Execute', true),
    (9, 'Execute', 'Stopping', false), (10, 'Stopping', 'Stopped', true), (11, 'Stopped', 'Resetting', false), (12, 'Resetting', 'Idle', true), (13, 'Any', 'Aborting', false), (14, 'Aborting', 'Aborted', true), (15, 'Aborted', 'Clearing', false), (16, 'Clearing', 'Stopped', true)),
  cm(c, name, must) AS (VALUES (0, 'CmdStart', true), (1, 'CmdStop', true), (2, 'CmdReset', true), (3, 'CmdHold', false), (4, 'CmdUnhold', false), (5, 'CmdAbort', true), (6, 'CmdClear', true), (7, 'CmdComplete', false)),
  md(m, name) AS (VALUES (0, 'Production'), (1, 'Manual'), (2, 'Maintenance')),
  u AS (SELECT p_partkey AS k FROM part),
  shown AS (SELECT a.j, b.j AS by_j FROM tr a JOIN tr b ON contains(lower(b.t), lower(a.t)) AND (a.f = 'Any' OR contains(lower(CASE b.f WHEN 'Any' THEN 'Execute' ELSE b.f END), lower(a.f)))),
  e AS (SELECT k, 'states' AS section, s AS item, s IN ('Idle', 'Execute', 'Stopped', 'Resetting') AS required, (k + i) % 3 = 0 AS present, (k + i) % 3 = 0 AND k % 2 = 0 AS calls_parent FROM u, st
    UNION ALL SELECT k, 'transitions', f || ' > ' || t, true, (auto AND (k + coalesce(i, 0)) % 3 = 0) OR (f = 'Any' AND (k + 5) % 3 = 0) OR EXISTS (SELECT 1 FROM shown x WHERE x.j = tr.j AND (u.k + x.by_j) % 4 = 0), NULL FROM u, tr LEFT JOIN st ON s = f
    UNION ALL SELECT k, 'commands', name, must, (k + c) % 3 = 0 OR (k + c) % 4 = 0, NULL FROM u, cm
    UNION ALL SELECT k, 'modes', name, true, (k + m) % 2 = 0, NULL FROM u, md
    UNION ALL SELECT k, 'errors', 'Aborting state', true, (k + 10) % 3 = 0, NULL FROM u
    UNION ALL SELECT k, 'errors', 'Alarms lead to abort', true, k % 5 = 0 AND ((k + 13) % 4 = 0 OR (k + 14) % 4 = 0 OR (k + 5) % 3 = 0), NULL FROM u
    UNION ALL SELECT k, 'errors', 'Way back from an error', true, (k + 15) % 4 = 0 OR (k + 16) % 4 = 0 OR (k + 6) % 3 = 0, NULL FROM u)"""


@_query(f"""WITH {_PACKML}, n AS (SELECT k, count(*) FILTER (section = 'states' AND present) AS states, count(*) FILTER (section = 'transitions' AND present) AS transitions, count(*) FILTER (section = 'commands' AND present) AS commands, count(*) FILTER (section = 'modes' AND present) AS modes, count(*) FILTER (section = 'errors' AND present) AS errors FROM e GROUP BY k),
  p AS (SELECT *, round_even(least(100.0::DOUBLE, states / 14 * 20 + transitions / 17 * 20 + commands / 5 * 20 + modes / 3 * 20 + errors / 3 * 20), 0)::INT AS percent FROM n)
  SELECT 'FB_M' || k AS pou, true AS applies, states, transitions, commands, modes, errors, percent, CASE WHEN percent >= 80 THEN 'Conformant' WHEN percent >= 50 THEN 'Partial' ELSE 'Non-conformant' END AS status FROM p
  UNION ALL SELECT 'Plain', false, 0, 0, 0, 0, 0, 0, 'Not Applicable'""")
def packml_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = v._fixed(spark, "Plain", "FUNCTION_BLOCK Plain\nVAR\n\tCmdStart : BOOL;\nEND_VAR\n", "eMode := E_ModuleModes.Manual;")
    n = [F.col(c).cast(LONG).alias(c) for c in packml.SECTIONS]
    return Project(v.packaged(spark, sf_dir).union(plain)).packml.select("pou", "applies", *n, "percent", "status")


@_query(f"""WITH {_PACKML} SELECT 'FB_M' || k AS pou, section, item, required, present, calls_parent FROM e""")
def packml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.packaged(spark, sf_dir)).packml_entries.select("pou", "section", "item", "required", "present", "calls_parent")


_DRIVE = """SELECT 'Drive' || user_id || '.tcdmdrv' AS path, user_id, event_type, count(*) AS n, CASE user_id % 5 WHEN 0 THEN 'Channel: ' || min(event_type) OVER (PARTITION BY user_id) ELSE 'Channel C' || (user_id % 3) END AS channel
  FROM events GROUP BY user_id, event_type"""


@_query(f"""WITH d AS ({_DRIVE}) SELECT DISTINCT path, channel AS section_path, 1 AS level, CASE user_id % 5 WHEN 0 THEN '' ELSE 'ChnId=C' || (user_id % 3) END AS attributes FROM d WHERE user_id % 7 <> 3
  UNION ALL SELECT path, channel || '/Group: ' || event_type, 2, '' FROM d WHERE user_id % 7 <> 3
  UNION ALL SELECT path, channel || '/Group: ' || event_type || '/Block ' || n, 3, 'Id=' || n FROM d WHERE user_id % 7 <> 3""")
def drive_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.drive_files(spark, sf_dir)).drive_sections.select("path", "section_path", "level", F.array_join("attributes", ", ").alias("attributes"))


@_query(f"""WITH d AS ({_DRIVE}), g AS (SELECT *, channel || '/Group: ' || event_type AS s FROM d WHERE user_id % 7 <> 3) SELECT path, s AS section_path, 0 AS ord, 'Name' AS name, event_type AS value FROM g
  UNION ALL SELECT path, s, 1, 'count', n::VARCHAR FROM g UNION ALL SELECT path, s || '/Block ' || n, 0, 'Limit', '<' || (n * 2) FROM g""")
def drive_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.drive_files(spark, sf_dir)).drive_parameters.select("path", "section_path", "ord", "name", "value")


@_query("""SELECT 'Drive' || user_id || '.tcdmdrv' AS path, CASE WHEN c THEN 'Drive' ELSE 'Drive ' END || user_id AS name, CASE WHEN c THEN 'ParseFailed' ELSE 'Parsed' END AS status, CASE WHEN NOT c THEN user_id::VARCHAR END AS item_id,
  CASE WHEN NOT c THEN 'AX' || user_id END AS order_code, CASE WHEN NOT c THEN 'TIID^Drive ' || user_id END AS io_item_path, CASE WHEN NOT c THEN '../line/' || user_id || '.tsproj' END AS project_path
  FROM (SELECT DISTINCT user_id, user_id % 7 = 3 AS c FROM events)""")
def drive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drives.drives(Project(v.drive_files(spark, sf_dir)).files).select("path", "name", "status", "item_id", "order_code", "io_item_path", "project_path")


@_query("""SELECT 'Drives' || (user_id // 100) AS name, '2.0' AS schema_version, count(*)::INT AS n_included, count_if(user_id % 2 = 0)::INT AS n_dependents, string_agg('Sub/Drive' || user_id || '.tcdmdrv', ',' ORDER BY user_id) AS related
  FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id // 100""")
def drive_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drives.projects(Project(v.drive_files(spark, sf_dir)).files).select("name", "schema_version", F.col("n_included").cast("int").alias("n_included"), F.col("n_dependents").cast("int").alias("n_dependents"), F.array_join("related", ",").alias("related"))


@_query("""SELECT 'FB_K' || p_partkey AS owner, 'fbSize' AS name, 'FB_Size' AS data_type, 'nSize := MAX(MIN(ABS(-(' || p_size || ')), 99), 1), nKey := ' || p_partkey AS constructor_args, NULL::VARCHAR AS initial_value, NULL::VARCHAR AS array_bounds FROM part
  UNION ALL SELECT 'FB_K' || p_partkey, 'rRate', 'LREAL', NULL, 'SCALE((nA + 1) * (' || p_partkey || '), 2)', NULL FROM part
  UNION ALL SELECT 'FB_K' || p_partkey, 'aRows', 'FB_Row', 'nRow := (1 + (2))', NULL, '0..(' || p_partkey || ')' FROM part
  UNION ALL SELECT 'FB_K' || p_partkey, 'sText', 'STRING(' || p_partkey || ')', NULL, 'CONCAT(''a'', UPPER(''b''))', NULL FROM part""")
def constructed_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.constructed(spark, sf_dir)).variables.select("owner", "name", "data_type", "constructor_args", "initial_value", "array_bounds")


@_query("""WITH RECURSIVE p AS (SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS i FROM part),
  n AS (SELECT p_brand, count(*) AS n FROM p GROUP BY p_brand), step AS (SELECT p.p_brand, i, j FROM p JOIN n ON p.p_brand = n.p_brand, unnest([2 * i + 1, 2 * i + 2, CASE WHEN i % 10 = 0 THEN i // 2 END]) t(j) WHERE j < n.n),
  r(p_brand, root, i) AS (SELECT p_brand, root, root FROM n, (VALUES (0), (3), (10)) t(root) UNION SELECT r.p_brand, r.root, step.j FROM r JOIN step ON r.p_brand = step.p_brand AND r.i = step.i)
  SELECT p_brand AS project_id, 'fb_l' || root AS root_lc, 'fb_l' || i AS name_lc FROM r""")
def calls_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Project(v.linked_parts(spark, sf_dir))
    roots = p.pous.select("project_id").distinct().select("project_id", F.explode(F.array(*[F.lit(f"FB_L{k}") for k in (0, 3, 10)])).alias("root"))
    return p.calls_reached(roots)


_DETAIL = """WITH d AS (SELECT p_brand, p_partkey AS k, k % 8 AS a, k % 6 AS f, k % 7 AS r FROM part)"""
_LISTED = lambda n, what, start, most: f"{n} || ': ' || array_to_string(['{what}' || i for i in range({start}, least({start} + {most}, {start} + {n}))], ', ')"


@_query(f"""{_DETAIL}, t AS (
  SELECT p_brand, k, 'IEC-002' AS rule_id, CASE WHEN a + f = 0 THEN 'N' WHEN a >= 0.8 * (a + f) THEN 'P' WHEN a >= 0.5 * (a + f) THEN 'W' ELSE 'F' END AS level, a || ' of ' || (a + f) AS detail FROM d
  UNION ALL SELECT p_brand, k, 'IEC-004', CASE WHEN k % 5 = 0 THEN 'W' ELSE 'P' END, CASE WHEN k % 5 = 0 THEN '1: Long0' END FROM d
  UNION ALL SELECT p_brand, k, 'GAMP-006', CASE WHEN k % 5 = 0 THEN 'P' ELSE 'F' END, NULL FROM d
  UNION ALL SELECT p_brand, k, 'ISA-004', CASE WHEN a = 0 THEN 'P' ELSE 'F' END, CASE WHEN a > 0 THEN {_LISTED("a", "bIn", 0, 5)} END FROM d
  UNION ALL SELECT p_brand, k, 'OOP-003', CASE WHEN k % 3 < 2 THEN 'P' ELSE 'W' END, CASE k % 3 WHEN 0 THEN 'FB_DBase' WHEN 1 THEN 'FB_U' || (k % 13) END FROM d
  UNION ALL SELECT p_brand, k, 'OOP-004', CASE WHEN k % 4 = 1 THEN 'P' ELSE 'W' END, CASE WHEN k % 4 = 1 THEN 'I_D, I_E' END FROM d
  UNION ALL SELECT p_brand, k, 'OOP-005', CASE WHEN a + f = 0 THEN 'N' WHEN f > 0 THEN 'P' ELSE 'W' END, f || ' of ' || (a + f) FROM d
  UNION ALL SELECT p_brand, k, 'oop.override_signature', CASE WHEN k % 3 > 0 THEN 'N' WHEN r > 0 THEN 'F' ELSE 'P' END, CASE WHEN r > 0 THEN {_LISTED("r", "Run", 0, 4)} END FROM d
  UNION ALL SELECT p_brand, k, 'oop.abstract_instantiation', CASE WHEN f > 0 THEN 'F' ELSE 'P' END, CASE WHEN f > 0 THEN {_LISTED("f", "_fb", 0, 4)} END FROM d
  UNION ALL SELECT p_brand, k, 'oop.interface_contract', CASE WHEN k % 4 = 1 THEN 'F' ELSE 'N' END, {_LISTED("(7 - r)", "go", "r", 5)} FROM d)
  SELECT p_brand AS project_id, 'FB_D' || k AS module, rule_id, level, CASE WHEN level <> 'N' THEN detail END AS detail FROM t""")
def compliance_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules found in each unit: numbers, and the first few names."""
    told = ("IEC-002", "IEC-004", "GAMP-006", "ISA-004", "OOP-003", "OOP-004", "OOP-005", "oop.override_signature", "oop.abstract_instantiation", "oop.interface_contract")
    rule = Project(v.faulty(spark, sf_dir)).rules.where(F.col("rule_id").isin(*told) & F.col("module").rlike(r"^FB_D\d"))
    return rule.select("project_id", "module", "rule_id", "level", "detail")


@_query(f"""{_DETAIL}, b AS (SELECT DISTINCT p_brand FROM d),
  x AS (SELECT p_brand, 'ISA-P05' AS rule_id, 'FB_D' || k || '.bIn' || i AS what, 10 AS most, row_number() OVER (PARTITION BY p_brand ORDER BY 'FB_D' || k, i) AS place FROM d, range(8) t(i) WHERE i < a
    UNION ALL SELECT p_brand, 'IEC-P04', u, 5, row_number() OVER (PARTITION BY p_brand ORDER BY u) FROM (SELECT DISTINCT p_brand, 'FB_U' || (k % 13) AS u FROM d WHERE k % 3 = 1)
    UNION ALL SELECT p_brand, 'GAMP-P01', 'CM_D' || k, 5, row_number() OVER (PARTITION BY p_brand ORDER BY 'CM_D' || k) FROM d WHERE k % 10 = 0),
  n AS (SELECT p_brand, rule_id, count(*) AS n, count(*) || ': ' || string_agg(what, ', ' ORDER BY place) FILTER (place <= most) AS names FROM x GROUP BY ALL),
  few(rule_id, most) AS (VALUES ('ISA-P05', 0), ('IEC-P04', 5), ('GAMP-P01', 3))
  SELECT b.p_brand AS project_id, few.rule_id, CASE WHEN n IS NULL THEN 'P' WHEN n <= most THEN 'W' ELSE 'F' END AS level, names AS detail FROM b CROSS JOIN few LEFT JOIN n ON n.p_brand = b.p_brand AND n.rule_id = few.rule_id
  UNION ALL SELECT p_brand, 'ISA-P03', CASE WHEN count(*) FILTER (k % 10 = 0) > 0 THEN 'P' ELSE 'W' END, (count(*) FILTER (k % 10 = 0))::VARCHAR FROM d GROUP BY p_brand""")
def compliance_project_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules found in whole projects, a project for each brand."""
    rule = Project(v.faulty(spark, sf_dir)).project_rules.where("rule_id in ('ISA-P05', 'IEC-P04', 'GAMP-P01', 'ISA-P03')")
    return rule.select("project_id", "rule_id", "level", "detail")


@_query("""SELECT 'FB_P' || p_partkey AS owner, 'nSize' AS name, p_size::VARCHAR AS initial_value, (p_partkey % 10 = 0)::INT AS parsed FROM part
  UNION ALL SELECT 'FB_P' || p_partkey, 'rPrice', printf('%.2f', p_retailprice), (p_partkey % 10 = 0)::INT FROM part
  UNION ALL SELECT 'FB_P' || p_partkey, 'eType', NULL, (p_partkey % 10 = 0)::INT FROM part""")
def stored_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables from a store by file after a tenth of the files changed, with the update that
    parsed each."""
    store, now = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"), v.parts(spark, sf_dir)
    changed = F.regexp_extract("path", r"^FB_P(\d+)", 1).try_cast("long") % 10 == 0
    store.update(now.withColumn("content", F.when(changed, F.regexp_replace("content", "nSize", "nFormer")).otherwise(F.col("content"))))
    p = store.update(now)
    at = store.ledger().select("project_id", F.regexp_replace("path", r"\.\w+$", "").alias("owner"), "parsed")
    return p.variables.where("owner_kind = 'pou'").join(at, ["project_id", "owner"]).select("owner", "name", "initial_value", "parsed")


_SAFETY = """WITH s AS (SELECT s_suppkey AS k, 'Safety' || (s_suppkey // 100) || '/' AS home, s_suppkey // 100 AS g FROM supplier)"""


@_query(f"""{_SAFETY} SELECT home || 'Logic/A' || k || '.sal' AS path, 'SafetyLogic' AS category, CASE WHEN c THEN 'ParseFailed' ELSE 'Parsed' END AS status, CASE WHEN c THEN 'A' ELSE 'App ' END || k AS name, NULL AS device_id,
    n AS n_networks, n AS n_blocks, 2 * n AS n_in, n AS n_out, CASE WHEN c THEN '' ELSE 'dsl-version=1.' || (k % 4) || '; network-count=' || n || '; function-block-container-count=' || n || '; in-port-count=' || (2 * n) || '; out-port-count=' || n END AS metadata
    FROM (SELECT *, k % 7 = 3 AS c, CASE WHEN k % 7 = 3 THEN 0 ELSE k % 5 END AS n FROM s WHERE k % 6 <> 1)
  UNION ALL SELECT home || 'Logic/A' || k || '.sal.diagram', 'SafetyDiagram', 'Parsed', 'A' || k || '.sal', NULL, 0, 0, 0, 0, 'dsl-version=unknown; network-shape-count=' || (k % 3) || '; function-block-shape-count=' || (k % 3) || '; port-shape-count=' || (2 * (k % 3)) FROM s WHERE k % 3 <> 0
  UNION ALL SELECT home || 'Alias/D' || k || '.sds', 'SafetyAliasDevice', 'Parsed', 'Device ' || k, (k + 1000)::VARCHAR, 0, 0, 0, 0, 'file-format-version=3; alias-type=' || (k % 9) || '; alias-subtype=unknown; vendor-id=unknown; io-count=' || (k % 4 + 1) FROM s
  UNION ALL SELECT home || 'Line.splcproj', 'SafetyProject', 'Parsed', 'Line', NULL, 0, 0, 0, 0, 'schema-version=2.' || g || '; target-system=unknown; programming-language=unknown; logic-file-count=' || (2 * count(*)) || '; alias-device-count=' || count(*) || '; configuration-file-count=1' FROM s GROUP BY home, g
  UNION ALL SELECT DISTINCT home || 'Target.xml', 'SafetyConfiguration', 'Parsed', 'Target', NULL, 0, 0, 0, 0, 'target-system-type=unknown; target-system-subtype=unknown; software-version=unknown; fsoe-address=' || g || '; ams-net-id=unknown' FROM s""")
def safety_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Project(v.safety_files(spark, sf_dir)).safety_artifacts
    return p.select("path", "category", "status", "name", "device_id", "n_networks", "n_blocks", "n_in", "n_out", F.array_join("metadata", "; ").alias("metadata"))


@_query(f"""{_SAFETY} SELECT home || 'Line.splcproj' AS path, 'Logic/A' || k || '.sal' AS related, CASE WHEN k % 6 <> 1 THEN home || 'Logic/A' || k || '.sal' END AS target, CASE WHEN k % 6 <> 1 THEN 'SafetyLogic' END AS target_category FROM s
  UNION ALL SELECT home || 'Line.splcproj', 'Alias/D' || k || '.sds', home || 'Alias/D' || k || '.sds', 'SafetyAliasDevice' FROM s
  UNION ALL SELECT DISTINCT home || 'Line.splcproj', 'Target.xml', home || 'Target.xml', 'SafetyConfiguration' FROM s
  UNION ALL SELECT home || 'Logic/A' || k || '.sal.diagram', 'A' || k || '.sal', CASE WHEN k % 6 <> 1 THEN home || 'Logic/A' || k || '.sal' END, CASE WHEN k % 6 <> 1 THEN 'SafetyLogic' END FROM s WHERE k % 3 <> 0""")
def safety_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.safety_files(spark, sf_dir)).safety_links.select("path", "related", "target", "target_category")


@_query(f"""{_SAFETY} SELECT home || 'Alias/D' || k || '.sds' AS path, i::INT AS ord, CASE WHEN i < k % 4 THEN 'In' || i ELSE 'Unnamed IO' END AS name, CASE WHEN i < k % 4 THEN 'BOOL' ELSE '' END AS data_type, CASE WHEN i < k % 4 THEN '1' ELSE '' END AS bit_size, CASE WHEN i < k % 4 THEN i::VARCHAR ELSE '' END AS bit_offset
  FROM s, range(4) t(i) WHERE i <= k % 4""")
def safety_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Project(v.safety_files(spark, sf_dir)).safety_ios.select("path", "ord", "name", "data_type", "bit_size", "bit_offset")
