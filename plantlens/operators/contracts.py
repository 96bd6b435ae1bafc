"""Rules that look from a unit to others: its parent, its interfaces, the types it holds.

Each rule is a relation of faults (project_id, pou_lc), one row for each thing that is wrong.
All are counted in one aggregation by unit, then levels are columns over the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import closure, compliance, declarations

DEEPEST = 6  # fixed value: units nested deeper than this are reported
ABSTRACT_METHOD = r"(?im)^[ \t]*METHOD(?:[ \t]+(?:PUBLIC|PROTECTED|PRIVATE|INTERNAL))?[ \t]+ABSTRACT[ \t]+(\w+)"
KEY = ["project_id", "pou_lc"]


def parameters(method: DataFrame) -> DataFrame:
    """project_id, pou_lc, method_lc, types: the lower-cased types of a method's inputs,
    outputs and in-outs in their order. Methods without any have no row."""
    owner = F.concat_ws(".", "pou_lc", "method_lc")
    found = declarations.variables(method.select("project_id", F.lit("method").alias("owner_kind"), owner.alias("owner"), "declaration"))
    typed = F.array_sort(F.collect_list(F.struct("ord", F.lower("data_type").alias("type"))))
    lists = found.where("scope in ('Input', 'Output', 'InOut')").groupBy("project_id", "owner").agg(typed.alias("t"))
    return lists.select("project_id", F.substring_index("owner", ".", 1).alias("pou_lc"), F.substring_index("owner", ".", -1).alias("method_lc"), F.col("t.type").alias("types"))


def changed_overrides(pou: DataFrame, method: DataFrame) -> DataFrame:
    """project_id, pou_lc, what (the name) of methods whose parameter types or return type differ from
    those of the direct parent's method of that name."""
    types = F.coalesce("types", F.array().cast("array<string>"))
    m = method.join(parameters(method), ["project_id", "pou_lc", "method_lc"], "left").select("project_id", "pou_lc", "method_lc", "method", types.alias("types"), F.lower(F.coalesce("return_type", F.lit(""))).alias("gives"))
    parent = pou.select("project_id", F.col("name_lc").alias("pou_lc"), F.lower("extends_type").alias("of_lc")).where("of_lc is not null")
    base = m.select("project_id", F.col("pou_lc").alias("of_lc"), "method_lc", F.col("types").alias("base_types"), F.col("gives").alias("base_gives"))
    return m.join(parent, KEY).join(base, ["project_id", "of_lc", "method_lc"]).where("types <> base_types or gives <> base_gives").select(*KEY, F.col("method").alias("what"))


def abstract_methods(pou: DataFrame, method: DataFrame) -> DataFrame:
    """project_id, of_lc, method_lc of abstract units: methods with the word, whether in an
    element of their own or in the unit's text."""
    text = F.concat_ws("\n", "declaration", "implementation")
    written = pou.where("is_abstract").select("project_id", F.col("name_lc").alias("of_lc"), F.explode(F.regexp_extract_all(text, F.lit(ABSTRACT_METHOD), F.lit(1))).alias("method_lc"))
    own = method.where("is_abstract").select("project_id", F.col("pou_lc").alias("of_lc"), "method_lc").join(pou.where("is_abstract").select("project_id", F.col("name_lc").alias("of_lc")), ["project_id", "of_lc"], "left_semi")
    return own.union(written.withColumn("method_lc", F.lower("method_lc"))).distinct()


def _lacking(edge: DataFrame, wanted: DataFrame, method: DataFrame) -> DataFrame:
    """Methods of `wanted` (project_id, of_lc, method_lc) that the units of `edge`
    (project_id, pou_lc, of_lc) don't have."""
    return edge.join(wanted, ["project_id", "of_lc"]).join(method.select(*KEY, "method_lc"), [*KEY, "method_lc"], "left_anti").select(*KEY, F.col("method_lc").alias("what"))


def diamonds(pou: DataFrame, chain: DataFrame) -> DataFrame:
    """project_id, pou_lc, ancestor_lc: what two or more of a unit's interfaces derive from."""
    own = pou.select("project_id", F.col("name_lc").alias("unit_lc"), F.explode("implements").alias("iface")).withColumn("iface", F.lower("iface")).distinct()
    up = chain.select("project_id", F.col("pou_lc").alias("iface"), "ancestor_lc").distinct()
    return own.join(up, ["project_id", "iface"]).groupBy("project_id", F.col("unit_lc").alias("pou_lc"), "ancestor_lc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def composition_depth(pou: DataFrame, variable: DataFrame, most: int = DEEPEST + 1) -> DataFrame:
    """project_id, pou_lc, depth of units that hold variables of units' types: the longest
    path from type to type, the unit itself counted, looked at up to `most`. A type that is
    met again on its path counts and ends the path.

    Walks are counted by their ends: a round has one row for each unit and type, however many
    ways lead there. Only units that reach a type within a cycle need their paths."""
    unit = pou.select("project_id", F.col("name_lc").alias("type_lc"))
    held = variable.where("owner_kind = 'pou'").select("project_id", "owner_lc", F.lower("data_type").alias("type_lc")).join(unit, ["project_id", "type_lc"], "left_semi").select("project_id", "owner_lc", "type_lc").distinct()
    step = held.select("project_id", F.col("owner_lc").alias("type_lc"), F.col("type_lc").alias("to_lc"))
    round_ = held.select("project_id", F.col("owner_lc").alias("pou_lc"), "type_lc")
    walk = round_.withColumn("depth", F.lit(2))
    for k in range(3, most + 1):
        round_ = round_.join(step, ["project_id", "type_lc"]).select("project_id", "pou_lc", F.col("to_lc").alias("type_lc")).distinct()
        walk = walk.union(round_.withColumn("depth", F.lit(k)))
    walk = walk.groupBy(*KEY, "type_lc").agg(F.max("depth").alias("depth"))
    cyclic = walk.where("pou_lc = type_lc").select("project_id", "type_lc")
    entangled = walk.join(cyclic, ["project_id", "type_lc"], "left_semi").select("project_id", F.col("pou_lc").alias("owner_lc")).distinct()
    path = closure._sql(
        pou.sparkSession,
        f"""WITH RECURSIVE t AS (
          SELECT project_id, owner_lc AS pou_lc, type_lc, array(owner_lc, type_lc) AS path, owner_lc = type_lc AS ended FROM {{start}}
          UNION ALL
          SELECT t.project_id, t.pou_lc, h.type_lc, concat(t.path, array(h.type_lc)), array_contains(t.path, h.type_lc)
          FROM t JOIN {{held}} h ON t.project_id = h.project_id AND t.type_lc = h.owner_lc
          WHERE NOT t.ended AND size(t.path) < {int(most)}
        ) SELECT project_id, pou_lc, size(path) AS depth FROM t""",
        start=held.join(entangled, ["project_id", "owner_lc"], "left_semi"), held=held,
    )
    plain = walk.join(entangled.withColumnRenamed("owner_lc", "pou_lc"), KEY, "left_anti").select(*KEY, "depth")
    return plain.union(path).groupBy(*KEY).agg(F.max("depth").alias("depth"))


def faults(pou: DataFrame, variable: DataFrame, method: DataFrame, chain: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, pou_lc, rule_id, what: one row for each thing that breaks a rule."""
    implemented = pou.select("project_id", F.col("name_lc").alias("pou_lc"), F.explode("implements").alias("of_lc")).withColumn("of_lc", F.lower("of_lc"))
    derived = pou.where("not is_abstract and extends_type is not null").select("project_id", F.col("name_lc").alias("pou_lc"), F.lower("extends_type").alias("of_lc"))
    abstract = pou.where("is_abstract").select("project_id", F.col("name_lc").alias("type_lc"))
    typed = variable.where("owner_kind = 'pou'").select("project_id", F.col("owner_lc").alias("pou_lc"), F.lower("data_type").alias("type_lc"), F.col("name").alias("what"))
    unended = files.where("ext = 'tcpou' and not endswith(content, '\n')").select("project_id", "path")
    found = {
        "oop.override_signature": changed_overrides(pou, method),
        "oop.abstract_contract": _lacking(derived, abstract_methods(pou, method), method),
        "oop.abstract_instantiation": typed.join(abstract, ["project_id", "type_lc"], "left_semi"),
        "oop.diamond_inheritance": diamonds(pou, chain).withColumn("what", F.col("ancestor_lc")),
        "oop.composition_depth": composition_depth(pou, variable).where(F.col("depth") > DEEPEST).withColumn("what", F.lit("")),
        "oop.interface_contract": _lacking(implemented, method.select("project_id", F.col("pou_lc").alias("of_lc"), "method_lc"), method),
        "structure.file_ending": pou.join(unended, ["project_id", "path"], "left_semi").withColumn("pou_lc", F.col("name_lc")).withColumn("what", F.lit("")),
    }
    return reduce(DataFrame.union, [df.select(*KEY, F.lit(rule).alias("rule_id"), "what") for rule, df in found.items()])


def evaluate(pou: DataFrame, variable: DataFrame, method: DataFrame, chain: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, module, standard, rule_id, level, detail, as compliance.evaluate has them;
    what breaks a rule is named in the order of the names."""
    worst = {
        "oop.override_signature": ("F", F.col("parent_known")), "oop.abstract_contract": ("F", ~F.col("is_abstract") & F.col("parent_promises")), "oop.abstract_instantiation": ("F", F.lit(True)),
        "oop.diamond_inheritance": ("W", F.size("implements") > 1), "oop.composition_depth": ("W", F.lit(True)), "oop.interface_contract": ("F", F.size("implements") > 0), "structure.file_ending": ("W", F.lit(True)),
    }
    text = F.lit(None).cast("string")
    for rule in worst:
        if rule in compliance.SHOWN:
            text = F.when(F.col("rule_id") == rule, F.concat_ws(": ", F.size("all").cast("string"), F.array_join(F.slice("all", 1, compliance.SHOWN[rule]), ", "))).otherwise(text)
    found = faults(pou, variable, method, chain, files).groupBy(*KEY, "rule_id").agg(F.array_sort(F.collect_list("what")).alias("all"))
    broken = found.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("rule_id", F.coalesce(text, F.lit("")).alias("text")))).alias("broken"))
    parent = pou.select("project_id", F.col("name_lc").alias("parent_lc"), F.lit(True).alias("parent_known"))
    promises = abstract_methods(pou, method).select("project_id", F.col("of_lc").alias("parent_lc"), F.lit(True).alias("parent_promises")).distinct()
    no = F.lit(False)
    unit = (
        pou.select("project_id", F.col("name").alias("module"), F.col("name_lc").alias("pou_lc"), F.lower("extends_type").alias("parent_lc"), "implements", "is_abstract")
        .join(parent, ["project_id", "parent_lc"], "left").join(promises, ["project_id", "parent_lc"], "left").join(broken, KEY, "left")
        .withColumn("parent_known", F.coalesce("parent_known", no)).withColumn("parent_promises", F.coalesce("parent_promises", no))
    )
    text = {rule: F.col("broken")[rule] for rule in worst}
    rows = [F.struct(F.lit("Architecture").alias("standard"), F.lit(rule).alias("rule_id"), F.when(~applies, "N").when(text[rule].isNotNull(), bad).otherwise("P").alias("level"), F.when(applies, F.nullif(text[rule], F.lit(""))).alias("detail")) for rule, (bad, applies) in worst.items()]
    return unit.select("project_id", "module", F.inline(F.array(*rows)))


def project_rules(pou: DataFrame, files: DataFrame, formal: DataFrame, informal: DataFrame) -> DataFrame:
    """project_id, standard, rule_id, level, detail of two rules on whole projects: no GUID in the
    files of several units, and sequences that are declared machines (`formal`, one row for
    each) and not only cases over an enumeration (`informal`)."""
    raw = pou.select("project_id", "path", "name_lc").join(files.select("project_id", "path", "content"), ["project_id", "path"])
    twice = compliance.guid_uniqueness(raw.select("project_id", "name_lc", F.col("content").alias("declaration"), F.lit("").alias("implementation")))
    twice = compliance.first_names(twice.withColumn("what", F.concat(F.col("guid"), F.lit(" ("), "units", F.lit(")"))), ["project_id"], ["guid"], "what", compliance.SHOWN["xml.guid_uniqueness"])
    twice = twice.select("project_id", F.lit(True).alias("twice"), F.concat_ws(": ", F.col("n").cast("string"), "names").alias("guids"))
    some = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    x = pou.select("project_id").distinct().join(twice, "project_id", "left").join(some(formal, "formal"), "project_id", "left").join(some(informal, "informal"), "project_id", "left")
    rules = {
        ("GAMP 5", "GAMP-P04"): (F.when(F.col("formal") > 0, "P").when(F.col("informal") > 0, "W").otherwise("N"), F.concat_ws(", ", F.concat(F.col("formal").cast("string"), F.lit(" declared")), F.concat(F.col("informal").cast("string"), F.lit(" by cases")))),
        ("XML integrity", "xml.guid_uniqueness"): (F.when(F.col("twice"), "F").otherwise("P"), F.col("guids")),
    }
    return x.select("project_id", F.inline(F.array(*[F.struct(F.lit(s).alias("standard"), F.lit(k).alias("rule_id"), level.alias("level"), F.nullif(detail, F.lit("")).alias("detail")) for (s, k), (level, detail) in rules.items()])))
