"""Compliance rules: one feature row for each unit, one row out for each unit and rule.

A rule is a column of levels (P pass, W warning, F fail, N not applicable) over the feature
row, so that all module rules are one projection and one unpivot, without a join. Beside its
level stands a detail: a number, and the first few names that it comes from. Names of one unit
are gathered with its other features; those of a whole project are cut to the first few before
they are gathered, so that no task ever holds more than these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx

#: Recognised prefixes, generic names, type prefixes, reserved words.
PREFIXES = ("UM_", "EM_", "CM_", "DM_", "FB_", "PRG_", "FC_", "I_", "E_", "ST_")
CASED = ("UM_", "EM_", "CM_", "DM_", "FB_", "I_", "E_", "ST_")
GENERIC = ("test", "main", "module", "base", "temp", "helper", "utils", "utility", "misc", "common")
HUNGARIAN = ("b", "n", "f", "lf", "s", "t", "dt", "a", "st", "e", "fb", "i", "p", "ref", "dw", "w", "by", "di", "_")
RESERVED = (
    "AND OR NOT XOR MOD TO IF THEN ELSE ELSIF END_IF CASE OF END_CASE FOR WHILE REPEAT UNTIL END_FOR END_WHILE END_REPEAT EXIT CONTINUE RETURN TRUE FALSE VAR VAR_INPUT VAR_OUTPUT VAR_IN_OUT "
    "VAR_GLOBAL VAR_TEMP VAR_STAT END_VAR FUNCTION FUNCTION_BLOCK PROGRAM METHOD PROPERTY INTERFACE EXTENDS IMPLEMENTS ABSTRACT FINAL PUBLIC PROTECTED PRIVATE INTERNAL SUPER THIS ARRAY"
).split()

#: How many names a detail shows (fixed values).
SHOWN = {
    "ISA-004": 5, "oop.override_super_call": 5, "oop.property_accessor_pairing": 5, "naming.member_casing": 4, "naming.reserved_words": 5, "xml.guid_format": 3, "oop.override_signature": 4, "oop.abstract_contract": 4,
    "oop.abstract_instantiation": 4, "oop.diamond_inheritance": 3, "oop.interface_contract": 5, "IEC-P04": 5, "ISA-P05": 10, "GAMP-P01": 5, "xml.guid_uniqueness": 10,
}
#: Units that are named for one GUID (fixed value).
HOLDERS = 4


def names_in(where: Column, order: Column, name: Column, most: int | None = None) -> Column:
    """An aggregate over what one unit holds: the names where `where` holds, joined in the
    order of `order`; the first `most` of them."""
    found = F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(order.alias("o"), name.alias("x"))))), lambda r: r.x)
    return F.array_join(found if most is None else F.slice(found, 1, most), ", ")


def first_names(rows: DataFrame, keys: list[str], order: list[str], name: str, most: int) -> DataFrame:
    """keys, n, names: how many rows there are under each key, and the first `most` names in
    their order. Every task passes on its own first ones and its count alone."""
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(name).alias("x")))), lambda r: r.x), ", ")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(first.groupBy(*keys).agg(text.alias("names")), keys)


def raw_features(files: DataFrame) -> DataFrame:
    """project_id, path and what rules on a unit's whole file look at: lines that begin with a
    tab or a space, runs of blank lines, GUIDs and what looks like one, properties' VAR blocks."""
    n = lambda pattern: F.regexp_count("content", F.lit(pattern))
    code = F.transform(F.slice(F.split("content", r"(?i)<Property\b"), 2, 1 << 30), lambda x: F.split(F.split(x, "(?i)<(?:Get|Set)\\b|</Property>")[0], r"\]\]>")[0])
    guid = r"\{[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\}"
    odd = F.filter(F.regexp_extract_all("content", F.lit(r"\{[0-9A-Fa-f-]{20,}+\}"), F.lit(0)), lambda g: ~g.rlike(f"^{guid}$"))
    return files.where("ext = 'tcpou'").select(
        "project_id", "path", F.array_join(F.slice(odd, 1, SHOWN["xml.guid_format"]), ", ").alias("odd_guids"), n(r"(?md)^\t").alias("n_tabbed"), n(r"(?md)^ ").alias("n_spaced"), fx.blank_run(F.col("content")).alias("blank_run"), n(r"\{[0-9A-Fa-f-]{20,}+\}").alias("n_guid_like"),
        n(guid).alias("n_guids"), F.size(F.filter(code, lambda x: x.rlike(r"(?i)\bVAR\b") & x.rlike("(?i)END_VAR"))).alias("n_var_properties"),
    )


def features(pou: DataFrame, variable: DataFrame, method: DataFrame, prop: DataFrame, chain: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each unit; members and the unit's file are aggregated before they are joined."""
    key = ["project_id", "pou_lc"]
    hungarian = F.col("name").rlike(rf"^({'|'.join(sorted(HUNGARIAN, key=len, reverse=True))})[A-Z]")
    ruled = F.col("scope").isin("Local", "Input", "Output", "InOut", "Stat")
    count = lambda c: F.sum(c.cast("long"))
    v = variable.where("owner_kind = 'pou'").withColumnRenamed("owner_lc", "pou_lc").groupBy(*key).agg(
        count(ruled).alias("n_ruled"), count(ruled & hungarian).alias("n_hungarian"), count(F.col("scope") == "Input").alias("n_in"), count(F.col("scope") == "Output").alias("n_out"), count(F.col("scope") == "InOut").alias("n_inout"),
        count(F.col("scope") == "Local").alias("n_local"), count((F.col("scope") == "Local") & F.col("name").startswith("_")).alias("n_private"), count((F.col("scope") == "Output") & F.lower("name").contains("error")).alias("n_error_out"),
        count(F.col("at_binding").isNotNull()).alias("n_at"), count(F.upper("name").isin(*RESERVED)).alias("n_reserved"), count((F.col("scope") == "Local") & ~F.col("name").rlike("^[A-Za-z_]")).alias("n_odd_local"),
        names_in(F.col("at_binding").isNotNull(), F.col("ord"), F.col("name"), SHOWN["ISA-004"]).alias("bound"), names_in(F.upper("name").isin(*RESERVED), F.col("ord"), F.col("name"), SHOWN["naming.reserved_words"]).alias("reserved"),
        names_in((F.col("scope") == "Local") & ~F.col("name").rlike("^[A-Za-z_]"), F.col("ord"), F.col("name"), SHOWN["naming.member_casing"]).alias("odd_locals"),
    )
    lower = F.col("method_lc")
    lines = F.size(F.split("body", "\n"))
    super_free = F.col("method").startswith("_") & (F.col("body") != "") & ~F.lower("body").contains("super^")
    life = F.col("method").isin("FB_init", "FB_exit", "FB_reinit")
    m = method.groupBy(*key).agg(
        count(~life).alias("n_methods"), F.max(lines).alias("longest_method"), count(lines > 150).alias("n_long"), names_in(lines > 150, F.col("ord"), F.col("method")).alias("long_methods"), count(lower == "fb_init").alias("n_init"), count(lower == "fb_exit").alias("n_exit"), count(F.col("visibility") != "Public").alias("n_hidden"),
        count(lower.isin("_alarms", "alarms")).alias("n_alarms_method"), count(lower.contains("simulat")).alias("n_simulation"), count(lower.rlike("auto|manual|mode|phase|operation")).alias("n_modes"), count(lower.contains("alarm")).alias("n_alarm_methods"),
        F.sum(F.length(fx.strip(F.coalesce("body", F.lit(""))))).alias("n_method_code"), count(super_free).alias("n_without_super"), names_in(super_free, F.col("ord"), F.col("method"), SHOWN["oop.override_super_call"]).alias("without_super"), count(F.lit(True)).alias("n_all_methods"),
    )
    bare = ~F.col("has_get") & ~F.col("has_set")
    p = prop.groupBy(*key).agg(count(F.lit(True)).alias("n_properties"), count(bare).alias("n_bare_properties"), names_in(bare, F.col("ord"), F.col("property"), SHOWN["oop.property_accessor_pairing"]).alias("bare_properties"))
    c = chain.groupBy(*key).agg(F.max(F.col("cyclic").cast("int")).alias("cyclic"))
    out = pou.select("project_id", "path", "name", F.col("name_lc").alias("pou_lc"), "pou_type", "extends_type", "implements", F.size("implements").alias("n_implements"), "is_abstract", "implementation", fx.layer(F.col("name")).alias("layer"))
    out = out.join(raw_features(files), ["project_id", "path"], "left").withColumn("blank_run", F.coalesce("blank_run", F.lit(False)))
    for part in (v, m, p, c):
        out = out.join(part, key, "left")
    counts = [x for x in out.columns if x.startswith("n_")] + ["longest_method", "cyclic"]
    return out.fillna(0, subset=counts)


def _level(ok: Column, otherwise: str = "W", applies: Column | None = None, middle: Column | None = None) -> Column:
    level = F.when(ok, "P")
    if middle is not None:
        level = level.when(middle, "W")
    level = level.otherwise(otherwise)
    return level if applies is None else F.when(applies, level).otherwise("N")


def module_rules() -> dict[str, tuple[str, Column]]:
    """Rule -> (standard, level)."""
    c = F.col
    fb, layer, name = c("pou_type") == "FunctionBlock", c("layer"), c("name")
    plant, control = layer.isin("UM", "EM"), layer == "CM"
    ratio = c("n_hungarian") / F.nullif(c("n_ruled"), F.lit(0))
    code = F.length(fx.strip(F.coalesce("implementation", F.lit("")))) + c("n_method_code")
    indented = c("n_tabbed") + c("n_spaced")
    prefixed = F.upper(name).rlike(f"^({'|'.join(PREFIXES)})")
    cased = F.exists(F.array(*[F.lit(p) for p in CASED]), lambda p: name.startswith(p))
    rules = {
        "IEC-001": _level(prefixed), "IEC-002": _level(ratio >= 0.8, "F", c("n_ruled") > 0, ratio >= 0.5),
        "IEC-003": _level(F.lit(True), applies=c("n_methods") > 0), "IEC-004": _level(c("longest_method") <= 150, "F", middle=c("longest_method") <= 300),
        "IEC-005": _level(c("n_in") + c("n_out") + c("n_inout") > 0, applies=fb),
        "OOP-001": _level(c("n_init") > 0, applies=fb), "OOP-002": _level(c("n_exit") > 0, applies=fb), "OOP-003": _level(c("extends_type").isNotNull(), applies=fb), "OOP-004": _level(c("n_implements") > 0, applies=fb),
        "OOP-005": _level(c("n_private") > 0, applies=fb & (c("n_local") > 0)), "OOP-006": _level(c("n_properties") > 0, applies=fb), "OOP-007": _level(c("n_error_out") > 0, applies=fb), "OOP-008": _level(c("n_hidden") > 0, applies=fb & (c("n_all_methods") > 0)),
        "ISA-001": _level(layer != "Other"), "ISA-002": _level(c("n_alarms_method") > 0, "F", plant), "ISA-003": _level(c("n_simulation") > 0, applies=control), "ISA-004": _level(c("n_at") == 0, "F", fb & ~control),
        "ISA-005": _level(c("n_modes") > 0, applies=plant), "ISA-006": _level(F.coalesce(F.upper("extends_type").contains("BASECLASS"), F.lit(False)), applies=plant | control),
        "GAMP-001": _level(c("n_in") > 0), "GAMP-002": _level(c("n_out") > 0), "GAMP-003": _level(c("n_alarm_methods") > 0), "GAMP-004": _level(layer != "Other"), "GAMP-005": _level(c("extends_type").isNotNull()),
        "GAMP-006": _level(code > 100, "F", middle=code > 0), "GAMP-007": _level(~F.regexp_replace(F.lower(name), "^_+", "").isin(*GENERIC)),
        "oop.extends_cycle": _level(c("cyclic") == 0, "F", c("extends_type").isNotNull()), "oop.override_super_call": _level(c("n_without_super") == 0), "oop.property_accessor_pairing": _level(c("n_bare_properties") == 0, "F"),
        "oop.method_count": _level(c("n_all_methods") <= 30), "naming.isa88_prefix_casing": F.when(name.rlike("^(um|em|cm|dm|fb)_"), "F").when(fb & ~cased, "W").otherwise("P"), "naming.member_casing": _level(c("n_odd_local") == 0),
        "naming.reserved_words": _level(c("n_reserved") == 0, "F"), "structure.property_var_blocks": _level(c("n_var_properties") == 0, applies=c("n_properties") > 0), "style.indentation_tabs": _level(c("n_spaced") < 0.1 * indented, applies=indented > 0),
        "style.excessive_blank_lines": _level(~c("blank_run")), "xml.guid_format": _level(c("n_guid_like") == c("n_guids"), "F"),
    }
    standard = {"IEC": "IEC 61131-3", "OOP": "OOP", "ISA": "ISA-88", "GAMP": "GAMP 5"}
    return {k: (standard.get(k.split("-")[0], "Architecture"), v) for k, v in rules.items()}


def module_details() -> dict[str, Column]:
    """Rule -> what its level comes from; null where there is nothing to name."""
    c = F.col
    of = lambda n, all_: F.concat_ws(" of ", n.cast("string"), all_.cast("string"))
    listed = lambda n, names: F.when(c(n) > 0, F.concat_ws(": ", c(n).cast("string"), c(names)))
    layer = F.when(c("layer") != "Other", c("layer")).otherwise(c("name"))
    number = lambda n: c(n).cast("string")
    return {
        "IEC-001": F.when(~F.upper(c("name")).rlike(f"^({'|'.join(PREFIXES)})"), c("name")), "IEC-002": of(c("n_hungarian"), c("n_ruled")), "IEC-003": number("n_methods"), "IEC-004": listed("n_long", "long_methods"),
        "OOP-003": c("extends_type"), "OOP-004": F.nullif(F.array_join("implements", ", "), F.lit("")), "OOP-005": of(c("n_private"), c("n_local")), "OOP-006": number("n_properties"), "OOP-008": of(c("n_hidden"), c("n_all_methods")),
        "ISA-001": layer, "ISA-004": listed("n_at", "bound"), "ISA-006": c("extends_type"), "GAMP-001": number("n_in"), "GAMP-002": number("n_out"), "GAMP-004": layer, "GAMP-005": c("extends_type"),
        "oop.override_super_call": listed("n_without_super", "without_super"), "oop.property_accessor_pairing": listed("n_bare_properties", "bare_properties"), "oop.method_count": number("n_all_methods"),
        "naming.member_casing": listed("n_odd_local", "odd_locals"), "naming.reserved_words": listed("n_reserved", "reserved"), "structure.property_var_blocks": number("n_var_properties"),
        "style.indentation_tabs": of(c("n_spaced"), c("n_tabbed") + c("n_spaced")), "xml.guid_format": F.nullif(c("odd_guids"), F.lit("")),
    }


def evaluate(feature: DataFrame) -> DataFrame:
    """project_id, module, standard, rule_id, level, detail (null where the rule doesn't apply)."""
    rules, detail = module_rules(), module_details()
    # levels and details are columns first, so that a level that its detail looks at is computed once
    feature = feature.withColumns({f"level {k}": level for k, (_, level) in rules.items()})
    level = {k: F.col(f"`level {k}`") for k in rules}
    said = {k: F.when(level[k] != "N", detail[k]) if k in detail else F.lit(None).cast("string") for k in rules}
    feature = feature.select("project_id", F.col("name").alias("module"), *level.values(), *[x.alias(f"detail {k}") for k, x in said.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("standard"), F.lit(k).alias("rule_id"), level[k].alias("level"), F.col(f"`detail {k}`").alias("detail")) for k, (s, _) in rules.items()])
    return feature.select("project_id", "module", F.inline(rows))


def project_rules(pou: DataFrame, gvl: DataFrame, dut: DataFrame, variable: DataFrame, method: DataFrame, unresolved: DataFrame) -> DataFrame:
    """project_id, standard, rule_id, level, detail of the rules on whole projects."""
    names = F.col("name_lc")
    layer = fx.layer(F.col("name"))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    key = ["project_id"]
    alarmed = method.where("method_lc like '%alarm%'").select("project_id", F.col("pou_lc").alias("name_lc")).distinct()
    p = pou.groupBy("project_id").agg(any_((F.col("pou_type") == "Program") & (names.startswith("prg_") | (names == "main"))).alias("main"), *[F.count_if(layer == x).alias(x.lower()) for x in ("UM", "EM", "CM")])
    g = gvl.groupBy("project_id").agg(any_(names.contains("objects")).alias("objects"), F.count(F.lit(1)).alias("gvls"))
    d = dut.groupBy("project_id").agg(F.count(F.lit(1)).alias("duts"), F.count_if(F.col("dut_type") == "Enum").alias("enums"), F.count_if(F.col("dut_type") == "Struct").alias("structs"))
    first = lambda rows, order, name, rule, n: first_names(rows, key, order, name, SHOWN[rule]).select("project_id", F.col("n").alias(n), F.concat_ws(": ", F.col("n").cast("string"), "names").alias(f"{n}_names"))
    u = first(unresolved, ["type_name"], "type_name", "IEC-P04", "unknown")
    bound = variable.where("owner_kind = 'pou' and at_binding is not null and not owner_lc like 'cm#_%' escape '#'").withColumn("place", F.concat_ws(".", "owner", "name"))
    a = first(bound, ["owner", "ord"], "place", "ISA-P05", "stray")
    q = first(pou.where(layer.isin("UM", "EM", "CM")).join(alarmed, ["project_id", "name_lc"], "left_anti"), ["name"], "name", "GAMP-P01", "quiet")
    x = p
    for part in (g, d, u, a, q):
        x = x.join(part, "project_id", "left")
    x = x.fillna(0)
    on = lambda c, bad="W": F.when(F.col(c) > 0, "P").otherwise(bad)
    number = lambda c: F.col(c).cast("string")
    few = lambda c, most: F.when(F.col(c) == 0, "P").when(F.col(c) <= most, "W").otherwise("F")
    none = F.lit(None).cast("string")
    rules = {
        ("IEC 61131-3", "IEC-P01"): (on("main", "F"), none), ("IEC 61131-3", "IEC-P02"): (on("duts"), number("duts")), ("IEC 61131-3", "IEC-P03"): (on("gvls"), number("gvls")), ("IEC 61131-3", "IEC-P04"): (few("unknown", 5), F.col("unknown_names")),
        ("ISA-88", "ISA-P01"): (on("objects", "F"), none), ("ISA-88", "ISA-P02"): (on("um", "F"), none), ("ISA-88", "ISA-P03"): (on("cm"), number("cm")), ("ISA-88", "ISA-P04"): (on("em"), number("em")),
        ("ISA-88", "ISA-P05"): (F.when(F.col("stray") == 0, "P").otherwise("F"), F.col("stray_names")),
        ("GAMP 5", "GAMP-P01"): (few("quiet", 3), F.col("quiet_names")), ("GAMP 5", "GAMP-P02"): (on("enums"), number("enums")), ("GAMP 5", "GAMP-P03"): (on("structs"), number("structs")),
    }
    return x.select("project_id", F.inline(F.array(*[F.struct(F.lit(s).alias("standard"), F.lit(k).alias("rule_id"), level.alias("level"), detail.alias("detail")) for (s, k), (level, detail) in rules.items()])))


def scores(rule: DataFrame, *keys: str) -> DataFrame:
    """keys, standard, n_pass, n_warning, n_fail, score, percent, level. Percent is rounded
    half to even; a standard none of whose rules applies scores 1 and has level N/A."""
    n = lambda x: F.sum((F.col("level") == x).cast("long"))
    out = rule.groupBy(*keys, "standard").agg(n("P").alias("n_pass"), n("W").alias("n_warning"), n("F").alias("n_fail"))
    applied = F.col("n_pass") + F.col("n_warning") + F.col("n_fail")
    score = F.when(applied == 0, 1.0).otherwise((F.col("n_pass") + 0.5 * F.col("n_warning")) / applied)
    level = F.when(applied == 0, "N/A").when(F.col("n_fail") > 0, "Fail").when(score >= 0.9, "Pass").when(score >= 0.6, "Warning").otherwise("Fail")
    return out.withColumn("score", score).withColumn("percent", F.bround(F.col("score") * 100, 0).cast("int")).withColumn("level", level)


def overall(score: DataFrame, *keys: str) -> DataFrame:
    return score.groupBy(*keys).agg(F.avg("score").alias("score"))


def guid_uniqueness(pou: DataFrame) -> DataFrame:
    """project_id, guid, n_units, units (the first HOLDERS) of the GUIDs that several units hold."""
    each = pou.select("project_id", "name_lc", F.explode(F.regexp_extract_all(F.lower(F.concat_ws("\n", "declaration", "implementation")), F.lit(r"\{([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})\}"), F.lit(1))).alias("guid")).distinct()
    return first_names(each, ["project_id", "guid"], ["name_lc"], "name_lc", HOLDERS).where("n > 1").withColumnsRenamed({"n": "n_units", "names": "units"})
