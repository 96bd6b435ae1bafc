"""State machines: CASE selectors over enum variables, their states, transitions and guards.

Bodies are read as lines. The label or guard that governs a line is the last one before it:
an as-of join, written as a window over each body's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx

WRAPPER = "dm_statemachine"  # fixed value
LABEL = r"^\s*((?:\w+\.)?\w+)\s*:\s*$"


def wrappers(all_variable: DataFrame) -> DataFrame:
    """project_id, pou_lc, name_lc, selector, display_name, initial_state, transition_state,
    enum_type of the wrapper instances: what their constructor is given. The first text is the
    name, the first two members of enumerations are the states; those of lines that go on a
    constructor (read as variables InitialState and TransitionState) follow its own."""
    members = lambda text: F.regexp_extract_all(text, F.lit(r"\b(E_\w++\.\w++)"), F.lit(1))
    goes_on = F.concat_ws(" ", "data_type", "constructor_args", "initial_value")
    more = all_variable.where("name_lc in ('initialstate', 'transitionstate')").groupBy("project_id", "pou_lc").agg(F.array_sort(F.collect_list(F.struct("ord_level", "ord", goes_on.alias("text")))).alias("more"))
    own = all_variable.where(F.lower("data_type").startswith(WRAPPER)).join(more, ["project_id", "pou_lc"], "left")
    args = F.coalesce(F.nullif("constructor_args", F.lit("")), F.regexp_extract("data_type", r"(?s)(\(.*)", 1))
    rest = F.coalesce(F.flatten(F.transform("more", lambda x: members(x.text))), F.array().cast("array<string>"))
    refs = F.when(args != "", F.concat(members(args), rest))
    name = F.nullif(F.regexp_extract(args, "'([^']++)'", 1), F.lit(""))
    enum = F.regexp_extract("initial_state", r"^(\w+)\.", 1)
    return own.select("project_id", "pou_lc", "name_lc", F.col("name").alias("selector"), name.alias("display_name"), F.get(refs, F.lit(0)).alias("initial_state"), F.get(refs, F.lit(1)).alias("transition_state")).withColumn("enum_type", F.nullif(enum, F.lit("")))


def selectors(body: DataFrame, all_variable: DataFrame) -> DataFrame:
    """project_id, pou, pou_lc, selector, enum_type, kind: enum variables that a CASE selects
    by (direct), and wrapper instances whose State it selects by (wrapped)."""
    used = body.select("project_id", "pou", "pou_lc", F.explode(F.regexp_extract_all("code", F.lit(r"(?i)\bCASE\s+(\w+(?:\.State)?)\s+OF\b"), F.lit(1))).alias("s")).distinct()
    used = used.withColumn("wrapped", F.lower("s").endswith(".state")).withColumn("name_lc", F.lower(F.substring_index("s", ".", 1)))
    keys, kept = ["project_id", "pou_lc", "name_lc"], ["project_id", "pou", "pou_lc", "selector", "enum_type"]
    var = all_variable.where(F.lower("data_type").startswith("e_") & F.col("scope").isin("Local", "Stat", "Input")).select(*keys, F.col("name").alias("selector"), F.col("data_type").alias("enum_type"))
    direct = used.where("not wrapped").join(var, keys).select(*kept, F.lit("direct").alias("kind"))
    wrapped = used.where("wrapped").join(wrappers(all_variable), keys).select(*kept, F.lit("wrapped").alias("kind"))
    return direct.union(wrapped)


def machines(selector: DataFrame, wrapper: DataFrame, pou: DataFrame, enum_value: DataFrame) -> DataFrame:
    """project_id, pou, pou_lc, selector, kind, enum_type, display_name, initial_state,
    transition_state of each unit's machines. A wrapper whose enumeration is known is one
    without a CASE too."""
    has_states = enum_value.select("project_id", F.col("dut_lc").alias("enum_lc")).distinct()
    used = selector.where("kind = 'wrapped'").select("project_id", "pou_lc", F.lower("selector").alias("name_lc"))
    keys = ["project_id", "pou_lc", "name_lc"]
    known = wrapper.withColumn("enum_lc", F.lower("enum_type")).join(has_states, ["project_id", "enum_lc"], "left_semi").select(*keys)
    names = pou.select("project_id", F.col("name_lc").alias("pou_lc"), F.col("name").alias("pou"))
    wrapped = wrapper.join(used.union(known).distinct(), keys, "left_semi").join(names, ["project_id", "pou_lc"])
    out = ["project_id", "pou", "pou_lc", "selector"]
    none = F.lit(None).cast("string")
    direct = selector.where("kind = 'direct'").select(*out, F.lit("direct").alias("kind"), "enum_type", none.alias("display_name"), none.alias("initial_state"), none.alias("transition_state"))
    return wrapped.select(*out, F.lit("wrapped").alias("kind"), "enum_type", "display_name", "initial_state", "transition_state").union(direct)


def of_instances(machine: DataFrame, node: DataFrame) -> DataFrame:
    """The machines of each instance of the tree, by its type: path and what machines() has. All
    wrappers count; of the variables over one enumeration the first by name does, and none
    where a wrapper has that enumeration."""
    rank = F.when(F.col("kind") == "wrapped", F.lit(0)).otherwise(F.row_number().over(Window.partitionBy("project_id", "pou_lc", F.lower("enum_type")).orderBy(F.desc("kind"), F.lower("selector"))) - 1)
    one = machine.withColumn("rank", rank).where("rank = 0").drop("rank")
    return node.select("project_id", "path", F.col("type_lc").alias("pou_lc")).join(one, ["project_id", "pou_lc"])


def case_lines(body: DataFrame, selector: DataFrame) -> DataFrame:
    """The lines of each selector's CASE block: project_id, pou, pou_lc, selector, enum_type,
    kind, body_ord, line_no, line, state, guard, run.

    A block ends where the depth of CASE and END_CASE comes back to zero. state is the last
    label at or before a line, guard the last IF or ELSIF since that label or an ELSE."""
    line = body.select("project_id", "pou_lc", F.col("ord").alias("body_ord"), F.posexplode(F.split("code", "\n")).alias("line_no", "line"))
    by = Window.partitionBy("project_id", "pou_lc", "body_ord").orderBy("line_no")
    delta = F.col("line").rlike(r"(?i)^\s*CASE\b.*\bOF\b").cast("int") - F.col("line").rlike(r"(?i)\bEND_CASE\b").cast("int")
    line = line.withColumn("depth", F.sum(delta).over(by))
    head = F.nullif(F.lower(F.regexp_extract("line", r"(?i)^\s*CASE\s+(\w+)(?:\.State)?\s+OF\b", 1)), F.lit(""))
    line = line.withColumn("head", F.when(F.col("depth") == 1, head)).withColumn("selector_lc", F.last("head", ignorenulls=True).over(by)).where("depth >= 1")
    one = line.join(selector.withColumn("selector_lc", F.lower("selector")), ["project_id", "pou_lc", "selector_lc"])
    by = Window.partitionBy("project_id", "pou_lc", "selector", "body_ord").orderBy("line_no")
    label = F.nullif(F.regexp_extract("line", LABEL, 1), F.lit(""))
    label = F.when(label.isNull() & F.col("line").rlike(r"(?i)^\s*ELSE\s*$"), "ELSE").otherwise(label)
    one = one.withColumn("label", label).withColumn("run", F.sum(F.col("label").isNotNull().cast("int")).over(by)).withColumn("state", F.last("label", ignorenulls=True).over(by))
    guard = F.nullif(fx.strip(F.regexp_extract("line", r"(?i)^\s*(?:IF|ELSIF)\b\s*(.*?)\s*\bTHEN\b", 1)), F.lit(""))
    hint = F.last(F.when(F.col("line").rlike(r"(?i)^\s*END_IF\b"), "").otherwise(guard), ignorenulls=True).over(Window.partitionBy("project_id", "pou_lc", "selector", "body_ord", "run").orderBy("line_no"))
    return one.withColumn("guard", F.nullif(hint, F.lit("")))


def _short(state: str | object) -> object:
    return F.substring_index(state, ".", -1)


def states(lines: DataFrame, enum_value: DataFrame) -> DataFrame:
    """project_id, pou, selector, state, value, has_branch, code: labels of the CASE block in
    full outer join with the enum's members; machines of one state are dropped."""
    branch = lines.where("label is not null or run > 0").groupBy("project_id", "pou", "selector", "enum_type", _short("state").alias("state")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNull(), F.struct("body_ord", "line_no", "line")))), lambda x: x.line), "\n").alias("code"))
    machine = lines.select("project_id", "pou", "selector", "enum_type").distinct()
    member = machine.join(enum_value.select("project_id", F.col("dut_lc"), F.col("name").alias("state"), "value"), (machine.enum_type.isNotNull()) & (F.lower(machine.enum_type) == F.col("dut_lc")) & (machine.project_id == enum_value.project_id)).select(machine.project_id, "pou", "selector", "enum_type", "state", "value")
    both = branch.withColumn("has_branch", F.lit(True)).join(member, ["project_id", "pou", "selector", "enum_type", "state"], "full_outer").where("state is not null").withColumn("has_branch", F.coalesce("has_branch", F.lit(False)))
    w = Window.partitionBy("project_id", "pou", "selector")
    return both.withColumn("n_states", F.count(F.lit(1)).over(w)).where("n_states >= 2")


def transitions(lines: DataFrame) -> DataFrame:
    """project_id, pou, selector, from_state, to_state, guard, timeout: assignments to the
    selector (of each pair of states the first) and GotoState calls of the wrapper (all of
    them, `?` before the first label), with the timeout that they are given."""
    assign = F.regexp_extract("line", r"(?i)\b(\w+)\s*:=\s*([\w.]+)\s*;", 1)
    target = F.regexp_extract("line", r"(?i)\b(\w+)\s*:=\s*([\w.]+)\s*;", 2)
    keys = ["project_id", "pou", "selector", "from_state", "to_state"]
    hint = F.regexp_replace("guard", r"\b_+", "")
    pick = lambda to, timeout: [F.col("project_id"), F.col("pou"), F.col("selector"), _short(F.coalesce("state", F.lit("?"))).alias("from_state"), _short(to).alias("to_state"), F.when(F.length(hint) > 80, F.concat(F.substring(hint, 1, 77), F.lit("..."))).otherwise(hint).alias("guard"), timeout.alias("timeout"), "body_ord", "line_no"]
    direct = lines.where((F.col("kind") == "direct") & (F.lower(assign) == F.lower("selector")) & F.col("state").isNotNull()).select(*pick(target, F.lit(None).cast("string")))
    first = Window.partitionBy(*keys).orderBy("body_ord", "line_no")
    direct = direct.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    # a line's calls: the machine, and what the parentheses hold
    call = r"(?i)(?<!\w)(\w++)\s*+\.\s*+GotoState\s*+\(([^()]*+(?:\([^()]*+\)[^()]*+)?+)\)"
    of = lambda k: F.regexp_extract_all("line", F.lit(call), F.lit(k))
    wrapped = lines.where("kind = 'wrapped'").select("*", F.inline(F.arrays_zip(of(1).alias("called"), of(2).alias("args")))).where(F.lower("called") == F.lower("selector"))
    given = lambda name, value: F.nullif(fx.strip(F.regexp_extract("args", rf"(?i)\b{name}\s*+:=\s*+({value})", 1)), F.lit(""))
    wrapped = wrapped.withColumn("to", given("StateNext", r"[\w.]++")).where("to is not null").select(*pick(F.col("to"), given("TimeoutNext", r".++")))
    return direct.union(wrapped).select(*keys, "guard", "timeout")


def flagged(state: DataFrame, machine: DataFrame | None = None) -> DataFrame:
    """is_error and is_timeout by the state's name; with the machines is_initial and
    is_transition by the states that they were constructed with."""
    lower = F.lower("state")
    out = state.withColumn("is_error", lower.rlike("error|fault|abort")).withColumn("is_timeout", lower.rlike("timeout|timedout"))
    if machine is None:
        return out
    out = out.join(machine.select("project_id", "pou", "selector", "initial_state", "transition_state"), ["project_id", "pou", "selector"], "left")
    named = lambda c: F.coalesce(F.endswith(F.lower(c), F.concat(F.lit("."), lower)), F.lit(False))
    return out.withColumn("is_initial", named("initial_state")).withColumn("is_transition", named("transition_state")).drop("initial_state", "transition_state")


def primary(state: DataFrame) -> DataFrame:
    """The largest machine of each unit; of equals the first by name."""
    size = state.groupBy("project_id", "pou", "selector").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project_id", "pou").orderBy(F.desc("n"), "selector")
    return size.withColumn("k", F.row_number().over(w)).where("k = 1").select("project_id", "pou", "selector", "n")
