"""Registered queries against their SQL over the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver
from plantlens.plans.queries import ORACLE_SQL, QUERIES
from plantlens.sources.virtual import TIERS

SF = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["pou_inventory", "variable_values_and_comments", "all_variables_overlay", "object_tree", "alarm_list", "sm_states", "sm_transitions", "unified_io", "call_edges", "library_dependencies", "compliance_scores", "packml_score", "packml_entries", "compliance_details", "compliance_project_details"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


def alarm_code(customers, tiered):
    """The text of a nation's method of alarms."""
    keys = sorted(c["c_custkey"] for c in customers)
    of = {}
    for c in sorted(customers, key=lambda c: c["c_custkey"]):
        if tiered and c["c_mktsegment"] in TIERS:
            of.setdefault(TIERS[c["c_mktsegment"]], []).append(f"ALM_Cust{c['c_custkey']}.Latched")
    blocks = "".join(f"_AlarmsPresent{t} := " + "\n\tOR ".join(x) + ";\n" for t, x in of.items())
    return blocks + "".join((f"ALM_Cust{k}.Trigger := nLevel > {k % 100};\n" if k % 2 == 0 else "") + (f"ALM_Cust{k}.TriggerDelay_ms := {k * 10};\n" if k % 3 == 0 else "") for k in keys)


def all_levels():
    """(module, rule) -> level of the virtual project, from the tables by hand."""
    t = {n: pq.read_table(f"{SF}/{n}.parquet").to_pylist() for n in ("region", "nation", "supplier", "customer")}
    unit = [(f"UM_R{r['r_regionkey']}", None, any(n["n_regionkey"] == r["r_regionkey"] for n in t["nation"]), False, False) for r in t["region"]]
    for n in t["nation"]:
        k, m = n["n_nationkey"], n["n_nationkey"] % 5
        c = [x for x in t["customer"] if x["c_nationkey"] == k]
        code = len(alarm_code(c, m > 0).strip())
        unit.append((f"EM_N{k}", {0: "EM_BASECLASS", 1: None}.get(m, "EM_Equipment"), bool(c) or any(s["s_nationkey"] == k for s in t["supplier"]), m != 1, code if m != 1 else 0))
    unit += [(f"CM_S{s['s_suppkey']}", f"CM_L{s['s_suppkey'] % 7}", False, False, False) for s in t["supplier"]]
    unit += [(f"CM_L{k}", f"CM_L{k - 1}" if k else "CM_BASECLASS", True, False, False) for k in range(7)] + [("EM_Equipment", None, True, False, False)]
    out = {}
    for name, parent, local, method, code in unit:
        cm, has_in, good = name.startswith("CM_"), name.startswith("CM_S"), name.startswith("CM_") or name == "EM_Equipment"
        pick = lambda x, bad="W": "P" if x else bad
        level = {
            "IEC-001": "P", "IEC-002": "P" if good else "F" if local else "N", "IEC-003": pick(method, "N"), "IEC-004": "P", "IEC-005": pick(has_in), "OOP-001": "W", "OOP-002": "W", "OOP-003": pick(parent), "OOP-004": "W", "OOP-005": "W" if local else "N", "OOP-006": "W", "OOP-007": "W", "OOP-008": pick(method, "N"),
            "ISA-001": "P", "ISA-002": "N" if cm else pick(method, "F"), "ISA-003": "W" if cm else "N", "ISA-004": "N" if cm else "P", "ISA-005": "N" if cm else "W", "ISA-006": pick(parent and "BASECLASS" in parent), "GAMP-001": pick(has_in), "GAMP-002": "W", "GAMP-003": pick(method), "GAMP-004": "P", "GAMP-005": pick(parent), "GAMP-006": "P" if code > 100 else "W" if code else "F", "GAMP-007": "P",
            "oop.extends_cycle": pick(parent, "N"), "oop.override_super_call": pick(not code), "oop.property_accessor_pairing": "P", "oop.method_count": "P", "naming.isa88_prefix_casing": "P", "naming.member_casing": "P", "naming.reserved_words": "P", "structure.property_var_blocks": "N", "style.indentation_tabs": pick(local or has_in, "N"), "style.excessive_blank_lines": "P", "xml.guid_format": "P",
            "oop.override_signature": pick(parent and "BASECLASS" not in parent, "N"), "oop.abstract_contract": "N", "oop.abstract_instantiation": "P", "oop.diamond_inheritance": "N", "oop.composition_depth": "P", "oop.interface_contract": "N", "structure.file_ending": "W", "PKM-000": "N",
        }
        out |= {(name, rule): x for rule, x in level.items()}
    return out


def test_all_rules_and_scores(spark):
    want = all_levels()
    got = QUERIES["compliance_rules_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.module, r.rule_id): r.level for r in got} == want
    assert len({r.rule_id for r in got}) == 45
    of = {"IEC": "IEC 61131-3", "OOP": "OOP", "ISA": "ISA-88", "GAMP": "GAMP 5", "PKM": "PackML"}
    count = Counter()
    for (module, rule), x in want.items():
        count[module, of.get(rule.split("-")[0], "Architecture"), x] += 1
    scored = {}
    for module, standard in {k[:2] for k in count}:
        p, w, f = (count[module, standard, x] for x in "PWF")
        score = (p + 0.5 * w) / (p + w + f) if p + w + f else 1.0
        scored[module, standard] = (p, w, f, round(score * 100), "N/A" if not p + w + f else "Fail" if f else "Pass" if score >= 0.9 else "Warning" if score >= 0.6 else "Fail")
    assert len(scored) == 6 * len({m for m, _ in want})
    assert {(r.module, r.standard): (r.n_pass, r.n_warning, r.n_fail, r.percent, r.level) for r in QUERIES["compliance_scores_all"](spark, SF).collect()} == scored


def test_entry(spark):
    assert driver.entry(spark).count() > 0 and set(driver.oracle_sql()) <= set(driver.queries())
