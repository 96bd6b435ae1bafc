"""XML of any shape and depth as rows: one for each element, with the interval of its content.

A file is cut into tags and texts. The running sum of what opens and closes is a token's depth;
tokens of one depth between two openings belong to the first of them. All windows are within
one file, so that a single shuffle by file serves them. It moves whole files, before they are
cut, in tasks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as fx
from plantlens.sources.files import dealt

FILE = ["project_id", "path"]
#: Bytes of files that a task reads; its windows hold about 250 times as much.
TASK = 1 << 20
TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
ATTRIBUTE = r"""([\w:.\-]+)\s*=\s*("[^"]*+"|'[^']*+')"""
NAME = r"^</?(?:[\w.\-]+:)?([\w.\-]+)"


def plain(text: Column) -> Column:
    """Text with the five named entities resolved; numbered ones stay."""
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def elements(files: DataFrame) -> DataFrame:
    """project_id, path, seq, last_seq, parent_seq, depth, name (local), tag (as written), text
    (the first own text that isn't blank, trimmed), value (all own texts, trimmed), is_leaf.

    `seq` to `last_seq` holds everything inside the element. A file that isn't well formed,
    is empty or null or declares a document type has no rows."""
    token = dealt(files.select(*FILE, "content"), FILE, "content", TASK).select(*FILE, F.posexplode(F.regexp_extract_all(fx.safe_xml(F.col("content")), F.lit(TOKEN), F.lit(0))).alias("seq", "token"))
    token = token.where(~F.col("token").startswith("<!--") & ~F.col("token").startswith("<?") & (fx.strip("token") != ""))
    t = F.col("token")
    cdata = t.startswith("<![CDATA[")
    kind = F.when(~t.startswith("<") | cdata, "text").when(t.rlike(r"^</\w"), "close").when(~t.rlike(r"^<\w"), "bad").when(t.endswith("/>"), "empty").when(t.endswith(">"), "open").otherwise("bad")
    text = F.when(cdata, F.substr(t, F.lit(10), F.length(t) - 12)).otherwise(plain(t))
    by = Window.partitionBy(*FILE).orderBy("seq")
    token = token.withColumn("kind", kind)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    token = token.withColumn("depth", (F.sum(step).over(by) + F.col("kind").isin("close", "empty").cast("int")).cast("int"))
    level = Window.partitionBy(*FILE, "depth").orderBy("seq")
    starts = F.col("kind").isin("open", "empty")
    token = token.withColumn("of", F.last(F.when(starts, F.col("seq")), ignorenulls=True).over(level))
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", text.alias("x"))))), lambda r: r.x)
    e = token.groupBy(*FILE, F.col("of").alias("seq")).agg(
        F.min("depth").alias("depth"), F.max(F.when(starts, t)).alias("tag"), F.max(F.when(F.col("kind") == "close", F.struct("seq", t.alias("tag")))).alias("close"), own.alias("texts"), F.count_if(F.col("kind") == "bad").alias("n_bad"),
    )
    local = lambda c: F.regexp_extract(c, NAME, 1)
    whole = F.col("seq").isNotNull() & (F.col("n_bad") == 0) & F.when(F.col("tag").endswith("/>"), F.col("close").isNull()).otherwise(F.col("close").isNotNull() & (F.regexp_extract("close.tag", r"^</([^\s>]+)", 1) == F.regexp_extract("tag", r"^<([^\s/>]+)", 1)))
    file = Window.partitionBy(*FILE)
    e = e.withColumn("sound", F.min(F.coalesce(whole, F.lit(False)).cast("int")).over(file) * (F.count_if(F.col("depth") == 1).over(file) == 1).cast("int")).where("sound = 1")
    e = e.select(*FILE, "seq", F.coalesce("close.seq", "seq").alias("last_seq"), "depth", local("tag").alias("name"), "tag", F.coalesce(fx.strip(F.get("texts", F.lit(0))), F.lit("")).alias("text"), fx.strip(F.array_join("texts", "")).alias("value"))
    e = e.withColumn("is_leaf", F.coalesce(F.lead("seq").over(by) > F.col("last_seq"), F.lit(True)))
    # the parent is the last element opened one level up: each element asks there, each answers at its own level
    asked = e.withColumn("opened", F.lit(None).cast("int")).withColumn("level", F.col("depth") - 1).union(e.withColumn("opened", F.col("seq")).withColumn("level", F.col("depth")))
    up = asked.withColumn("parent_seq", F.last("opened", ignorenulls=True).over(Window.partitionBy(*FILE, "level").orderBy("seq")))
    return up.where("opened is null").select(*FILE, "seq", "last_seq", "parent_seq", "depth", "name", "tag", "text", "value", "is_leaf")


def attribute(name: str, tag: str = "tag") -> Column:
    """The trimmed value of an attribute of this very name; empty where there is none."""
    found = F.filter(attributes(tag), lambda a: a["name"] == name)
    return F.coalesce(F.get(found, F.lit(0)).value, F.lit(""))


def attributes(tag: str = "tag") -> Column:
    """Name (without prefix) and trimmed value of each attribute, in the order written."""
    body = F.regexp_replace(tag, r"^<[^\s/>]+", "")
    pick = lambda k: F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(k))
    quoted = lambda v: fx.strip(plain(F.substr(v, F.lit(2), F.length(v) - 2)))
    return F.zip_with(pick(1), pick(2), lambda n, v: F.struct(F.substring_index(n, ":", -1).alias("name"), quoted(v).alias("value")))


def first_inside(name: str) -> Column:
    """For each element: the value of the first element of this name (in any case) inside of
    it; null where there is none or its value is blank."""
    ahead = Window.partitionBy(*FILE).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.lower("name") == name.lower(), F.struct("seq", "value")), ignorenulls=True).over(ahead)
    return F.when(found.seq <= F.col("last_seq"), F.nullif(found.value, F.lit("")))


def first_of(name: str, within: Column | None = None) -> Column:
    """An aggregate over a file: the value of the first element of this name below the root,
    among those where `within` holds; null where that is blank."""
    here = (F.lower("name") == name.lower()) & (F.col("depth") > 1)
    if within is not None:
        here &= within
    return F.nullif(F.min_by("value", F.when(here, F.col("seq"))), F.lit(""))
