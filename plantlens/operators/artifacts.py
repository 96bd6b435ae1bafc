"""Library references, and inventories of scope artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions import text as fx


def _block(name: str, inner: str) -> str:
    return rf'(?s)<{name}\s+Include="([^"]*)"\s*>{inner}</{name}>'


def libraries(files: DataFrame) -> DataFrame:
    """project_id, library, namespace, resolution, version, vendor: references of .plcproj
    files, with what version locks say, one row for each name and namespace."""
    proj = files.where("ext = 'plcproj'")
    ref = proj.select("project_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r'(?s)(<PlaceholderReference\s+Include="[^"]*"\s*>.*?</PlaceholderReference>)'), F.lit(1))).alias("x"))
    get = lambda p: F.nullif(fx.strip(F.regexp_extract("x", p, 1)), F.lit(""))
    refs = ref.select("project_id", "path", get(r'Include="([^"]*)"').alias("library"), F.coalesce(get("<DefaultNamespace>([^<]*)<"), get("<Namespace>([^<]*)<")).alias("namespace"), get("<DefaultResolution>([^<]*)<").alias("resolution"))
    lock = proj.select("project_id", F.explode(F.regexp_extract_all("content", F.lit(r'(?s)(<PlaceholderResolution\s+Include="[^"]*"\s*>.*?</PlaceholderResolution>)'), F.lit(1))).alias("x"))
    locks = lock.select("project_id", F.lower(get(r'Include="([^"]*)"')).alias("library_lc"), get("<Resolution>([^<]*)<").alias("locked")).groupBy("project_id", "library_lc").agg(F.max("locked").alias("locked"))
    first = refs.groupBy("project_id", F.lower("library").alias("library_lc"), "namespace").agg(F.min_by(F.struct("library", "resolution"), "path").alias("r"))
    joined = first.join(locks, ["project_id", "library_lc"], "left")
    res = F.coalesce("locked", "r.resolution")
    return joined.select("project_id", F.col("r.library").alias("library"), "namespace", res.alias("resolution"), version(res).alias("version"), vendor(res).alias("vendor"))


def version(resolution: Column) -> Column:
    """The part between the comma and the bracket of `name, version (vendor)`."""
    return F.nullif(fx.strip(F.regexp_extract(resolution, r"^[^,]*,\s*([^(]*?)\s*(?:\(|$)", 1)), F.lit(""))


def vendor(resolution: Column) -> Column:
    return F.nullif(fx.strip(F.regexp_extract(resolution, r"\(([^()]*)\)\s*$", 1)), F.lit(""))


def count_of(tag: str, content: str = "content") -> Column:
    """How often an element of this local name, in any case, opens."""
    return F.regexp_count(content, F.lit(rf"(?i)<(?:\w+:)?{tag}(?=[\s/>])"))


def tag_counts(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """page_id and a count for each tag; for pages that aren't well-formed XML too."""
    return pages.select("page_id", *[F.coalesce(F.regexp_count("html", F.lit(rf"(?i)<{t}[\s/>]")), F.lit(0)).cast("long").alias(f"n_{t}") for t in tags])


def scopes(files: DataFrame) -> DataFrame:
    """project_id, path, signals (distinct, in order), and counts of what a scope file holds."""
    names = F.regexp_extract_all("content", F.lit(r"(?s)<AdsAcquisition\b.*?<Name>([^<]*)</Name>"), F.lit(1))
    order = F.transform(names, lambda n: F.lower(n))
    distinct = F.filter(names, lambda n, i: F.array_position(order, F.lower(n)) == i + 1)
    return files.where("ext in ('tcmproj', 'tcscopex')").select("project_id", "path", distinct.alias("signals"), F.size(distinct).alias("n_signals"), count_of("Symbol").alias("n_symbols"), count_of("SubMember").alias("n_submembers"), count_of("Transformation").alias("n_transformations"), F.regexp_count("content", F.lit("(?i)<Enabled>true<")).alias("n_enabled"))
