"""Builds that only touch what changed: a manifest of digests, parts of rows, and versions that switch in one piece.

A version has a manifest (key, digest, part) and refers to parts; a part holds the sections, chunks, records, nodes and edges that one run made. A run
compares digests, sends new and changed filings through the build, writes them as a new part, and publishes a manifest that names, for each filing, the
part that its rows are read from. Rows of filings that changed or went stay in their old part, unread, until :func:`compact` writes one part anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filigraph.operators import chunking, extraction, sections
from filigraph.operators.lexicon import Lexicon
from filigraph.plans.build import Build
from filigraph.sources import versions
from filigraph.work import cut, discard

TABLES = ("sections", "chunks", "records", "nodes", "edges")
_MANIFEST = "filing string, digest string, part string"


@dataclass
class Run:
    """What a run did: its version, and how many filings were built, kept and gone."""

    version: int
    built: int
    kept: int
    gone: int


def digests(pages: DataFrame, key: str = "ticker", html_col: str = "html") -> DataFrame:
    """``filing, digest``: one row a filing, whatever the order of its rows. Null pages count as empty; rows of a null key are one filing."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    sha = F.sha2(html, 256)
    # of bounded size for any number of rows: a filing usually has one, and then its digest tells all
    parts = [F.count(F.lit(1)), F.min(sha), F.max(sha), F.bit_xor(F.xxhash64(html)), F.sum(F.xxhash64(F.lit(1), html).cast("decimal(38,0)"))]
    return pages.groupBy(F.col(key).cast("string").alias("filing")).agg(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256).alias("digest"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.filing").eqNullSafe(F.col(f"{right}.filing"))


def _manifest(spark: SparkSession, path: str, about: dict) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/parts/{about['manifest']}/manifest")


def _new_part(version: int) -> str:
    """The name of a run's folder, which no other run gets, so what a failed run left is in nobody's way."""
    return f"{version}-{uuid.uuid4().hex[:12]}"


def _write_part(pages: DataFrame, path: str, part: str, key: str, html_col: str, rule: sections.SectionRule, lexicon: Lexicon | None) -> dict[str, str]:
    """Builds pages and writes their tables, each with the filing that a row is of; sections and records are read back, so nothing is built twice."""
    spark, where = pages.sparkSession, f"{path}/parts/{part}"
    named = pages.select(F.col(key).cast("string").alias("ticker"), F.col(html_col).alias("html"))
    stored: dict[str, DataFrame] = {}

    def keep(name: str, table: DataFrame) -> DataFrame:
        table.write.parquet(f"{where}/{name}")
        stored[name] = table
        return spark.read.schema(table.schema).parquet(f"{where}/{name}")

    texts = keep("sections", sections.sections_of_pages(named, "ticker", "html", rule).withColumn("filing", F.col("ticker")))
    keep("chunks", chunking.chunk(texts).withColumn("filing", F.col("ticker")))
    told = keep("records", extraction.extract(texts, lexicon).withColumn("filing", F.col("Company.ticker")))
    for name, make in (("nodes", extraction.nodes), ("edges", extraction.edges)):
        keep(name, make(told))
    return {name: table.schema.json() for name, table in stored.items()}


def refresh(pages: DataFrame, path: str, key: str = "ticker", html_col: str = "html", rule: sections.SectionRule = sections.SectionRule(), lexicon: Lexicon | None = None, gone: bool = True) -> Run:
    """Brings the tables below ``path`` up to ``pages``, building new and changed filings alone; a run that fails leaves the last version as it was.

    ``gone`` says that filings which ``pages`` doesn't have are taken out; without it they stay, as for a delivery of changes. Another rule or lexicon
    needs another path, or :func:`compact` of all pages. A run without a change publishes nothing.
    """
    spark = pages.sparkSession
    try:
        last, about = versions.describe(spark, path)
        old = _manifest(spark, path, about)
    except FileNotFoundError:
        last, about, old = 0, {"parts": [], "schemas": {}}, spark.createDataFrame([], _MANIFEST)
    version = versions.next_version(spark, path)
    part = _new_part(version)
    now = digests(pages, key, html_col)
    sides = now.alias("n").join(old.alias("o"), _same("n", "o"), "full")
    state = F.when(F.col("n.digest").isNull(), "gone").when(F.col("o.digest").eqNullSafe(F.col("n.digest")), "kept").otherwise("built").alias("state")
    plan = cut(sides.select(F.coalesce("n.filing", "o.filing").alias("filing"), F.coalesce("n.digest", "o.digest").alias("digest"), F.col("o.part").alias("part"), state), "plan")
    counts = {r["state"]: r["n"] for r in plan.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    built, kept, lost = (counts.get(s, 0) for s in ("built", "kept", "gone"))
    if not built and not (lost and gone):
        discard(plan)
        return Run(last, 0, kept, 0)
    parts, schemas = list(about["parts"]), about["schemas"]
    if built:
        todo = plan.where("state = 'built'").select("filing").alias("b")
        changed = pages.alias("p").join(todo, F.col(f"p.{key}").cast("string").eqNullSafe(F.col("b.filing")), "left_semi")
        schemas = _write_part(changed, path, part, key, html_col, rule, lexicon)
        parts.append(part)
    live = plan.where(F.col("state") != "gone") if gone else plan
    live = live.select("filing", "digest", F.when(F.col("state") == "built", F.lit(part)).otherwise(F.col("part")).alias("part"))
    live.write.parquet(f"{path}/parts/{part}/manifest")
    versions.publish(spark, path, version, {"parts": parts, "manifest": part, "schemas": schemas, "built": built, "gone": lost if gone else 0})
    discard(plan)
    return Run(version, built, kept, lost if gone else 0)


def _rows(spark: SparkSession, path: str, about: dict, name: str) -> DataFrame | None:
    """All rows of a table's parts, with the part that each is of."""
    schema = StructType.fromJson(json.loads(about["schemas"][name])) if about["parts"] else None
    tables = [spark.read.schema(schema).parquet(f"{path}/parts/{p}/{name}").withColumn("part", F.lit(p)) for p in about["parts"]]
    out = tables[0] if tables else None
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _live(rows: DataFrame, manifest: DataFrame, filing: Column) -> DataFrame:
    named = rows.withColumn("__filing", filing).alias("r")
    wanted = manifest.alias("m")
    on = F.col("r.__filing").eqNullSafe(F.col("m.filing")) & (F.col("r.part") == F.col("m.part"))
    return named.join(wanted, on, "left_semi").drop("part", "__filing", "filing")


def open_build(spark: SparkSession, path: str, version: int | None = None) -> Build:
    """The tables of a version, its newest without a number; nodes and edges come from its records, so a filing's old ones are gone with them."""
    _, about = versions.describe(spark, path, version)
    manifest = _manifest(spark, path, about)
    if not about["parts"]:
        raise FileNotFoundError(f"nothing was built below {path}")
    table = lambda name, filing="filing": _live(_rows(spark, path, about, name), manifest, F.col(filing))
    records = table("records")
    if len(about["parts"]) == 1 and about["parts"] == [about["manifest"]]:  # all rows are of this version
        nodes, edges = (_rows(spark, path, about, name).drop("part") for name in ("nodes", "edges"))
    else:
        nodes, edges = extraction.nodes(records), extraction.edges(records)
    return Build(table("sections"), table("chunks"), records, nodes, edges)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``filing, digest, part`` of a version: which run's part each filing is read from."""
    return _manifest(spark, path, versions.describe(spark, path, version)[1])


def compact(spark: SparkSession, path: str) -> int:
    """A version of one part with the newest version's rows, none of them built anew."""
    last, about = versions.describe(spark, path)
    built, version = open_build(spark, path, last), versions.next_version(spark, path)
    part = _new_part(version)
    where = f"{path}/parts/{part}"
    names = {"sections": F.col("ticker"), "chunks": F.col("ticker"), "records": F.col("Company.ticker")}
    for name, filing in names.items():
        getattr(built, name).withColumn("filing", filing).write.parquet(f"{where}/{name}")
    for name in ("nodes", "edges"):
        getattr(built, name).write.parquet(f"{where}/{name}")
    _manifest(spark, path, about).withColumn("part", F.lit(part)).write.parquet(f"{where}/manifest")
    versions.publish(spark, path, version, {"parts": [part], "manifest": part, "schemas": about["schemas"], "built": 0, "gone": 0})
    return version
