"""Comparative scorecards over a long ``ticker, dimension, score`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.functions.text import capability_name, display, risk_name
from filigraph.operators.graph import Graph, one_hop


#: Fixed values of the display: icons by score, and the steps of an evidence chain.
SCORE_ICONS = ("⬜", "🟡", "🟠", "🟢")
CHAIN_STEPS = ("Mission/Vision", "Strategic Goals", "Operational Capabilities", "Initiatives", "Risk Mitigation")


def dense(companies: DataFrame, scores: DataFrame, dimensions: list[str]) -> DataFrame:
    """Every ticker with every dimension; a missing score is 0. ``dimensions`` is the stated list."""
    grid = companies.select("ticker").distinct().withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions])))
    return grid.join(scores, ["ticker", "dimension"], "left").select("ticker", "dimension", F.coalesce("score", F.lit(0)).alias("score"))


def in_categories(companies: DataFrame, categories: list[str]) -> DataFrame:
    """Companies of the categories; "All" among them takes every company, and no category takes none."""
    return companies if "All" in categories else companies.where(F.col("category").isin(categories))


def heatmap(companies: DataFrame, scores: DataFrame, shown: list[str], dimensions: list[str], categories: list[str] | None = None, order: str = "high") -> DataFrame:
    """A row per ticker with a column per shown dimension and ``total`` over all dimensions; no dimension, no rows.

    ``order`` is "high" or "low" by total, or "ticker"; ties go by ticker.
    """
    chosen = in_categories(companies, ["All"] if categories is None else categories)
    full = dense(chosen, scores, dimensions)
    wide = full.groupBy("ticker").agg(F.sum("score").alias("total"), *[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in shown])
    if not shown:
        wide = wide.where(F.lit(False))
    by = {"high": [F.desc("total"), "ticker"], "low": ["total", "ticker"], "ticker": ["ticker"]}[order]
    return wide.orderBy(*by)


def heatmap_cells(wide: DataFrame, shown: list[str]) -> DataFrame:
    """``ticker, dimension, score, hover`` of a heatmap."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"`{d}`").alias("score")) for d in shown])).alias("c")
    return wide.select("ticker", pairs).select("ticker", "c.*").withColumn("hover", F.format_string("Ticker: %s<br>Dimension: %s<br>Score: %d", "ticker", "dimension", "score"))


def layout(rows: int, columns: int) -> tuple[int, int]:
    """Width and height of a heatmap figure."""
    return columns * 120 + 150, max(400, rows * 40 + 100)


def percentages(scores: DataFrame, dimensions: list[str], most: int = 3) -> DataFrame:
    """``ticker, total, pct``: the share of the largest possible total in percent, halves to even."""
    best = len(dimensions) * most
    totals = scores.groupBy("ticker").agg(F.sum("score").alias("total"))
    return totals.withColumn("pct", F.bround(F.col("total") * 100 / F.lit(best), 0).cast("int"))


def winner(percent: DataFrame, first: str, second: str) -> DataFrame:
    """One row: both totals and percentages, and who wins ("Tie" if none)."""
    total = lambda t, c: F.coalesce(F.max(F.when(F.col("ticker") == t, F.col(c))), F.lit(0))
    row = percent.agg(total(first, "total").alias("total1"), total(second, "total").alias("total2"), total(first, "pct").alias("pct1"), total(second, "pct").alias("pct2"))
    return row.withColumn("winner", F.when(F.col("total1") > F.col("total2"), first).when(F.col("total2") > F.col("total1"), second).otherwise("Tie"))


def head_to_head(scores: DataFrame, dimensions: list[str], first: str, second: str, icons: tuple[str, ...] = SCORE_ICONS) -> DataFrame:
    """``dimension, score1, score2, better`` in the order of the dimensions, scores with an icon of three."""
    dims = scores.sparkSession.createDataFrame(list(enumerate(dimensions)), "ord int, dimension string")
    of = lambda t, c: scores.where(F.col("ticker") == t).groupBy("dimension").agg(F.max("score").alias(c))
    joined = dims.join(of(first, "s1"), "dimension", "left").join(of(second, "s2"), "dimension", "left").fillna(0, ["s1", "s2"])
    cell = lambda c: F.concat(F.element_at(F.array(*[F.lit(i) for i in icons]), F.col(c) + 1), F.lit(" "), F.col(c).cast("string"), F.lit("/3"))
    better = F.when(F.col("s1") > F.col("s2"), F.lit(f"← {first}")).when(F.col("s2") > F.col("s1"), F.lit(f"{second} →")).otherwise("=")
    return joined.orderBy("ord").select("ord", "dimension", cell("s1").alias("score1"), cell("s2").alias("score2"), better.alias("better"))


def evidence_chain(graph: Graph, seeds: DataFrame, missions: DataFrame | None = None, risk_names: dict[str, str] | None = None) -> DataFrame:
    """``seed, step, label, value``: mission, goals, capabilities, initiatives and risks in one line each ("—" if none).

    ``missions`` (seed, mission) holds curated missions.
    """
    text = graph.nodes.select(F.col("id").alias("n1"), "label", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("name"), F.lit("")).alias("text"))
    hops = one_hop(graph, seeds.select("seed")).join(text, "n1")
    shown: dict[str, tuple[int, int, Column]] = {
        "StrategicObjective": (2, 3, display(F.substring("text", 1, 120))),
        "Capability": (3, 4, capability_name(F.col("text"))),
        "Initiative": (4, 3, display(F.substring("text", 1, 100))),
        "RiskTheme": (5, 3, risk_name(F.col("text"), risk_names)),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("label") == k, F.lit(v[i]) if i < 2 else v[2]) for k, v in shown.items()])
    ranked = hops.withColumns({"step": pick(0), "most": pick(1), "item": pick(2)}).where("step is not null")
    place = F.row_number().over(Window.partitionBy("seed", "step").orderBy("o1", "n1"))
    top = ranked.withColumn("nth", place).where(F.col("nth") <= F.col("most"))
    joined = top.groupBy("seed", "step").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "item"))), lambda x: x["item"]), " · ").alias("value"))
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("label")) for i, n in enumerate(CHAIN_STEPS)])).alias("s")
    out = seeds.select("seed", steps).select("seed", "s.*").join(joined, ["seed", "step"], "left")
    if missions is not None:
        out = out.join(missions, "seed", "left").withColumn("value", F.when(F.col("step") == 1, F.col("mission")).otherwise(F.col("value")))
    return out.select("seed", "step", "label", F.coalesce(F.nullif("value", F.lit("")), F.lit("—")).alias("value"))
