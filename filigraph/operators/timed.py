"""As-of and interval joins: rows meet in bins of time, so neither a key with very many rows nor a long interval is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: Column) -> Column:
    """A time stamp as microseconds, as the session's clock shows it, so stamps with and without a zone compare."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _width(bin: str) -> Column:
    """A length of time, such as ``1 hour``, in microseconds."""
    number, unit = bin.split()
    begin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", begin, begin + F.expr(f"INTERVAL '{int(number)}' {unit.rstrip('s')}"))


def _clash(left: DataFrame, right: DataFrame, prefix: str) -> None:
    names = [f"{prefix}{c}" for c in right.columns]
    if both := {n.lower() for n in names} & {c.lower() for c in left.columns}:
        raise ValueError(f"both sides have {sorted(both)}; choose another prefix")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str = "ts", bin: str = "1 hour", tie: str | None = None, strict: bool = False, prefix: str = "last_") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same key at or (``strict``) before its time, as ``prefix`` columns, null where there is none.

    Of right rows of one time that with the largest ``tie`` is taken (of equal ones, any of those with equal columns by value). Rows of ``left`` with a null key or time
    meet none, such rows of ``right`` are never met; repeated left rows stay. ``bin`` is the width of the bins that a key's rows are sorted in: inside a bin
    the last right row so far is found by a window, and the last one of earlier bins is carried over one row a bin.
    """
    _clash(left, right, prefix)
    width = _width(bin)
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    whole = F.lit(True)
    for c in [*by, on]:
        whole &= F.col(c).isNotNull()
    payload = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    rank = F.col(tie).cast("string") if tie and right.schema[tie].dataType.typeName() == "string" else F.col(tie).cast("decimal(38,9)") if tie else F.lit(0)
    empty_row, empty_got = F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType)
    # at one time, right rows come before left ones, and after them where only earlier ones count
    r = right.where(whole).select(*keys, _micros(F.col(on)).alias("__t"), F.lit(1 if strict else 0).alias("__side"), rank.alias("__tie"), empty_row.alias("__row"), payload.alias("__got"))
    l = left.where(whole).select(*keys, _micros(F.col(on)).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"), F.struct(*left.columns).alias("__row"), empty_got.alias("__got"))  # noqa: E741
    rows = l.unionByName(r).withColumn("__bin", F.floor(F.col("__t") / width))
    last = F.max_by("__got", F.when(F.col("__got").isNotNull(), F.struct("__t", "__tie")))
    bins = rows.groupBy(*names, "__bin").agg(last.alias("__last"))
    before = Window.partitionBy(*names).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    within = Window.partitionBy(*names, "__bin").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__got", F.last("__got", ignorenulls=True).over(within)).where(F.col("__row").isNotNull())
    met = found.join(carried, [*names, "__bin"], "left").select("__row.*", F.coalesce("__got", "__carried").alias("__got"))
    rest = left.where(~F.coalesce(whole, F.lit(False))).withColumn("__got", empty_got)
    out = met.unionByName(rest)
    return out.select(*left.columns, *[F.col(f"__got.{prefix}{c}").alias(f"{prefix}{c}") for c in right.columns])


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], start: str = "start", end: str = "end", on: str = "ts", bin: str = "1 hour", closed: bool = True, prefix: str = "in_") -> DataFrame:
    """Pairs of a point and an interval of the same key that holds it (``closed``: its end as well), intervals' columns with ``prefix``.

    An interval goes to each bin that it reaches, as a sequence of numbers, so a point meets only those of its bin and each pair is found once. Null keys, times and ends meet
    nothing, nor do intervals that end before they start.
    """
    _clash(points, intervals, prefix)
    width = _width(bin)
    to_bin = lambda c: F.floor(_micros(F.col(c)) / width)
    named = intervals.where(F.col(start) <= F.col(end)).select(*[F.col(c).alias(f"{prefix}{c}") for c in intervals.columns], F.explode(F.sequence(to_bin(start), to_bin(end))).alias("__bin"))
    same = F.col("__point_bin") == F.col("__bin")
    for c in by:
        same &= F.col(c) == F.col(f"{prefix}{c}")
    t, a, b = _micros(F.col(on)), _micros(F.col(f"{prefix}{start}")), _micros(F.col(f"{prefix}{end}"))
    inside = (t >= a) & ((t <= b) if closed else (t < b))
    return points.withColumn("__point_bin", to_bin(on)).join(named, same & inside).drop("__point_bin", "__bin")
