"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants the same number of copies. Whole copies are granted at once; the fractional parts are copy
probabilities. Pairs of them meet, and words move at random from one to the other until one of the
two probabilities is integral. What is left over from each block meets in the next level of a
reduction tree, so a source's words come within one document of their target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.llm.shared import SMALL_ROWS, cut, sized, text_or_empty

BLOCK = 32
WORD = "[^\\x20\\x09-\\x0D]+"
_DONE = "array<struct<doc_id:bigint,size:bigint,copy:bigint,bump:int>>"
#: Rows that repeat id, source and size are numbered in runs of so many.
_RUN = 4096
#: What names a document of a source within the tree.
_NAME = ("doc_id", "size", "copy")


def word_count(text_col: str = "text") -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+` of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text_or_empty(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(table: DataFrame, column: str, name: str) -> DataFrame:
    """``table`` with ``name``: each row's place from 0 by ``column``, nulls last. Values must be distinct.

    Rows are dealt by ranges and numbered within them; only the sizes of the ranges meet in one window.
    """
    dealt = cut(table.repartitionByRange(F.asc_nulls_last(column)).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_last(column)))
    both = dealt.withColumn("__inside", inside).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return both.withColumn(name, (F.col("__before") + F.col("__inside") - 1).cast("long")).drop("__range", "__inside", "__before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_id, source_size, target, documents``, one row per source.

    ``sizes`` has ``source, size``. Sources by code point, null last, take the weights in turn.
    They share ``share`` times all words; none gets more than ``most`` times its own, and what is beyond goes to the others by weight:
    round by round, sources that the even share would overfill are filled, until none is left. A round is one sum over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = ranked(totals, "source", "source_id").withColumn("weight", F.get(cycle, (F.col("source_id") % len(weights)).cast("int")))
    rows = cut(rows.withColumn("cap", F.col("source_size") * F.lit(most)), "sources")
    budget = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]) * share
    level, filled = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = rows.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("spent"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if r["n"] == filled or not r["open"]:
            break
        level, filled = (budget - r["spent"]) / r["open"], r["n"]
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return rows.select("source", "source_id", "source_size", target.alias("target"), "documents")


def _chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that only depends on the seed and the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _duel(seed: int):
    """The pivotal step as a fold: the open document meets the next one."""

    def step(held: Column, other: Column) -> Column:
        gain, loss = (1 - held["p"]) * held["size"], held["p"] * held["size"]
        give, take = other["p"] * other["size"], (1 - other["p"]) * other["size"]
        up, down = F.least(gain, give), F.least(loss, take)
        rises = _chance(seed, *[d[c] for d in (held, other) for c in _NAME]) * (up + down) < down
        held_ends = F.when(rises, gain <= give).otherwise(loss <= take)
        moved = F.when(rises, up).otherwise(-down)
        stays = F.struct(*[other[c].alias(c) for c in _NAME], (other["p"] - moved / other["size"]).alias("p"))
        keeps = F.struct(*[held[c].alias(c) for c in _NAME], (held["p"] + moved / held["size"]).alias("p"))
        left = F.when(held_ends, stays).otherwise(keeps)
        bump = F.when(held_ends, rises.cast("int")).otherwise((~rises).cast("int"))
        done = F.struct(*[F.when(held_ends, held[c]).otherwise(other[c]).alias(c) for c in _NAME], bump.alias("bump"))
        return F.struct(
            *[left[c].alias(c) for c in _NAME], F.least(F.greatest(left["p"], F.lit(0.0)), F.lit(1.0)).alias("p"),
            F.concat(held["done"], F.array(done)).cast(_DONE).alias("done"),
        )

    return step


def _level(open_rows: DataFrame, seed: int) -> DataFrame:
    """(source_id, block, left): every block folded; ``left`` has the open document and those that are done.

    Large documents meet first, so that what stays open in the end tends to be small.
    """
    item = F.struct((-F.col("size")).alias("turn"), F.xxhash64(F.lit(seed), *_NAME).alias("tie"), *_NAME, "p")
    rows = open_rows.groupBy("source_id", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = F.col("items")[0]
    start = F.struct(*[first[c].alias(c) for c in (*_NAME, "p")], F.array().cast(_DONE).alias("done"))
    fold = F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, _duel(seed))
    return rows.select("source_id", "block", fold.alias("left"))


def numbered(rows: DataFrame) -> DataFrame:
    """``doc_id, source, size`` rows with ``copy``, which numbers those that repeat all three, from 0.

    Repeated rows are counted and made anew in runs of ``_RUN``, so a frequent one is spread over tasks.
    """
    counts = cut(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "size_counts")
    once = counts.where("n = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copy"))
    runs = counts.where("n > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_RUN).cast("long"))).alias("first"))
    last = F.least(F.col("first") + _RUN, F.col("n")) - 1
    again = runs.repartition("doc_id", "source", "size", "first").select("doc_id", "source", "size", F.explode(F.sequence("first", last)).alias("copy"))
    return once.unionByName(again)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` per input row: the words that the mix takes of each document.

    A null text has no words and a document without words gives none. A null source is a source of its own, the last. Ids may be null and
    break ties; rows that repeat an id are documents of their own. The same rows give the same mix, however they are dealt.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    rows = cut(numbered(cut(rows, "sizes")), "numbered_sizes")
    plan = cut(targets(rows, weights, share, most), "targets")
    of = sized(plan.withColumnRenamed("source", "plan_source"), plan.count())
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = rows.join(of, rows["source"].eqNullSafe(F.col("plan_source"))).withColumn("copies", F.floor(wish)).withColumn("p", wish - F.floor(wish))
    is_open = (F.col("size") > 0) & (F.col("p") > 0)
    blocks = F.ceil(F.col("documents") / F.lit(BLOCK))
    open_rows = wanted.where(is_open).select("source_id", F.pmod(F.xxhash64(*_NAME), blocks).alias("block"), *_NAME, "p")
    left_blocks = plan.agg(F.coalesce(F.max(blocks), F.lit(0)).alias("n")).first()["n"]
    decided = []
    level = 0
    while True:
        folded = cut(_level(open_rows, seed + level), f"mix_level_{level}")
        decided.append(folded.select("source_id", F.explode("left.done").alias("d")).select("source_id", "d.*"))
        open_rows = folded.select("source_id", F.floor(F.col("block") / BLOCK).alias("block"), *[f"left.{c}" for c in (*_NAME, "p")])
        if left_blocks <= 1:
            break
        left_blocks, level = -(-left_blocks // BLOCK), level + 1
    last = (_chance(seed, F.lit("last"), *[F.col(c) for c in _NAME]) < F.col("p")).cast("int").alias("bump")
    decided.append(open_rows.select("source_id", *_NAME, last))
    bumps = reduce(DataFrame.unionByName, decided)
    named = lambda taken: ("doc_id", "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken"), "source")
    rounded = bumps.join(sized(plan, plan.count()), "source_id").select(*named(F.floor(wish) + F.col("bump")))
    return rounded.unionByName(wanted.where(~is_open).select(*named(F.col("copies"))))


def apply_mix(docs: DataFrame, small_rows: int = SMALL_ROWS, **options) -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it. Documents without words stay once.

    Rows of one id and source, which the mix can't tell apart by name, share out what it takes of those of their size. Texts are shuffled
    only if more than ``small_rows`` documents are taken; the documents' numbers are broadcast otherwise. Columns may have any names.
    """
    id_col, text_col, source_col = (options.get(f"{k}_col", v) for k, v in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    taken = mix(docs, **options).select(F.xxhash64("doc_id", "source").alias("key"), "size", times.alias("times"))
    copies = cut(taken.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times")), "copies")
    names = copies.groupBy("key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    names = cut(names.where("n > 1 or times > 0"), "copies_by_name")
    counts = names.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("again")).first()
    key = F.xxhash64(docs[id_col].cast("long"), docs[source_col].cast("string"))
    columns = [docs[c] for c in docs.columns]
    row = F.struct(*columns).alias("row")

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.select("row", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("turn")).select("row.*")

    single = names.where("n = 1").select(F.col("key").alias("name"), F.col("times").cast("int").alias("times"))
    of_one = docs.join(sized(single, counts["once"], small_rows), key == single["name"]).select(row, single["times"].alias("times"))
    out = repeated(of_one, F.col("times"))
    if not counts["again"]:
        return out
    several = names.where("n > 1").select(F.col("key").alias("name"))
    size = F.coalesce(F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD)), F.lit(0)).cast("long")
    found = docs.join(sized(several, counts["again"], small_rows), key == several["name"]).select(several["name"].alias("key"), size.alias("size"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"), row)
    found = cut(found, "repeated_documents")
    salted = found.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(F.lit(0)))
    shares = salted.withColumn("before", before).join(copies, ["key", "size"])
    placed = found.withColumn("place", place).join(shares, ["key", "size", "salt"])
    own = F.floor(F.col("times") / F.col("n")) + (F.col("before") + F.col("place") <= F.col("times") % F.col("n")).cast("int")
    return out.unionAll(repeated(placed.withColumn("own", own).where("own > 0"), F.col("own")))
