"""Particle-table operators: classes, groups, ordering, splits and significance. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize


def class_counts(df: DataFrame, class_no: str = "class_no") -> DataFrame:
    """Rows of every class from 1 to the largest, empty classes included; classes below 1 are left out."""
    counts = df.where(F.col(class_no) >= 1).groupBy(F.col(class_no).cast("long").alias(class_no)).agg(F.count("*").alias("n"))
    dense = counts.agg(F.max(class_no).alias("k")).where("k is not null").select(F.explode(F.expr("sequence(1L, k)")).alias(class_no))
    return dense.join(counts, class_no, "left").select(class_no, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def size_histogram(counts: DataFrame, n: str = "n") -> DataFrame:
    """Classes by size: bin = size div 10, 10 at most."""
    return counts.groupBy(F.least(F.expr(f"{n} div 10"), F.lit(10)).cast("long").alias("size_bin")).agg(F.count("*").alias("classes"))


def number_by_first(df: DataFrame, name: str, order: list[str], out: str) -> DataFrame:
    """(name, out): values of name numbered from 1 by their first row in the order. Only names meet in one task."""
    firsts = df.groupBy(name).agg(F.min(F.struct(*order)).alias("first"))
    return firsts.select(name, F.row_number().over(Window.orderBy("first")).cast("long").alias(out))


def relabel_classes(df: DataFrame, class_no: str = "class_no") -> DataFrame:
    """(class_no, new_class, n): classes with rows get the numbers from 1 in order."""
    counts = df.groupBy(class_no).agg(F.count("*").alias("n"))
    return counts.select(class_no, F.row_number().over(Window.orderBy(class_no)).cast("long").alias("new_class"), "n")


def group_or_micrograph(df: DataFrame, group: str = "group_name", micrograph: str = "micrograph") -> DataFrame:
    """df whose group is the micrograph where all rows share one group but come from several micrographs."""
    facts = df.agg((F.min(group) == F.max(group)).alias("one"), (F.min(micrograph) != F.max(micrograph)).alias("several"))
    merged = df.crossJoin(F.broadcast(facts))  # facts is one row
    return merged.withColumn(group, F.when(F.col("one") & F.col("several"), F.col(micrograph).cast("string")).otherwise(F.col(group))).drop("one", "several")


def with_global_index(df: DataFrame, order: list[str], out: str = "ord") -> tuple[DataFrame, int]:
    """df with its place (from 0) in the order, and the number of rows.

    Range partitions are sorted and written once; only one count for each partition goes through the driver,
    so no task sees all rows.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(placed.withColumn("__id", F.monotonically_increasing_id()), "indexed")
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    starts, total = [], 0
    for c in counts:
        starts.append((c["__part"], total))
        total += c["n"]
    if not starts:
        return stored.withColumn(out, F.lit(0).cast("long")).drop("__id"), 0
    offsets = F.broadcast(spark.createDataFrame(starts, "__part bigint, __start bigint"))
    found = stored.withColumn("__part", part).join(offsets, "__part").withColumn(out, F.col("__start") + row)
    return found.drop("__id", "__part", "__start"), total


def equal_blocks(place: Column, total: int, blocks: int) -> Column:
    """Block from 1 of a place from 0 where `total` rows are dealt evenly, the remainder to the first blocks."""
    base, rest = divmod(total, blocks)
    wide = rest * (base + 1)
    i = place.cast("long")
    inside = F.floor(i / F.lit(base + 1)) + 1
    after = F.lit(rest + 1) + F.floor((i - wide) / F.lit(max(base, 1)))
    return F.when(i < wide, inside).otherwise(after).cast("long")


def split_equally(df: DataFrame, order: list[str], blocks: int, pool: int = 1, out: str = "block") -> DataFrame:
    """df with the block of each row; rows of one pool of consecutive rows share a block."""
    indexed, total = with_global_index(df, order, "__ord")
    pools = -(-total // pool)
    return indexed.withColumn(out, equal_blocks(F.floor(F.col("__ord") / pool), pools, blocks)).drop("__ord")


def shuffled(df: DataFrame, keys: list[str], seed: int, out: str = "place") -> DataFrame:
    """df with its place, from 0, in a random order that the seed and the keys fix; no task sees all rows."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    placed, _ = with_global_index(df.withColumn("__draw", draw), ["__draw", *keys], out)
    return placed.drop("__draw")


def halves(df: DataFrame, draw: Column, kept: str | None = None, out: str = "random_subset") -> DataFrame:
    """df with half 1 or 2 by the parity of draw; halves named by the column kept stay."""
    drawn = (F.pmod(draw, F.lit(2)) + 1).cast("long")
    if kept is not None:
        drawn = F.when(F.col(kept).isin(1, 2), F.col(kept).cast("long")).otherwise(drawn)
    return df.withColumn(out, drawn)


def present_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """(name, present): a column is written if it isn't constant or its value isn't the default; one pass."""
    facts = [
        F.coalesce((F.min(c) != F.max(c)) | (F.min(c) != F.lit(d)), F.lit(False)).alias(c) for c, d in defaults.items()
    ]
    row = df.agg(*facts)
    return row.unpivot([], list(defaults), "name", "present")


def restack(df: DataFrame, by: str, order: list[str], digits: int = 7) -> DataFrame:
    """df with new_index and new_name: the row's place within `by` in the order, as index@stack.

    One class may hold most rows: places come from the global order, less the first place of the class.
    """
    placed, _ = with_global_index(df, [by, *order], "__ord")
    firsts = placed.groupBy(F.col(by).alias("__by")).agg(F.min("__ord").alias("__first"))
    met = placed.join(firsts, F.col(by).eqNullSafe(F.col("__by")))
    indexed = met.withColumn("new_index", F.col("__ord") - F.col("__first") + 1).drop("__ord", "__by", "__first")
    return indexed.withColumn("new_name", F.concat(F.lpad(F.col("new_index").cast("string"), digits, "0"), F.lit("@class"), F.col(by).cast("string"), F.lit(".mrcs")))


def fine_class_plan(counts: DataFrame, class_no: str = "class_no", n: str = "n") -> DataFrame:
    """Fine classes of each class (1 under 20 rows, else n div 10 + 2) and the offset of the first."""
    planned = counts.withColumn("fine", F.when(F.col(n) < 20, F.lit(1)).otherwise(F.expr(f"{n} div 10 + 2")).cast("long"))
    before = Window.orderBy(class_no).rowsBetween(Window.unboundedPreceding, -1)  # classes, not rows, meet here
    return planned.withColumn("offset", F.coalesce(F.sum("fine").over(before), F.lit(0)).cast("long"))


def mass_threshold(df: DataFrame, by: str, weight: str, tie: str, share: float = 0.999) -> DataFrame:
    """df with `running`, `place` and `threshold`: the weight at which the falling running sum first exceeds the share of all."""
    falling = Window.partitionBy(by).orderBy(F.col(weight).desc(), tie)
    whole = Window.partitionBy(by)
    run = df.withColumn("running", F.sum(weight).over(falling.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(falling))
    limit = F.lit(share) * F.sum(weight).over(whole)
    crossed = run.withColumn("__limit", limit)
    return crossed.withColumn("threshold", F.coalesce(F.max(F.when(F.col("running") > F.col("__limit"), F.col(weight))).over(whole), F.min(weight).over(whole))).drop("__limit")


def significant_counts(df: DataFrame, by: str, weight: str, tie: str, share: float = 0.999) -> DataFrame:
    """(by, threshold, nr_significant): how many samples the mass needs, and the smallest of their weights."""
    marked = mass_threshold(df, by, weight, tie, share)
    return marked.groupBy(by).agg(F.max("threshold").alias("threshold"), F.count(F.when(F.col(weight) >= F.col("threshold"), 1)).alias("nr_significant"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the value at place floor(n / 2) of the rising order. Meant for one value a group."""
    return df.agg(F.sort_array(F.collect_list(value)).alias("v")).select(F.expr("get(v, cast(floor(size(v) / 2) as int))").alias("median"))


def top_pages(df: DataFrame, order: list[Column], page: int, size: int, out: str = "place") -> DataFrame:
    """Rows of one page (from 0) of the order, with their places; a bounded top-k, not a full sort."""
    top = df.orderBy(*order).limit((page + 1) * size)
    placed = top.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return placed.where(F.col(out) > page * size)
