"""Ordered sums and as-of lookups over groups of any size.

A group with more than its share of rows is cut into pieces at places drawn from the rows themselves (a hash sample of the
order columns), so that tasks get about equal numbers of rows however they lie in space. Pieces are summed each on its own,
and what lies before or behind a piece comes from a table with one row a piece, whose size is bounded by the number of pieces.
Where no group is that large there are no pieces, and rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_PIECE = 100_000
MAX_PIECES = 10_000  # of all groups together, since pieces are listed on the driver and broadcast; of more rows they are larger
ROWS_A_TASK = 250_000  # sorted by one task, about; more than the cores hold are dealt to as many partitions as that asks for
DRAWS_A_PIECE = 60
PIECE = "_piece"


@dataclass(frozen=True)
class Cuts:
    """The places at which large groups are cut: (by..., cuts: ascending array of the order columns' values)."""

    table: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    longest: int  # cuts of one group, at most

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows with their piece, 0 in a group that is not cut: the number of cuts up to the row, by halving."""
        here, placed = F.struct(*self.order), rows.join(F.broadcast(self.table), list(self.by), "left").withColumn(PIECE, F.lit(0))
        for k in reversed(range(self.longest.bit_length())):  # a column each, so that the steps are compiled
            placed = placed.withColumn(PIECE, F.when(F.get("cuts", F.col(PIECE) + F.lit((1 << k) - 1)) <= here, F.col(PIECE) + F.lit(1 << k)).otherwise(F.col(PIECE)))
        return placed.drop("cuts")

    def inside(self, rows: DataFrame) -> DataFrame:
        """The rows of cut groups alone, with their piece."""
        return self.place(rows.join(F.broadcast(self.table.select(*self.by)), list(self.by), "left_semi"))


def cut_large_groups(keys: DataFrame, by: tuple[str, ...], order: tuple[str, ...], rows_a_piece: int | None = None) -> Cuts | None:
    """Cuts of the groups with more than rows_a_piece rows, or None. Rows that are equal in all order columns stay together."""
    return _counted_and_cut(keys, by, order, rows_a_piece)[1]


def _counted_and_cut(keys: DataFrame, by: tuple[str, ...], order: tuple[str, ...], rows_a_piece: int | None) -> tuple[int, Cuts | None]:
    """The number of rows, and the cuts. At most rows / rows_a_piece groups are large, and their cuts are as many at most, so both
    may be broadcast; pieces grow where they would be more than MAX_PIECES."""
    counted = keys.groupBy(*by).agg(F.count("*").alias("n")).persist()
    total, most = (v or 0 for v in counted.agg(F.sum("n"), F.max("n")).first())
    limit = max(rows_a_piece or ROWS_A_PIECE, total // MAX_PIECES)
    large = counted.where(F.col("n") > limit).collect() if most > limit else []
    counted.unpersist()
    return total, _cut(keys, by, order, limit, large) if large else None


def _cut(keys: DataFrame, by: tuple[str, ...], order: tuple[str, ...], limit: int, large: list) -> Cuts:
    spark = keys.sparkSession
    listed = spark.createDataFrame([(*r[:-1], DRAWS_A_PIECE / limit) for r in large], keys.select(*by).schema.add("share", "double"))
    chance = F.pmod(F.xxhash64(*by, *order), F.lit(1 << 30)) / float(1 << 30)
    drawn = keys.join(F.broadcast(listed), list(by)).where(chance < F.col("share")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("drawn"))
    size, pieces = F.size("drawn"), F.greatest(F.lit(1), F.floor(F.size("drawn") / DRAWS_A_PIECE)).cast("int")
    at = F.transform(F.sequence(F.lit(1), pieces), lambda k: F.get("drawn", F.least(size - 1, F.floor(k * size / (pieces + 1)).cast("int"))))
    cuts = drawn.select(*by, F.array_distinct(at).alias("cuts"))
    found = cuts.collect()  # the draws of one large group are about DRAWS_A_PIECE times its pieces
    return Cuts(spark.createDataFrame(found, cuts.schema), by, order, max((len(r.cuts) for r in found), default=0))


def _dealt(rows: DataFrame, total: int, group: list[str]) -> DataFrame:
    """Rows whose groups meet in as many partitions as ROWS_A_TASK rows each ask for, or the session's if these are more. They are
    named, since small shuffles are otherwise merged by their packed bytes, to tasks of millions of rows. What the cores hold
    at once stays with the session."""
    spark, wanted = rows.sparkSession, -(-total // ROWS_A_TASK)
    if wanted <= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))), *group)


def running_sum(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, out: str, rows_a_piece: int | None = None) -> DataFrame:
    """Adds `out`, the sum of `value` up to each row in the order of the columns `order`, group by group. Null places come
    first, null values add nothing."""
    total, cuts = _counted_and_cut(df.select(*by, *order), by, order, rows_a_piece)
    if cuts is None:
        return _dealt(df, total, list(by)).withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = cuts.inside(df.select(*by, *order, value)).groupBy(*by, PIECE).agg(F.sum(value).alias("_total")).collect()
    before, sums = [], {}
    for r in sorted(totals, key=lambda r: r[PIECE]):  # one row a piece
        key = tuple(r[: len(by)])
        before.append((*key, r[PIECE], sums.get(key, 0.0)))
        sums[key] = sums.get(key, 0.0) + (r["_total"] or 0.0)
    carried = df.sparkSession.createDataFrame(before, df.select(*by).schema.add(PIECE, "integer").add("_before", "double"))
    inside = Window.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _dealt(cuts.place(df), total, [*by, PIECE]).withColumn(out, F.sum(value).over(inside)).join(F.broadcast(carried), [*by, PIECE], "left")
    return summed.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0.0))).drop(PIECE, "_before")


def _carries(cuts: Cuts, knots: DataFrame, total: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(by..., piece, _c_sum, _c_z, _c_next): of each piece of a cut group, the knots' sum and last place before it and the
    first knot (z, v) behind it."""
    first = F.min(F.struct(*order))  # of structs: sorted by group first, so a task may not take a whole part of the input
    ends = _dealt(cuts.inside(knots), total, [*by, PIECE]).groupBy(*by, PIECE).agg(F.sum("_v").alias("sum"), F.max("z").alias("last"), first.alias("first")).collect()
    groups: dict[tuple, dict[int, object]] = {}
    for r in ends:
        groups.setdefault(tuple(r[: len(by)]), {})[r[PIECE]] = r
    rows = []
    for cut in cuts.table.collect():
        key, own = tuple(cut[: len(by)]), groups.get(tuple(cut[: len(by)]), {})
        n, total, last = len(cut.cuts) + 1, 0.0, None
        ahead, behind = [None] * n, None
        for k in reversed(range(n)):
            ahead[k] = behind
            if k in own:
                behind = (own[k]["first"].z, own[k]["first"]["_v"])
        for k in range(n):
            rows.append((*key, k, total, last, ahead[k]))
            if k in own:
                total, last = total + own[k]["sum"], own[k]["last"]
    schema = knots.select(*by).schema.add(PIECE, "integer").add("_c_sum", "double").add("_c_z", "double")
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return knots.sparkSession.createDataFrame(rows, f"{text}, _c_next struct<z: double, v: double>")


def asof_sum(stars: DataFrame, gas: DataFrame, value: str, out: str = "asof", by: tuple[str, ...] = ("galaxy_id", "spaxel"), ties: tuple[str, ...] = (), split: bool = True, rows_a_piece: int | None = None) -> DataFrame:
    """Stars with `out`: the sum of the gas column `value` along z, interpolated at each star's z between the gas rows (knots)
    before and behind it.

    In front of the first knot the sum is the first one's, behind the last one it is the whole; without gas in the group
    it is 0. At equal z gas comes first, in the order of the columns `ties`, then of the value. Gas without a z or a value is
    left out; a star without z gets null. Stars and gas are read and shuffled once, together; groups with more than their
    share of rows are cut (`split`).
    """
    knots = gas.where(F.col("z").isNotNull() & F.col(value).isNotNull()).select(*by, F.col("z").cast("double").alias("z"), F.lit(0).alias("_t"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(ties)], F.col(value).cast("double").alias("_v"))
    order = ("z", "_t", *(f"_o{k}" for k in range(len(ties))), "_v")
    rows = stars.withColumn("z", F.col("z").cast("double")).withColumn("_t", F.lit(1)).unionByName(knots, allowMissingColumns=True)
    total, cuts = _counted_and_cut(rows.select(*by, *order), by, order, rows_a_piece) if split else (rows.count(), None)
    group = list(by)
    if cuts:
        rows, group = cuts.place(rows), [*by, PIECE]
    rows = _dealt(rows, total, group)
    up = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed, last = F.coalesce(F.sum("_v").over(up), F.lit(0.0)), F.last(F.when(F.col("_t") == 0, F.col("z")), ignorenulls=True).over(up)
    # lead keeps its place from row to row, and shares the sort with the sums
    over = f"PARTITION BY {', '.join(f'`{c}`' for c in group)} ORDER BY {', '.join(order)}"
    ahead = F.expr(f"lead(CASE WHEN _t = 0 THEN named_struct('z', z, 'v', _v) END) IGNORE NULLS OVER ({over})")
    seen = rows.withColumns({"_sum": summed, "_last": last, "_next": ahead}).where("_t = 1")
    if cuts:
        carried = _carries(cuts, knots, total, by, order)
        seen = seen.join(F.broadcast(carried), group, "left").withColumns({"_sum": F.col("_sum") + F.coalesce("_c_sum", F.lit(0.0)), "_last": F.coalesce("_last", "_c_z"), "_next": F.coalesce("_next", "_c_next")})
    return seen.withColumn(out, _between(F.col("z"), F.col("_sum"), F.col("_last"), F.col("_next"))).select(*stars.columns, out)


def _between(z: Column, total: Column, last: Column, ahead: Column) -> Column:
    share = (z - last) / (ahead["z"] - last)
    inside = F.when(last.isNull(), ahead["v"]).when(ahead.isNull(), total).otherwise(total + ahead["v"] * share)
    return F.when(z.isNotNull(), F.when(last.isNull() & ahead.isNull(), F.lit(0.0)).otherwise(inside))
