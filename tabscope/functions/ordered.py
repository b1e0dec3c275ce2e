"""Order-dependent work without a whole group in one task.

Many rules depend on row order inside a sheet, and one sheet may hold a third of
all rows.  A plain ``Window.partitionBy(sheet).orderBy(row)`` would sort that
sheet in a single task, so everything here works on *blocks*: slices of the row
number inside a group.  Row numbers are unique in a group, so a block never holds
more than ``BLOCK`` rows.  Per-block summaries (one row per block) carry state
from one block to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.session import durable

BLOCK = 1 << 18
RANK_BUCKETS = 1 << 14


def block_of(order: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def with_neighbours(df: DataFrame, group: list[str], order: str, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows plus copies of the nearest rows of the adjoining blocks.

    Adds ``_blk`` and ``_halo``.  Inside ``(group, _blk)`` an ordinary ``lag`` of
    up to ``before`` rows or ``lead`` of up to ``after`` rows is then right for
    every row whose ``_halo`` is false; drop the halo rows afterwards.
    """
    columns = df.columns
    base = df.withColumn("_blk", block_of(order, size))
    out = base.withColumn("_halo", F.lit(False))
    keys = [*group, "_blk"]
    whole = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])
    for count, ahead in ((before, False), (after, True)):
        if not count:
            continue
        # row_number() <= k is pruned in every task before the shuffle.
        direction = F.col(order).asc() if ahead else F.col(order).desc()
        edge = (base.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(direction)))
                .filter(F.col("_rn") <= count)
                .groupBy(*keys).agg(F.sort_array(F.collect_list(whole)).alias("_edge")))
        # Every block has at least one row, so `count` blocks reach far enough.
        blocks = Window.partitionBy(*group).orderBy("_blk").rowsBetween(*((1, count) if ahead else (-count, -1)))
        near = F.flatten(F.collect_list("_edge").over(blocks))
        near = F.slice(near, 1, count) if ahead else F.slice(near, F.greatest(F.size(near) - count + 1, F.lit(1)), count)
        halo = (edge.select("_blk", near.alias("_near")).select("_blk", F.explode("_near").alias("_n"))
                .select(*[F.col(f"_n.{c}").alias(c) for c in columns], "_blk", F.lit(True).alias("_halo")))
        out = out.unionByName(halo)
    return out


def running(df: DataFrame, group: list[str], order: str, sums: dict[str, Column] | None = None,
            fills: dict[str, Column] | None = None, block: Column | None = None, size: int = BLOCK, through: int = 0) -> DataFrame:
    """Running totals (``sums``) and last non-null values (``fills``) per group in
    ``order``: up to the current row, or to the row before it with ``through=-1``.

    Windows run inside blocks; block totals are one row per block, and their prefix
    is joined back on the same keys the rows are already partitioned by.
    """
    sums, fills = sums or {}, fills or {}
    keys = [*group, "_blk"]
    named = df.withColumn("_blk", block if block is not None else block_of(order, size))
    for name, expr in {**sums, **fills}.items():
        named = named.withColumn(f"_in_{name}", expr)
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, through)
    rows = named
    for name in sums:
        rows = rows.withColumn(f"_loc_{name}", F.sum(f"_in_{name}").over(local))
    for name in fills:
        rows = rows.withColumn(f"_loc_{name}", F.last(f"_in_{name}", ignorenulls=True).over(local))
    totals = named.groupBy(*keys).agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))).alias(f"_tot_{n}") for n in fills])
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, *[F.sum(f"_tot_{n}").over(earlier).alias(f"_pre_{n}") for n in sums],
                          *[F.last(f"_tot_{n}", ignorenulls=True).over(earlier).alias(f"_pre_{n}") for n in fills])
    joined = rows.join(carry, keys, "left")
    out = {n: F.coalesce(F.col(f"_loc_{n}") + F.coalesce(F.col(f"_pre_{n}"), F.lit(0)), F.col(f"_pre_{n}")) for n in sums}
    out.update({n: F.coalesce(F.col(f"_loc_{n}"), F.col(f"_pre_{n}")) for n in fills})
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def latest_mark(rows: DataFrame, marks: DataFrame, group: list[str], order: str, columns: list[str], size: int = BLOCK) -> DataFrame:
    """Adds ``columns`` of the last mark at or before each row (null before the first).

    ``marks`` (few, keyed by ``group`` and ``order``) are repeated over the row blocks they
    reach, so a block is complete by itself and rows are shuffled once."""
    ahead = with_neighbours(marks.select(*group, order, *columns), group, order, after=1, size=size)
    nxt = F.lead(order, 1).over(Window.partitionBy(*group, "_blk").orderBy(order))
    ends = rows.groupBy(*group).agg(F.max(order).alias("_end"))
    reach = (ahead.withColumn("_next", nxt).filter(~F.col("_halo")).drop("_blk", "_halo").join(ends, group)
             .withColumn("_stop", F.coalesce(F.col("_next") - 1, F.col("_end"))).filter(F.col("_stop") >= F.col(order))
             .withColumn("_blk", F.explode(F.sequence(block_of(order, size), block_of("_stop", size)))))
    packed = F.struct(*[F.col(c) for c in columns])
    both = (rows.withColumn("_blk", block_of(order, size)).withColumn("_mark", F.lit(None).cast(reach.select(packed.alias("m")).schema["m"].dataType))
            .withColumn("_is_row", F.lit(1))
            .unionByName(reach.select(*group, order, "_blk", packed.alias("_mark"), F.lit(0).alias("_is_row")), allowMissingColumns=True))
    w = Window.partitionBy(*group, "_blk").orderBy(order, "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(w)).filter("_is_row = 1")
    return filled.select(*rows.columns, *[F.col(f"_mark.{c}").alias(c) for c in columns])


def running_sorted(df: DataFrame, order: list[Column], value: str, out: str = "_running") -> DataFrame:
    """Running total of ``value`` over the whole table in any sort order.

    Rows are range-partitioned on the sort key (ties must be broken by the caller
    so no key is hot), written once so partition numbers cannot move between uses,
    summed inside each partition, and lifted by the prefix of the partition totals
    (one row per partition).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))
    local = placed.withColumn("_loc", F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = placed.groupBy("_pid").agg(F.sum(value).alias("_tot"))
    lift = totals.select("_pid", F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_pre"))
    # One row per shuffle partition: the size is set by configuration, not by data.
    return (local.join(F.broadcast(lift), "_pid", "left")
            .withColumn(out, F.col("_loc") + F.coalesce(F.col("_pre"), F.lit(0)))
            .drop("_pid", "_loc", "_pre"))


def rows_at_ranks(df: DataFrame, order: str, ranks, limit: int) -> DataFrame:
    """Rows at chosen 0-based positions in ``order`` (a unique whole number), with ``_rank``.

    ``ranks(n)`` lists at most ``limit`` positions from the row count.  Only the
    buckets of row numbers that hold a wanted position are sorted: one counting
    scan, then one scan keeping at most ``limit`` of 16,384 buckets.
    """
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    wanted = sorted(set(ranks(span["n"])))[:limit] if span["n"] else []
    if not wanted:
        return df.withColumn("_rank", F.lit(0).cast("bigint")).limit(0)
    width = max(-(-(span["hi"] - span["lo"] + 1) // RANK_BUCKETS), 1)
    placed = df.withColumn("_bkt", F.floor((F.col(order) - F.lit(span["lo"])) / F.lit(width)))
    counts = placed.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    # At most 16,384 bucket rows, whatever the table size.
    earlier = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    targets = F.array(*[F.lit(r).cast("bigint") for r in wanted])
    holding = (counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)))
               .withColumn("_want", F.filter(targets, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_cnt"))))
               .filter(F.size("_want") > 0).select("_bkt", "_before", "_want"))
    # No more buckets than positions: safe to broadcast.
    kept = placed.join(F.broadcast(holding), "_bkt")
    return (kept.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_bkt").orderBy(order)) - 1)
            .filter(F.array_contains("_want", F.col("_rank")))
            .drop("_bkt", "_before", "_want"))


def every_nth(n: int, points: int) -> list[int]:
    """Positions of every ceil(n/points)-th row: at most ``points`` of them."""
    return list(range(0, n, max(1, -(-n // points))))
