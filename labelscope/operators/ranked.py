"""Running totals of groups of any size: rows dealt by ranges of their order, sums carried over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.shared import cut

#: Rows of a block in which sums run before those of earlier blocks are added.
BLOCK = 4096


def running_totals(rows: DataFrame, by: list[str], order: dict[str, Column], values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``rows`` with, for each of ``values`` (named whole numbers), ``<name>_before`` and ``<name>_total`` within ``by``.

    The first is the sum over the rows earlier in ``order`` (named columns, ascending, nulls
    first), 0 for the first row; the second that over all rows of the group. Rows of equal order
    follow one another in any order; null keys are a group; no rows give no rows. Rows are
    dealt by ranges of (``by``, ``order``) and cut into blocks, so no window holds more than
    a block's rows, or a group's blocks, and a group is spread over as many tasks as its size
    asks for.
    """
    names = [*rows.columns, *[f"{v}_{part}" for v in values for part in ("before", "total")]]
    keys = [f"_k{k}" for k in range(len(by))]
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    known = rows.select(row, *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[c.alias(f"_o_{n}") for n, c in order.items()], *[v.cast("long").alias(f"_v_{n}") for n, v in values.items()])
    sort = [*keys, *[f"_o_{n}" for n in order]]
    held = [f"_v_{n}" for n in values]
    # no number of ranges, so that adaptive execution joins small neighbours; written, since
    # ranges are drawn anew whenever they are needed, and blocks have to stay
    dealt = cut(known.repartitionByRange(*sort).sortWithinPartitions(*sort).select("_row", *keys, *held, F.monotonically_increasing_id().alias("_at")))
    placed = dealt.withColumn("_block", F.floor(F.col("_at") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("_row", *keys, "_block", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in held])
    sums = placed.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in held])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *[F.col(k).alias(f"_b{k}") for k in keys], F.col("_block").alias("_b"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b{v}") for v in held], *[F.sum(v).over(Window.partitionBy(*keys)).alias(f"_t{v}") for v in held],
    )
    met = local.join(bases, [F.col("_block") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys]])
    sums_out = [c for v in held for c in (F.col(v) + F.col(f"_b{v}"), F.col(f"_t{v}"))]
    return met.select(*[F.col(f"_row.`{c}`") for c in rows.columns], *sums_out).toDF(*names)
