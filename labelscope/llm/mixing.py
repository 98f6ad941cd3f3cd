"""Mixing sources to target weights, in DataFrame operations alone.

Every document gets a hash-random key. Within a source, documents are ordered by
the key; the key's leading digits deal each source into key ranges, whose totals
give every range's offset, so that running sums are taken inside one range only
(a distributed prefix sum: no window holds a whole source). A source is then cut
at its exact budget. A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.llm.common import cut, table

#: Hexadecimal digits of the key that choose a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> the same with weight and target.

    Sources sorted by code point (null last) take ``weights`` in turn. Targets share
    the total by weight; none passes ``cap`` times its source's size, and the excess
    goes to the others by weight until none is above. In closed form: with sources
    ordered by size per weight, the first ones are capped as long as their cap is at
    most their share of what the ones before left; the rest share by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        weighed.withColumn("capped_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.col("capped_before"))
        .withColumn("over", F.col("limit") * F.col("weight_left") <= F.col("left") * F.col("weight"))
        .withColumn("level", F.min(F.when(~F.col("over"), F.struct(F.col("capped_before"), F.col("left"), F.col("weight_left")))).over(every))
    )
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.weight_left")
    target = F.when(F.col("over"), F.col("limit").cast("double")).otherwise(share)
    return shared.select("source", "source_size", "weight", target.alias("target"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    Inputs are ``doc_id, text, source``; other columns are ignored. A null text has
    size 0; null is a source of its own. Repeated rows count and are taken each on
    their own (equal keys and sizes, so their order does not change the figures'
    multiset). Rows without doc_id have the key of their text. Ties of the key are ordered by
    doc_id, then by size. A source whose
    sizes sum to 0 takes nothing. An empty table gives no rows.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    # written once: a few bytes a row go on, and the texts are read in one pass
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("mix_key")
    ).withColumn("mix_range", F.substring("mix_key", 1, RANGE_DIGITS))
    sized = cut(sized)
    ranges = sized.groupBy("source", "mix_range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_from", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    sources = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, cap)
    plan = ranges.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        F.col("r.source").alias("plan_source"), F.col("r.mix_range").alias("plan_range"), "range_from", "source_size", "target"
    )
    inside = Window.partitionBy("source", "mix_range").orderBy("mix_key", "doc_id", "size")
    running = sized.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = running.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("mix_range") == F.col("plan_range")))
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut_at = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("range_from") + F.col("inside"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut_at).cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all of ``documents``, weights 1, 2, 3 in turn, at most 3 epochs."""
    return mix_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w,
              3 * source_size AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, (SELECT sum(w) FROM s1) - coalesce(sum(w) OVER o, 0) AS wleft,
              (SELECT sum(source_size) FROM s1) AS total
       FROM s1 WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * wleft <= (total - capped) * w AS over FROM s2),
lv AS (SELECT total - capped AS room, wleft FROM s3 WHERE NOT over ORDER BY capped LIMIT 1),
st AS (SELECT source, source_size, CASE WHEN over THEN CAST(cap AS DOUBLE)
              ELSE CAST((SELECT room FROM lv) AS DOUBLE) * w / CAST((SELECT wleft FROM lv) AS DOUBLE) END AS target FROM s3),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM sized),
j AS (SELECT run.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget FROM run JOIN st ON run.source IS NOT DISTINCT FROM st.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS ep FROM j)
SELECT doc_id, size, source_size, target,
       CAST(ep * size + greatest(0, least(size, budget - ep * source_size - before)) AS BIGINT) AS taken
FROM e
"""
