"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Equal vectors form one class with a number of copies. The classes are dealt by their
nearest pivot into cells and these into blocks of bounded size; every block gets a cover
tree. Cells whose balls around their pivots come near enough are paired, then their blocks
by their own balls, and two paired blocks are joined by a dual traversal of their trees. A
join puts out one row per class it links: how many vectors it is linked with there, and
the smallest class that these links reach. Pairs are never put out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm.common import bound_batches, cut, released, table
from labelscope.llm.components import connected_components
from labelscope.llm.cover_tree import Edges, Tree, join, paths

THRESHOLD = 0.9
#: Bytes of vectors in a block.
BLOCK_BYTES = 8 << 20
MAX_PIVOTS = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _deal(shared):
    """Adds the nearest pivot of the vector's length to each class, and the distance from it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, np.ndarray] = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                cosine = _matrix(batch.column("v").take(pa.array(rows))) @ pivots[int(dim)].T
                cell[rows] = cosine.argmax(1)
                far[rows] = np.sqrt(np.maximum(0, 2 - 2 * cosine.max(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return deal


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, values, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        at = 0
        for end in (np.flatnonzero(change) + 1).tolist():
            yield pa.Table.from_batches([*held, batch.slice(at, end - at)])
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cover-tree paths of every block's classes, and the block's ball."""
    for t in _runs(batches, "block"):
        t = t.combine_chunks()
        x, rep = _matrix(t.column("v").chunk(0)), t.column("rep").to_numpy()
        path = rep[paths(x)]
        middle = x.mean(0)
        norm = np.sqrt(middle @ middle)
        middle = middle / norm if norm > 1e-12 else x[0]
        radius = float(np.sqrt(np.maximum(0, 2 - 2 * (x @ middle))).max())
        n = len(rep)
        first = np.zeros(n, bool)
        first[0] = True
        yield pa.RecordBatch.from_arrays(
            [
                t.column("block").chunk(0), t.column("dim").chunk(0), t.column("cell").chunk(0), t.column("rep").chunk(0), t.column("copies").chunk(0), t.column("v").chunk(0),
                pa.FixedSizeListArray.from_arrays(pa.array(path.ravel()), path.shape[1]).cast(pa.list_(pa.int64())),
                pa.array([middle.tolist() if f else None for f in first], pa.list_(pa.float64())), pa.array(np.where(first, radius, 0.0), mask=~first),
            ],
            names=["block", "dim", "cell", "rep", "copies", "v", "path", "middle", "radius"],
        )


def _tree(t: pa.Table) -> tuple[Tree, np.ndarray]:
    t = t.combine_chunks()
    rep = t.column("rep").to_numpy()
    order = np.argsort(rep)
    path = t.column("path").chunk(0).flatten().to_numpy().reshape(len(rep), -1)
    place = order[np.searchsorted(rep, path, sorter=order)]
    return Tree(_matrix(t.column("v").chunk(0)), place, t.column("copies").to_numpy()), rep


def near_cells(cells: list, pivots: dict[int, np.ndarray], limit: float) -> pd.DataFrame:
    """(dim, first, second) of cells (dim, cell, radius) that links no longer than ``limit`` may join; first <= second.

    There are at most MAX_PIVOTS cells to a dimension.
    """
    found = [np.zeros((0, 3), np.int64)]
    for dim, x in pivots.items():
        radius = np.full(len(x), -np.inf)
        for c in cells:
            if c["dim"] == dim:
                radius[c["cell"]] = c["radius"]
        gap = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
        i, j = np.nonzero(np.triu(gap <= radius[:, None] + radius + limit))
        found.append(np.stack([np.full(len(i), dim), i, j], 1))
    return pd.DataFrame(np.concatenate(found), columns=["dim", "first", "second"])


def _traverse(threshold: float):
    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "i", "j"):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            edges = Edges()
            if i == j:
                a, ids_a = _tree(t)
                join(a, None, threshold, ids_a, ids_a, edges)
                reps, links = ids_a, a.totals()
            else:
                block = t.column("block").to_numpy()
                a, ids_a = _tree(t.filter(pa.array(block == i)))
                b, ids_b = _tree(t.filter(pa.array(block == j)))
                join(a, b, threshold, ids_a, ids_b, edges)
                reps, links = np.concatenate([ids_a, ids_b]), np.concatenate([a.totals(), b.totals()])
            some = np.flatnonzero(links)
            node, low = edges.stars()
            root = reps.copy()
            if len(node):
                order = np.argsort(reps)
                root[order[np.searchsorted(reps, node, sorter=order)]] = low
            yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(links[some]), pa.array(root[some])], names=["rep", "links", "root"])

    return traverse


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of ``vectors`` (vec_id, embedding).

    Rows are linked when their cosine reaches ``threshold``; only vectors of equal length
    are compared. n_links counts the other rows linked with a row; component_id is the
    smallest vec_id that links reach. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without vec_id, link with nothing. Repeated rows are
    linked with each other. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 5000)
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(17), "v"))
    classes = rows.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # very large or small components: scaled so that squares neither overflow nor vanish
    scale = F.array_max(F.transform("v", lambda x: F.abs(x)))
    classes = classes.withColumn("m", scale).withColumn("v", F.expr("transform(v, x -> x / m)")).drop("m").withColumn("dim", F.size("v"))
    classes = cut(classes)

    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    most = {dim: max(64, block_bytes // (8 * dim)) for dim in sizes}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        wanted = min(MAX_PIVOTS, -(-n // most[dim]))
        picked = classes.filter(F.col("dim") == dim).orderBy(F.md5(F.col("rep").cast("string"))).limit(wanted).select("v").collect()
        x = np.array([r["v"] for r in picked])
        pivots[dim] = x / np.sqrt((x * x).sum(1, keepdims=True))
    dealt = classes.select("rep", "copies", "dim", "v").mapInArrow(
        released(_deal(spark.sparkContext.broadcast(pivots))), "rep long, copies long, dim int, v array<double>, cell int, far double"
    )
    dealt = cut(dealt)
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("most", F.greatest(F.lit(64), F.floor(F.lit(block_bytes) / (8 * F.col("dim")))))
    limit = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    close = near_cells(dealt.groupBy("dim", "cell").agg(F.max("far").alias("radius")).collect(), pivots, limit)
    close = spark.createDataFrame(close, "dim int, first int, second int") if len(close) else spark.createDataFrame([], "dim int, first int, second int")
    cells = cells.select("dim", "cell", F.ceil(F.col("n") / F.col("most")).cast("int").alias("chunks"))
    blocked = dealt.join(cells, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    blocked = blocked.withColumn("block", F.xxhash64("dim", "cell", "chunk"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planted = blocked.select("block", "dim", "cell", "rep", "copies", "v").repartition(parts, "block").sortWithinPartitions("block", "rep")
    planted = cut(
        planted.mapInArrow(released(_plant), "block long, dim int, cell int, rep long, copies long, v array<double>, path array<long>, middle array<double>, radius double")
    )

    balls = planted.filter("middle IS NOT NULL").select("block", "dim", "cell", "middle", "radius")
    left, right = (balls.select(*[F.col(c).alias(f"{c}_{side}") for c in balls.columns]) for side in "ij")
    cosine = F.expr("aggregate(zip_with(middle_i, middle_j, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    gap = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))
    near = F.broadcast(close).join(left, (F.col("dim") == F.col("dim_i")) & (F.col("first") == F.col("cell_i")))
    near = near.join(right, (F.col("dim") == F.col("dim_j")) & (F.col("second") == F.col("cell_j")))
    near = near.filter((F.col("first") < F.col("second")) | (F.col("block_i") <= F.col("block_j")))
    near = near.filter(gap <= F.col("radius_i") + F.col("radius_j") + limit)
    near = near.select(F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    sides = near.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    paired = planted.select("block", "rep", "copies", "v", "path").join(sides, "block")
    paired = paired.repartition(max(parts, 64), "i", "j").sortWithinPartitions("i", "j", "block", "rep")
    found = cut(paired.mapInArrow(released(_traverse(threshold)), "rep long, links long, root long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = rows.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    known = known.join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    known = known.select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
    )
    out = rows.select("vec_id", "h1", "h2", "good").join(known, F.col("good") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``embeddings``."""
    found = near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP1_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b
          WHERE a.vec_id <> b.vec_id
            AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT u.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(u.vec_id, coalesce(m, u.vec_id)) AS component_id,
       u.vec_id = least(u.vec_id, coalesce(m, u.vec_id)) AS kept
FROM u LEFT JOIN deg ON u.vec_id = deg.x LEFT JOIN low ON u.vec_id = low.x
"""
