"""Label runs (gaps and islands), code summaries, and alignments of runs and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.operators import rolling
from labelscope.shared import cut


#: Rows of a block in which runs are found before they are joined over block edges.
RUN_BLOCK = 4096


def contiguous_runs(labels: DataFrame, by: list[str], order: list[str], code: str = "code", block: int = RUN_BLOCK) -> DataFrame:
    """Maximal runs of equal codes: ``by``, run_index, code, start_idx, end_idx (exclusive), n_samples.

    Positions count rows in ``order`` (then code) from 0; a null code is a code of its own; no
    rows give no runs. Rows are dealt by ranges of their order and cut into blocks; runs are
    found inside blocks, and those of equal codes at a block's edge are joined by one row
    a block. So no window holds more than a block's rows, or a recording's blocks.
    """
    known = labels.select(*by, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(code).alias("code"), F.monotonically_increasing_id().alias("_id"))
    sort = [*by, *[f"_o{k}" for k in range(len(order))], "code", "_id"]  # the number deals out rows that are equal in all else
    # written, since ranges are drawn anew whenever they are needed, and blocks have to stay
    dealt = cut(known.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*by, "code", F.monotonically_increasing_id().alias("_at")))
    placed = dealt.withColumn("_block", F.floor(F.col("_at") / block))
    w = Window.partitionBy(*by, "_block").orderBy("_at")
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col("code").eqNullSafe(F.lag("code").over(w))).cast("int"))
    local = placed.select(*by, "_block", "_at", "code", changed.alias("_new"))
    local = local.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = cut(local.groupBy(*by, "_block", "_run").agg(F.first("code").alias("code"), F.count("*").alias("n"), F.min("_at").alias("_at")))
    inside = Window.partitionBy(*by, "_block").orderBy("_run")
    begun = pieces.withColumn("_start", F.sum("n").over(inside) - F.col("n"))
    edges = pieces.groupBy(*by, "_block").agg(
        F.sum("n").alias("_rows"), F.count("*").alias("_runs"), F.min_by(F.struct("code"), "_run").alias("_first"), F.max_by(F.struct("code"), "_run").alias("_last")
    )
    along = Window.partitionBy(*by).orderBy("_block")
    joined = F.coalesce(F.col("_first.code").eqNullSafe(F.lag("_last").over(along)["code"]) & F.lag("_rows").over(along).isNotNull(), F.lit(False)).cast("int")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    bases = edges.withColumn("_joined", joined).select(
        *by, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_base"),
        (F.coalesce(F.sum("_runs").over(before), F.lit(0)) - F.sum("_joined").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_run_base"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    met = begun.join(bases.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_block").alias("_b"), "_row_base", "_run_base"), [F.col("_block") == F.col("_b"), *same])
    return met.groupBy(*by, (F.col("_run") + F.col("_run_base")).alias("run_index")).agg(
        F.first("code").alias("code"), F.min(F.col("_start") + F.col("_row_base")).alias("start_idx"), F.max(F.col("_start") + F.col("_row_base") + F.col("n")).alias("end_idx"), F.sum("n").alias("n_samples")
    )


def run_seconds(runs: DataFrame, rate_hz: float) -> DataFrame:
    rate = F.lit(float(rate_hz))
    return runs.withColumn("start_s", F.col("start_idx") / rate).withColumn("end_s", F.col("end_idx") / rate).withColumn("duration_s", F.col("n_samples") / rate)


def code_summary(runs: DataFrame, by: list[str], rate_hz: float) -> DataFrame:
    """Per code: samples, seconds, runs, and the runs' seconds in order of start."""
    return runs.groupBy(*by, "code").agg(
        F.sum("n_samples").alias("n_samples"), (F.sum("n_samples") / F.lit(float(rate_hz))).alias("duration_s"), F.count("*").alias("n_runs"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_idx", "n_samples"))), lambda r: r["n_samples"] / F.lit(float(rate_hz))).alias("run_durations_s"),
    )


def code_differences(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """code, status: ``unknown`` where labels hold a code that is not expected, ``missing`` the other way."""
    seen = labels.select("code").distinct()
    unknown = seen.join(expected.select("code").distinct(), "code", "left_anti").withColumn("status", F.lit("unknown"))
    missing = expected.select("code").distinct().join(seen, "code", "left_anti").withColumn("status", F.lit("missing"))
    return unknown.unionByName(missing)


def overlap_argmax(schedule: DataFrame, runs: DataFrame, key: list[str], bin_s: float | None = None) -> DataFrame:
    """Each row of ``schedule`` (key, position, start_s, end_s) with the run of its key that it overlaps most.

    The earlier run wins a tie; rows without an overlap stay, with matched false, and so do
    those with a null key, a null bound, or an end before their start; the ``overlap_s`` of such
    a row is its own length. Both sides are dealt
    into time bins of ``bin_s`` seconds and met there, each pair in the first bin that both
    are in; so the rows of a key are not all compared. Bins are as wide as an interval is
    long on average where no width is given, which at most trebles the rows.
    """
    r = runs.select(*[F.col(k).alias(f"_r_{k}") for k in key], F.col("start_s").cast("double").alias("run_start_s"), F.col("end_s").cast("double").alias("run_end_s"))
    if bin_s is None:
        spans = schedule.select((F.col("end_s") - F.col("start_s")).alias("s")).unionByName(r.select((F.col("run_end_s") - F.col("run_start_s")).alias("s")))
        mean = spans.filter(S.finite(F.col("s")) & (F.col("s") > 0)).agg(F.avg("s")).first()[0]
        bin_s = float(mean) if mean else 1.0
    place = lambda c: F.floor(F.col(c) / F.lit(bin_s))
    dealt = lambda df, a, b, name: df.filter(S.finite(F.col(a)) & S.finite(F.col(b)) & (F.col(a) <= F.col(b))).withColumn(name, F.explode(F.sequence(place(a), place(b))))
    condition = (F.col("_bin") == F.col("_r_bin")) & (F.col("_bin") == F.greatest(place("start_s"), place("run_start_s")))
    condition = condition & (F.col("run_end_s") > F.col("start_s")) & (F.col("run_start_s") < F.col("end_s"))
    for k in key:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    pairs = dealt(schedule, "start_s", "end_s", "_bin").join(dealt(r, "run_start_s", "run_end_s", "_r_bin"), condition).select(*schedule.columns, "run_start_s", "run_end_s")
    every = pairs.unionByName(schedule.select("*", F.lit(None).cast("double").alias("run_start_s"), F.lit(None).cast("double").alias("run_end_s")))
    overlap = F.when(F.col("run_start_s").isNotNull(), F.least("end_s", "run_end_s") - F.greatest("start_s", "run_start_s"))
    best = F.max_by(
        F.struct("run_start_s", "run_end_s", overlap.alias("overlap_s")), F.struct(F.coalesce(overlap, F.lit(-1.0)), -F.coalesce("run_start_s", F.lit(0.0)))
    )
    out = every.groupBy(*schedule.columns).agg(best.alias("_b"))
    return out.select(
        *schedule.columns, F.col("_b.run_start_s").isNotNull().alias("matched"), "_b.run_start_s", "_b.run_end_s",
        F.coalesce(F.col("_b.overlap_s"), F.col("end_s") - F.col("start_s")).alias("overlap_s"),
        (F.col("_b.run_start_s") - F.col("start_s")).alias("start_offset_s"), (F.col("_b.run_end_s") - F.col("end_s")).alias("end_offset_s"),
    )


def _token(df: DataFrame, values: list[str]) -> Column:
    """One long for the values of a row; zeros of either sign are one value."""
    kinds = dict(df.dtypes)
    return F.xxhash64(*[F.col(v) + F.lit(0.0) if kinds[v] in ("float", "double") else F.col(v) for v in values])


def _agreeing(raw: DataFrame, part: DataFrame, offers: DataFrame, by: list[str], same: Column) -> DataFrame:
    """(by, offset) of ``offers`` where ``same`` (of raw's columns and part's, these with a leading underscore) holds for every row of ``part``."""
    size = part.groupBy(*by).agg(F.count("*").alias("_n"))
    wanted = part.select(*by, *[F.col(c).alias(f"_{c}") for c in part.columns if c not in by]).join(offers, by).withColumn("i", F.col("_i") + F.col("offset"))
    agree = wanted.join(raw, [*by, "i"]).filter(same).groupBy(*by, "offset").agg(F.count("*").alias("_agree"))
    return agree.join(size, by).filter("_agree = _n").select(*by, "offset")


def _unique(part: DataFrame, full: DataFrame, by: list[str]) -> DataFrame:
    """(by, matched, offset) of every sequence of ``part``: matched where ``full`` (by, offset) has one row for it."""
    found = full.groupBy(*by).agg(F.count("*").alias("_k"), F.min("offset").alias("_offset"))
    return part.select(*by).distinct().join(found, by, "left").select(*by, (F.coalesce("_k", F.lit(0)) == 1).alias("matched"), F.when(F.col("_k") == 1, F.col("_offset")).alias("offset"))


def align_exact(raw: DataFrame, part: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Offset at which ``part`` (by, i, values) is a stretch of ``raw`` (by, i, values); ``i`` counts from 0 without gaps.

    Rolling fingerprints of all stretches of the part's length propose offsets; the first and
    the last of them are then verified row by row, which tells none, one and several apart.
    More than one full match is no match (the data are periodic there). A null value agrees
    with nothing. Work is linear in both lengths however often values repeat.
    """
    # both are read several times below, and so are the sums
    raw, part = cut(raw.select(*by, "i", *values)), cut(part.select(*by, "i", *values))
    tokens = lambda df: df.select(*by, "i", _token(df, values).alias("token"))
    offers = cut(rolling.occurrences(cut(rolling.prefixes(tokens(raw), by)), rolling.fingerprint(tokens(part), by), by))
    ends = offers.groupBy(*by).agg(F.min("offset").alias("_a"), F.max("offset").alias("_b"))
    two = ends.select(*by, F.explode(F.array_distinct(F.array("_a", "_b"))).alias("offset"))
    same = F.lit(True)
    for v in values:
        same = same & (F.col(v) == F.col(f"_{v}"))
    return _unique(part, _agreeing(raw, part, two, by, same), by)


#: Width of a value bucket in tolerances, and how many staggered grids of buckets there are.
BUCKET, GRIDS = 2.0**24, 8
#: Proposed offsets of a sequence that are verified in the first round; each round takes twice as many.
FIRST_ROUND = 4


def _bucket(value: Column, grid: Column | int, tolerance: float) -> Column:
    """Place of a value on a grid of buckets; its fraction tells how near an edge it is."""
    return value / F.lit(BUCKET * tolerance) + (F.lit(grid) if isinstance(grid, int) else grid) / F.lit(float(GRIDS))


def align_within(raw: DataFrame, part: DataFrame, by: list[str], tolerance: float = 1e-9) -> DataFrame:
    """As ``align_exact`` for one real value, equal to an absolute tolerance.

    Values are put into buckets much wider than the tolerance, on the one of several staggered
    grids on which the longest beginning of the part keeps clear of bucket edges. There a row
    that agrees has the same bucket, so fingerprints of the buckets propose every offset.
    Proposed offsets are verified row by row, a few of each sequence first, then twice as many
    a round, until two agree or none is left. Values that are null or not finite agree with
    nothing.
    """
    value = S.present(F.col("value"))
    raw, clean = cut(raw.select(*by, "i", value.alias("value"))), cut(part.select(*by, "i", value.alias("value")))
    edge = lambda g: F.pmod(_bucket(F.col("value"), g, tolerance), F.lit(1.0))
    margin = lambda g: F.lit(4.0 / BUCKET) + F.abs(_bucket(F.col("value"), g, tolerance)) * F.lit(2.0**-50)  # more than the tolerance, and than rounding adds
    near = lambda g: F.col("value").isNull() | (edge(g) < margin(g)) | (edge(g) > 1 - margin(g))
    clear = clean.groupBy(*by).agg(F.count("*").alias("_n"), F.count("value").alias("_good"), *[F.min(F.when(near(g), F.col("i"))).alias(f"_e{g}") for g in range(GRIDS)])
    lengths = F.array(*[F.struct(F.coalesce(f"_e{g}", "_n").alias("length"), F.lit(-g).alias("grid")) for g in range(GRIDS)])
    chosen = clear.filter("_n = _good").withColumn("_best", F.array_max(lengths)).select(*by, F.col("_best.length").alias("_length"), (-F.col("_best.grid")).alias("_grid"))
    tokens = lambda df: df.withColumn("token", F.coalesce(F.floor(_bucket(F.col("value"), F.col("_grid"), tolerance)), F.lit(-1).cast("long")))
    beginning = tokens(clean.join(chosen, by).filter("i < _length"))
    sums = cut(rolling.prefixes(tokens(raw.join(chosen, by)).select(*by, "i", "token"), by))
    size = clean.groupBy(*by).agg(F.count("*").alias("_n"))
    last = raw.groupBy(*by).agg(F.max("i").alias("_last")).join(size, by).select(*by, (F.col("_last") - F.col("_n") + 1).alias("_most"))
    proposed = rolling.occurrences(sums, rolling.fingerprint(beginning, by), by)
    nothing = chosen.filter("_length = 0").join(raw, by).select(*by, F.col("i").alias("offset"))  # no clear beginning: every offset
    offers = cut(proposed.unionByName(nothing).join(last, by).filter("offset <= _most").select(*by, "offset"))
    same = F.abs(F.col("value") - F.col("_value")) <= tolerance
    full, left, several = None, offers, FIRST_ROUND
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy(*by).orderBy("offset"))  # Spark keeps a task's first rows of each group before it shuffles
        batch = cut(left.withColumn("_k", place).filter(F.col("_k") <= several).drop("_k"))
        agreed = _agreeing(raw, clean, batch, by, same)
        full = cut(agreed if full is None else full.unionByName(agreed))
        done = full.groupBy(*by).agg(F.count("*").alias("_k")).filter("_k > 1").select(*by)
        seen = batch.groupBy(*by).agg(F.max("offset").alias("_seen"))
        left = cut(left.join(seen, by).filter("offset > _seen").drop("_seen").join(done, by, "left_anti"))
        several *= 2
    return _unique(clean, full if full is not None else offers, by)
