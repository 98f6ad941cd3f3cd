"""Filters and peaks of recordings of any length, chunk by chunk.

A chunk is worked on with a halo of samples at either side. The halo is so long that what a
stable filter remembers of a wrong beginning has died out before the chunk begins, in both
directions; beyond that, it leaves ``REACH`` distances of filtered samples around the chunk
for the peak rules:

- whether a peak gives way to a higher one near it hangs on a chain of ever higher peaks;
  a chain that ends inside the halo is decided as in the whole recording. A recording with
  a chain that may not is handed back as unsure;
- a prominence needs the way to the next higher sample. Where that is outside the halo, the
  chunks' summaries (the samples that are higher than all before them, and the lowest one up
  to each, from either end) tell it, one short row a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions import signal as G
from labelscope.shared import cut

#: Samples of a chunk, what is left of a filter's memory behind a halo, and peak distances that a halo reaches further.
CHUNK, FORGOTTEN, REACH = 65_536, 1e-14, 64


def halo_of(sections: np.ndarray) -> int:
    """Samples after which the slowest pole of ``sections`` has died out (with room for poles that stand together)."""
    slowest = max(abs(r) for row in sections for r in np.roots(row[3:]))
    return int(np.ceil(1.5 * np.log(FORGOTTEN) / np.log(slowest))) + 50


def zero_phase(sections: np.ndarray, x: np.ndarray, left: int, right: int) -> np.ndarray:
    """Filtered samples of ``x`` without the ``left`` and ``right`` ones of its halo."""
    return G.filter_both_ways(sections, x)[left : len(x) - right]


def chunk_peaks(y: np.ndarray, begin: int, end: int, open_left: bool, open_right: bool, apart: int) -> tuple[list[tuple], bool]:
    """Peaks in ``y[begin:end]`` as in the whole recording, and whether that is sure.

    ``y`` has more samples on either side; it goes on beyond them where open. A peak is
    (place, height, low to the left, whether that is final, low to the right, the same).
    """
    places = G.local_maxima(y)
    flat = np.flatnonzero(np.diff(y))
    first = int(flat[0]) + 1 if len(flat) else len(y)
    last = int(flat[-1]) + 1 if len(flat) else 0
    # up to here (from here on) there may be peaks that cannot be seen
    dark_left, dark_right = (first if open_left else -apart - 1), (last if open_right else len(y) + apart + 1)
    unsure = (open_left and first > begin) or (open_right and last < end)
    at, state = places.tolist(), [""] * len(places)
    for i in np.argsort(y[places], kind="stable")[::-1].tolist():
        near = set()
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(at) and abs(at[j] - at[i]) < apart:
                near.add(state[j])
                j += step
        if apart > 1 and "kept" in near:
            state[i] = "gone"
        elif apart > 1 and ("unsure" in near or at[i] - dark_left < apart or dark_right - at[i] < apart):
            state[i] = "unsure"
        else:
            state[i] = "kept"
    inside = [k for k, p in enumerate(at) if begin <= p < end]
    unsure = unsure or any(state[k] == "unsure" for k in inside)
    kept = [at[k] for k in inside if state[k] == "kept"]
    if not kept:
        return [], unsure
    low_left, low_right = G._low_since_higher(y), G._low_since_higher(y[::-1])[::-1]
    most_left, most_right = np.maximum.accumulate(y), np.maximum.accumulate(y[::-1])[::-1]
    out = []
    for p in kept:
        ends = (not open_left or most_left[p] > y[p], not open_right or most_right[p] > y[p])
        out.append((p, float(y[p]), float(low_left[p]), bool(ends[0]), float(low_right[p]), bool(ends[1])))
    return out, unsure


def climbs(y: np.ndarray) -> tuple[list[float], list[float]]:
    """Samples of ``y`` higher than all before them, and the lowest sample before each."""
    most, least = np.maximum.accumulate(y), np.minimum.accumulate(y)
    at = np.flatnonzero(np.concatenate([[True], y[1:] > most[:-1]]))
    return y[at].tolist(), np.where(at > 0, least[np.maximum(at - 1, 0)], np.inf).tolist()


def placed(samples: DataFrame, chunk: int) -> DataFrame:
    """(participant_id, sample_index, value, place, n, n_bad): places from 0 in order of ``sample_index``, n and n_bad of the recording.

    Dealt by ranges and counted by blocks, so no window holds a recording.
    """
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col("value").cast("double")
    known = samples.select("participant_id", F.col("sample_index").cast("long").alias("sample_index"), value.alias("value"))
    dealt = cut(known.repartitionByRange(parts, "participant_id", "sample_index").sortWithinPartitions("participant_id", "sample_index").withColumn("_at", F.monotonically_increasing_id()))
    blocks = dealt.withColumn("_block", F.floor(F.col("_at") / chunk))
    bad = F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == F.lit(float("inf"))))
    counts = blocks.groupBy("participant_id", "_block").agg(F.count("*").alias("_rows"), bad.alias("_bad"))
    along = Window.partitionBy("participant_id")
    bases = counts.select(
        "participant_id", "_block", F.coalesce(F.sum("_rows").over(along.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_rows").over(along).alias("n"), F.sum("_bad").over(along).alias("n_bad"),
    )
    inside = F.row_number().over(Window.partitionBy("participant_id", "_block").orderBy("_at")) - 1
    return blocks.withColumn("_in", inside).join(bases, ["participant_id", "_block"]).select("participant_id", "sample_index", "value", (F.col("_in") + F.col("_base")).alias("place"), "n", "n_bad")


WORKED = """participant_id string, chunk long, unsure boolean, indexes array<long>, given array<double>, made array<double>, least double,
    up array<double>, up_low array<double>, down array<double>, down_low array<double>,
    peaks array<struct<place: long, height: double, left: double, left_done: boolean, right: double, right_done: boolean>>"""


def worked(rows: DataFrame, sections: np.ndarray, distance: float, rest: bool, chunk: int = CHUNK, reach: int = REACH) -> DataFrame:
    """Chunks (``WORKED``) of recordings (as from ``placed``, all finite and long enough), written.

    ``made`` is the filtered signal, or with ``rest`` what the filter leaves; peaks are of it.
    """
    apart = max(1, int(np.ceil(distance)))
    memory, more = halo_of(sections), reach * apart + 2
    halo = memory + more
    last = F.floor((F.col("n") - 1) / chunk)
    chunks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - halo) / chunk)), F.least(last, F.floor((F.col("place") + halo) / chunk)))
    several = rows.select("participant_id", "sample_index", "value", "place", "n", F.explode(chunks).alias("chunk"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        n, at = int(frame["n"].iloc[0]), int(key[1]) * chunk
        begin, end = at, min(n, at + chunk)
        low, high = max(0, begin - halo), min(n, end + halo)
        seen_low, seen_high = max(0, begin - more), min(n, end + more)
        x = frame["value"].to_numpy(float)
        filtered = zero_phase(sections, x, seen_low - low, high - seen_high)
        y = x[seen_low - low : len(x) - (high - seen_high)] - filtered if rest else filtered
        peaks, unsure = chunk_peaks(y, begin - seen_low, end - seen_low, seen_low > 0, seen_high < n, apart)
        core = y[begin - seen_low : end - seen_low]
        (up, up_low), (down, down_low) = climbs(core), climbs(core[::-1])
        inner = slice(begin - low, end - low)
        found = [{"place": p + seen_low, "height": h, "left": a, "left_done": b, "right": c, "right_done": d} for p, h, a, b, c, d in peaks]
        return pd.DataFrame({
            "participant_id": [key[0]], "chunk": [int(key[1])], "unsure": [unsure], "indexes": [frame["sample_index"].to_numpy()[inner]], "given": [x[inner]], "made": [core], "least": [float(core.min())],
            "up": [up], "up_low": [up_low], "down": [down], "down_low": [down_low], "peaks": [found],
        })

    return cut(several.groupBy("participant_id", "chunk").applyInPandas(run, WORKED))


def _low_until_higher(height: float, low: float, chunks: Iterator[tuple[float, list[float], list[float]]]) -> float:
    """The lowest sample up to the first one above ``height``, over chunks (lowest, climbs, lows before them) in order."""
    for least, rising, lows in chunks:
        k = int(np.searchsorted(rising, height, side="right"))
        if k < len(rising):
            return min(low, lows[k])
        low = min(low, least)
    return low


RESOLVED = "participant_id string, chunk long, place long, height double, prominence double"


def prominent(chunks: DataFrame) -> DataFrame:
    """(participant_id, chunk, place, height, prominence) of all peaks of ``worked`` chunks.

    Peaks whose way is not at its end meet the summaries of their recording's chunks; the
    others, nearly all, go nowhere.
    """
    peaks = chunks.select("participant_id", "chunk", F.explode("peaks").alias("p")).select("participant_id", "chunk", "p.*")
    done = F.col("left_done") & F.col("right_done")
    ready = peaks.filter(done).select("participant_id", "chunk", "place", "height", (F.col("height") - F.greatest("left", "right")).alias("prominence"))
    waiting = peaks.filter(~done)
    asked = waiting.select(F.col("participant_id").alias("_asked")).distinct()
    summaries = chunks.select(F.col("participant_id").alias("_who"), F.col("chunk").alias("_chunk"), "least", "up", "up_low", "down", "down_low").join(asked, F.col("_who") == F.col("_asked"), "left_semi")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"participant_id": [], "chunk": [], "place": [], "height": [], "prominence": []}).astype({"participant_id": str})
        right = right.sort_values("_chunk").reset_index(drop=True)
        spans = {int(c): k for k, c in enumerate(right["_chunk"])}
        ahead, back = list(zip(right["least"], right["up"], right["up_low"], strict=True)), list(zip(right["least"], right["down"], right["down_low"], strict=True))
        values = []
        for p in left.itertuples():
            k = spans[p.chunk]
            to_left = p.left if p.left_done else _low_until_higher(p.height, p.left, (back[j] for j in range(k - 1, -1, -1)))
            to_right = p.right if p.right_done else _low_until_higher(p.height, p.right, (ahead[j] for j in range(k + 1, len(ahead))))
            values.append(p.height - max(to_left, to_right))
        return left[["participant_id", "chunk", "place", "height"]].assign(prominence=values)

    resolved = waiting.groupBy("participant_id").cogroup(summaries.groupBy("_who")).applyInPandas(run, RESOLVED)
    return ready.unionByName(resolved)


def medians(rows: DataFrame, value: str, bracket: int = 10_000) -> DataFrame:
    """(participant_id, median) of finite values, exact: a sketch brackets each median, and only values inside the bracket are put in order."""
    ends = F.percentile_approx(value, F.array(F.lit(0.5 - 2 / bracket), F.lit(0.5 + 2 / bracket)), bracket)
    found = rows.groupBy("participant_id").agg(ends.alias("_ends"), F.count(value).alias("_n"))
    inside = rows.join(found, "participant_id").filter(F.col(value) <= F.col("_ends")[1])
    counts = inside.groupBy("participant_id", "_n", F.when(F.col(value) >= F.col("_ends")[0], F.col(value)).alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy("participant_id").orderBy(F.col("_v").asc_nulls_first()))
    reached = counts.withColumn("_upto", upto).filter("_v IS NOT NULL")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    return reached.groupBy("participant_id").agg(((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias("median"))
