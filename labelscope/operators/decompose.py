"""Recording-level signal operators: recordings of at most a chunk many a call, longer ones chunk by chunk (see ``block_signals``), the work of many tasks.

A failure is a status, never an exception. Recordings whose peaks cannot be told from chunks
for sure, such as very long stairs of ever higher peaks, are worked on whole, one a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import signal as G
from labelscope.operators import block_signals as B
from labelscope.shared import cut

EDA_SCHEMA = "participant_id string, sample_index long, value double, tonic double, phasic double, event_amplitude double, ok boolean, error string"
BEAT_SCHEMA = "participant_id string, sample_index long, ok boolean, error string"


def _each_recording(samples: DataFrame, run, schema: str, dealt: bool) -> DataFrame:
    """Of each recording in order, the columns that ``run`` makes of its (indexes, values), after its participant_id.

    A task's recordings stream past, so no call to Python is for one alone. The work is in
    the function, not in the bytes, so small partitions are not to be merged. Where samples are
    ``dealt``, recordings whole and in order, they are not dealt once more.
    """
    given = samples.select("participant_id", "sample_index", "value")
    if not dealt:
        parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        given = given.repartition(parts, "participant_id").sortWithinPartitions("participant_id", "sample_index")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []  # of the recording that has begun

        def ended() -> tuple:
            made = run(pa.concat_arrays([i for i, _ in held]), np.concatenate([x for _, x in held]))
            return name, made

        def rows(made: list[tuple]) -> pa.RecordBatch:
            who = pa.array([w for w, _ in made], pa.string()).take(pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for _, m in made])))
            return pa.RecordBatch.from_arrays([who, *[pa.concat_arrays(c) for c in zip(*[m for _, m in made], strict=True)]], names)

        for batch in batches:
            index, x = batch["sample_index"], batch["value"].to_numpy(zero_copy_only=False)
            runs = pc.run_end_encode(batch["participant_id"])
            ends, made = runs.run_ends.to_pylist(), []
            for who, begin, end in zip(runs.values.to_pylist(), [0, *ends], ends):  # noqa: B905
                if held and who != name:
                    made.append(ended())
                    held = []
                name = who
                held.append((index[begin:end], x[begin:end]))
            if made:
                yield rows(made)
        if held:
            yield rows([ended()])

    names = [c.split()[0] for c in schema.split(", ")]
    return given.mapInArrow(stream, schema)


def eda_of_whole_recordings(samples: DataFrame, rate_hz: float, params: G.EdaParams = G.EdaParams(), dealt: bool = False) -> DataFrame:
    """As ``eda_decomposition``, a recording whole in a task."""
    given = asdict(params)

    def run(index: pa.Array, x: np.ndarray) -> tuple:
        n = len(x)
        given_value = pa.array(x, mask=np.isnan(x))
        try:
            tonic, phasic, at, height = G.decompose_eda(x, rate_hz, G.EdaParams(**given))
        except ValueError as problem:
            nothing = pa.nulls(n, pa.float64())
            return index, given_value, nothing, nothing, nothing, pa.repeat(False, n), pa.repeat(str(problem), n)
        amplitude, none = np.zeros(n), np.ones(n, bool)
        amplitude[at], none[at] = height, False
        return index, given_value, pa.array(tonic), pa.array(phasic), pa.array(amplitude, mask=none), pa.repeat(True, n), pa.repeat("", n)

    return _each_recording(samples, run, EDA_SCHEMA, dealt)


def beats_of_whole_recordings(samples: DataFrame, rate_hz: float, params: G.BvpParams = G.BvpParams(), dealt: bool = False) -> DataFrame:
    """As ``pulse_peaks``, a recording whole in a task."""
    given = asdict(params)

    def run(index: pa.Array, x: np.ndarray) -> tuple:
        try:
            at, _ = G.detect_beats(x, rate_hz, G.BvpParams(**given))
        except ValueError as problem:
            return pa.nulls(1, pa.int64()), pa.repeat(False, 1), pa.repeat(str(problem), 1)
        return index.take(pa.array(at)), pa.repeat(True, len(at)), pa.repeat("", len(at))

    return _each_recording(samples, run, BEAT_SCHEMA, dealt)


def _parted(samples: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """Recordings of at most a chunk, and longer ones if there are any, written.

    Samples are counted first and then read again, which costs less than to write them all.
    """
    known = samples.select("participant_id", F.col("sample_index").cast("long").alias("sample_index"), F.col("value").cast("double").alias("value")).filter("participant_id IS NOT NULL")
    long = cut(known.groupBy("participant_id").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select("participant_id"))
    if long.isEmpty():
        return known, None
    return known.join(long, "participant_id", "left_anti"), cut(known.join(long, "participant_id", "left_semi"))


NOT_FINITE = "recording has non-finite samples"


def _too_short(sections: np.ndarray) -> Column:
    """Why a recording cannot be filtered, or null."""
    pad = G.padding(sections)
    return F.when(F.col("n") <= pad, F.format_string("signal of %d samples is too short to filter", F.col("n")))


def _unsure(chunks: DataFrame) -> DataFrame:
    return chunks.filter("unsure").select("participant_id").distinct()


def eda_decomposition(samples: DataFrame, rate_hz: float, params: G.EdaParams = G.EdaParams(), chunk: int = B.CHUNK, reach: int = B.REACH, dealt: bool = False) -> DataFrame:
    """Samples (participant_id, sample_index, value) with tonic and phasic parts and event amplitudes.

    Where a recording cannot be decomposed its parts are null, ok is false and error says why.
    Recordings of at most a ``chunk`` are worked on whole, longer ones chunk by chunk.
    ``dealt`` says that a recording's samples lie in one partition, together and in order.
    """
    short, long = _parted(samples, chunk)
    made = eda_of_whole_recordings(short, rate_hz, params, dealt and long is None)
    return made if long is None else made.unionByName(_eda_by_chunks(long, rate_hz, params, chunk, reach))


def _eda_by_chunks(samples: DataFrame, rate_hz: float, params: G.EdaParams, chunk: int, reach: int) -> DataFrame:
    sections = G.butterworth(params.order, params.cutoff_hz, rate_hz)
    short = F.when(F.col("n") < 8 * params.order + 1, F.lit("recording is too short to decompose"))
    rows = B.cut(B.placed(samples, chunk).withColumn("error", F.coalesce(short, F.when(F.col("n_bad") > 0, F.lit(NOT_FINITE)), _too_short(sections))))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("tonic", "phasic", "event_amplitude")]
    failed = rows.filter("error IS NOT NULL").select("participant_id", "sample_index", "value", *nothing, F.lit(False).alias("ok"), "error")
    chunks = B.worked(rows.filter("error IS NULL"), sections, params.distance_s * rate_hz, True, chunk, reach)
    unsure = _unsure(chunks)
    sure = chunks.join(unsure, "participant_id", "left_anti")
    found = B.prominent(sure).filter(F.col("prominence") >= params.prominence)
    events = found.groupBy("participant_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") - F.col("chunk") * chunk).cast("int").alias("k"), F.col("prominence").alias("v")))).alias("_events"))
    each = sure.select("participant_id", "chunk", F.posexplode(F.arrays_zip("indexes", "given", "made")).alias("_k", "_s")).join(events, ["participant_id", "chunk"], "left")
    decided = each.select(
        "participant_id", F.col("_s.indexes").alias("sample_index"), F.col("_s.given").alias("value"), (F.col("_s.given") - F.col("_s.made")).alias("tonic"), F.col("_s.made").alias("phasic"),
        F.try_element_at("_events", F.col("_k")).alias("event_amplitude"), F.lit(True).alias("ok"), F.lit("").alias("error"),
    )
    whole = eda_of_whole_recordings(rows.join(unsure, "participant_id", "left_semi"), rate_hz, params)
    return failed.unionByName(decided).unionByName(whole)


def pulse_peaks(samples: DataFrame, rate_hz: float, params: G.BvpParams = G.BvpParams(), chunk: int = B.CHUNK, reach: int = B.REACH, dealt: bool = False) -> DataFrame:
    """One row for each beat (participant_id, sample_index); one with a null sample_index where detection failed.

    Recordings of at most a ``chunk`` are worked on whole, longer ones chunk by chunk.
    ``dealt`` says that a recording's samples lie in one partition, together and in order.
    """
    short, long = _parted(samples, chunk)
    made = beats_of_whole_recordings(short, rate_hz, params, dealt and long is None)
    return made if long is None else made.unionByName(_beats_by_chunks(long, rate_hz, params, chunk, reach))


def _beats_by_chunks(samples: DataFrame, rate_hz: float, params: G.BvpParams, chunk: int, reach: int) -> DataFrame:
    sections = G.butterworth(params.order, (params.low_hz, params.high_hz), rate_hz)
    rows = B.cut(B.placed(samples, chunk).withColumn("error", F.coalesce(F.when(F.col("n_bad") > 0, F.lit(NOT_FINITE)), _too_short(sections))))
    chunks = B.worked(rows.filter("error IS NULL"), sections, params.distance_s * rate_hz, False, chunk, reach)
    unsure = _unsure(chunks)
    sure = chunks.join(unsure, "participant_id", "left_anti")
    made = sure.select("participant_id", F.explode("made").alias("y"))
    middle = B.cut(B.medians(made, "y"))
    off = made.join(middle, "participant_id").select("participant_id", F.abs(F.col("y") - F.col("median")).alias("off"))
    scale = B.cut(B.medians(off, "off").select("participant_id", (F.col("median") * F.lit(G.MAD_SCALE)).alias("scale")))
    still = scale.filter("scale <= 0").select("participant_id", F.lit("signal has no variation").alias("error"))
    failed = rows.filter("error IS NOT NULL").select("participant_id", "error").distinct().unionByName(still)
    failures = failed.select("participant_id", F.lit(None).cast("long").alias("sample_index"), F.lit(False).alias("ok"), "error")
    found = B.prominent(sure).join(scale.filter("scale > 0"), "participant_id").filter(F.col("prominence") >= params.prominence_scale * F.col("scale"))
    beats = found.join(sure.select("participant_id", "chunk", "indexes"), ["participant_id", "chunk"]).select(
        "participant_id", F.get("indexes", (F.col("place") - F.col("chunk") * chunk).cast("int")).alias("sample_index"), F.lit(True).alias("ok"), F.lit("").alias("error")
    )
    whole = beats_of_whole_recordings(rows.join(unsure, "participant_id", "left_semi"), rate_hz, params)
    return failures.unionByName(beats).unionByName(whole)
