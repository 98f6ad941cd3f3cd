"""The canonical feature table: windows with provenance, reference, quality and features.

Inputs are long tables: ``samples`` (participant_id, modality ACC/EDA/BVP/TEMP, sample_index,
value or x, y, z), ``labels`` (participant_id, sample_index, code) and ``sources``
(participant_id, source_file, source_sha256). Every modality is one grouped pass over its
own samples; the passes meet on (participant_id, window_index).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope import schema as C
from labelscope.functions.signal import BvpParams, EdaParams
from labelscope.operators import decompose, features, quality, windows
from labelscope.operators.quality import QualityParams
from labelscope.operators.windows import WindowSpec

RATES = {"acc": 32.0, "bvp": 64.0, "eda": 4.0, "temp": 4.0}
LABEL_RATE = 700.0
KEY = ["participant_id", "window_index"]
ORDER = ("acc", "eda", "bvp", "temp")


def durations(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """participant_id, duration_s (the shortest stream, labels included), spread_s."""
    rate = F.lit(None).cast("double")
    for m, r in RATES.items():
        rate = F.when(F.col("modality") == m.upper(), F.lit(r)).otherwise(rate)
    streams = samples.groupBy("participant_id", "modality").agg(F.count("*").alias("n_samples")).withColumn("rate_hz", rate)
    reference = labels.groupBy("participant_id").agg(F.count("*").alias("n_samples")).select("participant_id", F.lit("label").alias("modality"), "n_samples", F.lit(LABEL_RATE).alias("rate_hz"))
    return windows.usable_duration(streams.unionByName(reference))


def build(
    samples: DataFrame, labels: DataFrame, sources: DataFrame, dataset: str = "wearable", spec: WindowSpec = WindowSpec(), eda: EdaParams = EdaParams(), bvp: BvpParams = BvpParams(), q: QualityParams = QualityParams()
) -> DataFrame:
    """The 117-column table. Windows are made from durations; labels only annotate them."""
    length = spec.length_s
    lasting = durations(samples, labels)
    edges = {"label": LABEL_RATE, **{m: RATES[m] for m in C.MODALITIES}}
    grid = windows.window_grid(lasting, spec, edges, dataset).withColumn("dataset", F.lit(dataset))
    dealt = {m: windows.assign_windows(samples.filter(F.col("modality") == m.upper()), lasting, spec, RATES[m]) for m in ORDER}
    marked = windows.assign_windows(labels, lasting, spec, LABEL_RATE)
    out = windows.annotate(grid, marked, int(round(LABEL_RATE * length)))

    bare = grid.select(*KEY)
    for m in ORDER:
        channels = ["x", "y", "z"] if m == "acc" else ["value"]
        flags = quality.modality_flags(dealt[m], KEY, channels, int(round(RATES[m] * length)), m, q)
        out = out.join(quality.complete_flags(bare, flags, KEY, m), KEY)
    named = {
        "acc": quality.any_near_rail(["x", "y", "z"], q).alias("q_acc_near_rail"), "eda": quality.any_below(F.col("value"), q.eda_floor).alias("q_eda_below_plausible"),
        "temp": quality.any_outside(F.col("value"), q.temp_low, q.temp_high).alias("q_temp_out_of_range"),
    }
    for m, flag in named.items():
        out = out.join(dealt[m].groupBy(*KEY).agg(flag), KEY, "left")
    out = out.fillna(False, ["q_acc_near_rail", "q_eda_below_plausible", "q_temp_out_of_range"])

    # recording-level signals, each computed once and then dealt to windows
    parts = decompose.eda_decomposition(samples.filter("modality = 'EDA'"), RATES["eda"], eda)
    ok = parts.groupBy("participant_id").agg(F.bool_and("ok").alias("q_eda_decomposition_ok"))
    parts = windows.assign_windows(parts, lasting, spec, RATES["eda"]).withColumn("t", F.col("sample_index") / F.lit(RATES["eda"]) - F.col("window_index") * F.lit(length))
    peaks = decompose.pulse_peaks(samples.filter("modality = 'BVP'"), RATES["bvp"], bvp)
    beats_ok = peaks.groupBy("participant_id").agg(F.bool_and("ok").alias("q_bvp_pulse_detection_ok"))
    beats = windows.assign_windows(peaks.filter("sample_index IS NOT NULL"), lasting, spec, RATES["bvp"]).withColumn("t", F.col("sample_index") / F.lit(RATES["bvp"]))

    for made in (
        features.acceleration_features(dealt["acc"], KEY), features.eda_features(parts, KEY), features.bvp_features(dealt["bvp"], KEY),
        features.temperature_features(dealt["temp"].withColumn("t", F.col("sample_index") / F.lit(RATES["temp"]) - F.col("window_index") * F.lit(length)), KEY),
    ):
        out = out.join(made, KEY, "left")
    events = parts.filter("event_amplitude IS NOT NULL")
    out = features.event_features(out, events, KEY, "event_amplitude", "eda_scr")
    out = features.interbeat_features(out, beats, KEY, length)
    out = out.join(ok, "participant_id", "left").join(beats_ok, "participant_id", "left").fillna(False, ["q_eda_decomposition_ok", "q_bvp_pulse_detection_ok"])
    # a recording without decomposition has no event features at all, unlike a window without events
    for c in ("eda_scr_count", "eda_scr_amp_sum", "eda_scr_amp_mean", "eda_scr_amp_max"):
        out = out.withColumn(c, F.when(F.col("q_eda_decomposition_ok"), F.col(c).cast("double")))
    for c in ("bvp_beat_count", "bvp_valid_ibi_count", "bvp_beat_coverage"):
        out = out.withColumn(c, F.when(F.col("q_bvp_pulse_detection_ok"), F.col(c).cast("double")))
    out = out.withColumn("q_bvp_hr_available", F.col("q_bvp_hr_available") & F.col("q_bvp_pulse_detection_ok"))

    failed, text = F.lit(None).cast("int"), F.lit("")
    for k in range(len(ORDER) - 1, -1, -1):
        few = F.col(f"q_{ORDER[k]}_n_samples") < 2
        failed, text = F.when(few, F.lit(k)).otherwise(failed), F.when(few, F.lit(f"{ORDER[k]}: fewer than two samples")).otherwise(text)
    out = out.withColumn("error_family", failed).withColumn("q_feature_error", text).withColumn("q_structural_ok", quality.structural_ok(list(ORDER)))
    families = [[c.name for c in C.feature_columns() if c.metadata["modality"] == m] for m in ORDER]
    out = features.null_after_error(out, families).drop("error_family").join(sources.select("participant_id", "source_file", "source_sha256"), "participant_id", "left")
    declared = C.all_columns()
    kinds = {c.name: c.dataType for c in declared}
    return C.order_columns(out.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in out.columns]), declared)
