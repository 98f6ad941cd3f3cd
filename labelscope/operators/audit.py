"""Structural audit of recordings: label and signal statistics, flags, grades, flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.operators import runs

#: Flags with these marks make a recording unusable.
HARD = ("_missing", "_no_matching_run", "unexpected", "not_integer_valued", "_channels_", "not_numeric")
SOFT = ("missing_condition_codes",)


def signal_stats(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, counts of NaN or null and of infinities, and least and greatest value ignoring both."""
    v = F.col(value)
    infinite = F.abs(v) == F.lit(float("inf"))
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("n_nan"), F.count_if(infinite).alias("n_inf"),
        F.min(S.present(v)).alias("min"), F.max(S.present(v)).alias("max"),
    )


def label_audit(labels: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """Counts of labels and of those that are not whole numbers, and the codes that occur."""
    c = F.col(code)
    return labels.groupBy(*by).agg(
        F.count("*").alias("n_labels"), F.count_if(c != F.rint(c.cast("double"))).alias("n_not_integer"), F.array_sort(F.collect_set(code)).alias("codes")
    )


def flags(audit: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """key, flags: names of the rules that hold, in the rules' order; a rule that is null does not hold."""
    named = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return audit.select(*key, F.filter(named, lambda x: x.isNotNull()).alias("flags"))


def grade(flags_: Column) -> Column:
    """unusable with a hard flag, questionable with another, else apparently_usable."""
    hard = F.exists(flags_, lambda f: F.array_contains(F.transform(F.array(*[F.lit(h) for h in HARD]), lambda h: F.contains(f, h)), True) & ~f.isin(*SOFT))
    return F.when(hard, F.lit("unusable")).when(F.size(flags_) > 0, F.lit("questionable")).otherwise(F.lit("apparently_usable"))


def clock_difference(devices: DataFrame, residual_s: float = 30.0, hours: float = 2.0) -> DataFrame:
    """Difference of two devices' starts (chest_start_s local, wrist_start_s UTC), residual after whole hours, and its flag."""
    d = F.col("chest_start_s") - F.col("wrist_start_s")
    out = devices.withColumn("difference_s", d).withColumn("residual_s", S.clock_residual_s(d, hours))
    return out.withColumn("clock_flag", F.abs("residual_s") > residual_s)


def schedule_flags(matched: DataFrame, key: list[str], spread_s: float = 2.0) -> DataFrame:
    """Per key: conditions without a run, and whether the offsets of the matched ones spread too far."""
    offset = F.col("start_offset_s")
    return matched.groupBy(*key).agg(F.count_if(~F.col("matched")).alias("n_no_matching_run"), (F.max(offset) - F.min(offset) > spread_s).alias("offset_spread_flag"))


def classification(readable: Column, flags_: Column) -> Column:
    """The grade with its reasons: ``unusable:`` and the hard flags, ``questionable:`` and all flags, or apparently_usable."""
    marks = F.array(*[F.lit(h) for h in HARD[1:]])
    hard = F.filter(flags_, lambda f: F.endswith(f, F.lit("_missing")) | F.exists(marks, lambda h: F.contains(f, h)))
    return (
        F.when(~readable, F.lit("unusable:pkl_unreadable_or_missing"))
        .when(F.size(hard) > 0, F.concat(F.lit("unusable:"), F.array_join(hard, ";")))
        .when(F.size(flags_) > 0, F.concat(F.lit("questionable:"), F.array_join(flags_, ";")))
        .otherwise(F.lit("apparently_usable"))
    )


def release_audit(found: DataFrame, spread_s: float = 2.0, residual_s: float = 30.0) -> DataFrame:
    """``found`` (a row a participant, see ``recording_audit.FOUND``) with clocks, matched schedules, all flags and a classification.

    Schedules are counted from the start of the chest device's file; without its crop
    they cannot be placed and stay unverified.
    """
    key = "participant_id"
    devices = found.withColumn("chest_start_s", F.col("chest_start_s") + F.col("chest_crop_s"))
    clocks = clock_difference(devices.select(key, "chest_start_s", "wrist_start_s"), residual_s).select(key, "difference_s", "residual_s", "clock_flag")
    planned = found.filter("chest_crop_s IS NOT NULL").select(key, "chest_crop_s", F.explode("schedule").alias("s")).select(
        key, "s.position", "s.condition", F.col("s.expected_code").alias("code"), (F.col("s.start_s") - F.col("chest_crop_s")).alias("start_s"), (F.col("s.end_s") - F.col("chest_crop_s")).alias("end_s")
    )
    ran = found.select(key, F.explode("runs").alias("r")).select(key, "r.code", "r.start_s", "r.end_s")
    matched = runs.overlap_argmax(planned, ran, [key, "code"])
    offset = lambda name: F.max(name) - F.min(name) > spread_s
    missed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("matched"), F.struct("position", "condition")))), lambda x: F.concat(F.lit("schedule_"), x["condition"], F.lit("_no_matching_run")))
    by = matched.groupBy(key).agg(
        missed.alias("missed"), F.coalesce(offset("start_offset_s") | offset("end_offset_s"), F.lit(False)).alias("uneven"),
        F.array_sort(F.collect_list(F.struct("position", "condition", "code", "matched", "run_start_s", "run_end_s", "start_offset_s", "end_offset_s"))).alias("schedule_matches"),
    )
    said = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    unplaced = F.col("readable") & F.col("n_labels").isNotNull() & F.col("schedule").isNotNull() & F.col("chest_crop_s").isNull() & (F.size("runs") > 0)
    out = found.join(clocks, key, "left").join(by, key, "left")
    out = out.withColumn(
        "flags",
        F.concat(
            "flags", said(F.col("clock_flag"), "device_clocks_disagree_gt_30s"), said(unplaced, "schedule_alignment_unverified"), F.coalesce("missed", F.array().cast("array<string>")),
            said(F.col("uneven"), "schedule_offsets_inconsistent_across_conditions"),
        ),
    )
    return out.drop("missed", "uneven", "clock_flag").withColumn("classification", classification(F.col("readable"), F.col("flags")))


def release_tables(audited: DataFrame) -> dict[str, DataFrame]:
    """Participant, signal, label, run and schedule tables of ``release_audit``."""
    lasting = lambda *codes: F.aggregate(F.filter("labels", lambda x: x["code"].isin(*codes)), F.lit(0.0), lambda a, x: a + x["duration_s"])
    with_mark = lambda *marks: F.array_join(F.filter("flags", lambda f: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(f, m))), ";")
    has = lambda device: F.exists("signals", lambda x: x["device"] == device)
    seconds = {"baseline": (1,), "stress": (2,), "amusement": (3,), "meditation": (4,), "transient": (0,), "ignore_codes": (5, 6, 7)}
    tables = {
        "participants": audited.select(
            "participant_id", "readable", lasting(*range(-100, 100)).alias("recording_duration_s"), *[lasting(*codes).alias(f"{name}_duration_s") for name, codes in seconds.items()],
            S.codes_text(F.transform("labels", lambda x: x["code"])).alias("codes_present"), has("wrist").alias("wrist_available"), has("chest").alias("chest_available"),
            F.array_join(F.filter("flags", lambda f: F.endswith(f, F.lit("_missing"))), ";").alias("missing_signals"), with_mark("length", "duration", "schedule").alias("shape_alignment_flags"),
            with_mark("nonfinite").alias("nan_inf_flags"), "classification", "notes", "chest_crop_s", "wrist_crop_s", "residual_s", "rows_minus_labels",
        )
    }
    for name in ("signals", "labels", "runs", "schedule_matches"):
        tables[name] = audited.select("participant_id", F.explode(name).alias("_x")).select("participant_id", "_x.*")
    return tables


def count_summary(windows: DataFrame) -> DataFrame:
    """Windows, eligible ones, classes and mixed ones in all (participant_id null) and by participant, in one pass."""
    g = windows.groupingSets([["participant_id"], []], "participant_id")
    return g.agg(
        F.count("*").alias("n_windows"), F.count_if("binary_eligible").alias("n_eligible"), F.count_if(F.col("analysis_label") == 0).alias("n_baseline"),
        F.count_if(F.col("analysis_label") == 1).alias("n_stress"), F.count_if(~F.col("is_label_homogeneous")).alias("n_mixed"),
    )


def ineligible_codes(windows: DataFrame) -> DataFrame:
    """How many homogeneous windows have each code outside the binary reference."""
    rows = windows.filter(F.col("is_label_homogeneous") & ~F.col("binary_eligible"))
    return rows.groupBy("homogeneous_raw_label").agg(F.count("*").alias("n")).orderBy("homogeneous_raw_label")


def flat_tables(audit: DataFrame) -> dict[str, DataFrame]:
    """Participant, signal, label and run tables of nested audit rows (participant_id, grade, flags, signals, labels, runs)."""
    key = [c for c in ("participant_id",) if c in audit.columns]
    tables = {"participants": audit.select(*key, "grade", F.array_join("flags", ";").alias("flags"))}
    for name in ("signals", "labels", "runs"):
        tables[name] = audit.select(*key, F.posexplode(name).alias("position", "_x")).select(*key, "position", "_x.*")
    return tables
