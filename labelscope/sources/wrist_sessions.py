"""Loaders of two further data sets of wrist recordings: hospital shifts with surveys, and a controlled protocol.

Both come as CSV files of one signal each: the start time in the first line, the rate in the
second, then a row a sample; inter-beat intervals have the start time, then rows of seconds
since the start and interval. A hospital shift is a zip archive of such files in a folder
of its participant; the controlled recordings lie as plain files in participant folders.

Files are listed and read by Spark's own reader, so paths may be remote, and a choice of
participants is made on paths before anything is read. A file is the work of one task.
Files that cannot be read as they should give one row with the fault and no sample.

Labels stay what they are: time without a validated event is unknown, never a negative.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The signals of the wrist device with their number of columns.
SIGNALS = {"ACC": 3, "BVP": 1, "EDA": 1, "HR": 1, "IBI": 2, "TEMP": 1}
SAMPLES = "participant_id string, session_id string, signal string, start_unix double, rate_hz double, sample_index long, unix_s double, x double, y double, z double, fault string"
#: Rows of a batch that a task puts out.
BATCH = 100_000


@dataclass(frozen=True)
class Layout:
    """Where files lie below a root: a glob for all or one participant, and what a path says.

    ``pattern`` has the groups ``participant`` and, where the path tells them, ``session``
    and ``signal``; without ``signal`` a file is an archive of signals.
    """

    glob: str
    pattern: str

    def paths(self, root: str, participants: list[str] | None) -> list[str]:
        return [f"{root.rstrip('/')}/{self.glob.format(participant=p)}" for p in (participants or ["*"])]


#: Hospital shifts: one archive a shift, named by participant and start.
HOSPITAL = Layout("{participant}/*.zip", r"/(?P<participant>[^/]+)/(?P<session>[^/]+)\.zip$")
#: Controlled protocol: a folder a participant, a file a signal.
PROTOCOL = Layout("{participant}/*.csv", r"/(?P<participant>S\d+)/(?P<signal>ACC|BVP|EDA|HR|IBI|TEMP)\.csv$")


def session_files(spark: SparkSession, root: str, layout: Layout, participants: list[str] | None = None) -> DataFrame:
    """(path, content) of the files of ``layout`` below ``root``; with ``participants`` only theirs are listed."""
    return spark.read.format("binaryFile").load(layout.paths(root, participants)).select("path", "content")


def parse_signal(name: str, content: bytes) -> tuple[float, float | None, np.ndarray, np.ndarray]:
    """Start, rate (none for intervals), seconds since the start and columns of a signal's file; raises ``ValueError`` at a fault."""
    lines = content.decode("ascii").splitlines()
    if name not in SIGNALS:
        raise ValueError(f"unknown signal {name}")
    if not lines:
        raise ValueError("empty file")
    start = float(lines[0].split(",")[0])
    body = [line for line in lines[1 if name == "IBI" else 2 :] if line.strip()]
    width = SIGNALS[name]
    if any(line.count(",") != width - 1 for line in body):
        raise ValueError(f"rows have not {width} columns")
    values = np.array(",".join(body).split(","), float).reshape(-1, width) if body else np.empty((0, width))
    if name == "IBI":
        return start, None, values[:, 0], values[:, 1:]
    if len(lines) < 2:
        raise ValueError("no rate")
    rate = float(lines[1].split(",")[0])
    if not rate > 0:
        raise ValueError("rate must be positive")
    return start, rate, np.arange(len(values)) / rate, values


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in sorted(archive.namelist()):
            name = member.rsplit("/", 1)[-1].removesuffix(".csv")
            if member.endswith(".csv") and name in SIGNALS:
                yield name, archive.read(member)


def _columns(participant: str, session: str, signal: str | None, n: int, **values) -> pa.RecordBatch:
    every = {"participant_id": participant, "session_id": session, "signal": signal, "start_unix": None, "rate_hz": None, "sample_index": None, "unix_s": None, "x": None, "y": None, "z": None, "fault": None} | values
    text = {"participant_id", "session_id", "signal", "fault"}
    kinds = {c: pa.string() if c in text else pa.int64() if c == "sample_index" else pa.float64() for c in every}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) if isinstance(v, np.ndarray) else pa.array([v] * n, kinds[c]) for c, v in every.items()], names=list(every))


def _read_files(pattern: str):
    known = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = known.search(path)
                if found is None:
                    continue
                said = found.groupdict()
                participant, session, signal = said["participant"], said.get("session") or said["participant"], said.get("signal")
                try:
                    files = [(signal, content.as_py())] if signal else list(_members(content.as_py()))
                except Exception as problem:  # noqa: BLE001  whatever is wrong with an archive is its fault, not the job's
                    yield _columns(participant, session, None, 1, fault=f"{type(problem).__name__}: {problem}")
                    continue
                for name, octets in files:
                    try:
                        start, rate, seconds, values = parse_signal(name, octets)
                    except ValueError as problem:
                        yield _columns(participant, session, name, 1, fault=str(problem))
                        continue
                    for at in range(0, len(values), BATCH):
                        part, when = values[at : at + BATCH], seconds[at : at + BATCH]
                        axes = {axis: part[:, k].copy() for k, axis in enumerate("xyz") if k < part.shape[1]}
                        index = np.arange(at, at + len(part))
                        yield _columns(participant, session, name, len(part), start_unix=start, rate_hz=rate, sample_index=index, unix_s=start + when, **axes)

    return run


def session_samples(files: DataFrame, layout: Layout) -> DataFrame:
    """Samples (``SAMPLES``) of ``files`` (path, content): a row a sample, or one with ``fault`` for a file that cannot be read.

    ``unix_s`` is the start and the time since it; values other than of the accelerometer are
    in ``x``. Files whose path the layout does not know are left out; a signal without
    rows has none; no files give no rows.
    """
    return files.select("path", "content").mapInArrow(_read_files(layout.pattern), SAMPLES)


def survey_events(rows: DataFrame, levels: Mapping[str, int], zone: str, moment: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """(participant_id, event_id, start_unix, end_unix, y, label_source) of survey rows (participant, start, end, level as text).

    ``levels`` says which answers are which class; any other answer, and none, is unknown (null
    ``y``). Local times are of ``zone``. Times that cannot be read, and ends that do not come
    after their start, make an event without bounds, which labels nothing.
    """
    at = lambda c: F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(F.col(c), F.lit(moment)), zone)).cast("double")
    y = F.lit(None).cast("int")
    for answer, number in levels.items():
        y = F.when(F.trim("level") == answer, F.lit(number)).otherwise(y)
    timed = rows.select(F.col("participant").cast("string").alias("participant_id"), at("start").alias("_s"), at("end").alias("_e"), y.alias("y"), F.xxhash64("participant", "start", "end").alias("event_id"))
    good = F.col("_e") > F.col("_s")
    return timed.select("participant_id", "event_id", F.when(good, F.col("_s")).alias("start_unix"), F.when(good, F.col("_e")).alias("end_unix"), "y", F.lit("survey").alias("label_source"))


def label_windows(windows: DataFrame, events: DataFrame, bin_s: float = 3600.0) -> DataFrame:
    """``windows`` (participant_id, start_unix, end_unix, ...) with ``y``, ``n_events``: the class of the events that hold the whole window.

    Where no event holds it, where its event's class is unknown, or where events disagree, ``y``
    is null: unknown. Events are dealt into time bins and a window is met in the bin of its
    start alone, so a participant's events and windows are never all compared.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_s), F.floor(F.col(b) / bin_s)))
    spans = events.filter("start_unix IS NOT NULL AND end_unix IS NOT NULL").select(
        F.col("participant_id").alias("_p"), F.col("start_unix").alias("_s"), F.col("end_unix").alias("_e"), F.col("y").alias("_y"), bins("start_unix", "end_unix").alias("_b")
    )
    met = (F.col("participant_id") == F.col("_p")) & (F.floor(F.col("start_unix") / bin_s) == F.col("_b")) & (F.col("_s") <= F.col("start_unix")) & (F.col("end_unix") <= F.col("_e"))
    held = windows.join(spans, met, "left")
    agreed = (F.count("_s") == F.count("_y")) & (F.min("_y") == F.max("_y"))
    return held.groupBy(*windows.columns).agg(F.when(agreed, F.min("_y")).cast("int").alias("y"), F.count("_s").alias("n_events"))


def task_labels(spark: SparkSession, path: str) -> DataFrame:
    """(participant_id, second, label) of the controlled protocol's combined table (CSV with Participant, Time(sec), Label)."""
    rows = spark.read.csv(path, header=True)
    number = F.regexp_extract(F.col("Participant"), r"(\d+)", 1)
    return rows.select(F.concat(F.lit("S"), F.lpad(number, 2, "0")).alias("participant_id"), F.col("`Time(sec)`").cast("double").alias("second"), F.col("Label").cast("int").alias("label"))
