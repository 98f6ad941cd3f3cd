"""Column expressions: samples and seconds, labels, identifiers, seeds, tokens."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS_PER_G = 64.0
#: Label codes of the protocol and what they are called.
CONDITIONS: Mapping[int, str] = {
    0: "transient", 1: "baseline", 2: "stress", 3: "amusement", 4: "meditation", 5: "ignored_5", 6: "ignored_6", 7: "ignored_7",
}
#: Code -> binary reference label; every other code has none.
BINARY_REFERENCE: Mapping[int, int] = {1: 0, 2: 1}
#: Machine epsilon of double precision, to which probabilities are clipped for log loss.
EPSILON = 2.220446049250313e-16


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def present(value: Column) -> Column:
    """The value where it is finite, else null: missing is null here, never NaN."""
    return F.when(finite(value), value)


def acceleration(counts: Column, counts_per_g: float = COUNTS_PER_G) -> Column:
    return counts / F.lit(counts_per_g)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def millivolts(count: Column, resolution: float = 65536.0, range_mv: float = 3.0) -> Column:
    """ADC count of a centred channel as mV."""
    return (count / F.lit(resolution) - F.lit(0.5)) * F.lit(range_mv)


def sample_index(seconds: Column, rate_hz: Column) -> Column:
    """Nearest sample, halves to the even one."""
    return F.rint(seconds * rate_hz).cast("long")


def duration_s(n_samples: Column, rate_hz: Column) -> Column:
    return F.when(rate_hz > 0, n_samples / rate_hz).otherwise(F.raise_error(F.lit("rate must be positive")).cast("double"))


def window_count(duration: Column, length_s: float, step_s: float | None = None) -> Column:
    """Complete windows in a recording; 0 where it is shorter than one."""
    step = length_s if step_s is None else step_s
    n = F.floor((duration - F.lit(float(length_s))) / F.lit(float(step)) + F.lit(1e-9)) + 1
    return F.when(duration < F.lit(float(length_s)), F.lit(0)).otherwise(n).cast("int")


def window_tail(duration: Column, length_s: float, step_s: float | None = None) -> Column:
    """Seconds after the last complete window."""
    step = length_s if step_s is None else step_s
    n = window_count(duration, length_s, step_s)
    return F.when(n == 0, duration).otherwise(duration - ((n - 1) * F.lit(float(step)) + F.lit(float(length_s))))


def window_id(dataset: Column, participant: Column, index: Column) -> Column:
    return F.format_string("%s:%s:w%05d", dataset, participant, index)


def participant_number(participant: Column) -> Column:
    """Number in an id such as S12, for ordering; anything else is an error."""
    digits = F.regexp_extract(participant, r"^S(\d+)$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a participant id: "), participant)).cast("int"))


def condition_name(code: Column) -> Column:
    """Name of a homogeneous code; a window without one is mixed."""
    named = F.create_map(*[x for k, v in CONDITIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(code.isNull(), F.lit("mixed")).otherwise(F.coalesce(F.try_element_at(named, code.cast("int")), F.concat(F.lit("unknown_"), code.cast("string"))))


def binary_label(code: Column, reference: Mapping[int, int] = BINARY_REFERENCE) -> Column:
    out = F.lit(None).cast("byte")
    for k, v in reference.items():
        out = F.when(code == k, F.lit(v).cast("byte")).otherwise(out)
    return out


def ineligibility(code: Column, reference: Mapping[int, int] = BINARY_REFERENCE) -> Column:
    """Empty for eligible windows, else why one is not."""
    return (
        F.when(code.isNull(), F.lit("mixed_label_codes"))
        .when(code.isin(*reference), F.lit(""))
        .otherwise(F.concat(F.lit("homogeneous_code_"), code.cast("string"), F.lit("_outside_binary_reference")))
    )


def hard_prediction(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(threshold)).cast("byte")


def minutes_seconds(token: Column) -> Column:
    """``minutes.seconds`` in seconds: 7.08 is 428, 50.3 is 3030, 12 is 720; 60 seconds or more are an error."""
    minutes = F.substring_index(token, ".", 1).cast("double")
    fraction = F.when(F.instr(token, ".") > 0, F.substring_index(token, ".", -1)).otherwise(F.lit("0"))
    seconds = F.substring(F.rpad(fraction, 2, "0"), 1, 2).cast("double")
    return F.when(seconds < 60, minutes * 60 + seconds).otherwise(F.raise_error(F.concat(F.lit("seconds out of range in "), token)).cast("double"))


def child_seed(seed: int, stream: Column) -> Column:
    """First four bytes of sha-256 of ``seed:stream``, little-endian, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), stream), 256)
    swapped = F.concat(*[F.substring(digest, at, 2) for at in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def tie_key(seed: Column | int, participant: Column, window: Column) -> Column:
    """Hexadecimal digest that orders tied windows without labels or time; its order is that of the number."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat_ws(":", seed.cast("string"), participant, window), 256)


def candidate_id(family: str, parameters: Mapping[str, object]) -> str:
    return f"{family}:" + ",".join(f"{k}={v}" for k, v in parameters.items())


def clipped(probability: Column, epsilon: float = EPSILON) -> Column:
    return F.least(F.greatest(probability, F.lit(epsilon)), F.lit(1.0 - epsilon))


def budget(fraction: float, n: Column) -> Column:
    return F.floor(F.lit(float(fraction)) * n).cast("int")


def codes_text(codes: Column) -> Column:
    """A set of integer codes as sorted, comma-joined text."""
    return F.array_join(F.transform(F.array_sort(codes), lambda c: c.cast("string")), ",")


def utc_text(unix_seconds: Column) -> Column:
    """Unix seconds as ISO text in UTC, to the second (session time zone: UTC)."""
    return F.date_format(F.timestamp_micros((unix_seconds * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")


def clock_residual_s(difference_s: Column, hours: float = 2.0) -> Column:
    """What is left of a difference of two device clocks after a whole offset of hours."""
    return difference_s - F.lit(hours * 3600.0)
