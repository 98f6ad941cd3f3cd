"""Configuration documents: reading, deep merge, open entries, contracts, typed parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from labelscope.functions.scalars import BINARY_REFERENCE, COUNTS_PER_G
from labelscope.functions.signal import BvpParams, EdaParams
from labelscope.operators.quality import QualityParams
from labelscope.operators.windows import WindowSpec


class ConfigError(ValueError):
    """A configuration contradicts what is fixed."""


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` on top of ``base``; mappings are merged, everything else (lists too) is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(dataset: str | None, folder: Path) -> dict[str, Any]:
    """base.yaml of ``folder`` with the dataset's file on top."""
    import yaml

    documents = [yaml.safe_load((Path(folder) / f"{name}.yaml").read_text()) or {} for name in ("base", dataset) if name]
    out: dict[str, Any] = {}
    for d in documents:
        out = merge(out, d)
    return out


def open_entries(config: Any, at: str = "") -> list[str]:
    """Dotted paths of null entries."""
    if config is None:
        return [at]
    if isinstance(config, Mapping):
        return [p for k, v in config.items() for p in open_entries(v, f"{at}.{k}" if at else str(k))]
    if isinstance(config, list):
        return [p for i, v in enumerate(config) for p in open_entries(v, f"{at}[{i}]")]
    return []


def get(config: Mapping[str, Any], path: str) -> Any:
    for key in path.split("."):
        if not isinstance(config, Mapping) or key not in config:
            raise ConfigError(f"missing entry {path}")
        config = config[key]
    return config


#: Entries that a configuration may state but not change.
FIXED = {
    "windowing.length_s": 60, "windowing.step_s": 60, "windowing.origin_s": 0, "windowing.drop_incomplete": True,
    "labels.positive_code": 2, "labels.negative_code": 1, "acceleration.counts_per_g": 64,
}


def validate(config: Mapping[str, Any], fixed: Mapping[str, Any] = FIXED) -> None:
    """Every entry of ``fixed`` must be there with that value."""
    wrong = [f"{p}: {got!r}, not {want!r}" for p, want in fixed.items() if (got := get(config, p)) != want or isinstance(got, bool) != isinstance(want, bool)]
    if wrong:
        raise ConfigError("; ".join(wrong))


def binary_reference(labels: Mapping[str, Any]) -> dict[int, int]:
    """Codes of the two classes; must be the fixed ones, and none of the codes left out."""
    got = {labels.get("negative_code"): 0, labels.get("positive_code"): 1}
    if got != dict(BINARY_REFERENCE) or set(got) & set(labels.get("ineligible_codes", ())):
        raise ConfigError(f"binary reference {got} is not {dict(BINARY_REFERENCE)}")
    return {int(k): v for k, v in got.items()}


@dataclass(frozen=True)
class Parameters:
    window: WindowSpec
    eda: EdaParams
    bvp: BvpParams
    quality: QualityParams
    counts_per_g: float


def parameters(config: Mapping[str, Any]) -> Parameters:
    """Frozen parameter objects of a valid configuration; sections left out keep their defaults."""
    validate(config)
    take = lambda kind, name: kind(**{k: v for k, v in config.get(name, {}).items()})
    w = config["windowing"]
    counts = float(get(config, "acceleration.counts_per_g"))
    if counts != COUNTS_PER_G:
        raise ConfigError("counts per g is fixed")
    return Parameters(WindowSpec(float(w["length_s"]), float(w["step_s"]), float(w["origin_s"])), take(EdaParams, "eda"), take(BvpParams, "bvp"), take(QualityParams, "quality"), counts)
