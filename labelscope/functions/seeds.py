"""Named seeds on the driver: the same numbers as ``scalars.child_seed`` gives in SQL."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np


def child_seed(seed: int, stream: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{stream}".encode()).digest()[:4], "little")


def rng(seed: int, stream: str) -> np.random.Generator:
    """A generator of its own for every named stream."""
    return np.random.default_rng(child_seed(seed, stream))


def set_global_seed(seed: int) -> None:
    """Seed what libraries draw from behind one's back; operators here use named streams."""
    os.environ["PYTHONHASHSEED"] = str(seed)
    random.seed(seed)
    np.random.seed(seed % 2**32)
