"""Participant-disjoint splits: leave one out outside, stratified group folds inside."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.functions.seeds import child_seed as seed_of


class SplitError(AssertionError):
    """A split mixes participants or does not cover them."""


def lopo_folds(participants: DataFrame) -> DataFrame:
    """(outer_participant, fold_index, participant_id, part): each participant is the test set once.

    Folds are numbered by the number in the id. The pairs are all of them by definition
    of the scheme; participants are few.
    """
    ids = participants.select("participant_id").distinct().withColumn("number", S.participant_number(F.col("participant_id")))
    everyone = ids.agg(F.array_sort(F.collect_list(F.struct("number", "participant_id"))).alias("all"))
    outer = everyone.select("all", F.posexplode("all").alias("fold_index", "o"))
    pairs = outer.select(F.col("o.participant_id").alias("outer_participant"), "fold_index", F.explode("all.participant_id").alias("participant_id"))
    return pairs.withColumn("part", F.when(F.col("participant_id") == F.col("outer_participant"), "test").otherwise("train"))


def overlapping(train: DataFrame, test: DataFrame, key: str = "participant_id") -> DataFrame:
    """Participants on both sides; none is what is wanted."""
    return train.select(key).distinct().join(test.select(key), key, "left_semi")


def assert_disjoint(train: DataFrame, test: DataFrame, key: str = "participant_id") -> None:
    if not overlapping(train, test, key).isEmpty():
        raise SplitError("participants are in training and test")


def cover_violations(folds: DataFrame, participants: DataFrame, part: str = "test") -> DataFrame:
    """(participant_id, n): participants not in exactly one fold's ``part``, unknown ones included."""
    n = folds.filter(F.col("part") == part).groupBy("participant_id").agg(F.count("*").alias("n"))
    all_ = participants.select("participant_id").distinct().withColumn("_known", F.lit(True))
    both = all_.join(n, "participant_id", "full_outer").select("participant_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_known", F.lit(False)).alias("known"))
    return both.filter("n <> 1 OR NOT known").select("participant_id", "n")


@dataclass(frozen=True)
class InnerFold:
    index: int
    train: tuple[str, ...]
    validation: tuple[str, ...]


@dataclass(frozen=True)
class InnerSplit:
    outer_participant: str
    seed: int
    stream: str
    folds: tuple[InnerFold, ...]


def group_folds(counts: dict[str, tuple[int, ...]], n_splits: int, seed: int) -> list[list[str]]:
    """Groups of each fold, classes balanced greedily.

    ``counts`` are class counts by group. Groups in order of their ids are shuffled, those
    with the most uneven counts go first (stable), and each joins the fold where the spread
    of class shares between folds becomes smallest; of nearly equal ones, the fold with fewer rows.
    """
    names = sorted(counts)
    table = np.array([counts[g] for g in names], dtype=float)
    order = np.arange(len(names))
    np.random.RandomState(seed).shuffle(order)
    order = order[np.argsort(-table[order].std(axis=1), kind="stable")]
    held = np.zeros((n_splits, table.shape[1]))
    total = table.sum(axis=0)
    folds: list[list[str]] = [[] for _ in range(n_splits)]
    for group in order:
        best, best_spread, best_rows = 0, np.inf, np.inf
        for fold in range(n_splits):
            trial = held.copy()
            trial[fold] += table[group]
            spread, rows = (trial / total).std(axis=0).mean(), trial[fold].sum()
            if spread < best_spread or (np.isclose(spread, best_spread) and rows < best_rows):
                best, best_spread, best_rows = fold, spread, rows
        held[best] += table[group]
        folds[best].append(names[group])
    return folds


def inner_split(class_counts: dict[str, tuple[int, ...]], outer_participant: str, seed: int = 42, n_splits: int = 4) -> InnerSplit:
    """Validation folds over the training participants of one outer fold."""
    stream = f"inner_split:{outer_participant}"
    own = seed_of(seed, stream)
    folds = group_folds({k: v for k, v in class_counts.items() if k != outer_participant}, n_splits, own)
    everyone = sorted(k for k in class_counts if k != outer_participant)
    made = tuple(InnerFold(i, tuple(p for p in everyone if p not in set(v)), tuple(sorted(v))) for i, v in enumerate(folds))
    split = InnerSplit(outer_participant, own, stream, made)
    validate_inner(split)
    return split


def inner_folds(counts: DataFrame, seed: int = 42, n_splits: int = 4) -> DataFrame:
    """(outer_participant, seed, fold_index, participant_id, part) of every outer participant, from (participant_id, n0, n1).

    Each outer participant is a row of work for the tasks, with the counts of all (a few
    numbers a participant); no counts give no folds. A split that does not hold what
    ``validate_inner`` asks for is an error.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = counts.groupBy().agg(F.collect_list(F.struct("participant_id", "n0", "n1")).alias("a"))
    outer = every.select(F.explode("a.participant_id").alias("outer"), F.col("a.participant_id").alias("names"), F.col("a.n0").alias("zeros"), F.col("a.n1").alias("ones"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for who, names, zeros, ones in zip(frame["outer"], frame["names"], frame["zeros"], frame["ones"], strict=True):
                made = inner_split({n: (int(a), int(b)) for n, a, b in zip(names, zeros, ones, strict=True)}, who, seed, n_splits)
                rows = [(who, made.seed, f.index, p, part) for f in made.folds for part, ids in (("train", f.train), ("validation", f.validation)) for p in ids]
                yield pd.DataFrame(rows, columns=["outer_participant", "seed", "fold_index", "participant_id", "part"])

    return outer.repartition(parts, "outer").mapInPandas(run, "outer_participant string, seed long, fold_index int, participant_id string, part string")


def validate_inner(split: InnerSplit) -> None:
    """Train and validation are disjoint, never hold the outer participant, and validation covers everyone once."""
    everyone = {p for f in split.folds for p in (*f.train, *f.validation)}
    seen = [p for f in split.folds for p in f.validation]
    if split.outer_participant in everyone:
        raise SplitError("the outer participant is in an inner fold")
    if sorted(seen) != sorted(everyone):
        raise SplitError("validation folds do not cover every participant once")
    for f in split.folds:
        if set(f.train) & set(f.validation) or not f.train or not f.validation:
            raise SplitError(f"fold {f.index} mixes participants or is empty")
        if set(f.train) | set(f.validation) != everyone:
            raise SplitError(f"fold {f.index} does not hold everyone")


def to_dict(split: InnerSplit) -> dict:
    return asdict(split)


def from_dict(d: dict) -> InnerSplit:
    folds = tuple(InnerFold(f["index"], tuple(f["train"]), tuple(f["validation"])) for f in d["folds"])
    return InnerSplit(d["outer_participant"], d["seed"], d["stream"], folds)
