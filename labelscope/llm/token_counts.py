"""Token counts of whole texts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone with the tokenizer's own library;
those that come back as exactly one token are the proven whole tokens. A text is cut
into pre-tokens here; a pre-token that is a proven whole token counts 1, and only the
others go through the library's merges (remembered per worker, in two generations of
bounded size). A text with characters for which this module does not vouch, or with a
special token's string, is encoded by the library as it stands.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import textkernel as tk
from labelscope.llm.common import bound_batches, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens a worker remembers in each of two generations.
REMEMBERED = 300_000
#: Characters of a text that are cut into pre-tokens at once (longer ones are split at white space).
PIECE = 1 << 20

#: Letters, numbers and other characters of the vouched-for alphabet, after lower-casing.
LETTERS = "a-zªµºß-öø-ÿœšž"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t\n\x0b\x0c\r "
VOUCHED = re.compile("[\t\n\x0b\x0c\r -~¡-¬®-ÿŒœŠšŸŽž‐-‧€]*")
#: The tokenizer's pre-token pattern over that alphabet.
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(text: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=4)
def whole_tokens(text: str) -> list[str]:
    """Vocabulary strings, one pre-token each, that the library encodes alone as one token: proven once a tokenizer."""
    tokenizer = load_tokenizer(text)
    bytes_of = _byte_letters()
    strings = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith("</w>"):
            try:
                strings.append(bytes(bytes_of[c] for c in entry[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    own = [s for s in strings if s and VOUCHED.fullmatch(s) and s == s.lower() and PRETOKEN.fullmatch(s) and PRETOKEN.findall(s) == [s]]
    return [s for s, e in zip(own, tokenizer.encode_batch(own, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Counts tokens of texts in one worker."""

    def __init__(self, text: str, whole: list[str]):
        self.tokenizer = load_tokenizer(text)
        self.whole = dict.fromkeys(whole, 1)
        self.young: dict[str, int] = dict(self.whole)
        self.old: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not VOUCHED.fullmatch(text) or SPECIAL.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(self._piece(p) for p in _pieces(text))

    def _piece(self, text: str) -> int:
        tokens = PRETOKEN.findall(text.lower())
        try:
            return sum(map(self.young.__getitem__, tokens))
        except KeyError:
            self._learn(set(tokens))
            return sum(map(self.young.__getitem__, tokens))

    def _learn(self, tokens: set[str]) -> None:
        missing = [t for t in tokens if t not in self.young]
        if len(self.young) + len(missing) > REMEMBERED + len(self.whole):
            self.old = self.young
            self.young = dict(self.whole)
            missing = [t for t in tokens if t not in self.young]
        unknown = []
        for t in missing:
            if (n := self.old.get(t)) is None:
                unknown.append(t)
            else:
                self.young[t] = n
        if unknown:
            for t, e in zip(unknown, self.tokenizer.encode_batch(unknown, add_special_tokens=False), strict=True):
                self.young[t] = len(e.ids)


def _pieces(text: str) -> Iterator[str]:
    """Parts of a long text, cut at white space (which ends every pre-token)."""
    at = 0
    while len(text) - at > PIECE:
        space = re.compile(f"[{SPACES}]").search(text, at + PIECE)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


_worker: dict[int, Counter] = {}


def _count(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _worker:
            _worker.clear()
            _worker[shared.id] = Counter(*shared.value)
        counter = _worker[shared.id]
        for batch in batches:
            texts = batch.column("text")
            _, offs = tk.buffers(texts)
            tokens = np.fromiter((counter.count(t) if t else 0 for t in (x.as_py() for x in texts)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return count


class _Shared:
    """A broadcast with an id that tells workers which counter they hold."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text).

    A null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids come out as
    they came in; other columns are not read; an empty table gives no rows.
    ``vocabulary`` is the path of the tokenizer's file (a few MB, broadcast).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as file:
        text = file.read()
    shared = _Shared(spark.sparkContext.broadcast((text, whole_tokens(text))), hash(text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _count(shared), "doc_id long, n_bytes long, n_tokens long"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
