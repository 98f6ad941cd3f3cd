"""Token ids of whole texts by a byte-level BPE file, as the ``tokenizers`` library gives them.

``tiktoken`` runs the same vocabulary several times faster. It is used where both libraries
must agree: merges are the same list, and texts are split by the same pattern, whose
classes (letters, numbers, white space) are compared for every character of Unicode. Texts
with a character that the two class differently, with a special token's string, or with a
run so long that merging it would be quadratic go through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Bytes without ASCII white space (or of nothing else) from which a text is left to the library with the better bound.
LONG_RUN = 1024


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


def _byte_of() -> dict[str, int]:
    """The bytes that the printable stand-ins of byte-level vocabularies are for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(text: str) -> dict[bytes, int] | None:
    """Bytes of every token with its id, if ids follow the order of merges (which ranks stand for)."""
    parsed, byte_of = json.loads(text), _byte_of()
    special = {t["content"] for t in parsed["added_tokens"]}
    vocab = {k: v for k, v in parsed["model"]["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
    ids = [vocab["".join(m)] for m in merges]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or any(c not in byte_of for k in vocab for c in k):
        return None
    return {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}


def _all_characters() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@functools.lru_cache(maxsize=1)
def unsure_characters() -> str:
    """Characters that the two libraries' patterns class differently (letter, number, white space)."""
    import tiktoken
    from tokenizers import Regex, pre_tokenizers

    every = _all_characters()
    differ: set[str] = set()
    for kind in (r"\p{L}+", r"\p{N}+", r"\s+"):
        one = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        first = set(one.decode(one.encode_ordinary(every)))  # only what the pattern matches is encoded
        second = {s for s, _ in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every)}
        differ |= first ^ {c for s in second for c in s}
    return "".join(sorted(differ))


class Ids:
    """Encodes texts in one worker."""

    def __init__(self, text: str, unsure: str):
        self.tokenizer = load_tokenizer(text)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsure = set(unsure)
        ranks = _ranks(text)
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.fast = None

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or not self._agreed(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def _agreed(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if self.unsure and not text.isascii() and not self.unsure.isdisjoint(text):
            return False
        return len(text) <= LONG_RUN or not has_long_run(text)


def has_long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` bytes stand between two ASCII blanks or line ends, or as many of these in a row."""
    octets = np.frombuffer(text.encode(), np.uint8)
    blank, size = np.flatnonzero(octets <= 32), len(octets)
    if np.diff(blank, prepend=-1, append=size).max() > LONG_RUN:
        return True
    return len(blank) >= LONG_RUN and bool((blank[LONG_RUN - 1 :] - blank[: 1 - LONG_RUN] == LONG_RUN - 1).any())
