"""Noisy-channel restoration of disguised words under a character language model.

A token that may be disguised (marks or digits between letters, letters repeated three
times and more, single letters spaced out) becomes a lattice: each character may stand
for itself, for a letter it resembles, for nothing (a separator, a repetition) or for a
word boundary, at a cost. The Viterbi path through the lattice under a character trigram
model gives the restored token. All other text has one path, itself, and stays.

A token ends at white space, at a byte that hides nothing, and where a script without
spaces meets another one. Tokens and separators may have any length: one lattice is laid
over the whole token, and its rivals are read for the words of the best path.
"""

from __future__ import annotations

import re

import numpy as np

from labelscope.llm import textkernel as tk

#: Marks and digits and the letters they resemble.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
SEPARATORS = ".-_*'~ "
#: Costs in nats: a letter behind a look-alike, behind "*", no character, a look-alike meant as it stands,
#: a space meant as one between spaced letters, a shortened repetition.
RESEMBLES, WILD, NOTHING, LITERAL, GAP, SHORTENED = 1.0, 2.5, 1.2, 6.5, 2.0, 0.5
#: Rivals are read for as many words of the best path together as have this many characters.
LONGEST = 40
SPACED = 4
#: Readings kept, and how much dearer than the best a rival may be.
RIVALS, MARGIN = 5, 7.0
REMEMBERED = 100_000

N_SYMBOLS = 28  # 0 boundary, 1-26 letters, 27 any other letter
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_ALIKE = np.zeros(256, bool)
_ALIKE[[ord(c) for c in LOOKALIKES]] = True
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in SEPARATORS.strip()]] = True
#: ASCII bytes that end a token.
_HARD = ~(_LETTER | _ALIKE | _BETWEEN)
#: What is read in one step: separators or white space of any length, a character and its repetitions.
_UNIT = re.compile(r"[-._'~ \t\n\r\f\v]+|(.)\1*", re.S)
_NOTHING = frozenset(SEPARATORS + "\t\n\r\f\v")


def count_trigrams(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of symbol triples of lower-cased texts, none across texts, as a flat array."""
    symbol = np.zeros(len(raw) + 2 * len(offs), np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    symbol[np.arange(len(raw)) + 2 * (text + 1)] = _SYMBOL[raw]  # two boundaries before each text
    code = (symbol[:-2] * N_SYMBOLS + symbol[1:-1]) * N_SYMBOLS + symbol[2:]
    return np.bincount(code, minlength=N_SYMBOLS**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -log P(c | a, b) of all triples, interpolated with shorter contexts."""
    three = counts.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS).astype(np.float64)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + N_SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def suspects(raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of lower-cased texts that may hold disguised words, in order, disjoint."""
    starts, ends = tokens(raw, offs)
    if not len(starts):
        return []
    letter = _LETTER[raw]
    n = len(raw)
    inner = np.zeros(n, bool)
    if n > 2:
        same_left = np.concatenate([[False], raw[1:] == raw[:-1]])
        same_right = np.append(raw[:-1] == raw[1:], False)
        next_letter = np.append(letter[1:], False)
        before = np.concatenate([[False], letter[:-1]])
        first = np.zeros(n, bool)
        first[starts] = True
        alike = _ALIKE[raw] & ~same_left & ~same_right
        left_ok = before | first | np.concatenate([[False], _ALIKE[raw[:-1]]])
        inner |= alike & next_letter & left_ok
        a, b = tk.runs(_BETWEEN[raw], offs)
        within = before[a] & ~first[a] & np.append(letter & ~first, False)[b]
        inner[a[within]] = inner[b[within] - 1] = True
        inner[2:] |= letter[2:] & (raw[2:] < 128) & same_left[2:] & same_left[1:-1]
    flagged = np.zeros(len(starts), bool)
    marks = np.flatnonzero(inner)
    home = np.searchsorted(starts, marks, side="right") - 1
    flagged[home[marks < ends[home]]] = True
    found = [(int(starts[i]), int(ends[i])) for i in np.flatnonzero(flagged & (ends - starts >= 3))]
    words, stops, woffs = tk.word_spans(raw, offs, tk.NONSPACE)
    single = (stops - words == 1) & (letter[words] | _ALIKE[raw[words]])
    for a, b in zip(*tk.runs(single, woffs), strict=True):
        if b - a >= SPACED and letter[words[a:b]].sum() >= 2:
            found.append((int(words[a]), int(stops[b - 1])))
    return sorted(found)


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens: no white space or hard byte in them, and either scripts without spaces or others.

    Marks between two characters of scripts without spaces belong to them, other marks to what else they touch.
    """
    n = len(raw)
    soft = ~_HARD[raw]
    lead = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(n), 0))
    head = raw[lead]
    unspaced = (head >= 0xE3) & (head <= 0xED)
    if n:
        unspaced |= (head == 0xE0) & (raw[np.minimum(lead + 1, n - 1)] >= 0xB8)  # Thai, Lao
    a, b = tk.runs(soft & ~_LETTER[raw], offs)
    if len(a):
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        between = (a > 0) & (b < n) & ~edge[a] & ~edge[b]
        between &= unspaced[np.maximum(a - 1, 0)] & unspaced[np.minimum(b, n - 1)]
        turned = np.zeros(n + 1, np.int64)
        turned[a[between]] = 1
        turned[b[between]] -= 1
        unspaced |= np.cumsum(turned[:-1]) > 0
    one, two = tk.runs(soft & ~unspaced, offs), tk.runs(soft & unspaced, offs)
    starts, ends = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
    order = np.argsort(starts)
    return starts[order], ends[order]


class Restorer:
    """Restores tokens under a language model, remembering a bounded number of them."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[tuple[str, bool], list[str]] = {}
        self.best: dict[str, tuple[str, list[list[str]], bool]] = {}

    def readings(self, token: str, spaced: bool = False) -> list[str]:
        """The best path and its near rivals, best first; ``spaced`` says that a whole of single letters is known of."""
        out = self.known.get((token, spaced))
        if out is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = self.known[token, spaced] = self._viterbi(token, spaced)
        return out

    def token(self, token: str) -> str:
        """The cheapest path through the lattice of the whole token, whatever its length."""
        return self._best(token)[0]

    def rivals(self, token: str) -> str:
        """All readings, for scoring: of the words of the best path, ``LONGEST`` characters together, and over their joints."""
        best, parts, spaced = self._best(token)
        out = [best]
        for words in parts:
            out += self.readings("".join(words), spaced)
        for left, right in zip(parts, parts[1:], strict=False):
            out += self.readings(left[-1] + right[0], spaced)
        return " ".join(dict.fromkeys(out))

    def _best(self, token: str) -> tuple[str, list[list[str]], bool]:
        """A token's best path, its words as lists of about ``LONGEST`` characters each, and whether it is spaced."""
        out = self.best.get(token)
        if out is None:
            out = self._path(token)
            if len(token) <= LONGEST:
                if len(self.best) >= REMEMBERED:
                    self.best.clear()
                self.best[token] = out
        return out

    def _path(self, token: str) -> tuple[str, list[list[str]], bool]:
        units = [m[0] for m in _UNIT.finditer(token)]
        spaced = _spaced(units)
        costs = self.costs
        # per state: cost, and the texts put out with whether a word ends there, the last one first
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self._options(units, spaced):
            ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (cost, steps) in paths.items():
                for option in options:
                    out, price, boundary = option
                    a, b, more = p, q, cost + price
                    for symbol in (0,) if boundary else _symbols(out):
                        more += costs[a][b][symbol]
                        a, b = b, symbol
                    if (a, b) not in ahead or more < ahead[a, b][0]:
                        ahead[a, b] = (more, (steps, option))
            paths = ahead
        steps = min(((cost + costs[a][b][0], n, held) for n, ((a, b), (cost, held)) in enumerate(paths.items())), key=lambda x: x[:2])[2]
        texts, ends = [], {len(units)}
        while steps is not None:
            steps, (out, _, boundary) = steps
            texts.append(out)
            if boundary:
                ends.add(len(units) - len(texts) + 1)
        parts: list[list[str]] = []
        at, room = 0, 0
        for end in sorted(ends):
            while at < end:
                stop = min(end, at + 4 * LONGEST)  # a stretch without any word end
                word, at = "".join(units[at:stop]), stop
                if not parts or len(word) > room:
                    parts.append([])
                    room = LONGEST
                parts[-1].append(word)
                room -= len(word)
        return "".join(reversed(texts)), parts, spaced

    def _options(self, units: list[str], spaced: bool) -> list[list[tuple[str, float, bool]]]:
        """Per unit: (text put out, cost, whether it is a boundary to the model)."""
        steps: list[list[tuple[str, float, bool]]] = []
        for k, unit in enumerate(units):
            c, n = unit[0], len(unit)
            if c.isalpha():
                options = [(unit, 0.0, False)]
                if n >= 3:
                    options += [(c, SHORTENED, False), (c * 2, SHORTENED, False)]
            else:
                alike = LOOKALIKES.get(c, "") if n == 1 or n == 2 and c in "$0!|@" else ""
                options = [(unit, GAP if spaced and c in _NOTHING else LITERAL if alike else 0.0, True)]
                for x in alike:
                    options.append((x * n, WILD if c == "*" else RESEMBLES * n, False))
                if c in _NOTHING and 0 < k < len(units) - 1:
                    options.append(("", 0.0 if spaced else NOTHING, False))
            steps.append(options)
        return steps

    def _viterbi(self, token: str, spaced: bool) -> list[str]:
        """Texts of the cheapest paths; a state (the last two symbols) holds its ``RIVALS`` best."""
        costs = self.costs
        paths: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        units = [m[0] for m in _UNIT.finditer(token)]
        for options in self._options(units, spaced or _spaced(units)):
            ahead: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (p, q), held in paths.items():
                for out, price, boundary in options:
                    a, b, more = p, q, price
                    for symbol in (0,) if boundary else _symbols(out):
                        more += costs[a][b][symbol]
                        a, b = b, symbol
                    ahead.setdefault((a, b), []).extend((cost + more, text + out) for cost, text in held)
            paths = {state: sorted(held)[:RIVALS] for state, held in ahead.items()}
        ends = sorted((cost + costs[a][b][0], text) for (a, b), held in paths.items() for cost, text in held)
        return list(dict.fromkeys(text for cost, text in ends if cost <= ends[0][0] + MARGIN))[:RIVALS]

    def texts(self, raw: np.ndarray, offs: np.ndarray, rivals: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased texts with their disguised tokens restored, as bytes and offsets.

        With ``rivals``, a token is followed by the rivals of its best reading, for scoring.
        """
        pieces, at, grown = [], 0, []
        data = raw.tobytes()
        for a, b in suspects(raw, offs):
            if a < at:
                continue
            before = data[a:b].decode()
            after = self.rivals(before) if rivals else self.token(before)
            if rivals and after != before:  # a word of its own beside digits and scripts without spaces
                after = " " * (a > 0 and (data[a - 1] > 127 or 48 <= data[a - 1] < 58)) + after + " " * (b < len(data) and (data[b] > 127 or 48 <= data[b] < 58))
            if after != before:
                put = after.encode()
                pieces += [data[at:a], put]
                grown.append((a, len(put) - (b - a)))
                at = b
        if not grown:
            return raw, offs
        pieces.append(data[at:])
        place, change = np.array([x for x, _ in grown]), np.cumsum([0, *(x for _, x in grown)])
        return np.frombuffer(b"".join(pieces), np.uint8), offs + change[np.searchsorted(place, offs)]

    def restore(self, text: str) -> str:
        """One text, lower-cased and restored."""
        raw = tk.LOWER[np.frombuffer(text.encode(), np.uint8)]
        return self.texts(raw, np.array([0, len(raw)]))[0].tobytes().decode()


def _spaced(units: list[str]) -> bool:
    """Whether single letters are spaced out."""
    return len(units) >= 2 * SPACED - 1 and all(u[0] in _NOTHING for u in units[1::2])


def _symbols(text: str) -> list[int]:
    return [_symbol(c) for c in text]


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27
