"""The noisy channel of problem 2: which characters a scanner takes for which, and how likely words are.

Every confusion keeps the *strokes* of a word (m is three strokes, rn is one and two), so all readings of a
word have equal strokes. Words are therefore judged in buckets of equal strokes, which Spark shuffles; no
task needs more of the vocabulary than its buckets. :class:`Model` is the same on tables that one task holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

LEAST = 3
# A word is taken for noise if one confusion leads to a word this many times as frequent, or two confusions to one TWICE times.
ONCE, TWICE = 40, 400
# The same for a word with digits among its letters, and for a number with letters in it.
ONCE_DIGITS, TWICE_DIGITS, NUMBER = 5, 20, 8
# What is printed and what the scanner reads instead.
CONFUSIONS = [
    tuple(pair.split(">"))
    for pair in (
        "e>c c>e i>l l>i i>1 l>1 t>f f>t s>5 a>o o>a o>0 g>9 h>b b>h b>6 b>8 t>7 z>2 g>6 g>q q>g 1>l 0>o 1>i "
        "d>cl cl>d u>ii ii>u ü>ii m>rn rn>m w>vv vv>w in>m m>in li>h h>li nn>rm fi>ﬁ fl>ﬂ ff>ﬀ ffi>ﬃ "
        "é>ê é>è è>é ê>é é>e è>e ê>e á>a à>a â>a ä>a í>i î>i ó>o ô>o ö>o ú>u ü>u ñ>n ç>c ß>b"
    ).split()
]
# The strokes that the confusions above keep.
STROKES = str.maketrans(
    {c: strokes for group, strokes in (("ecéèêëç", "c"), ("ao0áàâäóòôö", "o"), ("il1íìîïr", "i"), ("ft7", "t"), ("s5", "s"), ("z2", "z"), ("hbß68gq9unúùûüñ", "ii"), ("m", "iii"), ("d", "ci"), ("w", "vv"), ("ﬁﬂ", "ti"), ("ﬀ", "tt"), ("ﬃ", "tti")) for c in group}
)
# Letters read in place of digits.
DIGITS = str.maketrans("lIiOoSB", "1110058")
NUMBER_LIKE = re.compile(r"[0-9lIiOoSB]+")
WORD = re.compile(r"[^\W_]+")
FOLD_MANY = (("rm", "nn"), ("rn", "m"), ("in", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"))


def _fold_table() -> dict[int, str]:
    classes = {"a": "0oàáâäöóôò", "i": "1l|ïîíì", "s": "5", "e": "cèéêëç", "g": "9q", "b": "68h", "t": "7f", "u": "üúùû", "n": "ñ"}
    return {ord(c): k for k, group in classes.items() for c in group}


FOLD = _fold_table()


BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _op in CONFUSIONS:
    BY_FIRST.setdefault(_op[1][0], []).append(_op)
AT = {op: i for i, op in enumerate(CONFUSIONS)}


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    """One form for all readings of a word that the confusions lead to (coarse)."""
    for seen, kept in FOLD_MANY:
        word = word.replace(seen, kept)
    return word.translate(FOLD)


@lru_cache(maxsize=100_000)
def _part(word: str) -> str:
    digits = sum(c.isdigit() for c in word)
    return "#" if digits and digits * 2 >= len(word) else fold(word)


def shape(line: str) -> str:
    """One form for a line of page matter: numbers as #, words folded, signs as blanks."""
    return " ".join(map(_part, WORD.findall(line.lower())))


class _Tokens(dict):
    """The token of each word, kept."""

    def __missing__(self, word: str) -> str:
        token = "#" if word.isdigit() else word if numeric(word) else word.lower()
        if len(self) < 500_000:
            self[word] = token
        return token


token = _Tokens().__getitem__


def tokens(line: str) -> list[str]:
    """Lower-case words, plain numbers as #; numbers with letters in them keep their case, which tells B from 8."""
    return list(map(token, WORD.findall(line)))


def numeric(word: str) -> bool:
    """A number in which at most half of the digits may have been read as letters."""
    return NUMBER_LIKE.fullmatch(word) is not None and 2 * sum("0" <= c <= "9" for c in word) >= len(word)


def strokes(word: str) -> str:
    """The key that every reading of the word shares; numbers with letters share that of the number."""
    return "#" + word.translate(DIGITS) if numeric(word) else word.translate(STROKES)


def reversals(word: str, start: int = 0) -> list[tuple[str, int, tuple[str, str]]]:
    """(word before one confusion, its place, the confusion) for every confusion that may have led here."""
    out = []
    for at in range(start, len(word)):
        for op in BY_FIRST.get(word[at], ()):
            if word.startswith(op[1], at):
                out.append((word[:at] + op[0] + word[at + len(op[1]) :], at, op))
    return out


class Entry(NamedTuple):
    """What the corpus knows of a word: its count (0 if it is no word of its own), whether another word may have
    become it, the words it may be a reading of, their counts and the confusions that lead from each."""

    n: int
    doubtful: bool
    readings: list[str]
    counts: list[int]
    ways: list[str]  # per reading, its ways: confusions as "3" or "3+17", parted by blanks


def bucket(words: dict[str, int], numbers: dict[str, int]) -> tuple[dict[str, Entry], Counter, Counter]:
    """The entries of all words of one bucket of equal strokes, how often each confusion explains a noise word,
    and how often what it starts from is printed. ``numbers`` has the counts of plain numbers."""
    counted = {w: n for w, n in words.items() if n >= LEAST}
    hits, shown = Counter(), Counter()
    noise = set()
    for w, n in counted.items():
        if numeric(w):
            if numbers.get(w.translate(DIGITS), 0) >= NUMBER * n:
                noise.add(w)
            continue
        if len(counted) == 1:
            continue
        once, twice = (ONCE_DIGITS, TWICE_DIGITS) if any("0" <= c <= "9" for c in w) else (ONCE, TWICE)
        before = reversals(w)
        best = max(((counted.get(v, 0), v, op) for v, _, op in before), default=(0, "", None))
        if best[0] >= once * n:
            noise.add(w)
            hits[AT[best[2]]] += n
        elif len(w) >= 4 and any(counted.get(u, 0) >= twice * n for v, at, _ in before for u, _, _ in reversals(v, at)):
            noise.add(w)
    sure = {w: n for w, n in counted.items() if w not in noise}
    for w, n in sure.items():
        for i, (true, _) in enumerate(CONFUSIONS):
            if true in w:
                shown[i] += n * w.count(true)
    out = {}
    for w in words:
        own = sure.get(w, 0)
        found: dict[str, list[str]] = {}
        if numeric(w):
            found = {} if own else {"#": [""]}
        elif sure and (len(sure) > 1 or w not in sure):
            for v, _, op in reversals(w):
                if v != w and v in sure and (own or sure[v] >= 5):
                    found.setdefault(v, []).append(str(AT[op]))
            if not found and not own and (len(w) >= 7 or (len(w) >= 4 and any(c.isdigit() for c in w))):
                for v, at, op in reversals(w):
                    for u, _, other in reversals(v, at):
                        if u != w and sure.get(u, 0) >= 20:
                            found.setdefault(u, []).append(f"{AT[op]}+{AT[other]}")
        doubtful = bool(own) and bool(found)
        out[w] = Entry(own, doubtful, list(found), [sure.get(v, 0) for v in found], [" ".join(sorted(set(x))) for x in found.values()])
    return out, hits, shown


def doubt(entry: Entry) -> float:
    """Log probability of a word being one of its own: an unknown word beside a known one that a confusion explains hardly is."""
    return 0.0 if entry.n or not entry.readings else -12.0 if any("+" in way for way in entry.ways) else -8.0


def rates(hits: dict[int, int], shown: dict[int, int]) -> list[float]:
    """The log rate of each confusion."""
    return [math.log((hits.get(i, 0) + 0.2) / (shown.get(i, 0) + 2000)) for i in range(len(CONFUSIONS))]


def scores(entry: Entry, rate: list[float]) -> list[float]:
    """The log probability of each reading's likeliest way; a number is read wrongly by e to the power of -6."""
    return [max(sum(rate[int(i)] for i in way.split("+")) for way in ways.split(" ")) if ways else -6.0 for ways in entry.ways]


class Reader:
    """Decodes runs of words in a corpus of ``total`` words.

    ``entries`` maps a word to (count, doubtful, readings, counts, scores, doubt), ``pairs`` a pair to its count.
    """

    def __init__(self, total: int):
        self.total = max(total, 1)

    def candidates(self, word: str, entry: tuple | None) -> list[tuple[str, float, int]]:
        """(reading, log probability of ``word`` being what is seen of it, count), the word itself first."""
        if entry is None:
            return [(word, 0.0, 0)]
        n, _, readings, counts, score, doubt = entry
        return [(word, doubt, n), *sorted(zip(readings, score, counts, strict=True), key=lambda x: (-x[1], x[0]))]

    def pair(self, n_before: int, n_word: int, n_pair: int) -> float:
        """Log probability of a word after another."""
        n = n_pair if n_before and n_word else 0
        return math.log((n + 10.0 * (n_word + 0.3) / self.total) / (n_before + 10.0))

    def alone(self, word: str, entry: tuple | None) -> str:
        """The likeliest reading of a word by itself."""
        return max(self.candidates(word, entry), key=lambda c: c[1] + math.log((c[2] + 0.3) / self.total))[0]

    def decode(self, before: tuple[str, int], run: list[str], after: tuple[str, int], entries: dict[str, tuple], pairs: dict[tuple[str, str], int]) -> list[str]:
        """The likeliest words of a run between two certain neighbours (Viterbi over every reading of each word).

        A doubtful word that the corpus has after and before its neighbours as printed stays.
        """
        ring = [before[0], *run, after[0]]
        choices = []
        for i, w in enumerate(run, 1):
            entry = entries.get(w)
            certain = entry is not None and entry[1] and pairs.get((ring[i - 1], w), 0) >= LEAST and pairs.get((w, ring[i + 1]), 0) >= LEAST
            choices.append([(w, 0.0, entry[0])] if certain else self.candidates(w, entry))
        if all(len(c) == 1 for c in choices):
            return list(run)
        paths = [(0.0, [before])]
        for options in [*choices, [(after[0], 0.0, after[1])] if after[0] else []]:
            if not options:
                break
            paths = [
                max(((t + self.pair(way[-1][1], n, pairs.get((way[-1][0], v), 0)) + s, [*way, (v, n)]) for t, way in paths), key=lambda x: x[0])
                for v, s, n in options
            ]
        best = max(paths, key=lambda x: x[0])[1]
        return [v for v, _ in best[1 : len(run) + 1]]


class Model:
    """The channel on tables that one task holds: for small corpora and tests."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], compounds: dict[tuple[str, str], int], total: int, numbers: dict[str, int] | None = None):
        self.pairs, self.compounds, self.reader = pairs, compounds, Reader(total)
        groups: dict[str, dict[str, int]] = {}
        for w, n in words.items():
            groups.setdefault(strokes(w), {})[w] = n
        self.groups, self.numbers, self.entries = groups, numbers or {}, {}
        hits, shown = Counter(), Counter()
        found: dict[str, Entry] = {}
        for group in groups.values():
            entries, h, s = bucket(group, self.numbers)
            found |= entries
            hits += h
            shown += s
        self.rate = rates(hits, shown)
        self.entries = {w: self._scored(e) for w, e in found.items()}

    def _scored(self, e: Entry) -> tuple:
        counts = [self.groups.get("#", {}).get("#", 0) if v == "#" else n for v, n in zip(e.readings, e.counts, strict=True)]
        return e.n, e.doubtful, e.readings, counts, scores(e, self.rate), doubt(e)

    def entry(self, word: str) -> tuple:
        """The entry of a word, be it in the corpus or not."""
        if word not in self.entries:
            self.entries[word] = self._scored(bucket({**self.groups.get(strokes(word), {}), word: 0}, self.numbers)[0][word])
        return self.entries[word]

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(reading, log probability), the word itself first."""
        return [(v, s) for v, s, _ in self.reader.candidates(word, self.entry(word))]

    def decode(self, line: list[str]) -> list[str]:
        """The likeliest words of a line."""
        return self.reader.decode(("", 0), line, ("", 0), {w: self.entry(w) for w in line}, self.pairs)
