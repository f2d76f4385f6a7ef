"""Small edit distances: deletion neighbourhoods and the restricted Damerau-Levenshtein distance."""

from __future__ import annotations

from itertools import combinations


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and every form of it with up to ``most`` characters left out."""
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for gone in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


def distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, old = before, [i], row
        before = old
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)
