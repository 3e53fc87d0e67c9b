"""Plain loops that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def removed(texts: list[str | None], length: int) -> list[bytearray]:
    """1 for every byte covered by a string of ``length`` bytes that starts at two places or more."""
    data = [(text or "").encode() for text in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    marks = []
    for d in data:
        mark, end = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                first = max(i, end)
                mark[first : i + length] = b"\1" * (i + length - first)
                end = i + length
        marks.append(mark)
    return marks


def spans(mark: bytearray) -> list[tuple[int, int]]:
    edges = [k for k in range(len(mark) + 1) if (mark[k] if k < len(mark) else 0) != (mark[k - 1] if k else 0)]
    return list(zip(edges[::2], edges[1::2], strict=True))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    found = WORD.findall((text or "").translate(_LOWER))
    grams = [" ".join(found[k : k + shingle]) for k in range(max(1, len(found) - shingle + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: list[int], budget: int = 4) -> list[int]:
    """For each fingerprint, the first place reachable over links."""
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    held = np.array(prints, np.uint64)
    for i in range(len(held)):
        for j in np.flatnonzero(np.bitwise_count(held[i] ^ held[i + 1 :]) <= budget) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def quality_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    repeated = {k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(repeated)


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    ones, zeros = scores[labels == 1], scores[labels == 0]
    return float(np.mean([(ones > z).mean() + 0.5 * (ones == z).mean() for z in zeros]))
