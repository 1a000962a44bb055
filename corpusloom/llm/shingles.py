"""Word shingles of texts, their hashes, and labels of connected rows of a task."""

from __future__ import annotations

import numpy as np

SEED = 42


def _shingles(text: str | None, n: int) -> list[bytes]:
    """The runs of n words of the lower-cased (A-Z) text, repeats included; fewer words give one run, none give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = max(1, len(words) - n + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:k].tolist()
    return [whole[s:e] for s, e in zip(starts, ends[-k:].tolist(), strict=True)]


def _hashes(shingles: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], dtype=np.uint64)


def _least_labels(n: int, pairs) -> np.ndarray:
    """The least index of each index's component, over arrays of pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != label[label]).any():
                label = label[label]
    return label
