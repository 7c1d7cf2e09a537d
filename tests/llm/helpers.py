"""Plain versions of what the operators compute, for comparison."""

from __future__ import annotations

import numpy as np
import xxhash


def simhash(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(ids: list[int], fps: list[int], radius: int) -> dict[int, int]:
    values = np.array(fps, np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = find(x), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
