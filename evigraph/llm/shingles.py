"""Word shingles of whole texts as sorted 64-bit hashes (numpy), shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a shingle; derived from the golden ratio by a fixed rule.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: each input bit reaches all output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``, with A-Z in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words than k make one shingle; no words, none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - k + 1
    total = h[:n] * PLACES[0]
    for j in range(1, k):
        total += mix(h[j : n + j]) * PLACES[j]
    return np.unique(mix(total))


def one_permutation(sorted_set: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the top bits deal each hash to one of ``bins`` (a power of two), the smallest stays.

    Empty bins are filled by optimal densification: bin ``i`` tries the bins ``probes[:, i]`` in turn, the same
    for every set, and takes the first that is not empty. ``sorted_set`` must not be empty.
    """
    shift = np.uint64(64 - bins.bit_length() + 1)
    starts = np.arange(bins, dtype=np.uint64) << shift
    at = np.minimum(np.searchsorted(sorted_set, starts), len(sorted_set) - 1)
    values = sorted_set[at]
    full = (values >> shift) == np.arange(bins, dtype=np.uint64)
    if not full.all():
        source = np.arange(bins)
        empty = np.flatnonzero(~full)
        for probe in probes:
            source[empty] = probe[empty]
            empty = empty[~full[source[empty]]]
            if not len(empty):
                break
        source[empty] = np.flatnonzero(full)[0]
        values = values[source]
    return values


def probe_table(bins: int, tries: int = 4096, seed: int = 7) -> np.ndarray:
    """``tries`` x ``bins`` places that empty bins look at; equal on every machine."""
    place = np.arange(bins, dtype=np.uint64) + np.uint64(bins) * np.arange(tries, dtype=np.uint64)[:, None]
    return (mix(place + np.uint64(seed << 40)) % np.uint64(bins)).astype(np.int64)
