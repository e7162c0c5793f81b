"""Signatures of shingle sets against their definition, part by part."""

from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pytest

from failtriage.llm import ngrams
from failtriage.llm.common import mix

M = (1 << 64) - 1


def by_definition(elements, band, uppers, threshold):
    """Sum of the mixed elements of each part that is not empty, of the first dealing."""
    k = int((1 - threshold) / (1 + threshold) * 2 * uppers[band])
    n = k + 2 + k // 4 if k else 1
    salt = band * 1_000_003 * 0x9E3779B97F4A7C15 & M
    sums = {}
    for x in mix(elements ^ np.uint64(salt)).tolist():
        part = (x >> 32) * n >> 32
        sums[part] = sums.get(part, 0) + x & M
    sums = [(s + part * 0xD6E8FEB86659FD93 + salt) & M for part, s in sorted(sums.items())]
    return (mix(np.array(sums, np.uint64)) & ~np.uint64(1) | np.uint64(band & 1)).view(np.int64).tolist()


@pytest.mark.parametrize("size", [1, 2, 5, 9, 40, 700, 20_000])
def test_signatures_are_the_sums_of_the_parts(size):
    elements = np.random.default_rng(size).integers(0, 1 << 64, size, dtype=np.uint64)
    elements = ngrams._distinct(np.concatenate([elements, elements[::-1]]))
    assert elements.tolist() == sorted(set(elements.tolist())) and len(elements) == size
    uppers = ngrams.bands(Fraction(4, 5))
    band = bisect_left(uppers, size)
    found = ngrams.signatures(elements, uppers, Fraction(4, 5))
    for instance in (band, band + 1):
        first = next(own for own, b, _ in found if b == instance)
        assert first.tolist() == by_definition(elements, instance, uppers, Fraction(4, 5))


def test_no_hashes_have_no_distinct_ones():
    assert len(ngrams._distinct(np.empty(0, np.uint64))) == 0
