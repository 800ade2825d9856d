"""SimHash fingerprints and their Hamming index, in Column functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(shift: int, mask: Column, hashes: Column, weights: Column | None) -> Column:
    """The sums of the masked lanes of the shifted hashes."""

    def lane(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift).bitwiseAND(mask)

    if weights is None:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + lane(h))
    return F.aggregate(F.zip_with(hashes, weights, lambda h, w: lane(h) * w), F.lit(0).cast("long"), lambda a, x: a + x)


def _lanes(width: int, hashes: Column, weights: Column | None, total: Column) -> Column:
    """The 64 majority bits, by counters of width bits side by side in longs; total (of weights) must be under 2 ** (width - 1)."""
    # A lane (with the bias) reaches its top bit exactly if its count is more than half of total. The last lane is
    # taken by itself: its top bit is the sign.
    starts = range(0, 64 - width, width)
    one, high = sum(1 << at for at in starts), sum(1 << (at + width - 1) for at in starts)
    bias = F.lit((1 << (width - 1)) - 1).cast("long") - F.shiftright(total.cast("long"), 1)
    spread = bias * F.lit(one)
    out = F.lit(0).cast("long")
    for i in range(width):
        count = _count(i, F.lit(one + (1 << (64 - width))), hashes, weights)
        low = (count.bitwiseAND(F.lit((1 << (64 - width)) - 1)) + spread).bitwiseAND(F.lit(high))
        last = F.shiftrightunsigned(F.shiftrightunsigned(count, 64 - width) + bias, width - 1)
        out = out.bitwiseOR(F.shiftrightunsigned(low, width - 1 - i)).bitwiseOR(F.shiftleft(last, 64 - width + i))
    return out


def simhash(hashes: Column, weights: Column | None = None, total: Column | None = None) -> Column:
    """64 bits: bit b is set if more than half of the weight lies on hashes with bit b set. total: sum of the weights."""
    if weights is None:
        n = F.size(hashes)
        return F.when(n < 128, _lanes(8, hashes, None, n)).when(n < 1 << 15, _lanes(16, hashes, None, n)).otherwise(_lanes(32, hashes, None, n))
    return F.when(total < 1 << 15, _lanes(16, hashes, weights, total)).otherwise(_lanes(32, hashes, weights, total))


def block_keys(fingerprint: Column, radius: int, agree: int = 1) -> Column:
    """Keys of which two fingerprints within radius share at least one: of radius + agree blocks, any agree blocks together (pigeonhole)."""
    n = radius + agree
    edges = [round(64 * i / n) for i in range(n + 1)]
    keys = []
    for which, chosen in enumerate(combinations(range(n), agree)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(which).alias("blocks"), fingerprint.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def hamming(a: str, b: str) -> Column:
    return F.expr(f"bit_count({a} ^ {b})")
