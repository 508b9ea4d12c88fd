"""Keys for an exact similarity join of token sets: two close sets share at least one key.

High thresholds use *segments*. Tokens are dealt to m segments by hash. Close sets of sizes up to h differ in
at most D = 2h (1 - t) / (1 + t) tokens, so with m = D + SHARED segments at least SHARED segments are equal in both.
A segment of a typical text holds about six tokens, which is far more telling than any single token, and needs
no global token order. Segments that tell little (empty, or of few and frequent tokens) would be shared by many
unrelated texts; they are *weak* and used in pairs: of two equal segments either one is not weak, or both
together form a weak pair. Since m depends on the size, sizes are cut into classes of ratio t, and a set uses the keys of its own class and those
of the next, where its larger partners are.

Keys that turn out to be shared by too many sets are *hot* and can be refined: on level 2 by pairs of segments that are weak or hot, on level k by
k segments of which all parts of k - 1 are hot. Close sets that share no cold key share at least SHARED segments, all of them weak or hot; if no pair of
these is cold they share a triple all of whose pairs are hot, and so on up to level SHARED. So refining loses no close pair.

Pairs of weak segments grow with the square of the set. Classes of sets above `LARGE_SET` tokens have a quarter more segments instead, so that close sets
have SHARED and D / 4 of them in common. A set with fewer weak segments than that has a strong one in common with any close set. Only two sets with more
weak ones each may have none; these have prefix keys (below) beside, which are complete on their own. So the number of keys is linear in the size.
Prefix keys are single tokens, which more and more unrelated sets share as the corpus grows, so few sets should need them.

Low thresholds would need more segments than there are tokens and use the plain *prefix*: close sets share one
of the first n - ceil(t n) + 1 tokens in a global order, here rare first.

Whether two keys are equal depends on nothing but the tokens concerned and the frequencies. Hash collisions
can add candidates, never lose one; candidates are verified on the tokens themselves.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A mark holds the logarithm of a token's frequency, in 1/1024 bits, above bits of its hash.
HASH_BITS = 40
# From this threshold (percent) segments hold enough tokens to be used.
SEGMENT_PERCENT = 70
# Segments that close sets have in common at least: the deepest level of refined keys.
SHARED = 4
# A segment is weak when chance alone would give it to more sets than this, unless it has this many tokens:
# in a block of near copies every token is frequent, and segments must not all be weak there.
WEAK_SETS, STRONG_TOKENS = 16, 4
# Classes of sets with more tokens have more segments, by this part of the tokens that may differ, and no pairs of weak ones.
LARGE_SET, SPARE_PART = 512, 4

_SPREAD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 divided by the golden ratio, odd


class Frequencies:
    """In how many sets a token is, by its hash: exact for frequent tokens, for others the rest of what their bucket counts.

    `buckets` counts all tokens by hash modulo its length, `heavy` (sorted hashes) and `counts` are the frequent ones.
    """

    def __init__(self, buckets: np.ndarray, heavy: np.ndarray, counts: np.ndarray):
        self.rest = buckets.astype(np.int64)
        np.subtract.at(self.rest, heavy % len(buckets), counts)
        self.heavy, self.counts = heavy, counts

    @classmethod
    def from_arrays(cls, rest: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> Frequencies:
        """The same from its three arrays."""
        found = cls.__new__(cls)
        found.rest, found.heavy, found.counts = rest, heavy, counts
        return found

    def of(self, hashes: np.ndarray) -> np.ndarray:
        found = self.rest[hashes % len(self.rest)]
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
            found = np.where(self.heavy[at] == hashes, self.counts[at], found)
        return np.maximum(found, 1)


def marks_of(hashes: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(frequencies) * 1024).astype(np.int64) << HASH_BITS | hashes & ((1 << HASH_BITS) - 1)


def set_keys(
    hashes: Column, percent: int, total: int, frequencies: Callable[[], Frequencies], hot: Column | None = None, level: int = 1
) -> Column:
    """The keys (array of bigint) of a set given the 64-bit hashes of its tokens.

    `total` is the number of sets, by which frequencies become probabilities; `frequencies` gives them inside a task. From level 2 on, `hot` has the set's keys
    of all levels before that too many sets share: only what these and weak segments make on this level is a key. Runs on Arrow batches.
    """

    def keys(batch: pd.Series) -> pd.Series:
        of = _segment_keys if percent >= SEGMENT_PERCENT else _prefix_keys
        bounds, known = class_bounds(percent, int(batch.map(len).max())), frequencies()
        return batch.map(lambda h: of(marks_of(h, known.of(h)), percent, total, bounds))

    def refined(batch: pd.Series, hot_batch: pd.Series) -> pd.Series:
        bounds, known = class_bounds(percent, int(batch.map(len).max())), frequencies()
        return pd.Series([_segment_keys(marks_of(h, known.of(h)), percent, total, bounds, k, level) for h, k in zip(batch, hot_batch)])

    kind = T.ArrayType(T.LongType())
    return F.pandas_udf(keys, kind)(hashes) if hot is None else F.pandas_udf(refined, kind)(hashes, hot)


def class_bounds(percent: int, largest: int) -> list[int]:
    """Smallest size of each class, up to two classes beyond `largest`."""
    bounds, beyond = [1], 0
    while beyond < 2:
        bounds.append(bounds[-1] * 100 // percent + 1)
        beyond += bounds[-1] > largest
    return bounds


def _segment_keys(
    marks: np.ndarray, percent: int, total: int, bounds: list[int], hot: np.ndarray | None = None, level: int = 2
) -> np.ndarray:
    size = len(marks)
    own = bisect_right(bounds, size) - 1
    classes = [own, own + 1] if size * 100 >= bounds[own + 1] * percent else [own]
    hashes = (marks & ((1 << HASH_BITS) - 1)).astype(np.uint64)
    mixed = _mix(hashes)
    # Information in 1/1024 bits, in integers so that sums do not depend on the order.
    surprise = np.maximum(int(np.log2(max(total, 1)) * 1024) - (marks >> HASH_BITS), 0)
    enough = int(np.log2(max(total / WEAK_SETS, 1.0)) * 1024)
    surprise = np.maximum(surprise, -(-enough // STRONG_TOKENS))
    found = []
    for number in classes:
        most_different = 2 * (bounds[number + 1] - 1) * (100 - percent) // (100 + percent)
        large = bounds[number + 1] - 1 > LARGE_SET
        shared = SHARED + (most_different // SPARE_PART if large else 0)
        segments = most_different + shared
        segment = (hashes % np.uint64(segments)).astype(np.int64)
        content, told = np.zeros(segments, np.uint64), np.zeros(segments, np.int64)
        np.bitwise_xor.at(content, segment, mixed)
        np.add.at(told, segment, surprise)
        place = np.arange(segments, dtype=np.uint64) + np.uint64(number << 32)
        key = _mix(content + _mix(place))
        strong = told >= enough
        if hot is None:
            found.append(key[strong])
        if large:
            many = [] if hot is None else [key[strong]]
            if np.count_nonzero(~strong) >= shared:
                many.append(_mix(_prefix_keys(marks, percent, total, bounds).view(np.uint64) + _mix(place[:1])))
            # Cold ones have been compared before; the hot ones go on in rounds.
            found += many if hot is None else [keys[np.isin(keys.view(np.int64), hot)] for keys in many]
        elif hot is None:
            weak = key[~strong]
            first, second = np.triu_indices(len(weak), 1)
            found.append(_mix(weak[first] + _mix(weak[second])))
        else:
            found.append(_joined(key[~strong | np.isin(key.view(np.int64), hot)], ~strong, key, hot, level))
    return np.unique(np.concatenate(found)).view(np.int64)


def _joined(open_keys: np.ndarray, weak: np.ndarray, key: np.ndarray, hot: np.ndarray, level: int) -> np.ndarray:
    """Keys of `level` segments among those that are weak or hot, all of whose parts of fewer segments are weak or hot."""
    steps, faint = _mix(open_keys), set(np.flatnonzero(np.isin(open_keys, key[weak])).tolist())
    # Groups of places in `open_keys`, ascending; a group's key follows from that of the group without its last place.
    groups, values = [(k,) for k in range(len(open_keys))], open_keys
    for size in range(2, level + 1):
        known = set(groups)
        grown = [(at, k) for at, group in enumerate(groups) for k in range(group[-1] + 1, len(open_keys))
                 if size == 2 or all(part in known for part in combinations((*group, k), size - 1))]
        if not grown:
            return np.zeros(0, np.uint64)
        before, last = np.array(grown).T
        values = _mix(values[before] + steps[last])
        groups = [(*groups[at], k) for at, k in grown]
        held = np.isin(values.view(np.int64), hot)
        if size == level:  # pairs of weak segments were keys on the first level: of these only hot ones are open
            return values[held | np.array([size > 2 or not faint.issuperset(group) for group in groups])]
        # Cold ones have been compared, and so have all that hold them.
        groups, values = [group for group, h in zip(groups, held) if h], values[held]
    return values


def _prefix_keys(marks: np.ndarray, percent: int, total: int, bounds: list[int]) -> np.ndarray:
    size = len(marks)
    required = (size * percent + 99) // 100
    return np.unique(np.sort(marks)[: size - required + 1])


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _SPREAD
    return values ^ (values >> np.uint64(32))
