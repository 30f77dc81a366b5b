"""Titles that are nearly equal: all pairs of lengths that are near enough, cut down by bounds that leave out none, then compared as sequences.

Titles are dealt to classes of length, STEPS of which make up the ratio of lengths that titles can have which are similar enough. A group
is a class and the next STEPS; large ones are parted. Within a group all pairs are looked at, so the work grows with the square of the titles.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.durable import broadcast_if_small, cut

#: Columns of counts (the last takes all characters but the most frequent ones); titles compared at a time, of those that are near the first
#: ones, and titles made into bits at a time.
COLUMNS, STEP, FIRST, ROWS = 256, 4096, 64, 512
#: From this length of the earlier title on, SequenceMatcher starts no match at a character that makes up over a hundredth of it.
LONG = 200
#: Classes of length; titles of a class and of its partners in one task, in units of a title and 512 characters; comparisons in one task. What
#: is left over is dealt anew without that limit, in tasks of so many pairs.
STEPS, OWN, ALL, MANY, PAIRS = 4, 4096, 16384, 16384, 1 << 20
#: A title's similar ones that are looked for at once, from each group.
MOST = 4
_POINTS = 0x110000
_MIX, _SPIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Titles:
    """Titles as counts of their characters and as bits of their stretches.

    Two sides that are compared have the same names of characters, stretches, width of bits and ranking.
    """

    def __init__(self, texts: list[str], names: np.ndarray, stretches: tuple[int, ...], width: int, ranked: bool) -> None:
        self.texts, self.starts, self.masks = texts, {}, {}
        self.n = np.array(list(map(len, texts)), np.int64)
        kind = np.int16 if self.n.max(initial=0) < 1 << 15 else np.int32
        self.counts = np.zeros((len(texts), COLUMNS), kind)
        self.bits = {q: np.zeros((len(texts), width // 64), np.uint64) for q in stretches}
        step = max(1, min(ROWS, (1 << 24) // width))
        for at in range(0, len(texts), step):
            some = slice(at, at + step)
            points, rows = _points(texts[some]), len(texts[some])
            owner = np.repeat(np.arange(rows), self.n[some])
            self.counts[some] = np.bincount(owner * COLUMNS + names[points], minlength=rows * COLUMNS).reshape(rows, COLUMNS)
            for q in stretches:
                self.bits[q][some] = _bits(points.astype(np.uint64), owner, rows, q, width, ranked)
        self.folded = np.ascontiguousarray(np.bitwise_or.reduce(self.bits[stretches[0]].reshape(len(texts), 4, width // 256), axis=1).T)  # a column a title
        self.by_column = np.ascontiguousarray(self.counts.T)
        often = self.counts > (self.n // 100 + 1)[:, None]
        often[:, -1] = False  # the last column's are many characters: none is left out, so that a bound stays one
        self.rare = np.where(often, 0, self.counts).astype(kind)
        self.n_rare = self.rare.sum(1, dtype=np.int64)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _bits(points: np.ndarray, owner: np.ndarray, rows: int, q: int, width: int, ranked: bool) -> np.ndarray:
    """A row of `width` bits for each title: those of the hashes of its stretches of q characters. If ranked, the first, second, ... of
    equal stretches have bits of their own."""
    n = max(0, len(points) - q + 1)
    whole = owner[:n] == owner[q - 1 :]
    low = np.zeros(n, np.uint64)
    for k in range(q):
        low = low * _SPIN + points[k : k + n]
    low, at = (low[whole] * _MIX) >> np.uint64(24), owner[:n][whole]
    if ranked:
        key = np.sort((at.astype(np.uint64) << np.uint64(40)) | low)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        low, at = (key & np.uint64((1 << 40) - 1)) + rank.astype(np.uint64) * _SPIN, (key >> np.uint64(40)).astype(np.int64)
    flags = np.zeros((rows, width), bool)
    flags[at, ((low * _MIX) >> np.uint64(32)).astype(np.int64) & (width - 1)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def places_of(text: str) -> dict[str, list[int]]:
    """Where each character of a title stands."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(text):
        places.setdefault(c, []).append(j)
    return places


def starts_of(text: str) -> dict[str, list[int]]:
    """Where matches with a title that is the earlier one may start."""
    places = places_of(text)
    return places if len(text) < LONG else {c: at for c, at in places.items() if len(at) <= len(text) // 100 + 1}


def masks_of(starts: dict[str, list[int]]) -> dict[str, int]:
    """The places of each character as the bits of a number."""
    masks = {}
    for c, at in starts.items():
        flags = np.zeros(at[-1] + 1, bool)
        flags[at] = True
        masks[c] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return masks


def common_length(a: str, masks: dict[str, int], n: int) -> int:
    """The length of the longest common subsequence with a title of n characters, whose places `masks` are: bits of a row of the usual table,
    that fall where its value rises."""
    row = every = (1 << n) - 1
    for c in a:
        if mask := masks.get(c):
            rise = row & mask
            row = ((row + rise) | (row - rise)) & every
    return n - row.bit_count()


def _ahead(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters are equal from i and j on."""
    k = 0
    while k + 32 <= most and a[i + k : i + k + 32] == b[j + k : j + k + 32]:
        k += 32
    while k < most and a[i + k] == b[j + k]:
        k += 1
    return k


def _behind(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters are equal before i and j."""
    k = 0
    while k + 32 <= most and a[i - k - 32 : i - k] == b[j - k - 32 : j - k]:
        k += 32
    while k < most and a[i - k - 1] == b[j - k - 1]:
        k += 1
    return k


def alike(a: str, b: str, ratio: float, places: dict[str, list[int]], starts: dict[str, list[int]]) -> bool:
    """SequenceMatcher(None, a, b).ratio() > ratio, by the same blocks, with places_of(a) and starts_of(b).

    Only the places of a where a match may start are visited, and what is left to match is given up once it can't suffice.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0 > ratio
    seeds = sorted(i for c in starts if c in places for i in places[c])
    matched, possible, ranges = 0, min(len(a), len(b)), [(0, len(a), 0, len(b), 0, len(seeds))]
    while ranges and 2.0 * matched / total <= ratio < 2.0 * (matched + possible) / total:
        i0, i1, j0, j1, s0, s1 = ranges.pop()
        possible -= min(i1 - i0, j1 - j0)
        i, j, k, last, runs = i0, j0, 0, -2, {}
        for at in seeds[s0:s1]:
            before = runs if at == last + 1 else {}
            runs, last = {}, at
            for there in starts[a[at]]:
                if j0 <= there < j1:
                    run = runs[there] = before.get(there - 1, 0) + 1 if before else 1
                    if run > k:
                        i, j, k = at - run + 1, there - run + 1, run
        if i > i0 and j > j0:
            more = _behind(a, i, b, j, min(i - i0, j - j0))
            i, j, k = i - more, j - more, k + more
        if i + k < i1 and j + k < j1:
            k += _ahead(a, i + k, b, j + k, min(i1 - i - k, j1 - j - k))
        if k:
            matched += k
            at = bisect_left(seeds, i, s0, s1)  # a range without any holds no match, but for one at the start of both
            if i0 < i and j0 < j and (s0 < at or not i0 + j0):
                possible += min(i - i0, j - j0)
                ranges.append((i0, i, j0, j, s0, at))
            at = bisect_left(seeds, i + k, at, s1)
            if i + k < i1 and j + k < j1 and at < s1:
                possible += min(i1 - i - k, j1 - j - k)
                ranges.append((i + k, i1, j + k, j1, at, s1))
    return 2.0 * matched / total > ratio


def names_of(texts: list[str]) -> np.ndarray:
    """A column of each character: the most frequent ones have their own."""
    often = np.zeros(_POINTS, np.int64)
    for at in range(0, len(texts), ROWS):
        often += np.bincount(_points(texts[at : at + ROWS]), minlength=_POINTS)
    top = np.argsort(-often)[: COLUMNS - 1] if (often > 0).sum() >= COLUMNS else np.flatnonzero(often)
    names = np.full(_POINTS, COLUMNS - 1, np.int64)
    names[top] = np.arange(len(top))
    return names


def alike_before(new: Titles, i: int, old: Titles, upto: int, ratio: float, most: int, left: list[int]) -> tuple[list[int], bool]:
    """Of old's first `upto` titles the first `most` to which new's title i is over `ratio` similar, as SequenceMatcher(None, new, old) has it;
    and whether these are all. left[0]: comparisons that may still be made.

    A ratio over r needs matches of over r / 2 of both lengths, and characters in common are at least as many. Matches lie in blocks with
    something unmatched between them, and each block but one at the start holds a rare character of the earlier title, if that is LONG. So of
    the stretches of q characters all are in common but those of what is unmatched and q - 1 for each block.
    """
    n, counts, found, places = new.n[i], new.counts[i], [], None
    columns = np.flatnonzero(counts)
    mine = counts[columns][:, None]
    for at in range(0, upto, STEP):
        end = min(upto, at + STEP)
        least = np.ceil((n + old.n[at:end]) * (ratio / 2) - 1e-6).astype(np.int64)
        common = np.minimum(old.by_column[columns, at:end], mine).sum(0, dtype=counts.dtype if n < 1 << 15 else np.int64)
        near = np.flatnonzero(common >= least)
        for part in (near[:FIRST], near[FIRST:]):  # of a crowd of copies the first ones will do
            for j in _by_stretches(new, i, old, part + at, least[part]) if len(part) else ():
                if len(found) == most:
                    return found, False
                places = places or places_of(new.texts[i])
                if j not in old.starts:
                    old.starts[j] = starts_of(old.texts[j])
                m = int(old.n[j])
                if not LONG <= m < 10 * LONG:  # where alike() takes long: matches are a common subsequence
                    if j not in old.masks:
                        old.masks[j] = masks_of(old.starts[j] if m < LONG else places_of(old.texts[j]))
                    if 2.0 * common_length(new.texts[i], old.masks[j], m) / (int(n) + m) <= ratio:
                        continue
                if not left[0]:
                    return found, False
                left[0] -= 1
                if alike(new.texts[i], old.texts[j], ratio, places, old.starts[j]):
                    found.append(j)
    return found, True


def _by_stretches(new: Titles, i: int, old: Titles, near: np.ndarray, least: np.ndarray) -> list[int]:
    """Those of old's titles `near` that may have blocks of `least` characters with new's title i."""
    n, m = new.n[i], old.n[near]
    gaps = n + m - 2 * least
    blocks = 1 + np.where(m < LONG, gaps, np.minimum(gaps, old.n_rare[near]))
    q = next(iter(new.bits))
    own = np.bitwise_count(new.folded[:, i, None] & ~old.folded[:, near]).sum(0, dtype=np.int64)
    good = own <= max(0, n - q + 1) - least + (q - 1) * blocks
    near, least, m, gaps = (x[good] for x in (near, least, m, gaps))
    if not len(near):
        return []
    blocks = 1 + np.where(m < LONG, gaps, np.minimum(gaps, np.minimum(old.rare[near], new.counts[i]).sum(1, dtype=np.int64)))
    for q in new.bits:
        mine, other = new.bits[q][i], old.bits[q][near]
        own, others = np.bitwise_count(mine & ~other).sum(1, dtype=np.int64), np.bitwise_count(other & ~mine).sum(1, dtype=np.int64)
        shared = least - (q - 1) * blocks
        good = (own <= max(0, n - q + 1) - shared) & (others <= np.maximum(0, m - q + 1) - shared)
        near, least, m, blocks = (x[good] for x in (near, least, m, blocks))
        if not len(near):
            break
    return near.tolist()


def _earlier(group: pa.Table, ratio: float, limit: int) -> tuple[list[int], list[int]]:
    """Pairs of rows of a group: a title and one of the first similar ones before it, or -1 behind the last if there may be more.

    Titles of the class (x false) are held against partners before them, and partners of longer classes against titles of it.
    """
    rank, text = pc.rank(group["o"], tiebreaker="dense").to_numpy(), group["t"].to_pylist()
    partner, asks, n, left = group["x"].to_numpy(), group["z"].to_numpy(), group["n"].to_numpy(), [limit]
    sides = [np.flatnonzero(~partner), np.flatnonzero(partner)]
    sides = [s[np.argsort(rank[s])] for s in sides]
    if not asks.any() or not min(map(len, sides)):
        return [], []
    names, short = names_of(text), n.min() < LONG
    ranked = short or n.min() > 4 * LONG  # long ones often repeat themselves
    width = max(256, 1 << int(4 * n.max() - 1).bit_length())
    titles = [Titles([text[i] for i in s], names, (3, 2, 5) if short else (5, 9), width, ranked) for s in sides]
    longer = group["f"].to_numpy() > group["g"].to_numpy()
    olds, news = [], []
    for side in (0, 1):
        own, others = sides[side], sides[1 - side]
        before = np.searchsorted(rank[others], rank[own])
        for i in np.flatnonzero(asks[own] & (longer[own] | (side == 0)) & (before > 0)).tolist():
            found, whole = alike_before(titles[side], i, titles[1 - side], int(before[i]), ratio, MOST, left)
            for j in found + [None] * (not whole):
                olds.append(-1 if j is None else int(others[j]))
                news.append(int(own[i]))
    return olds, news


def similar_before(titles: DataFrame, ratio: float, again: bool = False) -> DataFrame:
    """a, b: for each title (block, t, o) that asks (z), of each of its groups the first MOST similar ones of the block before it; a null a, if there may be more."""
    kind, limit = titles.schema["o"].dataType.simpleString(), 1 << 60 if again else MANY
    f = F.floor(F.log("n") * (STEPS / math.log((2 - ratio) / ratio))).cast("int")
    titles = titles.withColumn("n", F.length("t").cast("long")).where("n > 0").withColumn("f", f)
    groups = F.explode(F.sequence(F.col("f") - STEPS, F.col("f"))).alias("g")
    weight = 1 + F.col("n") / 512
    sizes = titles.groupBy("block", "f").agg(F.sum(weight).alias("w"), F.sum(F.when(F.col("z"), weight).otherwise(0.0)).alias("a"))
    own = lambda c: F.sum(F.when(F.col("f") == F.col("g"), F.col(c)))
    of = sizes.select("*", groups).groupBy("block", "g").agg(own("w").alias("own"), own("a").alias("asks"), F.sum("w").alias("all"), F.sum("a").alias("all_ask"))
    pairs_of = F.col("asks") * F.col("all") + F.col("own") * F.col("all_ask")
    finer = F.sqrt(pairs_of / PAIRS) if again else F.lit(1.0)
    parts = of.where("all_ask > 0 AND own IS NOT NULL").select("block", "g", *(F.ceil(F.greatest(F.col(c) / most, finer)).alias(x) for c, most, x in (("own", OWN, "p"), ("all", ALL, "q"))))
    parts = broadcast_if_small(cut(parts))
    dealt = lambda n, seed: F.pmod(F.xxhash64("o", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = titles.withColumn("g", F.col("f")).join(parts, ["block", "g"]).withColumns({"i": dealt("p", 1), "j": every("q"), "x": F.lit(False)})
    partners = titles.select("*", groups).join(parts, ["block", "g"]).withColumns({"i": every("p"), "j": dealt("q", 2), "x": F.lit(True)})

    def pairs(group: pa.Table) -> pa.Table:
        olds, news = _earlier(group, ratio, limit)
        o = group["o"].combine_chunks()
        return pa.table({"a": o.take(pa.array([None if i < 0 else i for i in olds], pa.int64())), "b": o.take(pa.array(news, pa.int64()))})

    both = first.unionByName(partners).select("block", "g", "i", "j", "x", "z", "f", "n", "o", "t")
    return both.groupBy("block", "g", "i", "j").applyInArrow(pairs, f"a {kind}, b {kind}")
