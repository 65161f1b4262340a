"""Exact Jaccard join of documents by their word n-grams: universe partition and pigeonhole.

A document's set is its distinct shingles of ``shingle`` words, lower-cased (a
text with fewer words is one shingle).  Equal sets are one class; only one
document of a class is compared further, so copies cost no pairs.

Candidates.  Two sets of sizes n >= m with similarity t or more differ in at
most ``H = (1 - t) / (1 + t) * (n + m)`` elements.  Sizes fall into bands of
ratio 1 / t, so a set's partners that are not larger lie in its own band or the
one below.  For each band the universe of shingles is hashed into more than H
segments, and of two sets that differ in at most H elements one of any H + 1
segments agrees.  A set is indexed by the contents of its segments in its own
band and the next.  Segments with few shingles tell little, so as many sizes of
them as can be are left out, as long as most sets keep more than H others; in
bands where single shingles are not enough either, half as many segments are used
with their one-deletion neighbourhoods, and one with two shingles or more accounts
for two differences.  Sets that keep too few segments are found beforehand: they,
and only they, look for the small ones, or with deletions, or for empty ones too,
as far as they need, and their bands index these for them.

Links.  Sets with a signature in common are not paired with each other but with
the least of them, their hub, and the exact difference from it is computed.
What this leaves are pairs of one hub that are not linked through it.  Of two
such sets x and y with differences Dx and Dy from the hub, x and y differ in
``|Dx| + |Dy| - 2 |Dx & Dy|``, so linked ones share elements of Dx and Dy: they
meet on a prefix of those, new elements first and of these the common ones last,
which is short.  Which are common is counted on a sample of sets; it is no more than
an order, any of which gives the same links.  Each set brings a
parity bitmap of ``BITS`` bits along: two sets differ in at least as many elements
as their bitmaps do in bits, so of those that meet only pairs within reach by their
numbers, places and bitmaps are compared exactly.  Where that leaves more than
``DENSE`` pairs for each set of a place, only a least spanning forest of them (by
the bitmaps' distance) is compared, and the hub's sets meet once more, under the
labels that gives.  Places that are dense even then give a further hub, the least
of them, to sets that hang together, and so does a place where more than ``MEETING``
meet, and so on until none is left.  What a place gives is so never more than a
multiple of the sets that meet there, however large a group is.

Shingles are compared by 64-bit hashes of their words, lengths included.

Defined results: a null or empty text has no set and links with nothing; rows
with a null id have their size, and no component; repeated rows are in one
component; of rows that share an id each has its own links, and the id joins
them; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache, reduce
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import textcore as T
from scriptorium.llm.components import components
from scriptorium.llm.runtime import Scratch, few
from scriptorium.session import spread

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
#: Sets at one meeting place beyond which it gets a hub; pairs for each set beyond which a place is dense.
MEETING, DENSE = 2048, 64
#: A place is held whole up to so many times ``MEETING``: it gets a hub only if its pairs are too many, as most are of one label.
HELD = 16
#: Pairs of a place that are compared at a time.
AT_ONCE = 1 << 16
#: One of so many sets is counted for the order of shingles, and so many of the most common ones are told from the others.
COUNTED, MOST_COMMON = 32, 1 << 16
#: Places of up to so many sets are handled many at a time.
SMALL = 12
#: What a row of ``met`` says: compare the two, take the first for a hub of the second, let the hub's sets meet again.
NEAR, HUB, AGAIN = 0, 1, 2
#: Bits of a set's parity bitmap.
BITS = 512
#: Members of a hub that are compared in one run of rows.
HUB_PART = 256
#: Segments of up to so many shingles less one are left out where the others are enough by so many deviations; none may be lacking but by chance.
MOST_LEAST, MARGIN, SAFE = 4, 1.0, 4.5

_U = np.uint64


@dataclass(frozen=True)
class Band:
    """Sets of ``lo < size <= hi``: number of segments, fewest shingles of one that counts, and whether deletions are indexed."""

    lo: int
    hi: int
    segments: int
    least: int
    deletions: bool


class Bands:
    """The bands and their allocation for one similarity."""

    def __init__(self, t: Fraction):
        self.num, self.den = t.numerator, t.denominator
        least = 1
        while self.differ(2 * least) < 1:
            least += 1
        self.first = least - 1
        self.bands: list[Band] = []

    def differ(self, total: int) -> int:
        """Most elements that two linked sets with so many elements together differ in."""
        return (self.den - self.num) * total // (self.den + self.num)

    def upto(self, size: int) -> None:
        while not self.bands or self.bands[-1].hi <= size:
            lo = self.bands[-1].hi if self.bands else self.first
            hi = max(lo + 1, ceil(lo * self.den / self.num))
            self.bands.append(self._allocated(lo, hi))

    def _allocated(self, lo: int, hi: int) -> Band:
        """Segments as they are, the small ones left out as far as most sets can do without; where single shingles do not do, deletions."""
        for least in range(MOST_LEAST, 0, -1):
            if m := self._enough(lo, hi, least, MARGIN if least > 1 else SAFE):
                return Band(lo, hi, m, least, False)
        return Band(lo, hi, -(-(self.differ(2 * hi) + 1) // 2) + 1, 1, True)

    def _enough(self, lo: int, hi: int, least: int, margin: float) -> int:
        """So many segments that sets keep as many of ``least`` shingles as they need, by ``margin`` deviations; 0 if there is no such number."""
        need = [(n, self.differ(2 * n) + 1) for n in (lo + 1, hi)]
        for m in range(max(k for _, k in need), 2 * hi // (least + 1) + 1):
            shares = [1 - sum(exp(-n / m) * (n / m) ** j / factorial(j) for j in range(least)) for n, _ in need]
            if all(m * p - margin * sqrt(m * p * (1 - p)) >= k for p, (_, k) in zip(shares, need, strict=True)):
                return m
        return 0

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Each size's band; -1 where no other set of at most that size is similar enough."""
        self.upto(int(sizes.max(initial=1)))
        return np.searchsorted([self.first, *[b.hi for b in self.bands]], sizes, side="left") - 1


@cache
def _bands(num: int, den: int) -> Bands:
    return Bands(Fraction(num, den))


def shingle_sets(words: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a slice's texts, sorted by both."""
    texts = [np.repeat(np.arange(len(words.counts)), words.counts)]
    rolled = T.sequence_hash(words.hash, n)
    inside = T.inside_text(words, n)
    text, hashed = texts[0][: len(rolled)][inside], rolled[inside]
    for short in range(1, n):
        own = np.flatnonzero(words.counts == short)
        if len(own):
            text = np.append(text, own)
            hashed = np.append(hashed, T.sequence_hash(words.hash, short)[words.first[own]] ^ _U(short))
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    return text[new], hashed[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Segments:
    """Segments of one band for some sets: contents as sums of mixed hashes, and counts."""

    def __init__(self, number: int, band: Band, text: np.ndarray, hashed: np.ndarray, n_texts: int):
        self.number, self.band = number, band
        salted = T.mix(hashed ^ _U(0x5851F42D4C957F2D * (number + 1) & (1 << 64) - 1))
        segment = ((salted >> _U(32)) * _U(band.segments) >> _U(32)).astype(np.int64)
        self.place = text * band.segments + segment
        self.element = T.mix(hashed + _U(0x2545F4914F6CDD1D))
        self.sum = np.zeros(n_texts * band.segments, dtype=_U)
        np.add.at(self.sum, self.place, self.element)
        self.count = np.bincount(self.place, minlength=len(self.sum))

    def _signed(self, sums: np.ndarray, places: np.ndarray, space: int) -> np.ndarray:
        return T.mix(sums ^ T.mix((places % self.band.segments).astype(_U) + _U(2 * self.number + space << 32)))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set, signature): contents of the segments that count, and with one shingle less where that is indexed."""
        used = np.flatnonzero(self.count >= self.band.least)
        yield used // self.band.segments, self._signed(self.sum[used], used, 0)
        if self.band.deletions:
            yield self._less(0, 2)

    def _less(self, space: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        far = self.count[self.place] >= least
        place = self.place[far]
        return place // self.band.segments, self._signed(self.sum[place] - self.element[far], place, space)

    def further_rows(self, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What sets look for that have too few segments: small ones (1), all with one shingle less (2), empty ones (3)."""
        if level == 1:
            used = np.flatnonzero((self.count > 0) & (self.count < self.band.least))
        else:
            used = np.arange(len(self.sum)) if level == 3 else np.flatnonzero(self.count)
            yield self._less(1, 1 if level == 3 else 2)
        yield used // self.band.segments, self._signed(self.sum[used], used, 1)

    def _worth(self, least: int, deletions: bool) -> np.ndarray:
        grid = self.count.reshape(-1, self.band.segments)
        return (grid >= least).sum(axis=1) + ((grid > 1).sum(axis=1) if deletions else 0)

    def lacks(self, differ: np.ndarray) -> np.ndarray:
        """The level of further rows that a set needs, for its segments to account for more than it may differ in; 0 for none."""
        enough = [self._worth(self.band.least, self.band.deletions) > differ, self._worth(1, self.band.deletions) > differ, self._worth(1, True) > differ]
        return np.select(enough, [0, 1, 2], 3)


def bitmaps(text: np.ndarray, hashed: np.ndarray, n_texts: int) -> np.ndarray:
    """A row of ``BITS`` bits for each set, packed: whether an odd number of its elements falls on each."""
    place = text * BITS + (T.mix(hashed ^ _U(0x5DEECE66D)) >> _U(32)).astype(np.int64) % BITS
    return np.packbits((np.bincount(place, minlength=n_texts * BITS) & 1).astype(np.uint8).reshape(n_texts, BITS), axis=1)


def _text_rows(batch: pa.RecordBatch, shingle: int):
    for lo, hi, words in T.words_of(batch.column(2), T.NON_SPACE, lower=True):
        text, hashed = shingle_sets(words, shingle)
        yield lo, hi, text, hashed, np.searchsorted(text, np.arange(hi - lo + 1))


def prints(docs: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """(_d, _t, n, f1, f2, lacks): the size of each row's set, two sums over it, and if it has too few segments its band, times four, and what it needs further."""

    def run(batches):
        bands = _bands(t.numerator, t.denominator)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi, text, hashed, first in _text_rows(batch, shingle):
                n = np.diff(first)
                number = bands.of(n)
                lacks = np.full(hi - lo, -1, dtype=np.int32)
                for b in np.unique(number[number >= 0]):
                    member = number == b
                    own, index, at = member[text], np.cumsum(member) - 1, np.flatnonzero(member)
                    found = Segments(int(b), bands.bands[b], index[text[own]], hashed[own], len(at)).lacks(np.array([bands.differ(2 * int(k)) for k in n[at]]))
                    lacks[at] = np.where(found > 0, 4 * b + found, -1)
                for values, column in zip(out, (n, _sums(T.mix(hashed), first).view(np.int64), _sums(T.mix(hashed ^ _U(0x1234567)), first).view(np.int64), lacks), strict=True):
                    values.append(column)
            columns = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in out]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[c.cast(k) for c, k in zip(columns, types, strict=True)]], ["_d", "_t", "n", "f1", "f2", "lacks"])

    return docs.select("_d", "_t", "_text").mapInArrow(run, "_d bigint, _t bigint, n bigint, f1 bigint, f2 bigint, lacks int")


#: Added to a set's key in rows that only larger sets look for, so that others come first.
_ONLY_INDEXED = 1 << 62
#: Keys from here on are made of hashes, for ids that are negative, greater, or have several sets.
_MADE = 1 << 61


def signatures(sets: DataFrame, shingle: int, t: Fraction, lacking: dict[int, int]) -> DataFrame:
    """(sig, y): the segment signatures of each set (_k, _text) in its band and the next. ``lacking``: bands in which some set needs further ones, and up to which level."""

    def run(batches):
        bands = _bands(t.numerator, t.denominator)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, text, hashed, first in _text_rows(batch, shingle):
                n = np.diff(first)
                number = bands.of(n)
                for b in np.unique(number):
                    bands.upto(bands.bands[max(b, 0)].hi + 1)
                    for target, mark in ((b, 0), (b + 1, _ONLY_INDEXED))[int(b < 0) :]:
                        band = bands.bands[target]
                        member = number == b
                        if mark:
                            member &= n * bands.den >= bands.num * (band.lo + 1)
                        if not member.any():
                            continue
                        own = member[text]
                        index = np.cumsum(member) - 1
                        at = np.flatnonzero(member)
                        cut = Segments(int(target), band, index[text[own]], hashed[own], len(at))
                        marks = np.full(len(at), mark, dtype=np.int64)
                        made = [(row, sig, marks) for row, sig in cut.rows()]
                        if target in lacking:
                            # only sets that lack segments look for these
                            if not mark:
                                marks = np.where(cut.lacks(np.array([bands.differ(2 * int(k)) for k in n[at]])) > 0, 0, _ONLY_INDEXED)
                            made += [(row, sig, marks) for row, sig in cut.further_rows(lacking[target])]
                        for row, sig, marked in made:
                            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(keys[lo + at[row]] + marked[row])], ["sig", "y"])

    return sets.select("_k", F.lit(0).alias("_"), "_text").mapInArrow(run, "sig bigint, y bigint")


def hub_pairs(rows: DataFrame) -> DataFrame:
    """(hub, x), different: under each signature the least set of the band, and each other one."""

    def run(batches):
        sig = hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, y = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.empty(len(s), dtype=bool)
            new[0] = sig is None or s[0] != sig
            new[1:] = s[1:] != s[:-1]
            run_of = np.cumsum(new) - 1
            firsts = y[new]
            hubs = np.where(run_of >= 0, firsts[run_of] if len(firsts) else 0, hub if hub is not None else 0)
            x = y & (_ONLY_INDEXED - 1)
            used = (hubs < _ONLY_INDEXED) & (x != hubs)
            if used.any():
                pairs = np.unique(np.stack([hubs[used], x[used]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["hub", "x"])
            sig, hub = s[-1], hubs[-1]

    return rows.repartition("sig").sortWithinPartitions("sig", "y").mapInArrow(run, "hub bigint, x bigint").distinct()


def common_shingles(sets: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles that most sets of the sample have, sorted, and in how many."""

    def run(batches):
        for batch in batches:
            for _, _, _, hashed, _ in _text_rows(batch, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64))], ["h"])

    sample = sets.where(F.pmod(F.xxhash64("_k"), F.lit(COUNTED)) == 0).select("_k", F.lit(0).alias("_"), "_text")
    counts = sample.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    found = counts.orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    hashed = found.column("h").to_numpy().astype(np.int64).view(_U)
    order = np.argsort(hashed)
    return hashed[order], found.column("c").to_numpy().astype(np.int64)[order]


def _common_last(hashed: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sorted shingles in the order in which sets meet on them."""
    known, counts = common
    if not len(known) or not len(hashed):
        return hashed
    place = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
    return hashed[np.argsort(np.where(known[place] == hashed, counts[place], 0), kind="stable")]


def compared(sets: DataFrame, pairs: DataFrame, shingle: int, t: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(hub, x, n, apart, linked, prefix, bits) for each pair: x's size, how many elements differ, and the first of those, new ones in x first; x's bitmap."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_PART).alias("parts")).where("parts > 1")
    dealt = pairs.join(few(parts), "hub", "left").select("hub", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).alias("part"), F.lit(1).alias("role"), "x")
    wanted = dealt.unionByName(dealt.select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("x")).distinct())
    rows = sets.join(few(wanted), sets["_k"] == wanted["x"]).select("hub", "part", "role", "x", "_text").repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "x")
    num, den = t.numerator, t.denominator

    def run(batches):
        key = own = None
        for batch in batches:
            hub, part, role, x = (batch.column(i).to_numpy() for i in (0, 1, 2, 3))
            out = {"hub": [], "x": [], "n": [], "apart": [], "linked": [], "prefix": [], "bits": []}
            for lo, hi, words in T.words_of(batch.column(4), T.NON_SPACE, lower=True):
                text, hashed = shingle_sets(words, shingle)
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                bits = bitmaps(text, hashed, hi - lo)
                for i in range(lo, hi):
                    mine = hashed[first[i - lo] : first[i - lo + 1]]
                    if role[i] == 0:
                        key, own = (hub[i], part[i]), mine.copy()
                        continue
                    assert key == (hub[i], part[i]), "a hub's text is missing"
                    place = np.minimum(np.searchsorted(own, mine), max(0, len(own) - 1))
                    both = own[place] == mine if len(own) else np.zeros(len(mine), dtype=bool)
                    kept = np.ones(len(own), dtype=bool)
                    kept[place[both]] = False
                    shared = int(both.sum())
                    apart = len(mine) + len(own) - 2 * shared
                    linked = den * shared >= num * (len(mine) + len(own) - shared)
                    least = _prefix(len(mine), apart, linked, t)
                    for values, value in zip(out.values(), (hub[i], x[i], len(mine), apart, linked, np.concatenate([_common_last(mine[~both], common)[:least], own[kept]])[:least].view(np.int64), bits[i - lo].tobytes()), strict=True):
                        values.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), types, strict=True)], list(out))

    return rows.mapInArrow(run, "hub bigint, x bigint, n bigint, apart bigint, linked boolean, prefix array<bigint>, bits binary")


def _prefix(n: int, apart: int, linked: bool, t: Fraction) -> int:
    """How many elements of a difference are enough to meet every set that it may be linked with past the hub."""
    num, den = t.numerator, t.denominator
    if linked:
        return apart - (2 * num * apart // (den + num)) // 2
    return apart - max(1, apart - (den - num) * n // num) + 1


def _hanging_together(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that it hangs together with by pairs of places."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        after = label.copy()
        np.minimum.at(after, pairs[:, 0], least)
        np.minimum.at(after, pairs[:, 1], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _spanning(n: int, pairs: np.ndarray, far: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs, the nearest first: every tree takes its nearest way out, until none has any."""
    order = np.argsort(far, kind="stable")
    pairs, label, taken = pairs[order], np.arange(n), []
    while True:
        ends = label[pairs]
        pairs, ends = (v[ends[:, 0] != ends[:, 1]] for v in (pairs, ends))
        if not len(pairs):
            return np.concatenate(taken) if taken else np.zeros((0, 2), dtype=np.int64)
        nearest = np.full(n, len(pairs))
        for side in (0, 1):
            np.minimum.at(nearest, ends[:, side], np.arange(len(pairs)))
        used = np.unique(nearest[nearest < len(pairs)])
        taken.append(pairs[used])
        label = _hanging_together(n, ends[used])[label]


@dataclass
class Meeting:
    """Rows of sets that meet: number of elements, of those apart from the hub, whether linked with it, label, place of the element in the prefix, bitmap."""

    n: np.ndarray
    apart: np.ndarray
    linked: np.ndarray
    label: np.ndarray
    at: np.ndarray
    bits: np.ndarray

    def within_reach(self, i: np.ndarray, j: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs of rows may be linked past their hub, as one of them at least is not linked with it, and their bitmaps' distances."""
        num, den = t.numerator, t.denominator
        most = (den - num) * (self.n[i] + self.n[j]) // (den + num)
        shared = -((most - self.apart[i] - self.apart[j]) // 2)
        able = (shared <= np.minimum(self.apart[i] - self.at[i], self.apart[j] - self.at[j])) & (np.abs(self.apart[i] - self.apart[j]) <= most)
        able = np.flatnonzero(able & (self.label[i] != self.label[j]) & ~(self.linked[i] & self.linked[j]))
        differ = np.bitwise_count(self.bits[i[able]] ^ self.bits[j[able]]).sum(axis=1, dtype=np.int64)
        near = differ <= most[able]
        return able[near], differ[near]

    def fewer(self, lo: int, hi: int) -> np.ndarray:
        """Which of the rows ``lo`` to ``hi`` are in every pair that matters: those without the most usual label, or those not linked with the hub."""
        _, which, counts = np.unique(self.label[lo:hi], return_inverse=True, return_counts=True)
        other, unlinked = which != np.argmax(counts), ~self.linked[lo:hi]
        return other if other.sum() < unlinked.sum() else unlinked

    def of_one_place(self, lo: int, hi: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows ``lo`` to ``hi``, and their distances."""
        found, far = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        one, every = self.fewer(lo, hi), np.arange(hi - lo)
        rows, step = np.flatnonzero(one), max(1, AT_ONCE // (hi - lo))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            i, j = np.repeat(part, hi - lo), np.tile(every, len(part))
            once = ~one[j] | (j > i)
            i, j = lo + i[once], lo + j[once]
            near, differ = self.within_reach(i, j, t)
            found.append(np.stack([i[near], j[near]], axis=1))
            far.append(differ)
        return np.concatenate(found), np.concatenate(far)

    def of_small_places(self, place: np.ndarray, small: np.ndarray, t: Fraction) -> np.ndarray:
        """Pairs of all places that are ``small`` (by number of place)."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for d in range(1, SMALL):
            i = np.flatnonzero((place[d:] == place[:-d]) & small[place[d:]]) if d < len(place) else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            near, _ = self.within_reach(i, i + d, t)
            found.append(np.stack([i[near], i[near] + d], axis=1))
        return np.concatenate(found)


def met(members: DataFrame, t: Fraction, meeting: int, again: bool) -> DataFrame:
    """(a, b, kind): what follows from sets that meet, see ``NEAR``. ``again``: whether they did before.

    Members (with labels; equal ones are linked already) meet at the elements of their prefixes.  Of two that meet, so many elements
    must be common that neither may have too few from here on, and their numbers and bitmaps must be near each other.
    """
    rows = members.select("hub", "x", "n", "apart", "linked", "label", "bits", F.posexplode("prefix").alias("at", "element"))
    names = ["hub", "element", "x", "n", "apart", "linked", "label", "at"]

    dense = DENSE

    def crowded(x: np.ndarray, lo: int, hi: int, least: int) -> np.ndarray:
        return np.stack([np.full(hi - lo, least), x[lo:hi]], axis=1)

    def place(x: np.ndarray, hub: int, sets: Meeting, lo: int, hi: int) -> list[tuple[np.ndarray, int]]:
        if (sets.label[lo:hi] == sets.label[lo]).all():
            return []
        if hi - lo > meeting and sets.fewer(lo, hi).sum() * (hi - lo) > meeting * meeting:
            return [(crowded(x, lo, hi, x[lo]), HUB)]
        pairs, far = sets.of_one_place(lo, hi, t)
        if len(pairs) <= dense * (hi - lo):
            return [(x[pairs], NEAR)]
        if not again:
            return [(x[_spanning(hi - lo, pairs - lo, far) + lo], NEAR), (np.array([[hub, hub]]), AGAIN)]
        hubs = _hanging_together(hi - lo, pairs - lo)
        own = np.arange(hi - lo)
        return [(x[np.stack([hubs, own], axis=1)[hubs != own] + lo], HUB)]

    def run(batches):
        held: list[np.ndarray] | None = None
        crowd: tuple[int, int, int] | None = None  # the place that is being crowded, and the least there

        def taken(c: list[np.ndarray], last: bool):
            """Pairs of whole places, and the rows of the last one if it may go on."""
            nonlocal crowd
            kinds: tuple[list, list, list] = ([], [], [])
            new = np.ones(len(c[0]), dtype=bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            starts = np.append(np.flatnonzero(new), len(new))
            rest = None
            sizes = np.diff(starts)
            sets = Meeting(*c[3:])
            small = (sizes > 1) & (sizes <= min(SMALL, meeting))
            small[-1] &= last
            small[0] &= not crowd or crowd[:2] != (c[0][0], c[1][0])
            kinds[NEAR].append(c[2][sets.of_small_places(np.cumsum(new) - 1, small, t)])
            edge = np.isin(np.arange(len(sizes)), (0, len(sizes) - 1))
            for r in np.flatnonzero(((sizes > 1) | edge) & ~small):
                lo, hi = starts[r], starts[r + 1]
                key = (c[0][lo], c[1][lo])
                if crowd and crowd[:2] == key:
                    kinds[HUB].append(crowded(c[2], lo, hi, crowd[2]))
                elif hi - lo > meeting * HELD:
                    crowd = (*key, c[2][lo])
                    kinds[HUB].append(crowded(c[2], lo, hi, crowd[2]))
                elif r == len(sizes) - 1 and not last:
                    rest = [v[lo:hi] for v in c]
                else:
                    for pairs, kind in place(c[2], key[0], sets, lo, hi):
                        kinds[kind].append(pairs)
            pairs = [np.unique(np.concatenate(k), axis=0) if k else np.zeros((0, 2), dtype=np.int64) for k in kinds]
            flags = np.repeat(np.arange(3, dtype=np.int32), [len(k) for k in pairs])
            both = np.concatenate(pairs)
            return rest, pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(flags)], ["a", "b", "kind"])

        for batch in batches:
            if batch.num_rows:
                bits = np.frombuffer(b"".join(batch.column(len(names)).to_pylist()), dtype=_U).reshape(batch.num_rows, -1)
                c = [*(v.to_numpy(zero_copy_only=False) for v in batch.columns[: len(names)]), bits]
                if held:
                    c = [np.concatenate(v) for v in zip(held, c, strict=True)]
                held, out = taken(c, False)
                if out.num_rows:
                    yield out
        if held:
            yield taken(held, True)[1]

    dealt = rows.select(*names, "bits").repartition("hub", "element").sortWithinPartitions("hub", "element", "x")
    return dealt.mapInArrow(run, "a bigint, b bigint, kind int").distinct()


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def linked_groups(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(_d, _t, n, component) for each row: its id (null as it is), a hash of its text, the size of its set, the least id of its component."""
    keep, drop, t = scratch.keep, scratch.drop, similarity
    source = docs.select(F.col(id_col).cast("long").alias("_d"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text"))
    printed = keep(prints(source, shingle, t), "prints")
    classed = ["n", "f1", "f2"]
    known = printed.where(F.col("_d").isNotNull() & (F.col("n") > 0))
    several = keep(known.select("_d", *classed).distinct().groupBy("_d").count().where("count > 1").select("_d"), "several")
    classes = known.groupBy(*classed).agg(F.min(F.struct("_d", "_t")).alias("rep")).select(*classed, "rep.*")
    plain = F.col("_d").between(0, _MADE - 1)
    repeated_ids = not several.isEmpty()
    if repeated_ids:
        classes = classes.join(few(several.withColumn("also", F.lit(True))), "_d", "left")
        plain = F.col("also").isNull() & plain
    classes = keep(classes.withColumn("_k", F.when(plain, F.col("_d")).otherwise(_MADE + F.pmod(F.xxhash64("_d", "_t"), F.lit(_MADE)))).select(*classed, "_d", "_t", "_k"), "classes")

    copies = keep(printed.where("_d is not null").join(classes.select("_d", "_t"), ["_d", "_t"], "left_anti").select("_d", "_t").distinct(), "copies")  # and rows without words
    sets = source.where(F.col("_d").isNotNull()).join(few(copies), ["_d", "_t"], "left_anti")
    made = classes.where("_k <> _d").select("_d", "_t", "_k")
    sets = sets.withColumn("_k", F.col("_d")) if made.isEmpty() else sets.join(few(made), ["_d", "_t"], "left").withColumn("_k", F.coalesce("_k", "_d"))
    sets = sets.select("_k", "_text")
    lacking = {r[0]: r[1] for r in printed.where("lacks >= 0").groupBy(F.floor(F.col("lacks") / 4)).agg(F.max(F.col("lacks") % 4)).collect()}  # bands: some hundred at most

    common = common_shingles(sets, shingle)
    links = []
    if repeated_ids:
        of_id = known.join(few(several), "_d", "left_semi").select("_d", *classed).join(classes.select(*classed, "_k"), classed)
        links = [of_id.select(F.col("_k").alias("a"), (-1 - F.pmod(F.xxhash64("_d"), F.lit(_MADE))).alias("b"))]
    pairs = keep(hub_pairs(signatures(sets, shingle, t, lacking)), "pairs-0")
    known_members: DataFrame | None = None
    n = 0
    while True:
        members = keep(compared(sets, pairs, shingle, t, common), f"members-{n}")
        links.append(members.where("linked").select(F.col("hub").alias("a"), F.col("x").alias("b")))
        held = members if known_members is None else members.unionByName(known_members.join(few(pairs.select("hub").distinct()), "hub", "left_semi"))
        known_members = members if known_members is None else known_members.unionByName(members)
        hubs, further = None, []
        for again in (False, True):
            labels = components(_all(links), scratch, f"graph-{n}-{int(again)}")
            links = [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))]
            own = held if hubs is None else held.join(few(hubs), "hub", "left_semi")
            own = own.join(few(labels.withColumnRenamed("node", "x")), "x", "left").withColumn("label", F.coalesce("label", "x"))
            apart = own.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if(~F.col("linked")).alias("open"), F.count("*").alias("of"))
            apart = keep(apart.where("lo <> hi and open > 0 and of > 1").select("hub"), f"apart-{n}-{int(again)}")
            found = keep(met(own.join(few(apart), "hub", "left_semi"), t, MEETING, again), f"met-{n}-{int(again)}")
            said = {r[0] for r in found.select("kind").distinct().collect()}
            if NEAR in said:
                near = found.where(F.col("kind") == NEAR).select(F.col("a").alias("hub"), F.col("b").alias("x"))
                links.append(keep(compared(sets, near, shingle, t, common).where("linked").select(F.col("hub").alias("a"), F.col("x").alias("b")), f"near-{n}-{int(again)}"))
            if HUB in said:
                further.append(found.where(F.col("kind") == HUB).select(F.col("a").alias("hub"), F.col("b").alias("x")).where("hub <> x"))
            if AGAIN not in said:
                break
            hubs = found.where(F.col("kind") == AGAIN).select(F.col("a").alias("hub"))
        n += 1
        if further:
            pairs = keep(_all(further).distinct().join(known_members.select("hub", "x"), ["hub", "x"], "left_anti"), f"pairs-{n}")
        if not further or pairs.isEmpty():
            break
    if len(links) > 1:
        labels = components(_all(links), scratch, "graph")
    grouped = classes.join(labels.withColumnRenamed("node", "_k"), "_k", "left").withColumn("label", F.coalesce("label", "_k"))
    least = grouped.groupBy("label").agg(F.min("_d").alias("component"))
    per_class = keep(grouped.join(least, "label").select(*classed, "component"), "per-class")
    out = printed.join(per_class, classed, "left")
    whole = F.when(F.col("_d").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("_d")).otherwise(F.col("component"))
    drop(*[name for name in scratch.names if name.partition("-")[0] in ("pairs", "members", "apart", "met", "near")])
    return out.select("_d", "_t", "n", whole.cast("long").alias("component"))


def one_of_each_group(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, and those with a null id."""
    groups = linked_groups(docs, scratch, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    gone = scratch.keep(groups.where("component <> _d").select("_d").distinct(), "gone")
    return docs.join(few(gone), docs[id_col].cast("long") == gone["_d"], "left_anti")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; shingles of 3 words, similarity 0.9."""
    scratch = Scratch(spark, "op2")
    groups = linked_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), scratch, shingle=3, similarity=Fraction(9, 10))
    return scratch.until_exit(groups.select(F.col("_d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
