"""Shared parts of the two operators that find long passages repeated across documents.

A passage is ``window`` consecutive words.  Every window has one anchor: the
k-gram of words with the least hash within it (the leftmost of equal ones), so
equal windows have equal anchors at equal places, and anchors are some 6 % of all
positions.  An anchor's context is the stretch of words that the windows which
it stands for cover.  Two documents that share a window share its anchor's k-gram;
where the whole contexts agree, all their windows do, and only contexts that
differ under one k-gram need their windows compared.

Windows and contexts are compared by hashes of all their words (contexts with
their place and length, windows by two independent 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textcore as T
from scriptorium.llm.runtime import few

WINDOW = 50
GRAM = 16

_U = np.uint64
#: A null id stands after all others.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str, whole: str | None = None) -> DataFrame:
    """(_d, _t, _text): the id with nulls last, a hash that tells texts of equal ids apart, and the text; ``whole``: a struct of the row as well."""
    columns = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text")]
    return docs.select(*columns, *([F.struct("*").alias(whole)] if whole else []))


def _leftmost_min(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of ``values[i : i + n]`` for each i, the leftmost of equal ones."""
    best, place = values, np.arange(len(values))
    width = 1
    while 2 * width <= n:
        left, right = best[: len(best) - width], best[width:]
        first = left <= right
        best, place = np.where(first, left, right), np.where(first, place[: len(first)], place[width:])
        width *= 2
    m = len(values) - n + 1
    if width == n:
        return place[:m]
    shift = n - width
    return np.where(best[:m] <= best[shift : shift + m], place[:m], place[shift : shift + m])


class Anchors:
    """Windows of a slice of texts: starts, the anchor each belongs to, and per anchor k-gram and context hashes."""

    def __init__(self, words: T.Words, window: int = WINDOW, gram: int = GRAM):
        self.words, self.window = words, window
        n = len(words.hash) - window + 1
        if n <= 0 or not (inside := T.inside_text(words, window)).any():
            self.start = self.of = self.text = np.zeros(0, dtype=np.int64)
            self.at = self.begin = self.end = self.start
            self.key = self.context = np.zeros(0, dtype=_U)
            return
        grams = T.sequence_hash(words.hash, gram)
        at = _leftmost_min(grams, window - gram + 1)[:n]
        self.start = np.flatnonzero(inside)
        at = at[self.start]
        new = np.ones(len(at), dtype=bool)
        owner = np.repeat(np.arange(len(words.counts)), words.counts)[self.start]
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        self.of = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        anchor = at[first]
        begin, end = self.start[first], self.start[last] + window
        up, down = T._WORDS[1].upto(len(words.hash) + 1)
        total = np.zeros(len(words.hash) + 1, dtype=_U)
        np.cumsum(words.hash * up[: len(words.hash)], out=total[1:])
        shape = (anchor - begin).astype(_U) * _U(1 << 20) + (end - begin).astype(_U)
        self.key = grams[anchor]
        self.at, self.begin, self.end = anchor, begin, end
        self.context = T.mix((total[end] - total[begin]) * down[begin] ^ T.mix(shape + _U(1 << 45)))
        self.text = owner[first]

    def window_hashes(self, which: int) -> np.ndarray:
        return T.sequence_hash(self.words.hash, self.window, which)[self.start]


def anchor_rows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, sub, _d, _t): each different anchor context of each document."""

    def run(batches):
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, _, words in T.words_of(batch.column(2), T.NON_SPACE, lower=False):
                a = Anchors(words, window, gram)
                if not len(a.key):
                    continue
                order = np.lexsort((a.context, a.key, a.text))
                key, sub, text = a.key[order], a.context[order], a.text[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (text[1:] != text[:-1])
                key, sub, text = key[new].view(np.int64), sub[new].view(np.int64), text[new] + lo
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sub), pa.array(ids[text]), pa.array(marks[text])], ["key", "sub", "_d", "_t"])

    return docs.select("_d", "_t", "_text").mapInArrow(run, "key bigint, sub bigint, _d bigint, _t bigint")


def window_rows(docs: DataFrame, contexts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, sub, _d, _t): the windows (by two hashes) under the given contexts (_d, _t, sub) of the documents."""
    chosen = contexts.groupBy("_d", "_t").agg(F.collect_list("sub").alias("_chosen"))  # no more than a document's own anchors
    rows = with_texts(docs, chosen)

    def run(batches):
        for batch in batches:
            ids, marks, chosen = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, words in T.words_of(batch.column(2), T.NON_SPACE, lower=False):
                a = Anchors(words, window, gram)
                wanted = np.zeros(len(a.key), dtype=bool)
                for k in range(lo, hi):
                    own = slice(*np.searchsorted(a.text, [k - lo, k - lo + 1]))
                    wanted[own] = np.isin(a.context[own].view(np.int64), chosen[k].values.to_numpy())
                used = wanted[a.of]
                text = a.text[a.of[used]]
                key, sub = a.window_hashes(0)[used], a.window_hashes(1)[used]
                order = np.lexsort((sub, key, text))
                key, sub, text = key[order], sub[order], text[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (text[1:] != text[:-1])
                key, sub, text = key[new].view(np.int64), sub[new].view(np.int64), text[new] + lo
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sub), pa.array(ids[text]), pa.array(marks[text])], ["key", "sub", "_d", "_t"])

    return rows.select("_d", "_t", "_text", "_chosen").mapInArrow(run, "key bigint, sub bigint, _d bigint, _t bigint")


def with_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents among ``keys`` with its other columns; other texts stay where they are if the keys are few enough."""
    return docs.join(few(keys.select("_d", "_t")), ["_d", "_t"], "left_semi").join(keys, ["_d", "_t"])


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(few(keys.select("_d", "_t")), ["_d", "_t"], "left_anti")


def suffix_rows(docs: DataFrame, contexts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, suffix, before, lo, hi, _d, _t): the suffixes at the anchors of the given contexts (_d, _t, sub), as far as windows reach.

    ``suffix`` packs the hashes of the words from the anchor on, ``before`` those before it, the nearest first, 64 bits each and
    big-endian, so that bytes sort as words do; windows start ``lo`` to ``hi`` words before the anchor.
    """
    chosen = contexts.groupBy("_d", "_t").agg(F.collect_list("sub").alias("_chosen"))  # no more than a document's own anchors
    rows = with_texts(docs, chosen)

    def run(batches):
        for batch in batches:
            ids, marks, chosen = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, words in T.words_of(batch.column(2), T.NON_SPACE, lower=False):
                a = Anchors(words, window, gram)
                packed, seen, out = words.hash.astype(">u8"), set(), []
                for k in range(lo, hi):
                    own = slice(*np.searchsorted(a.text, [k - lo, k - lo + 1]))
                    for n in np.flatnonzero(np.isin(a.context[own].view(np.int64), chosen[k].values.to_numpy())) + own.start:
                        if (k, a.context[n]) not in seen:
                            seen.add((k, a.context[n]))
                            at, begin, end = a.at[n], a.begin[n], a.end[n]
                            out.append((a.key[n].view(np.int64), packed[at:end].tobytes(), packed[begin:at][::-1].tobytes(), at - (end - window), at - begin, ids[k], marks[k]))
                if out:
                    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "suffix", "before", "lo", "hi", "_d", "_t"])

    return rows.select("_d", "_t", "_text", "_chosen").mapInArrow(run, "key bigint, suffix binary, before binary, lo int, hi int, _d bigint, _t bigint")


#: What a neighbour of the same key and sub key makes of a row.
REPEAT, FIRST, ALONE = 1, 2, 3


def sorted_neighbours(rows: DataFrame, keep_first: bool, extra: str = "", alone: bool = False) -> DataFrame:
    """Sorts rows (key, sub, _d, _t) and compares neighbours; gives (key, sub, _d, _t, kind).

    REPEAT: a row of the same key and sub key has a smaller ``_d``.  With
    ``keep_first``, FIRST: none has, but the key has other sub keys; with
    ``alone``, ALONE: nor has it.  Rows go through in order and none but those at
    the start of the last key are held, however many share a key.  ``extra``: a
    further column that comes along.
    """
    columns = ["key", "sub", "_d", "_t", *([extra.split()[0]] if extra else [])]
    dealt = rows.select(columns).repartition("key").sortWithinPartitions("key", "sub", "_d", "_t")

    def run(batches):
        key = sub = least = None
        several = False
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, s, d = (batch.column(i).to_numpy() for i in range(3))
            same_key = np.empty(len(k), dtype=bool)
            same = np.empty(len(k), dtype=bool)
            same_key[0] = key is not None and k[0] == key
            same_key[1:] = k[1:] == k[:-1]
            same[0] = same_key[0] and s[0] == sub
            same[1:] = same_key[1:] & (s[1:] == s[:-1])
            begin = np.flatnonzero(~same)
            run_of = np.cumsum(~same) - 1
            firsts = d[begin]
            run_least = np.where(run_of >= 0, firsts[run_of] if len(firsts) else 0, least if least is not None else 0)
            repeat = d > run_least
            out = np.zeros(len(k), dtype=np.int8)
            out[repeat] = REPEAT
            if keep_first:
                group = np.cumsum(~same_key)
                subs = np.bincount(group[~same], minlength=group[-1] + 1)
                if same_key[0]:
                    subs[0] += 1 if not several else 2
                if held and same_key[0] and subs[0] >= 2:
                    yield from held
                if not same_key[0] or subs[0] >= 2 or group[-1]:
                    if alone and not (same_key[0] and subs[0] >= 2):
                        yield from map(_as_alone, held)
                    held = []
                first = ~repeat & (subs[group] >= 2)
                out[first] = FIRST
                if alone:
                    out[~repeat & (subs[group] < 2) & (group != group[-1])] = ALONE
                several = bool(subs[-1] >= 2)
                open_end = ~repeat & (group == group[-1]) & (not several)
                if open_end.any():
                    held.append(_with_kind(batch, open_end, np.full(len(k), FIRST, dtype=np.int8)))
            if (used := out > 0).any():
                yield _with_kind(batch, used, out)
            key, sub, least = k[-1], s[-1], run_least[-1]
        if alone:
            yield from map(_as_alone, held)

    return dealt.mapInArrow(run, f"key bigint, sub bigint, _d bigint, _t bigint{', ' + extra if extra else ''}, kind int")


def _as_alone(batch: pa.RecordBatch) -> pa.RecordBatch:
    kinds = pa.array(np.full(batch.num_rows, ALONE, dtype=np.int32))
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], kinds], batch.schema.names)


def _with_kind(batch: pa.RecordBatch, used: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    part = batch.filter(pa.array(used))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(kind[used].astype(np.int32))], [*part.schema.names, "kind"])


def marks(contexts: DataFrame, windows: DataFrame) -> DataFrame:
    """(_d, _t, contexts, windows): what of each document also occurs in an earlier one; no more than its own anchors and windows."""
    rows = contexts.select("_d", "_t", F.col("sub").alias("c"), F.lit(None).cast("long").alias("w")).unionByName(windows.select("_d", "_t", F.lit(None).cast("long").alias("c"), F.col("key").alias("w")))
    return rows.groupBy("_d", "_t").agg(F.collect_list("c").alias("_contexts"), F.collect_list("w").alias("_windows"))


def repeated_words(a: Anchors, text: int, contexts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each word of one text: whether a marked window covers it."""
    first, last = a.words.first[text], a.words.first[text + 1]
    own = np.flatnonzero(a.text[a.of] == text) if len(a.of) else np.zeros(0, dtype=np.int64)
    if not len(own):
        return np.zeros(last - first, dtype=bool)
    hit = np.isin(a.context[a.of[own]].view(np.int64), contexts)
    if len(windows):
        hit |= np.isin(a.window_hashes(0)[own].view(np.int64), windows)
    return T.covered(a.start[own[hit]] - first, a.window, last - first)


Values = Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], tuple]
Fields = list[tuple[str, pa.DataType, str]]


def _valued(rows: DataFrame, values: Values, fields: Fields, keep: tuple[str, ...], marked: bool, window: int, gram: int) -> DataFrame:
    names = ["_d", "_t", *keep, *[f[0] for f in fields]]
    schema = ", ".join(["_d bigint", "_t bigint", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], *[f"{n} {t}" for n, _, t in fields]])

    def run(batches):
        for batch in batches:
            kept = [batch.column(3 + i) for i in range(len(keep))]
            made = []
            for lo, hi, words in T.words_of(batch.column(2), T.NON_SPACE, lower=False):
                a = Anchors(words, window, gram) if marked else None
                raw = words.data.tobytes()
                for k in range(lo, hi):
                    i, j = words.first[k - lo], words.first[k - lo + 1]
                    if a is not None:
                        contexts, windows = (batch.column(3 + len(keep) + c)[k].values.to_numpy() for c in (0, 1))
                        repeated = repeated_words(a, k - lo, contexts, windows)
                    else:
                        repeated = np.zeros(j - i, dtype=bool)
                    made.append(values(raw, words.start[i:j], words.end[i:j], repeated))
            columns = [pa.array([r[c] for r in made], t) for c, (_, t, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *kept, *columns], names)

    return rows.select("_d", "_t", "_text", *keep, *(["_contexts", "_windows"] if marked else [])).mapInArrow(run, schema)


def cut_marked(docs: DataFrame, marked: DataFrame, values: Values, fields: Fields, keep: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each marked document what ``values(bytes, starts, ends, repeated)`` makes of its words."""
    return _valued(with_texts(docs, marked), values, fields, keep, True, window, gram)


def cut(docs: DataFrame, marked: DataFrame, values: Values, fields: Fields, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The same for every document; texts without marks are not shuffled while the marked keys are few enough to broadcast."""
    rest = _valued(without(docs, marked), values, fields, (), False, window, gram)
    return cut_marked(docs, marked, values, fields, (), window, gram).unionByName(rest)


def kept_words(raw: bytes, start: np.ndarray, end: np.ndarray, repeated: np.ndarray) -> bytes:
    """The words that are not repeated, joined by one space."""
    keep = ~repeated
    return b" ".join([raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])


def real_id(d: Column) -> Column:
    return F.when(d != NO_ID, d)
