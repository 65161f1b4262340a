"""Removal of repeated passages with a sparse suffix array.

Of each text only the suffixes that start at content-selected places are
retained: the minimisers, k-grams with the least hash of some window.  They are
dealt by their first k words; one whose stretch (all that the windows around the
minimiser cover, to its left and right) equals that of an earlier document is a
repeat as a whole, and one whose first k words no other stretch shares repeats
nothing.  The rest is sorted by its words and neighbours are compared: the length
of their common start tells how far a match reaches to the right.  For each number
of words to the left, suffixes that agree far enough to the right (a run of
neighbours, none of whose common starts is shorter) and in those words to the left
are the same window; the least id keeps it.

What is sorted together is all suffixes with the same first k words, up to ``HELD``
of them.  Where more different stretches share a k-gram, each of their windows is a
row of its own, dealt by its words and compared with its neighbours there, so that
no task holds a frequent passage's surroundings.

A word is repeated if it lies in a window whose words also stand, in this order,
in a document with a smaller id; the smallest id keeps its passage.

Defined results: a null or empty text has no words; documents that share an id
do not repeat each other; null ids stand after all others and are not smaller
than one another; long texts are cut like others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import passages as P
from scriptorium.llm import textcore as T
from scriptorium.llm.runtime import Scratch, few
from scriptorium.session import spread


#: Suffixes with the same first words that are compared in one place.
HELD = 8192

_U = np.uint64


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed words as rows of a matrix, and how many each row has."""
    out = np.zeros((len(rows), width), dtype=_U)
    n = np.array([len(r) // 8 for r in rows], dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : n[i]] = np.frombuffer(r, ">u8")
    return out, n


def common_starts(suffix: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words each sorted suffix has in common with the one before it; 0 for the first."""
    same = suffix[1:] == suffix[:-1]
    first = np.where(same.all(axis=1), suffix.shape[1], same.argmin(axis=1))
    return np.concatenate([[0], np.minimum(first, np.minimum(n[1:], n[:-1]))]) if len(n) else n


def repeated_windows(key: np.ndarray, suffixes: list[bytes], befores: list[bytes], lo: np.ndarray, hi: np.ndarray, d: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window hash) of windows that a row with a smaller ``d`` has too, among suffixes sorted by key and words, whole keys."""
    suffix, n = _matrix(suffixes, window)
    before, _ = _matrix(befores, window - gram)
    reach = common_starts(suffix, n)
    reach[1:][key[1:] != key[:-1]] = 0
    up, _ = T._WORDS[0].upto(window)
    left = np.zeros(len(key), dtype=_U)
    rows, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=_U)]
    for o in range(window - gram + 1):
        if o:
            left = T.mix(left * _U(0x9E3779B97F4A7C15) + before[:, o - 1])
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own) < 2:
            continue
        run = np.cumsum(reach < window - o)[own]
        order = np.lexsort((d[own], left[own], run))
        own, run = own[order], run[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (left[own[1:]] != left[own[:-1]])
        own = own[d[own] > d[own[new]][np.cumsum(new) - 1]]
        total = (before[own, :o][:, ::-1] * up[:o]).sum(axis=1, dtype=_U) + (suffix[own, : window - o] * up[o:window]).sum(axis=1, dtype=_U)
        rows.append(own)
        hashes.append(T.mix(total))
    return np.concatenate(rows), np.concatenate(hashes)


def compared(suffixes: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, _d, _t): repeated windows (by hash) of the suffixes of ``passages.suffix_rows``, whose keys have at most ``HELD`` of them."""
    dealt = suffixes.repartition("key").sortWithinPartitions("key", "suffix", "_d", "_t")

    def found(table: pa.Table) -> pa.RecordBatch:
        key, lo, hi, d, t = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "_d", "_t"))
        at, hashed = repeated_windows(key, table.column("suffix").to_pylist(), table.column("before").to_pylist(), lo, hi, d, window, gram)
        return pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(d[at]), pa.array(t[at])], ["key", "_d", "_t"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if held and held[-1].column(0)[-1].as_py() != keys[0]:
                yield found(pa.Table.from_batches(held))
                held = []
            if cut:
                yield found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "key bigint, _d bigint, _t bigint")


def repeats(source: DataFrame, scratch: Scratch, *, window: int = P.WINDOW, gram: int = P.GRAM) -> DataFrame:
    """Marks of repeated passages of ``source`` (see ``passages.keyed``)."""
    retained = scratch.keep(P.sorted_neighbours(P.anchor_rows(source, window, gram), keep_first=True), "suffixes")
    firsts = retained.where(F.col("kind") == P.FIRST)
    crowded = scratch.keep(firsts.groupBy("key").count().where(F.col("count") > HELD).select("key"), "crowded")
    none = crowded.isEmpty()
    rest = firsts if none else firsts.join(few(crowded), "key", "left_anti")
    windows = compared(P.suffix_rows(source, rest.select("_d", "_t", "sub"), window, gram), window, gram)
    if not none:
        extended = P.window_rows(source, firsts.join(few(crowded), "key", "left_semi").select("_d", "_t", "sub"), window, gram)
        windows = windows.unionByName(P.sorted_neighbours(extended, keep_first=False).select("key", "_d", "_t"))
    return scratch.keep(P.marks(retained.where(F.col("kind") == P.REPEAT), windows), "marks")


def _without_repeats(raw: bytes, start: np.ndarray, end: np.ndarray, repeated: np.ndarray) -> tuple[str]:
    """The text with each run of repeated words cut out, up to the next word that stays."""
    if not len(start):
        return ("",)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    parts, at = [], start[0]
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        parts.append(raw[at : start[a]])
        at = start[b] if b < len(start) else end[-1]
    parts.append(raw[at : end[-1]])
    return (b"".join(parts).decode("utf-8"),)


def dedup_passages(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", window: int = P.WINDOW) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts; texts without any stay as they are."""
    rows = P.keyed(docs, id_col, text_col, whole="_row")
    marked = repeats(rows.drop("_row"), scratch, window=window)
    changed = P.cut_marked(rows, marked, _without_repeats, [("_cut", pa.string(), "string")], ("_row",), window)
    changed = changed.select(F.col("_row").withField(f"`{text_col}`", F.col("_cut")).alias("_row"))
    return changed.unionByName(P.without(rows, marked).select("_row")).select("_row.*")


def _digest(raw: bytes, start: np.ndarray, end: np.ndarray, repeated: np.ndarray) -> tuple[int, int, str]:
    return len(start), int(repeated.sum()), hashlib.sha256(P.kept_words(raw, start, end, repeated)).hexdigest()


#: What a document's words come to.
DIGEST = [("n_words", pa.int64(), "bigint"), ("n_removed", pa.int64(), "bigint"), ("kept_sha256", pa.string(), "string")]


def digested(source: DataFrame, marked: DataFrame, window: int = P.WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): kept words joined by one space."""
    return P.cut(source, marked, _digest, DIGEST, window=window).select(P.real_id(F.col("_d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; windows of 50 words."""
    scratch = Scratch(spark, "op3")
    source = P.keyed(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", "text")
    return scratch.until_exit(digested(source, repeats(source, scratch)))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT DISTINCT s.doc_id, i FROM s JOIN f USING (h) WHERE f.first < s.doc_id), unnest(range(i, i + 50)) AS t(p) GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept FROM d, unnest(range(1, len(w) + 1)) AS t(p)
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS g FROM r) x WHERE x.doc_id = d.doc_id AND x.g = p) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(r.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
