"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item,
if it has words, is one window).  As a set of shingles of ``shingle`` words a
window is contained in a document only if every one of its shingles is, so the
necessary prefix, with the shingles ordered by their rarity over all documents,
is the rarest one.  Documents are joined with the windows on that shingle; the
shingle's place in the window gives the only start that a hit can have
(positional bound), which must leave room for the whole window in the text
(length bound); what is left is compared word by word, as bytes.

Benchmark tables are handled in blocks of at most ``block_bytes`` of text: the
index of one block is what is broadcast, so its size is bounded however large
the table is, and each further block is one more pass over the documents.

Defined results: a null or empty text has no words and no hits; an item without
words has no windows; items with a null id mark words but are not listed;
repeated documents are judged each for itself; columns other than the id and
the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import textcore as T
from scriptorium.llm.runtime import shared_folder, tuned, type_of
from scriptorium.session import spread

WINDOW = 10
SHINGLE = 3
#: Text of one benchmark block; its index takes some 60 times as much memory in each worker at most.
BLOCK_BYTES = 4 << 20

MATCH = "n_words bigint, hit array<struct<start:int,end:int>>, items array<string>"


@dataclass
class Block:
    """The windows of some items. ``starts``: offset of each window in ``words``; shingles by (length, hash)."""

    words: list[bytes]
    word_hash: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    shingles: dict[int, np.ndarray]

    def shingle_size(self, length: int) -> int:
        return min(SHINGLE, length)


def _distinct_windows(rows: list[tuple[str | None, str]], window: int) -> Block:
    """Each different word sequence once, with the ids of the items that have it."""
    words: list[bytes] = []
    hashes: list[np.ndarray] = []
    owners: dict[bytes, set[str]] = defaultdict(set)
    where: dict[bytes, tuple[int, int]] = {}
    for item, text in rows:
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        found = T.split(raw, np.array([0, len(raw)]), T.ALNUM, lower=True)
        n = len(found.start)
        length = min(window, n)
        base = len(words)
        words += [found.word(i) for i in range(n)]
        hashes.append(found.hash)
        for i in range(n - length + 1 if n else 0):
            key = b" ".join(words[base + i : base + i + length])
            where.setdefault(key, (base + i, length))
            owners[key] |= {item} if item is not None else set()
    order = list(where)
    starts = np.array([where[k][0] for k in order], dtype=np.int64)
    lengths = np.array([where[k][1] for k in order], dtype=np.int64)
    word_hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    block = Block(words, word_hash, starts, lengths, [sorted(owners[k]) for k in order], {})
    for size in sorted({block.shingle_size(int(n)) for n in lengths}):
        rolled = T.sequence_hash(word_hash, size)
        own = starts[[block.shingle_size(int(n)) == size for n in lengths]]
        own_len = lengths[[block.shingle_size(int(n)) == size for n in lengths]]
        block.shingles[size] = np.unique(np.concatenate([rolled[s : s + n - size + 1] for s, n in zip(own, own_len, strict=True)]))
    return block


class _Lookup:
    """Places of hashes in a sorted table, most misses stopped by a bit table."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = max(16, int(np.ceil(np.log2(len(table) + 1))) + 4)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self._slot(table)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``hashes`` that are allowed and in the table, and their places there."""
        at = np.flatnonzero(self.seen[self._slot(hashes)] & allowed)
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.table, hashes[at]), len(self.table) - 1)
        same = self.table[place] == hashes[at]
        return at[same], place[same]


def _rarity(docs: DataFrame, spark: SparkSession, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs over all documents (summed per task, then over tasks)."""
    tables = spark.sparkContext.broadcast(block.shingles)

    def count(batches):
        lookups = {size: _Lookup(table) for size, table in tables.value.items()}
        counts = {size: np.zeros(len(look.table), dtype=np.int64) for size, look in lookups.items()}
        for batch in batches:
            for _, _, words in T.words_of(batch.column(0), T.ALNUM, lower=True):
                for size, look in lookups.items():
                    _, place = look.find(T.sequence_hash(words.hash, size), T.inside_text(words, size))
                    counts[size] += np.bincount(place, minlength=len(look.table))
        for size, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(at), pa.array(found[at])], ["size", "place", "n"])

    summed = docs.select("_text").mapInArrow(count, "size int, place bigint, n bigint").groupBy("size", "place").agg(F.sum("n").alias("n"))
    out = {size: np.zeros(len(table), dtype=np.int64) for size, table in block.shingles.items()}
    for size, place, n in summed.collect():  # at most one row for each shingle of the block
        out[size][place] = n
    return out


@dataclass
class _Prefix:
    """For one shingle length: prefix shingles, and for each the windows and the shingle's offset in them."""

    shingles: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _prefixes(block: Block, rarity: dict[int, np.ndarray]) -> dict[int, _Prefix]:
    """The rarest shingle of each window that can occur at all (none of its shingles is absent from the documents)."""
    chosen: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for w, (start, length) in enumerate(zip(block.starts, block.lengths, strict=True)):
        size = block.shingle_size(int(length))
        own = T.sequence_hash(block.word_hash[start : start + length], size)
        place = np.searchsorted(block.shingles[size], own)
        counts = rarity[size][place]
        if counts.min() > 0:
            best = int(counts.argmin())
            chosen[size].append((int(place[best]), w, best))
    out = {}
    for size, rows in chosen.items():
        rows.sort()
        place, window, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        used, first = np.unique(place, return_index=True)
        out[size] = _Prefix(block.shingles[size][used], np.append(first, len(place)), window, offset)
    return out


def _matches(words: T.Words, block: Block, prefixes: dict[int, _Prefix], lookups: dict[int, _Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """Verified (word start, window) pairs."""
    starts, windows = [], []
    for size, prefix in prefixes.items():
        at, place = lookups[size].find(T.sequence_hash(words.hash, size), T.inside_text(words, size))
        if not len(at):
            continue
        n = prefix.first[place + 1] - prefix.first[place]
        row = np.repeat(prefix.first[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = prefix.window[row]
        at = np.repeat(at, n)
        start = at - prefix.offset[row]
        text = np.searchsorted(words.first, at, side="right") - 1
        fits = (start >= words.first[text]) & (start + block.lengths[window] <= words.first[text + 1])
        start, window = start[fits], window[fits]
        for length in np.unique(block.lengths[window]):
            own = np.flatnonzero(block.lengths[window] == length)
            step = np.arange(length)
            same = np.ones(len(own), dtype=bool)
            for lo in range(0, len(own), 1 << 16):
                part = own[lo : lo + (1 << 16)]
                same[lo : lo + (1 << 16)] = (words.hash[start[part][:, None] + step] == block.word_hash[block.starts[window[part]][:, None] + step]).all(axis=1)
            for i in own[same]:
                b = block.starts[window[i]]
                if words.sequence(int(start[i]), int(length)) == b" ".join(block.words[b : b + length]):
                    starts.append(start[i])
                    windows.append(window[i])
    return np.array(starts, dtype=np.int64), np.array(windows, dtype=np.int64)


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _scan(docs: DataFrame, spark: SparkSession, block: Block, prefixes: dict[int, _Prefix], carried: bool, id_type: str) -> DataFrame:
    """One pass over the documents for one block; ``carried``: earlier blocks' hits come along and are united."""
    sent = spark.sparkContext.broadcast((block, prefixes))
    schema = f"_id {id_type}, {MATCH}" + (", _text string" if carried else "")

    def scan(batches):
        block, prefixes = sent.value
        lookups = {size: _Lookup(p.shingles) for size, p in prefixes.items()}
        hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            counts, hits, items = [], [], []
            before = (batch.column("hit").to_pylist(), batch.column("items").to_pylist()) if "hit" in batch.schema.names else None
            texts = batch.column(batch.schema.names.index("_text"))
            for lo, _, words in T.words_of(texts, T.ALNUM, lower=True):
                starts, windows = _matches(words, block, prefixes, lookups)
                n = words.counts
                by_text: dict[int, list[int]] = defaultdict(list)
                for i, text in enumerate(np.searchsorted(words.first, starts, side="right") - 1):
                    by_text[int(text)].append(i)
                for text in range(len(n)):
                    own = by_text.get(text, [])
                    earlier = before[0][lo + text] if before else []
                    known = set(before[1][lo + text]) if before else set()
                    if own or earlier:
                        at = starts[own] - words.first[text]
                        length = block.lengths[windows[own]]
                        at = np.append(at, [x["start"] for x in earlier]).astype(np.int64)
                        length = np.append(length, [x["end"] - x["start"] for x in earlier]).astype(np.int64)
                        hits.append(_runs(T.covered(at, length, int(n[text]))))
                        for i in own:
                            known.update(block.items[windows[i]])
                    else:
                        hits.append([])
                    counts.append(int(n[text]))
                    items.append(sorted(known))
            columns = [batch.column(batch.schema.names.index("_id")), pa.array(counts, pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *([texts] if carried else [])], ["_id", "n_words", "hit", "items", *(["_text"] if carried else [])])

    return docs.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, hit (runs of words inside an occurrence of a window), items (ids as strings, sorted)."""
    spark = tuned(docs.sparkSession)
    id_type = type_of(docs, id_col)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    out = source
    for k in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        rows = sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0] or "", r[1]))  # one block: bounded by block_bytes
        block = _distinct_windows(rows, window)
        prefixes = _prefixes(block, _rarity(source, spark, block))
        last = k == n_blocks - 1
        out = _scan(out, spark, block, prefixes, not last, id_type)
        if not last:
            shared_folder(spark)
            out = out.checkpoint()
    return out.withColumnRenamed("_id", id_col)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, as they are."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_of"))
    found = contamination(rows, benchmark, id_col="_row", text_col="_of", **options)
    return found.where(F.size("hit") == 0).select("_row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contamination(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
