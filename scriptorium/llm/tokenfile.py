"""Token-id files: one concatenated id array, Elias-Fano coded document boundaries.

The files hold blocks in ascending order of document id.  A block is one row of
a Parquet folder (Spark's commit protocol makes the writing safe against lost
executors): shard and block number, how many ids of its shard come before it,
the document ids, the ids of its documents one after another (16 bits each where
the vocabulary allows, else 32), and the boundaries as an Elias-Fano sequence
whose select gives any document's offset without a table of offsets.  A
document's place in the whole array is its shard's start (a running sum over
shards) + the block's + the boundary's.

Shards are ranges of document ids between approximate quantiles, one for each
``SHARD_BYTES`` of text (and no fewer than there are shuffle partitions); documents are
encoded before they are shuffled, so only ids move.  An id that several
quantiles fall on is spread over their shards by a checksum of its tokens.  A
shard is read in order and cut into blocks of ``BLOCK_IDS`` ids, so no task
holds more than a block and one document.

Encoding is the library's.  Where the tokenizer's file says that white space only
parts words (see ``split_of``), a text's ids are those of its words (split at ASCII
white space) one after another, and a plain word's those of the parts that the
file's own pattern makes of it; each worker then keeps the ids of the words and
parts it met last, up to twice ``KEPT_BYTES`` of each, over all its tasks.  With any
other file whole texts go through the library.  Strings of special tokens within a
text become those tokens, as the library has it, or are ordinary text if
``specials_as_text`` is set.

Defined results: a null text is an empty one (the end id alone); documents with
a null id come first; repeated ids are ordered by checksum, then ids; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.eliasfano import EliasFano
from scriptorium.llm.runtime import Scratch, kept, released, tuned
from scriptorium.session import spread

END_ID = 2
#: A quarter of a megabyte at 16 bits an id.
BLOCK_IDS = 1 << 17
#: About what each of two generations of words, and of parts of words, may take in a worker.
KEPT_BYTES = 64 << 20
#: Bytes of text that a shard is made for.
SHARD_BYTES = 64 << 20

BLOCKS = "shard int, block int, before bigint, n_docs int, n_ids bigint, width int, null_ids int, doc_ids binary, ids binary, bounds binary"


#: Characters up to U+00FF without controls and white space: lower-casing is one to one, and composition changes nothing.
PLAIN = r"[!-~\u00a1-\u00ac\u00ae-\u00ff]+"


def split_of(spec: dict) -> str | None:
    """The pattern by which a tokenizer (its file's contents) splits lower-cased words into the parts that it merges, if it treats each word by itself; else None."""
    normal, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in normal.get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] or model.get("type") != "BPE" or model.get("dropout"):
        return None
    split, level = (*pre.get("pretokenizers", []), {}, {})[:2]
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or level.get("use_regex"):
        return None
    pattern = (split.get("pattern") or {}).get("Regex")
    if spec.get("post_processor") or spec.get("truncation") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in spec.get("added_tokens", [])):
        return None
    # only where no alternative takes white space can a part not reach from one word to the next
    return pattern if pattern and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern and pattern.count(r"\s") == 1 else None


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printed, else the next from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printed else next(others)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


class Recent(dict):
    """Values of the keys met last: a young generation, which becomes the old one when it has taken ``KEPT_BYTES``."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}
        self.taken = 0

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            self.taken += 200 + 2 * len(key) + len(value)
            if self.taken > KEPT_BYTES:
                self.old = dict(self)
                self.clear()
                self.taken = 0
            self[key] = value
        return value


class TextIds:
    """Packed ids of texts as the tokenizer gives them; where words stand alone, of words of plain characters by their parts."""

    def __init__(self, file: str, dtype: np.dtype, specials_as_text: bool):
        import regex
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as lines:
            spec = json.load(lines)
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.dtype = dtype
        self.by_words = split_of(spec)
        if self.by_words:
            specials = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
            self.special = regex.compile("|".join(specials) or r"(?!)").search
            self.parts, self.plain = regex.compile(self.by_words).findall, regex.compile(PLAIN).fullmatch
            self.merge = self.tokenizer.model.tokenize
            self.part, self.word = Recent(self._part), Recent(self._word)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(BYTE_LETTERS.__getitem__, part.encode()))
        return np.array([token.id for token in self.merge(part)], dtype=self.dtype).tobytes()

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if self.plain(word) and not self.special(word):
            return b"".join(map(self.part.__getitem__, self.parts(word.lower())))
        return self._encoded(word)

    def text(self, text: str) -> bytes:
        if not self.by_words:
            return self._encoded(text)
        for space in "\t\n\x0b\x0c\r":
            text = text.replace(space, " ")
        return b"".join(map(self.word.__getitem__, text.split(" ")))


def _made(file: str, wide: bool, specials_as_text: bool) -> TextIds:
    return TextIds(file, np.dtype("<u4" if wide else "<u2"), specials_as_text)


def _worker(file: str, wide: bool, specials_as_text: bool) -> TextIds:
    """What one worker keeps."""
    return kept(_made, file, wide, specials_as_text)


def _id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def _vocabulary(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size()


def encoded(docs: DataFrame, file: str, end_id: int, bounds: list[int], specials_as_text: bool = False) -> DataFrame:
    """(_id, _shard, _tie, _ids) of each document; the ids packed, with the end id."""
    dtype = _id_type(max(_vocabulary(file), end_id + 1))
    edges = np.array(bounds, dtype=np.int64)

    def run(batches):
        words = _worker(file, dtype.itemsize == 4, specials_as_text)
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch in batches:
            ids = batch.column(0)
            packed = [words.text(text) + end if text else end for text in batch.column(1).to_pylist()]
            ties = np.array([zlib.crc32(x) for x in packed], dtype=np.int64)
            known = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(edges, known, "left"), np.searchsorted(edges, known, "right")
            shard = lo + (ties * (hi - lo + 1) >> 32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard.astype(np.int32)), pa.array(ties), pa.array(packed, pa.binary())], ["_id", "_shard", "_tie", "_ids"])

    return docs.mapInArrow(run, "_id bigint, _shard int, _tie bigint, _ids binary")


def _pack(width: int):
    """Rows in order of (shard, id, tie, ids) to blocks."""

    def run(batches):
        released()
        shard, block, before = None, 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nulls = sum(i is None for i, _ in held)
            lengths = np.array([len(x) // width for _, x in held], dtype=np.int64)
            row = {
                "shard": shard,
                "block": block,
                "before": before,
                "n_docs": len(held),
                "n_ids": size,
                "width": width,
                "null_ids": nulls,
                "doc_ids": np.array([i for i, _ in held if i is not None], dtype="<i8").tobytes(),
                "ids": b"".join(x for _, x in held),
                "bounds": EliasFano.of(np.cumsum(lengths)).to_bytes(),
            }
            types = {"shard": pa.int32(), "block": pa.int32(), "before": pa.int64(), "n_docs": pa.int32(), "n_ids": pa.int64(), "width": pa.int32(), "null_ids": pa.int32(), "doc_ids": pa.binary(), "ids": pa.binary(), "bounds": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in types.items()], list(types))

        for batch in batches:
            for i, s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (s != shard or size >= BLOCK_IDS):
                    yield closed()
                    block, before, held, size = block + 1, before + size, [], 0
                if s != shard:
                    shard, block, before = s, 0, 0
                held.append((i, x))
                size += len(x) // width
        if held:
            yield closed()

    return run


@dataclass
class TokenFiles:
    """Written token-id files."""

    blocks: DataFrame

    def shard_starts(self) -> dict[int, int]:
        """Ids before each shard; a row for each shard comes to the driver."""
        totals = sorted((r[0], r[1]) for r in self.blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
        starts, at = {}, 0
        for shard, n in totals:
            starts[shard], at = at, at + n
        return starts

    def documents(self) -> DataFrame:
        """(_id, start, ids): ids as little-endian unsigned 32-bit integers, read from the files."""
        starts = self.shard_starts()

        def read(batches):
            released()
            for batch in batches:
                for row in batch.to_pylist():
                    coded = EliasFano.from_bytes(row["bounds"])
                    bounds = coded.at(np.arange(coded.n))  # by select
                    first = np.concatenate([[0], bounds[:-1]])
                    ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4").astype("<u4").tobytes()
                    known = pa.array(np.frombuffer(row["doc_ids"], "<i8"))
                    base = starts[row["shard"]] + row["before"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([pa.nulls(row["null_ids"], pa.int64()), known]),
                            pa.array(base + first),
                            pa.array([ids[4 * a : 4 * b] for a, b in zip(first, bounds, strict=True)], pa.binary()),
                        ],
                        ["_id", "start", "ids"],
                    )

        return self.blocks.select("shard", "before", "width", "null_ids", "doc_ids", "ids", "bounds").mapInArrow(read, "_id bigint, start bigint, ids binary")

    def document(self, doc_id: int) -> DataFrame:
        """(_id, start, ids) of the documents with one id: select finds their two offsets, no block's are expanded."""
        starts = self.shard_starts()

        def read(batches):
            released()
            for batch in batches:
                for row in batch.to_pylist():
                    known = np.frombuffer(row["doc_ids"], "<i8")
                    lo, hi = (row["null_ids"] + int(np.searchsorted(known, doc_id, side)) for side in ("left", "right"))
                    bounds = EliasFano.from_bytes(row["bounds"])
                    dtype, base = np.dtype("<u2" if row["width"] == 2 else "<u4"), starts[row["shard"]] + row["before"]
                    for i in range(lo, hi):
                        a, b = bounds[i - 1] if i else 0, bounds[i]
                        ids = np.frombuffer(row["ids"], dtype, b - a, a * dtype.itemsize).astype("<u4").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([base + a], pa.int64()), pa.array([ids], pa.binary())], ["_id", "start", "ids"])

        return self.blocks.select("shard", "before", "width", "null_ids", "doc_ids", "ids", "bounds").mapInArrow(read, "_id bigint, start bigint, ids binary")


def write(docs: DataFrame, scratch: Scratch, file: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, specials_as_text: bool = False) -> TokenFiles:
    """Encodes the documents and writes them in ascending order of their (integer) id below the scratch folder."""
    spark = tuned(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    if not shards:
        size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    cuts = [k / shards for k in range(1, shards)]
    bounds = source.agg(F.percentile_approx("_id", cuts or [0.5], 100 * shards)).first()[0] or []
    width = _id_type(max(_vocabulary(file), end_id + 1)).itemsize
    dealt = encoded(source, file, end_id, sorted(bounds), specials_as_text).repartition(shards, "_shard").sortWithinPartitions("_shard", "_id", "_tie", "_ids")
    blocks = dealt.select("_id", "_shard", "_ids").mapInArrow(_pack(width), BLOCKS)
    return TokenFiles(scratch.keep(blocks, "tokens", compression="zstd"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    import public_tokenizers

    scratch = Scratch(spark, "op5")
    files = write(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), scratch, public_tokenizers.path("word_bpe_49k.json"))
    out = files.documents().select(F.col("_id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return scratch.until_exit(out)
