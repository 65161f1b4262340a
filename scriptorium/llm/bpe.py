"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

A sequence of tokens is what the merges make of its bytes exactly if each token
is (alone) what the merges make of its own bytes and so is each pair of
neighbours.  So for every prefix of a piece there is one last token, found from
the last tokens of shorter prefixes, and the transducer reads one byte at a time.
Nondeterministic, it would start in the tree of tokens anew before each byte; the
set of tree nodes it is then in is told by the deepest of them (the others are
its suffixes), so a state is a node.  Transitions between states, the suffix that
a state falls back on and the tokens that end in it are determined when they are
first asked for.  Of the tokens that end at a byte the one that fits the last
token before it is the last token there.  Tokens are emitted once every
boundary from which a token may still grow has them behind it, so the lookahead
is bounded by the longest token.  Transitions are kept up to
``STATE_BYTES``; workers also keep the ids of the pieces they met last, up to
twice ``KEPT_BYTES``.

Decoding is a stream: ids are taken ``PUSH`` at a time, their bytes joined, and an
incremental UTF-8 machine, whose state goes from one push to the next, tells where
the last complete sequence ends.

Defined results: a null text is an empty one (no ids, empty bytes); repeated rows
are encoded each for itself; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.runtime import kept, tuned, type_of
from scriptorium.session import spread

#: About what a worker's transitions, and its pairs and parts of tokens, may take, and each of two generations of pieces.
STATE_BYTES, PAIR_BYTES, KEPT_BYTES = 24 << 20, 24 << 20, 64 << 20
#: Bytes of a piece after which tokens that are settled are emitted.
SETTLED_EACH = 4096
#: Ids that are decoded at once.
PUSH = 1 << 16
#: Above any rank.
NEVER = 1 << 60


def read_ranks(file: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The tokens' prefix tree: node and byte to node, each node's token, the node above it and its last byte.
        self.child: dict[int, int] = {}
        self.token, self.above, self.byte = [-1], [0], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.child.setdefault(node << 8 | byte, len(self.token))
                if after == len(self.token):
                    self.token.append(-1)
                    self.above.append(node)
                    self.byte.append(byte)
                node = after
            self.token[node] = rank
        #: Determined so far: transitions, the node of each node's longest proper suffix, and (token, length) of the tokens that end at a node.
        self.next: dict[int, int] = {}
        self.suffix: list[int | None] = [None] * len(self.token)
        self.suffix[0] = 0
        self.ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.token)
        self.ending[0] = ()
        self._fits: dict[int, bool] = {}
        self._made: dict[int, tuple | None] = {}
        self.made_bytes = 0

    def _spines(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """First and last part of a token while the merges (lowest rank first) make it, each with the rank that ends it.

        None if they do not make it from its bytes.
        """
        if token in self._made:
            return self._made[token]
        data, ranks = self.bytes_of[token], self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        firsts, lasts = [], []
        while len(parts) > 1:
            found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            if at == 0:
                firsts.append((parts[0], best))
            if at == len(parts) - 2:
                lasts.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        made = None
        if len(parts) == 1:
            made = ([*firsts, (data, NEVER)], [*lasts, (data, NEVER)])
        self.made_bytes += 300 + 130 * (len(firsts) + len(lasts))
        if self.made_bytes > PAIR_BYTES:
            self._made.clear()
            self.made_bytes = 0
        self._made[token] = made
        return made

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave ``right`` whole, and after ``left`` (-1: nothing before it).

        They do unless, while both are made, the last part of ``left`` and the first of ``right`` are merged before
        either is merged within its token (of equal ranks, what stands further left goes first).
        """
        own = self._spines(right)
        known = own is not None
        if known and left >= 0:
            lasts, firsts = self._spines(left)[1], own[0]
            i = j = 0
            while True:
                (p, p_ends), (q, q_ends) = lasts[i], firsts[j]
                joined = self.ranks.get(p + q, NEVER)
                if joined < p_ends and joined <= q_ends and joined < NEVER:
                    known = False
                    break
                if p_ends == q_ends == NEVER:
                    break
                if p_ends <= q_ends:
                    i += 1
                else:
                    j += 1
        if len(self._fits) * 150 > PAIR_BYTES:
            self._fits.clear()
        self._fits[left + 1 << 32 | right] = known
        return known

    def _suffix(self, node: int) -> int:
        """The node of the longest proper suffix that is in the tree."""
        path = []
        while self.suffix[node] is None:
            path.append(node)
            node = self.above[node]
        for node in reversed(path):
            self.suffix[node] = self.step(self.suffix[self.above[node]], self.byte[node]) if self.above[node] else 0
        return self.suffix[node]

    def step(self, node: int, byte: int) -> int:
        """The state after one more byte."""
        at = node
        while (after := self.child.get(at << 8 | byte)) is None and at:
            at = self._suffix(at)
        if len(self.next) * 150 > STATE_BYTES:
            self.next.clear()
        self.next[node << 8 | byte] = after = after or 0
        return after

    def ends(self, node: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that end in a state, longest first."""
        if (known := self.ending[node]) is None:
            known = self.ends(self._suffix(node))
            if (token := self.token[node]) >= 0:
                known = ((token, len(self.bytes_of[token])), *known)
            self.ending[node] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is itself a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        last = [-1]  # the last token of each prefix, from the settled place on
        node = n = 0
        fits, after, ending = self._fits, self.next, self.ending
        for byte in piece:
            if (to := after.get(node << 8 | byte)) is None:
                to = self.step(node, byte)
            node = to
            n += 1
            for token, length in ending[node] or self.ends(node):
                if length <= n:
                    left = last[n - length]
                    if (known := fits.get(left + 1 << 32 | token)) is None:
                        known = self.fits(left, token)
                    if known:
                        last.append(token)
                        break
            else:
                raise ValueError("a byte is not in the vocabulary")
            if n >= SETTLED_EACH:
                last = self._emit(out, last, self._settled(last))
                n = len(last) - 1
        self._emit(out, last, n)
        return out

    def _settled(self, last: list[int]) -> int:
        """The last boundary behind every one from which a token may still grow."""
        live = {*range(max(0, len(last) - self.longest), len(last))}
        while len(live) > 1:
            at = max(live)
            live.discard(at)
            live.add(at - len(self.bytes_of[last[at]]))
        return live.pop()

    def _emit(self, out: list[int], last: list[int], upto: int) -> list[int]:
        """Writes the tokens before a boundary and forgets what is before it."""
        tokens, at = [], upto
        while at > 0:
            tokens.append(last[at])
            at -= len(self.bytes_of[last[at]])
        out += reversed(tokens)
        return last[upto:]


class Kept(dict):
    """Packed ids of the pieces met last: a young generation, which becomes the old one when it has taken ``KEPT_BYTES``."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.old: dict[str, bytes] = {}
        self.taken = 0

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            found = self.transducer.encode(piece.encode("utf-8", "replace"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            self.taken += 200 + 2 * len(piece) + len(ids)
            if self.taken > KEPT_BYTES:
                self.old = dict(self)
                self.clear()
                self.taken = 0
            self[piece] = ids
        return ids


class Encoder:
    """Texts to packed ids: pieces by the pattern, each through the transducer or as kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.kept = Kept(self.transducer)

    def text(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, self.pieces(text)))


class Utf8Machine:
    """Incremental UTF-8: a state is (code point so far, bytes still due, least and greatest next byte).

    Ill-formed sequences give one U+FFFD for each maximal part, as the Unicode standard recommends.
    """

    START = (0, 0, 0x80, 0xBF)
    #: First bytes with a narrower range for the second byte.
    NARROW = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    @classmethod
    def step(cls, state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
        point, due, lo, hi = state
        out = ""
        if due:
            if lo <= byte <= hi:
                point = point << 6 | byte & 0x3F
                return (cls.START, chr(point)) if due == 1 else ((point, due - 1, 0x80, 0xBF), "")
            out = "�"
        if byte < 0x80:
            return cls.START, out + chr(byte)
        for least, most, length in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)):
            if least <= byte <= most:
                return (byte & (0x3F >> length), length, *cls.NARROW.get(byte, (0x80, 0xBF))), out
        return cls.START, out + "�"


class StreamDecoder:
    """Ids in, text out, as far as it is complete; ``finish`` ends the stream.

    What is kept between two pushes is the sequence that the machine is within, three bytes at most; everything before
    it is complete and decoded at once.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.rest = b""

    def push(self, ids: list[int]) -> str:
        data = self.rest + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self._open(data[-3:])
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _open(tail: bytes) -> int:
        """Bytes at the end that are the begin of a sequence."""
        for n in range(len(tail), 0, -1):
            state = Utf8Machine.START
            whole = ""
            for byte in tail[-n:]:
                state, out = Utf8Machine.step(state, byte)
                whole += out
            if state != Utf8Machine.START and not whole:
                return n
        return 0

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


def _made(file: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(file), pattern)


def _encoder(file: str, pattern: str) -> Encoder:
    """What one worker keeps for encoding."""
    return kept(_made, file, pattern)


def _by_rank(file: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(file).items()}


def _tokens(file: str) -> dict[int, bytes]:
    return kept(_by_rank, file)


def _encoded(texts: pa.Array, file: str, pattern: str) -> list[bytes]:
    encode = _encoder(file, pattern).text
    return [encode(text) if text else b"" for text in texts.to_pylist()]


def _decoded(packed: list[bytes], bytes_of: dict[int, bytes]) -> list[str]:
    out = []
    for raw in packed:
        decoder = StreamDecoder(bytes_of)
        ids = np.frombuffer(raw, "<u4")
        parts = [decoder.push(ids[k : k + PUSH].tolist()) for k in range(0, len(ids), PUSH)]
        out.append("".join([*parts, decoder.finish()]))
    return out


def encode(docs: DataFrame, file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers."""
    tuned(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_encoded(batch.column(1), file, pattern), pa.binary())], [id_col, "ids"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, ids binary")


def checked(texts: pa.Array, packed: list[bytes], bytes_of: dict[int, bytes]) -> None:
    """Decodes the ids of each text and compares: ids that do not give the text back are an error."""
    for text, back in zip(texts.to_pylist(), _decoded(packed, bytes_of), strict=True):
        if back != (text or ""):
            raise ValueError(f"ids that decode to another text: {text!r:.80}")


def encode_arrays(docs: DataFrame, file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as an array, each text's decoded again and compared with it."""
    tuned(docs.sparkSession)

    def run(batches):
        for batch in batches:
            packed = _encoded(batch.column(1), file, pattern)
            checked(batch.column(1), packed, _encoder(file, pattern).transducer.bytes_of)
            n = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ids], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, file: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from what ``encode`` gives."""
    tuned(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_decoded(batch.column(1).to_pylist(), _tokens(file)), pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {type_of(encoded, id_col)}, text string")


def round_trip(docs: DataFrame, file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): both steps in one worker."""
    tuned(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = _encoded(batch.column(1), file, pattern)
            bytes_of = _encoder(file, pattern).transducer.bytes_of
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(_decoded(ids, bytes_of), pa.string())], [id_col, "ids", "text"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, ids binary, text string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    import public_tokenizers

    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = round_trip(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), file, pattern)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
