from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import weakref
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import ann, bpe, chat, decontaminate, fingerprints, jaccard, passages, quality, registry, suffixarray, textcore, tokenfile, urlfilter
from scriptorium.llm.eliasfano import EliasFano
from scriptorium.llm.runtime import Scratch
from tests.helpers import DATA, agree

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "uno"), (4, "uno"), (5, "Ünö DOS"), (6, LONG), (7, LONG), (None, LONG), (8, "x" * 50_000)]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that the operators use inside."""
    rows = [(i, t, "a", 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string, _d int, hit int, n int")


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    agree(spark, registry.QUERIES[name], registry.ORACLES[name])


def near_copies(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    out: list[str | None] = [None, "", "uno"]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 14, 40, 120]))]
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def grams(text: str | None, n: int) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def chains(seed: int) -> list[str]:
    """Groups whose members are each a near copy of the one before, and passages that many texts share, ids shuffled."""
    rng = random.Random(seed)
    out = []
    for length in (30, 60):
        text = [f"c{rng.randrange(500)}" for _ in range(length)]
        for _ in range(25):
            text = list(text)
            text[rng.randrange(length)] = f"c{rng.randrange(500)}"
            out.append(" ".join(text))
    passage = [f"p{k}" for k in range(40)]
    for _ in range(40):
        out.append(" ".join(passage + [f"c{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 12, 30]))]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("n", "t", "meeting", "dense", "of"), [(3, Fraction(9, 10), 1024, 64, near_copies), (5, Fraction(4, 5), 3, 0, near_copies), (5, Fraction(4, 5), 1024, 64, chains), (5, Fraction(4, 5), 60, 0, chains), (3, Fraction(9, 10), 4, 1, chains)])
def test_jaccard_components(spark, monkeypatch, n, t, meeting, dense, of):
    monkeypatch.setattr(jaccard, "MEETING", meeting)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "SMALL", 12 if dense else 1)
    texts = of(n)
    sets = [grams(x, n) for x in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    found = jaccard.linked_groups(documents(spark, texts), Scratch(spark, "t"), shingle=n, similarity=t).collect()
    assert {r._d: (r.n, r.component) for r in found} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_a_large_place_of_one_label_gets_no_hub(spark):
    rows = [(0, x, 100, 20, x < 40, 1 if x < 40 else 40, [7], bytes(jaccard.BITS // 8)) for x in range(1, 41)]
    members = spark.createDataFrame(rows, "hub long, x long, n long, apart long, linked boolean, label long, prefix array<long>, bits binary")
    found = jaccard.met(members, Fraction(4, 5), 8, False).collect()
    assert {(*sorted((r.a, r.b)), r.kind) for r in found} == {(x, 40, jaccard.NEAR) for x in range(1, 40)}


def test_jaccard_with_common_shingles_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 1)
    test_jaccard_components(spark, monkeypatch, 5, Fraction(4, 5), 60, 0, chains)
    assert list(jaccard._common_last(np.arange(5, dtype=np.uint64), (np.array([1, 3], dtype=np.uint64), np.array([9, 4])))) == [0, 2, 4, 3, 1]


@pytest.mark.parametrize("first", [None, "text"])
def test_jaccard_of_ids_with_an_empty_row(spark, first):
    rng = random.Random(7)
    rows, expected = [], set()
    for k in range(0, 40, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        own = [(k, " ".join(base)), (k, rng.choice([None, "", " "]))]
        rows += [*(own if first else own[::-1]), (k + 1, " ".join([*base[:-1], "zz"]))]
        expected |= {(k, k), (k + 1, k)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.linked_groups(docs, Scratch(spark, "t"), shingle=3, similarity=Fraction(9, 10)).where("n > 0").collect()
    assert {(r._d, r.component) for r in found} == expected


def removed(texts, window=50):
    """What is left of each text without words in windows that start in a text with a smaller number."""
    seen: dict[tuple, int] = {}
    out = {}
    for i, text in enumerate(texts):
        w = (text or "").split()
        gone = set()
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s : s + window]), i) < i:
                gone.update(range(s, s + window))
        out[i] = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    return out


def passages_of(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(30)] + shared[: 40 + 5 * k] + [word() for _ in range(30)]) for k in range(5)] + [" ".join(["same"] * 300)] * 3
    common = [word() for _ in range(120)]
    for _ in range(30):  # passages that begin and end anywhere, some with a word changed
        lo = rng.randrange(60)
        part = common[lo : lo + rng.randrange(30, 70)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = word()
        texts.append(" ".join([word() for _ in range(rng.randrange(20))] + part + [word() for _ in range(rng.randrange(20))]))
    return [*texts, None, "", texts[0], " ".join(["a", "b"] * 60)]


@pytest.mark.parametrize("held", [8192, 3])
def test_passages_by_suffixes(spark, monkeypatch, held):
    monkeypatch.setattr(suffixarray, "HELD", held)
    texts = passages_of(3)
    source = passages.keyed(documents(spark, texts), "doc_id", "text")
    found = suffixarray.digested(source, suffixarray.repeats(source, Scratch(spark, "t"))).collect()
    assert {r.doc_id: r.kept_sha256 for r in found} == removed(texts)


def test_common_starts_of_sorted_suffixes():
    rows = [np.array(x, ">u8").tobytes() for x in ([1, 2], [1, 2, 0], [1, 2, 3], [1, 3, 3], [2])]
    assert suffixarray.common_starts(*suffixarray._matrix(rows, 3)).tolist() == [0, 2, 2, 1, 0]


def test_passages_by_an_index_that_is_opened_again(spark, tmp_path):
    texts = passages_of(4)
    source = passages.keyed(documents(spark, texts), "doc_id", "text")
    marks, history = None, None
    for k, batch in enumerate(fingerprints.batches_of(source, 5)):
        index = fingerprints.FingerprintIndex(Scratch(spark, "t"), f"file://{tmp_path}/index", buckets=3 if not k else 7)  # as a later application does
        assert (index.n, index.buckets) == (k, 3)
        own = index.ingest(batch, history)
        marks = own if marks is None else marks.unionByName(own)
        history = batch if history is None else history.unionByName(batch)
    assert sorted((r.kind, r.tier) for r in index.runs) == [("run", 0), ("run", 2), ("windows", 0), ("windows", 2)]
    assert {r.doc_id: r.kept_sha256 for r in suffixarray.digested(source, marks).collect()} == removed(texts)
    with index.in_order():
        merged = index.merged(*[r for r in index.runs if r.kind == "run"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged  # runs lie in buckets
    assert index.table(index.runs[0]).groupBy("key", "sub").count().where("count > 1").isEmpty()


def test_index_of_odd_rows(spark, odd, tmp_path):
    index = fingerprints.FingerprintIndex(Scratch(spark, "t"), f"file://{tmp_path}/odd")
    source = passages.keyed(odd, "doc_id", "text")
    marks = index.ingest(source.where("_d < 7"), None)
    marks = marks.unionByName(index.ingest(source.where("false"), source.where("_d < 7"))).unionByName(index.ingest(source.where("_d >= 7"), source.where("_d < 7")))
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in suffixarray.digested(source, marks).collect())
    assert rows == [(False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 0, 0), (False, 4, 1, 0), (False, 4, 1, 0), (False, 5, 2, 0), (False, 6, 30_000, 0), (False, 7, 30_000, 30_000), (False, 8, 1, 0), (True, 0, 30_000, 30_000)]


def test_decontamination_in_blocks(spark):
    items = spark.createDataFrame([(str(i), " ".join(f"b{i}x{k}" for k in range(12))) for i in range(6)] + [("s", "kurz"), (None, "b9 z"), ("e", "")], "item_id string, text string")
    docs = documents(spark, ["pre " + " ".join(f"b{i}x{k}" for k in range(1, 11)) + " post kurz" for i in range(6)] + ["nichts", None, "B9 Z"])
    rows = [{r.doc_id: (r.n_words, [tuple(h) for h in r.hit], r["items"]) for r in decontaminate.contamination(docs, items, block_bytes=size).collect()} for size in (1 << 20, 120)]
    assert rows[0] == rows[1] and rows[0][0] == (13, [(1, 11), (12, 13)], ["0", "s"]) and rows[0][7] == (0, [], []) and rows[0][8] == (2, [(0, 2)], [])
    assert [r.doc_id for r in decontaminate.uncontaminated(docs, items).collect()] == [6, 7]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700):
        values = np.sort(rng.integers(0, 10**6, n))
        coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
        assert coded.values().tolist() == values.tolist() and [coded[i] for i in range(n)] == values.tolist()
        some = rng.permutation(n)[: n // 2 + 1]
        assert coded.at(some).tolist() == values[some].tolist() and coded.at(np.arange(n)).tolist() == values.tolist()


@pytest.mark.parametrize(("name", "as_text"), [("word_bpe_49k.json", False), ("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_token_files_match_the_library(spark, monkeypatch, name, as_text):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    texts = ["", None, "Hello, WORLD's 123 ½ ñ é 漢字 \x1c x\xa0y", "ß İ Σ</w> <|endoftext|> a<|startoftext|>b \n <|endoftext|>", LONG, *[f"doc {i} thhaen's" for i in range(40)]]
    file = P.path(name)
    library = Tokenizer.from_file(file)
    if as_text:
        library.encode_special_tokens = True
    made = tokenfile.write(documents(spark, texts), Scratch(spark, "t"), file, shards=3, specials_as_text=as_text)
    rows = {r._id: r for r in made.documents().collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, zlib.crc32(rows[i].ids)) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_which_tokenizers_encode_word_by_word():
    specs = {name: json.load(open(P.path(name), encoding="utf-8")) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    assert tokenfile.split_of(specs["word_bpe_49k.json"]).startswith("'s|") and tokenfile.split_of(specs["byte_bpe_50k.json"]) is None
    other = json.loads(json.dumps(specs["word_bpe_49k.json"]))
    other["normalizer"]["normalizers"].pop()
    assert tokenfile.split_of(other) is None and tokenfile.split_of({}) is None


def test_one_document_of_the_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 12000)
    rows = [(i, f"doc {i} thhaen's " * (i % 7)) for i in range(900)] + [(5, "twice"), (None, "none"), (None, "")]
    files = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), P.path("word_bpe_49k.json"), shards=2)
    whole = sorted(tuple(r) for r in files.documents().where("_id is not null").collect())
    assert files.blocks.agg(F.max("n_docs")).first()[0] > 256
    for i in (0, 5, 255, 256, 257, 450, 898, 899, 900):
        assert sorted(tuple(r) for r in files.document(i).collect()) == [r for r in whole if r[0] == i]


def test_a_worker_gives_back_its_encoder_when_texts_are_read_by_another_operator():
    file, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    held = weakref.ref(bpe._encoder(file, pattern))
    assert bpe._encoder(file, pattern) is held()
    assert [(lo, hi) for lo, hi, _, _ in textcore.slices(pa.array(["uno", None]))] == [(0, 2)] and held() is None


def test_a_worker_gives_back_its_tokenizer_when_it_packs():
    file = P.path("word_bpe_49k.json")
    held = weakref.ref(tokenfile._worker(file, False, False))
    assert tokenfile._worker(file, False, False) is held()
    assert list(tokenfile._pack(2)(iter([]))) == [] and held() is None


def test_ids_of_another_text_are_an_error():
    coder = bpe._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).transducer
    packed = [np.array(coder.encode(t.encode()), "<u4").tobytes() for t in ("año", "", "")]
    bpe.checked(pa.array(["año", None, ""]), packed, coder.bytes_of)
    with pytest.raises(ValueError, match="another text"):
        bpe.checked(pa.array(["ano", None, ""]), packed, coder.bytes_of)


def test_byte_bpe_matches_the_library(spark, monkeypatch):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "the", "ing", " ", "é", "\n", "1", "漢", "😀", "zz", "..."]) for _ in range(40)) for _ in range(200)]
    coder = bpe.Transducer(ranks)
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert all(coder.encode(t.encode()) == whole.encode_ordinary(t) for t in texts)
    rows = {r.doc_id: r for r in bpe.round_trip(documents(spark, [*texts, None, ""]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    monkeypatch.setattr(bpe, "SETTLED_EACH", 150)
    long = ["".join(rng.choice(["a", "the", "ing", "é", "漢", "zz", "x"]) for _ in range(900)) for _ in range(20)]
    assert all(coder.encode(t.encode()) == whole.encode_ordinary(t) for t in [*texts, *long, "z" * 2500])
    monkeypatch.setattr(bpe, "KEPT_BYTES", 5000)
    monkeypatch.setattr(bpe, "PAIR_BYTES", 5000)
    monkeypatch.setattr(bpe, "STATE_BYTES", 5000)
    own = bpe.Encoder(ranks, P.PATTERN)
    assert all(np.frombuffer(own.text(x), "<u4").tolist() == library.encode_ordinary(x) for x in texts)
    monkeypatch.setattr(bpe, "PUSH", 7)
    for i, text in enumerate([*texts, "", ""]):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == library.encode_ordinary(text) and rows[i].text == text
    decoder = bpe.StreamDecoder(coder.bytes_of)
    ids = [rng.randrange(256) for _ in range(500)]
    assert "".join(decoder.push([i]) for i in ids) + decoder.finish() == b"".join(coder.bytes_of[i] for i in ids).decode("utf-8", "replace")


def test_quality_on_held_out_labels(spark):
    rows = registry.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = [r for r in rows.collect() if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert rows.where("score is null or score < 0 or score > 1").isEmpty()


def test_quality_against_a_plain_descent(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["uno", "dos", "TRES", "4", "!!", "x1"][: 3 + 3 * (i % 2)]) for _ in range(rng.randrange(1, 30))) for i in range(40)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(40, 1), (99, 0), (None, 1), (31, None)], "doc_id long, quality int")
    docs = documents(spark, texts)
    found = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, bits=10)).collect()}

    def places(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality.features(data, np.array([0, len(data)]), 10)[0].tolist()

    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    rows = [(i, i % 2) for i in range(30)] + [(40, 1)]
    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            own = places(texts[rows[k][0]])
            x = {p: quality.SCALE * own.count(p) / len(own) for p in own} | {"bias": 1.0}
            w = {p: weight(p) for p in x}
            error = 1 / (1 + math.exp(-sum(w[p] * x[p] for p in x))) - rows[k][1]
            for p, v in x.items():
                g, before = error * v, n.get(p, 0.0)
                n[p] = before + g * g
                z[p] = z.get(p, 0.0) + g - (math.sqrt(n[p]) - math.sqrt(before)) / quality.ALPHA * w[p]
    for i, text in enumerate(texts):
        own = places(text)
        dot = weight("bias") + (quality.SCALE * sum(weight(p) for p in own) / len(own) if own else 0.0)
        assert abs(found[i] - 1 / (1 + math.exp(-dot))) < 1e-4
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5} and quality.score(docs.where("false"), none).isEmpty()
    assert quality.accepted(docs.where("false"), quality.fit(docs.where("false"), labels)).isEmpty()


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((600, 16))
    vectors[100:140] = vectors[5]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None] * 8), (1080, [1.0] * 3), (None, [1.0] * 16)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(3, vectors[3].tolist())] + odd, "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in ann.search(rows, Scratch(spark, "t"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20)) and all(len(v) == 20 for v in found.values())
    hits = 0
    for q, best in found.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        true = np.lexsort((np.arange(600), -scores))[:20]
        hits += len({v for v, _ in best} & set(true.tolist()))
        assert np.allclose([s for _, s in best], scores[[v for v, _ in best]])
    assert hits / (20 * len(found)) >= 0.9
    assert ann.search(rows.where("vec_id < 0"), Scratch(spark, "t"), F.lit(True)).isEmpty()


@pytest.mark.parametrize("kind", ["lengths", "clusters", "axes", "ties"])
def test_search_is_exact_on_other_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "LEAST_PART", 256)
    monkeypatch.setattr(ann, "GROUP", 128)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((900, 24))
    if kind == "lengths":
        vectors *= rng.lognormal(0, 1, 900)[:, None]
    elif kind == "clusters":
        vectors = rng.standard_normal((9, 24))[rng.integers(0, 9, 900)] + 0.1 * vectors
    elif kind == "axes":
        vectors /= np.arange(1, 25)
    else:
        vectors = rng.integers(0, 2, (900, 24)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(20, (2 * vectors[20] + 1).tolist())], "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in ann.search(rows, Scratch(spark, "t"), F.col("vec_id") % 20 == 0).where("query_id != 20").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    every = [*enumerate(vectors), (20, 2 * vectors[20] + 1)]
    for q in [q for q in range(0, 900, 20) if q != 20]:
        scores = [(-np.cumsum(vectors[q] * v)[-1], i) for i, v in every if i != q]
        assert found[q] == [(i, -s) for s, i in sorted(scores)[:20]]


def test_chat_windows_round_trip(spark):
    rng = random.Random(1)
    pieces = ["a", "\\", "<|im_end|>", "</s>", "[INST]", "<", "|", "\n", "ñ", "<<SYS>>", " "]
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None]) if t else "system", "".join(rng.choice(pieces) for _ in range(rng.randrange(60))) or None) for c in (1, 2, None) for t in range(150)]
    turns += [(1, 3, "user", "tie"), (1, None, "user", "null")]
    made = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), Scratch(spark, "t"), budget=200, history_budget=40)
    rows = made.select("*", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("masked")).orderBy("conv", "window").collect()
    for conv in (1, 2, None):
        order = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        own = [r for r in rows if r.conv == conv]
        assert [(x.role, x.text) for r in own for x in r.turns[r.n_repeated :]] == [(t[2] or "", t[3] or "") for t in order]
        assert "".join(r.masked for r in own) == "".join(t[3] or "" for t in order if t[2] == "assistant")
        assert all(r.tokens <= 200 or (r.n_new, r.n_repeated) == (1, 0) for r in own)
        sizes = [sum(-(-len(f"<|im_start|>{x.role}<|im_sep|>{chat_escaped(x.text)}<|im_end|>") // 4) for x in r.turns[r.n_repeated :]) for r in own]
        assert sum(a + b <= (200 - 40) // 2 for a, b in zip(sizes, sizes[1:], strict=False)) <= len(own) // 3  # windows are filled, but at the ends of stretches


def chat_escaped(text):
    out = text.replace("\\", "\\\\")
    for control in chat.CONTROL:
        out = out.replace(control, f"{control[0]}\\{control[1:]}")
    return out


def test_chat_windows_keep_the_budget(spark):
    turns = [(1, 0, "system", "s" * 600)] + [(1, k, "user" if k % 2 else "assistant", "x" * size) for k, size in enumerate([100, 1400, 5, 5, 5000, 20, 1400, 1400, 30, 2500, 40] * 3, 1)]
    turns += [(2, 0, "system", "s" * 6000), (2, 1, "assistant", "y"), (3, None, None, None), (4, 0, "assistant", "z" * 100_000)]
    rows = spark.createDataFrame([(*t, 1, 2, "n") for t in turns], "conv_id long, turn long, role string, text string, place int, window int, tokens string")
    made = chat.windows(rows, Scratch(spark, "t"), budget=1024).select("*", chat.parsed(F.col("formatted")).alias("turns")).orderBy("conv", "window").collect()
    assert all(r.tokens <= 1024 or (r.n_new, r.n_repeated) == (1, 0) for r in made)
    assert {r.conv: sum(x.n_new for x in made if x.conv == r.conv) for r in made} == {1: 34, 2: 2, 3: 1, 4: 1}
    assert all(r.turns[0].role == "system" for r in made if r.conv == 1 and r.tokens <= 1024)
    words = chat.windows(rows, Scratch(spark, "t"), budget=8, history_budget=2, count=lambda p: F.size(F.split(p, "x{50}"))).collect()
    assert all(r.tokens <= 8 or (r.n_new, r.n_repeated) == (1, 0) for r in words)
    assert chat.windows(rows.where("false"), Scratch(spark, "t")).isEmpty()


def test_url_rules(spark):
    urls = [None, "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://com/en/", "x://xcom/en/", "x://example.net/de/8", "x://a.b.net/de/1", "x://org", "x://org/es/"]
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string"), broadcast_bytes=0).collect()}
    assert rows[0] == rows[1] == rows[2] == ("", "", None, "allow")
    assert rows[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and rows[4][2:] == ("com/en/", "block") and rows[5][2:] == (None, "allow")
    assert rows[6][2:] == ("example.net/de/8", "block") and rows[7][2:] == ("net/de/", "allow") and rows[8] == ("org", "", None, "allow") and rows[9][2:] == ("org/es/", "block")


def test_odd_rows_and_clashing_columns(spark, odd):
    ids = sorted(i for i, _ in ODD if i is not None)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    items = spark.createDataFrame([("a", "ünö dos")], "item_id string, text string")
    of = lambda df, c="doc_id": sorted(r[c] for r in df.collect() if r[c] is not None)
    file, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    model = quality.fit(odd, labels)
    assert of(quality.score(odd, model)) == of(bpe.encode(odd, file, pattern)) == of(decontaminate.contamination(odd, items)) == ids
    assert of(jaccard.linked_groups(odd, Scratch(spark, "t")), "_d") == ids
    assert of(suffixarray.dedup_passages(odd, Scratch(spark, "t"))) == ids
    assert quality.accepted(odd, model, least=0.0).columns == jaccard.one_of_each_group(odd, Scratch(spark, "t")).columns == decontaminate.uncontaminated(odd, items).columns == odd.columns
    kept = {r.doc_id: r.text for r in suffixarray.dedup_passages(odd.where("doc_id > 5"), Scratch(spark, "t")).collect()}
    assert kept[6] == LONG and kept[7] == ""
    none = odd.where("false")
    assert jaccard.linked_groups(none, Scratch(spark, "t")).isEmpty() and suffixarray.dedup_passages(none, Scratch(spark, "t")).isEmpty()
    assert tokenfile.write(none, Scratch(spark, "t"), P.path("word_bpe_49k.json")).documents().isEmpty()


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < len(docs)
    assert all(len(r.ids) == r.n_tokens for r in out.collect())
