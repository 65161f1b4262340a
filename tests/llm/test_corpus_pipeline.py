"""The pipeline against its stages in plain Python; only the classifier's scores are taken from the operator."""

from __future__ import annotations

import base64
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from scriptorium.llm import quality
from tests.helpers import DATA

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, ALNUM = re.compile(r"[^\x20\t-\r]+"), re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def windows(words: list[str], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def least_of_groups(texts: dict[int, str]) -> set[int]:
    """Ids that are the least of those linked by a similarity of 0.8 over shingles of 5 words."""
    sets = {}
    for i, text in texts.items():
        w = WORD.findall(text.translate(ASCII_LOWER))
        sets[i] = windows(w, min(5, len(w))) if w else set()
    group = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {k: x if v == y else v for k, v in group.items()}
    return set(group.values())


def cut(texts: dict[int, str]) -> dict[int, list[str]]:
    """Words left where windows of 50 that a smaller id has are gone."""
    first: dict[tuple, int] = {}
    out = {}
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        gone: set[int] = set()
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), i) < i:
                gone.update(range(s, s + 50))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_pipeline_agrees_with_plain_stages(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if scores[r.doc_id] >= 0.7}
    kept = least_of_groups(texts)
    words = cut({i: texts[i] for i in kept})
    items = [ALNUM.findall((r.text or "").translate(ASCII_LOWER)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = set().union(*(windows(w, min(10, len(w))) for w in items if w))
    sizes = {len(w) for w in leaks}
    clean = {i: w for i, w in words.items() if not any(windows(ALNUM.findall(" ".join(w).translate(ASCII_LOWER)), n) & leaks for n in sizes)}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    found = {i: library.decode(x) for i, x in ids.items()}
    counts = [docs.count(), len(texts), len(kept), len(clean)]
    assert counts == sorted(set(counts), reverse=True)
    assert {i: WORD.findall(t) for i, t in found.items()} == clean
    assert ids == {i: library.encode_ordinary(t) for i, t in found.items()}
    uncut = [i for i in clean if clean[i] == WORD.findall(texts[i])]
    assert all(found[i] == texts[i] for i in uncut)


def test_stages_of_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 977}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "uno"), (4, "uno"), (5, "DOS tres"), (6, long), (7, long), (None, long)]
    docs = spark.createDataFrame([(i, t, "es", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("a", "UNO"), ("b", None), (None, "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df=docs: stages[name](spark, df, str(tmp_path))
    kept = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert run("quality classifier").columns == docs.columns and run("quality classifier").isEmpty()
    assert kept(run("n-gram Jaccard join")) == sorted([r for r in rows if r[0] != 7], key=str)
    cut = {r.doc_id: (r.text, r.n_chars) for r in run("suffix-array dedup").collect()}
    assert (cut[6], cut[7], cut[None], cut[4]) == ((long, len(long)), ("", 0), ("", 0), ("uno", 3)) and len(cut) == 8
    assert kept(run("benchmark decontamination")) == sorted([r for r in rows if r[0] != 4], key=str)
    found = {r.doc_id: r.n_tokens for r in run("byte-level BPE encoding and decoding").collect()}
    assert found[1] == found[2] == 0 and found[4] > 0 and len(found) == 8
    assert all(run(name, docs.where("false")).isEmpty() for name in stages)
