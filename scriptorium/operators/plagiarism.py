"""Copied and similar text: containment of shingles, TF-IDF, flagged sentences, the copied run.

Everything is a join on shared shingles (by 64-bit hashes) or terms, so pairs of
texts that share nothing are never made.  Texts and references come as (id, text); a reference's
``ref_order`` decides ties.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import text as T

SHINGLE = 5
LEAST_OVERLAP = 0.02
FLAG_FROM = 0.55
KEPT_MATCHES = 5
LEAST_RUN = 3
FRAGMENT = 240
#: Entries of all lists of texts that share a shingle, up to which they are broadcast (8 bytes each and a flag).
BROADCAST_SOURCES = 16_000_000
#: Up to so many shingles or terms of all references are broadcast.
BROADCAST_ROWS = 1_000_000
#: Tasks that count pairs of texts, for each shuffle partition.
PIECES = 16


def shingle_rows(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, n, shingle): the hash of each different shingle with how many its text has."""
    rows = T.once(T.once(df, *keys, _k=T.match_tokens(F.col(text))), *keys, _g=T.shingle_hashes(F.col("_k"), SHINGLE))
    return rows.select(*keys, F.size("_g").alias("n"), F.explode("_g").alias("shingle"))


def few(rows: DataFrame) -> DataFrame:
    """Rows of references, broadcast if there are few: what texts hold is then not shuffled."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def containment(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, n, ref_id, ref_order, shared): for each text and reference with any shingle in common."""
    left = shingle_rows(texts, "id")
    right = few(shingle_rows(refs, "ref_id", "ref_order").drop("n"))
    return left.join(right, "shingle").groupBy("id", "n", "ref_id", "ref_order").agg(F.count("*").alias("shared"))


def matches(pairs: DataFrame) -> DataFrame:
    """Pairs above the least overlap, with the overlap as a whole percentage."""
    share = F.col("shared") / F.col("n")
    return pairs.where(share > LEAST_OVERLAP).withColumn("overlap", T.percent(share))


def top_matches(pairs: DataFrame, k: int = KEPT_MATCHES) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("overlap"), "ref_order")
    return matches(pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sentence_rows(texts: DataFrame) -> DataFrame:
    """(id, sent, text, start, end, text_start) of all sentences."""
    return texts.select("id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "s")).select("id", "sent", "s.*")


def sharing(texts: DataFrame, refs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Texts without those none of whose sentences has a shingle of the references.

    A shingle of a sentence is one of its text, but for sentences of fewer tokens than a shingle, which are one
    themselves: if a reference is as short, all texts stay.
    """
    if not refs.where(F.size(T.match_tokens(F.col("text"))).between(1, SHINGLE - 1)).isEmpty():
        return texts
    met = shingle_rows(texts, "id").join(few(shingles.select("shingle").distinct()), "shingle", "left_semi")
    return texts.join(met.select("id").distinct(), "id", "left_semi")


def flagged_sentences(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, sent, start, end, text_start, text, ref_id, ref_order, overlap): sentences that a reference covers by 55 % or more; the best one, the first of equal."""
    right = few(shingle_rows(refs, "ref_id", "ref_order").drop("n"))
    texts = sharing(texts, refs, right)
    left = shingle_rows(sentence_rows(texts), "id", "sent")
    share = F.col("shared") / F.col("n")
    order = Window.partitionBy("id", "sent").orderBy(F.desc("share"), "ref_order")
    best = left.join(right, "shingle").groupBy("id", "sent", "n", "ref_id", "ref_order").agg(F.count("*").alias("shared")).withColumn("share", share)
    best = best.withColumn("rank", F.row_number().over(order)).where((F.col("rank") == 1) & (F.col("share") >= FLAG_FROM))
    # cut again, of the texts that have any
    sentences = sentence_rows(texts.join(best.select("id").distinct(), "id", "left_semi"))
    return best.join(sentences, ["id", "sent"]).select("id", "sent", "start", "end", "text_start", "text", "ref_id", "ref_order", T.percent(F.col("share")).alias("overlap"))


def common_runs(sentences: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, sent, first, ref_first, length): the longest run of tokens that a sentence (id, sent, ref_id, tokens) and its reference (ref_id, ref_tokens) share, the first found of equal ones.

    Runs are seeded on shared runs of ``LEAST_RUN`` tokens (all of a shorter sentence), neighbours on a diagonal put together;
    a reference's places are made once, however many sentences it is compared with.
    """
    k = F.least(F.size("tokens"), F.lit(LEAST_RUN))
    own = sentences.where(F.size("tokens") > 0).withColumn("k", k)
    seeds = F.coalesce(*[F.when(F.col("k") == n, T.gram_hashes(F.col("tokens"), n)) for n in range(1, LEAST_RUN + 1)])
    left = own.select("id", "sent", "ref_id", "k", F.posexplode(seeds).alias("i", "seed"))
    needed = own.select("ref_id", "k").distinct()
    right = refs.join(needed, "ref_id").select("ref_id", "k", F.posexplode(F.coalesce(*[F.when(F.col("k") == n, T.gram_hashes(F.col("ref_tokens"), n)) for n in range(1, LEAST_RUN + 1)])).alias("j", "seed"))
    met = left.join(right, ["ref_id", "k", "seed"]).withColumn("diagonal", F.col("i") - F.col("j"))
    along = Window.partitionBy("id", "sent", "ref_id", "diagonal").orderBy("i")
    islands = met.withColumn("island", F.col("i") - F.row_number().over(along))
    runs = islands.groupBy("id", "sent", "ref_id", "k", "diagonal", "island").agg(F.count("*").cast("int").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"))
    order = Window.partitionBy("id", "sent").orderBy(F.desc("n"), "i", "j", "ref_id")
    best = runs.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return best.select("id", "sent", (F.col("i") - F.col("n") + 1).alias("first"), (F.col("j") - F.col("n") + 1).alias("ref_first"), (F.col("n") + F.col("k") - 1).alias("length"))


def token_spans(text: Column) -> Column:
    """(start, end) of each token in the text as it stands."""
    other = r"[^\p{L}\p{N}_]+"
    pieces = F.filter(T.pieces_with_offsets(text, f"{T.TOKEN}|{other}"), lambda p: p["raw"].rlike(rf"^{T.TOKEN}"))
    return F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.char_length(p["raw"])).alias("end")))


def located(flagged: DataFrame, refs: DataFrame) -> DataFrame:
    """Flagged sentences with the copied run: where it is in the text, its words, and the reference's fragment; runs of three tokens at least."""
    needed = refs.join(flagged.select("ref_id").distinct(), "ref_id", "left_semi")
    sources = T.once(needed, "ref_id", ref_text=F.col("text"), ref_tokens=T.match_tokens(F.col("text")), ref_at=token_spans(F.col("text"))).where(F.size("ref_tokens") == F.size("ref_at"))
    spans = T.once(flagged, "id", "sent", "ref_id", "text", "text_start", tokens=T.match_tokens(F.col("text")), at=token_spans(F.col("text"))).where(F.size("tokens") == F.size("at"))
    runs = common_runs(spans, sources).where(F.col("length") >= LEAST_RUN)
    found = spans.join(runs, ["id", "sent"]).join(sources.select("ref_id", "ref_text", "ref_at"), "ref_id")
    begin, end = F.get("at", F.col("first"))["start"], F.get("at", F.col("first") + F.col("length") - 1)["end"]
    ref_begin, ref_end = F.get("ref_at", F.col("ref_first"))["start"], F.get("ref_at", F.col("ref_first") + F.col("length") - 1)["end"]
    fragment = F.substring("ref_text", ref_begin + 1, ref_end - ref_begin)
    short = F.concat(F.regexp_replace(F.substring(fragment, F.lit(1), F.lit(FRAGMENT)), rf"{T.SPACE}+$", ""), F.lit("…"))
    return found.select(
        "id", "sent", "ref_id", (F.col("text_start") + begin).alias("copy_start"), (F.col("text_start") + end).alias("copy_end"),
        F.substring("text", begin + 1, end - begin).alias("copy_text"), F.col("length").alias("matched_words"),
        F.when(F.char_length(fragment) > FRAGMENT, short).otherwise(fragment).alias("source_fragment"),
    )


def document_frequencies(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.array_distinct(T.match_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def topical(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, topical): the greatest cosine with any reference, as a whole percentage; a text counts among the corpus of its own weights."""
    n = refs.count() + 1
    terms = lambda df, key: T.once(df, key, _k=T.match_tokens(F.col("text"))).select(key, F.size("_k").alias("n"), F.explode("_k").alias("term")).groupBy(key, "n", "term").agg(F.count("*").alias("c"))
    base = few(document_frequencies(refs))
    own = terms(texts, "id").join(base, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)) + 1)
    idf = lambda df: F.ln(F.lit(float(n + 1)) / (df + 1)) + 1.0
    own = own.select("id", "term", (F.col("c") / F.col("n") * idf(F.col("df"))).alias("w"), idf(F.col("df")).alias("idf"), idf(F.col("df") - 1).alias("idf_without"))
    theirs = few(terms(refs, "ref_id").select("ref_id", "term", (F.col("c") / F.col("n")).alias("tf")))
    plain = theirs.join(base, "term").groupBy("ref_id").agg(F.sum(F.pow(F.col("tf") * idf(F.col("df")), 2)).alias("norm"))
    met = own.join(theirs, "term").groupBy("id", "ref_id").agg(
        F.sum(F.col("w") * F.col("tf") * F.col("idf")).alias("dot"),
        F.sum(F.pow(F.col("tf") * F.col("idf"), 2) - F.pow(F.col("tf") * F.col("idf_without"), 2)).alias("more"),
    )
    norms = own.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("own"))
    cosine = F.col("dot") / F.sqrt(F.col("own") * (F.col("norm") + F.col("more")))
    best = met.join(plain.withColumn("norm", F.col("norm")), "ref_id").join(norms, "id").groupBy("id").agg(F.max(cosine).alias("cosine"))
    return texts.select("id").join(best, "id", "left").select("id", F.coalesce(T.percent(F.col("cosine")), F.lit(0)).alias("topical"))


def shared_lists(texts: DataFrame) -> DataFrame:
    """(met, w, key): the different lists of texts (peer, ref_id, n) that share a shingle, one of the batch among them, each with how many shingles have it."""
    rows = shingle_rows(texts, "ref_id", "peer").repartition("shingle")
    lists = rows.groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("peer", "ref_id", "n"))).alias("met"))
    lists = lists.where((F.size("met") > 1) & F.element_at("met", -1)["peer"]).groupBy("met").agg(F.count("*").alias("w"))
    return lists.withColumn("key", F.xxhash64("met", "w"))


def batch_matches(texts: DataFrame, corpus: DataFrame | None = None, k: int = KEPT_MATCHES) -> DataFrame:
    """Each text against all others (and a corpus, which comes first among equals): the ``k`` best, with whether the source is one of the batch.

    Shingles that the same texts share are met together, as one list of texts. A text's lists are put in one task, where what
    they hold is counted: no pair of texts is shuffled.
    """
    own = texts.select(F.col("id").alias("ref_id"), "text", F.lit(True).alias("peer"))
    if corpus is None:
        others = own
    else:
        others = corpus.select("ref_id", "text", F.lit(False).alias("peer")).unionByName(own)
    lists = shared_lists(others).persist(StorageLevel.DISK_ONLY)
    sources = lists.select("key", F.col("met.ref_id").alias("ids"), F.col("met.peer").alias("peers"))
    if (lists.agg(F.sum(F.size("met"))).first()[0] or 0) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    pieces = PIECES * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = lists.select("key", "w", F.explode("met").alias("m")).where("m.peer").select(F.col("m.ref_id").alias("id"), F.col("m.n").alias("n"), "key", "w")
    met = left.repartition(pieces, "id").join(sources, "key").select("id", "n", "w", F.inline(F.arrays_zip("ids", "peers"))).withColumnsRenamed({"ids": "ref_id", "peers": "peer"})
    met = met.where(~(F.col("peer") & (F.col("id") == F.col("ref_id"))))
    pairs = met.groupBy("id", "n", "ref_id", "peer").agg(F.sum("w").alias("shared"))
    if corpus is None:
        return top_matches(pairs.withColumn("ref_order", F.struct("peer", "ref_id")), k)
    kind = corpus.schema["ref_order"].dataType
    order = corpus.groupBy("ref_id").agg(F.first("ref_order").alias("o")).withColumn("peer", F.lit(False))
    pairs = matches(pairs).join(order, ["ref_id", "peer"], "left")
    return top_matches(pairs.withColumn("ref_order", F.struct("peer", F.when(~F.col("peer"), F.col("o")).cast(kind).alias("ref_order"), "ref_id")).drop("o", "overlap"), k)
