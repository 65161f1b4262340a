"""Registered queries of the analyses: each runs over its whole tables, with its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import evaluation, learning, localize, plagiarism, segments, signals, verdict
from scriptorium.operators.features import FEATURE_ORDER, RAW, featurize
from scriptorium.plans import engine
from scriptorium.plans import oracles as O
from scriptorium.session import spread
from scriptorium.sources import documents as sources
from scriptorium.sources import store

#: Pieces of the documents for each core: texts take long, and one that takes longest should not be left to the end.
PIECES = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows, PIECES) if name == "documents" else rows


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of ``documents``, normalised."""
    return T.once(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", text=T.normalized(F.col("text")))


def chats(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): the turns of each conversation as paragraphs."""
    turns = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return T.once(turns.withColumnRenamed("conv_id", "id"), "id", text=T.normalized(F.array_join(F.col("t.text"), "\n\n")))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """``benchmark`` as references, in the order of their ids."""
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("ref_id"), F.col("item_id").alias("ref_order"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), "text")


def six(c):
    return F.round(c, 6)


@query(f"WITH {O.DOCS} SELECT id, length(t) AS n_chars, md5(t) AS digest, len({O.paragraphs('t')}) AS n_paragraphs FROM d")
def text_normalize(spark, d):
    return docs(spark, d).select("id", F.char_length("text").alias("n_chars"), F.md5("text").alias("digest"), F.size(T.paragraphs(F.col("text"))).alias("n_paragraphs"))


@query(f"WITH {O.DOCS} SELECT id, {O.n_words('t')} AS words, len(regexp_extract_all(t, '{O.TOKEN}')) AS tokens, len({O.match_tokens('t')}) AS match_tokens, md5(array_to_string({O.match_tokens('t')}, ' ')) AS digest FROM d")
def token_counts(spark, d):
    k = T.match_tokens(F.col("text"))
    return docs(spark, d).select("id", T.n_words(F.col("text")).alias("words"), F.size(T.tokens(F.col("text"))).alias("tokens"), F.size(k).alias("match_tokens"), F.md5(F.array_join(k, " ")).alias("digest"))


@query(f'WITH {O.DOCS}, {O.sentence_places()} SELECT id, sent, start, "end", text_start, md5(text) AS digest FROM sp')
def sentence_split(spark, d):
    return plagiarism.sentence_rows(docs(spark, d)).select("id", "sent", "start", "end", "text_start", F.md5("text").alias("digest"))


@query(f"WITH {O.DOCS}, {O.features('d', 'id')} SELECT id, {', '.join(f'round({k}, 6) AS {k}' for k in FEATURE_ORDER)}, {', '.join(RAW)} FROM f")
def feature_table(spark, d):
    f = featurize(docs(spark, d))
    return f.select("id", *[F.round(f"f.{k}", 6).alias(k) for k in FEATURE_ORDER], *[F.col(f"f.{k}").alias(k) for k in RAW])


@query(f"WITH {O.CHATS}, {O.features('d', 'id')} SELECT id, {', '.join(f'round({k}, 6) AS {k}' for k in FEATURE_ORDER)}, {', '.join(RAW)} FROM f")
def conversation_features(spark, d):
    f = featurize(chats(spark, d))
    return f.select("id", *[F.round(f"f.{k}", 6).alias(k) for k in FEATURE_ORDER], *[F.col(f"f.{k}").alias(k) for k in RAW])


@query(f"WITH {O.DOCS}, l AS (SELECT id, lower(t) AS low FROM d) " + " UNION ALL ".join(f"SELECT id, '{k}' AS lexicon, {O.occurrences('low', v)} AS n FROM l" for k, v in L.LEXICONS.items()))
def lexicon_counts(spark, d):
    low = F.lower("text")
    rows = F.array(*[F.struct(F.lit(k).alias("lexicon"), T.occurrences(low, v).cast("long").alias("n")) for k, v in L.LEXICONS.items()])
    return docs(spark, d).select("id", F.explode(rows).alias("x")).select("id", "x.*")


@query(f"WITH {O.DOCS}, k AS (SELECT id, unnest({O.match_tokens('t')}) AS term FROM d) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM k GROUP BY term")
def term_frequencies(spark, d):
    rows = docs(spark, d).select("id", F.explode(T.match_tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    return rows.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


def _mattr_positions(spark, d):
    """Moving type-token ratio by positions: each place counts in the windows that see no earlier place of its word."""
    rows = docs(spark, d).select("id", T.words(F.col("text")).alias("w")).where(F.size("w") > 50).select("id", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))
    before = F.lag("p", 1, -1).over(Window.partitionBy("id", "word").orderBy("p"))
    seen = F.greatest(F.lit(0), F.least("p", F.col("n") - 50) - F.greatest(F.lit(0), F.col("p") - 49, before + 1) + 1)
    sums = rows.withColumn("seen", seen).groupBy("id", "n").agg(F.sum("seen").alias("seen"))
    return sums.select("id", six(F.col("seen") / (F.lit(50.0) * (F.col("n") - 49))).alias("mattr"))


@query(f"WITH {O.DOCS}, k AS (SELECT id, {O.words('t')} AS w FROM d) SELECT id, round(list_sum(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i:i + 49])))) / (50.0 * (len(w) - 49)), 6) AS mattr FROM k WHERE len(w) > 50")
def mattr(spark, d):
    return _mattr_positions(spark, d)


_PAIRS = f"""{O.DOCS}, {O.refs()}, ds AS (SELECT id, len(g) AS n, unnest(g) AS g FROM (SELECT id, {O.shingles('k')} AS g FROM (SELECT id, {O.match_tokens('t')} AS k FROM d))),
pairs AS (SELECT id, n, item_id, count(*) AS shared FROM ds JOIN rs USING (g) GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT id, item_id, n, shared, {O.percent('shared / n')} AS overlap FROM pairs WHERE shared / n > 0.02")
def shingle_containment(spark, d):
    found = plagiarism.matches(plagiarism.containment(docs(spark, d), refs(spark, d)))
    return found.select("id", F.col("ref_id").alias("item_id"), "n", "shared", "overlap")


_TOP = f"top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, item_id) AS rank FROM (SELECT id, item_id, {O.percent('shared / n')} AS overlap FROM pairs WHERE shared / n > 0.02))"


@query(f"WITH {_PAIRS}, {_TOP} SELECT id, item_id, overlap, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 5")
def top_matches(spark, d):
    return plagiarism.top_matches(plagiarism.containment(docs(spark, d), refs(spark, d))).select("id", F.col("ref_id").alias("item_id"), "overlap", "rank")


_FLAGGED = f"""{O.DOCS}, {O.sentence_places()}, {O.refs()},
sg AS (SELECT id, sent, len(g) AS n, unnest(g) AS g FROM (SELECT id, sent, {O.shingles('k')} AS g FROM (SELECT id, sent, {O.match_tokens('text')} AS k FROM sp))),
sm AS (SELECT id, sent, n, item_id, count(*) AS shared FROM sg JOIN rs USING (g) GROUP BY ALL),
fl AS (SELECT *, shared / n AS share FROM sm QUALIFY row_number() OVER (PARTITION BY id, sent ORDER BY shared / n DESC, item_id) = 1)"""


@query(f'WITH {_FLAGGED} SELECT id, sent, start, "end", item_id, {O.percent("share")} AS overlap FROM fl JOIN sp USING (id, sent) WHERE share >= 0.55')
def flagged_sentences(spark, d):
    found = plagiarism.flagged_sentences(docs(spark, d), refs(spark, d))
    return found.select("id", "sent", "start", "end", F.col("ref_id").alias("item_id"), "overlap")


@query(
    f"""WITH {_FLAGGED}, fs AS (SELECT id, sent, item_id, {O.match_tokens('sp.text')} AS a, r.k AS b FROM fl JOIN sp USING (id, sent) JOIN r USING (item_id) WHERE share >= 0.55),
ai AS (SELECT id, sent, CAST(generate_subscripts(a, 1) AS INTEGER) - 1 AS i, unnest(a) AS tok FROM fs), bi AS (SELECT id, sent, CAST(generate_subscripts(b, 1) AS INTEGER) - 1 AS j, unnest(b) AS tok FROM fs),
mt AS (SELECT id, sent, i, j, i - j AS dg, i - row_number() OVER (PARTITION BY id, sent, i - j ORDER BY i) AS isl FROM ai JOIN bi USING (id, sent, tok)),
rn AS (SELECT id, sent, count(*) AS length, max(i) AS li, max(j) AS lj FROM mt GROUP BY id, sent, dg, isl)
SELECT id, sent, CAST(li - length + 1 AS INTEGER) AS first, CAST(lj - length + 1 AS INTEGER) AS ref_first, CAST(length AS INTEGER) AS length FROM rn QUALIFY row_number() OVER (PARTITION BY id, sent ORDER BY length DESC, li, lj) = 1"""
)
def longest_common_run(spark, d):
    found = plagiarism.flagged_sentences(docs(spark, d), refs(spark, d)).select("id", "sent", "ref_id", T.match_tokens(F.col("text")).alias("tokens"))
    return plagiarism.common_runs(found, refs(spark, d).select("ref_id", T.match_tokens(F.col("text")).alias("ref_tokens")))


_OTHER = r"[^\p{L}\p{N}_]+"


@query(
    f"""WITH {_FLAGGED}, fs AS (SELECT id, sent, item_id, sp.text AS own_text, text_start, {O.match_tokens('sp.text')} AS a, r.k AS b, bm.text AS ref_text FROM fl JOIN sp USING (id, sent) JOIN r USING (item_id) JOIN benchmark bm USING (item_id) WHERE share >= 0.55),
ai AS (SELECT id, sent, CAST(generate_subscripts(a, 1) AS INTEGER) - 1 AS i, unnest(a) AS tok FROM fs), bi AS (SELECT id, sent, CAST(generate_subscripts(b, 1) AS INTEGER) - 1 AS j, unnest(b) AS tok FROM fs),
mt AS (SELECT id, sent, i, j, i - j AS dg, i - row_number() OVER (PARTITION BY id, sent, i - j ORDER BY i) AS isl FROM ai JOIN bi USING (id, sent, tok)),
rn AS (SELECT id, sent, count(*) AS length, max(i) AS li, max(j) AS lj FROM mt GROUP BY id, sent, dg, isl),
best AS (SELECT id, sent, length AS n, li - length + 1 AS f, li AS l, lj - length + 1 AS rf, lj AS rl FROM rn QUALIFY row_number() OVER (PARTITION BY id, sent ORDER BY length DESC, li, lj) = 1),
tx AS (SELECT 0 AS side, id AS k1, sent AS k2, own_text AS x FROM fs UNION ALL SELECT DISTINCT 1, item_id, 0, ref_text FROM fs),
tp AS (SELECT side, k1, k2, generate_subscripts(x, 1) AS i, unnest(x) AS raw FROM (SELECT side, k1, k2, regexp_extract_all(x, '{O.TOKEN}|{_OTHER}') AS x FROM tx)),
tq AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY side, k1, k2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM tp),
ts AS (SELECT side, k1, k2, row_number() OVER (PARTITION BY side, k1, k2 ORDER BY i) - 1 AS t, pos AS s, pos + length(raw) AS e FROM tq WHERE regexp_matches(raw, '^{O.TOKEN}')),
sz AS (SELECT side, k1, k2, count(*) AS c FROM ts GROUP BY ALL),
fd AS (SELECT fs.*, n, p.s AS s, q.e AS e, u.s AS us, v.e AS ve FROM fs JOIN best USING (id, sent)
  JOIN ts p ON p.side = 0 AND p.k1 = id AND p.k2 = sent AND p.t = f JOIN ts q ON q.side = 0 AND q.k1 = id AND q.k2 = sent AND q.t = l JOIN ts u ON u.side = 1 AND u.k1 = item_id AND u.t = rf JOIN ts v ON v.side = 1 AND v.k1 = item_id AND v.t = rl
  JOIN sz x ON x.side = 0 AND x.k1 = id AND x.k2 = sent AND x.c = len(a) JOIN sz y ON y.side = 1 AND y.k1 = item_id AND y.c = len(b) WHERE n >= 3),
fr AS (SELECT *, substring(ref_text, CAST(us + 1 AS INTEGER), CAST(ve - us AS INTEGER)) AS frag FROM fd)
SELECT id, sent, item_id AS ref_id, CAST(text_start + s AS INTEGER) AS copy_start, CAST(text_start + e AS INTEGER) AS copy_end, substring(own_text, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)) AS copy_text, CAST(n AS INTEGER) AS matched_words,
  CASE WHEN length(frag) > 240 THEN regexp_replace(substring(frag, 1, 240), '{O.WS}+$', '') || '…' ELSE frag END AS source_fragment FROM fr"""
)
def copied_spans(spark, d):
    base = refs(spark, d)
    return plagiarism.located(plagiarism.flagged_sentences(docs(spark, d), base), base)


@query(
    f"""WITH {O.DOCS}, {O.refs()}, dk AS (SELECT id, {O.match_tokens('t')} AS k FROM d), nr AS (SELECT count(*) + 1 AS n FROM r),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(k) AS term FROM r) GROUP BY term),
tr AS (SELECT item_id, term, count(*) / any_value(len) AS tf FROM (SELECT item_id, len(k) AS len, unnest(k) AS term FROM r) GROUP BY item_id, term),
td AS (SELECT id, term, count(*) / any_value(len) AS tf FROM (SELECT id, len(k) AS len, unnest(k) AS term FROM dk) GROUP BY id, term),
dw AS (SELECT id, term, tf * (ln((n + 1) / (coalesce(df, 0) + 2)) + 1) AS w, ln((n + 1) / (coalesce(df, 0) + 2)) + 1 AS own, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS without FROM td LEFT JOIN df USING (term), nr),
rn AS (SELECT item_id, sum((tf * (ln((n + 1) / (df + 1)) + 1)) ** 2) AS norm FROM tr JOIN df USING (term), nr GROUP BY item_id),
dn AS (SELECT id, sum(w * w) AS norm FROM dw GROUP BY id),
mt AS (SELECT id, item_id, sum(w * tf * own) AS dot, sum((tf * own) ** 2 - (tf * without) ** 2) AS more FROM dw JOIN tr USING (term) GROUP BY id, item_id),
co AS (SELECT id, max(dot / sqrt(dn.norm * (rn.norm + more))) AS c FROM mt JOIN rn USING (item_id) JOIN dn USING (id) GROUP BY id)
SELECT d.id, coalesce({O.percent('c')}, 0) AS topical FROM d LEFT JOIN co USING (id)"""
)
def tfidf_topical(spark, d):
    return plagiarism.topical(docs(spark, d), refs(spark, d))


@query(
    f"""WITH {O.DOCS}, g AS (SELECT id, len(g) AS n, unnest(g) AS g FROM (SELECT id, {O.shingles('k')} AS g FROM (SELECT id, {O.match_tokens('t')} AS k FROM d))),
p AS (SELECT a.id, a.n, b.id AS source, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY ALL)
SELECT id, source, {O.percent('shared / n')} AS overlap, CAST(row_number() OVER w AS INTEGER) AS rank FROM p WHERE shared / n > 0.02 WINDOW w AS (PARTITION BY id ORDER BY {O.percent("shared / n")} DESC, source) QUALIFY row_number() OVER w <= 5"""
)
def batch_cross_match(spark, d):
    return plagiarism.batch_matches(docs(spark, d)).select("id", F.col("ref_id").alias("source"), "overlap", "rank")


@query(f"WITH RECURSIVE {O.CHATS}, {O.blocks()} SELECT id, block, words, CAST(last - first + 1 AS INTEGER) AS paragraphs FROM bl")
def block_packing(spark, d):
    rows = chats(spark, d).select("id", localize.packed(F.col("text")).alias("b")).select("id", F.posexplode("b").alias("block", "b"))
    return rows.select("id", "block", F.col("b.words").cast("long").alias("words"), (F.col("b.last") - F.col("b.before")).alias("paragraphs"))


@query(
    f"""WITH RECURSIVE {O.CHATS}, {O.blocks()}, bt AS (SELECT id, block, array_to_string(p[first:last], chr(10) || chr(10)) AS t FROM bl JOIN pn USING (id)), {O.features('bt', 'id, block')},
h AS (SELECT f.id, bl.words, {O.heuristic()} AS p FROM f JOIN bl ON f.id = bl.id AND f.block = bl.block)
SELECT id, count(*) FILTER (words > 0) AS n_blocks, round(sum(p * words) / sum(words), 6) AS mean, round(sum(CASE WHEN p >= 0.5 THEN words ELSE 0 END) / sum(words), 6) AS coverage FROM h GROUP BY id HAVING count(*) >= 2 AND count(*) FILTER (words > 0) > 0"""
)
def block_estimate(spark, d):
    return localize.block_estimate(chats(spark, d)).select("id", "n_blocks", six(F.col("mean")).alias("mean"), six(F.col("coverage")).alias("coverage"))


@query(f"WITH {O.DOCS}, {O.features('d', 'id')} " + " UNION ALL ".join(f"SELECT id, '{k}' AS key, round({O.rounded(O.signal(k))}, 6) AS value, {O.percent(O.rounded(O.signal(k)))} AS score, {O.severity(O.rounded(O.signal(k)))} AS severity FROM f" for k, _, _, _ in signals.SIGNALS))
def signal_breakdown(spark, d):
    rows = featurize(docs(spark, d), only=signals.USED).select("id", F.explode(signals.breakdown(F.col("f"))).alias("s"))
    return rows.select("id", "s.key", six(F.col("s.value")).alias("value"), "s.score", "s.severity")


@query(f"WITH {O.DOCS}, {O.features('d', 'id')} SELECT id, round({O.heuristic()}, 6) AS heuristic, {O.percent(O.clamp(O.heuristic(4), '0.03', '0.97'))} AS probability FROM f")
def heuristic_score(spark, d):
    f = featurize(docs(spark, d), only=signals.USED)
    return f.select("id", six(signals.heuristic(F.col("f"))).alias("heuristic"), signals.probability(F.col("f")).alias("probability"))


@query(f"WITH {O.DOCS}, {O.scores()} SELECT id, sent, words, window_words, round(score, 6) AS score, round(confidence, 6) AS confidence FROM sc")
def sentence_scores(spark, d):
    return localize.sentence_scores(docs(spark, d)).select("id", "sent", "words", "window_words", six(F.col("score")).alias("score"), six(F.col("confidence")).alias("confidence"))


_SMOOTH = "sm AS (SELECT *, avg(score) OVER (PARTITION BY id ORDER BY sent ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM sc)"
_REGIONS = f"""{_SMOOTH}, ri AS (SELECT *, sent - row_number() OVER (PARTITION BY id ORDER BY sent) AS island FROM sm WHERE smooth >= 0.22),
rg AS (SELECT id, min(sent) AS first, max(sent) AS last, count(*) AS n, max(smooth) AS top, coalesce(avg(score), 0.0) AS mean, CAST(sum(words) AS BIGINT) AS words FROM ri GROUP BY id, island HAVING max(smooth) >= 0.26 AND (count(*) >= 2 OR avg(score) >= 0.3))"""


@query(f"WITH {O.CHATS}, {O.scores()}, {_SMOOTH} SELECT id, sent, round(smooth, 6) AS smooth FROM sm")
def smoothing(spark, d):
    return localize.smoothed(localize.sentence_scores(chats(spark, d))).select("id", "sent", six(F.col("smooth")).alias("smooth"))


@query(f"WITH {O.CHATS}, {O.scores()}, {_REGIONS} SELECT id, first, last, n, round({O.rounded('mean', 3)}, 6) AS score, words FROM rg")
def regions(spark, d):
    """Thresholds are lower than the usual ones, which no invented prose reaches."""
    return localize.regions(localize.sentence_scores(chats(spark, d)), 0.26, 0.22, 0.3).select("id", "first", "last", "n", six(F.col("score")).alias("score"), "words")


_W = "words * (0.5 + 0.5 * confidence)"


@query(
    f"""WITH {O.CHATS}, {O.scores()}, mw AS (SELECT *, {_W} AS w FROM sc WHERE score IS NOT NULL)
SELECT id, count(*) AS scored, round(sum(w * {O.ramp('score', 0.35, 0.65)}) / sum(w), 6) AS fraction, round(least(sum(CASE WHEN score >= 0.6 THEN w ELSE 0 END), sum(CASE WHEN score <= 0.35 THEN w ELSE 0 END)) / sum(w) * 2.0, 6) AS heterogeneity
FROM mw GROUP BY id HAVING sum(w) > 0 AND count(*) >= 4"""
)
def heterogeneity(spark, d):
    found = localize.mixture(localize.sentence_scores(chats(spark, d)))
    return found.select("id", "scored", six(F.col("fraction")).alias("fraction"), six(F.col("heterogeneity")).alias("heterogeneity"))


_ESTIMATES = f"""{_PAIRS}, {O.features('d', 'id')}, es AS (SELECT f.id, f.word_count AS words, {O.percent(O.clamp(O.heuristic(4), '0.03', '0.97'))} AS ai, {O.percent(O.heuristic(4))} AS h, coalesce(sim, 0) AS similarity
FROM f LEFT JOIN (SELECT id, max({O.percent('shared / n')}) AS sim FROM pairs WHERE shared / n > 0.02 GROUP BY id) USING (id))"""


def _estimates(spark, d):
    texts = docs(spark, d)
    rows = featurize(texts, only=signals.USED).select("id", "f", F.col("f.word_count").alias("words"), signals.probability(F.col("f")).alias("ai"), T.percent(signals.heuristic(F.col("f"), 4)).alias("h"))
    best = plagiarism.matches(plagiarism.containment(texts, refs(spark, d))).groupBy("id").agg(F.max("overlap").alias("similarity"))
    return rows.join(best, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0)))


@query(f"WITH {_ESTIMATES} SELECT id, similarity, ai, CAST(round_even({O.clamp('(1.0 - similarity / 100.0) * (1.0 - ai / 100.0) * 100.0', '1.0', '99.0')}, 0) AS INTEGER) AS originality, CASE WHEN ai >= 66 THEN 'alto' WHEN ai >= 33 THEN 'medio' ELSE 'bajo' END AS level FROM es")
def originality(spark, d):
    return _estimates(spark, d).select("id", "similarity", "ai", verdict.originality(F.col("similarity"), F.col("ai")).alias("originality"), signals.level(F.col("ai")).alias("level"))


_CONF = "(CASE WHEN words < 80 THEN 0.35 WHEN words < 300 THEN 0.65 ELSE 0.9 END) * (0.7 + 0.3 * (1.0 - abs(h / 100.0 - similarity / 100.0))) * (0.75 + 0.25 * (abs(ai - 50) / 50.0))"


@query(
    f"""WITH {_ESTIMATES}, c AS (SELECT *, {_CONF} AS s, CASE WHEN words < 80 THEN 'baja' WHEN words < 300 THEN 'media' ELSE 'alta' END AS legacy FROM es)
SELECT id, CASE WHEN s < 0.45 THEN 'baja' WHEN s < 0.68 THEN 'media' ELSE 'alta' END AS level, round({O.rounded('s', 2)}, 6) AS score, legacy,
'Confianza ' || CASE WHEN s < 0.45 THEN 'baja' WHEN s < 0.68 THEN 'media' ELSE 'alta' END || ': ' || CASE WHEN words < 80 THEN '{verdict.LENGTHS[0]}' WHEN words < 300 THEN '{verdict.LENGTHS[1]}' ELSE '{verdict.LENGTHS[2]}' END
|| CASE WHEN 1.0 - abs(h / 100.0 - similarity / 100.0) < 0.5 THEN '; {verdict.DISAGREE}' ELSE '' END || CASE WHEN abs(ai - 50) / 50.0 < 0.2 THEN '; {verdict.GREY}' ELSE '' END || '.' AS reason FROM c"""
)
def confidence(spark, d):
    """The similarity stands in for a model's probability."""
    rows = _estimates(spark, d)
    c = verdict.confidence(F.col("words"), F.lit(True), F.col("h") / 100.0, F.col("similarity") / 100.0, F.col("ai"), F.lit(0.0))
    legacy = verdict.confidence_level(F.col("words"), F.lit(True))
    return rows.select("id", c["level"].alias("level"), six(c["score"]).alias("score"), legacy["level"].alias("legacy"), c["reason"].alias("reason"))


_HUMAN = [("voice", "personal_voice_density >= 1.5"), ("rhythm", "sentence_len_std >= 6"), ("informal", "informal_density > 0"), ("rich", "mattr >= 0.80"), ("openings", "sentence_start_diversity >= 0.8"), ("concrete", "hedging_density < 1.0 AND generic_phrase_density < 0.5")]


@query(
    f"""WITH {O.DOCS}, {O.features('d', 'id')}, e AS (SELECT id, {O.percent(O.clamp(O.heuristic(4), '0.03', '0.97'))} AS ai, list_filter([{', '.join(f"CASE WHEN {rule} THEN '{verdict.HUMAN[k]}' END" for k, rule in _HUMAN)}], lambda x: x IS NOT NULL) AS hs FROM f)
SELECT id, CASE WHEN ai >= 66 THEN '{verdict.VERDICTS["machine"]}' WHEN ai >= 40 THEN '{verdict.VERDICTS["mixed"]}' ELSE '{verdict.VERDICTS["human"]}' END AS summary, CASE WHEN len(hs) > 0 THEN array_to_string(hs, ' ') ELSE '{verdict.HUMAN["none"]}' END AS human FROM e"""
)
def explanations(spark, d):
    f = featurize(docs(spark, d))
    return f.select("id", verdict.summary(signals.probability(F.col("f")), F.lit(0)).alias("summary"), F.array_join(verdict.human_signals(F.col("f")), " ").alias("human"))


def _raised(keys) -> str:
    return " OR ".join(f"({O.rounded(O.signal(k))}) >= 0.33" for k in keys)


@query(
    f"""WITH {O.DOCS}, {O.features('d', 'id')}, e AS (SELECT id, list_filter([{', '.join(f"CASE WHEN {_raised(keys)} THEN '{t}' END" for p in verdict.PRIORITIES for keys, q, t, _ in verdict.ADVICE if p == q)}], lambda x: x IS NOT NULL) AS a FROM f)
SELECT id, CASE WHEN len(a) > 0 THEN array_to_string(a, '; ') ELSE '{verdict.FINE[1]}' END AS advice FROM e"""
)
def recommendations(spark, d):
    rows = T.once(featurize(docs(spark, d), only=signals.USED), "id", s=signals.breakdown(F.col("f"))).select("id", verdict.recommendations(F.col("s"), F.lit(False), F.lit(0)).alias("r"))
    return rows.select("id", F.array_join(F.col("r.title"), "; ").alias("advice"))


def _segments(spark, d):
    texts = engine.dealt(docs(spark, d))
    sentences = engine.kept(localize.sentence_scores(texts))
    marks = sentences.groupBy("id").agg(F.struct(T.rounded(T.ratio(F.sum("words"), F.count("*"))).alias("avg_sentence_len")).alias("f"))
    return engine.segmented(texts, marks, sentences, engine.copied(texts, refs(spark, d))[1])


@query()
def segment_table(spark, d):
    rows = _segments(spark, d)
    return rows.select("id", "sent", "start", "end", "category", "ai_score", "overlap", "source", "reason", F.size("evidence").alias("n_evidence"))


@query(f"WITH {O.DOCS} SELECT id, length(t) AS n_chars, true AS same FROM d")
def round_trip(spark, d):
    """Sentences and what lies between them put together again."""
    rows = T.once(docs(spark, d), "id", "text", s=T.sentences(F.col("text")))
    ends = F.concat(F.transform("s", lambda x: x["start"]), F.array(F.char_length("text")))
    rows = T.once(rows, "id", "text", "s", starts=ends)
    starts = F.col("starts")
    pieces = F.transform("s", lambda x, i: F.concat(F.substring("text", x["start"] + 1, x["end"] - x["start"]), F.substring("text", x["end"] + 1, F.get(starts, i + 1) - x["end"])))
    whole = F.concat(F.substring("text", F.lit(1), F.get(starts, F.lit(0))), F.array_join(pieces, ""))
    return rows.select("id", F.char_length("text").alias("n_chars"), (whole == F.col("text")).alias("same"))


@query(f'WITH {O.DOCS}, {O.sentence_places()} SELECT sp.id, sent, round(start / length(t) * 100.0, 6) AS "left", round(greatest(("end" - start) / length(t) * 100.0, 1.5), 6) AS width FROM sp JOIN d USING (id)')
def heatmap(spark, d):
    texts = docs(spark, d)
    rows = plagiarism.sentence_rows(texts).withColumn("ai_score", F.lit(0))
    bars = segments.heat_bars(rows, texts.select("id", F.char_length("text").alias("length")))
    return bars.select("id", "sent", six(F.col("left")).alias("left"), six(F.col("width")).alias("width"))


_TITLE = f"CASE WHEN c = '' THEN '{store.UNTITLED}' WHEN length(c) = 48 THEN c || '…' ELSE c END"
_CUT = f"SELECT doc_id, source, text, substring(regexp_replace({O.strip('text')}, '{O.WS}+', ' ', 'g'), 1, 48) AS c FROM documents"


@query(f"SELECT doc_id AS id, {_TITLE} AS title, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM ({_CUT}) JOIN (SELECT doc_id, substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS s FROM documents) USING (doc_id)")
def titles(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), store.title(F.col("text")).alias("title"), store.slug(F.col("text")).alias("slug"))


def _history(spark, d):
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").alias("id"), F.timestamp_seconds("doc_id").alias("created_at"), store.title(F.col("text")).alias("title"), F.col("n_chars").cast("int").alias("word_count"), F.lit(1).alias("originality"), F.lit(2).alias("plagiarism"), F.lit(3).alias("ai_probability"), F.col("source").alias("summary"), "text", F.lit("{}").alias("payload"))


@query(f"SELECT doc_id AS id, {_TITLE} AS title, source AS summary FROM ({_CUT}) ORDER BY doc_id DESC LIMIT 50")
def history_topk(spark, d):
    return store.listed(_history(spark, d)).select("id", "title", "summary")


@query("""SELECT doc_id AS id, '"' || doc_id || '","' || replace(source, '"', '""') || '","' || replace(coalesce(lang, ''), '"', '""') || '","' || replace(text, '"', '""') || '"' AS line FROM documents""")
def csv_lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), store.csv_line(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")).alias("line"))


@query("SELECT role AS label, count(*) AS total, count(*) FILTER (turn > 1) AS own FROM conversations GROUP BY role")
def corpus_counts(spark, d):
    return store.corpus_counts(table(spark, d, "conversations").select(F.col("role").alias("label"), (F.col("turn") > 1).alias("own")))


@query("WITH s AS (SELECT count(*) FILTER (quality = 1) AS n_human, count(*) FILTER (quality = 0) AS n_ai FROM labels) SELECT n_human, n_ai, round(CASE WHEN greatest(n_human, n_ai) = 0 THEN 0.0 ELSE least(n_human, n_ai) / greatest(n_human, n_ai) END, 6) AS balanced FROM s")
def corpus_balance(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "humano").otherwise("ia").alias("label"))
    return store.corpus_balance(rows).withColumn("balanced", six(F.col("balanced")))


@query("SELECT max_by(doc_id, n_chars * 1000000 + doc_id) AS doc_id, max(n_chars * 1000000 + doc_id) AS added_at FROM documents")
def last_example(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("added_at"))
    return store.last_example(rows).select("doc_id", "added_at")


@query("SELECT doc_id AS id, source FROM documents WHERE NOT (source = 'src0')")
def history_delete(spark, d):
    """What a deletion leaves."""
    gone = F.col("source") == "src0"
    return table(spark, d, "documents").where(~F.coalesce(gone, F.lit(False))).select(F.col("doc_id").alias("id"), "source")


_SCORED = "p AS (SELECT l.doc_id, l.quality AS y, (d.doc_id * 37 % 101) / 100.0 AS p FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def _scored(spark, d):
    labels = table(spark, d, "labels").where("quality is not null")
    return labels.join(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") * 37 % 101 / 100.0).alias("p"))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM p)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c""")
def confusion_matrix(spark, d):
    found = learning.metrics(_scored(spark, d).withColumn("predicted", (F.col("p") >= 0.5).cast("int")))
    return found.select("tp", "fp", "tn", "fn", *[six(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"""WITH {_SCORED}, b AS (SELECT greatest(ceil(p * 5) - 1, 0) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM p GROUP BY 1)
SELECT (SELECT round(avg((p - y) ** 2), 6) FROM p) AS brier, round(sum(n * abs(p - y)) / sum(n), 6) AS ece, (SELECT count(*) FILTER (p BETWEEN 0.3 AND 0.7) FROM p) AS mixed FROM b""")
def brier_ece(spark, d):
    rows = _scored(spark, d)
    mixed = rows.agg(F.count_if(F.col("p").between(0.3, 0.7)).alias("mixed"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))
    ece = learning.calibration_error(rows).select(six(F.col("ece")).alias("ece"))
    return mixed.withColumn("k", F.lit(0)).join(ece.withColumn("k", F.lit(0)), "k").select("brier", "ece", "mixed")


@query("WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents) SELECT doc_id AS id, round((n_chars - m) / s, 6) AS z FROM documents, s")
def zscore(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("z"))
    return learning.standardised(rows, ["z"]).select("id", six(F.col("z")).alias("z"))


@query("SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark, d):
    return learning.class_weights(table(spark, d, "labels"), "quality").select("quality", "n", six(F.col("weight")).alias("weight"))


@query("SELECT quality, count(*) AS n, count(*) // 5 AS least, (count(*) + 4) // 5 AS most FROM labels GROUP BY quality")
def fold_sizes(spark, d):
    """Five folds of each class, as even as can be."""
    dealt = learning.folds(table(spark, d, "labels").where("quality is not null"), "doc_id", "quality")
    sizes = dealt.groupBy("quality", "fold").count()
    return sizes.groupBy("quality").agg(F.sum("count").alias("n"), F.min("count").alias("least"), F.max("count").alias("most"))


def _vectors(spark, d):
    labels = table(spark, d, "labels").where("quality is not null")
    rows = docs(spark, d).join(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id")
    return featurize(rows).select(F.col("id").alias("key"), "y", learning.vector(F.col("f")).alias("x"))


@query()
def train_cv(spark, d):
    """Cross-validated metrics of each fold."""
    scored = learning.cross_validated(learning.folds(_vectors(spark, d), "key", "y"))
    return learning.metrics(scored.withColumn("predicted", (F.col("p") >= 0.5).cast("int")), "fold")


@query()
def model_scores(spark, d):
    """All documents by a model of all labelled ones."""
    model = learning.fitted(_vectors(spark, d))
    return featurize(docs(spark, d)).select("id", model.probability(F.col("f")).alias("p"))


@query(f"SELECT page_id, regexp_extract(lower(url), '\\.[^./]*$') AS suffix, CASE WHEN regexp_extract(lower(url), '\\.[^./]*$') NOT IN ('.txt', '.md', '.pdf', '.docx') THEN 'formato no admitido' END AS error, CASE WHEN {O.strip('html')} = '' THEN 0 ELSE len(regexp_split_to_array({O.strip('html')}, '{O.WS}+')) END AS words FROM pages")
def upload_checks(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", sources.suffix(F.col("url")).alias("suffix"), sources.upload_errors(F.col("url"), F.octet_length("html")).alias("error"), sources.whitespace_words(F.col("html")).alias("words"))


@query("SELECT name, count(*) AS n FROM (SELECT 'item' AS name, text FROM benchmark UNION ALL SELECT source AS name, text FROM documents) WHERE trim(text) <> '' GROUP BY name")
def reference_union(spark, d):
    items = table(spark, d, "benchmark").select(F.lit("item").alias("name"), "text")
    return sources.references(items, table(spark, d, "documents").select(F.col("source").alias("name"), "text")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, round(greatest(1e-6, least(1 - 1e-6, (doc_id % 101) / 100.0)), 6) AS p, round(1.0 / (1.0 + exp(-(1.5 * ln(greatest(1e-6, least(1 - 1e-6, (doc_id % 101) / 100.0)) / (1.0 - greatest(1e-6, least(1 - 1e-6, (doc_id % 101) / 100.0)))) - 0.25))), 6) AS calibrated FROM documents")
def platt_scaling(spark, d):
    p = F.col("doc_id") % 101 / 100.0
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), six(T.clamp(p, 1e-6, 1 - 1e-6)).alias("p"), six(T.platt(p, 1.5, -0.25)).alias("calibrated"))


@query()
def evidence_spans(spark, d):
    """Evidence in all sentences of all documents."""
    rows = plagiarism.sentence_rows(docs(spark, d)).select("id", "sent", F.explode(segments.evidence(F.col("text"), F.col("text_start"))).alias("e"))
    return rows.select("id", "sent", "e.*")


@query()
def report_table(spark, d):
    rows = store.report_rows(_segments(spark, d))
    return rows.select("id", "sent", "rank", "category", store.latin1(F.col("text")).alias("text"), F.size("evidence").alias("n_evidence"))


@query()
def analyze(spark, d):
    found = engine.analyze(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), refs(spark, d))
    return found.select("id", "originality", "plagiarism", "ai_probability", "confidence.level", "topical_similarity", "n_flagged", "heterogeneity", "n_regions", "explanation.summary", "word_count")


@query()
def analyze_batch(spark, d):
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "text", F.lit(None).cast("string").alias("error"))
    return engine.batch(files)


_SPANS = "SELECT event_id % 500 AS id, event_id % 97 * 3 AS s, event_id % 97 * 3 + event_id % 11 AS e FROM events"


@query(f"WITH s AS ({_SPANS}), c AS (SELECT DISTINCT id, unnest(range(s, e)) AS at FROM s) SELECT s.id, CAST(count(DISTINCT c.at) AS BIGINT) AS chars FROM s LEFT JOIN c USING (id) GROUP BY s.id")
def covered_characters(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 500).alias("id"), (F.col("event_id") % 97 * 3).alias("start"), (F.col("event_id") % 97 * 3 + F.col("event_id") % 11).alias("end"))
    return evaluation.covered(rows, "id")


_SCORED = "SELECT l.doc_id, CASE WHEN l.doc_id % 5 = 0 THEN 'mixto' WHEN quality = 1 THEN 'ia' ELSE 'humano' END AS label, CAST(l.doc_id % 101 AS INTEGER) AS ai FROM labels l"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, label, ai AS ai_probability, CAST(ai >= 50 AS INTEGER) AS predicted, ai / 100.0 AS p, CASE label WHEN 'mixto' THEN ai BETWEEN 30 AND 70 WHEN 'ia' THEN ai >= 50 ELSE ai < 50 END AS \"right\" FROM ({_SCORED})")
def evaluation_rows(spark, d):
    label = F.when(F.col("doc_id") % 5 == 0, "mixto").when(F.col("quality") == 1, "ia").otherwise("humano")
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"), label.alias("label"), (F.col("doc_id") % 101).cast("int").alias("ai_probability"))
    return evaluation.judged(rows).drop("y")
