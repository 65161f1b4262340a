"""The same computations in DuckDB's SQL, put together from the pieces that several queries share."""

from __future__ import annotations

import unicodedata

from scriptorium.functions import lexicons as L
from scriptorium.operators import signals

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD, TOKEN = r"[\p{L}\p{Nl}\p{No}]+", r"[\p{L}\p{N}_]+"
SENTENCE = r"[^.!?…\n]+[.!?…]*\n*"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    line = strip("regexp_replace(regexp_replace(p, '[ \\t]*\\n[ \\t]*', ' ', 'g'), '[ \\t]{2,}', ' ', 'g')")
    text = f"regexp_replace({strip(f"coalesce({x}, '')")}, '\\r\\n?', chr(10), 'g')"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({text}, '\\n[ \\t]*\\n+'), lambda p: {line}), lambda p: p <> ''), chr(10) || chr(10))"


DOCS = f"d AS (SELECT doc_id AS id, {norm('text')} AS t FROM documents)"
CHATS = "raw AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), " + f"d AS (SELECT conv_id AS id, {norm('text')} AS t FROM raw)"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda x: lower(x))"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def match_tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '{TOKEN}')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{SENTENCE}'), lambda x: {strip('x')}), lambda x: x <> '')"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{WS}*\\n'), lambda x: {strip('x')}), lambda x: x <> '')"


def array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def occurrences(low: str, values: list[str]) -> str:
    return f"CAST(list_sum(list_transform({array(values)}, lambda n: (length({low}) - length(replace({low}, n, ''))) // length(n))) AS BIGINT)"


def ratio(a: str, b: str, default: str = "0.0") -> str:
    return f"CASE WHEN ({b}) = 0 THEN {default} ELSE CAST({a} AS DOUBLE) / ({b}) END"


def rounded(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def ramp(x: str, lo: float, hi: float) -> str:
    return clamp(f"(({x}) - CAST({lo!r} AS DOUBLE)) / CAST({hi - lo!r} AS DOUBLE)", "0.0", "1.0")


def percent(x: str) -> str:
    return f"CAST(round_even(({x}) * 100, 0) AS INTEGER)"


def total(x: str) -> str:
    return f"coalesce(list_sum({x}), 0)"


def deviation(x: str) -> str:
    s, q = total(x), total(f"list_transform({x}, lambda v: v * v)")
    return f"CASE WHEN len({x}) > 1 THEN sqrt(CAST(len({x}) * {q} - {s} * {s} AS DOUBLE)) / len({x}) ELSE 0.0 END"


def mean(x: str) -> str:
    return ratio(total(x), f"len({x})")


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({x}) - {n - 2}, 1)), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


def shingles(x: str, n: int = 5) -> str:
    return f"CASE WHEN len({x}) > 0 AND len({x}) < {n} THEN [array_to_string({x}, ' ')] ELSE list_distinct({grams(x, n)}) END"


def features(source: str, keys: str) -> str:
    """CTEs from ``source`` (keys, t) to ``f``: keys and all features and counts."""
    per100 = lambda c: ratio(f"({c}) * 100.0", "n")
    openers = sorted(unicodedata.normalize("NFD", o).encode("ascii", "ignore").decode() for o in L.SENTENCE_OPENERS)
    low = f"regexp_replace(strip_accents(lower(x)), '^{WS}+', '')"
    opener = f"len(list_filter({array(openers)}, lambda o: starts_with({low}, o) AND NOT regexp_matches(substring({low}, length(o) + 1, 1), '^\\p{{L}}'))) > 0"
    line = f"regexp_matches(x, '^{WS}*(?:[-*•·–—]|\\p{{Nd}}+[.)]|[a-zA-Z][.)]){WS}+')"
    count_chars = lambda chars: f"(length(t) - length(translate(t, '{chars.replace(chr(39), chr(39) * 2)}', '')))"
    gram_ratio = lambda n: ratio(f"len({grams('k', n)}) - len(list_distinct({grams('k', n)}))", f"len({grams('k', n)})")
    seen = "list_sum(list_transform(range(1, greatest(len(w) - 48, 1)), lambda i: len(list_distinct(w[i:i + 49]))))"
    trigrams = "list_transform(range(1, greatest(length(m) - 1, 1)), lambda i: substring(m, i, 3))"
    values = {
        "avg_sentence_len": mean("lens"),
        "sentence_len_std": deviation("lens"),
        "sentence_len_cv": ratio(deviation("lens"), mean("lens")),
        "type_token_ratio": ratio("len(c)", "n"),
        "hapax_ratio": ratio("len(list_filter(c, lambda v: v = 1))", "n"),
        "avg_word_len": ratio(total("list_transform(w, lambda x: length(x))"), "n"),
        "punct_ratio": ratio(count_chars(L.PUNCTUATION), "n"),
        "comma_density": ratio(count_chars(","), "ns"),
        "connector_density": per100("connector_count"),
        "stopword_ratio": ratio(f"len(list_filter(w, lambda x: list_contains({array(L.STOPWORDS)}, x)))", "n"),
        "repeated_trigram_ratio": gram_ratio(3),
        "generic_phrase_density": per100("generic_count"),
        "personal_voice_density": per100("personal_count"),
        "informal_density": per100("informal_count"),
        "burstiness": f"CASE WHEN len(s) > 1 AND {mean('lens')} > 0 THEN {clamp(ratio(deviation('lens'), mean('lens')), '0.0', '2.0')} ELSE 0.0 END",
        "sentence_start_diversity": ratio("len(list_distinct(firsts))", "len(firsts)", "1.0"),
        "sentence_opener_ratio": ratio("opener_count", "ns"),
        "paragraph_len_cv": f"CASE WHEN len(p) < 2 THEN 0.5 ELSE {ratio(deviation('p'), mean('p'))} END",
        "list_marker_ratio": ratio(f"len(list_filter(l, lambda x: {line}))", "len(l)"),
        "hedging_density": per100("hedge_count"),
        "mattr": f"CASE WHEN n = 0 THEN 0.0 WHEN n <= 50 THEN CAST(len(list_distinct(w)) AS DOUBLE) / n ELSE {seen} / (50.0 * (n - 49)) END",
        "repeated_bigram_ratio": gram_ratio(2),
        "typographic_density": per100(count_chars(L.TYPOGRAPHIC)),
        "mente_density": per100("len(list_filter(w, lambda x: length(x) > 6 AND regexp_matches(strip_accents(x), 'mente$')))"),
        "nominalization_density": per100("len(list_filter(w, lambda x: length(x) > 5 AND regexp_matches(strip_accents(x), '(?:cion|ciones|sion|siones|miento|mientos|dad|dades)$')))"),
        "char_trigram_diversity": f"CASE WHEN length(m) < 3 THEN 1.0 ELSE CAST(len(list_distinct({trigrams})) AS DOUBLE) / len({trigrams}) END",
        "vocab_entropy": f"CASE WHEN len(c) <= 1 THEN 0.0 ELSE (log2(CAST(n AS DOUBLE)) - {total('list_transform(c, lambda v: v * log2(CAST(v AS DOUBLE)))')} / n) / log2(CAST(len(c) AS DOUBLE)) END",
        "similar_len_run_ratio": "CASE WHEN len(lens) < 2 THEN 0.0 ELSE CAST(run AS DOUBLE) / len(lens) END",
        **{f"fw_{x}": per100(f"len(list_filter(w, lambda x: x = '{x}'))") for x in L.FUNCTION_WORDS},
    }
    order = ["word_count", "sentence_count", "char_count", "paragraph_count", "connector_count", "generic_count", "personal_count", "informal_count", "hedge_count", "opener_count"]
    raw = {"word_count": "n", "sentence_count": "len(s)", "char_count": "length(t)", "paragraph_count": "len(p)"}
    picked = ", ".join([f"{rounded(v)} AS {k}" for k, v in values.items()] + [f"CAST({raw.get(k, k)} AS INTEGER) AS {k}" for k in order])
    by = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"b.{k.strip()} = runs.{k.strip()}" for k in keys.split(","))
    return f"""
a AS (SELECT {keys}, t, lower(t) AS low, {words('t')} AS w, list_transform(regexp_extract_all(t, '{TOKEN}'), lambda x: lower(x)) AS k, {sentences('t')} AS s,
  trim(regexp_replace(strip_accents(lower(t)), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS m,
  list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {strip('x')} <> '') AS l,
  list_transform({paragraphs('t')}, lambda x: {n_words('x')}) AS p FROM {source}),
b AS (SELECT *, len(w) AS n, greatest(len(s), 1) AS ns, CASE WHEN len(s) > 0 THEN list_transform(s, lambda x: {n_words('x')}) ELSE [0] END AS lens,
  CASE WHEN len(w) > 0 THEN map_values(list_aggregate(w, 'histogram')) ELSE [] END AS c,
  list_filter(list_transform(s, lambda x: lower(regexp_extract(x, '{WORD}'))), lambda x: x <> '') AS firsts,
  {occurrences('low', L.CONNECTORS)} AS connector_count, {occurrences('low', L.GENERIC_PHRASES)} AS generic_count, {occurrences('low', L.HEDGES)} AS hedge_count,
  {occurrences('low', L.INFORMAL_MARKERS)} AS informal_count, len(list_filter(w, lambda x: list_contains({array(L.PERSONAL_MARKERS)}, x))) + {occurrences('low', L.PERSONAL_PHRASES)} AS personal_count,
  len(list_filter(s, lambda x: {opener})) AS opener_count FROM a),
steps AS (SELECT {keys}, i, v, lag(v) OVER (PARTITION BY {keys} ORDER BY i) AS u FROM (SELECT {keys}, generate_subscripts(lens, 1) AS i, unnest(lens) AS v FROM b)),
islands AS (SELECT {keys}, sum(CASE WHEN u IS NOT NULL AND abs(v - u) <= 0.25 * greatest(v, u, 1) THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY i) AS island FROM steps),
runs AS (SELECT {keys}, max(c) AS run FROM (SELECT {keys}, island, count(*) AS c FROM islands GROUP BY ALL) GROUP BY ALL),
f AS (SELECT {by}, {picked} FROM b JOIN runs ON {same})"""


def signal(key: str) -> str:
    feature, lo, hi, falls = signals.RAMPS[key]
    up = ramp(feature, lo, hi)
    out = f"(1.0 - {up})" if falls else f"({up})"
    if key == "uniform_paragraphs":
        return f"CASE WHEN paragraph_count < 3 THEN 0.0 ELSE {out} END"
    if key == "too_clean":
        return f"CASE WHEN informal_density = 0 THEN {out} ELSE 0.0 END"
    return out


def heuristic(digits: int | None = None) -> str:
    parts = [f"CAST({w!r} AS DOUBLE) * ({rounded(signal(k), digits) if digits else signal(k)})" for k, w, _, _ in signals.SIGNALS]
    return clamp("0.0 + " + " + ".join(parts), "0.0", "1.0")


def severity(x: str) -> str:
    return f"CASE WHEN {x} >= 0.66 THEN 'alta' WHEN {x} >= 0.33 THEN 'media' ELSE 'baja' END"


def windows(texts: str = "d") -> str:
    """CTE ``win``: (id, sent, words, t) of each sentence with its neighbours."""
    return f"""ss AS (SELECT id, {sentences('t')} AS s FROM {texts}),
win AS (SELECT id, CAST(i - 1 AS INTEGER) AS sent, {n_words('s[i]')} AS words, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS t FROM ss, unnest(range(1, len(s) + 1)) AS r(i))"""


def scores(texts: str = "d") -> str:
    """CTEs to ``sc``: (id, sent, words, window_words, score, confidence)."""
    return f"""{windows(texts)}, {features('win', 'id, sent')},
sc AS (SELECT win.id, win.sent, win.words, word_count AS window_words, CASE WHEN word_count >= 12 THEN {rounded(heuristic())} END AS score,
  CASE WHEN word_count >= 12 THEN {rounded(ramp('CAST(word_count AS DOUBLE)', 12.0, 60.0))} ELSE 0.0 END AS confidence FROM win JOIN f ON win.id = f.id AND win.sent = f.sent)"""


def refs() -> str:
    return f"r AS (SELECT item_id, {match_tokens('text')} AS k FROM benchmark), rs AS (SELECT item_id, unnest(g) AS g FROM (SELECT item_id, {shingles('k')} AS g FROM r))"


def sentence_places(texts: str = "d") -> str:
    """CTE ``sp``: (id, sent, text, start, end, text_start)."""
    return f"""pc AS (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS raw FROM (SELECT id, regexp_extract_all(t, '{SENTENCE}|[.!?…\\n]+') AS x FROM {texts})),
po AS (SELECT id, i, raw, coalesce(sum(length(raw)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pc),
sp AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS sent, {strip('raw')} AS text, CAST(start AS INTEGER) AS start, CAST(start + length(raw) AS INTEGER) AS "end",
  CAST(start + length(raw) - length(regexp_replace(raw, '^{WS}+', '')) AS INTEGER) AS text_start FROM po WHERE NOT regexp_matches(raw, '^[.!?…\\n]') AND {strip('raw')} <> '')"""


def blocks(texts: str = "d") -> str:
    """CTE ``bl``: (id, block, words, first, last) by a fold over paragraphs."""
    return f"""pg AS (SELECT id, {paragraphs('t')} AS p FROM {texts}),
pn AS (SELECT id, p, list_transform(p, lambda x: {n_words('x')}) AS n FROM pg WHERE len(p) > 0),
fo AS (SELECT id, 0 AS i, 0 AS block, 0 AS held, n FROM pn UNION ALL
  SELECT id, i + 1, CASE WHEN i > 0 AND held >= 50 THEN block + 1 ELSE block END, (CASE WHEN held >= 50 THEN 0 ELSE held END) + n[i + 1], n FROM fo WHERE i < len(n)),
g0 AS (SELECT id, block, min(i) AS first, max(i) AS last, max(held) AS words, max(block) OVER (PARTITION BY id) AS top FROM fo WHERE i > 0 GROUP BY id, block),
g1 AS (SELECT id, CASE WHEN block = top AND block > 0 AND words < 25 THEN block - 1 ELSE block END AS block, first, last, words FROM g0),
bl AS (SELECT id, CAST(block AS INTEGER) AS block, CAST(sum(words) AS BIGINT) AS words, min(first) AS first, max(last) AS last FROM g1 GROUP BY id, block)"""
