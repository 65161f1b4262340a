"""Stylometric features of a text: 38 that the classifier takes, in a fixed order, and 10 counts.

``featurize`` is one projection over rows, whatever a row's text is (a document,
a window of sentences, a block of paragraphs): nothing is shuffled.  Results are
rounded to four digits, and whatever is computed from features starts from those.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T

FEATURE_ORDER = [
    "avg_sentence_len", "sentence_len_std", "sentence_len_cv", "type_token_ratio", "hapax_ratio", "avg_word_len", "punct_ratio", "comma_density",
    "connector_density", "stopword_ratio", "repeated_trigram_ratio", "generic_phrase_density", "personal_voice_density", "informal_density",
    "burstiness", "sentence_start_diversity", "sentence_opener_ratio", "paragraph_len_cv", "list_marker_ratio", "hedging_density", "mattr",
    "repeated_bigram_ratio", "typographic_density", "mente_density", "nominalization_density", "char_trigram_diversity", "vocab_entropy",
    "similar_len_run_ratio", *[f"fw_{w}" for w in L.FUNCTION_WORDS],
]
RAW = ["word_count", "sentence_count", "char_count", "paragraph_count", "connector_count", "generic_count", "personal_count", "informal_count", "hedge_count", "opener_count"]

MENTE = r"mente$"
NOMINAL = r"(?:cion|ciones|sion|siones|miento|mientos|dad|dades)$"


def mean(array: Column) -> Column:
    return T.ratio(T.total(array, kind="bigint"), F.size(array))


def deviation(array: Column) -> Column:
    """Population standard deviation of whole numbers, from exact sums; 0 for fewer than two."""
    n, s, q = F.size(array).cast("bigint"), T.total(array, kind="bigint"), T.total(array, lambda x: x * x, "bigint")
    return F.when(n > 1, F.sqrt((n * q - s * s).cast("double")) / n).otherwise(F.lit(0.0))


def mattr(array: Column, window: int = 50) -> Column:
    """Mean share of different elements over all windows of a size; over all of a shorter array."""
    n = F.size(array)
    at = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    seen = T.total(at, lambda i: F.size(F.array_distinct(F.slice(array, i, window))), "bigint")
    return F.when(n == 0, F.lit(0.0)).when(n <= window, T.ratio(F.size(F.array_distinct(array)), n)).otherwise(seen / (F.lit(float(window)) * (n - (window - 1))))


def repeated(grams: Column) -> Column:
    return T.ratio(F.size(grams) - F.size(F.array_distinct(grams)), F.size(grams))


def entropy(counts: Column) -> Column:
    """Shannon entropy over its greatest possible value."""
    n, v = T.total(counts), F.size(counts)
    mass = T.total(counts, lambda c: c * F.log2(c.cast("double")))
    return F.when(v <= 1, F.lit(0.0)).otherwise((F.log2(n) - mass / n) / F.log2(v.cast("double")))


def similar_run(lengths: Column, tolerance: float = 0.25) -> Column:
    """Longest run of neighbours whose lengths differ by a quarter of the longer at most, over all."""
    begin = F.struct(F.lit(None).cast("int").alias("before"), F.lit(0).alias("run"), F.lit(1).alias("best"))

    def step(a: Column, x: Column) -> Column:
        alike = F.abs(x - a["before"]) <= F.lit(tolerance) * F.greatest(x, a["before"], F.lit(1))
        run = F.when(F.coalesce(alike, F.lit(False)), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("before"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    n = F.size(lengths)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(lengths, begin, step, lambda a: a["best"]) / n)


def trigram_diversity(norm: Column) -> Column:
    """Different runs of three characters over all; all of them are the threes from each of the first three places on."""
    grams = F.concat(*[F.regexp_extract_all(F.substring(norm, F.lit(k), F.char_length(norm)), F.lit("(?s).{3}"), 0) for k in (1, 2, 3)])
    n = F.char_length(norm)
    return F.when(n < 3, F.lit(1.0)).otherwise(F.size(F.array_distinct(grams)) / (n - 2).cast("double"))


#: Steps on the way to features that only these need.
ONLY_FOR = {
    "_sorted": {"type_token_ratio", "hapax_ratio", "vocab_entropy"},
    "_m": {"char_trigram_diversity"},
    "_g3": {"repeated_trigram_ratio"},
    "_g2": {"repeated_bigram_ratio"},
    "_plain": {"mente_density", "nominalization_density"},
    "_firsts": {"sentence_start_diversity"},
    "_l": {"list_marker_ratio"},
    "_connector": {"connector_density", "connector_count"},
    "_generic": {"generic_phrase_density", "generic_count"},
    "_hedge": {"hedging_density", "hedge_count"},
    "_informal": {"informal_density", "informal_count"},
    "_personal": {"personal_voice_density", "personal_count"},
    "_opener": {"sentence_opener_ratio", "opener_count"},
    "_fw": {f"fw_{w}" for w in L.FUNCTION_WORDS},
    "_lens": {"avg_sentence_len", "sentence_len_std", "sentence_len_cv", "burstiness", "similar_len_run_ratio"},
    "_std": {"sentence_len_std", "sentence_len_cv", "burstiness"},
    "_p": {"paragraph_len_cv", "paragraph_count"},
    "_pavg": {"paragraph_len_cv"},
}
ONLY_FOR |= {"_starts": ONLY_FOR["_sorted"], "_c": ONLY_FOR["_sorted"], "_k": ONLY_FOR["_g3"] | ONLY_FOR["_g2"], "_tri": ONLY_FOR["_m"], "_avg": ONLY_FOR["_lens"], "_pstd": ONLY_FOR["_pavg"]}
ONLY_FOR["_low"] = set().union(*[ONLY_FOR[k] for k in ("_connector", "_generic", "_hedge", "_informal", "_personal")])


def featurize(df: DataFrame, text_col: str = "text", name: str = "f", only: Collection[str] | None = None) -> DataFrame:
    """``df`` with a struct ``name`` of all features and counts (or ``only`` these) of ``text_col``; a null text is empty."""
    kept = df.columns
    wanted = [k for k in [*FEATURE_ORDER, *RAW] if only is None or k in only]
    needed = lambda k: k not in ONLY_FOR or not ONLY_FOR[k].isdisjoint(wanted)
    step = lambda d, keep, **made: T.once(d, *kept, *filter(needed, keep), **{k: v for k, v in made.items() if needed(k)})
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = step(df, [], _t=t, _low=F.lower(t), _w=T.words(t), _k=T.tokens(t), _s=T.sentence_texts(t), _m=T.for_match(t), _l=T.lines(t), _sorted=F.array_sort(T.words(t)))
    low, w, s = F.col("_low"), F.col("_w"), F.col("_s")
    d = step(
        d, ["_t", "_w", "_s", "_l", "_m"],
        _n=F.size(w),
        _lens=F.when(F.size(s) > 0, F.transform(s, lambda x: T.n_words(x))).otherwise(F.array(F.lit(0))),
        _starts=T.run_starts(F.col("_sorted")),
        _p=F.transform(T.paragraphs(F.col("_t")), lambda p: T.n_words(p)),
        _plain=F.transform(w, lambda x: T.folded(x)),
        _firsts=F.filter(F.transform(s, T.first_word), lambda x: x != ""),
        _g3=T.grams(F.col("_k"), 3),
        _g2=T.grams(F.col("_k"), 2),
        _connector=T.occurrences(low, L.CONNECTORS),
        _generic=T.occurrences(low, L.GENERIC_PHRASES),
        _hedge=T.occurrences(low, L.HEDGES),
        _informal=T.occurrences(low, L.INFORMAL_MARKERS),
        _personal=F.size(F.filter(w, lambda x: x.isin(*L.PERSONAL_MARKERS))) + T.occurrences(low, L.PERSONAL_PHRASES),
        _opener=F.size(F.filter(s, T.starts_with_opener)),
        _fw=F.filter(w, lambda x: x.isin(*L.FUNCTION_WORDS)),
    )
    d = step(
        d, ["_t", "_w", "_s", "_l", "_m", "_n", "_lens", "_p", "_plain", "_firsts", "_g3", "_g2", "_connector", "_generic", "_hedge", "_informal", "_personal", "_opener", "_fw"],
        _c=T.run_lengths(F.col("_starts"), F.col("_n")), _avg=mean(F.col("_lens")), _std=deviation(F.col("_lens")), _pavg=mean(F.col("_p")), _pstd=deviation(F.col("_p")), _tri=trigram_diversity(F.col("_m")),
    )
    n, sentences = F.col("_n"), F.size("_s")
    n_s = F.greatest(sentences, F.lit(1))
    per100 = lambda c: T.ratio(c * F.lit(100.0), n)
    lens, p, avg, std = F.col("_lens"), F.col("_p"), F.col("_avg"), F.col("_std")
    suffixed = lambda pattern, least: F.size(F.filter("_plain", lambda x: (F.char_length(x) > least) & x.rlike(pattern)))
    values = {
        "avg_sentence_len": avg,
        "sentence_len_std": std,
        "sentence_len_cv": T.ratio(std, avg),
        "type_token_ratio": T.ratio(F.size("_c"), n),
        "hapax_ratio": T.ratio(F.size(F.filter("_c", lambda c: c == 1)), n),
        "avg_word_len": T.ratio(T.total(w, F.char_length, "bigint"), n),
        "punct_ratio": T.ratio(T.count_chars(F.col("_t"), L.PUNCTUATION), n),
        "comma_density": T.ratio(T.count_chars(F.col("_t"), ","), n_s),
        "connector_density": per100(F.col("_connector")),
        "stopword_ratio": T.ratio(F.size(F.filter(w, lambda x: x.isin(*L.STOPWORDS))), n),
        "repeated_trigram_ratio": repeated(F.col("_g3")),
        "generic_phrase_density": per100(F.col("_generic")),
        "personal_voice_density": per100(F.col("_personal")),
        "informal_density": per100(F.col("_informal")),
        "burstiness": F.when((sentences > 1) & (avg > 0), T.clamp(T.ratio(std, avg), 0.0, 2.0)).otherwise(F.lit(0.0)),
        "sentence_start_diversity": T.ratio(F.size(F.array_distinct("_firsts")), F.size("_firsts"), 1.0),
        "sentence_opener_ratio": T.ratio(F.col("_opener"), n_s),
        "paragraph_len_cv": F.when(F.size(p) < 2, F.lit(0.5)).otherwise(T.ratio(F.col("_pstd"), F.col("_pavg"))),
        "list_marker_ratio": T.ratio(F.size(F.filter("_l", T.is_list_line)), F.size("_l")),
        "hedging_density": per100(F.col("_hedge")),
        "mattr": mattr(w),
        "repeated_bigram_ratio": repeated(F.col("_g2")),
        "typographic_density": per100(T.count_chars(F.col("_t"), L.TYPOGRAPHIC)),
        "mente_density": per100(suffixed(MENTE, 6)),
        "nominalization_density": per100(suffixed(NOMINAL, 5)),
        "char_trigram_diversity": F.col("_tri"),
        "vocab_entropy": entropy(F.col("_c")),
        "similar_len_run_ratio": similar_run(lens),
        **{f"fw_{x}": per100(F.size(F.filter("_fw", _equals(x)))) for x in L.FUNCTION_WORDS},
    }
    raw = {
        "word_count": n,
        "sentence_count": sentences,
        "char_count": F.char_length("_t"),
        "paragraph_count": F.size("_p"),
        "connector_count": F.col("_connector"),
        "generic_count": F.col("_generic"),
        "personal_count": F.col("_personal"),
        "informal_count": F.col("_informal"),
        "hedge_count": F.col("_hedge"),
        "opener_count": F.col("_opener"),
    }
    out = F.struct(*[(T.rounded(values[k]) if k in values else raw[k]).alias(k) for k in wanted])
    return T.once(d, *kept, **{name: out})


def _equals(value: str):
    return lambda x: x == value
