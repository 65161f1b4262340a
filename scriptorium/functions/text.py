"""Text functions as Column expressions.

Character classes are spelled out, because ``\\w`` and ``\\s`` mean different
things in different engines: word characters are letters, numbers and ``_``,
words are runs of letters and letter-like numbers, and white space is the set
that Unicode gives.  Offsets count code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L

WORD = r"[\p{L}\p{Nl}\p{No}]+"
TOKEN = r"[\p{L}\p{N}_]+"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
SENTENCE = r"[^.!?…\n]+[.!?…]*\n*"
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
LIST_LINE = rf"^{SPACE}*(?:[-*•·–—]|\p{{Nd}}+[.)]|[a-zA-Z][.)]){SPACE}+"


def _folds() -> tuple[str, str]:
    """Letters that compatibility decomposition makes one letter with marks, what they become, and the marks, which go."""
    source, target = [], []
    for code in (*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and parts != chr(code):
            source.append(chr(code))
            target.append(base[0])
    marks = [chr(c) for c in range(0x0300, 0x0370) if unicodedata.combining(chr(c))]
    return "".join(source + marks), "".join(target)


FOLD_FROM, FOLD_TO = _folds()


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+", "")


def normalized(c: Column) -> Column:
    """Paragraphs (parted by blank lines) with their single line ends and runs of blanks made one space; null is empty."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\r\n?", "\n")
    one_line = lambda p: strip(F.regexp_replace(F.regexp_replace(p, "[ \t]*\n[ \t]*", " "), "[ \t]{2,}", " "))
    return F.array_join(F.filter(F.transform(F.split(text, "\n[ \t]*\n+", -1), one_line), lambda p: p != ""), "\n\n")


def folded(c: Column) -> Column:
    """Without accents: exact for Latin letters; see ``sources.nfkd`` for all of Unicode."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def for_match(c: Column) -> Column:
    """Lower case, no accents, everything between tokens one space."""
    return F.trim(F.regexp_replace(folded(F.lower(c)), r"[^\p{L}\p{N}_]+", " "))


def words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), 0), F.lower)


def n_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), 0))


def tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), 0), F.lower)


def match_tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(F.lower(c)), F.lit(TOKEN), 0)


def sentence_texts(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), 0), strip), lambda x: x != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Pieces whose offsets are summed up together; so many of those sums are summed up again.
TOGETHER = 128


def pieces_with_offsets(c: Column, pattern: str) -> Column:
    """All of the text as consecutive matches of a pattern that leaves nothing out, each with its start.

    Starts are summed up within stretches of ``TOGETHER`` pieces, then over the stretches: to append to an array copies it.
    """
    empty = F.array().cast("array<struct<raw:string,start:int>>")
    begin = F.struct(empty.alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.array(F.struct(x.alias("raw"), a["at"].alias("start")))).alias("out"), (a["at"] + F.char_length(x)).alias("at"))
    within = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / TOGETHER).cast("int")), lambda k: F.aggregate(F.slice(p, k * TOGETHER + 1, TOGETHER), begin, step))
    first = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    starts = lambda w: F.aggregate(w, first, lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), (a["at"] + x["at"]).alias("at")), lambda a: a["out"])
    moved = lambda w: bound(starts(w), lambda s: F.flatten(F.transform(w, lambda x, k: F.transform(x["out"], lambda q: F.struct(q["raw"].alias("raw"), (q["start"] + F.get(s, k)).alias("start"))))))
    whole = lambda p: F.when(F.size(p) > 0, bound(within(p), moved)).otherwise(empty)
    return F.coalesce(bound(F.regexp_extract_all(c, F.lit(pattern), 0), whole), empty)


def sentences(c: Column) -> Column:
    """(text, start, end, text_start) of each sentence; blank ones are none, and terminators at a begin belong to no sentence."""
    pieces = F.filter(pieces_with_offsets(c, rf"{SENTENCE}|[.!?…\n]+"), lambda p: (~p["raw"].rlike(r"^[.!?…\n]")) & (strip(p["raw"]) != ""))
    return F.transform(
        pieces,
        lambda p: F.struct(
            strip(p["raw"]).alias("text"),
            p["start"].alias("start"),
            (p["start"] + F.char_length(p["raw"])).alias("end"),
            (p["start"] + F.char_length(p["raw"]) - F.char_length(lstrip(p["raw"]))).alias("text_start"),
        ),
    )


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"\n{SPACE}*\n", -1), strip), lambda p: p != "")


def lines(c: Column) -> Column:
    return F.filter(F.split(c, LINE_END, -1), lambda x: strip(x) != "")


def is_list_line(c: Column) -> Column:
    return c.rlike(LIST_LINE)


def first_word(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, WORD, 0))


def occurrences(c: Column, needles: Sequence[str]) -> Column:
    """How often each needle stands in the (lower-case) text, without overlaps, summed."""
    count = lambda c, n: F.floor((F.char_length(c) - F.char_length(F.replace(c, n, F.lit("")))) / F.char_length(n)).cast("int")
    return bound(c, lambda c: F.aggregate(literals(needles), F.lit(0), lambda a, n: F.when(F.contains(c, n), a + count(c, n)).otherwise(a)))


def holds_any(c: Column, needles: Sequence[str]) -> Column:
    return bound(c, lambda c: F.exists(literals(needles), lambda n: F.contains(c, n)))


def starts_with_opener(c: Column) -> Column:
    """Whether the text begins with a connector that ends where a word ends."""
    openers = [unicodedata.normalize("NFD", o).encode("ascii", "ignore").decode() for o in L.SENTENCE_OPENERS]
    return folded(F.lower(c)).rlike(rf"^{SPACE}*(?:{'|'.join(openers)})(?!\p{{L}})")


def count_chars(c: Column, chars: str) -> Column:
    return F.char_length(c) - F.char_length(F.translate(c, chars, ""))


def grams(array: Column, n: int) -> Column:
    """Runs of ``n`` elements joined by a space; none if there are fewer."""
    at = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(array, i, n), " "))


def shingles(array: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` tokens; fewer tokens are one run."""
    return F.when((F.size(array) > 0) & (F.size(array) < n), F.array(F.array_join(array, " "))).otherwise(F.array_distinct(grams(array, n)))


def gram_hashes(array: Column, n: int) -> Column:
    """64-bit hashes of the runs of ``n`` elements, one for each place."""
    at = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(array, i, n)))


def shingle_hashes(array: Column, n: int = 5) -> Column:
    """64-bit hashes of the distinct runs of ``n`` tokens; fewer tokens are one run."""
    return F.when((F.size(array) > 0) & (F.size(array) < n), F.array(F.xxhash64(array))).otherwise(F.array_distinct(gram_hashes(array, n)))


def once(df: DataFrame, *keep: str, **values: Column) -> DataFrame:
    """``keep`` and named values, each evaluated once a row: the optimizer does not copy expressions through a generator."""
    return df.select(*keep, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_once")).select(*keep, *[F.col(f"_once.{k}").alias(k) for k in values])


def run_starts(ordered: Column) -> Column:
    """Places in a sorted array (a column of its own) where another element begins."""
    n = F.size(ordered)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))


def run_lengths(starts: Column, n: Column) -> Column:
    """How often each element occurs, from where its run starts (a column of its own)."""
    return F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), n) - s)


def total(array: Column, value: Callable[[Column], Column] = lambda x: x, kind: str = "double") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: a + value(x).cast(kind))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def ramp(c: Column, lo: float, hi: float) -> Column:
    """Linear from 0 at ``lo`` to 1 at ``hi``, cut at both."""
    return clamp((c - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a.cast("double") / b)


def rounded(c: Column, digits: int = 4) -> Column:
    """To so many digits, halves up: the same arithmetic in every engine."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def percent(c: Column) -> Column:
    """A share as a whole number of hundredths, halves to even."""
    return F.bround(c * 100).cast("int")


def sigmoid(z: Column) -> Column:
    return F.when(z < -60, 0.0).when(z > 60, 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def logit(p: Column) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (F.lit(1.0) - q))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))
