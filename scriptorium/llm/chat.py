"""Chat formatting in budgeted windows, with a loss mask.

Each turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``; control strings inside
roles and texts are escaped reversibly (a backslash doubles, and one is put after
the first character of each control string).  A conversation's turns are cut into
windows by the prefix sums of their tokens, counted by ``count``: of each stretch of
``STRETCH`` budgets a window takes turns up to the last whose prefix sum still fits into
the room, which is the budget less the system turn and ``history_budget``.  Each window
after the first repeats the conversation's first system turn and up to
``history`` turns before its own, as far as they fit in ``history_budget`` and the budget.
A window so never has more tokens than the budget, but for a turn that is longer by
itself, which is never cut and then stands alone.  A turn that leaves no room for the
system turn stands without it, and a system turn of more than half the budget is not
repeated.  The loss mask covers the text of each assistant turn in the window where it
is new, and no repeated one.

Everything is DataFrame expressions.  Positions and prefix sums are made in two
steps, over ranges of 64 turn numbers and over those ranges, so a very long
conversation is not sorted in one task; a window is what is put together in one
row, and its size is bounded by the budget.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), role and text, so repeated rows and ties have an order and each stays; a
null conversation id is a conversation of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.runtime import Scratch, tuned

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates give a meaning.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

BUDGET = 1024
HISTORY = 2
HISTORY_BUDGET = 256
#: Turn numbers that are sorted together.
RANGE = 64
#: Budgets of tokens whose turns are dealt to windows together.
STRETCH = 4
#: More than the windows of a stretch.
_WINDOWS = 1 << 20

LOSS_ROLE, SYSTEM_ROLE = "assistant", "system"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(piece: Column) -> Column:
    """A counter that needs no vocabulary: four characters a token. A turn's marks count."""
    return F.ceil(F.char_length(piece) / 4).cast("long")


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, count: Callable[[Column], Column]) -> DataFrame:
    """Each turn with its place (from 1) and the tokens of its conversation before it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))).withColumn("body", escaped(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    rows = rows.select(
        "conv", "turn", "role", "text", "piece", F.floor(F.col("turn") / RANGE).alias("part"), F.greatest(count(F.col("piece")).cast("long"), F.lit(1)).alias("tokens"), F.char_length("head").alias("head_chars"), F.char_length("body").alias("body_chars")
    )
    own = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(own)).withColumn("upto", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("text")
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("part_tokens"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("t_before"))
    return rows.join(parts, F.col("conv").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).select(
        "conv", "role", "piece", "tokens", "head_chars", "body_chars", (F.col("n_before") + F.col("rank")).alias("place"), (F.col("t_before") + F.col("upto") - F.col("tokens")).alias("start")
    )


def windows(
    turns: DataFrame,
    scratch: Scratch,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    history_budget: int = HISTORY_BUDGET,
    count: Callable[[Column], Column] = tokens_of,
) -> DataFrame:
    """One row per window: conv, window, n_new, n_repeated, tokens, formatted, loss (code point ranges of ``formatted``)."""
    tuned(turns.sparkSession)
    history_budget = min(history_budget, budget // 2)
    placed = scratch.keep(_placed(turns, conv_col, turn_col, role_col, text_col, count), "placed", compression="zstd")
    system = placed.where(F.col("role") == SYSTEM_ROLE).groupBy(F.col("conv").alias("c")).agg(F.min(F.struct("place", "tokens")).alias("s")).where(F.col("s.tokens") <= budget // 2)
    system = scratch.keep(system.select("c", F.col("s.place").alias("system"), F.col("s.tokens").alias("system_tokens")), "system")
    stretch = F.floor(F.col("start") / (STRETCH * budget)).alias("stretch")
    rows = placed.select("conv", "place", "tokens", stretch).groupBy("conv", "stretch").agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("turns"))  # STRETCH * budget turns at most
    rows = rows.join(system, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    room = (F.lit(budget - history_budget) - F.coalesce("system_tokens", F.lit(0))).cast("long")
    begin = F.struct(F.array().cast("array<bigint>").alias("ends"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("last"))

    def deal(a: Column, t: Column) -> Column:
        """A window ends before a turn that does not fit any more."""
        full = (a["used"] > 0) & (a["used"] + t["tokens"] > room)
        ends = F.when(full, F.concat(a["ends"], F.array(a["last"]))).otherwise(a["ends"])
        return F.struct(ends.alias("ends"), (F.when(full, F.lit(0)).otherwise(a["used"]) + t["tokens"]).alias("used"), t["place"].alias("last"))

    ends = F.aggregate("turns", begin, deal, lambda a: F.concat(a["ends"], F.array(a["last"])))
    spans = rows.select("conv", "stretch", F.expr("turns[0].place - 1").alias("before"), ends.alias("ends")).select("conv", "stretch", "before", "ends", F.posexplode("ends").alias("k", "last"))
    first = F.coalesce(F.get("ends", F.col("k") - 1), F.col("before")) + 1
    members = spans.select(F.col("conv").alias("c"), (F.col("stretch") * _WINDOWS + F.col("k")).alias("window"), F.explode(F.sequence(first, F.col("last"))).alias("p"))
    placed = scratch.keep(placed.join(members, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))).drop("c", "p"), "dealt", compression="zstd")
    firsts = placed.groupBy("conv", "window").agg(F.min("place").alias("first"), F.min("start").alias("from"), F.sum("tokens").alias("new_tokens"))
    firsts = firsts.join(system, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    kept = F.coalesce((F.col("system") < F.col("first")) & (F.col("system_tokens") + F.col("new_tokens") <= budget), F.lit(False))
    spare = F.least(F.lit(history_budget), F.lit(budget) - F.col("new_tokens") - F.when(kept, F.col("system_tokens")).otherwise(0))
    firsts = firsts.select("conv", "window", "first", "from", F.when(kept, F.col("system")).alias("system"), spare.alias("spare"))
    back = F.sequence(F.greatest(F.col("first") - history, F.lit(1)), F.col("first") - 1)
    back = F.when((F.col("first") > 1) & F.lit(history > 0), back).otherwise(F.array().cast("array<bigint>"))
    own = F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<bigint>"))
    wanted = firsts.select(F.col("conv").alias("c"), F.col("window").alias("into"), "from", "system", "spare", F.explode(F.array_union(back, own)).alias("p"))
    repeated = placed.drop("window").join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")))
    repeated = repeated.where((F.col("from") - F.col("start") <= F.col("spare")) | (F.col("place") == F.coalesce("system", F.lit(0))))
    fields = ["conv", "window", "place", "role", "piece", "tokens", "head_chars", "body_chars", "new"]
    every = placed.withColumn("new", F.lit(True)).select(fields).unionByName(repeated.withColumn("window", F.col("into")).withColumn("new", F.lit(False)).select(fields))
    order = Window.partitionBy("conv", "window").orderBy("place")
    every = every.withColumn("offset", F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begin = F.col("offset") + F.col("head_chars")
    span = F.when(F.col("new") & (F.col("role") == LOSS_ROLE), F.struct(begin.alias("start"), (begin + F.col("body_chars")).alias("end")))
    rows = every.select("conv", "window", "new", "tokens", F.struct("place", "piece").alias("p"), span.alias("span"))
    made = rows.groupBy("conv", "window").agg(
        F.count_if("new").alias("n_new"),
        F.count_if(~F.col("new")).alias("n_repeated"),
        F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list("p")).alias("pieces"),
        F.array_sort(F.collect_list("span")).alias("loss"),
    )
    return made.select("conv", "window", "n_new", "n_repeated", "tokens", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(
            unescaped(F.substring_index(p, SEP, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")


#: The conversation that the query adds: both texts are control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, then read back."""
    scratch = Scratch(spark, "op6")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    made = windows(rows.unionByName(probe), scratch)
    own = F.slice(parsed(F.col("formatted")), F.col("n_repeated").cast("int") + 1, F.greatest(F.col("n_new").cast("int"), F.lit(1)))
    read = made.select(
        "conv",
        "window",
        F.size(own).cast("long").alias("n"),
        F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        under_mask(F.col("formatted"), F.col("loss")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, loss = (F.array_join(F.col(f"w.{c}"), "") for c in ("turns", "loss"))
    out = whole.select(
        F.col("conv").alias("conv_id"),
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
    return scratch.until_exit(out)


def _sql_escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLE = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length('{START}{SEP}{END}') + length({_sql_escaped('role')}) + length({_sql_escaped('text')}) AS chars FROM c),
p AS (SELECT *, CAST(row_number() OVER o AS BIGINT) AS place, coalesce(sum((chars + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT conv_id, min(place) AS sys, arg_min((chars + 3) // 4, place) AS st FROM p WHERE role = '{SYSTEM_ROLE}' GROUP BY ALL),
u AS (SELECT p.*, (chars + 3) // 4 AS tok, start // {STRETCH * BUDGET} AS part, CASE WHEN st <= {BUDGET // 2} THEN sys END AS sys, CASE WHEN st <= {BUDGET // 2} THEN st ELSE 0 END AS st FROM p LEFT JOIN s USING (conv_id)),
w AS (SELECT conv_id, place, part, CAST(1 AS BIGINT) AS win, CAST(tok AS BIGINT) AS used FROM u WHERE place = 1
      UNION ALL SELECT u.conv_id, u.place, u.part, w.win + CASE WHEN u.part <> w.part OR w.used + u.tok > {BUDGET - HISTORY_BUDGET} - u.st THEN 1 ELSE 0 END,
                       CAST(CASE WHEN u.part <> w.part OR w.used + u.tok > {BUDGET - HISTORY_BUDGET} - u.st THEN 0 ELSE w.used END + u.tok AS BIGINT) FROM w JOIN u ON u.conv_id = w.conv_id AND u.place = w.place + 1),
q AS (SELECT u.*, win FROM u JOIN w USING (conv_id, place)),
f AS (SELECT conv_id, win, min(place) AS first, min(start) AS fs, sum(tok) AS new, any_value(sys) AS sys, any_value(st) AS st FROM q GROUP BY ALL),
h AS (SELECT conv_id, win, first, fs, CASE WHEN sys < first AND st + new <= {BUDGET} THEN sys END AS sys, {BUDGET} - new - CASE WHEN sys < first AND st + new <= {BUDGET} THEN st ELSE 0 END AS spare FROM f),
r AS (SELECT q.conv_id, sum(chars) AS chars FROM h JOIN q ON q.conv_id = h.conv_id
      AND ((q.place < h.first AND q.place >= h.first - {HISTORY} AND h.fs - q.start <= least(spare, {HISTORY_BUDGET})) OR q.place = h.sys) GROUP BY ALL),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
             coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{LOSS_ROLE}'), '') AS loss, sum(chars) AS chars FROM q GROUP BY ALL)
SELECT g.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(g.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN r ON g.conv_id = r.conv_id
"""
