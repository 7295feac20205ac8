"""Chat formatting into budgeted windows, in DataFrame operations only.

Turns of a conversation are put in order, and prefix sums of their tokens (words and ``OVERHEAD`` for the
template) cut it at turns: the sums are divided into blocks of the budget; the turns that lie within one block make a window,
and a turn that reaches over a block's end makes one of its own. A window thus never exceeds the budget unless it
is a single turn that does. Every window begins with the conversation's system turn, then with up to ``history``
earlier turns within ``history_tokens``; what a window repeats is masked, so each assistant text is a target once.

Template: ``<|turn|>role<|says|>text<|end|>`` for each turn. In roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes
``&lt;``, so no text can hold a control string, and the original is restored exactly.

Defined results: null roles and texts are empty; null turn numbers come last; equal numbers go by role, then text; rows
with a null conv_id are one conversation; repeated rows are turns of their own; other columns are ignored; an
empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
OVERHEAD = 4


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def chat_windows(turns: DataFrame, budget: int = 384, history: int = 2, history_tokens: int = 96) -> DataFrame:
    """``conv_id, window, n_tokens, formatted, n_repeated, loss_spans`` (code points, end exclusive).

    The first ``n_repeated`` turns of a window are the system turn and history that earlier windows held.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + OVERHEAD
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), tokens.alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(order))
    is_system = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("part", F.struct("pos", is_system.alias("sys"), "role", "text", "tokens"))
    rows = rows.withColumn("system", F.first("part").over(upto))
    rows = rows.withColumn("system", F.when(F.col("system.sys"), F.col("system")))
    room = F.greatest(F.lit(1), budget - history_tokens - F.coalesce("system.tokens", F.lit(0)))
    length = F.when(F.col("part.sys"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("room", room).withColumn("length", length).withColumn("end", F.sum("length").over(upto))
    start = F.col("end") - F.col("length")
    block, last = F.floor(start / F.col("room")), F.floor((F.col("end") - 1) / F.col("room"))
    rows = rows.withColumn("window", F.when(F.col("part.sys"), None).otherwise(2 * block + F.when(block == last, 0).otherwise(1)))
    rows = rows.withColumn("window", F.coalesce("window", F.lead("window").over(order), F.lit(0)))
    recent = F.filter(F.array(*[F.lag("part", k).over(order) for k in range(1, history + 1)]), lambda x: x.isNotNull() & ~x["sys"])
    rows = rows.withColumn("new", ~F.col("window").eqNullSafe(F.lag("window").over(order))).withColumn("recent", recent)
    fitting = F.filter("recent", lambda x, i: F.aggregate(F.slice("recent", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["tokens"]) <= history_tokens)
    windows = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list("part")).alias("fresh"),
        F.first(F.when(F.col("new"), F.reverse(fitting)), ignorenulls=True).alias("past"),
        F.first("system", ignorenulls=True).alias("system"),
    )
    # a window that holds the system turn as new has no past
    opening = F.when(F.col("system").isNull() | F.col("fresh")[0]["sys"], F.filter("past", lambda x: F.lit(False))).otherwise(F.array("system"))
    past = F.when(F.col("fresh")[0]["sys"], F.filter("past", lambda x: F.lit(False))).otherwise(F.col("past"))
    windows = windows.withColumn("repeated", F.concat(opening, past)).withColumn("n_repeated", F.size("repeated"))
    windows = windows.withColumn("parts", F.concat("repeated", "fresh"))
    shown = F.transform("parts", lambda x: F.struct(escape(x["role"]).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("target")))
    windows = windows.withColumn("shown", shown)
    pieces = F.transform("shown", lambda x: F.concat(F.lit(TURN), x["head"], F.lit(SAYS), x["body"], F.lit(END)))
    windows = windows.withColumn("pieces", pieces)
    begins = F.transform("pieces", lambda _, i: F.aggregate(F.slice("pieces", 1, i), F.lit(0), lambda a, y: a + F.length(y)))
    windows = windows.withColumn("begins", begins)

    def span(x, i):
        at = F.col("begins")[i] + len(TURN) + len(SAYS) + F.length(x["head"])
        return F.struct((x["target"] & (i >= F.col("n_repeated"))).alias("loss"), at.alias("start"), (at + F.length(x["body"])).alias("end"))

    spans = F.transform(F.filter(F.transform("shown", span), lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    n_tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return windows.select("conv_id", "window", n_tokens.alias("n_tokens"), F.array_join("pieces", "").alias("formatted"), "n_repeated", spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a window as ``array<struct<role, text>>``, from nothing but its formatted string."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s, i: i > 0)

    def parsed(s):
        body = F.substring_index(F.substring_index(s, END, 1), SAYS, -1)
        return F.struct(unescape(F.substring_index(s, SAYS, 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, parsed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*(c.split()[0] for c in schema.split(", ")))
    windows = chat_windows(turns.unionByName(planted))
    fresh = F.filter(read_back(F.col("formatted")), lambda x, i: i >= F.col("n_repeated"))
    losses = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = windows.select("conv_id", "window", fresh.alias("turns"), F.array_join(losses, "").alias("loss"), F.length("formatted").alias("chars"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    each = each.withColumn("turns", F.struct(F.size("turns").alias("n"), lines.alias("lines")))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.sum("turns.n").alias("n_turns"))
    lines = F.array_join(F.transform("w", lambda x: x["turns"]["lines"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER o AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
    23 + length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), s AS (
  SELECT *, pos = 1 AND role = 'system' AS sys, max(CASE WHEN pos = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER g AS sys_tokens,
    max(CASE WHEN pos = 1 AND role = 'system' THEN chars ELSE 0 END) OVER g AS sys_chars
  FROM p WINDOW g AS (PARTITION BY conv_id)
), e AS (
  SELECT *, greatest(1, 288 - sys_tokens) AS room, CASE WHEN sys THEN 0 ELSE tokens END AS len,
    sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS fin
  FROM s
), w AS (
  SELECT *, CASE WHEN NOT sys THEN 2 * floor((fin - len) / room) + CASE WHEN floor((fin - len) / room) = floor((fin - 1) / room) THEN 0 ELSE 1 END END AS win
  FROM e
), h AS (
  SELECT *, coalesce(win, lead(win) OVER o, 0) AS w2, CASE WHEN NOT lag(sys) OVER o THEN lag(tokens) OVER o END AS t1, lag(chars) OVER o AS c1,
    CASE WHEN NOT lag(sys, 2) OVER o THEN lag(tokens, 2) OVER o END AS t2, lag(chars, 2) OVER o AS c2
  FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos)
), n AS (
  SELECT *, w2 IS DISTINCT FROM lag(w2) OVER (PARTITION BY conv_id ORDER BY pos) AS new FROM h
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN new THEN CASE WHEN NOT sys THEN sys_chars ELSE 0 END
    + CASE WHEN t1 <= 96 THEN c1 ELSE 0 END + CASE WHEN t1 + t2 <= 96 THEN c2 ELSE 0 END ELSE 0 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
