"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes training windows: prefix sums of turn tokens choose spans of whole turns, each later
window begins with the system turn and the latest turns that fit the history budget, and the loss mask holds the
texts of assistant turns that are new in the window, so each is a target once. Turns are marked by control
strings; in roles and texts `&`, `<` and `[` are written as entities, so that no control string of this or
another template survives inside, and are read back exactly.

Defined results: null roles and texts are empty; rows of equal turn are ordered by role and text; a null turn
comes first; a null conv_id is a conversation; a turn above the budget has a window of its own, uncut; an empty
table gives an empty result. A conversation is one record: its turns meet in one task, in sort buffers that spill
and then one row; work grows with its length, as a window takes its own turns and looks back over at most so many as the
history budget can hold. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
#: Tokens of a turn's marks.
MARKS = 3
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128, target: str = "assistant", retained: str = "system") -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated (turns at its head that an earlier window had), loss
    (array of start and length in characters of text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("head", F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT)))
    rows = rows.withColumn("shown", F.concat("head", escape(F.col("body")), F.lit(END)))
    rows = rows.withColumn("tok", F.regexp_count("shown", F.lit(WORD)).cast("long") + MARKS).withColumn("len", F.char_length("shown").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("tok").over(order)).withColumn("chars", F.sum("len").over(order)).withColumn("i", F.count(F.lit(1)).over(order))
    turn = F.struct("i", "role", "shown", "tok", "len", "cum", "chars", F.char_length("head").cast("long").alias("skip"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    first = F.col("t")[0]
    conv = conv.withColumn("kept", F.when(first["role"] == retained, 1).otherwise(0)).withColumn("kept_tok", F.when(first["role"] == retained, first["tok"]).otherwise(0).cast("long"))
    none = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<bigint>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        room = F.when(F.size(a["starts"]) == 1, F.lit(budget).cast("long")).otherwise(F.greatest(F.lit(budget - history).cast("long") - F.col("kept_tok"), F.lit(1).cast("long")))
        new = (F.size(a["starts"]) == 0) | (x["cum"] - a["base"] > room)
        return F.struct(F.when(new, x["cum"] - x["tok"]).otherwise(a["base"]).alias("base"), F.when(new, F.concat(a["starts"], F.array(x["i"]))).otherwise(a["starts"]).alias("starts"))

    conv = conv.withColumn("starts", F.aggregate("t", none, step)["starts"])
    turns_of = lambda a, b: F.when(b >= a, F.transform(F.sequence(a, b), lambda i: F.get("t", (i - 1).cast("int")))).otherwise(F.slice("t", 1, 0))
    no, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def window(a: Column, k: Column) -> Column:
        kept = F.when(k > 0, F.col("kept")).otherwise(0).cast("long")
        done = F.when(a > 1, F.get("t", (a - 2).cast("int"))["cum"]).otherwise(no)
        near = turns_of(F.greatest(kept + 1, a - history // MARKS), a - 1)  # no more turns than this fit
        past = F.filter(near, lambda x: done - (x["cum"] - x["tok"]) <= history)
        before = F.when(k > 0, F.concat(turns_of(one, kept), past)).otherwise(F.slice("t", 1, 0))
        new = turns_of(a, F.coalesce(F.get("starts", k + 1) - 1, F.size("t").cast("long")))
        return F.struct(k.cast("int").alias("window"), before.alias("before"), new.alias("new"))

    wins = conv.select("conv_id", F.explode(F.transform("starts", window)).alias("s")).select("conv_id", "s.*")
    lead = F.aggregate("before", F.lit(0).cast("long"), lambda n, x: n + x["len"])
    wins = wins.withColumn("lead", lead)
    at = F.get("new", F.lit(0))
    marked = F.filter("new", lambda x: x["role"] == target)
    loss = F.transform(marked, lambda x: F.struct((F.col("lead") + x["chars"] - x["len"] - (at["chars"] - at["len"]) + x["skip"]).alias("start"), (x["len"] - x["skip"] - len(END)).alias("length")))
    text = F.array_join(F.transform(F.concat("before", "new"), lambda x: x["shown"]), "")
    return wins.select("conv_id", "window", text.alias("text"), F.size("before").alias("n_repeated"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, from their texts and masks alone: conv_id, turns (role, text), loss,
    formatted_chars."""
    part = F.filter(F.split("text", F.lit("<\\|end\\|>\\n")), lambda x: x != "")
    turns = F.transform(part, lambda x: F.struct(unescape(F.replace(F.substring_index(x, TEXT, 1), F.lit(ROLE), F.lit(""))).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    rows = windows.select("conv_id", "window", "n_repeated", turns.alias("turns"), loss.alias("loss"), F.char_length("text").cast("long").alias("chars"))
    rows = rows.withColumn("turns", F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0))))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return conv.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(i AS BIGINT) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(i, r)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    back = read_back(format_windows(turns))
    said_all = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: Windows by a recursion over their first turns, with the budgets of format_windows.
ORACLE = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, '<|role|>' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') || '<|text|>'
    || replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') || '<|end|>' || chr(10) AS s FROM said),
sized AS (SELECT conv_id, turn, role, body, length(s) AS n, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) + 3 AS tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS i FROM shown),
summed AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) AS cum FROM sized),
kept AS (SELECT conv_id, tok AS sys_tok, n AS sys_n FROM summed WHERE i = 1 AND role = 'system'),
wins AS (
  SELECT conv_id, 0 AS k, CAST(1 AS BIGINT) AS a FROM summed WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.k + 1, min(t.i) FROM wins w JOIN summed f ON f.conv_id = w.conv_id AND f.i = w.a LEFT JOIN kept s ON s.conv_id = w.conv_id
    JOIN summed t ON t.conv_id = w.conv_id AND t.i > w.a AND t.cum - (f.cum - f.tok) > CASE WHEN w.k = 0 THEN 512 ELSE greatest(384 - coalesce(s.sys_tok, 0), 1) END
  GROUP BY w.conv_id, w.k),
again AS (SELECT w.conv_id, coalesce(max(s.sys_n), 0) + coalesce(sum(t.n), 0) AS n FROM wins w JOIN summed p ON p.conv_id = w.conv_id AND p.i = w.a - 1
    LEFT JOIN kept s ON s.conv_id = w.conv_id
    LEFT JOIN summed t ON t.conv_id = w.conv_id AND t.i < w.a AND t.i > CASE WHEN s.conv_id IS NULL THEN 0 ELSE 1 END AND p.cum - (t.cum - t.tok) <= 128
  WHERE w.k > 0 GROUP BY w.conv_id, w.k),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || body || chr(10), '' ORDER BY i) AS turns, sum(n) AS n,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY i), '') AS loss FROM summed GROUP BY conv_id)
SELECT w.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(w.n + coalesce(a.n, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN (SELECT conv_id, sum(n) AS n FROM again GROUP BY conv_id) a ON a.conv_id = w.conv_id
"""
