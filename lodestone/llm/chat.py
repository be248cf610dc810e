"""Chat formatting (operator 7), in DataFrame functions only: preference pairs.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns is rendered once, as the
prompt; what follows is rendered for either side, and a mask tells which turns are trained on (the assistant's, in
completions only).

No conversation is ever gathered: a pair's turns are compared by a full join on (pair, turn), the first difference is
a pre-aggregated minimum, and the result has a row for each rendered turn, in order of (pair, part, turn).  So a pair
with a third of all turns is only a hot join key, which Spark splits.

preference_pairs makes pairs of plain conversations: chosen is the conversation up to the assistant's last turn,
rejected is the same with that turn answered by the assistant's first reply of the same conversation (a stale reply),
or by an empty reply if there is only one or the first says the same as the last.

The key of a pair is `pair`: its prompt, chosen and rejected are its rows with that part, and `trained` is their mask.  A
pair whose two sides are the same has no completions; its rows are flagged `degenerate`, to be left out of training.

Defined results: repeated rows are one turn; several different texts with the same (conversation, turn) are one
message each, in the order of (role, text), of one turn; turns with a null number come last; a null role is unknown, a
null text is empty, before anything is compared; conversations with a null id are one conversation; one without an
assistant's turn, or whose only reply is empty, is all prompt and degenerate; marks inside roles and texts are broken up;
an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import source

LAST = 9223372036854775807
OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def rendered(role: Column, text: Column) -> Column:
    """<|role|>, a line break, the text, <|end|> and a line break; a mark inside the text is broken up by a space."""
    broken_up = lambda x: F.replace(x, F.lit(OPEN), F.lit("< |"))
    name = F.replace(broken_up(role), F.lit(CLOSE), F.lit("| >"))
    return F.concat(F.lit(OPEN), name, F.lit(f"{CLOSE}\n"), broken_up(text), F.lit(f"{END}\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """pair, turn, role, text; each once."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("pair"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()


def preference_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen and the rejected turns (pair, turn, role, text) of every conversation."""
    own = turns(conversations)
    said = F.col("role") == "assistant"
    key = F.struct("turn", "text")
    ends = own.where(said).groupBy(F.col("pair").alias("p")).agg(
        F.max(key).alias("last"), F.min(key).alias("first")
    )
    other = (F.col("first.turn") < F.col("last.turn")) & (F.col("first.text") != F.col("last.text"))
    ends = ends.select("p", F.col("last.turn").alias("last"), F.when(other, F.col("first.text")).otherwise(F.lit("")).alias("stale"))
    joined = own.join(ends, F.col("pair").eqNullSafe(F.col("p")), "left")
    chosen = joined.where(F.col("last").isNull() | (F.col("turn") <= F.col("last")))
    at_end = (F.col("turn") == F.col("last")) & said
    replaced = F.when(at_end.eqNullSafe(True), F.col("stale")).otherwise(F.col("text"))
    rejected = chosen.select("pair", "turn", "role", replaced.alias("text")).distinct()
    return chosen.select("pair", "turn", "role", "text"), rejected


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair, part (prompt, chosen, rejected), turn, role, rendered, trained, degenerate: a row for each rendered message.

    chosen and rejected: (pair, turn, role, text) without nulls in role and text, each row once.
    """
    side = lambda df, name: df.select("pair", "turn", "role", "text", F.lit(name).alias("side"))
    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    # A turn is common if all its messages are on both sides; messages are compared by their own hash, not gathered.
    message = both.groupBy("pair", "turn", "role", "text").agg(F.count_distinct("side").alias("sides"))
    first = message.groupBy("pair").agg(F.min(F.when(F.col("sides") < 2, F.col("turn"))).alias("differs"))
    first = first.select(F.col("pair").alias("p"), "differs")
    placed = both.join(first, F.col("pair").eqNullSafe(F.col("p")), "left")
    in_prompt = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    shown = placed.where(~in_prompt | (F.col("side") == "chosen"))
    return shown.select(
        "pair", F.when(in_prompt, F.lit("prompt")).otherwise(F.col("side")).alias("part"), "turn", "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        (~in_prompt & (F.col("role") == "assistant")).alias("trained"), F.col("differs").isNull().alias("degenerate"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    formatted = format_pairs(*preference_pairs(source(spark, sf_dir, "conversations")))
    return formatted.withColumnRenamed("pair", "conv_id")


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role,
  coalesce(text, '') AS text FROM conversations),
e AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT e.conv_id, last, first, min(t.text) FILTER (WHERE t.turn = first) AS said, max(t.text) FILTER (WHERE t.turn = last) AS says
  FROM e JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.role = 'assistant' GROUP BY e.conv_id, last, first),
s AS (SELECT conv_id, last, CASE WHEN first < last AND said <> says THEN said ELSE '' END AS stale FROM r),
c AS (SELECT t.*, last, stale FROM t LEFT JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE last IS NULL OR turn <= last),
b AS (SELECT conv_id, turn, role, text, 'chosen' AS side FROM c
  UNION ALL SELECT DISTINCT conv_id, turn, role,
    CASE WHEN turn = last AND role = 'assistant' THEN stale ELSE text END, 'rejected' FROM c),
m AS (SELECT conv_id, turn, role, text, count(DISTINCT side) AS n FROM b GROUP BY ALL),
d AS (SELECT conv_id, min(turn) FILTER (WHERE n < 2) AS differs FROM m GROUP BY conv_id),
p AS (SELECT b.*, differs, differs IS NULL OR turn < differs AS shared FROM b JOIN d ON b.conv_id IS NOT DISTINCT FROM d.conv_id)
SELECT conv_id, CASE WHEN shared THEN 'prompt' ELSE side END AS part, turn, role,
  '<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered,
  NOT shared AND role = 'assistant' AS trained, differs IS NULL AS degenerate
FROM p WHERE NOT shared OR side = 'chosen'
"""
