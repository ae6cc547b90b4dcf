r"""Chat formatting by prefix-target expansion (native: DataFrame functions only).

Every assistant turn becomes an example of its own: all preceding turns are the context and only
that reply is trainable. A conversation that doesn't end with an assistant turn gets one more
example without a trainable part, so that no turn is lost.

Template: ``<|im_start|>ROLE\nTEXT<|im_end|>\n`` for each turn. Control strings inside a text are
escaped reversibly: ``<``, any number of ``_``, ``|`` gets one more ``_`` (``<|`` -> ``<_|``), which no control
string contains; in a role a line feed also becomes ``<|n|>``. Unescaping takes one ``_`` away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END, NL = "<|im_start|>", "<|im_end|>\n", "<|n|>"


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(_*)\|", r"<_$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<_")), F.regexp_replace(text, r"<_(_*)\|", r"<$1|")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NL))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NL), F.lit("\n")))


def format_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv, example_no (from 1), text, loss_start, loss_length (code points of text that are trained on).

    Turns are ordered by turn number, then role and text; repeated rows are repeated turns. Null
    roles and texts count as empty; a null conversation id is a conversation of its own. loss_length
    is 0 in an example that is context only. A conversation is one row while it is formatted: its
    examples have to be, too.
    """
    blank = F.lit("")
    one = F.struct(
        turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col], blank).alias("role"),
        F.coalesce(turns[text_col], blank).alias("text"),
    )
    convs = turns.select(turns[conv_col].alias("conv"), one.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = F.transform("ts", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
    body = F.transform("ts", lambda t: escape(t["text"]))
    goal = F.transform("ts", lambda t: t["role"] == target_role)
    convs = convs.select("conv", F.size("ts").alias("n"), head.alias("head"), body.alias("body"), goal.alias("goal"))
    last = F.array_compact(F.array(F.when(~F.element_at("goal", -1), F.col("n"))))
    at = F.concat(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at(F.col("goal"), i)), last)
    rows = convs.select("conv", "head", "body", "goal", F.posexplode(at).alias("no", "i"))
    turn = F.zip_with(F.slice("head", F.lit(1), F.col("i") - 1), F.slice("body", F.lit(1), F.col("i") - 1), lambda h, b: F.concat(h, b, F.lit(END)))
    context = F.concat(F.array_join(turn, ""), F.element_at("head", F.col("i")))
    rows = rows.select("conv", (F.col("no") + 1).alias("example_no"), context.alias("context"), F.element_at("body", F.col("i")).alias("last"), F.element_at("goal", F.col("i")).alias("trained"))
    return rows.select(
        "conv",
        "example_no",
        F.concat("context", "last", F.lit(END)).alias("text"),
        F.length("context").alias("loss_start"),
        F.when(F.col("trained"), F.length("last")).otherwise(0).alias("loss_length"),
        F.col("trained"),
    )


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> back from a formatted example."""
    parts = F.split(text, r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    start = len(START)

    def turn(p: Column) -> Column:
        at = F.locate("\n", p)
        return F.struct(
            unescape_role(F.substring(p, F.lit(start + 1), at - F.lit(start + 1))).alias("role"),
            unescape(F.substring(p, at + 1, F.length(p))).alias("text"),
        )

    return F.transform(parts, turn)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are read back from the formatted examples: turns from the longest one of a
    conversation (it holds them all), the loss text from the masks of all of them in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    kinds = dict(rows.dtypes)
    probe = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    examples = format_examples(rows.unionByName(probe))
    masked = F.when(F.col("loss_length") > 0, unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))).otherwise("")
    back = examples.select("conv", "example_no", "text", masked.alias("loss"), F.length("text").cast("long").alias("chars"))
    per = back.groupBy("conv").agg(
        F.max_by("text", "example_no").alias("longest"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    per = per.select("conv", "formatted_chars", "n_examples", "loss", parse_turns(F.col("longest")).alias("ts"))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        F.col("conv").alias("conv_id"),
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


QUERIES = {"op9_chat_format": op9_chat_format}

ORACLES = {
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (
  SELECT *, 12 + length(replace(regexp_replace(role, '<(_*)\|', '<_\1|', 'g'), chr(10), '<|n|>')) + 1 + length(regexp_replace(text, '<(_*)\|', '<_\1|', 'g')) + 11 AS chars,
         row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM g GROUP BY conv_id
""",
}
