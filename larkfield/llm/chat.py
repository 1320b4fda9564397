"""Chat formatting with Spark expressions only, and reading the result back.

Output of one conversation: ``<s>``, then for each run of turns of one role ``[role]``, the texts of the run
with ``[+]`` between them, and ``</s>``. Inside roles and texts the characters ``& < [ ]`` become
entities, so no text can hold a control string and the output can be read back exactly. The loss mask
lists start and length (code points, from 1) of every assistant text in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """``<conv>, formatted, mask`` per conversation.

    Null roles and texts count as empty. Turns are ordered by number, then role, then text, so repeated
    numbers and repeated rows have one defined order and all stay; null numbers come first. A null
    conversation id is one conversation. Other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"))
    sets = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    starts = F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role != turns[i - 2].role)")
    runs = F.expr("transform(starts, (s, k) -> slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s))")

    def piece(text: Column, learned: Column) -> Column:
        return F.struct(text.alias("text"), learned.alias("learned"))

    def run_pieces(run: Column) -> Column:
        role = F.get(run, F.lit(0))["role"]
        head = F.array(piece(F.concat(F.lit("["), escaped(role), F.lit("]")), F.lit(False)))
        own = F.flatten(F.transform(run, lambda t, i: F.when(
            i == 0, F.array(piece(escaped(t["text"]), t["role"] == learn_role))).otherwise(
            F.array(piece(F.lit("[+]"), F.lit(False)), piece(escaped(t["text"]), t["role"] == learn_role)))))
        return F.concat(head, own, F.array(piece(F.lit("</s>"), F.lit(False))))

    start = F.array(piece(F.lit("<s>"), F.lit(False)))
    pieces = (sets.withColumn("starts", starts).withColumn("runs", runs)
              .select("conv", F.concat(start, F.flatten(F.transform("runs", run_pieces))).alias("pieces")))
    # The state carries the next position and the spans found so far.
    spans = F.expr("""aggregate(pieces, struct(1L AS next, cast(array() AS array<struct<start: bigint, length: bigint>>) AS spans),
        (s, p) -> struct(s.next + length(p.text) AS next,
                         if(p.learned, array_append(s.spans, struct(s.next AS start, cast(length(p.text) AS bigint) AS length)), s.spans) AS spans),
        s -> s.spans)""")
    return pieces.select(F.col("conv").alias(conv_col), F.array_join(F.col("pieces.text"), "").alias("formatted"),
                         spans.alias("mask"))


def read_chats(chats: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """``<conv>, formatted, turns, learned``: turns (role, text) and the text under the mask, unescaped."""
    runs = F.expr("filter(split(substring(formatted, 4), '</s>'), (r, i) -> r != '')")

    def run_turns(run: Column) -> Column:
        role = F.substring_index(F.substr(run, F.lit(2)), "]", 1)
        texts = F.split(F.substr(run, F.length(role) + F.lit(3)), r"\[\+\]")
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    learned = F.array_join(F.transform("mask", lambda m: unescaped(
        F.substr("formatted", m["start"].cast("int"), m["length"].cast("int")))), "")
    return chats.select(F.col(conv_col), "formatted", F.flatten(F.transform(runs, run_turns)).alias("turns"),
                        learned.alias("learned"))
