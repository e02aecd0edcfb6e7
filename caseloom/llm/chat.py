"""Preference formatting: one prompt, two completions with masks.

Two conversations, chosen and rejected, share a prefix of turns. The prefix is the part
before the first turn in which they differ, found as a minimum per pair, so turns are
never collected: a pair's pieces stay rows, and a conversation of any length is spread
over tasks. The shared turns are rendered once, as the prompt; the others are rendered
per side, with the span that a loss should count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table

HEAD, NECK, TAIL = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def preference_pieces(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(pair_id, part, turn, role, piece, mask_start, mask_length), one row per piece.

    ``turns`` has pair_id, rejected (boolean), turn, role and text. ``part`` is prompt,
    chosen or rejected. Within a part pieces follow each other by turn, role and piece. The mask
    of a completion's piece covers the text and the end mark of a ``trained`` role; it is
    empty elsewhere, as in the whole prompt.

    A null turn comes before turn 0 (as -1); null roles and texts are empty. Rows repeated
    in one conversation count once; several texts in one turn are all in that turn. If one
    side has no more turns, its completion has no piece.
    """
    t = turns.select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("rejected"), 2).otherwise(1).alias("side"))
    # 1: chosen only, 2: rejected only, 3: both
    t = t.groupBy("pair_id", "turn", "role", "text").agg(F.bit_or("side").alias("sides"))
    apart = t.filter("sides < 3").groupBy("pair_id").agg(F.min("turn").alias("apart"))
    t = t.withColumnRenamed("pair_id", "p").join(apart, F.col("p").eqNullSafe(F.col("pair_id")), "left")
    part = (F.when(F.col("apart").isNull() | (F.col("turn") < F.col("apart")), F.array(F.lit("prompt")))
            .when(F.col("sides") == 1, F.array(F.lit("chosen")))
            .when(F.col("sides") == 2, F.array(F.lit("rejected")))
            .otherwise(F.array(F.lit("chosen"), F.lit("rejected"))))
    head = F.concat(F.lit(HEAD), "role", F.lit(NECK))
    counts = (F.col("part") != "prompt") & (F.col("role") == trained)
    return t.select(F.col("p").alias("pair_id"), F.explode(part).alias("part"), "turn", "role", "text").select(
        "pair_id", "part", "turn", "role", F.concat(head, "text", F.lit(TAIL)).alias("piece"),
        F.when(counts, F.length(head)).otherwise(0).cast("long").alias("mask_start"),
        F.when(counts, F.length("text") + len(TAIL)).otherwise(0).cast("long").alias("mask_length"))


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected and the spans of both completions.

    For conversations that fit a row. Spans are (start, length) in characters.
    """
    def rendered(part):
        mine = F.filter("all", lambda x: x["part"] == part)
        return F.concat_ws("", F.transform(mine, lambda x: x["piece"])).alias(part)

    def spans(part):
        mine = F.filter("all", lambda x: x["part"] == part)
        start = F.struct(F.lit(0).cast("long").alias("at"),
                         F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
        step = F.aggregate(mine, start, lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["mask_length"] > 0, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["mask_start"]).alias("start"), x["mask_length"].alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
        return step["spans"].alias(f"{part}_spans")

    return pieces.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "role", "piece", "part", "mask_start", "mask_length"))).alias("all")).select(
        "pair_id", rendered("prompt"), rendered("chosen"), rendered("rejected"),
        spans("chosen"), spans("rejected"))


@query("op2_chat_format", f"""
with t as (select distinct conv_id // 2 as pair_id, coalesce(turn, -1) as turn, coalesce(role, '') as role,
        coalesce(text, '') as text, conv_id % 2 as side from conversations),
g as (select pair_id, turn, role, text, count(*) as n, max(side) as side from t group by all),
a as (select pair_id, min(turn) as apart from g where n < 2 group by pair_id),
p as (select g.*, apart is null or turn < apart as shared from g left join a using (pair_id)),
q as (select pair_id, 'prompt' as part, turn, role, text from p where shared union all
    select t.pair_id, case t.side when 1 then 'rejected' else 'chosen' end, t.turn, t.role, t.text from t
    join p on p.pair_id = t.pair_id and p.turn = t.turn and p.role = t.role and p.text = t.text and not shared),
r as (select *, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body,
    part <> 'prompt' and role = '{TRAINED}' as counts from q)
select pair_id, part, turn, role, length(head || body)::bigint as n_chars,
    (case when counts then length(head) else 0 end)::bigint as mask_start,
    (case when counts then length(body) else 0 end)::bigint as mask_length,
    sha256(head || body) as piece_sha256 from r""")
def op2_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation: an even id is chosen over the odd id that follows it."""
    c = table(spark, d, "conversations")
    turns = c.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
                     (F.pmod("conv_id", F.lit(2)) == 1).alias("rejected"), "turn", "role", "text")
    return preference_pieces(turns).select(
        "pair_id", "part", "turn", "role", F.length("piece").cast("long").alias("n_chars"),
        "mask_start", "mask_length", F.sha2("piece", 256).alias("piece_sha256"))
