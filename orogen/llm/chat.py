"""Preference pairs of conversations: the common prompt and two masked completions, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles whose turns are learned from.
LEARNED = "assistant"


def of_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, side, turn, role, text of given pairs of conversations (pair_id, conv_id, side: chosen or rejected)."""
    named = pairs.select("pair_id", F.col("conv_id").alias("_conv"), "side")
    return named.join(turns.select("conv_id", "turn", "role", "text"), F.col("_conv") == F.col("conv_id")).select("pair_id", "side", "turn", "role", "text")


def swapped_answers(turns: DataFrame) -> DataFrame:
    """pair_id, side, turn, role, text: each conversation, and the same with another one's last answer in place of its own.

    The conversation itself is chosen. The rejected one has its turns before the last answer (the last turn of role
    `assistant`), then the last answer of its partner: the conversation whose id differs in the lowest bit alone.
    Conversations without an answer keep all their turns on both sides; where the partner is missing or has no
    answer, the rejected side ends before the answer. Turns with a null conv_id belong to none and are left out.
    """
    own = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    answer = F.struct("turn", "text")
    last = own.where(F.col("role") == LEARNED).groupBy("conv_id").agg(F.max(answer).alias("answer"))
    cut = own.join(last.select("conv_id", F.col("answer.turn").alias("at"), F.col("answer.text").alias("said")), "conv_id", "left")
    before = F.col("at").isNull() | (F.col("turn") < F.col("at")) | ((F.col("turn") == F.col("at")) & ((F.col("role") != LEARNED) | ~F.col("text").eqNullSafe(F.col("said"))))
    side = lambda rows, name: rows.select(F.col("conv_id").alias("pair_id"), F.lit(name).alias("side"), "turn", "role", "text")
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer.text").alias("text"))
    swapped = last.select("conv_id", F.col("answer.turn").alias("turn")).join(partner, "conv_id").select("conv_id", "turn", F.lit(LEARNED).alias("role"), "text")
    return side(own, "chosen").unionByName(side(cut.where(before), "rejected")).unionByName(side(swapped, "rejected"))


def _rendered(turns: str) -> str:
    return rf"transform({turns}, t -> concat('<|', coalesce(t.role, ''), '|>\n', coalesce(t.text, ''), '<|end|>\n'))"


def _spans(turns: str) -> str:
    """Character ranges of the learned turns, their end marks included, in the rendered turns."""
    head = "char_length(coalesce(t.role, '')) + 5"
    whole = f"{head} + char_length(coalesce(t.text, '')) + 8"
    return (
        f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<first:int,last:int>>)), (s, t) -> named_struct("
        f"'at', s.at + {whole}, 'spans', if(t.role <=> '{LEARNED}', concat(s.spans, array(named_struct('first', s.at + {head}, 'last', s.at + {whole}))), s.spans)), s -> s.spans)"
    )


def formatted(sided: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans for every pair.

    Columns read: pair_id, side (chosen or rejected), turn, role, text; others are ignored, whatever their names.
    The prompt is the longest common prefix of the two conversations in turns of equal role and text, rendered
    once; the completions are the turns after it. Spans are the character ranges of a completion to learn from. A side that is
    missing counts as a conversation without turns; null roles and texts are rendered as empty, and equal
    each other; turns with the same number follow by role and text, null first. No turns give no rows. A pair is
    one row, however long: a conversation has to fit in a task, as a text has to.
    """
    rows = sided.select("pair_id", "side", "turn", "role", "text")
    turn = F.struct("turn", "role", "text")
    grouped = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "chosen", turn))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "rejected", turn))).alias("r"),
    )
    same = "zip_with(c, r, (x, y) -> x is not null and y is not null and x.role <=> y.role and x.text <=> y.text)"
    common = f"transform(array(array_position({same}, false)), p -> if(p = 0, least(size(c), size(r)), cast(p as int) - 1))[0]"
    cut = grouped.withColumn("n_common", F.expr(common)).select(
        "pair_id",
        "n_common",
        F.expr("slice(c, 1, n_common)").alias("p"),
        F.expr("slice(c, n_common + 1, size(c))").alias("c"),
        F.expr("slice(r, n_common + 1, size(r))").alias("r"),
    )
    joined = lambda x: F.expr(f"array_join({_rendered(x)}, '')")
    return cut.select(
        "pair_id", "n_common", joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"),
        F.expr(_spans("c")).alias("chosen_spans"), F.expr(_spans("r")).alias("rejected_spans"),
    )


def preferences(sided: DataFrame) -> DataFrame:
    """formatted() with the spans as text, such as `11-40,63-90`."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return formatted(sided).withColumns({c: text(c) for c in ("chosen_spans", "rejected_spans")})


ORACLE_SQL = """
with answers as (
  select conv_id, turn, text from (
    select *, row_number() over (partition by conv_id order by turn desc, text desc nulls last) as r
    from conversations where role = 'assistant' and conv_id is not null) where r = 1),
sided as (
  select conv_id as pair_id, 0 as side, turn, role, text from conversations where conv_id is not null
  union all
  select c.conv_id, 1, c.turn, c.role, c.text from conversations c left join answers a on c.conv_id = a.conv_id
  where c.conv_id is not null and (a.turn is null or c.turn < a.turn or (c.turn = a.turn and (c.role <> 'assistant' or c.text is distinct from a.text)))
  union all
  select a.conv_id, 1, a.turn, 'assistant', b.text from answers a join answers b on b.conv_id = xor(a.conv_id, 1)),
t as (
  select pair_id, side, role, text,
         row_number() over (partition by pair_id, side order by turn, role, text) as pos,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as piece
  from sided),
both_sides as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.pos, b.pos) as pos,
         a.pos is not null and b.pos is not null and a.role is not distinct from b.role and a.text is not distinct from b.text as same
  from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.pos = b.pos),
n as (select pair_id, coalesce(min(pos) filter (where not same) - 1, max(pos)) as n_common from both_sides group by pair_id),
u as (
  select t.*, n.n_common,
         sum(case when pos > n_common then length(piece) else 0 end) over (partition by t.pair_id, side order by pos) as last,
         length(coalesce(role, '')) + 5 as head
  from t join n on t.pair_id = n.pair_id)
select pair_id, cast(any_value(n_common) as integer) as n_common,
       coalesce(string_agg(piece, '' order by pos) filter (where side = 0 and pos <= n_common), '') as prompt,
       coalesce(string_agg(piece, '' order by pos) filter (where side = 0 and pos > n_common), '') as chosen,
       coalesce(string_agg(piece, '' order by pos) filter (where side = 1 and pos > n_common), '') as rejected,
       coalesce(string_agg(cast(last - length(piece) + head as varchar) || '-' || cast(last as varchar), ',' order by pos)
                filter (where side = 0 and pos > n_common and role = 'assistant'), '') as chosen_spans,
       coalesce(string_agg(cast(last - length(piece) + head as varchar) || '-' || cast(last as varchar), ',' order by pos)
                filter (where side = 1 and pos > n_common and role = 'assistant'), '') as rejected_spans
from u group by pair_id
"""
