"""Preference formatting: a prompt from the longest common turn prefix, and a pair of masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands around a turn in the rendered text.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(side: Column) -> Column:
    return F.coalesce(side, F.array().cast("array<struct<role:string,text:string>>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(AFTER_ROLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters (code points) in a rendered completion: length and whether the loss counts them. Only what the assistant says, with its end mark, counts."""
    return F.flatten(
        F.transform(turns, lambda t: F.array(F.struct(F.char_length(_head(t)).alias("length"), F.lit(False).alias("loss")), F.struct(F.char_length(_body(t)).alias("length"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"))))
    )


def conversations_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns (array of role, text) in the order of turn; ties by role and text, nulls first. Rows with a null id are left out.

    A conversation is one value in what this gives, so that it has to fit into one task's memory.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    ordered = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask of each pair of turn arrays.

    The prompt is the longest prefix of turns that are equal in role and text (null equals null), rendered once; the
    completions are the rest of each side, and empty where a side ends there. A null side has no turns; null roles and
    texts are rendered as empty. One row comes out for each that goes in; other columns aren't read.
    """
    a, b = F.col("a"), F.col("b")
    rows = pairs.select(F.col(id_col), _turns(F.col(chosen_col)).alias("a"), _turns(F.col(rejected_col)).alias("b"))
    both = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), both), lambda i: (i == both) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    rows = rows.withColumn("n", F.array_min(differ))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    return rows.select(
        F.col(id_col), F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.slice(a, 1, F.col("n"))).alias("prompt"),
        _rendered(rest(a)).alias("chosen"), _rendered(rest(b)).alias("rejected"), _mask(rest(a)).alias("chosen_mask"), _mask(rest(b)).alias("rejected_mask"),
    )


def with_borrowed_endings(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation up to its last assistant turn, and rejected is the same with that turn's text taken from the last assistant turn of the conversation with the next id.

    Where there is none, rejected ends before that turn. Conversations without an assistant turn make no pair.
    """
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant"))
    own = conversations.filter(F.size("turns") > 0).withColumn("last", last).filter("last is not null")
    lent = own.select((F.col("conv_id") - 1).alias("conv_id"), F.get("turns", F.col("last"))["text"].alias("lent"), F.lit(True).alias("has"))
    head = F.slice("turns", 1, F.col("last"))
    role = F.get("turns", F.col("last"))["role"]
    borrowed = F.when(F.col("has"), F.concat(head, F.array(F.struct(role.alias("role"), F.col("lent").alias("text"))))).otherwise(head)
    return own.join(lent, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.col("last") + 1).alias("chosen"), borrowed.alias("rejected"))


ORACLE = """
    with o as (select conv_id, list({'role': role, 'text': text} order by turn, role, text) as turns from conversations where conv_id is not null group by conv_id),
    l as (select *, list_max(list_filter(range(len(turns)), lambda i: turns[i + 1].role = 'assistant')) as last from o),
    c as (select * from l where last is not null),
    p as (select c.conv_id as pair_id, c.turns[:c.last + 1] as a,
                 case when n.conv_id is not null then list_concat(c.turns[:c.last], [{'role': 'assistant', 'text': n.turns[n.last + 1].text}]) else c.turns[:c.last] end as b
          from c left join c n on n.conv_id = c.conv_id + 1),
    s as (select *, list_min(list_filter(range(least(len(a), len(b)) + 1), lambda i: i = least(len(a), len(b)) or a[i + 1] is distinct from b[i + 1])) as n from p),
    r as (select pair_id, n, a[:n] as prompt, a[n + 1:] as chosen, b[n + 1:] as rejected from s)
    select pair_id, n::bigint as n_prompt_turns,
           coalesce(array_to_string(list_transform(prompt, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as prompt,
           coalesce(array_to_string(list_transform(chosen, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as chosen,
           coalesce(array_to_string(list_transform(rejected, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as rejected,
           coalesce(list_sum(list_transform(chosen, lambda t: case when t.role = 'assistant' then length(t.text) + 8 else 0 end)), 0)::bigint as chosen_loss_chars,
           coalesce(list_sum(list_transform(rejected, lambda t: case when t.role = 'assistant' then length(t.text) + 8 else 0 end)), 0)::bigint as rejected_loss_chars
    from r"""
