"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns
before it as context and only that reply trainable.

Turns are marked as in `<|im_start|>role\ntext<|im_end|>\n`. Control strings inside roles and texts are escaped with a
backslash code that no control string contains, so a formatted example can be read back exactly; line ends in roles are escaped, too.

Rows of a conversation meet in one shuffle by conversation; a conversation is a row of the result's size anyway.

Defined cases: a null text or role is empty; a row without a conversation is one of its own (equal such rows are one), so
they never meet in one group; turns are ordered by turn (null first), then role, then text, and repeated rows stay; turns
after the last reply come as a last example without a target, so no turn is lost; an empty table gives no examples;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning in chat templates. They never appear in an escaped text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"


def _put(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    text = _put(text, "\\", "\\b")
    for x in CONTROL:
        text = _put(text, x, ("\\t" if x[0] == "<" else "\\l") + x[1:])
    return text


def unescaped(text: Column) -> Column:
    return _put(_put(_put(_put(text, "\\t", "<"), "\\l", "["), "\\n", "\n"), "\\b", "\\")


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """conv_id, loose (tells rows without a conversation apart; else null), example (from 0), text (the formatted prefix
    and reply), mask_start and mask_end (the reply's place in text, in characters; equal for an example without a
    target)."""
    turn, role, text = turns[turn_col], F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        F.when(turns[conv_col].isNull(), F.sha2(F.to_json(F.struct(turn.alias("a"), role.alias("b"), text.alias("c"))), 256)).alias("loose"),
        F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("t"),
    )
    c = rows.groupBy("conv_id", "loose").agg(F.sort_array(F.collect_list("t")).alias("t"))
    c = c.select("conv_id", "loose", F.transform("t", lambda x: F.struct(
        (x["role"] == target_role).alias("target"),
        F.concat(F.lit(START), _put(escaped(x["role"]), "\n", "\\n"), F.lit("\n")).alias("head"),
        escaped(x["text"]).alias("body"),
    )).alias("t"))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["target"] | (i == F.size(F.col("t")))
    )
    e = c.select("conv_id", "loose", "t", F.posexplode(ends).alias("example", "upto"))
    before = F.concat_ws(
        "", F.transform(F.slice("t", F.lit(1), F.col("upto") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    )
    e = e.select("conv_id", "loose", "example", before.alias("before"), F.element_at("t", F.col("upto")).alias("last"))
    start = F.char_length("before") + F.char_length("last.head")
    return e.select(
        "conv_id",
        "loose",
        "example",
        F.concat("before", "last.head", "last.body", F.lit(END)).alias("text"),
        start.cast("bigint").alias("mask_start"),
        F.when(F.col("last.target"), start + F.char_length("last.body")).otherwise(start).cast("bigint").alias("mask_end"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns, and all text under their masks."""
    trained = unescaped(F.expr("substring(text, int(mask_start) + 1, int(mask_end - mask_start))"))
    c = formatted.groupBy("conv_id", "loose").agg(
        F.max(F.struct("example", "text"))["text"].alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", trained.alias("x")))).alias("trained"),
        F.sum(F.char_length("text")).cast("bigint").alias("formatted_chars"),
    )
    parts = F.slice(F.split("whole", r"<\|im_start\|>", -1), 2, 1 << 30)
    turn = F.transform(parts, lambda x: F.struct(
        unescaped(F.substring_index(x, "\n", 1)).alias("role"),
        unescaped(F.replace(F.substr(x, F.instr(x, F.lit("\n")) + 1), F.lit(END), F.lit(""))).alias("text"),
    ))
    return c.select(
        "conv_id",
        turn.alias("turns"),
        F.concat_ws("", F.transform("trained", lambda x: x["x"])).alias("trained"),
        "formatted_chars",
    )


def op5(turns: DataFrame) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    spark = turns.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    back = read_back(examples(turns.select("conv_id", "turn", "role", "text").unionByName(extra)))
    whole = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql() -> str:
    esc = "replace({}, '\\', '\\b')"
    for x in CONTROL:
        esc = f"replace({esc}, '{x}', '{'\\t' if x[0] == '<' else '\\l'}{x[1:]}')"
    one = f"length('{START}') + length(replace({esc.format('role')}, chr(10), '\\n')) + 1 + length({esc.format('text')}) + length('{END}')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, CASE WHEN conv_id IS NULL THEN (turn, role, text) END AS loose FROM c),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, loose) AS n, sum({one}) OVER w AS upto FROM l
  WINDOW w AS (PARTITION BY conv_id, loose ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id, loose"""


SQL = _sql()
