"""Places of regular expressions in texts, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums are taken in blocks of so many, so that a text with very many matches costs little more for each.
BLOCK = 128


def _sums(d: DataFrame, lengths: str, to: str) -> DataFrame:
    """Adds `to`: an array with the sum of what stands before each element of the array of int `lengths`."""
    size = F.size(lengths)
    blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    part = lambda k: F.slice(F.col(lengths), k * BLOCK + 1, F.lit(BLOCK))
    add = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    zero = F.lit(0).cast("int")
    d = d.withColumn("_block", F.transform(blocks, lambda k: F.aggregate(part(k), zero, lambda a, x: a + x)))
    d = d.withColumn("_base", F.aggregate("_block", F.array(zero), add))
    each = lambda k: F.aggregate(F.slice(part(k), 1, F.size(part(k)) - 1), F.array(F.get(F.col("_base"), k)), add)
    empty = F.array().cast("array<int>")
    return d.withColumn(to, F.when(size > 0, F.flatten(F.transform(blocks, each))).otherwise(empty)).drop("_block", "_base")


def found(d: DataFrame, text: str, pattern: str, to: str, only_if: Column) -> DataFrame:
    """Adds `to`: an array of structs of each match, leftmost and not overlapping: start and end (in code points, end
    exclusive), match, before and after (up to 32 characters between it and the next match). Texts for which only_if is
    false are not searched."""
    empty = F.array().cast("array<string>")
    d = d.withColumn("_m", F.when(only_if, F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).otherwise(empty))
    some = F.size("_m") > 0
    d = d.withColumn("_p", F.when(some, F.split(F.col(text), pattern, -1)).otherwise(empty))
    d = d.withColumn(
        "_l",
        F.zip_with("_p", F.concat(F.array(F.lit("")), F.col("_m")), lambda p, m: F.char_length(p) + F.char_length(m)),
    )
    d = _sums(d, "_l", "_s")
    at = F.transform(
        F.col("_m"),
        lambda m, i: F.struct(
            F.get(F.col("_s"), i + 1).cast("int").alias("start"),
            (F.get(F.col("_s"), i + 1) + F.char_length(m)).cast("int").alias("end"),
            m.alias("match"),
            F.right(F.get(F.col("_p"), i), F.lit(32)).alias("before"),
            F.left(F.get(F.col("_p"), i + 1), F.lit(32)).alias("after"),
        ),
    )
    return d.withColumn(to, at).drop("_m", "_p", "_l", "_s")


def _folded(items: str, merge) -> Column:
    """The array of structs `items`, sorted by start, from left to right: an element that begins before the last one ends
    is merged with it by merge(last, element), else it follows. Elements are appended within blocks of BLOCK, so a text
    with very many of them costs little more for each."""
    empty = F.slice(F.col(items), 1, 0)
    none = F.get(F.col(items), F.lit(-1))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))

    def step(a, x):
        last = a["last"]
        apart = last.isNotNull() & (x["start"] >= last["end"])
        return F.struct(
            F.when(last.isNull() | apart, x).otherwise(merge(last, x)).alias("last"),
            a["outs"].alias("outs"),
            F.when(apart, F.concat(a["now"], F.array(last))).otherwise(a["now"]).alias("now"),
        )

    def block(acc, k):
        start = F.struct(acc["last"].alias("last"), acc["outs"].alias("outs"), empty.alias("now"))
        return F.aggregate(
            F.slice(F.col(items), k * BLOCK + 1, F.lit(BLOCK)), start, step,
            lambda a: F.struct(a["last"].alias("last"), F.concat(a["outs"], F.array(a["now"])).alias("outs")),
        )

    zero = F.struct(none.alias("last"), F.slice(F.array(empty), 1, 0).alias("outs"))
    whole = F.aggregate(blocks, zero, block, lambda a: F.concat(F.flatten(a["outs"]), F.array(a["last"])))
    return F.when(F.size(items) > 0, whole).otherwise(empty)


def settled(items: str) -> Column:
    """Of structs (start, order, end and more), sorted: of two that overlap, the one of the lesser order stays, decided
    from left to right; of equal orders, the one that ends later."""
    better = lambda last, x: (x["order"] < last["order"]) | ((x["order"] == last["order"]) & (x["end"] > last["end"]))
    return _folded(items, lambda last, x: F.when(better(last, x), x).otherwise(last))


def marked(d: DataFrame, text: str, spans: str, to: str) -> DataFrame:
    """Adds `to`: the text with [KIND] in place of each of `spans` (sorted structs of start, end and kind); overlapping
    ones are one, of the first one's kind. Each block of spans sees only its part of the text, so neither many spans nor
    long texts make it quadratic."""
    bare = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    joint = lambda last, x: F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
    d = d.withColumn("_bare", bare)
    d = d.withColumn("_spans", _folded("_bare", joint)).drop("_bare")
    n = F.size("_spans")
    at = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.coalesce(F.get(F.col("_spans"), k * BLOCK)["start"], F.char_length(F.col(text))))
    d = d.withColumn("_regions", F.when(n > 0, F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
        lambda k: F.struct(at(k).alias("at"), F.substr(F.col(text), at(k) + 1, at(k + 1) - at(k)).alias("part"), F.slice("_spans", k * BLOCK + 1, F.lit(BLOCK)).alias("spans")),
    )))

    def region(r):
        def step(a, x):
            gap = F.substr(r["part"], a["at"] - r["at"] + 1, x["start"] - a["at"])
            return F.struct(x["end"].alias("at"), F.concat(a["parts"], F.array(gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("parts"))

        start = F.struct(r["at"].alias("at"), F.array().cast("array<string>").alias("parts"))
        rest = lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(r["part"], a["at"] - r["at"] + 1, F.char_length(r["part"])))
        return F.aggregate(r["spans"], start, step, rest)

    whole = F.array_join(F.transform("_regions", region), "")
    return d.withColumn(to, F.when(n == 0, F.col(text)).otherwise(whole)).drop("_spans", "_regions")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1))),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, F.coalesce(F.substr(back, i, F.lit(1)).try_cast("int"), F.lit(0))).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                         F.coalesce(F.substr(back, i, F.lit(1)).try_cast("int"), F.lit(0)) + 1)),
    )
    return total % 10 == 0
