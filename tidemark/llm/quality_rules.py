"""Quality rules, line first: every line is tried against punctuation, navigation and boilerplate rules, failing lines
are removed, and a document that loses too much of its text is rejected.

All of it is one projection of built-in functions: no shuffle, no Python, no group that could grow.

Defined cases: a null or empty text has no words and fails; a null id passes through; repeated rows are judged one by
one; other columns of the input never reach the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, carried, handed_on, keyed, sealed, words

#: Phrases that mark a line as boilerplate, in lower case, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "javascript is disabled",
    "enable javascript",
    "click here to",
    "uses cookies",
    "follow us on",
    "sign up for our",
    "add to cart",
    "back to top",
    "powered by wordpress",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "allgemeine geschäftsbedingungen",
    "newsletter abonnieren",
    "verwendet cookies",
    "in den warenkorb",
    "nach oben",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "abonnez-vous à",
    "utilise des cookies",
    "ajouter au panier",
    "haut de page",
    "todos los derechos reservados",
    "política de privacidad",
    "condiciones de uso",
    "suscríbete a",
    "utiliza cookies",
    "añadir al carrito",
    "volver arriba",
)
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def _symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))


def _with_repeated(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words that lie in a 3-word window found twice or more. h holds a hash for each window.

    Each intermediate array is a column of its own, so that no lambda computes it again for each element.
    """
    none = F.array().cast("array<int>")
    d = d.withColumn("order", F.sort_array("h"))
    d = d.withColumn(
        "twice",
        F.array_distinct(F.filter("order", lambda x, i: (i > 0) & (x == F.get(F.col("order"), i - 1)))),
    )
    many = F.size("twice") > 64
    d = d.withColumn(
        "pairs", F.when(many, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    same = lambda x, i: F.coalesce(F.get(F.col("pairs"), i)["h"] == x["h"], F.lit(False))
    d = d.withColumn("near", F.filter("pairs", lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1)))
    few = F.filter(
        F.transform("h", lambda x, i: F.when(F.array_contains(F.col("twice"), x), i)), lambda i: i.isNotNull()
    )
    d = d.withColumn(
        "hit",
        F.when(F.col("h").isNull() | (F.size("twice") == 0), none)
        .when(many, F.sort_array(F.transform("near", lambda x: x["i"])))
        .otherwise(few),
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    count = F.aggregate(
        "hit",
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return d.withColumn("n_repeat_words", count.cast("bigint"))


def _flags(text: Column, n_symbols: Column) -> Column:
    """What a document must have somewhere for a rule to be worth a look at its lines."""
    lower = F.col("low")
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | lower.contains(phrase)
    arrows = text.contains(">") | text.contains("›") | text.contains("»") | text.contains("→")
    return F.struct(
        boiler.alias("boiler"), (n_symbols > 0).alias("symbols"), text.contains("!!").alias("bangs"), arrows.alias("arrows"), text.rlike("[0-9]").alias("digits")
    )


def _lines(lines: str) -> Column:
    """Each line with what the rules look at: bare (without spaces at its ends), n (characters) and k (words)."""
    bare = F.transform(lines, lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(SPACE_CHARS)).alias("bare")))
    return F.transform(bare, lambda x: F.struct(
        x["line"].alias("line"), x["bare"].alias("bare"), F.char_length(x["bare"]).alias("n"),
        (F.octet_length(x["bare"]) - F.octet_length(F.replace(x["bare"], F.lit(" "), F.lit(""))) + 1).alias("k"),
    ))


def _line_fails(x: Column, has: Column, symbol_percent: int, nav_bars: int, menu_words: int) -> Column:
    bare, n, k = x["bare"], x["n"], x["k"]
    count = lambda of: n - F.char_length(F.translate(bare, of, ""))
    lower, boiler = F.lower(bare), F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | lower.contains(phrase)
    symbols = has["symbols"] & ((_symbols(bare) * 100 > n * symbol_percent) | (count("|") >= nav_bars))
    trail = has["arrows"] & (k <= 4 * menu_words) & (count(">›»→") >= 2)
    shouted = has["bangs"] & bare.rlike(r"(?:!!.*){3,}")
    capitals = ~bare.rlike("[a-zà-öø-ÿ]") & (n - F.char_length(F.regexp_replace(bare, "[A-Z]", "")) >= 20)
    cut_off = bare.endswith("...") | bare.endswith("…")
    few = k <= menu_words
    link = few & bare.rlike(r"https?://|www\.")
    numbers = has["digits"] & (count("0123456789") * 2 > n)
    menu = few & ~bare.rlike(r"""[.!?;:…"'”’»)\]。！？]\z""")
    return (n > 0) & (symbols | trail | shouted | capitals | cut_off | link | numbers | menu | (has["boiler"] & boiler))


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    symbol_percent: int = 10,
    nav_bars: int = 3,
    menu_words: int = 3,
    max_lost_percent: int = 30,
) -> DataFrame:
    """Per document: the counts, base_failed, the lines left (clean_text), n_lost (characters lost), and kept.

    A line fails by punctuation: it shouts ("!!" three times or more, or 20 capitals and no small letter) or is cut off
    (its end is an ellipsis); by navigation: it has nav_bars or more bars, it is a trail of two or more arrows, it is an
    address with menu_words words or fewer, or it has so few words and no mark at its end; as boilerplate: over
    symbol_percent of it are symbols, over half are digits, it holds a phrase of BOILERPLATE, or it equals an earlier
    line. A document is rejected if its words or repeated windows fail the base rules, or if over max_lost_percent of its
    characters are lost.
    """
    d = keyed(docs, id_col, text_col)
    # one step for each level of expressions, so that nothing is computed twice
    d = d.withColumn("w", words(F.col("text"))).withColumn("lines", F.split("text", "\n", -1))
    d = d.withColumn("n_words", F.size("w").cast("bigint"))
    w = F.col("w")
    d = d.withColumn(
        "h",
        F.when(
            F.col("n_words") >= 4,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ),
    )
    full = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("full", full).withColumn("once", F.array_distinct("full"))
    d = d.withColumn("n_symbols", _symbols(F.col("text")).cast("bigint")).withColumn("low", F.lower("text"))
    d = d.withColumn("has", _flags(F.col("text"), F.col("n_symbols"))).drop("low").withColumn("seen", _lines("once"))
    d = _with_repeated(d).select(
        "doc_id",
        "text",
        "n_words",
        "n_repeat_words",
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        "n_symbols",
        (F.size("full") - F.size("once")).cast("bigint").alias("n_dup_lines"),
        F.aggregate("full", F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)).alias("line_chars"),
        F.transform(
            F.filter("seen", lambda x: ~_line_fails(x, F.col("has"), symbol_percent, nav_bars, menu_words)), lambda x: x["line"]
        ).alias("left"),
    )
    d = d.withColumn("left_chars", F.aggregate("left", F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.col("line_chars") - F.col("left_chars")
    return sealed(
        d,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * lost <= max_lost_percent * F.col("line_chars"))).alias("kept"),
        lost.alias("n_lost"),
        F.array_join("left", "\n").alias("clean_text"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("clean_text")


def stage(docs: DataFrame) -> DataFrame:
    """The kept documents, their text without the lines that failed; all columns of documents."""
    return handed_on(judged(carried(docs)).filter("kept"), docs, F.col("clean_text"))


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled FROM d),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, sum(length(x)) AS n FROM (
    SELECT doc_id, x, b, length(b) AS n, length(b) - length(replace(b, ' ', '')) + 1 AS k FROM (
      SELECT doc_id, x, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM (SELECT DISTINCT doc_id, unnest(filled) AS x FROM w)))
  WHERE NOT (length(regexp_replace(b, '[^#*$%&|<>]', '', 'g')) * 100 > n * 10
    OR length(regexp_replace(b, '[^|]', '', 'g')) >= 3 OR regexp_matches(b, '(?:!!.*){3,}')
    OR (length(regexp_replace(b, '[^>›»→]', '', 'g')) >= 2 AND k <= 12)
    OR (NOT regexp_matches(b, '[a-zà-öø-ÿ]') AND length(regexp_replace(b, '[^A-Z]', '', 'g')) >= 20)
    OR regexp_matches(b, '(?:\.\.\.|…)\z') OR (regexp_matches(b, 'https?://|www\.') AND k <= 3)
    OR length(regexp_replace(b, '[^0-9]', '', 'g')) * 2 > n
    OR (k <= 3 AND NOT regexp_matches(b, '[.!?;:…"''”’»)\]。！？]\z'))
    OR regexp_matches(lower(b), '{phrases}')) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines,
  coalesce(list_sum(list_transform(filled, lambda x: length(x))), 0)::BIGINT AS line_chars FROM w),
j AS (SELECT c.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words, (line_chars - coalesce(l.n, 0))::BIGINT AS n_lost
  FROM c LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost <= 30 * line_chars AS kept, n_lost FROM f
""".replace("{phrases}", "|".join(BOILERPLATE).replace("'", "''"))
