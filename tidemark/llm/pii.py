"""PII by candidate gradient boosting, with built-in functions only.

Base kinds (email, ip, card, phone) are found by their patterns and checks. High-recall generators propose further spans,
which may overlap each other: long numbers that fail the card check, telephone numbers without a country code,
national ids, bank accounts, spelled-out email addresses, dates of birth, credentials. Boosted trees score each candidate
by its format and its context, and a threshold, calibrated on held-out labelled candidates, selects; of overlapping
ones that are selected, the one of the higher score stays. Base spans always stay, and candidates yield to them.
The trees are trained on TRAINING generated, labelled candidates (a bound that does not depend on the input) and written
as column expressions: finding and scoring are one projection, without a shuffle.

Defined cases: a null or empty text has no spans; a null id passes through; repeated rows are searched one by one;
candidates of equal scores that overlap: the one that ends later stays; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, handed_on, keyed, sealed
from .spans import found, luhn, marked, settled
from .trees import boosted, threshold

#: Labelled candidates that are generated for training.
TRAINING = 8000
#: The share of right ones among held-out candidates that the threshold keeps.
PRECISION = 0.97
#: The base patterns, with possessive repeats and starts that no earlier start makes useless.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: The generators, by the kind they propose; the numbers are those that the card pattern finds, of 12 digits or more.
MORE = {
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])",
    "bank_account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[-. /][0-9]{3,4}[-. ]?[0-9]{3,5}(?![0-9A-Za-z-])",
    "spelled_email": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,}+ ?[\[(]? ?at ?[\])]? ?[a-z0-9-]{2,}+ ?[\[(]? ?dot ?[\])]? ?[a-z]{2,}+(?![a-z0-9])",
    "birth_date": r"(?<![0-9./-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9./-])",
    "credential": r"(?i)(?<![a-z0-9])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|pin)[\"']?[ \t]*+[:=][ \t]*+[\"']?[^\s\"'<>|]{4,}+|\b(?-i:AKIA|ASIA)(?-i:[A-Z0-9]{16})\b",
}
NUMBER = "number"
KINDS = (*MORE, NUMBER)
PHONE_WORDS = r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|whatsapp|contact|reach me|text me|telefon|teléfono|téléphone|handy|móvil|portable)\b"
ID_WORDS = r"(?i)\b(?:ssn|social security|national id|tax id|passport|identity|ausweis|dni|insurance)\b"
BANK_WORDS = r"(?i)\b(?:iban|account|bank|konto|cuenta|compte|transfer|card|visa|mastercard|amex|karte|tarjeta|carte|credit|debit|paid)\b"
MAIL_WORDS = r"(?i)\b(?:mail|e-mail|email|write|contact|reach|correo|courriel)\b"
BIRTH_WORDS = r"(?i)\b(?:born|birth|birthday|dob|geboren|geb|nacid[oa]|nacimiento|née?|naissance)\b"
REFERENCE_WORDS = r"(?i)\b(?:order|invoice|version|isbn|issn|item|ref|reference|page|pages|ticket|batch|part|section|article|year|room|doi|timestamp|tracking|serial|since|until|published|on|updated)\b"
PLACEHOLDERS = r"(?i)(?:required|optional|string|null|none|true|false|example|change|your|xxx|\*\*\*|test|missing|invalid|expired|reset|policy|prompt|field|value|here)"


def _digits(x: Column) -> Column:
    return F.translate(x, " ().-+", "")


def base_spans(d: DataFrame, text: str) -> DataFrame:
    """Adds `base`: sorted structs of start, rank, end and kind, and `_number`: what the card pattern finds, of 12
    digits or more, without the cards."""
    t = F.col(text)
    digits = t.rlike("[0-9]")
    d = d.withColumn("_digit", digits)
    d = found(d, text, EMAIL, "_email", t.contains("@"))
    d = found(d, text, IP, "_ip", F.col("_digit") & t.rlike(r"[0-9]\.[0-9]"))
    d = found(d, text, CARD, "_card", F.col("_digit") & t.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"))
    d = found(d, text, PHONE, "_phone", t.contains("+") & F.col("_digit"))
    part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    small = lambda x: (F.char_length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("bigint"), F.lit(999)) <= 255)
    n = lambda x: F.char_length(_digits(x["match"]))
    checks = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["match"], r"\."), small),
        "card": lambda x: n(x).between(14, 19) & luhn(_digits(x["match"])),
        "phone": lambda x: n(x).between(10, 15),
    }

    def span(r: int, k: str):
        return lambda x: F.struct(
            x["start"].alias("start"), F.lit(r).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind")
        )

    kept = [F.transform(F.filter(f"_{k}", checks[k]), span(r, k)) for r, k in enumerate(BASE)]
    d = d.withColumn("base", F.sort_array(F.concat(*kept)))
    d = d.withColumn("_number", F.filter("_card", lambda x: (n(x) >= 12) & ~checks["card"](x)))
    return d.drop("_digit", *[f"_{k}" for k in BASE])


def _features(kind: Column, before: Column, match: Column, after: Column) -> list[Column]:
    digits = F.char_length(match) - F.char_length(F.translate(match, "0123456789", ""))
    length = F.char_length(match)
    value = F.regexp_replace(match, r"(?i)^[a-z_-]+[\"']?[ \t]*[:=][ \t]*[\"']?", "")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    bare = _digits(match)
    parts = [
        kind,
        digits,
        length,
        length - F.char_length(F.translate(match, " .-/()[]", "")),
        match.rlike(r"^\("),
        match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        match.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$"),
        match.rlike(r"^(?:19|20)[0-9]{2}[-. /]"),
        match.rlike(r"[\[(]"),
        match.rlike(r"(?i) (?:at|dot) "),
        before.rlike(PHONE_WORDS),
        before.rlike(ID_WORDS),
        before.rlike(BANK_WORDS),
        before.rlike(MAIL_WORDS),
        before.rlike(REFERENCE_WORDS),
        before.rlike(BIRTH_WORDS),
        before.rlike(r"[A-Za-z0-9_/#$=*.-]$"),
        after.rlike(r"^[A-Za-z0-9_/%=*+]|^\.[0-9]"),
        before.rlike(r"[:：]\s*$"),
        match.rlike("[A-Z]"),
        match.rlike(PLACEHOLDERS),
        F.char_length(F.regexp_replace(shape, r"0+|a+|A+|[^0aA]+", "x")) / F.greatest(length, F.lit(1)),
        F.size(F.array_distinct(F.split(value, ""))),
        F.coalesce(F.left(bare, F.lit(1)).try_cast("int"), F.lit(-1)),
        match.rlike(r"^(?:[0-9]{4}[ -]){3}[0-9]{3,4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$|^[0-9]{15,16}$"),
        bare.rlike(r"0{5}$|([0-9])\1{6}|0123456|1234567"),
    ]
    return [x.cast("double") for x in parts]


NAMES = [f"f{i}" for i in range(26)]


def labelled_candidates(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """Generated findings: kind (its number), before, match, after and label. Words of the context are made of hashed
    letters; one in fifty labels is wrong on purpose, as labels of real findings are."""
    r = lambda k, n, low=0: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int") + low
    pick = lambda k, *x: F.element_at(F.array(*[F.lit(v) for v in x]), r(k, len(x), 1))
    f = F.format_string
    noise = F.sha2(F.col("id").cast("string"), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(noise)), "[+/=\\s]", "")
    word = lambda k: F.substr(F.translate(F.sha2(F.concat(F.col("id"), F.lit(k)), 256), "0123456789", "aeiousntrl"), F.lit(1), r(k, 7, 2))
    some = F.concat_ws(" ", word("w1"), word("w2"), F.lit(""))
    long_number = lambda k, n: F.substr(F.translate(F.sha2(F.concat(F.col("id"), F.lit(k)), 512), "abcdef", "402468"), F.lit(1), n)
    phone = F.when(r(1, 3) == 0, f("%03d-%03d-%04d", r(2, 800, 200), r(3, 1000), r(4, 10000))).when(
        r(1, 3) == 1, f("(%03d) %03d-%04d", r(2, 800, 200), r(3, 1000), r(4, 10000))
    ).otherwise(f("0%03d %07d", r(2, 900, 100), r(3, 10000000)))
    ssn = f("%03d-%02d-%04d", r(2, 660, 1), r(3, 98, 1), r(4, 9998, 1))
    iban = f("%s%02d %04d %04d %04d %04d %02d", pick(5, "DE", "FR", "ES", "GB"), r(6, 97, 2), r(2, 10000), r(3, 10000), r(4, 10000), r(7, 10000), r(8, 100))
    code = f("%s%02d %04d %04d %04d", pick(5, "AB", "QX", "TR"), r(6, 97, 2), r(2, 10000), r(3, 10000), r(4, 10000))
    spelled = f("%s%s %s %s %s", pick(5, "jane", "max.m", "lea", "tom_k"), r(2, 90).cast("string"),
                pick(6, "at", "[at]", "(at)"), pick(7, "example", "mail", "host"), pick(8, "dot com", "[dot] org", "(dot) net"))
    loose = f("%s at %s dot %s", pick(5, "look", "stop", "meet"), pick(6, "the", "that", "every"), pick(7, "matrix", "line", "mark"))
    ref = F.when(r(1, 2) == 0, f("%04d-%04d-%03d", r(2, 130, 1900), r(3, 10000), r(4, 1000))).otherwise(
        f("%03d %03d %04d", r(2, 900, 100), r(3, 1000), r(4, 10000)))
    bad_ssn = f("%03d-%02d-%04d", r(2, 99, 900), r(3, 98, 1), r(4, 9998, 1))
    plain = F.concat(some, pick(9, "in the ", "words and more ", "", "of the thing ", "then "))
    date = F.when(r(1, 2) == 0, f("%02d.%02d.%04d", r(2, 28, 1), r(3, 12, 1), r(4, 90, 1930))).otherwise(f("%04d-%02d-%02d", r(4, 90, 1930), r(3, 12, 1), r(2, 28, 1)))
    typed = F.concat(pick(5, "3", "4", "5", "6"), long_number("n", F.lit(15)))
    card = F.when(r(1, 2) == 0, typed).otherwise(F.regexp_replace(typed, r"([0-9]{4})(?=[0-9])", r"$1 "))
    other = F.concat(pick(5, "0", "1", "2", "7", "8", "9"), long_number("n", r(6, 8, 11)))
    name = pick(5, "password", "passwd", "token", "secret", "api_key", "pwd")
    joint = pick(6, "=", " = ", ": ", "='", " = \"")
    key = F.when(r(7, 2) == 0, F.substr(noise, F.lit(1), r(8, 33, 10))).otherwise(F.substr(b64, F.lit(1), r(8, 24, 8)))
    access = F.concat(pick(5, "AKIA", "ASIA"), F.substr(F.upper(F.regexp_replace(b64, "[^A-Za-z2-7]", "")), F.lit(1), F.lit(16)))
    stale = F.concat(name, joint, pick(7, "required", "optional", "string", "changeme", "your_password", "example123", "null,", "missing", "reset", "********", "policies", "prompt()", "field"))
    number, credential, birth = float(KINDS.index(NUMBER)), float(KINDS.index("credential")), float(KINDS.index("birth_date"))
    cases = [
        (2, 1, F.concat(some, pick(9, "call ", "phone: ", "my mobile is ", "tel ", "fax: ", "contact ", "Telefon ", "móvil ")), phone),
        (0, 1, F.concat(some, pick(9, "SSN ", "social security: ", "tax id ", "national id: ", "passport ", "insurance ")), ssn),
        (1, 1, F.concat(some, pick(9, "IBAN: ", "bank account ", "transfer to ", "Konto ", "cuenta ")), iban),
        (3, 1, F.concat(some, pick(9, "write to ", "mail: ", "contact me: ", "email ", "correo ")), spelled),
        (2, 0, F.concat(some, pick(9, "order ", "invoice ", "ref: ", "pages ", "isbn ", "version ", "serial ", "tracking ")), F.coalesce(ref, phone)),
        (2, 0, plain, ref),
        (2, 0, plain, phone),
        (0, 0, F.concat(some, pick(9, "part ", "order ", "batch ", "room ", "serial ")), ssn),
        (0, 0, plain, bad_ssn),
        (1, 0, F.concat(plain, pick(10, "item ", "part ", "")), code),
        (3, 0, plain, loose),
        (0, 0, F.concat(plain, F.lit("x=")), ssn),
        (birth, 1, F.concat(some, pick(9, "born ", "date of birth: ", "DOB ", "geboren am ", "nacida el ", "né le ", "birthday: ")), date),
        (birth, 0, F.concat(plain, pick(10, "published ", "on ", "since ", "updated: ", "version ", "")), date),
        (number, 1, F.concat(plain, pick(10, "", "", "card ", "Visa: ", "account ", "Karte ", "paid with ")), card),
        (number, 0, F.concat(plain, pick(10, "order ", "isbn ", "timestamp ", "tracking ", "serial ", "ref: ", "", "", "0.", "id=")), other),
        (number, 0, F.concat(plain, pick(10, "order ", "isbn ", "timestamp ", "0.", "doi ", "serial ")), card),
        (number, 1, F.concat(plain, pick(10, "account ", "bank: ", "Konto ", "cuenta ", "compte ")), other),
        (credential, 1, plain, F.concat(name, joint, key)),
        (credential, 1, plain, access),
        (credential, 0, plain, stale),
        (credential, 0, plain, F.concat(name, joint, word("v"), F.lit("ing"))),
    ]
    n = F.pmod(F.xxhash64("id", F.lit("case")), F.lit(len(cases)))
    made = F.element_at(
        F.array(*[F.struct(F.lit(float(k)).alias("kind"), F.lit(y).alias("label"), F.right(b, F.lit(32)).alias("before"),
                           m.alias("match")) for k, y, b, m in cases]), (n + 1).cast("int"))
    after = pick(11, " and so on", ".", ", then", " ", "\nmore", "", "!!", " | ")
    flipped = F.when(r("wrong", 50) == 0, 1 - F.col("c.label")).otherwise(F.col("c.label")).alias("label")
    return spark.range(rows).select("id", made.alias("c"), after.alias("after")).select("id", "c.kind", flipped, "c.before", "c.match", "after")


def _training(spark: SparkSession, rows: int) -> tuple[DataFrame, Column]:
    """The features and labels, and which rows are held out."""
    data = labelled_candidates(spark, rows)
    columns = _features(F.col("kind"), F.col("before"), F.col("match"), F.col("after"))
    data = data.select("id", F.col("label").cast("double").alias("label"), *[c.alias(x) for c, x in zip(columns, NAMES, strict=True)])
    return data, F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0


def trained(spark: SparkSession, rows: int = TRAINING):
    """(score, threshold): the boosted trees as a function of features, and the calibrated threshold."""
    data, held = _training(spark, rows)
    score = boosted(data.filter(~held), NAMES, rounds=12, depth=4)
    scored = data.filter(held).select(score(lambda i: F.col(NAMES[i])).alias("score"), "label")
    return score, threshold(scored, PRECISION)


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, training: int = TRAINING) -> DataFrame:
    """doc_id, text, base and spans: sorted arrays of structs of start, rank, end and kind (end exclusive)."""
    score, least = trained(docs.sparkSession, training)
    d = base_spans(keyed(docs, id_col, text_col), "text")
    t = F.col("text")
    some = {
        "national_id": t.rlike("[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"),
        "bank_account": t.rlike("[A-Z]{2}[0-9]{2}"),
        "local_phone": t.rlike("[0-9]{2}[)]?[-. /][0-9]{3}"),
        "spelled_email": t.rlike("(?i) dot |[\\[(] ?dot"),
        "birth_date": t.rlike("(?:19|20)[0-9]{2}") & t.rlike("[0-9][./-][0-9]"),
        "credential": t.rlike(r"AKIA|ASIA|(?i)(?:pass|pwd|secret|token|key|pin)[a-z]*[\"']?[ \t]*[:=]"),
    }
    for k, pattern in MORE.items():
        d = found(d, "text", pattern, f"_{k}", some[k])

    def offer(r: int, k: str):
        return lambda x: F.struct(
            F.lit(len(BASE) + r).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind"),
            F.array(*_features(F.lit(float(r)), x["before"], x["match"], x["after"])).alias("f"),
        )

    offered = [F.transform(f"_{k}", offer(r, k)) for r, k in enumerate(KINDS)]
    d = d.withColumn("_offered", F.concat(*offered)).drop(*[f"_{k}" for k in KINDS])
    scored = F.transform("_offered", lambda x: F.struct(
        x["start"].alias("start"), (-score(lambda i: F.get(x["f"], F.lit(i)))).alias("order"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")
    ))
    d = d.withColumn("_scored", scored).drop("_offered")
    # a base span's order is less than any score's
    fixed = F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.lit(-2.0).alias("order"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")))
    d = d.withColumn("_all", F.sort_array(F.concat(fixed, F.filter("_scored", lambda x: x["order"] <= -least)))).drop("_scored")
    d = d.withColumn("_own", F.when(F.size("_all") == F.size("base"), F.slice("_all", 1, 0)).otherwise(settled("_all"))).drop("_all")
    added = F.transform(
        F.filter("_own", lambda x: x["rank"] >= len(BASE)),
        lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    return sealed(d, "doc_id", "text", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9(docs: DataFrame) -> DataFrame:
    d = detected(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return d.select(
        "doc_id", *map(count, BASE), F.sha2(_said("base").cast("binary"), 256).alias("base_sha256"), _said("spans").alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def stage(docs: DataFrame) -> DataFrame:
    """All documents, their spans redacted in the text."""
    d = detected(carried(docs)).select("doc_id", "text", "spans")
    return handed_on(marked(d, "text", "spans", "clean_text"), docs, F.col("clean_text"))
