"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts their score.

DataFrame functions only. Patterns run over classes of characters without repeated groups, so that a very
long run neither recurses nor is scanned again and again; separators that join a span are first replaced,
one for one, by a mark. Offsets are code points: what lies between matches (``split``) and the matches
themselves (``regexp_extract_all``) add up to their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import read_table, text_or_empty

#: In the order of results. The first four are the base; the others are our additions.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
_MARK, _OTHER = "\ue000", "\ue001"  # a mark of the text itself becomes the other, one for one
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words near a span that raise its score.
CONTEXT = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|pay",
    "phone": "phone|tel|call|fax|mobile", "iban": "iban|account|bank|transfer", "local_phone": "phone|tel|call|fax|mobile",
}
#: Code points before and after a span in which such words count.
NEAR = 40
#: Scores: the pattern alone, what a passed checksum and a context word add.
BASE, CHECKED, NEARBY = 0.6, 0.25, 0.15


#: Matches of a text whose places are added up one by one; beyond, whole runs of so many are added up first.
_RUN = 64


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<t, s>>``: matches with their start, from left to right.

    A start is the length of all before it. It is added up from the lengths of whole runs and of the few in
    its own run, so that work does not grow with the square of the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def place(v: Column) -> Column:
        # What each match adds: the text before it and itself.
        steps = F.zip_with(F.transform(F.slice(v["b"], F.lit(1), F.size(v["t"])), F.length), F.transform(v["t"], F.length), lambda x, y: (x + y).cast("long"))
        return _let(steps, lambda st: _let(F.transform(F.sequence(F.lit(0), F.size(st), F.lit(_RUN)), lambda i: total(F.slice(st, i + 1, _RUN))), lambda runs: F.transform(v["t"], lambda t, i: start(v, st, runs, t, i))))

    def start(v: Column, st: Column, runs: Column, t: Column, i: Column) -> Column:
        whole = F.floor(i / _RUN).cast("int")
        before = total(F.slice(runs, F.lit(1), whole)) + total(F.slice(st, whole * _RUN + 1, i - whole * _RUN))
        return F.struct(t.alias("t"), (before + F.length(F.get(v["b"], i))).cast("long").alias("s"))

    return _let(F.struct(found.alias("t"), between.alias("b")), place)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<t:string,s:bigint>>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(F.when(c.rlike("[0-9]"), c).otherwise("0"))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def propose(text: Column) -> dict[str, Column]:
    """Each kind's confirmed spans, as columns of ``array<struct<t, s>>``."""
    clean = F.translate(text, _MARK, _OTHER)
    dots = F.regexp_replace(clean, f"(?<=[{_DOMAIN}])\\.(?=[{_DOMAIN}])", _MARK)
    email = f"(?:\\G|(?<![{_MARK}{_LOCAL}]))[{_MARK}{_LOCAL}]++@[{_DOMAIN}]++{_MARK}[{_MARK}{_DOMAIN}]++"
    joined = F.regexp_replace(clean, "(?<=[0-9])[\\x20-](?=[0-9])", _MARK)
    cards = F.transform(_matches(joined, f"[0-9][0-9{_MARK}]{{13,}}+"), lambda m: F.struct(F.replace(m["t"], F.lit(_MARK), F.lit("")).alias("d"), m["s"].alias("s"), F.length(m["t"]).alias("n")))
    blank = lambda n: F.repeat(F.lit("0"), n)
    cards = F.transform(F.filter(cards, lambda m: F.length(m["d"]).between(14, 19) & luhn(F.when(F.length(m["d"]).between(14, 19), m["d"]).otherwise("1"))), lambda m: F.struct(blank(m["n"]).alias("t"), m["s"].alias("s")))
    has_digit = text.rlike("[0-9]")
    number = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    near = lambda m, n: F.lower(F.substr(text, F.greatest(m["s"] - n + 1, F.lit(1)).cast("int"), F.lit(n)))
    return {
        "email": _if(text.contains("@"), _matches(dots, email)),
        "ip": _if(text.rlike("[0-9]\\.[0-9]"), F.filter(_matches(text, "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"), lambda m: m["t"].rlike(f"^{_BYTE}\\.{_BYTE}\\.{_BYTE}\\.{_BYTE}$"))),
        "card": _if(has_digit & text.rlike("[0-9](?:[\\x20-]?[0-9]){13}"), cards),
        "phone": _if(text.contains("+"), F.filter(_matches(text, "\\+[0-9][\\x20().0-9-]+[0-9]"), lambda m: number(m["t"]).between(10, 15))),
        "iban": _if(has_digit, F.filter(_matches(text, "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"), lambda m: mod97(m["t"]))),
        # A number without a country is taken only where a word nearby says so.
        "local_phone": _if(text.contains("("), F.filter(_matches(text, "\\([0-9]{3}\\)\\x20?[0-9]{3}-[0-9]{4}(?![0-9])"), lambda m: near(m, NEAR).rlike(CONTEXT["local_phone"]))),
    }


def detect(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, spans array<struct<start, rank, kind, end, score>>`` by start and then kind.

    Null and empty texts have none. Rows are independent of each other; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col), text_or_empty().alias("text"))
    found = rows.select(id_col, "text", *(c.alias(f"_{k}") for k, c in propose(F.col("text")).items()))

    def spans(rank: int, kind: str) -> Column:
        def one(m: Column) -> Column:
            end = m["s"] + F.length(m["t"])
            around = F.lower(F.substr(F.col("text"), F.greatest(m["s"] - NEAR + 1, F.lit(1)).cast("int"), F.length(m["t"]) + 2 * NEAR))
            sure = BASE + CHECKED * (kind in ("card", "iban"))
            score = F.lit(sure) + F.when(around.rlike(CONTEXT[kind]), F.lit(NEARBY)).otherwise(F.lit(0.0))
            return F.struct(m["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), score.alias("score"))

        return F.transform(f"_{kind}", one)

    return found.select(id_col, F.array_sort(F.concat(*(spans(i, k) for i, k in enumerate(KINDS)))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: counts by base kind and of all spans, the digest of the base spans, all spans, and all with their scores.

    Null and empty texts have none; very long texts are read whole. Repeated rows come out as often as they are
    there; other columns are ignored. No rows in, no rows out.
    """
    rows = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    show = lambda s, more=(): F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"), *(F.format_string("%.2f", x[k]) for k in more))), ",")
    count = lambda i, k: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long").alias(f"n_{k}")
    base = F.sha2(show(F.filter("spans", lambda x: x["rank"] < 4)), 256).alias("base_sha256")
    return rows.select("doc_id", *(count(i, k) for i, k in enumerate(KINDS[:4])), base, show(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), show(F.col("spans"), ["score"]).alias("scored"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
