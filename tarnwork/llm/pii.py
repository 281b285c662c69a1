"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Spark expressions only.  Positions come from the pieces between matches: the regular expression splits a text into
pieces, whose lengths with those of the matches give each start, in code points.  Expressions are written so that Java
needs neither deep recursion nor time quadratic in a run of digits or letters.

Null texts count as empty and have no spans; ties in a start are ordered as KINDS are; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

_LOCAL = "A-Za-z0-9._%+-"


#: Lengths of account numbers (IBAN) by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: a text without a match of this, cheaper to test, has no span of the kind
    gate: str
    score: float
    #: words that make the kind likelier when they stand shortly before a span
    near: str
    base: bool = True


#: The first four are the base kinds, in the order that ties are listed in.
KINDS = (
    # A local part begins where a run of its characters does, or where the last match ended.
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", ".", 0.6, "ip|host|address|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|pay|mastercard"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9])(?:{_IBAN})(?![A-Za-z0-9])", "", 0.8, "iban|account|bank|konto|compte", False),
    Kind("ssn", r"[0-9](?<![0-9A-Za-z.-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-", 0.4, "ssn|social|security", False),
    Kind("secret", r"(?<=(?i:token|secret|password|passwd|key)[\"'\x20]{0,2}[=:][\"'\x20]{0,2})[A-Za-z0-9_/+-]{16,}+", "=", 0.8, "token|secret|password|key|auth", False),
)


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), values.alias("value")), lambda x: x["value"].isNotNull())
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.contains(text, F.lit(kind.gate)), spans).otherwise(empty) if kind.gate else spans


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the last digit checks the others."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number, its first four characters put last and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    digit = lambda ch: F.ascii(ch) - 48
    return F.aggregate(turned, F.lit(0), lambda a, ch: F.when(ch.rlike("[0-9]"), (a * 10 + digit(ch)) % 97).otherwise((a * 100 + digit(ch) - 7) % 97)) == 1


def _holds(kind: Kind, value: Column) -> Column:
    digits = digits_of(value)
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
    if kind.name == "ip":
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind.name == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        return mod97(value)
    if kind.name == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS, reach: int = 48) -> Column:
    """array<struct<start, ord, kind, end, score, value>> by start, then order of kind."""
    def of(k: int, kind: Kind) -> Column:
        def told(x: Column) -> Column:
            before = F.lower(F.substring(text, F.greatest(x["start"] - reach, F.lit(0)) + 1, F.least(x["start"], F.lit(reach))))
            score = F.round(F.lit(kind.score) + F.when(before.rlike(rf"(?<![a-z])(?:{kind.near})"), 0.2).otherwise(0.0), 2)
            return F.struct(x["start"].alias("start"), F.lit(k).alias("ord"), F.lit(kind.name).alias("kind"), x["end"].alias("end"), score.alias("score"), x["value"].alias("value"))

        return F.transform(F.filter(_found(text, kind), lambda x: _holds(kind, x["value"])), told)

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(kinds))))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and pii: array<struct<start, ord, kind, end, score, value>>; positions are code points from 0."""
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).select(id_col, spans(F.col("_text"), kinds).alias("pii"))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """The documents with every match that holds replaced by its kind in square brackets; overlaps go by the first."""
    text = text_of(text_col)
    found = spans(F.col("_text"), kinds)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.col("_spans"), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    out = docs.withColumn("_text", text).withColumn("_spans", found)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), whole)).drop("_text", "_spans")
