"""Line dedup: a line goes if an earlier line of the corpus equals it or is within one edit; Spark expressions only.

Equal lines meet on a 128-bit hash.  Lines within one edit meet by a deletion-neighbourhood join: each emits, as hashed
keys, what is left of it when one character is deleted, and itself; lines with an equal variant are verified by their
edit distance.  Emitting every variant of every line would multiply the corpus by its line length, so the neighbourhood
is opened in three steps that lose no pair:

1. a line's half without the edit is a key (3 keys cover every length); lines whose keys nobody shares are done;
2. of the others, the line without one of 8 segments is a key (16 keys), likewise;
3. of what still shares a key, the one-character deletions of the segment join, within that key.

Pairs are made in step 3 only, among lines that agree in all but one segment and in that up to a deletion, so groups of
variable lines (numbered pages) don't make all pairs.

Lines are compared without blanks at their ends.  Lines shorter than ``min_chars`` stay; lines shorter than ``near_chars``
must be equal.  Earliest: smallest doc_id (null first), then text hash, then line number.  Rows that repeat both id and
text are one document and fare alike.  Null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

SEGMENTS = 8


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, th, line_no, line, h1, h2, n of every line that takes part."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_of(text_col), "\n")).alias("line_no", "raw"))
    rows = rows.select("doc", "th", "line_no", F.btrim("raw", F.lit(" \t\x0b\x0c\r")).alias("line"))
    rows = rows.withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), F.col("line")))


def _halves(line: Column, n: Column) -> Column:
    """Keys of the prefixes and suffixes that a line shares with any line within one edit, if the edit is elsewhere."""
    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    key = lambda side, size, part: F.xxhash64(F.lit(side), size, part)
    return F.array_distinct(
        F.array(
            key("p", low, F.left(line, low)),
            key("p", high, F.left(line, high)),
            key("s", n - low, F.right(line, n - low)),
            key("s", n + 1 - high, F.right(line, n + 1 - high)),
        )
    )


def _segments(line: Column, n: Column) -> Column:
    """array<struct<key, middle>>: for either length that the longer of a pair may have, the line without each segment."""
    out = []
    for more in (0, 1):
        c = n + more
        for j in range(SEGMENTS):
            start, end = F.floor(c * j / SEGMENTS).cast("int"), F.floor(c * (j + 1) / SEGMENTS).cast("int")
            tail = c - end
            key = F.xxhash64(F.lit(j), c, F.left(line, start), F.right(line, tail))
            out.append(F.struct(key.alias("key"), F.substring(line, start + 1, F.greatest(n - start - tail, F.lit(0))).alias("middle")))
    return F.array(*out)


def _tail(middle: Column, i: Column) -> Column:
    """All that follows character i, however long."""
    return F.substring(middle, i + 1, F.length(middle))


def _variants(key: Column, middle: Column) -> Column:
    """Hashes of the segment and of each of its one-character deletions, within the key."""
    cut = lambda i: F.xxhash64(key, F.concat(F.left(middle, i - 1), _tail(middle, i)))
    deleted = F.when(F.length(middle) > 0, F.transform(F.sequence(F.lit(1), F.length(middle)), cut)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.array(F.xxhash64(key, middle)), deleted))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another line has, too; minimum and maximum are summed before the shuffle, so no key gathers."""
    known = rows.groupBy(key).agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).where("_a <> _b").select(key)
    return rows.join(known, key, "left_semi")


def _bits(lines: DataFrame) -> DataFrame:
    """A set of hashes as 256 bitmaps of 4 KB, whatever its size: 1 MB that may be broadcast."""
    return lines.select(F.pmod("h1", F.lit(256)).alias("_bucket"), F.pmod(F.shiftright("h1", 8), F.lit(32768)).alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_map"))


def _maybe_in(lines: DataFrame, bits: DataFrame) -> DataFrame:
    """Lines whose hash may be in the set; a filter only, an exact join follows."""
    at = F.pmod(F.shiftright("h1", 8), F.lit(32768))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
    return lines.withColumn("_bucket", F.pmod("h1", F.lit(256))).join(F.broadcast(bits), "_bucket").where(bit == 1).drop("_bucket", "_map")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, near_chars: int = 20, near: bool = True) -> DataFrame:
    """(doc, th, line_no, how) of each line that goes; th is the hash of the text, how is 'equal' or 'near'."""
    lines = _lines(docs, id_col, text_col, min_chars)
    keys = F.when(F.col("n") >= near_chars, _halves(F.col("line"), F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    seen = lines.select("doc", "th", "line_no", "h1", "h2", *([keys.alias("keys")] if near else []))
    at = F.struct("doc", "th", "line_no")
    distinct = seen.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("copies"), *([F.any_value("keys").alias("keys")] if near else []))
    distinct = stage(distinct, "lines")
    repeated = distinct.where("copies > 1").select("h1", "h2", "first")
    equal = lines.select("doc", "th", "line_no", "h1", "h2").join(repeated, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    equal = equal.select("doc", "th", "line_no", F.lit("equal").alias("how")).distinct()
    if not near:
        return equal

    halves = distinct.select("h1", "h2", F.explode("keys").alias("key"))
    alike = stage(_shared(halves, "key").select("h1", "h2").distinct(), "alike")
    texts = _maybe_in(lines.where(F.col("n") >= near_chars).select("h1", "h2", "n", "line"), _bits(alike))
    # An inner join with distinct rows; a semi-join would be moved below the filter and shuffle every line's text.
    texts = texts.join(alike, ["h1", "h2"]).groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    texts = stage(texts, "texts")
    cut = texts.select("h1", "h2", F.explode(_segments(F.col("line"), F.length("line"))).alias("s")).select("h1", "h2", "s.key", "s.middle")
    close = _shared(cut, "key").select("h1", "h2", F.explode(_variants(F.col("key"), F.col("middle"))).alias("variant"))
    close = stage(_shared(close, "variant").distinct(), "close")
    left, right = (close.select("variant", F.struct("h1", "h2").alias(x)) for x in "ab")
    pairs = left.join(right, "variant").where("a < b").select("a", "b").distinct()
    facts = texts.join(distinct.select("h1", "h2", "first"), ["h1", "h2"])
    for x in "ab":
        one = facts.select(F.struct("h1", "h2").alias(x), F.col("line").alias(f"line_{x}"), F.col("first").alias(f"first_{x}"))
        pairs = pairs.join(one, x)
    pairs = pairs.where(F.levenshtein("line_a", "line_b", 1) >= 0)
    later = pairs.select(F.greatest("first_a", "first_b").alias("x")).select("x.doc", "x.th", "x.line_no", F.lit("near").alias("how")).distinct()
    return equal.union(later)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, with text less its repeated lines; n_lines and n_removed (long) are added."""
    gone = removals(docs, id_col, text_col, **options).groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list("line_no").alias("_gone"))
    base = docs.withColumn("_hash", F.xxhash64(text_col))
    joined = base.join(gone, base[id_col].eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_th")), "left")
    lines = F.split(F.col(text_col), "\n")
    # The text is split once; within the function it would be split for every line.
    stay = F.filter(lines, lambda _, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    return (
        joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn(text_col, text)
        .drop("_doc", "_th", "_gone", "_hash")
    )
