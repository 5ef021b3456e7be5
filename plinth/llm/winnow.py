"""Winnowing document fingerprints, in SQL functions only.

Every ``K`` bytes in a row of the text's UTF-8 form are hashed, at each position, and of each ``WINDOW``
hashes in a row the least is chosen, the rightmost of equal ones. So two texts that share
``WINDOW + K - 1`` bytes in a row, wherever in them, share a chosen hash. Every chosen one keeps its
position in bytes: an element of a fingerprint is the hash (39 bits) times 2^24, less the position
(modulo 2^24), which makes the rightmost of equal hashes the least element. Windows are rolled by
doubling: the least of 2, 4, 8 ... hashes in a row from the least of half as many.

Defined cases: a null text is empty; an empty text has an empty fingerprint, wholly like another empty
one and unlike any other; a text of fewer than K bytes has one hash, of all of it; with fewer than WINDOW
hashes the least of them is chosen; texts of any length are read whole; rows that share an id each keep their row, and are followed by the next id's row with the least
head; null ids are one id before all others; the last id is followed by the first; an empty table gives
no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

K, WINDOW = 16, 48
BITS = 24  # of an element that tell the position
LOW = (1 << BITS) - 1
HASH = (1 << 63) - 1 - LOW
ALL = 1 << 30  # more than any length; 2^31 - 1 would overflow behind the first place


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where use needs it for every element."""
    return F.transform(F.array(value), use)[0]


def grams(raw: Column, offset: Column | None = None, k: int = K) -> Column:
    """An element for each k bytes in a row: array of longs. Positions count from offset."""

    def element(hash_: Column, at: Column) -> Column:
        return hash_.bitwiseAND(F.lit(HASH)) - at

    def of(long: bool) -> Column:
        def at(i: Column) -> Column:
            i = i - 1 if offset is None else i + (offset - 1)
            return i.bitwiseAND(F.lit(LOW)) if long else i

        def gram(x: Column, i: Column) -> Column:
            return element(F.xxhash64(F.substring(x, i, F.lit(k))), at(i))

        return let(raw, lambda x: F.transform(F.sequence(F.lit(1), F.octet_length(x) - (k - 1)), lambda i: gram(x, i)))

    n = F.octet_length(raw)
    whole = F.array(element(F.xxhash64(raw), F.lit(0) if offset is None else offset.bitwiseAND(F.lit(LOW))))
    last = n if offset is None else n + offset
    return F.when(n == 0, F.array().cast("array<long>")).when(n < k, whole).when(last <= LOW, of(False)).otherwise(of(True))


def minima(g: Column, window: int = WINDOW) -> Column:
    """The least element of each window of grams, or of all where there are fewer."""

    def least(a: Column, by: int) -> Column:  # beyond the end there are nulls, which least leaves out
        return let(a, lambda x: F.zip_with(x, F.slice(x, by + 1, F.lit(ALL)), lambda p, q: F.least(p, q)))

    out, width = g, 1
    while width < window:
        by = min(width, window - width)
        out, width = least(out, by), width + by
    return F.when(F.size(g) > 0, F.slice(out, F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1)))).otherwise(g)


def fingerprint(raw: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen elements of a binary column in order of position: array of longs."""
    return F.array_distinct(let(grams(raw, None, k), lambda g: minima(g, window)))


def edited_fingerprint(chosen: Column, edited: Column, kept: Column, k: int = K, window: int = WINDOW) -> Column:
    """fingerprint(edited), from that of a text which has the same first ``kept`` bytes.

    Elements all of whose windows lie in what is kept are the text's; windows that reach beyond are read anew.
    """
    full = kept - (k - 1)  # grams within what is kept
    begin = full - (2 * window - 1)  # windows from here on are read anew

    def rest(s: Column) -> Column:
        tail = grams(F.substring(s["edited"], s["begin"] + 1, F.lit(ALL)), s["begin"], k)
        again = let(tail, lambda g: F.when(F.size(g) >= window, minima(g, window)).otherwise(F.array().cast("array<long>")))
        return F.array_distinct(F.concat(F.filter(s["chosen"], lambda x: position(x) <= s["begin"] + (window - 1)), again))

    both = F.struct(edited.alias("edited"), chosen.alias("chosen"), begin.alias("begin"))
    return F.when((begin <= 0) | (F.octet_length(edited) > LOW), fingerprint(edited, k, window)).otherwise(let(both, rest))


def position(x: Column) -> Column:
    """Where an element's k-gram begins."""
    return (-x).bitwiseAND(F.lit(LOW)).cast("int")


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x + LOW, BITS)))


def positions(chosen: Column) -> Column:
    return F.transform(chosen, position)


def text_of(chosen: Column) -> Column:
    """A fingerprint as text: its elements in order, as decimal numbers with blanks between."""
    return F.concat_ws(" ", chosen.cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    both = let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(F.size(F.array_intersect(s["a"], s["b"])), lambda n: F.struct(n.alias("n"), (F.size(s["a"]) + F.size(s["b"]) - n).alias("of"))))
    return let(both, lambda r: F.when(r["of"] == 0, F.lit(1.0)).otherwise(r["n"] / r["of"]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Rows (id, text, chosen, head, next_hashes): a text, its fingerprint, the start of the next document,
    as long as this text's last 1/share, and the hashes of the next document's fingerprint.

    Ids are whole numbers. One shuffle of the texts and their fingerprints by id, used twice (both sides
    read the same columns), and one of the starts and hashes.
    """
    none = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    order = common.neighbours(common.in_order(ids, ["key"], "ids"), ["key"], ["key", "n"], wrap=True)
    order = order.select(F.col("key").alias("own"), F.col("prev.key").alias("prev_key"), (F.col("prev.n") / share).cast("int").alias("take"))
    full = rows.withColumn("chosen", fingerprint(F.col("text").cast("binary"))).join(order.hint("shuffle_merge"), F.col("key") == F.col("own"))
    heads = full.select(F.col("prev_key").alias("of"), F.struct(F.left("text", F.col("take")).alias("head"), hashes(F.col("chosen")).alias("hashes")).alias("next"))
    heads = heads.groupBy("of").agg(F.min("next").alias("next"))
    key = F.when(F.col("key") != none, F.col("key")).cast(docs.schema[id_col].dataType).alias(id_col)
    return full.join(heads.hint("shuffle_merge"), F.col("key") == F.col("of")).select(key, "text", "chosen", F.col("next.head").alias("head"), F.col("next.hashes").alias("next_hashes"))
