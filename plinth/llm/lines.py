"""Fuzzy line dedup by MinHash: one line stays of each component of similar lines.

Lines are compared lower-cased with white space runs as one blank; equal ones share a 64-bit hash.
Each distinct line has a one-permutation MinHash signature over its shingles of ``SHINGLE`` characters
(bins without a shingle borrow from the next, with a mark of the distance) cut into bands. Lines that
share a band are candidates; per candidate set the exact Jaccard similarity of shingle sets is computed
along a spanning forest (each line reached looks among those not yet reached), in many sets at once, so no
set gives all its pairs. Components come from distributed union-find; the line with the least (id, position) stays.

High recall: two lines of similarity 0.8 share one of 12 bands of 6 values with probability 0.97, at
0.85 with 0.995. A task signs a line once, however often it has it, before anything is shuffled.

Defined cases: blank lines are never removed; a null text stays null; a text that loses all its lines
is empty; rows with a null id pass unchanged; rows that share an id count as one document (a line of
theirs at one position stays in each); lines of any length are compared whole; an empty table gives no
rows; other columns, of any name, pass, but one named like ``count_col`` gives way to the count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import run_starts, whole_runs
from .wordhash import distinct, strung

SHINGLE = 8
BANDS, ROWS = 12, 6
LEAST = 0.8
NONE = np.uint64(0xFFFFFFFF)


SEEN = 500_000  # lines that a task remembers to have signed


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str | None) -> list[str]:
    """normal() of each line of a text, in order."""
    out = []
    for line in (text or "").lower().split("\n"):
        line = line.strip()
        out.append(line if line.isprintable() and "  " not in line else " ".join(line.split()))
    return out


def key(line: str) -> int:
    """A 64-bit hash of a normalised line, as a signed long."""
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)


def polynomial(x: np.ndarray, size: int, base: int = 0x100000001B3) -> np.ndarray:
    """The polynomial in ``base`` of each ``size`` numbers in a row, modulo 2^64, from those of half as many."""
    if size == 1:
        return x
    half = size // 2
    h = polynomial(x, half, base)
    n = max(0, len(x) - 2 * half + 1)
    h = h[:n] * np.uint64(pow(base, half, 1 << 64)) + h[half : half + n]
    return h if size == 2 * half else h[: max(0, n - 1)] * np.uint64(base) + x[size - 1 : size - 1 + max(0, n - 1)]


def shingle_rows(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, hash) of every character shingle; shorter lines are one shingle."""
    padded = [x if len(x) >= size else x + "\0" * (size - len(x)) for x in lines]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = np.array([len(x) for x in padded], dtype=np.int64)
    h = polynomial(flat, size)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    count = n - size + 1
    owner = np.repeat(np.arange(len(lines)), count)
    at = np.arange(len(owner)) + np.repeat((np.cumsum(n) - n) - (np.cumsum(count) - count), count)
    return owner, h[at]


def signatures(lines: list[str], bins: int = BANDS * ROWS, size: int = SHINGLE) -> np.ndarray:
    """The least 32-bit value of each bin, a row per line, with empty bins filled from the next."""
    owner, h = shingle_rows(lines, size)
    bin_ = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    sig = np.full(len(lines) * bins, NONE, dtype=np.uint64)
    np.minimum.at(sig, owner * bins + bin_.astype(np.int64), h & NONE)
    sig = sig.reshape(len(lines), bins)
    places = np.where(np.concatenate([sig, sig], axis=1) != NONE, np.arange(2 * bins), 4 * bins)
    following = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :bins]
    far = following - np.arange(bins)
    return np.take_along_axis(sig, following % bins, axis=1) + far.astype(np.uint64) * np.uint64(0x1000000000F)


def buckets(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band, a column per band, as signed longs."""
    parts = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        out = (out ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """Rows sorted by their first column, as Python lists per run of it, over batch ends."""
    held: list[list] | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0][0] == row[0]:
                for c, v in zip(held, row, strict=True):
                    c.append(v)
            else:
                if held is not None:
                    yield held
                held = [[v] for v in row]
    if held is not None:
        yield held


def _distinct_lines(batch: pa.RecordBatch, column: int, at: int, n: int) -> dict[int, str]:
    found: dict[int, str] = {}
    for text in batch.column(column).slice(at, n).to_pylist():
        for line in normal_lines(text):
            if line:
                found.setdefault(key(line), line)
    return found


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (bucket, line): distinct candidate sets of two or more lines, each under a hash of its members."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                found = {k: x for k, x in _distinct_lines(batch, 0, at, 2000).items() if k not in seen}
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(found)
                lines, keys = list(found.values()), np.fromiter(found, dtype=np.int64, count=len(found))
                size, begin = 0, 0
                for i, line in enumerate([*lines, None]):
                    if line is None or (size := size + len(line)) > 500_000:
                        some = lines[begin : i + (line is not None)]
                        if some:
                            hashed = buckets(signatures(some))
                            own = keys[begin : begin + len(some)]
                            yield pa.RecordBatch.from_arrays([pa.array(hashed.ravel()), pa.array(np.repeat(own, BANDS))], names=["bucket", "line"])
                        size, begin = 0, i + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, line in whole_runs(batches, 1):
            some = np.repeat((sizes := run_starts([bucket])[1]) > 1, sizes)  # most buckets have one line
            order = np.lexsort((line[some], bucket[some]))
            bucket, line = bucket[some][order], line[some][order]
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (line[1:] != line[:-1])][: len(bucket)]
            bucket, line = bucket[new], line[new]
            if not len(bucket):
                continue
            starts, sizes = run_starts([bucket])
            chosen = np.repeat(sizes > 1, sizes)
            mixed = (line.view(np.uint64) ^ (line.view(np.uint64) >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            name = np.repeat(np.add.reduceat(mixed, starts), sizes)[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(line[chosen])], names=["bucket", "line"])

    signed = common.arrow_map(docs.select(text_col), sign, "bucket long, line long")
    # one sort key, so that Spark sorts by radix
    sets = common.arrow_map(signed.repartition("bucket").sortWithinPartitions("bucket"), meet, "bucket long, line long")
    return sets.distinct()


def forests(words: list[str], sets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (x, y) of the lines of many sets, numbered from 0 and ascending, by exact Jaccard similarity.

    All sets go on together: a round compares one reached line of each with those of its set not yet
    reached; where none is left to look from, it is the first of the others.
    """
    n = len(words)
    owner, h = shingle_rows(words)
    low = np.uint64(64 - max(1, n).bit_length())
    rest = (np.uint64(1) << low) - np.uint64(1)
    own = distinct((owner.astype(np.uint64) << low) | (h >> (np.uint64(64) - low)))  # a line's hashes, each once
    line = (own >> low).astype(np.int64)
    _, code = np.unique((sets[line].astype(np.uint64) << low) | (own & rest), return_inverse=True)  # a set's hashes, numbered
    size = np.bincount(line, minlength=n)
    first = np.cumsum(size) - size
    mark = np.zeros(len(code), dtype=bool)
    reached, free, done = range(3)
    state = np.full(n, free)
    left, links = np.arange(n), [np.zeros((2, 0), dtype=np.int64)]
    while len(left):
        starts, sizes = run_starts([sets[left]])
        x = np.minimum.reduceat(state[left] * n + left, starts) % n
        state[x] = done
        other = state[left] == free
        y, x_of = left[other], np.repeat(x, sizes)[other]
        if len(y):
            seen = strung(code, first[x], size[x])
            mark[seen] = True
            shared = np.add.reduceat(mark[strung(code, first[y], size[y])], np.cumsum(size[y]) - size[y], dtype=np.int64)
            mark[seen] = False
            near = shared >= least * (size[y] + size[x_of] - shared)
            links.append(np.stack([x_of[near], y[near]]))
            state[y[near]] = reached
        goes_on = np.logical_or.reduceat(state[left] == free, starts)
        left = left[np.repeat(goes_on, sizes) & (state[left] != done)]
    x, y = np.concatenate(links, axis=1)
    return x, y


def links(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Rows (a, b): verified links between distinct lines, by their hashes."""
    sets = common.stash(candidates(docs, text_col), "line-sets")
    common.release(docs.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                found = {k: x for k, x in _distinct_lines(batch, 0, at, 2000).items() if k not in seen}
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["line", "words"])

    wanted = sets.select("line").distinct()
    own = common.arrow_map(docs.select(text_col), texts, "line long, words string").join(wanted, "line", "left_semi")
    own = common.stash(own.groupBy("line").agg(F.min("words").alias("words")), "line-texts")
    common.release(docs.sparkSession)
    rows = sets.join(own, "line").select("bucket", "line", "words").repartition("bucket").sortWithinPartitions("bucket")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]  # the numbers of the sets, the lines, their words
        count = room = 0

        def flush() -> pa.RecordBatch:
            sets, line, words = held
            x, y = forests(words, np.array(sets), least)
            line = np.array(line, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(line[x]), pa.array(line[y])], names=["a", "b"])

        for _, line, words in runs(batches, 3):  # many sets are compared at once
            held[0] += [count] * len(line)
            held[1] += line
            held[2] += words
            count, room = count + 1, room + sum(map(len, words))
            if room > 100_000:  # what is made of them stays in the cache
                yield flush()
                held, count, room = [[], [], []], 0, 0
        if count:
            yield flush()

    return common.arrow_map(rows, verify, "a long, b long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, count_col: str | None = None) -> DataFrame:
    """docs with ``text`` less its repeated lines; with count_col, also the number of lines removed."""
    if count_col and count_col.lower() in (id_col.lower(), text_col.lower()):
        raise ValueError(f"{count_col!r} can't take the count")
    docs = docs.drop(count_col) if count_col else docs
    gone_col, own_col = common.fresh(docs, "gone"), common.fresh(docs, "own")
    roots = common.components(common.stash(links(docs, text_col, least).distinct(), "line-links"))
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, where, line = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for at, x in enumerate(normal_lines(text)):
                    if x:
                        which.append(i)
                        where.append(at)
                        line.append(key(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(where, pa.int32()), pa.array(line, pa.int64())], names=["id", "at", "line"])

    seen = common.arrow_map(docs.select(id_col, text_col).where(F.col(id_col).isNotNull()), place, f"id {kind}, at int, line long")
    named = seen.join(roots, F.col("line") == F.col("node"), "left").select("id", "at", F.coalesce("root", "line").alias("line"))
    named = common.stash(named, "line-places")
    common.release(docs.sparkSession)
    first = named.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1")
    # stored, so that the join below shuffles both sides and Spark can split a line that very many documents have
    first = common.stash(first.select(F.col("line").alias("own"), F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at")), "line-first")
    gone = named.join(first, F.col("line") == F.col("own")).where((F.col("id") != F.col("first_id")) | (F.col("at") != F.col("first_at")))
    gone = gone.groupBy("id").agg(F.collect_list("at").alias(gone_col)).withColumnRenamed("id", own_col)
    joined = docs.join(gone, docs[id_col] == F.col(own_col), "left").drop(own_col)
    where = docs.columns.index(text_col)
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, *([StructField(count_col, LongType())] if count_col else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, drop in zip(batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if drop:
                    off = set(drop)
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in off])
                    counts.append(len(off))
                else:
                    counts.append(0)
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[where] = pa.array(texts, pa.string())
            if count_col:
                columns.append(pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return common.arrow_map(joined, cut, schema)
