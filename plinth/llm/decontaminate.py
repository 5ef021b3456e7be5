"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item has the SimHash of its word shingles. A document's windows of as many words as
the item (or the whole document, where it is shorter) are compared with it: blocks of the fingerprint
within a smaller radius (multi-index Hamming search) guarantee every item within ``radius`` bits, and
the exact weighted-shingle similarity (weighted Jaccard; a shingle weighs as often as it occurs)
decides. Windows are skipped, exactly, where they share too few shingles with all items to be
similar enough. Words are lower-cased (A-Z) with ASCII punctuation as blanks.

The radius is wide, as fingerprints scatter: the exact similarity decides anyway, and the README has
the recall as measured. Eight blocks of eight bits find all items within any radius below 32.

The benchmark travels to the executors in blocks of at most ``BLOCK`` items, each counted and weighed
before it is fetched; documents are never shuffled, but read once per block. Defined cases: a null text
has no words and matches nothing; an item without words never matches; items with equal texts all match;
an item repeated with its id counts once; documents that are repeated are each reported, the earliest
of an item's equally similar windows; texts of any length are searched whole; ids may be of any type;
empty tables give no rows; other columns, of any name, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from . import common, simhash
from .wordhash import PLAIN, distinct, shingle_hashes, word_hashes

BLOCK = 4096  # items
BLOCK_BYTES = 32 << 20
RADIUS = 26
PARTS = 8
MASK = (1 << 64 // PARTS) - 1
SIEVE = 20  # bits of a hash that a table of all items' shingles is asked first


class Index:
    """Items ready for search. similarity(a, b): weighted Jaccard of two arrays of shingle hashes."""

    def __init__(self, items: list[tuple], size: int, least: float, radius: int):
        self.size, self.least, self.radius = size, least, radius
        self.ids, self.hashes, self.words = [], [], []
        for key, text in items:
            words = word_hashes(text, PLAIN)
            if len(words):
                self.ids.append(key)
                self.words.append(len(words))
                self.hashes.append(np.sort(shingle_hashes(words, size)))
        self.known = distinct(np.concatenate([np.zeros(0, np.uint64), *self.hashes]))
        self.sieve = np.zeros(1 << SIEVE, dtype=bool)
        self.sieve[(self.known >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
        self.prints = np.array([simhash.majority(h) for h in self.hashes], dtype=np.uint64)
        self.lengths = sorted(set(self.words))
        self.by_length = {n: np.flatnonzero(np.array(self.words) == n) for n in self.lengths}
        near = radius // PARTS  # within radius bits, one of the parts differs in so many at most
        flips = [0] + [sum(1 << b for b in c) for k in range(1, near + 1) for c in combinations(range(64 // PARTS), k)]
        self.flips = np.array(flips, dtype=np.int64)
        self.known_by_length = {n: distinct(np.concatenate([self.hashes[i] for i in own])) for n, own in self.by_length.items()}
        self.blocks = {}
        for n, own in self.by_length.items():
            for k in range(PARTS):
                block = (self.prints[own] >> np.uint64(64 // PARTS * k)).astype(np.int64) & MASK
                order = np.argsort(block, kind="stable")
                self.blocks[n, k] = block[order], own[order]

    def near(self, n: int, print_: int) -> np.ndarray:
        """All items of n words within the radius."""
        found = []
        for k in range(PARTS):
            block, own = self.blocks[n, k]
            wanted = ((print_ >> (64 // PARTS * k)) & MASK) ^ self.flips
            a, b = np.searchsorted(block, wanted, "left"), np.searchsorted(block, wanted, "right")
            found += [own[i:j] for i, j in zip(a[b > a], b[b > a], strict=True)]
        if not found:
            return np.zeros(0, dtype=np.int64)
        own = distinct(np.concatenate(found))
        return own[np.bitwise_count(self.prints[own] ^ np.uint64(print_)) <= self.radius]

    @staticmethod
    def similarity(a: np.ndarray, b: np.ndarray) -> float:
        keys, counts = np.unique(a, return_counts=True)
        other, theirs = np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(keys, other, assume_unique=True, return_indices=True)
        shared = int(np.minimum(counts[i], theirs[j]).sum())
        return shared / (len(a) + len(b) - shared)

    def search(self, raw: bytes | None) -> list[tuple]:
        """(item id, first word, words, similarity) of each item's best window that is similar enough."""
        words = word_hashes(raw, PLAIN)
        if not len(words) or not len(self.known):
            return []
        h = shingle_hashes(words, self.size)
        hit = self.sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)]
        if hit.any():
            some = np.flatnonzero(hit)
            at = np.searchsorted(self.known, h[some])
            hit[some] = self.known[np.minimum(at, len(self.known) - 1)] == h[some]
        if not hit.any() and len(words) >= self.size and self.lengths[0] >= self.size:
            return []  # items or documents shorter than a shingle have hashes of their own
        hits = np.flatnonzero(hit)
        best: dict[int, tuple] = {}
        for n in self.lengths:
            if n < self.size and n <= len(words):  # items shorter than a shingle: windows are hashed anew
                short = shingle_hashes(words, n)
                starts = np.flatnonzero(np.isin(short, self.known_by_length[n]))
                windows = [(int(s), n, short[s : s + 1]) for s in starts]
            else:
                m = max(1, min(n, len(words)) - self.size + 1)
                full = max(1, n - self.size + 1)
                # weighted Jaccard of m and full shingles is at least `least` only with so many shared
                need = self.least * (m + full) / (1 + self.least) - 1e-9
                if m < need or len(hits) < need:
                    continue
                own_hits = hits[np.isin(h[hits], self.known_by_length[n])]
                if len(own_hits) < need:
                    continue
                there = np.zeros(len(h) + 1, dtype=np.int64)
                there[own_hits + 1] = 1
                sums = np.cumsum(there)
                shared = sums[m:] - sums[:-m]
                windows = [(int(s), min(n, len(words)), h[s : s + m]) for s in np.flatnonzero(shared >= need)]
            for s, width, own in windows:
                for i in self.near(n, simhash.majority(own)).tolist():
                    score = self.similarity(own, self.hashes[i])
                    if score >= self.least and (i not in best or score > best[i][3]):
                        best[i] = (self.ids[i], s, width, score)
        return list(best.values())


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks whose number and bytes are all checked before one leaves its table."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, -(-2 * n // BLOCK), -(-2 * size // BLOCK_BYTES))
    while n:
        block = F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int")
        seen = rows.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("size"))
        # distinct rows scatter, so a full block gets smaller with more of them; one huge item is a block of its own
        if not seen.where((F.col("n") > 1) & ((F.col("n") > BLOCK) | (F.col("size") > BLOCK_BYTES))).head(1):
            break
        parts *= 2
    for part in range(parts if n else 0):
        own = rows if parts == 1 else rows.where(block == part)
        yield sorted(((i, bytes(t) if t is not None else None) for i, t in own.collect()), key=repr)


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, size: int, least: float, radius: int, item_id: str, item_text: str):
    for items in blocks_of(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        made: dict[str, Index] = {}

        def index(sent=sent, made=made) -> Index:
            if "x" not in made:
                made["x"] = Index(sent.value, size, least, radius)
            return made["x"]

        yield index


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Rows (id, item_id, first_word, n_words, similarity): each item that a document holds, at its best window."""
    common.ship(docs.sparkSession)
    kind, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item}, first_word long, n_words long, similarity double"
    item_kind = to_arrow_type(benchmark.schema[item_id].dataType)
    out = None
    for index in _passes(docs, benchmark, text_col, shingle, least, radius, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(k, hit) for k, text in enumerate(batch.column(1).cast(pa.binary())) for hit in index().search(text.as_py())]
                keys = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
                columns = [pa.array([h[c] for _, h in found], t) for c, t in enumerate((item_kind, pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=[id_col, "item_id", "first_word", "n_words", "similarity"])

        part = common.arrow_map(docs.select(id_col, text_col), run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, without those that hold an item. One pass over them per block of items."""
    for index in _passes(docs, benchmark, text_col, shingle, least, radius, item_id, item_text):
        where = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], index=index, where=where) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not index().search(t.as_py()) for t in batch.column(where).cast(pa.binary())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = common.arrow_map(docs, run, docs.schema)
    return docs
