"""Re-Pair grammar compression of token ids, in shards with random access.

Per shard, pairs of neighbouring symbols are replaced by new nonterminals, the most frequent first,
until no pair occurs twice. A round replaces all pairs at least half as frequent as the most frequent
one; where occurrences overlap, the more frequent pair wins. Pairs are counted exactly, once when they
appear: afterwards only the counts beside a replacement change, so all rounds together cost about a
sort of the ids. No rule holds the end id, so every document is a range of symbols of its own.

A shard keeps its rules, how many ids each rule's symbol stands for, the symbols, how many ids precede
every ``MARK``-th symbol, and each document's first symbol. So a range of ids is found by bisection and
decoded from the symbols that hold it alone.

File format: a Parquet table with a row per shard: ``part`` and ``shard`` (ascending id order),
``part_start`` (ids before it in its part), ``n_tokens``, ``doc_ids``, ``doc_tokens`` and ``blob``.
The blob, little-endian: b"RPR3"; unsigned 32-bit counts of rules, symbols and documents, the first
nonterminal and the longest expansion; as unsigned 32-bit the documents' first symbols and the marks;
then, in as many bits each as the largest takes, the expansion lengths, the rules as pairs and the symbols.

Defined cases: a null text is empty (the end id alone); null ids come first and stay null; rows with
one id keep all, ordered by text; an empty table gives an empty store; other columns, of any name, are
ignored; a document longer than a shard is a shard of its own; ids are below 2^31.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens
from .wordhash import strung

SHARD = 1 << 20  # ids
LEAST, SHARE = 2, 2
GONE = -1
MARK = 256  # symbols between two marks of how many ids precede
SCHEMA = "part int, shard int, part_start long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, blob binary"


def grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """An order in which equal pairs stand together, the pairs in it as a << width | b, and the width."""
    width = max(int(a.max(initial=0)), int(b.max(initial=0)), 1).bit_length()
    low = len(a).bit_length()
    key = a.astype(np.int64)
    key <<= width
    key |= b
    if 2 * width + low > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order], width
    key <<= low
    key |= np.arange(len(key))
    key.sort()  # a sort of plain numbers is several times faster than of places
    order = key & ((1 << low) - 1)
    key >>= low
    return order, key, width


def picked(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """a[at]; twice as fast, as the places, which are all there, are not looked at first."""
    return a.take(at, mode="clip")


class Pairs:
    """The pairs of neighbours in a row of symbols: numbered, counted, and where they occur, while symbols are replaced.

    A pair's number is its code; 0 stands for pairs that are never replaced: those with the end id and
    those that occur too rarely. As each new pair has a new symbol, counts only fall once a code is made.
    """

    def __init__(self, ids: np.ndarray, end_id: int, least: int):
        n = len(ids)
        self.end_id, self.least = end_id, least
        self.symbols = np.append(ids, end_id).astype(np.int32)  # an end id stands at place n, before the first and behind the last
        self.after = np.minimum(np.arange(1, n + 2, dtype=np.int32), n)  # the next symbol's place
        self.before = np.arange(-1, n, dtype=np.int32)
        self.before[0] = n
        self.code = np.zeros(n + 1, dtype=np.int32)
        self.made = 1
        self.count, self.rank = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.pair, self.twin = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=bool)
        self.at, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.places = np.zeros(2 * n + 16, dtype=np.int32)  # of each code, when it was made
        self.held = 0
        self.alive = np.zeros(0, dtype=np.int64)  # codes that may still occur often enough
        self.name(self.symbols[:-1], self.symbols[1:])

    def learn(self, at: np.ndarray) -> None:
        """Gives the pairs that begin at these places, all of them new, their codes."""
        self.code[at] = 0
        a, b = picked(self.symbols, at), picked(self.symbols, picked(self.after, at))
        # most occur once: those alone with their hash need no sorting
        bits = (2 * len(a) + 128).bit_length()
        mark = (a.view(np.uint32) * np.uint32(0x9E3779B1) + b.view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        often = np.flatnonzero(picked(np.bincount(mark.view(np.int32)), mark) >= self.least)
        self.name(picked(a, often), picked(b, often), picked(at, often))

    def name(self, a: np.ndarray, b: np.ndarray, at: np.ndarray | None = None) -> None:
        """Codes for those of these pairs that occur often enough; they begin at these places, or at each one."""
        order, key, width = grouped(a, b)
        edge = np.ones(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=edge[1:])
        starts = np.flatnonzero(edge)
        sizes = np.diff(starts, append=len(key))
        key = picked(key, starts)
        first, second = key >> width, key & ((1 << width) - 1)
        often = (sizes >= self.least) & (first != self.end_id) & (second != self.end_id)
        order = order.compress(np.repeat(often, sizes))
        at = order if at is None else picked(at, order)
        sizes, first, second = sizes.compress(often), first.compress(often), second.compress(often)
        new = np.arange(self.made, self.made + len(sizes))
        self.made += len(sizes)
        while self.made > len(self.count):
            self.count, self.rank, self.pair, self.twin, self.at, self.size = (np.r_[x, np.zeros_like(x)] for x in (self.count, self.rank, self.pair, self.twin, self.at, self.size))
        while self.held + len(at) > len(self.places):
            self.places = np.r_[self.places, np.zeros_like(self.places)]
        self.code[at] = np.repeat(new.astype(np.int32), sizes)
        own = slice(self.made - len(sizes), self.made)
        self.count[own], self.size[own], self.pair[own], self.twin[own] = sizes, sizes, (first << 32) | second, first == second
        self.at[own] = self.held + np.cumsum(sizes) - sizes
        self.places[self.held : self.held + len(at)] = at
        self.held += len(at)
        self.alive = np.concatenate([self.alive, new])

    def most(self) -> int:
        """How often the most frequent pair occurs."""
        counts = picked(self.count, self.alive)
        often = np.flatnonzero(counts >= self.least)
        self.alive, self.counts = picked(self.alive, often), picked(counts, often)
        return int(self.counts.max(initial=0))

    def occurrences(self, codes: np.ndarray) -> np.ndarray:
        """The places where these codes still occur, without those of a pair of one symbol that overlap the one before."""
        size = picked(self.size, codes)
        ends = np.cumsum(size, dtype=np.int64)
        where = picked(self.places, np.repeat(picked(self.at, codes) - (ends - size), size) + np.arange(ends[-1]))
        where = where.compress(picked(self.code, where) == np.repeat(codes, size))
        where.sort()
        where = where.astype(np.intp)
        if picked(self.twin, codes).any():
            twin = picked(self.twin, picked(self.code, where))
            run = where[twin]
            begins = np.r_[True, (self.after[run[:-1]] != run[1:]) | (self.code[run[:-1]] != self.code[run[1:]])]
            begin = np.flatnonzero(begins)
            place = np.arange(len(run)) - np.repeat(begin, np.diff(np.r_[begin, len(run)]))
            twin[np.flatnonzero(twin)[place % 2 == 0]] = False
            where = where[~twin]
        return where

    def choose(self, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs that occur ``floor`` times or more, without overlap, after ``most``: the more frequent pair comes first.

        With them the places of the pairs' second symbols, and the pairs' codes, ascending.
        """
        often = np.flatnonzero(self.counts >= floor)
        codes = picked(picked(self.alive, often), np.argsort(picked(self.counts, often), kind="stable"))
        self.rank[codes] = np.arange(1, len(codes) + 1, dtype=np.int32)
        where = self.occurrences(codes)
        own = picked(self.rank, picked(self.code, where))
        if picked(self.twin, codes).any():
            rare = np.bincount(own, minlength=len(codes) + 1) < self.least  # overlapping itself only: never often enough
            self.count[codes[rare[1:]]] = 0
            some = np.flatnonzero(~picked(rare, own))
            where, own = picked(where, some), picked(own, some)
        second = picked(self.after, where)
        meet = np.flatnonzero(second[:-1] == where[1:])  # one pair's second symbol is the next one's first
        left, right = picked(own, meet), picked(own, meet + 1)
        kept = np.ones(len(where), dtype=bool)
        kept[meet[left < right]] = False
        kept[meet[left > right] + 1] = False
        found = np.bincount(own.compress(kept), minlength=len(codes) + 1) >= self.least
        some = np.flatnonzero(kept & picked(found, own))
        return picked(where, some), picked(second, some).astype(np.intp), np.sort(codes[found[1:]])

    def replace(self, here: np.ndarray, second: np.ndarray, kept: np.ndarray, base: int) -> np.ndarray:
        """Puts new symbols, from ``base`` on, for the pairs that ``choose`` gave. The rules, a row each."""
        own = picked(self.code, here)
        self.rank[kept] = np.arange(base, base + len(kept), dtype=np.int32)
        behind = picked(self.after, second).astype(np.intp)
        outer = picked(self.before, here)
        self.symbols[second] = GONE
        outer = outer.compress(picked(self.symbols, outer) != GONE).astype(np.intp)  # their pairs end, too
        ended = np.concatenate([own, picked(self.code, second), picked(self.code, outer)])
        if 16 * len(ended) < self.made:
            np.subtract.at(self.count, ended, np.int32(1))
        else:
            self.count[: self.made] -= np.bincount(ended, minlength=self.made)
        self.symbols[here] = picked(self.rank, own)
        self.code[second] = 0
        self.after[here] = behind
        self.before[behind] = here
        self.learn(np.concatenate([here, outer]))
        pairs = picked(self.pair, kept)
        return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)


def compress(ids: np.ndarray, base: int, end_id: int = tokens.END_ID, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that are left, and the rules: rule i makes symbol base + i stand for two symbols.

    No pair without the end id is left that occurs ``least`` times without overlap.
    """
    known = Pairs(ids, end_id, least)
    rules = [np.zeros((0, 2), dtype=np.int64)]
    made = 0
    while (most := known.most()) >= least:
        here, second, kept = known.choose(max(least, -(-most // SHARE)))
        if len(here):
            rules.append(known.replace(here, second, kept, base + made))
            made += len(rules[-1])
    symbols = known.symbols[:-1]
    return symbols[symbols != GONE].astype(np.int64), np.concatenate(rules)


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Numbers below 2^bits, each in so many bits."""
    wide = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(wide, bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int, at: int) -> tuple[np.ndarray, int]:
    """n packed numbers from a place in the bytes, and the place behind them."""
    end = at + (n * bits + 7) // 8
    padded = raw[at:end] + bytes(8)
    begin = np.arange(n, dtype=np.int64) * bits
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    return ((words[begin >> 3] >> (begin & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4"), end


def rounds(rules: np.ndarray, base: int) -> Iterator[slice]:
    """Parts of the rules, in order, that only name symbols of the parts before them."""
    latest = rules.max(axis=1, initial=0) - base  # the last rule that a rule names
    done = 0
    while done < len(rules):
        later = latest[done:] >= done
        end = done + int(later.argmax()) if later.any() else len(rules)
        yield slice(done, end)
        done = end


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule's symbol stands for."""
    out = np.ones(len(rules) + 1, dtype=np.int64)  # the last one is every id's
    for part in rounds(rules, base):
        block = rules[part]
        out[part] = out[np.where(block < base, -1, block - base)].sum(1)
    return out[:-1]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, size: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for: each rule is written out once, then strung together."""
    size = lengths(rules, base) if size is None else size.astype(np.int64)
    starts = base + np.cumsum(size) - size
    flat = np.arange(base + int(size.sum()), dtype=np.int32)  # an id stands for itself
    begin, count = np.r_[np.arange(base), starts], np.r_[np.ones(base, dtype=np.int64), size]
    for part in rounds(rules, base):
        block = rules[part].ravel()
        own = strung(flat, begin[block], count[block])
        flat[starts[part.start] : starts[part.start] + len(own)] = own
    return strung(flat, begin[symbols], count[symbols])


def expand_some(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """As expand, for few symbols: only rules that they need are followed."""
    s = symbols.astype(np.int64)
    while len(at := np.flatnonzero(s >= base)):
        width = np.ones(len(s), dtype=np.int64)
        width[at] = 2
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]), dtype=np.int64)
        out[ends - width] = s
        pairs = rules[s[at] - base]
        out[ends[at] - 2], out[ends[at] - 1] = pairs[:, 0], pairs[:, 1]
        s = out
    return s


def write_blob(docs: list[np.ndarray], base: int, end_id: int) -> bytes:
    ids = np.concatenate([np.zeros(0, "<u4"), *docs])
    base = max(base, int(ids.max(initial=0)) + 1)
    s, rules = compress(ids, base, end_id)
    size = lengths(rules, base)
    width = np.r_[size, 1][np.where(s < base, len(size), s - base)]
    starts = np.cumsum(width) - width
    first = np.searchsorted(starts, np.cumsum([0, *map(len, docs[:-1])]))
    bits, longest = (base + len(rules)).bit_length(), int(size.max(initial=1))
    head = struct.pack("<5I", len(rules), len(s), len(docs), base, longest)
    packed = pack_bits(size, longest.bit_length()), pack_bits(rules.ravel(), bits), pack_bits(s, bits)
    return b"".join([b"RPR3", head, first.astype("<u4").tobytes(), starts[::MARK].astype("<u4").tobytes(), *packed])


class Shard:
    """A blob, opened. ids(), document(k) and range(start, count) decode all, one or any part of its ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"RPR3":
            raise ValueError("not a shard of this format")
        self.blob = blob
        n_rules, self.n_symbols, n_docs, self.base, longest = struct.unpack_from("<5I", blob, 4)
        self.bits = (self.base + n_rules).bit_length()
        self.first = np.frombuffer(blob, "<u4", n_docs, 24).astype(np.int64)
        self.marks = np.frombuffer(blob, "<u4", -(-self.n_symbols // MARK), at := 24 + 4 * n_docs)
        self.lengths, at = unpack_bits(blob, longest.bit_length(), n_rules, at + 4 * len(self.marks))
        rules, self.at = unpack_bits(blob, self.bits, 2 * n_rules, at)
        self.rules = rules.reshape(-1, 2).astype(np.int64)

    def symbols(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Symbols of a range, unpacked."""
        end = self.n_symbols if end is None else min(end, self.n_symbols)
        begin = start - start % 8  # begins a byte
        return unpack_bits(self.blob, self.bits, end - begin, self.at + begin * self.bits // 8)[0][start - begin :]

    def ids(self) -> np.ndarray:
        return expand(self.symbols(), self.rules, self.base, self.lengths).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        end = int(self.first[k + 1]) if k + 1 < len(self.first) else self.n_symbols
        return expand_some(self.symbols(int(self.first[k]), end), self.rules, self.base).astype("<u4")

    def range(self, start: int, count: int) -> np.ndarray:
        if count <= 0 or not len(self.marks):
            return np.zeros(0, "<u4")
        a = int(np.searchsorted(self.marks, start, "right")) - 1
        b = int(np.searchsorted(self.marks, start + count, "left"))
        s = self.symbols(a * MARK, b * MARK).astype(np.int64)
        ends = int(self.marks[a]) + np.cumsum(np.r_[self.lengths, 1][np.where(s < self.base, len(self.lengths), s - self.base)])
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + count, "left")) + 1
        skip = start - (int(ends[i - 1]) if i else int(self.marks[a]))
        return expand_some(s[i:j], self.rules, self.base)[skip : skip + count].astype("<u4")


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, shard_tokens: int = SHARD) -> None:
    """Encodes all texts in ascending id order and writes the store: one shuffle, by ranges of ids."""
    tok = tokenizer_path or tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        base = tokens.load(tok).tokenizer.get_vocab_size()
        keys, held, size, shard, before, kind_ = [], [], 0, 0, 0, None

        def close() -> pa.RecordBatch:
            long = pa.int64()
            counts = list(map(len, held))
            row = [[part], [shard], [before], [size], [keys], [counts], [write_blob(held, base, end_id)]]
            types = [pa.int32(), pa.int32(), long, long, pa.list_(kind_), pa.list_(long), pa.binary()]
            names = ["part", "shard", "part_start", "n_tokens", "doc_ids", "doc_tokens", "blob"]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            kind_ = batch.schema.field(0).type
            for some in tokens.portions(batch, 1):
                ids, ends = tokens.encode_column(some.column(1), tok, end_id)
                for key, own in zip(some.column(0).to_pylist(), np.split(ids, ends[:-1]), strict=True):
                    keys.append(key)
                    held.append(own)
                    size += len(own)
                    if size >= shard_tokens:
                        yield close()
                        keys, held, shard, before, size = [], [], shard + 1, before + size, 0
        if held:
            yield close()

    order = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()]
    rows = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(*order)
    common.arrow_map(rows, run, SCHEMA.format(kind=kind)).write.parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row per document, decoded from the files: id, start (ids before it in the whole store), n_tokens, ids."""
    store = spark.read.parquet(path)
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()
    # a row per range partition of the writer: their number is bounded by spark.sql.shuffle.partitions
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("part_base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind_ = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                raw = Shard(row["blob"]).ids().tobytes()
                ends = np.cumsum(np.array(row["doc_tokens"], dtype=np.int64))
                starts = ends - row["doc_tokens"]
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([row["part"]] * len(ids), pa.int32()), pa.array(row["doc_ids"], kind_), pa.array(starts + row["part_start"]), pa.array(row["doc_tokens"], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "part_start", "n_tokens", "ids"])

    docs = common.arrow_map(store.select("part", "part_start", "doc_ids", "doc_tokens", "blob"), run, f"part int, doc_id {kind}, part_start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(totals), "part").select("doc_id", (F.col("part_base") + F.col("part_start")).alias("start"), "n_tokens", "ids")
