"""SimHash fingerprints of word shingles, and near-duplicate classes by pivot distance tables.

Fingerprints link at ``radius`` or fewer differing bits. Blocks guarantee that no such pair is
missed: the 64 bits are cut into ``blocks`` parts, a pair differs in at most ``radius`` of them, so it
agrees wholly on some choice of ``blocks - radius`` parts, and each choice is one shuffle key per
*distinct* fingerprint. Among those that share a key, a table of Hamming distances to fixed reference
fingerprints (pivots) discards every pair whose coordinates differ by more than the radius (triangle
inequality), and the survivors are verified bit by bit. Each key gives only a spanning forest of its
links, found by searching the not yet reached, so a key with very many members gives as many links,
not its pairs; components of the links are found by distributed union-find.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal fingerprints
are one node however many rows have them; a null id never names a component, its row gets the
component of its fingerprint (null if no row of it has an id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import Alike, distinct, mix, word_hashes
from .wordhash import shingle_hashes as shingle_hashes_of

PIVOTS = 16
CHUNK = 1 << 15  # shingles whose bits are counted at once


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule: the hash of their number."""
    return np.array([xxhash.xxh64_intdigest(str(i), 42) for i in range(n)], dtype=np.uint64)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at blanks, tabs, line ends, vertical tabs and form feeds."""
    return raw.lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), seed)] if words else []
    return [digest(g, seed) for g in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (axis 0) have each bit, the highest first: shape (..., 64)."""
    planes = [np.ascontiguousarray(hashes)]
    for _ in range(4):  # sums of 2, 4, 8 and 16 hashes as bit planes, before bits are unpacked
        if len(planes[0]) < 64:
            break
        if len(planes[0]) % 2:
            planes = [np.concatenate([p, np.zeros_like(p[:1])]) for p in planes]
        carry, out = np.uint64(0), []
        for p in planes:
            x, y = p[::2], p[1::2]
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
        planes = [*out, carry]
    total = 0
    for k, p in enumerate(planes):
        bits = np.unpackbits(np.ascontiguousarray(p.astype(">u8")).view(np.uint8).reshape(*p.shape, 8), axis=-1)
        total = total + (bits.sum(0, dtype=np.int64) << k)
    return total


def majority(hashes: np.ndarray) -> int:
    """Bit k is set if more than half of the hashes have it; no hashes: zero."""
    if not len(hashes):
        return 0
    count = sum(bit_counts(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK))
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    return majority(np.array(shingle_hashes(words_of(text or b""), size, seed), dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fingerprint): the fingerprint as a signed long with the same 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fingerprint"])

    return common.arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fingerprint long")


def masks(blocks: int, radius: int) -> list[int]:
    """The bits of each choice of blocks that a pair within the radius must share at least once."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of n items: each reached one looks among those not yet reached, by near(x, free)."""
    free = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(free):
        front, free = [int(free[0])], free[1:]
        while front and len(free):
            x = front.pop()
            found = near(x, free)
            if len(found):
                out += [(x, int(y)) for y in found]
                front += found.tolist()
                free = np.setdiff1d(free, found, assume_unique=True)
    return out


def forest(prints: np.ndarray, reference: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links among fingerprints: the pivot table discards pairs, the rest are verified."""
    table = np.bitwise_count(prints[:, None] ^ reference[None, :]).astype(np.int16)

    def near(x: int, free: np.ndarray) -> np.ndarray:
        for k in range(table.shape[1]):
            free = free[np.abs(table[free, k] - table[x, k]) <= radius]
            if not len(free):
                return free
        return free[np.bitwise_count(prints[free] ^ prints[x]) <= radius]

    return spanning(len(prints), near)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Sorted number columns in parts that never end within a run of the first ``keys`` columns."""
    held: list[list[np.ndarray]] = []  # the last key's rows so far; it may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        end = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in now[:keys]])))
        if held and (end or any(x[0] != y[0] for x, y in zip(now[:keys], held[0], strict=False))):
            yield [np.concatenate(x) for x in zip(*held, [x[:end] for x in now], strict=True)]
            held = []
        elif end:
            yield [x[:end] for x in now]
        held.append([x[end:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def run_starts(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])])
    return starts, np.diff(np.r_[starts, len(columns[0])])


def links(nodes: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Links between distinct fingerprints: nodes has long columns (fingerprint, node); gives pairs (a, b) of nodes."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("c"), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks(blocks, radius))]))
    rows = nodes.select(keys.alias("k"), "fingerprint", "node").select("k.c", "k.key", "fingerprint", "node")
    rows = rows.repartition("c", "key").sortWithinPartitions("c", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots()
        none = np.zeros(0, dtype=np.int64)
        for c, key, prints, node in whole_runs(batches, 2):
            prints = prints.view(np.uint64)
            starts, sizes = run_starts([c, key])
            a, b = [none], [none]
            pairs = starts[sizes == 2]
            x, y = prints[pairs], prints[pairs + 1]
            near = np.ones(len(pairs), dtype=bool)
            for p in reference:
                near &= np.abs(np.bitwise_count(x ^ p).astype(np.int16) - np.bitwise_count(y ^ p)) <= radius
            near &= np.bitwise_count(x ^ y) <= radius
            a.append(node[pairs[near]])
            b.append(node[pairs[near] + 1])
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if tree := forest(prints[at : at + n], reference, radius):
                    tree = np.array(tree)
                    a.append(node[at + tree[:, 0]])
                    b.append(node[at + tree[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return common.arrow_map(rows, run, "a long, b long")


def classes(prints: DataFrame, id_col: str = "doc_id", radius: int = 3, blocks: int = 6) -> DataFrame:
    """Rows (id, fingerprint, component_id): the least id reachable over links, its own included.

    prints: stored rows (id, fingerprint) with a long id.
    """
    nodes = common.stash(prints.groupBy("fingerprint").agg(F.min(id_col).alias("node")), "prints")
    found = common.components(common.stash(links(nodes.where("node is not null"), radius, blocks).distinct(), "links"))
    roots = nodes.join(found, "node", "left").select(F.col("fingerprint").alias("fp"), F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, F.col("fingerprint") == F.col("fp")).select(id_col, "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Fingerprints every whole text and gives its class: rows (id, fingerprint, component_id)."""
    prints = common.stash(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    return classes(prints, id_col, radius, blocks)


BANDS, BAND_ROWS, FAR = 24, 5, 24


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set: of BAND_ROWS least values, each by another mixing of all hashes; none: all zero."""
    if not len(hashes):
        return np.zeros(BANDS, dtype=np.uint64)
    salt = (np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK // 16):
        x = (hashes[at : at + CHUNK // 16, None] ^ salt) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (id, component_id): classes of texts whose word shingle sets have Jaccard ``least`` or more.

    MinHash over the same shingles finds them: texts that agree on all values of one of 24 bands of 5,
    and whose SimHash over these shingles differs in at most 24 bits of 64 (pivot table, then verified),
    are candidates, and their exact similarity decides. Whether two sets share a band depends on their
    similarity alone, wherever the texts differ: at 0.8 they do with probability 0.9999, at 0.85 and more
    with 0.999999. Equal word sequences are one node. Rows without an id are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                same, prints = [], []
                for t in part.column(1).cast(pa.binary()):
                    raw = t.as_py() or b""
                    same.append(xxhash.xxh3_128_digest(b" ".join(words_of(raw))))
                    h = distinct(shingle_hashes_of(word_hashes(raw), shingle))
                    prints.append(np.r_[np.uint64(majority(h)), band_keys(h)].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array(prints, pa.binary())], names=["id", "same", "wide"])

    signed = common.arrow_map(docs.select(id_col, text_col).where(F.col(id_col).isNotNull()), sign, f"id {kind}, same binary, wide binary")
    signed = common.stash(signed, "wide-prints")
    nodes = signed.groupBy("same").agg(F.min("id").alias("node"))
    nodes = common.stash(nodes, "wide-nodes")
    own = signed.select("id", "same", "wide").join(nodes.select(F.col("same").alias("s"), "node"), (F.col("same") == F.col("s")) & (F.col("id") == F.col("node")), "left_semi")
    own = own.dropDuplicates(["id"]).select(F.col("id").cast("long").alias("node"), "wide")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1)
                repeat = lambda x: pa.array(np.repeat(x, BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(raw[:, 1:].ravel().astype(np.int64)), repeat(part.column(0).to_numpy()), repeat(raw[:, 0].astype(np.int64))], names=["key", "node", "print"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots()
        for key, node, prints in whole_runs(batches, 1):
            starts, sizes = run_starts([key])
            names, members = [], []
            for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                root = np.arange(n)
                for x, y in forest(prints[at : at + n].view(np.uint64), reference, FAR):
                    root[y] = root[x]
                ids = node[at : at + n]
                which, where, count = np.unique(root, return_inverse=True, return_counts=True)
                for k in np.flatnonzero(count > 1):
                    chosen = np.sort(ids[where == k])
                    names += [xxhash.xxh3_64_intdigest(chosen.tobytes()) >> 1] * len(chosen)
                    members.append(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *members]))], names=["bucket", "node"])

    rows = common.arrow_map(own, bands, "key long, node long, print long").repartition("key").sortWithinPartitions("key", "node")
    sets = common.stash(common.arrow_map(rows, meet, "bucket long, node long").distinct(), "wide-sets")
    common.release(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("words"))
    texts = texts.join(sets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    found = sets.join(texts, "node").select("bucket", "node", "words").repartition("bucket").sortWithinPartitions("bucket", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(node: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
            tree = spanning(len(node), Alike(hashes, least).near)
            return pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in tree], pa.int64()), pa.array([node[y] for _, y in tree], pa.int64())], names=["a", "b"])

        now, node, hashes = None, [], []
        for batch in batches:
            for bucket, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if bucket != now and node:
                    yield of(node, hashes)
                    node, hashes = [], []
                now = bucket
                node.append(key)
                hashes.append(distinct(shingle_hashes_of(word_hashes(t.as_py()), shingle)))
        if node:
            yield of(node, hashes)

    roots = common.components(common.stash(common.arrow_map(found, verify, "a long, b long").distinct(), "wide-links"), "a", "b").withColumnRenamed("node", "n")
    named = nodes.join(roots, F.col("node") == F.col("n"), "left").select(F.col("same").alias("s"), F.coalesce("root", "node").cast(kind).alias("component_id"))
    return signed.join(named, F.col("same") == F.col("s")).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs, all columns, with the least id of each class of similar texts (all rows of that id). Rows without an id stay."""
    gone = similar_classes(docs, id_col, text_col, shingle, least).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__plinth_id")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__plinth_id"), "left_anti")
