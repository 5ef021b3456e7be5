"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), the pairs in linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features of a whole text: words hashed to 2^15 slots, each with its damped frequency, scaled to unit
length; statistics of structure (shares of symbols, digits, upper case, table bars and markers,
repeated words and lines, word and line lengths) in one-hot bands; and as metadata the bands of its
size in bytes, words and lines. Labels, language, source and id are never inputs.

It is fitted on the driver on a bounded sample (``SAMPLE`` rows of each class, by the smallest hash of
the id) of labelled rows that are not held out, one document row (the least text) of each id; features,
not texts, are fetched, of at most ``WORDS`` distinct words a text, by slot. Scoring is one pass without
a shuffle, over whole texts. Defined cases: null and empty texts are scored (statistics of nothing); without
labels of both classes every score is 0.5; repeated rows are each scored; null ids stay null, and are
never held out; ties need no order, as every row has a score of its own; a column named like the score
gives way to it, other columns pass; very long texts are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

SLOTS = 1 << 15
SAMPLE = 3000
WORDS = 20_000  # distinct words of a text that may be fetched to fit
FACTORS = 8
BANDS = 12
STATISTICS = 16
DIM = SLOTS + STATISTICS * BANDS
_symbols = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b not in b" \t\n\r\x0b\x0c")
_ends = b".,;:!?'\"()-"
_strange = bytes(set(_symbols) - set(_ends))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _band(x: float) -> int:
    """Shares in bands that halve towards zero: 0 for none, the last for all."""
    return 0 if x <= 0 else max(1, BANDS - 1 + int(np.floor(np.log2(min(x, 1.0)))))


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[int]:
    """The band of each structure statistic and piece of metadata."""
    n, w = max(len(raw), 1), max(len(words), 1)
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    top = counts.most_common(1)[0][1] if counts else 0
    runs = sum(map(bytes.__eq__, words, words[1:]))
    strange = n - len(raw.translate(None, _strange)) if raw else 0
    return [
        _band(strange / n),
        _band((len(raw) - len(raw.translate(None, b"0123456789"))) / n),
        _band((len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n),
        _band((len(raw) - len(raw.translate(None, _ends))) / n),
        _band(raw.count(b"|") / w),
        _band((raw.count(b"http") + raw.count(b"@") + raw.count(b"www.")) / w),
        _band(sum(map(raw.count, (b"{", b"}", b"<", b">", b"="))) / w),
        _band(runs / w),
        _band(top / w),
        _band(1 - len(counts) / w),
        _band(1 - len(set(filled)) / len(filled) if filled else 0),
        _band(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in filled) / len(filled) if filled else 0),
        min(BANDS - 1, len(raw) // w),  # bytes a word
        min(BANDS - 1, w.bit_length() - 1),
        min(BANDS - 1, len(lines).bit_length() - 1),
        min(BANDS - 1, max(len(raw).bit_length() - 3, 0)),
    ]


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    raw = raw or b""
    words = raw.lower().split()
    counts = Counter(words)
    slots = np.fromiter((zlib.crc32(x) & (SLOTS - 1) for x in counts), dtype=np.int64, count=len(counts))
    values = 1.0 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(values):
        values /= np.sqrt((values * values).sum())
    bands = SLOTS + np.arange(STATISTICS) * BANDS + np.array(statistics(raw, words, counts))
    return np.concatenate([slots, bands]), np.concatenate([values, np.full(STATISTICS, 0.5)])


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[slots] * values[:, None]
        pairs = 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        z = self.bias + float(self.weights[slots] @ values) + pairs
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, seed: int = 7) -> Model:
    """AdaGrad on the log loss, both classes weighing the same in sum."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(DIM), rng.normal(0, 0.01, (DIM, FACTORS)))
    n1 = int(labels.sum())
    if not 0 < n1 < len(labels):
        return Model(0.0, np.zeros(DIM), np.zeros((DIM, FACTORS)))
    weight = np.where(labels == 1, 0.5 * len(labels) / n1, 0.5 * len(labels) / (len(labels) - n1))
    seen_w, seen_v, seen_b = np.full(DIM, 1e-2), np.full((DIM, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            slots, x = rows[r]
            p = model.score(slots, x)
            g = weight[r] * (p - labels[r])
            if abs(g) < 1e-3:
                continue
            v = model.factors[slots]
            total = (v * x[:, None]).sum(0)
            grad_w = g * x + 1e-5 * model.weights[slots]
            grad_v = g * (x[:, None] * total[None, :] - v * (x * x)[:, None]) + 1e-5 * v
            seen_w[slots] += grad_w**2
            seen_v[slots] += grad_v**2
            seen_b += g * g
            model.weights[slots] -= rate * grad_w / np.sqrt(seen_w[slots])
            model.factors[slots] -= rate * grad_v / np.sqrt(seen_v[slots])
            model.bias -= rate * g / np.sqrt(seen_b)
    return model


def bounded(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistics, and the words of the least slots, of a text with very many distinct words."""
    if len(slots) <= WORDS + STATISTICS:
        return slots, values
    kept = np.r_[np.argsort(slots[:-STATISTICS], kind="stable")[:WORDS], np.arange(len(slots) - STATISTICS, len(slots))]
    return slots[kept], values[kept]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` rows of each class, none of them held out."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k")).distinct()
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("k")).select("k", "y", "t")
    # one row of each id and label, whatever the tables repeat: what is fetched is bounded
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bounded(*features(t.as_py())) for t in batch.column(2).cast(pa.binary())]
            slots, values = pa.array([s.tolist() for s, _ in found], pa.list_(pa.int64())), pa.array([x.tolist() for _, x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64()), slots, values], names=["k", "y", "slots", "values"])

    fetched = common.arrow_map(rows, run, "k string, y long, slots array<long>, values array<double>").toArrow().to_pylist()
    fetched.sort(key=lambda r: (r["k"], r["slots"]))
    return fit([(np.array(r["slots"]), np.array(r["values"])) for r in fetched], np.array([r["y"] for r in fetched], dtype=float))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", least: float | None = None) -> DataFrame:
    """All columns of docs and ``out``; with ``least``, only rows with at least that score, without it."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32)))
    if out.lower() == text_col.lower():
        raise ValueError(f"{out!r} can't take the score")
    docs = docs.drop(out) if least is None else docs
    where = docs.columns.index(text_col)
    schema = docs.schema if least is not None else StructType([*docs.schema.fields, StructField(out, DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            found = np.array([own.score(*features(t.as_py())) for t in batch.column(where).cast(pa.binary())], dtype=np.float64)
            if least is not None:
                yield batch.filter(pa.array(found >= least))
            else:
                yield batch.append_column(out, pa.array(found))

    return common.arrow_map(docs, run, schema)
