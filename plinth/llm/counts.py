"""Unigram token counts of texts by dynamic programming shared over a trie.

Distinct pre-tokens (a word with the mark of the blank before it) are inserted in a trie. A node
keeps the forward score of its prefix: the best sum of piece scores that makes it, and how many
pieces that takes, both from the nodes of shorter prefixes on its path. So a prefix is scored once,
however many pre-tokens begin with it, and the count at a pre-token's last node is stored with it.
The words of a whole Arrow column are numbered by Arrow's dictionary; only distinct ones not yet known
meet the trie, in sorted order. A document's count is the sum over its words.

Pieces are those of a public sentencepiece file; a piece's score is the logarithm of its share under
Zipf's law by its number in the file. A character that no piece holds costs as many byte tokens as
its UTF-8 form has bytes. Among equal scores fewer pieces win. The trie lives in the worker, is
bounded, and starts anew when full; results do not depend on that.

Defined cases: a null or blank text has no words and no tokens; words are what Python's split gives,
of any length (a long one is counted in time in proportion to its length); repeated rows are each
counted; null ids stay null; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

MARK = "▁"
NODES = 600_000  # nodes of a worker's trie, about 100 MB
KNOWN = 300_000  # words of a generation, about 60 MB; a worker keeps two
LONGEST = 1_000  # longer words are scored by themselves and not kept
_splits = np.array([x for x in tokens._wide_blanks.tolist() if x != int.from_bytes(chr(0x180E).encode(), "big")])  # where Python splits


class Trie:
    def __init__(self, pieces: list[tuple[str, float]], byte_score: float):
        self.scores: dict[str, float] = {}
        for piece, score in pieces:
            if piece and score > self.scores.get(piece, -math.inf):
                self.scores[piece] = score
        #: every ending of a piece, with the score of the piece that it is, if any
        self.endings: dict[str, float | None] = {p[i:]: None for p in self.scores for i in range(1, len(p))} | self.scores
        self.byte_score = byte_score
        self.known: dict[bytes, tuple[int, float]] = {}
        self.old: dict[bytes, tuple[int, float]] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}  # node and character to node
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def _forward(self, word: str, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Score and count of word[:end] from those of its prefixes, by length."""
        score, pieces = -math.inf, 0
        endings = self.endings
        for begin in range(end - 1, -1, -1):
            piece = word[begin:end]
            if piece not in endings:
                break
            own = endings[piece]
            if own is not None:
                s = best[begin] + own
                if s > score or s == score and count[begin] + 1 < pieces:
                    score, pieces = s, count[begin] + 1
        if score == -math.inf:
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score, pieces = best[end - 1] + n * self.byte_score, count[end - 1] + n
        return score, pieces

    def insert(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """(tokens, score) of sorted pre-tokens; new nodes are made for the parts of them not seen before."""
        last, nodes, best, count = "", [0], [0.0], [0]  # the path of the word before, up to where the next one leaves it
        for word in words:
            if len(word) > LONGEST:
                own, pieces = [0.0], [0]
                for end in range(1, len(word) + 1):
                    s, n = self._forward(word, end, own, pieces)
                    own.append(s)
                    pieces.append(n)
                yield pieces[-1], own[-1]
                continue
            end = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                end += 1
            del nodes[end + 1 :], best[end + 1 :], count[end + 1 :]
            node, last = nodes[end], word
            for end in range(end + 1, len(word) + 1):
                step = node << 21 | ord(word[end - 1])
                node = self.next.get(step, 0)
                if not node:
                    node = self.next[step] = len(self.best)
                    s, n = self._forward(word, end, best, count)
                    self.best.append(s)
                    self.count.append(n)
                nodes.append(node)
                best.append(self.best[node])
                count.append(self.count[node])
            yield count[-1], best[-1]

    def of(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Tokens and score of distinct words. Known ones stay in two generations; a full one becomes the old."""
        if len(self.known) >= KNOWN:
            self.old, self.known = self.known, {}
        if len(self.best) > NODES:
            self.clear()
        known, old = self.known, self.old
        new = []
        for w in words:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w)
        new = sorted((MARK + w.decode("utf-8", "replace"), w) for w in new)
        long = {}
        for (word, w), found in zip(new, self.insert([word for word, _ in new]), strict=True):
            if len(word) > LONGEST:
                long[w] = found
            else:
                known[w] = found
        return [known[w] if w in known else long[w] for w in words]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and score of each text of an Arrow string column."""
        offsets, data = tokens.byte_column(texts)
        space = tokens.spaces(data, _splits)
        filled = ~space
        if len(data) == 0:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        begins = filled.copy()
        begins[1:] &= space[:-1]
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[heads] = filled[heads]
        starts = np.flatnonzero(begins)
        ends_of_text = np.searchsorted(starts, offsets)
        n_words = np.diff(ends_of_text)
        if not len(starts):
            return n_words, np.zeros(len(texts), np.int64), np.zeros(len(texts))
        text = data[filled]
        places = np.r_[np.cumsum(filled, dtype=np.int32)[starts] - 1, len(text)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(text)]).dictionary_encode()
        found = self.of(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        count = np.fromiter((n for n, _ in found), np.int64, len(found))[codes]
        score = np.fromiter((s for _, s in found), np.float64, len(found))[codes]
        total = np.r_[0, np.cumsum(count)]
        owner = np.repeat(np.arange(len(texts)), n_words)
        return n_words, np.diff(total[ends_of_text]), np.bincount(owner, score, len(texts))


_tries: dict[str, Trie] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> Trie:
    if path not in _tries:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        total = math.log(sum(1 / (i + 1) for i in range(n)))
        pieces = [(model.id_to_piece(i), -math.log(i + 1) - total) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _tries[path] = Trie(pieces, -math.log(n) - total)
    return _tries[path]


def token_counts(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_tokens, score). One pass, no shuffle."""
    path = model_path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(path)
        for batch in batches:
            for part in tokens.portions(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, trie.column(part.column(1)))], names=[id_col, "n_words", "n_tokens", "score"])

    return common.arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words long, n_tokens long, score double")
