"""Exact token ids by a public ``tokenizers`` file, with the library called for distinct pieces only.

The byte-level pre-tokeniser never joins a character that is no white space with white space behind
it, nor ASCII letters, digits and punctuation with each other (but for an apostrophe and the letters
behind it). So a text may be cut before an ASCII white space that follows another character, and where
such classes change, and the ids of the pieces joined are the ids of the text. The cuts of a whole
Arrow column are found in its bytes, its pieces are numbered by Arrow's dictionary, and only those not
yet known are encoded: one of letters, of digits or of punctuation (perhaps after a blank) is one
pre-token, which the library's model encodes; any other goes through the whole library. Those that
begin with a blank go through it many in a call, and are told apart by the bytes of their tokens.
Pieces keep their ids in the worker; ids are unsigned 32-bit, little-endian.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
CACHED = 450_000  # pieces of a generation, about 90 MB; a worker keeps two
SLICE = 4 << 20  # bytes of a column handled at once
TOGETHER = 1 << 18  # bytes of new pieces in a call of the library

PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: The bytes that the byte-level alphabet shows as other characters, in the order of those from U+0100 on.
_shown = {byte: 256 + i for i, byte in enumerate([*range(33), *range(127, 161), 173])}
_alphabet = np.array([_shown.get(byte, byte) for byte in range(256)], dtype="<u2")
_loaded: dict[str, Encoder] = {}

_wide_blanks = np.array(sorted(int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_safe = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)  # where a block may end

#: What a byte may be: ASCII letter, digit, punctuation, apostrophe or white space, a control character
#: that some hold for white space, the first byte of a wide white space character.
OTHER, LETTER, DIGIT, MARK, QUOTE, BLANK, CONTROL, LEAD = range(8)


def _kind(b: int) -> int:
    if b in _safe:
        return BLANK
    if 0x1C <= b < 0x20:
        return CONTROL
    if b in (0xC2, 0xE1, 0xE2, 0xE3):
        return LEAD
    if b >= 128:
        return OTHER
    return LETTER if chr(b).isalpha() else DIGIT if 48 <= b <= 57 else QUOTE if b == 39 else MARK if 32 < b < 127 else OTHER


_kinds = bytes(map(_kind, range(256)))

#: Between which kinds (8 times the first one and the second) a token surely ends, and those before white space alone.
_between = {8 * a + b for a, b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2))}
_before_blanks = {8 * a + BLANK for a in range(8) if a not in (BLANK, CONTROL)}
_blank_cuts = bytes(k in _before_blanks for k in range(256))
_cuts = bytes(k in _before_blanks | _between for k in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """A tokenizer file's exact ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # pieces are kept here
        self.model = self.tokenizer.model.tokenize
        # the same model behind a cut before each blank, which the byte-level alphabet shows as U+0120
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Split("\u0120", "merged_with_next")
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int32)  # bytes of each id
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special).encode() or b"(?!)")
        self.id_bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.feed = self.whole("\n")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        lead, word = (self.feed, text[1:]) if text[0] == "\n" else (b"", text)
        core = word[1:] if word[:1] == " " and not lead else word
        if not core or not (core.isalpha() or core.isascii() and (core.isdigit() or not core.strip(PUNCTUATION))):
            return self.whole(text)
        if text.isascii():
            shown = "\u0120" + core if word[0] == " " else core
        else:
            shown = word.encode().decode("latin-1").translate(_shown)
        return lead + b"".join([self.id_bytes[t.id] for t in self.model(shown)])

    def together(self, pieces: list[bytes], words: bool) -> list[bytes]:
        """The ids of pieces between which a text may be cut, by one call of the library for many."""
        out, upto = [], np.cumsum(list(map(len, pieces)))
        while len(out) < len(pieces):
            at = len(out)
            done = int(upto[at - 1]) if at else 0
            some = pieces[at : max(at + 1, int(np.searchsorted(upto, done + TOGETHER, "right")))]
            raw = b"".join(some)
            if words:
                found = self.words.encode_batch_fast([_alphabet[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")], add_special_tokens=False)
            else:
                found = self.tokenizer.encode_batch_fast([raw.decode("utf-8", "replace")], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            bytes_to, ends = np.cumsum(self.width[ids]), upto[at : at + len(some)] - done
            last = np.searchsorted(bytes_to, ends)
            if not np.array_equal(bytes_to.take(last, mode="clip"), ends):  # special tokens that are written in other letters
                out += map(self.piece, some)
                continue
            raw, cuts = ids.tobytes(), (4 * (last + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def fresh(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of new pieces: of words, of others that a cut before their blank sets apart, and of the rest."""
        kinds = []
        for p in pieces:
            kind = 0
            if p[0] == 32:
                text = p[1:].decode("utf-8", "replace")
                kind = 1 if text.isalpha() else 2 if text[-1:].isprintable() and text[-1:] not in ("", " ") else 0
            kinds.append(kind)
        found = [None, *(iter(self.together([p for p, k in zip(pieces, kinds, strict=True) if k == own], own == 1)) for own in (1, 2))]
        return [next(found[k]) if k else self.piece(p) for p, k in zip(pieces, kinds, strict=True)]

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces. Known ones stay in two generations; a full one becomes the old."""
        if len(self.known) >= CACHED:
            self.old, self.known = self.known, {}
        out = list(map(self.known.get, pieces))
        new = [p for p, ids in zip(pieces, out, strict=True) if ids is None]
        if not new:
            return out
        ids = list(map(self.old.get, new)) if self.old else [None] * len(new)
        never = iter(self.fresh([p for p, x in zip(new, ids, strict=True) if x is None]))
        ids = [next(never) if x is None else x for x in ids]
        self.known.update(zip(new, ids, strict=True))
        rest = iter(ids)
        return [next(rest) if x is None else x for x in out]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow string column in a row, and where those of each end. Nulls have none."""
        n = len(texts)
        offsets, data = byte_column(texts)
        ids, cut_ids, seen = [], [np.zeros(1, np.int64)], 0
        at_text = 0  # texts whose end is not yet counted
        collects = gc.isenabled()
        gc.disable()  # only flat objects are made here; walking them costs a tenth of the time
        try:
            for begins, end in blocks(data, offsets, self.special):
                some, counts = self.pieces_of(data, begins, end)
                ids.append(some)
                before = np.r_[0, np.cumsum(counts)]
                closed = int(np.searchsorted(offsets[1:], end, "right")) if end < len(data) else n
                places = np.searchsorted(begins, offsets[1 + at_text : 1 + closed], "left")
                cut_ids.append(seen + before[places])
                at_text, seen = closed, seen + len(some)
        finally:
            if collects:
                gc.enable()
        ends = np.concatenate(cut_ids)[1:]
        if len(ends) < n:  # all texts are empty
            ends = np.r_[ends, np.full(n - len(ends), seen)].astype(np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, "<u4")), ends

    def pieces_of(self, data: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that begin at these places, and how many each has."""
        first = int(begins[0])
        places = np.r_[begins - first, end - first].astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(data[first:end])])
        coded = column.dictionary_encode()
        found = self.of(strings(coded.dictionary))
        size = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        counts = size.take(codes, mode="clip")  # the places are all there
        ends = np.cumsum(counts, dtype=np.int32)
        begin = (np.cumsum(size, dtype=np.int32) - size).take(codes, mode="clip") - (ends - counts)
        places = np.repeat(begin, counts)
        places += np.arange(ends[-1], dtype=np.int32)
        return flat.take(places, mode="clip"), counts


def strings(column: pa.Array) -> list[bytes]:
    """A binary column without nulls, several times faster than by ``to_pylist``."""
    _, places, raw = column.buffers()
    places = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = raw.to_pybytes() if raw else b""
    return [raw[a:b] for a, b in zip(places, places[1:], strict=False)]


def byte_column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an Arrow string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, places, raw = texts.buffers()
    if not len(texts) or raw is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]


def kinds(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_kinds), np.uint8)


def wide_spaces(data: np.ndarray, kind: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where white space characters of several bytes begin, and how many bytes each has."""
    lead = np.flatnonzero(kind == LEAD)
    padded = np.r_[data, np.zeros(2, np.uint8)] if len(lead) else data
    size = np.where(padded[lead] == 0xC2, 2, 3)
    char = (padded[lead].astype(np.int64) << 16) | (padded[lead + 1].astype(np.int64) << 8) | np.where(size == 2, 0, padded[lead + 2]) if len(lead) else lead
    found = np.isin(char, wide)
    return lead[found], size[found]


def spaces(data: np.ndarray, wide: np.ndarray = _wide_blanks) -> np.ndarray:
    """Which bytes belong to a white space character (or to a control character that Python holds for one)."""
    kind = kinds(data)
    space = (kind == BLANK) | (kind == CONTROL)
    places, size = wide_spaces(data, kind, wide)
    for k in range(3):
        space[places[size > k] + k] = True
    return space


def cuts_of(data: np.ndarray, table: bytes) -> np.ndarray:
    """Before which bytes a text may be cut, by a table of pairs of kinds, but not between two white space characters."""
    kind = kinds(data)
    pairs = bytearray(len(data))
    pair = np.frombuffer(pairs, np.uint8)
    pair[1:] = kind[:-1] << 3
    pair |= kind
    cut = np.frombuffer(pairs.translate(table), bool)
    places, size = wide_spaces(data, kind, _wide_blanks)
    behind = places + size
    cut[behind[behind < len(data)]] = False
    return cut


def blocks(data: np.ndarray, offsets: np.ndarray, special: re.Pattern):
    """The column's bytes in blocks of about SLICE: the places where pieces begin, and where the block ends."""
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]  # of texts that are not empty
    at = 0
    while at < len(data):
        size = SLICE
        while True:
            end = min(len(data), at + size)
            own = data[at:end]
            cut = cuts_of(own, _blank_cuts if special.search(own) else _cuts)
            cut[0] = True
            cut[starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at] = True
            cuts = np.flatnonzero(cut) + at
            if end == len(data):
                break
            # the last piece may go on; before white space the next byte matters less than its own first
            safe = cuts[np.isin(data[cuts], _safe)]
            if len(safe) and safe[-1] > at:
                end = int(safe[-1])
                cuts = cuts[cuts < end]
                break
            size *= 2
        yield cuts, end
        at = end


def load(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices with at most SLICE bytes of a string column, or one row."""
    offsets, _ = byte_column(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def encode_column(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column's texts in a row, each followed by the end id, and where each ends."""
    ids, ends = load(path).column(texts)
    if end_id is None:
        return ids, ends
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def encode_all(texts: list[str | None], path: str, end_id: int | None = END_ID) -> list[bytes]:
    """The ids of each text, as bytes."""
    ids, ends = encode_column(pa.array(texts, pa.string()), path, end_id)
    return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(ends) else []


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, without an end id."""
    return encode_all(texts, path, None)
