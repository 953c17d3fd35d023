"""SentencePiece encoding with byte offsets into the source, and decoding.

Encoding has three steps, each keeping the alignment to the source bytes:

1. Normalisation by longest prefix through the model's compiled character map (a double-array trie followed
   by a pool of replacement strings): at each place the longest key of the trie that starts there is replaced,
   else one character is copied. Every normalised character records the source bytes that it stands for.
   Then white space is escaped, squeezed where the model asks for it, and the dummy prefix is put in front.
2. Segmentation. For BPE models in which no piece holds the space mark behind another character, merges cannot
   cross the place before a run of marks, so each such segment is encoded once (library, no sampling) and kept in a
   bounded cache per worker. Any other model or text goes to the library whole.
3. Projection: the pieces of a segment lie one behind the other on the normalised text; the alignment turns each into
   a span of source bytes. A byte-fallback piece has the span of the one byte that it stands for; the dummy prefix has
   an empty span.

Defined results: null is the empty text, whose ids are just the end id (where asked for); rows are never merged or
dropped; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Lexicon, add_columns, aside, chunk_bounds, chunk_hashes, lean, string_buffer

MARK = "▁"
CACHE_ENTRIES = 200_000


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i, n = 0, len(buf)

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = buf[i]
            out |= (b & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b < 0x80:
                return out, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = buf[i : i + size], i + size
        yield tag >> 3, value


@lru_cache(maxsize=4)
def model_settings(path: str) -> dict:
    """What the model file says on normalisation: fields of trainer_spec (2) and normalizer_spec (3)."""
    out = {"bpe": False, "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 2:
                out["bpe"] = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                out |= {"charsmap": spec.get(2, b""), "add_dummy_prefix": bool(spec.get(3, 1)), "remove_extra_whitespaces": bool(spec.get(4, 1)), "escape_whitespaces": bool(spec.get(5, 1))}
    return out


class CharsMap:
    """The compiled character map: little-endian size, a double-array trie of 32-bit units, replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement."""
        units = self.units
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[start : self.pool.index(b"\0", start)]
        return found


def normalize(text: str, settings: dict, charsmap: CharsMap) -> tuple[str, np.ndarray]:
    """The normalised text and, for each of its characters and its end, the source byte where it starts.

    Without a character map, squeezing and literal marks this is one replacement and one cumulative sum.
    """
    if not text:
        return "", np.zeros(1, np.int64)
    prefix = settings["add_dummy_prefix"]
    if not charsmap.units and not settings["remove_extra_whitespaces"]:
        body = text.replace(" ", MARK)
        if text.isascii():
            start = np.arange(len(text) + 1, dtype=np.int64)
        else:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            start = np.zeros(len(text) + 1, np.int64)
            np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=start[1:])
        return (MARK + body, np.concatenate([[0], start])) if prefix else (body, start)
    data, out, at, i = text.encode("utf-8", "surrogatepass"), [], [], 0
    while i < len(data):
        hit = charsmap.longest(data, i)
        if hit is None:
            lead = data[i]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            hit = size, data[i : i + size]
        for c in hit[1].decode("utf-8", "replace"):
            out.append(c)
            at.append(i)
        i += hit[0]
    if settings["remove_extra_whitespaces"]:
        kept = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
        while kept and out[kept[-1]] == " ":
            kept.pop()
        end = at[kept[-1] + 1] if kept and kept[-1] + 1 < len(at) else len(data)
        out, at = [out[k] for k in kept], [at[k] for k in kept]
    else:
        end = len(data)
    if not out:
        return "", np.zeros(1, np.int64)
    body = "".join(out).replace(" ", MARK)
    return (MARK + body, np.array([at[0], *at, end], np.int64)) if prefix else (body, np.array([*at, end], np.int64))


class Encoder:
    """Encodes texts to (ids, begins, ends); one per worker process."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.settings = model_settings(path)
        self.map = CharsMap(self.settings["charsmap"])
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.eos = self.sp.eos_id()
        self.byte = {i for i in range(len(pieces)) if self.sp.is_byte(i)}
        self.width = np.array([1 if i in self.byte else -1 if self.sp.is_unknown(i) else len(p.encode()) - 2 * p.count(MARK) for i, p in enumerate(pieces)], np.int64)
        s = self.settings
        #: segments can be encoded apart
        self.apart = s["bpe"] and s["add_dummy_prefix"] and s["escape_whitespaces"] and not s["remove_extra_whitespaces"] and not self.map.units and bool(self.byte) and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.lexicon = Lexicon(self._segments, CACHE_ENTRIES)

    def _segments(self, segs: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sizes, ids, and ends of the pieces in bytes of the normalised segment, where a mark counts as one byte.

        A segment is written as the library gets it: without the first mark, which the dummy prefix brings back.
        """
        ids = self.sp.encode(segs, num_threads=1)
        for k, s in enumerate(segs):
            if not s:  # the library puts the dummy prefix before any text but the empty one
                ids[k] = [self.sp.piece_to_id(MARK)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        width = self.width[flat]
        for at in np.flatnonzero(width < 0):  # an unknown piece: only without byte fallback
            raise ValueError(f"{self.sp.id_to_piece(int(flat[at]))!r} has no width")
        total = np.cumsum(width)
        before = np.repeat((total - width)[np.cumsum(size) - size], size) if len(flat) else total
        return size, [flat, (total - before).astype(np.int32)]

    def encode(self, text: str | None, add_end: bool = True) -> tuple[list[int], np.ndarray, np.ndarray]:
        _, ids, begins, ends = self.encode_many(pa.array([text], pa.string()), add_end)
        return ids.tolist(), begins, ends

    def rows_apart(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose segments can be encoded apart: those without a literal mark, if the model allows it."""
        ok = np.full(len(offsets) - 1, self.apart)
        at = np.flatnonzero(data[:-2] == 0xE2)
        at = at[(data[at + 1] == 0x96) & (data[at + 2] == 0x81)]
        if len(at):
            ok[np.searchsorted(offsets, at, side="right") - 1] = False
        return ok

    def encode_many(self, column: pa.Array, add_end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text, and ids, begins and ends of all texts one behind the other."""
        data, offsets = string_buffer(column)
        rows = len(offsets) - 1
        length = np.diff(offsets)
        apart = self.rows_apart(data, offsets) & (length > 0)
        text = lambda lo, hi: data[lo:hi].tobytes().decode()
        st, en, first = chunk_bounds(data, offsets)
        row = np.repeat(np.arange(rows), np.diff(first))
        # A run of spaces belongs to the word behind it, and a run at the end of a text stands alone.
        final = np.zeros(len(st), bool)
        final[first[1:] - 1] = True
        whole = apart[row] & ((en > st) | final)
        lead = np.zeros(len(st), np.int64)
        begin = np.flatnonzero(whole)
        before = np.concatenate([[-1], begin[:-1]]) if len(begin) else begin
        same = (before >= 0) & (row[before] == row[begin])
        head = np.where(same, before + 1, first[row[begin]])
        lead[begin] = begin - head  # empty pieces before this one, one space each
        st, en, row = st[begin] - lead[begin], en[begin], row[begin]
        # the space before a segment is its first mark; a segment that starts a text has the dummy prefix instead
        n = np.zeros(rows, np.int64)
        ids = b = e = np.empty(0, np.int64)
        if len(st):
            lex = self.lexicon
            entry = lex.lookup(*chunk_hashes(data, st, en), lambda k: text(st[k], en[k]))
            size = lex.size[entry]
            ids, e = lex.gather(lex.flat[0], entry), lex.gather(lex.flat[1], entry).astype(np.int64)
            # piece ends count from the segment's mark, which lies at st - 1
            e += np.repeat(st - 1 - offsets[row], size)
            b = np.concatenate([[0], e[:-1]])
            opens = np.concatenate([[True], row[1:] != row[:-1]])
            b[(np.cumsum(size) - size)[opens]] = 0
            np.add.at(n, row, size)
        special = np.flatnonzero(~apart & (length > 0))
        if len(special) or add_end:
            bound = np.concatenate([[0], np.cumsum(n)])
            other = {r: self._whole(text(offsets[r], offsets[r + 1])) for r in special.tolist()}
            if add_end and not other:
                at = bound[1:]
                ids, b, e = (np.insert(x, at, y) for x, y in ((ids, self.eos), (b, length), (e, length)))
                n = n + 1
            else:
                parts: list[list[np.ndarray]] = [[], [], []]
                for r in range(rows):
                    got = other.get(r) or (ids[bound[r] : bound[r + 1]], b[bound[r] : bound[r + 1]], e[bound[r] : bound[r + 1]])
                    for k in range(3):
                        parts[k].append(got[k])
                        if add_end:
                            parts[k].append(np.full(1, (self.eos, length[r], length[r])[k]))
                    n[r] = len(got[0]) + add_end
                ids, b, e = (np.concatenate(x) for x in parts)
        return n, ids.astype(np.int32), b.astype(np.int32), e.astype(np.int32)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids for the whole text, projected through the recorded alignment."""
        norm, start = normalize(text, self.settings, self.map)
        ids = self.sp.encode(text)
        begins, ends, at, sub = [], [], 0, 0
        for i in ids:
            if i in self.byte:  # one byte of the character at ``at``
                width = len(norm[at].encode())
                begins.append(start[at] + sub)
                sub += 1
                ends.append(start[at + 1] if sub == width else start[at] + sub)
                if sub == width:
                    at, sub = at + 1, 0
            else:
                n = len(self.sp.id_to_piece(i)) if i != self.sp.unk_id() else 1
                begins.append(start[at])
                at += n
                ends.append(start[at])
        return np.array(ids, np.int32), np.array(begins, np.int64), np.array(ends, np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", add_end: bool = True, decoded: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with columns ids, span_begin, span_end (array<int>): source bytes [begin, end) of every piece.

    Columns of these names in ``docs`` are replaced; of the others all stay, or those named. ``decoded`` names a further column for
    the library's decode(ids), made in the same worker.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        enc = _encoder(path)
        n, *flat = enc.encode_many(texts, add_end)
        off = np.concatenate([[0], np.cumsum(n)])
        cols = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(f)) for f in flat]
        if decoded:
            cols.append(pa.array([enc.sp.decode(flat[0][a:b].tolist()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string()))
        return cols

    added = [(name, T.ArrayType(T.IntegerType())) for name in ("ids", "span_begin", "span_end")]
    return add_columns(docs, text_col, added + ([(decoded, T.StringType())] if decoded else []), make, columns)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library's decode(ids) gives; null ids give null. A column of that name is replaced."""
    lean(encoded.sparkSession)
    src, names = aside(encoded)
    keep = [f"f{j}" for j, c in enumerate(names) if c != out_col]
    at = keep.index(f"f{names.index(ids_col)}")
    schema = src.select(*keep).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _encoder(path).sp
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if x is None else sp.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    out = src.select(*keep).mapInArrow(run, schema)
    return out.select(*[F.col(f).alias(names[int(f[1:])]) for f in keep], F.col("decoded").alias(out_col))
