"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map (a double-array trie over UTF-8 bytes with a pool
of replacements), noting for each normalised character how many source bytes it stands for. The library segments the normalised text
with a copy of the model whose normalisation is switched off, and every piece is projected to the source bytes that it stands for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

MARK = "▁"


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, i
        shift += 7


def proto_fields(data: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """(field number, wire type, value, raw bytes) of a protobuf message."""
    i = 0
    while i < len(data):
        start = i
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        elif kind == 0:
            value, i = _varint(data, i)
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, kind, value, data[start:i]


class CharsMap:
    """The compiled character map: a Darts double-array trie and a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that data holds at this place, and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(b"\0", best[1])]


class Normalizer:
    def __init__(self, spec: bytes):
        got = {f: v for f, _, v, _ in proto_fields(spec)}
        self.map = CharsMap(got.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))

    @property
    def identity(self) -> bool:
        return not self.map.units and self.dummy and not self.squeeze and self.escape

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters the source bytes up to its end; the whole source is covered."""
        data = text.encode("utf-8", "replace")
        out: list[str] = []
        ends: list[int] = []
        space = MARK if self.escape else " "
        i, blank = 0, True  # blank: leading or repeated spaces go if spaces are squeezed
        while i < len(data):
            if hit := self.map.longest(data, i):
                n, new = hit[0], hit[1].decode("utf-8", "replace")
            else:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = data[i : i + n].decode("utf-8", "replace")
            i += n
            for c in new:
                if c == " " and self.squeeze and blank:
                    continue
                blank = c == " "
                out.append(space if c == " " else c)
                ends.append(i)
            if ends:
                ends[-1] = i
        if self.squeeze:
            while out and out[-1] == space:
                out.pop()
                ends.pop()
            if ends:
                ends[-1] = len(data)
        if self.dummy and out:
            out.insert(0, space)
            ends.insert(0, 0)
        return "".join(out), ends


class Pieces:
    """Encodes and decodes with one model file; made once in each worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        with open(model_file, "rb") as f:
            proto = f.read()
        self.full = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = next((v for n, _, v, _ in proto_fields(proto) if n == 3), b"")
        self.normalizer = Normalizer(spec)
        # the same model with normalisation off: no map (identity), no dummy prefix, no squeezing, spaces escaped
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x01"
        kept = b"".join(raw for n, _, _, raw in proto_fields(proto) if n != 3)
        self.core = sentencepiece.SentencePieceProcessor(model_proto=kept + b"\x1a" + bytes([len(off)]) + off)
        self.names = [self.core.id_to_piece(i) for i in range(self.core.get_piece_size())]
        self.byte = [self.core.is_byte(i) for i in range(len(self.names))]
        self.bos, self.eos = self.core.bos_id(), self.core.eos_id()
        # source bytes of each piece where normalisation only adds the prefix and escapes spaces; a byte piece stands for one byte
        self.source = np.array([1 if b else len(x.encode()) - 2 * x.count(MARK) for x, b in zip(self.names, self.byte, strict=True)], np.int64)
        self.plain = self.normalizer.identity and any(self.byte)

    def _lengths(self, ids: list[int], chunk: str, widths: list[int]) -> list[int]:
        """Source bytes of each piece; byte pieces of one character share its bytes, the first takes what is left over."""
        out, k = [], 0
        pending = 0  # byte pieces still to come for the character at k
        for i in ids:
            if self.byte[i]:
                if not pending:
                    pending = len(chunk[k].encode("utf-8", "replace"))
                    w = widths[k]
                    spread = [1] * min(w, pending) + [0] * (pending - w)
                    spread[0] += max(0, w - pending)
                    k += 1
                out.append(spread[len(spread) - pending])
                pending -= 1
            else:
                n = len(self.names[i]) if i != self.core.unk_id() else None
                if n is None:  # an unknown piece without byte fallback: it runs to where the next known piece begins
                    n = 1
                out.append(sum(widths[k : k + n]))
                k += n
        if out and k < len(widths):
            out[-1] += sum(widths[k:])
        return out

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids with begin and end, and the source byte at which each piece between them ends."""
        if self.plain and MARK not in text:
            ids = self.core.encode(MARK + text.replace(" ", MARK)) if text else []
            ends = np.maximum(np.cumsum(self.source[np.array(ids, np.int64)]) - 1, 0)  # the dummy prefix stands for no source byte
        else:
            norm, at = self.normalizer(text)
            ids = self.core.encode(norm)
            ends = np.cumsum(np.array(self._lengths(ids, norm, [y - x for x, y in zip([0, *at], at, strict=False)]), np.int64))
        return [self.bos] * (self.bos >= 0) + ids + [self.eos] * (self.eos >= 0), ends

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids)


_made: dict[str, Pieces] = {}


def pieces_for(model_file: str) -> Pieces:
    """One encoder for each model file and Python worker, kept while the worker lives."""
    if model_file not in _made:
        _made[model_file] = Pieces(model_file)
    return _made[model_file]


def encode_documents(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ids (with begin and end), begin and end source byte of each piece between them, and the text decoded from the ids.

    Null texts count as empty; an empty text has the two edge ids only. Any other columns are dropped.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces_for(model_file)
        for b in batches:
            got = [sp.encode(t or "") for t in b.column(1).to_pylist()]
            columns = {
                key: b.column(0),
                "ids": pa.array([i for i, _ in got], pa.list_(pa.int32())),
                "begins": pa.array([[0, *e[:-1]] if len(e) else [] for _, e in got], pa.list_(pa.int64())),
                "ends": pa.array([e for _, e in got], pa.list_(pa.int64())),
                "decoded": pa.array([sp.decode(i) for i, _ in got], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, begins array<long>, ends array<long>, decoded string")


def encoding_digests(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of what encode_documents() gives; spans_crc32 is that of the pieces' end bytes as little-endian 64-bit integers."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces_for(model_file)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids, ends = sp.encode(t or "")
                raw, decoded = np.array(ids, "<u4").tobytes(), sp.decode(ids)
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), int(ends[-1]) if len(ends) else 0, zlib.crc32(np.ascontiguousarray(ends, "<i8"))))
            n, a, d, c, s = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_pydict({key: b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string()), "covered_bytes": pa.array(c, pa.int64()), "spans_crc32": pa.array(s, pa.int64())})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_crc32 long")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
