"""Byte-level BPE on a sentencepiece model that is serialised from the vocabulary.

Each token's bytes are written as printable characters, its score is its
negative rank, and the normaliser is the identity.  sentencepiece then merges
the neighbours whose joint token has the lowest rank, leftmost first, which is
byte-level BPE.  Texts are cut into pre-tokens first; ids decode by the inverse
mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.scratch import small_batches

#: Distinct pre-tokens that a task remembers, and the longest that it remembers.
MEMO, MEMO_CHARS = 200_000, 48
# Code points that the regex module takes for letters or numbers
# and that were not yet assigned in Unicode 16, which the rank files' own library follows.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: An unassigned code point, neither letter nor number nor white space.
STAND_IN = 0x378


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> list[str]:
    """One printable character for each byte: its own, or one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks, which run from 0.

    The unknown piece comes last; no text reaches it, as every byte is a piece.
    """
    letter = byte_alphabet()
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every byte")
    normal, unknown = 1, 2
    pieces = [_field(1, _field(1, "".join(letter[b] for b in t).encode()) + _field(2, float(-r)) + _field(3, normal)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    bpe, none = 2, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, none) for k in (41, 42, 43))
    # identity: no dummy prefix, no removed and no escaped white space
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with one model; lives within one task."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.late = np.array(LATER, np.uint32)
        self.ranks = ranks
        self.letters = byte_alphabet()
        by_rank = sorted(ranks, key=ranks.get)
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.memo: dict[str, tuple[bytes, str]] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text; letters of later Unicode versions count as symbols."""
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            if code.max() >= self.late[0, 0]:
                at = np.searchsorted(self.late[:, 0], code, "right") - 1
                later = (at >= 0) & (code <= self.late[at, 1])
                if later.any():
                    plain = np.where(later, np.uint32(STAND_IN), code).astype("<u4").tobytes().decode("utf-32-le")
                    return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        return self.pattern.findall(text)

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token; a pre-token that is itself a token keeps its id."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return self.processor.encode("".join(map(self.letters.__getitem__, raw)), num_threads=1)

    def _look(self, piece: str) -> tuple[bytes, str]:
        found = self.memo.get(piece)
        if found is None:
            ids = self.piece_ids(piece)
            found = np.array(ids, np.int32).tobytes(), ",".join(map(str, ids))
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text, and the same in decimal joined by commas."""
        found = list(map(self._look, self.cut(text)))
        return np.frombuffer(b"".join([f[0] for f in found]), np.int32), ",".join([f[1] for f in found])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, in blocks of bounded size."""
        out = []
        for a in range(0, len(ids), 1 << 18):
            part = ids[a : a + (1 << 18)]
            size = self.lengths[part]
            at = np.repeat(self.starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


def _broadcast(docs: DataFrame, ranks: dict[bytes, int]):
    # the vocabulary file bounds the size
    return docs.sparkSession.sparkContext.broadcast((serialize_model(ranks), ranks))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids of every whole text.

    Null and empty texts give no ids; null and repeated ids and repeated rows
    pass through, an empty table gives an empty result, and other columns are
    ignored.
    """
    shared = _broadcast(docs, ranks)

    def run(batches):
        codec = Codec(*shared.value, pattern)
        for b in batches:
            for part in _slices(b):
                ids = [codec.encode(t or "")[0] for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").transform(small_batches).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and decoded bytes of ``encode``'s rows; null ids give no bytes."""
    shared = _broadcast(encoded, ranks)

    def run(batches):
        codec = Codec(*shared.value, pattern)
        for b in batches:
            raw = [codec.decode(np.asarray(i if i is not None else [], np.int32)) for i in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").transform(small_batches).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: both directions in one pass.

    Null texts count as empty, as in ``encode``.
    """
    shared = _broadcast(docs, ranks)

    def run(batches):
        codec = Codec(*shared.value, pattern)
        for b in batches:
            for part in _slices(b):
                n, a, d = [], [], []
                for text in part.column(1).to_pylist():
                    ids, decimal = codec.encode(text or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(decimal.encode()).hexdigest())
                    d.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(small_batches).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch, rows: int = 256):
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
