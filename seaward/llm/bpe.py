"""Byte-level BPE: a sentencepiece model written out directly from a rank file, encoding and decoding with it.

Each rank's bytes are mapped byte by byte to printable characters and become one piece, whose score is the negative
rank; normalisation is the identity.  A text is cut by the splitting pattern, each pre-token is encoded by itself, and
ids go back to bytes by the inverse mapping.

Nulls and empty texts: no ids.  Texts of any length are encoded whole.  Rows that repeat an id or a text are encoded one by
one.  Ties between merges go to the leftmost.  Other columns are not looked at, whatever their names.  An empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import map_columns, read_table, text_or_empty

#: Chunks whose ids a worker keeps; beyond it the store starts anew (a bound on memory, not on results).
CACHE = 500_000
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No pre-token holds white space after another character, so a text falls into such chunks, each cut by itself.
_CHUNKS = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def settled_pattern(pattern: str) -> str:
    r"""``pattern`` with \\p{L} and \\p{N} without code points that Python's Unicode tables leave unassigned.

    The splitting module's tables are years newer than those of other encoders, and would join signs that these cut.
    """
    import regex

    spans: list[list[int]] = []
    for m in regex.finditer(r"[\p{L}\p{N}]+", "".join(chr(c) for c in range(0x80, 0x40000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")):
        for c in map(ord, m[0]):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    if not spans:
        return pattern
    off = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    letters, numbers = f"[\\p{{L}}--[{off}]]", f"[\\p{{N}}--[{off}]]"
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{off}])")
    return "(?V1)" + inside.replace(r"\p{L}+", letters + "+").replace(r"\p{N}+", numbers + "+")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a whole number (varint) or a float (32 bits)."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: pieces in rank order (id = rank), then one unknown piece that no text can reach."""
    chars = byte_characters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal))
        for i, t in enumerate(order)
    ]
    pieces.append(_field(1, _field(1, "⁇⁇".encode()) + _field(2, 0.0) + _field(3, unknown)))
    n = len(order)
    trainer = _field(3, bpe) + _field(4, n + 1) + _field(40, n) + b"".join(
        _varint(k << 3) + _varint((1 << 64) - 1) for k in (41, 42, 43)
    )
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder for one rank file; made once for each Python worker."""

    _made: dict = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.split = regex.compile(settled_pattern(pattern)).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(ranks))
        self.map = dict(enumerate(byte_characters()))
        self.bytes_of = sorted(ranks, key=ranks.get)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.ids: dict[str, bytes] = {}  # of pre-tokens and of chunks, as unsigned 32-bit numbers

    @classmethod
    def get(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _cut(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word and word.isascii():  # most chunks: a word, or a word and one sign
            if word.isalpha():
                return [chunk]
            if word[-1] in ".,;:" and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def encode(self, text: str) -> list[int]:
        chunks, ids = _CHUNKS.findall(text), self.ids
        if new := [c for c in set(chunks) if c not in ids]:
            if len(ids) > CACHE:
                ids.clear()
                new = list(set(chunks))
            parts = [self._cut(c) for c in new]
            tokens = list({t for p in parts for t in p if t not in ids})
            if tokens:
                mapped = [t.encode().decode("latin-1").translate(self.map) for t in tokens]
                ids.update((t, array("I", v).tobytes()) for t, v in zip(tokens, self.model.encode(mapped, num_threads=1), strict=True))
            for c, p in zip(new, parts, strict=True):
                if len(p) != 1:
                    ids[c] = b"".join(map(ids.__getitem__, p))
        out = array("I", b"".join(map(ids.__getitem__, chunks))).tolist()
        for c in new:
            if len(c) > 64:  # long chunks hardly come again
                ids.pop(c, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


def encode_texts(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """For each row: number of ids, sha256 of the ids, sha256 of the bytes they decode to; with ``keep_ids`` the ids."""

    def run(rows):
        codec = Codec.get(path, pattern)
        out = {key: rows[key], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if keep_ids else {})
        for value in rows["__text"]:
            ids = codec.encode(value)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(codec.decimal(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if keep_ids:
                out["ids"].append(ids)
        return out

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids
    return map_columns(docs.select(F.col(key), text_or_empty(text).alias("__text")), run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of each row's ids (null ids: null)."""

    def run(rows):
        codec = Codec.get(path, pattern)
        return {key: rows[key], "bytes": [None if v is None else codec.decode(v) for v in rows[ids]]}

    return map_columns(df.select(key, ids), run, f"`{key}` {dict(df.dtypes)[key]}, bytes binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_texts(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
SQL: dict[str, str] = {}
