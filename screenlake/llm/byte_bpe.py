"""Byte-level BPE encoding and decoding over Arrow batches with the ``tokenizers`` library.

The rank file is read once by the driver and travels with the task; each worker builds the
model once.  A text is cut into the matches of the pattern, each match is encoded on its own,
and the ids of matches seen before come from a bounded cache.  In the model every byte is one
printable character; decoding goes back through that table, so a character whose bytes lie in
several tokens is put together again, and an incomplete one becomes U+FFFD in the text form.

Defined cases: a null text counts as empty and has no ids; null ids decode to no bytes; an id
that the file does not hold raises; repeated rows are encoded alike; an empty table gives an
empty result; columns of the input are kept, the added ones replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from screenlake.llm.arrow import parts

#: Matches encoded in one go and kept in the cache at most.
PIECES_AT_ONCE, PIECES_KEPT = 200_000, 30_000


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Decoder:
    """Bytes of tokens, by way of their printable characters."""

    _made: dict[str, Decoder] = {}

    @classmethod
    def of(cls, data: bytes) -> Decoder:
        key = hashlib.sha256(data).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(data)
        return cls._made[key]

    def __init__(self, data: bytes):
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        as_text = {rank: "".join(chars[b] for b in token) for token, rank in read_ranks(data).items()}
        self.token_bytes = {rank: bytes(byte_of[c] for c in text) for rank, text in as_text.items()}

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))

    def starts(self, packed: bytes | None) -> tuple[list[int], list[int]]:
        """First byte of each token, and the character that holds this byte."""
        tokens = [self.token_bytes[i] for i in np.frombuffer(packed or b"", "<u4").tolist()]
        sizes = np.array([len(t) for t in tokens], np.int64)
        first = np.cumsum(sizes) - sizes
        character = np.cumsum((np.frombuffer(b"".join(tokens), np.uint8) & 0xC0) != 0x80) - 1
        return first.tolist(), character[first].tolist() if len(first) else []


class Codec:
    """Encodes single matches with a ``tokenizers`` model made from a rank file, and decodes."""

    _made: dict[str, Codec] = {}

    @classmethod
    def of(cls, data: bytes, pattern: str) -> Codec:
        key = hashlib.sha256(data + pattern.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(data, pattern)
        return cls._made[key]

    def __init__(self, data: bytes, pattern: str):
        import regex
        from tokenizers import models

        ranks = read_ranks(data)
        chars = byte_characters()
        as_text = {token: "".join(chars[b] for b in token) for token in ranks}
        # Any two tokens whose join is a token may merge, at the rank of the join.
        merges = [
            (as_text[token[:i]], as_text[token[i:]])
            for token, rank in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if ranks.get(token[:i], rank) < rank and ranks.get(token[i:], rank) < rank
        ]
        vocab = {as_text[t]: r for t, r in ranks.items()}
        self.model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        self.pattern = regex.compile(pattern)
        self.to_chars = dict(enumerate(chars))
        self.decoder = Decoder.of(data)
        self.decode, self.starts = self.decoder.decode, self.decoder.starts
        self.seen: dict[str, bytes] = {}

    def _packed(self, pieces: list[str]) -> bytes:
        if len(self.seen) > PIECES_KEPT:
            self.seen.clear()
        for piece in set(pieces).difference(self.seen):
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.to_chars))
            self.seen[piece] = array("I", [t.id for t in tokens]).tobytes()
        return b"".join(map(self.seen.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) <= PIECES_AT_ONCE:
            return self._packed(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: self._packed(list(itertools.islice(found, PIECES_AT_ONCE))), b""))


def _mapped(df: DataFrame, added: list[tuple[str, T.DataType, pa.DataType]], source: str, make) -> DataFrame:
    """``df`` with columns computed from the column ``source`` by ``make(values) -> columns``."""
    names = [name for name, _, _ in added]
    kept = [c for c in df.columns if c not in names]
    need = kept if source in kept else [*kept, source]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = make(batch.column(batch.schema.names.index(source)).to_pylist())
            arrays = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, added, strict=True))], names=[*kept, *names])

    return df.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``, the token ids as little-endian unsigned 32-bit
    integers; with ``offsets`` also ``byte_starts`` and ``char_starts`` of the tokens."""
    with open(path, "rb") as file:
        data = file.read()
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]
    if offsets:
        numbers = T.ArrayType(T.LongType())
        added += [("byte_starts", numbers, pa.list_(pa.int64())), ("char_starts", numbers, pa.list_(pa.int64()))]

    def make(texts: list[str | None]):
        codec = Codec.of(data, pattern)
        ids = [codec.encode(t) for t in texts]
        columns = [[len(x) // 4 for x in ids], ids]
        return columns + [list(c) for c in zip(*map(codec.starts, ids), strict=True)] if offsets and ids else columns + [[]] * (2 * offsets)

    return _mapped(docs, added, text, make)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids, and ``decoded_text``."""
    with open(path, "rb") as file:
        data = file.read()

    def make(packed: list[bytes | None]):
        decoder = Decoder.of(data)
        back = [decoder.decode(x) for x in packed]
        return back, [b.decode("utf-8", "replace") for b in back]

    return _mapped(df, [("decoded", T.BinaryType(), pa.binary()), ("decoded_text", T.StringType(), pa.string())], ids, make)
