"""Byte-level BPE: encoding with character offsets, and decoding.

Texts are split by the vocabulary's pattern; the tokenizers library encodes each
distinct piece once per worker. A token covers whole bytes, but not always whole
characters: offsets are byte positions mapped to the characters they lie in, so
tokens that share a character overlap in it. Decoding looks bytes up in the
reversed byte table; a character split over tokens appears once its last byte
has come.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from lexmill.llm.rows import map_text, only
from lexmill.llm.vocabulary import byte_characters, from_ranks
from lexmill.llm.workers import Cache, held

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        tokenizer = from_ranks(path)
        # \s of this library also holds the separators U+001C to U+001F, which have no White_Space property
        spaced = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(spaced).findall
        self.pieces = Cache(lambda piece: tuple(tokenizer.encode(piece, add_special_tokens=False).ids))
        byte_of = {c: b for b, c in byte_characters().items()}
        names = tokenizer.get_vocab()
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, token in names.items():
            self.bytes[token] = bytes(byte_of[c] for c in name)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token's characters."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)
        return char[ends - self.lengths[ids]] if ids else ends, char[ends - 1] + 1 if ids else ends

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_pieces(self, ids) -> list[str]:
        """The text each token completes: empty while a character is still open, U+FFFD for bytes that are none."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.bytes[i]) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", final=True)
        return out


def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids, starts, ends: token ids and the characters [start, end) they lie in.

    A null or empty text has no tokens. Repeated rows are encoded one by one,
    null ids stay null, other columns are left out, empty tables stay empty.
    """

    def make():
        own = codec(vocabulary, pattern)

        def work(texts):
            ids = [own.encode(t or "") for t in texts]
            spans = [own.offsets(t or "", i) for t, i in zip(texts, ids)]
            return ids, [s for s, _ in spans], [e for _, e in spans]

        return work

    fields = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
    return map_text(only(docs, doc_id=id_col, text=text_col), "text", make, fields, "ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, text, pieces: the decoded text and what each token adds to it. Null ids give an empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            parts = [own.decode_pieces(ids or []) for ids in batch.column("ids").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(["".join(p) for p in parts], pa.string()), pa.array(parts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "pieces"])

    return only(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, f"doc_id {id_type}, text string, pieces array<string>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and then decoding, without shipping the ids."""

    def make():
        own = codec(vocabulary, pattern)
        digits = [str(i) for i in range(len(own.bytes))]

        def work(texts):
            counts, ids_sha, text_sha = [], [], []
            for text in texts:
                ids = own.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            return counts, ids_sha, text_sha

        return work

    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return map_text(
        only(docs, doc_id=id_col, text=text_col), "text", make, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
