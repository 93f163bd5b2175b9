"""Byte-level BPE encoding and decoding of texts: bpe.py's backtracking encoder over every pre-token, and back.

Rows: one for each input row, in the same partition; nothing is shuffled and nothing is dropped.
A null text counts as empty: no ids, and the digests are those of empty strings. A null id stays null,
repeated rows stay repeated, other columns are not read, an empty table gives an empty result.
Long texts are encoded whole; a pre-token of any length takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.bpe import BacktrackingEncoder, Memo, read_ranks
from vigilake.llm.common import decoded, map_texts, slim, table

RANKS = "byte_bpe_50k.tiktoken"


class Codec:
    """text <-> ids, for a rank file and the pattern that splits texts before merging."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        encoder = BacktrackingEncoder(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.written = Memo(lambda piece: " ".join(map(str, encoder.encode(piece.encode()))))
        self.bytes_of = {str(token): data for token, data in encoder.bytes_of.items()}

    def encode(self, text: str) -> str:
        """Decimal ids, joined by one space."""
        return " ".join(map(self.written.__getitem__, self.pieces(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


def encode_texts(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each text as an array."""

    def make():
        codec = Codec(path)
        return lambda data: ([int(x) for x in codec.encode(decoded(data)).split()],)

    return map_texts(slim(df, id_col, text_col), "id long,ids array<int>", make).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encode_texts()'s rows; null ids give an empty text, bytes that aren't UTF-8 are replaced."""

    def make():
        codec = Codec(path)
        return lambda data: (codec.decode(data.decode()).decode("utf-8", "replace"),)

    ids = df.selectExpr(f"`{id_col}` AS id", f"array_join(`{ids_col}`, ' ') AS text")
    return map_texts(slim(ids, "id", "text"), "id long,text string", make).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what encoding gives and of what decoding those ids gives."""

    def make():
        codec, sha = Codec(path), lambda data: hashlib.sha256(data).hexdigest()

        def one(data: bytes) -> tuple:
            ids = codec.encode(decoded(data))
            return ids.count(" ") + 1 if ids else 0, sha(ids.encode()), sha(codec.decode(ids))

        return one

    out = map_texts(slim(df, id_col, text_col), "id long,n_tokens long,ids_sha256 string,decoded_sha256 string", make)
    return out.withColumnRenamed("id", id_col)


def op6_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
