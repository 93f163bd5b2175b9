"""Token counts by the whole-token shortcut.

Offline, on the driver, each string of the vocabulary is merged by itself; those that end as one token
are proven. A pre-token that is proven counts one; only the rest is merged. Strings of special tokens
inside a text count one each, as the library's default has it.

Rows: one for each input row, in place. A null text counts as empty (0 bytes, 0 tokens); a null id stays
null; repeated rows stay repeated; other columns are not read. Texts are never truncated.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.bpe import Memo
from vigilake.llm.common import decoded, map_texts, slim, table

VOCABULARY = "byte_bpe_50k.json"
#: The context length that over_limit compares with.
LIMIT = 512
#: Pieces of more symbols are merged over a heap.
HEAP_FROM = 40


def letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + k) for k, byte in enumerate(others)}


class Merges:
    """Applies a list of merges to a string of the vocabulary's letters."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {tuple(pair): k for k, pair in enumerate(merges)}

    def parts(self, word: str) -> list[str]:
        return self._short(list(word)) if len(word) < HEAP_FROM else self._long(list(word))

    def _short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank.get((parts[k], parts[k + 1]), none)
        return parts

    def _long(self, parts: list) -> list[str]:
        """The same over a heap of pairs and a linked list."""
        size, rank = len(parts), self.rank
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(size - 1) if (r := rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if parts[k] != left or j < 0 or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [x for x in parts if x is not None]


@lru_cache(maxsize=4)
def load(path: str) -> tuple[list[tuple[str, str]], frozenset[str], tuple[str, ...]]:
    """The merges, the vocabulary strings proven to encode alone as one token, and the special strings."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in told["model"]["merges"]]
    engine, special = Merges(merges), tuple(x["content"] for x in told["added_tokens"])
    proven = frozenset(x for x in told["model"]["vocab"] if x not in special and len(engine.parts(x)) == 1)
    return merges, proven, special


class Counter:
    """Counts the tokens of texts. `proven` are vocabulary strings in the vocabulary's letters."""

    def __init__(self, merges, proven: frozenset[str], special: tuple[str, ...], pattern: str):
        engine, of_byte = Merges(merges), letters()
        to_byte = {letter: byte for byte, letter in of_byte.items()}
        whole = {}
        for word in proven:
            data = bytes(to_byte[x] for x in word)
            try:
                whole[data.decode()] = 1
            except UnicodeDecodeError:  # part of a character: never a pre-token
                continue

        def merged(piece: str) -> int:
            return len(engine.parts("".join(map(of_byte.__getitem__, piece.encode()))))

        rest = Memo(merged)
        self.whole, self.rest = whole, rest
        self.findall = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str) -> int:
        if self.special is None or not (found := sum(1 for _ in self.special.finditer(text))):
            return self._ordinary(text)
        return found + sum(map(self._ordinary, self.special.split(text)))

    def _ordinary(self, text: str) -> int:
        pieces = self.findall(text)
        whole, rest = self.whole, self.rest
        return sum(1 if x in whole else rest[x] for x in pieces)


def token_counts(df: DataFrame, path: str, *, limit: int = LIMIT, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row. The vocabulary is sent to the workers once; its size is bounded by the file."""
    known = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        counter = Counter(*known.value, pattern)

        def one(data: bytes) -> tuple:
            n = counter.count(decoded(data))
            return len(data), n, n > limit

        return one

    out = map_texts(slim(df, id_col, text_col), "id long,n_bytes long,n_tokens long,over_limit boolean", make)
    return out.withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
