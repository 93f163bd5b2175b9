"""Byte-pair encoding by backtracking over longest matches.

A sequence of tokens is the one that merging in rank order gives if each token encodes to itself and
each adjacent pair of tokens stays apart when their joined bytes are merged. So a text is encoded from
left to right by the longest match that stays compatible with its predecessor; where none does, the
position is marked dead and the predecessor is shortened. Every position dies at most once, so the
work is linear in the text, unlike rescanning for the lowest-ranked pair.
"""

from __future__ import annotations

import base64

import ahocorasick

from vigilake.llm.common import MEMO_BYTES, MEMO_ENTRIES


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank. Opened where the library is installed, on any machine."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The parts that merging the lowest-ranked adjacent pair leaves, again and again, the leftmost of equals first.

    Only merges of a rank under `below` take part. Quadratic; used for vocabulary entries and as the tests' measure.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best) and (below is None or rank < below):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BacktrackingEncoder:
    """Encodes single pre-tokens. `whole_first`: a pre-token that is in the vocabulary is that token, whatever its merges give."""

    def __init__(self, ranks: dict[bytes, int], whole_first: bool = True):
        self.ranks, self.whole_first = ranks, whole_first
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; a byte is its own halves; none if merging never makes it."""
        if token not in self._halves:
            data = self.bytes_of[token]
            if len(data) == 1:
                self._halves[token] = (token, token)
            else:
                parts = merge(data, self.ranks, token)
                self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether these tokens, each encoding to itself, stay apart when their joined bytes are merged."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > MEMO_ENTRIES:
                self._apart.clear()
            known = self._apart[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undo the merges on both sides of the border, latest first; a merge across it that comes earlier joins them."""
        limit = float("inf")
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < limit:
                return False
            # The side whose last merge is the later one is undone; of equal ranks the left one was merged first.
            if a > b:
                order = ((a, 0), (b, 1))
            else:
                order = ((b, 1), (a, 0))
            for token, side in order:
                if len(self.bytes_of[token]) > 1:
                    limit = token + side
                    halves = self.halves(token)
                    if halves is None:
                        return False
                    if side:
                        b = halves[0]
                    else:
                        a = halves[1]
                    break
            else:
                return True

    def encode(self, data: bytes) -> list[int]:
        if self.whole_first and (whole := self.ranks.get(data)) is not None:
            return [whole]
        latin = data.decode("latin-1")
        # Longest matches alone are the first branch of the search; where every pair of them is compatible, it ends there.
        made = [match[0] for _, match in self.automaton.iter_long(latin)]
        if all(map(self.compatible, made, made[1:])) and all(self.halves(token) for token in made):
            return made
        return self._backtrack(latin)

    def _backtrack(self, latin: str) -> list[int]:
        size = len(latin)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(latin):
            starts[end - match[1] + 1].append(match)
        dead = bytearray(size + 1)
        made: list[int] = []
        chosen: list[int] = []
        at, pick = 0, len(starts[0]) - 1 if size else -1
        while at < size:
            here, last = starts[at], made[-1] if made else None
            while pick >= 0:
                token, length = here[pick]
                if not dead[at + length] and self.halves(token) is not None and (last is None or self.compatible(last, token)):
                    break
                pick -= 1
            if pick >= 0:
                made.append(token)
                chosen.append(pick)
                at += length
                pick = len(starts[at]) - 1 if at < size else -1
            else:
                dead[at] = 1
                if not made:
                    raise ValueError("a byte is missing from the vocabulary")
                at -= len(self.bytes_of[made.pop()])
                pick = chosen.pop()
        return made


class Memo(dict):
    """piece -> what `make` gives for it. Long pieces are not kept; a full memo becomes the older one, from which pieces in use come back."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value
