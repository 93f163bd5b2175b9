"""Words of letters and digits, over bytes."""

from __future__ import annotations

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: A-Z lower-cased, then every ASCII byte but 0-9 and a-z turned into a space; bytes from 0x80 on belong to words.
_TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else 0x20 if x in _SEPARATORS else x for x in range(256))


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased words: runs of code points outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F."""
    return data.translate(_TABLE).split()
