"""Words of raw UTF-8 bytes, in blocks, so that a very long text needs little memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``, in order; blocks end at white space.

    ``bytes.split()`` splits at exactly these six bytes.
    """
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end
