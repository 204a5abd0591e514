"""Pre-tokens of many texts at once.

The splitting pattern of the public byte-level tokenizers decides every boundary within a window of
four characters (two back, two ahead), so its transducer is strictly local: one table gives each
character's class, and comparisons of neighbouring classes over a whole batch give all boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters with the property White_Space: fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: Bytes of text that are split at once, which bounds memory at about 30 times as much.
SLICE = 4 << 20


@cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                table[low + m.start() : low + m.end()] = kind
    table[[ord(c) for c in WHITE_SPACE]] = WHITE
    table[ord(" ")] = SPACE
    return table


def boundaries(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte positions in ``data`` (UTF-8) where a pre-token starts; texts begin at ``offsets[:-1]``."""
    code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(n + 3, bool)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[np.searchsorted(place, begins)] = True
    first[n:] = True
    kind = class_table()[code]
    white = kind >= SPACE
    start = first[:n].copy()
    here, before = ~white[1:], ~white[:-1]
    start[1:] |= np.where(here, np.where(before, kind[1:] != kind[:-1], kind[:-1] == WHITE), before)
    followed = ~white[2:] & ~first[2:n]  # the last white space before other characters stands apart
    start[1:-1] |= white[1:-1] & white[:-2] & followed & ~first[1 : n - 1]
    for i in np.flatnonzero((code == 39) & start):
        if first[i + 1]:
            continue
        one = chr(code[i + 1])
        size = 2 if one in "stmd" else 3 if not first[i + 2] and one + chr(code[i + 2]) in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            if i + size < n:
                start[i + size] = True
    return place[start]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first row, data, offsets) of consecutive rows of a string array, ``size`` bytes or one row each; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        part = data.slice(ends[row], ends[upto] - ends[row]).to_pybytes() if data is not None else b""
        yield row, part, ends[row : upto + 1] - ends[row]
        row = upto


def words_of(data: bytes, starts: np.ndarray) -> pa.DictionaryArray:
    """The pre-tokens that begin at ``starts`` and reach to the next, as a dictionary array."""
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
