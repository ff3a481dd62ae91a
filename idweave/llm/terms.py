"""Words of ASCII letters and digits and of all beyond ASCII; of letters only A-Z are lower-cased."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECE_BYTES = 1 << 20
_SHOWN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_column(text: Column) -> Column:
    """The words of a text as an array, null for null."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(PATTERN), F.lit(0))


def words(text: str | None, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The same words in UTF-8, in lists of about ``piece`` bytes, so that a very long text is never a single list."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SHOWN)
    at = 0
    while at < len(data):
        end = at + piece
        if end < len(data):
            end = data.rfind(b" ", at + 1, end)
            end = data.find(b" ", at + piece) if end < 0 else end
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
