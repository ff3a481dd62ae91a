"""Token ids of whole texts by a word-level BPE of the ``tokenizers`` library, remembering words already encoded."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

#: Texts of these characters only, without "<|", are split at white space first; all others are encoded as they are.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\\|")
#: The tokenizer's own pattern (a fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARKS = frozenset(".,;:!?")
REMEMBERED = 1_500_000  #: words and chunks between white space that a worker holds at most


def plain(text: str) -> bool:
    """Whether white space parts the text for the tokenizer as for ``split``, and nothing joins across it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not PLAIN.search(text)
    return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already keeps every core busy
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = "<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # of words and marks, and of chunks made of them

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian integers of ``width``."""
        if not text:
            return b""
        if not plain(text):
            return self.direct(text)
        own, known = text.split(), self.known
        new = set(own).difference(known)
        if new:
            self._learn(new)
        ids = b"".join(map(known.__getitem__, own))
        if len(known) > REMEMBERED:
            known.clear()
        return ids

    def _learn(self, chunks: set[str]) -> None:
        known, parts = self.known, []
        for c in chunks:  # mostly a word, or a word and one mark
            low = c.lower()
            if low.isalpha():
                parts.append((low,))
            elif low[-1] in MARKS and low[:-1].isalpha():
                parts.append((low[:-1], low[-1]))
            else:
                parts.append(PIECE.findall(low))
        new = list(set(chain.from_iterable(parts)).difference(known))
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.width)
            at = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(at) == len(new):
                data = ids.tobytes()
                known.update(zip(new, [data[i:j] for i, j in zip([0, *at], at)]))
            else:
                known.update((p, self.direct(p)) for p in new)
        one = known.__getitem__
        known.update([(c, one(own[0]) if len(own) == 1 else b"".join(map(one, own))) for c, own in zip(chunks, parts)])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
