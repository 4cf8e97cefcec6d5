"""Token ids of words by a public vocabulary, remembered by each Python worker.

The vocabulary's normaliser and splitter treat a plain word (Latin-1 letters, then marks) in a
known way: letters in lower case and marks are one piece each. Such words go straight to the
vocabulary's merge model; all others go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words and pieces that a worker remembers, together. It forgets all when full. A dictionary of 700,000 would double its table.
HELD = 690_000
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)?([!#$%&*+,./:;=?@|~-]+)?")
#: Bytes of UTF-8 as the characters by which byte-level vocabularies know them.
_BYTES = {b: 256 + 33 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 256 + 67}
_WORKERS: dict[str, WordPieces] = {}


class WordPieces:
    """Ids of white-space-free words as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> WordPieces:
        """The worker's own one, kept from task to task."""
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def _piece(self, s: str) -> bytes:
        """Ids of lower-case letters or of marks; as a word of their own they have the same, so both are remembered in one place."""
        got = self.known.get(s)
        if got is None:
            text = s if s.isascii() else s.encode("utf-8").decode("latin-1").translate(_BYTES)
            got = self.known[s] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return got

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The memory, in which all of ``words`` are."""
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > HELD:
            known.clear()
            known[""] = b""
            new = words
        odd = []
        for w in new:
            m = _PLAIN.fullmatch(w)
            if m:
                a, b = m.groups()
                low = a.lower() if a else ""
                known[w] = self._piece(w) if w == low or w == b else self._piece(low) + (self._piece(b) if b else b"")
            else:
                odd.append(w)
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return known
