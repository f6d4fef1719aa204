"""Token ids of texts by the tokenizers library, looked up by text chunk.

A byte-level pre-tokenizer never lets a pre-token cross a place before a space that something visible follows. So a text
may be cut there and its ids are those of the chunks, one after the other. Chunks repeat a lot: a worker asks the library
once for each and remembers the answer. Texts with a special token's string go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from rateweave.llm.bpe import compiled
from rateweave.llm.common import worker_cache

#: Remembered chunks and pre-tokens of a worker; it starts anew beyond that.
REMEMBERED = 600_000
#: Entries of one generation of a ``Remembered``.
GENERATION = 400_000
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Remembered(dict):
    """Answers of ``ask``, looked up and filled in one step.

    When a generation is full, a new one begins; what is asked again moves over from the one before, so frequent keys stay
    and the older half of the others goes.
    """

    def __init__(self, ask):
        super().__init__()
        self.ask = ask
        self.before: dict = {}

    def __missing__(self, key):
        found = self.before.get(key)
        self[key] = found = self.ask(key) if found is None else found
        return found

    def turn(self) -> None:
        if len(self) > GENERATION:
            self.before = dict(self)
            self.clear()


class LibraryIds:
    """Ids of one tokenizer file (JSON), as bytes of 32-bit integers."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        described = json.loads(data)
        pre = described["pre_tokenizer"]
        if (described["normalizer"] is not None or described["model"]["type"] != "BPE" or pre["type"] != "ByteLevel"
                or pre["add_prefix_space"] or not pre["use_regex"]):
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        self.special = [t["content"] for t in described["added_tokens"]]
        self.chunks = re.compile(r" (?=\S)").split
        self.uncut_space = re.compile(r" (?!\S)").search
        self.pieces = compiled(PATTERN).findall
        self.tokenize = self.library.model.tokenize
        # how the byte level writes bytes: visible ones as they are, others from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.written = str.maketrans({chr(b): chr(256 + n) for n, b in enumerate(hidden)})
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}
        # the same for whole texts, where a worker meets every chunk of its share
        self.heads = Remembered(self._chunk)
        self.words = Remembered(lambda c: self._ask(" " + c) if c.isalpha() else self._chunk(" " + c))

    def whole(self, text: str) -> bytes | None:
        """Ids of a text that can't be cut, None if it can."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        return None

    def learn(self, first: set[str], later: set[str]) -> None:
        """Ask the library for chunks not seen before; ``later`` ones follow a space."""
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first.clear()
            self.later.clear()
        if len(self.piece) > REMEMBERED:
            self.piece.clear()
        later_ids, ask = self.later, self._ask
        for c in later:
            if c not in later_ids:
                later_ids[c] = ask(" " + c) if c.isalpha() else self._chunk(" " + c)
        for c in first:
            if c not in self.first:
                self.first[c] = self._chunk(c)

    def _chunk(self, chunk: str) -> bytes:
        known, out = self.piece, []
        for p in self.pieces(chunk):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self._ask(p)
            out.append(ids)
        return b"".join(out)

    def _ask(self, piece: str) -> bytes:
        """The library's merges for one pre-token."""
        written = piece if piece.isascii() else piece.encode().decode("latin-1")
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(written.translate(self.written))])

    def encode(self, texts: list[str]) -> list[bytes]:
        heads, word, out = self.heads, self.words.__getitem__, []
        for text in texts:
            ids = self.whole(text)
            if ids is None:
                chunks = self.chunks(text) if self.uncut_space(text) else text.split(" ")
                ids = heads[chunks[0]] + b"".join(map(word, chunks[1:]))
            out.append(ids)
        heads.turn()
        self.words.turn()
        if len(self.piece) > REMEMBERED:
            self.piece.clear()
        return out


def library_ids(data: bytes) -> LibraryIds:
    """The worker's encoder of one file, made at its first use."""
    return worker_cache(f"library_{hashlib.md5(data).hexdigest()}", lambda: LibraryIds(data))
