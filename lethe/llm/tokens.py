"""Byte-level BPE ids of whole texts inside tasks, with the ids of known words kept.

The pre-tokeniser never joins characters across a single space that stands before a visible
character: whatever follows starts a token of its own, led by that space. So a text may be
encoded piece by piece, and a piece seen before need not be encoded again. The ids are those
that the library gives for the whole text; ``tests/llm/test_tokens.py`` compares them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np

VOCABULARY = "byte_bpe_50k.json"

# A space that can only be the first character of a token.
CUT = re.compile(r" (?=\S)")
# Latin letters, then marks that are one token group whatever stands before them; the same once
# more on the next line, whose break is a token of its own.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ʯ]+", "[.,!?;:$%&*#|()]*"
WORD = re.compile(rf"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes texts with the ``tokenizers`` library.

    ``capacity`` bounds the pieces remembered per generation. When the young generation is
    full it becomes the old one, so memory holds two generations at most, and a byte each for
    some ten times as many that were seen once. The string of a special token is ordinary text,
    or with ``special_tokens`` that token, as in the library's plain call.
    """

    def __init__(self, path: str, capacity: int = 500_000, special_tokens: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.special: dict[str, bytes] = {}
        if special_tokens:
            added = self.tokenizer.get_added_tokens_decoder()
            for i, token in ((i, t) for i, t in added.items() if t.special):
                if token.lstrip or token.rstrip or token.single_word:
                    raise ValueError(f"special token {token.content!r} depends on its neighbours")
                self.special[token.content] = array("I", [i]).tobytes()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_names = re.compile(f"({'|'.join(map(re.escape, longest_first))})")
        # How the model spells each byte, taken from the library itself.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        spelt = {chr(b): self._spell(level, b) for b in range(256)}
        self.letters = str.maketrans(spelt)
        self.space = spelt[" "]
        self.capacity = capacity
        self.mask = (1 << (8 * capacity).bit_length()) - 1
        self.seen = bytearray(self.mask + 1)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    @staticmethod
    def _spell(level, byte: int) -> str:
        # A byte from 128 on stands in a two byte character, first or second.
        if byte < 128:
            return level.pre_tokenize_str(chr(byte))[0][0]
        if byte < 192:
            return level.pre_tokenize_str(bytes([0xC2, byte]).decode())[0][0][1]
        for tail in (b"\x80", b"\xa0\x80", b"\x90\x80\x80", b"\x80\x80\x80"):
            try:
                return level.pre_tokenize_str((bytes([byte]) + tail).decode())[0][0][0]
            except UnicodeDecodeError:
                continue
        return chr(byte)  # never occurs in UTF-8

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(lead + spelt)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._whole(marks)
            if len(self.tails) < self.capacity:
                self.tails[marks] = ids
        return ids

    def _after_space(self, piece: str) -> bytes:
        """Ids of a space and this piece."""
        match = WORD.fullmatch(piece)
        if match is None:
            return self._whole(" " + piece)
        word, marks, below, more = match.groups()
        if not marks and below is None:
            return self._word(word, self.space)
        head = self.young.get(word) or self.old.get(word)
        if head is None:
            head = self._word(word, self.space)
            at = hash(word) & self.mask
            if self.seen[at]:
                self._keep(word, head)
            else:
                self.seen[at] = 1
        if below is None:
            return head + self._tail(marks)
        return head + self._tail(marks + "\n") + self._word(below, "") + (self._tail(more) if more else b"")

    def _keep(self, piece: str, ids: bytes) -> None:
        """Remember a piece; when the young generation is full it becomes the old one."""
        if len(self.young) >= self.capacity:
            self.old, self.young = self.young, {}
            self.seen = bytearray(self.mask + 1)
        self.young[piece] = ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, as unsigned 32-bit integers."""
        if any(name in text for name in self.special):
            # The library parts texts at special tokens before anything else.
            parts = self.special_names.split(text)
            ids = b"".join(self.special.get(p) or self._ordinary(p) for p in parts)
        else:
            ids = self._ordinary(text)
        return np.frombuffer(ids, "<u4")

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        if "" in pieces:  # more than one space, or one at an end
            pieces = CUT.split(text)
        first = pieces[0]
        # A text that begins with a space is cut in front of its first word, leaving nothing.
        ids = list(map(self.young.get, pieces))
        ids[0] = self._whole(first) if first else b""
        old, seen, mask = self.old.get, self.seen, self.mask
        for i in [i for i, found in enumerate(ids) if found is None]:
            piece = pieces[i]
            found = old(piece)
            if found is None:
                if piece.isascii() and piece.isalpha():
                    found = self._word(piece, self.space)
                else:
                    found = self._after_space(piece)
                    old, seen = self.old.get, self.seen
            ids[i] = found
            # Most pieces never come again: nothing is kept at their first time.
            at = hash(piece) & mask
            if not seen[at]:
                seen[at] = 1
            elif len(piece) < 64:
                self._keep(piece, found)
                old, seen = self.old.get, self.seen
        return b"".join(ids)


_encoders: dict[tuple[str, int, bool], PieceEncoder] = {}


def encoder(path: str, capacity: int = 500_000, special_tokens: bool = False) -> PieceEncoder:
    """The encoder of this Python worker; what it remembers lasts from task to task."""
    key = (path, capacity, special_tokens)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def encode_all(
    texts: Iterable[str | None], path: str, special_tokens: bool = False
) -> Iterable[np.ndarray]:
    encode = encoder(path, special_tokens=special_tokens).encode
    return (encode(text or "") for text in texts)
