"""Token ids of whole texts by the word-level BPE file, a word at a time and from a bounded cache.

The file's rules never look across white space, so a text's ids are its chunks' ids in a row. Frequent
chunks come from a dictionary of at most ``CACHE_BYTES``; others are merged by their ranks (the rank of a merge is the id it makes), and
chunks with characters beyond Latin, controls or special tokens go to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from functools import cache, cached_property

#: Bytes that the cached chunks may take, and what an entry takes besides its letters and ids.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 240
END = b"\xff"  # never part of UTF-8, so it can stand for the end of a word

# The file's own split pattern, and the characters for which both routes are tested to agree.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = frozenset(".,;:!?)")
PLAIN = re.compile("[\t-\r -~ -ɏ]*")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pack(ids: list[int]) -> bytes:
    """Little-endian 16-bit ids."""
    out = array("H", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Chunks(dict):
    """Little-endian 16-bit ids of white-space separated chunks, as bytes."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        import tiktoken

        letters, ranks = byte_letters(), {}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        for token, rank in vocabulary.items():
            if not token.startswith("<|"):
                ended = token.endswith("</w>")
                ranks[bytes(letters[c] for c in (token[:-4] if ended else token)) + END * ended] = rank
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(PIECES).findall
        self.path, self.held, self.older = path, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            small = chunk.lower()
            if not (chunk.isascii() and chunk.isalnum()) and ("<|" in chunk or not PLAIN.fullmatch(chunk)):
                out = pack(self.exact(chunk))
            elif small.isalpha():  # one piece, and NFC leaves plain characters alone
                out = pack(self.merge(small.encode() + END))
            elif small[-1:] in MARKS and small[:-1].isalpha():  # a word and a mark, each from the cache
                return self[chunk[:-1]] + self[chunk[-1]]
            else:
                out = pack(self.plain(chunk))
        cost = ENTRY_BYTES + len(chunk) + len(out)
        if cost > CACHE_BYTES // 64:  # a chunk of half a megabyte is not worth keeping
            return out
        if self.held + cost > CACHE_BYTES // 2:  # what was used since the last turn moves on, the rest goes
            self.older, self.held = dict(self), 0
            self.clear()
        self[chunk] = out
        self.held += cost
        return out

    def plain(self, chunk: str) -> list[int]:
        ids = []
        for piece in self.pieces(unicodedata.normalize("NFC", chunk).lower()):
            ids += self.merge(piece.encode() + END)
        return ids

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded by the first text that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers
        return tokenizers.Tokenizer.from_file(self.path)

    def exact(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """All ids of ``text``; null and blank texts have none."""
        if not text:
            return b""
        if not PLAIN.fullmatch(text) and re.search("[\x1c-\x1f]", text):
            return pack(self.exact(text))  # str.split would take these for blanks
        held, missed = self.get, self.__missing__
        return b"".join([held(chunk) or missed(chunk) for chunk in text.split()])


@cache
def chunks(path: str) -> Chunks:
    """One encoder per worker process."""
    return Chunks(path)
