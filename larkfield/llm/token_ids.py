"""Texts to token ids with the ``tokenizers`` library, remembering the ids of frequent chunks."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Letters that are letters in every Unicode version, ASCII signs, and white space (\x1c-\x1f are white space to ``re`` only).
_LETTERS, _SIGNS, _BLANK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~", r"[^\S\x1c-\x1f]"
#: Cuts a text where the byte-level vocabulary's own pattern always cuts: a letter run ends before any ASCII sign, digit
#: or blank, a run of signs (not begun by an apostrophe, as contractions are) before a blank, letter or digit, other
#: visible characters before white space, and of white space only a last blank joins what follows.
_CHUNKS = re.compile(rf" ?[{_LETTERS}]++(?=[\x00-\x7f]|\Z)|(?!')[{_SIGNS}]++(?={_BLANK}|[{_LETTERS}0-9]|\Z)"
                     rf"| ?[\S\x1c-\x1f]+|{_BLANK}+(?![\S\x1c-\x1f])|{_BLANK}")
_ENCODERS: dict[str, IdEncoder] = {}


class IdEncoder(dict):
    """Text to ids as little-endian unsigned 32-bit bytes, the same as ``Tokenizer.encode`` gives for the whole text.

    A text that holds an added token (such as an end-of-text mark) is encoded whole, as such tokens are cut out
    before anything else. Unknown chunks of several texts are encoded together.
    """

    room = 500_000
    longest = 48

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one process per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that start with a blank
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks. Words after one blank are encoded as one text: only their first tokens start with a blank."""
        words = [c for c in chunks if c[0] == " " and c[1:].isalpha()]
        others = [c for c in chunks if c[0] != " " or not c[1:].isalpha()]
        out = dict(zip(others, self._encoded(others)))
        if words:
            ids = np.frombuffer(self._encoded(["".join(words)])[0], "<u4")
            ends = (4 * np.flatnonzero(self.opens[ids])).tolist() + [4 * len(ids)]
            data = ids.tobytes()
            out.update((w, data[low:high]) for w, low, high in zip(words, ends, ends[1:]))
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        chunks, ends, whole = [], [], {}
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                whole[i] = text
            else:
                chunks += _CHUNKS.findall(text)
            ends.append(len(chunks))
        parts = list(map(self.get, chunks))
        places = [i for i, ids in enumerate(parts) if ids is None]
        if places:
            fresh = self._fresh({chunks[i] for i in places})
            for i in places:
                parts[i] = fresh[chunks[i]]
            if len(self) + len(fresh) > self.room:
                self.clear()
            self.update((c, ids) for c, ids in fresh.items() if len(c) <= self.longest)
        out = [b"".join(parts[low:high]) for low, high in zip([0, *ends], ends)]
        for i, ids in zip(whole, self._encoded(list(whole.values()))):
            out[i] = ids
        return out

    def stream(self, texts: Iterable[str], most: int = 1 << 21) -> Iterator[bytes]:
        """Ids of every text, encoding groups of about ``most`` characters."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= most:
                yield from self.of(group)
                group, held = [], 0
        yield from self.of(group)


def added_tokens(path: str) -> list[str]:
    """Strings that a tokenizer file takes as one token before anything else, without loading the tokenizer."""
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file).get("added_tokens", [])]


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def id_encoder(vocabulary: str = "byte_bpe_50k") -> IdEncoder:
    """The worker's encoder of a public byte-level vocabulary, loaded once per process."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        _ENCODERS[vocabulary] = IdEncoder(public_tokenizers.path(f"{vocabulary}.json"))
    return _ENCODERS[vocabulary]
