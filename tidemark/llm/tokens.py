"""Token ids of texts by the tokenizers library, one document after the other, with an end id."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Fixed value: how the byte-level vocabularies split a text into pieces before merging, as it reads for Latin letters,
#: their digits and common punctuation. Texts with any other character or an added token go to the library as they are.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PIECES = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
PLAIN = r"[\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧]*"


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    Merges never cross pieces, so each distinct piece is encoded once by the library and kept, up to `most` pieces.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # added tokens (end of text and the like) are no pieces: texts that hold one go to the library whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.plain = re.compile(PIECES).findall, re.compile(PLAIN).fullmatch
        self.most, self.known = most, {}
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Words with a space before them go to the library many in one text: where a token opens with a space, a word does."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        rest = list(set(pieces).difference(words)) if len(words) < len(pieces) else []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(list(chain.from_iterable(self._library(["".join(part[k : k + 64]) for k in range(0, len(part), 64)]))), np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                rest += part
                continue
            raw, cuts = ids.astype("<u4").tobytes(), (starts * 4).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for p, ids in zip(part, self._library(part)):
                self.known[p] = b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """ids of each text and the end id; a null counts as empty."""
        tail = end.to_bytes(4, "little")
        whole = lambda t: any(a in t for a in self.added) or not self.plain(t)
        pieces = [None if not t or whole(t) else self.split(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        self._learn(list(set(chain.from_iterable(filter(None, pieces))).difference(self.known)))
        get = self.known.__getitem__
        out = []
        for t, p in zip(texts, pieces):
            if p is None:
                p = np.array(self._library([t])[0], "<u4").tobytes() if t else b""
                out.append(p + tail)
            else:
                out.append(b"".join(map(get, p)) + tail)
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 600_000) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]
