"""Tokens of whole texts by a tokenizers file, one white-space chunk at a time.

The vocabulary drops white space and cuts there before anything else, so a text's tokens are those of its chunks in
turn. Chunks recur; each is cut once into the vocabulary's pieces (words, digits, marks), whose tokens are remembered in
stores of bounded size. Chunks with characters beyond ASCII and the letters of Latin-1, and those that may hold an
added token, go whole through the library. Whether a file allows all this is checked when it is opened.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import islice

import numpy as np

#: Chunks, and pieces, that one Python worker remembers, and the longest of them in bytes.
REMEMBERED = 300_000
LONGEST = 48

#: Fixed values of the vocabulary file: its rule for pieces, and the same rule for lower-case text of the plain characters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def cuts_at_white_space(config: dict) -> bool:
    """True if white space is normalised to single spaces and no piece of a text holds any; added tokens keep to their own text."""
    steps = config.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    split = config.get("pre_tokenizer") or {}
    split = split.get("pretokenizers", [split])[0]
    return (
        all(s.get("type") in ("NFC", "Replace", "Lowercase") for s in steps)
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and split["pattern"].get("Regex") == PIECES
        and not any(t["single_word"] for t in config.get("added_tokens", []))
    )


def trimmed(store: dict) -> dict:
    """The half of a store that came first: what recurs often was met early."""
    return dict(islice(store.items(), len(store) // 2))


class Encoder:
    """Packed ids (little-endian, 32 bits) of whole texts."""

    @staticmethod
    @cache
    def of(path: str) -> Encoder:
        return Encoder(path)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_chunk = cuts_at_white_space(config)
        self.added = sorted({t["content"][:2] for t in config.get("added_tokens", [])})
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        suffix, words = config["model"].get("end_of_word_suffix"), self.library.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for word, i in words.items() if suffix and word.endswith(suffix)]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """All pieces go through the library at once, and are told apart by the tokens that end one."""
        ids = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(pieces):  # the vocabulary has no end for each piece
            self.pieces.update((piece, self._whole(piece)) for piece in pieces)
            return
        whole = ids.tobytes()
        self.pieces.update((piece, whole[a:b]) for piece, a, b in zip(pieces, [0, *ends], ends))

    def _encode(self, new: list[bytes]) -> list[bytes]:
        """The packed ids of chunks."""
        if len(self.pieces) > REMEMBERED:
            self.pieces = trimmed(self.pieces)
        cut, lacking, known, plain, pieces_of = [], {}, self.pieces, PLAIN.fullmatch, PLAIN_PIECES.findall
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            if len(chunk) > LONGEST or not plain(text) or [a for a in self.added if a in text]:
                cut.append(text)
                continue
            cut.append(own := pieces_of(text.lower()))
            for piece in own:
                if piece not in known:
                    lacking[piece] = None
        if lacking:
            self._learn(list(lacking))
        return [self._whole(x) if isinstance(x, str) else known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x]) for x in cut]

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """All ids of each UTF-8 text."""
        if not self.by_chunk:
            return [self._whole(t.decode("utf-8", "replace")) for t in texts]
        known = self.chunks
        cut = [t.split() for t in texts]
        if len(known) > REMEMBERED:
            self.chunks = known = trimmed(known)
        new = list(set().union(*cut).difference(known))
        known.update(zip(new, self._encode(new)))
        out = [b"".join(map(known.__getitem__, own)) for own in cut]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        return out
