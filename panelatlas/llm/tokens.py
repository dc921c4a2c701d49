"""Token ids of whole texts from a ``tokenizers`` file, with a memory of pieces already encoded.

The vocabulary splits at white space before anything else, so the ids of a text are the ids of its space-separated
pieces one after the other. A piece is given to the library when it is new; pieces met again are remembered, those met
once only for a while. Both memories are bounded in pieces, and pieces of over 64 characters are never remembered, so a
worker holds some 80 MB of them, however many tasks it runs.
Two cheap rewrites let more pieces meet, both only where they leave the ids as they are:

* a Latin-1 text is lower-cased first (the library's own normaliser does the same to it);
* a comma or full stop between a letter or digit and a space becomes a piece of its own (the library always splits there).

A text that holds ``<|`` could hold a special token's string, and goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_DOUBT = re.compile(r"[^a-zß-öø-ÿ0-9][.,](?:[ \n]|$)")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_LONGEST = 64
_KEPT: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """``limit`` bounds the pieces that were met again, ``young`` those met once; when one is reached, they are forgotten and
    encoded again as they come."""

    def __init__(self, path: str, limit: int = 250_000, young: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.most_young = Tokenizer.from_file(path), limit, young
        self.pieces: dict[str, bytes] = {"": b""}
        self.young: dict[str, bytes] = {}
        said = json.loads(self.tokenizer.to_str())
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        self.by_space = any(x.get("pattern") == {"Regex": "\\s+"} for x in steps) and said["model"].get("end_of_word_suffix") == "</w>"
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Encode pieces that aren't known; those of Latin letters alone share one call, cut at the ids that end a word."""
        out: dict[str, bytes] = {}
        plain = [x for x in new if _LETTERS.fullmatch(x)]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain):
                raw, at = ids.tobytes(), 0
                for piece, end in zip(plain, (4 * ends).tolist()):
                    out[piece] = raw[at:end]
                    at = end
        for piece in new:
            if piece not in out:
                out[piece] = self.whole(piece)
        if len(self.young) + len(out) > self.most_young:
            self.young = {}
        if len(out) <= self.most_young:
            self.young.update((k, v) for k, v in out.items() if len(k) <= _LONGEST)
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text, without special tokens."""
        if not text:
            return b""
        if "<|" in text or not self.by_space:
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pieces = text.replace("\n", " ").split(" ")
        else:
            text = text.lower().replace("\n", " ")
            if not _DOUBT.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
            pieces = text.split(" ")
        found = list(map(self.pieces.get, pieces))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            young = self.young
            again = {x: ids for i in gaps if (ids := young.get(x := pieces[i])) is not None}
            new = self.learn({x for i in gaps if (x := pieces[i]) not in again})
            for i in gaps:
                found[i] = new[x] if (x := pieces[i]) in new else again[x]
            if again:
                if len(self.pieces) + len(again) > self.limit:
                    self.pieces = {"": b""}
                self.pieces.update(again)
        return b"".join(found)


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for one vocabulary file."""
    if path not in _KEPT:
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
