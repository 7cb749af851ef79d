"""Token ids of whole texts by a public tokenizer file, with a cache of words."""

from __future__ import annotations

import re

import numpy as np

#: Words of these characters alone: already NFC, lower-cased one to one, and cut by PIECES as the tokenizer's own pattern cuts them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_LOADED: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a tokenizer that drops white space, as ``encode(text, add_special_tokens=False)`` gives them.

    Such a tokenizer treats each blank-separated run by itself, so each different run is encoded once while it
    stays in the cache. ``most`` bounds the runs, and the pieces of runs, that are kept; a cache starts anew beyond it.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet
        names = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.alphabet = {b: names[b] for b in range(256)}
        self.runs, self.pieces = _Cache(self._run), _Cache(self._piece)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if PLAIN.fullmatch(run) and "<|" not in run:
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(run.lower())))
        return np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        for cache in (self.runs, self.pieces):
            if len(cache) > self.most:
                cache.clear()
        return np.frombuffer(b"".join(map(self.runs.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))), "<u4")


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        made = self[key] = self.make(key)
        return made


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that its cache lasts from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
