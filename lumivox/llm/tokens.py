"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import regex

#: What the word tokenizer's own pattern splits within a run without white space.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Runs whose splitting and lower case need no look at the tokenizer's normaliser: printable Latin.
_PLAIN = regex.compile("[!-~¡-įĲ-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For word tokenizers (those that drop white space and mark word ends) runs between ASCII white space are
    encoded one by one and remembered, as each run's ids depend on that run alone; others encode whole texts.
    ``most`` bounds the runs and the words remembered.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.by_word = getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word.encode().decode("latin-1").translate(self.letters)
            found = self._packed([t.id for t in self.tokenizer.model.tokenize(shown)])
            if len(self.words) < self.most:
                self.words[word] = found
        return found

    def _run(self, run: bytes) -> bytes:
        text = run.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join(map(self._word, _PIECES.findall(unicodedata.normalize("NFC", text).lower())))
        else:
            found = self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.runs) < self.most:
            self.runs[run] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """The ids, in the narrowest of 16 and 32 unsigned bits that holds the vocabulary; none for null."""
        if not text:
            return np.empty(0, self.dtype)
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        runs = text.encode().split()
        get, new = self.runs.get, self._run
        return np.frombuffer(b"".join([get(r) or new(r) for r in runs]), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file; kept, as loading and warming it costs more than a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
