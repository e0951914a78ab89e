"""Token ids of texts through a saved tokenizer, inside tasks."""

from __future__ import annotations

import os

import numpy as np

#: Words a worker remembers before it starts a new set; the set before is kept and asked first.
REMEMBERED_WORDS = 300_000
LONGEST_REMEMBERED = 64
#: Marks that end many words. Those of added tokens such as ``<|endoftext|>`` are not among them.
ENDING_MARKS = ".,;:!?*&#%$\"()[]"
#: Letters below this are the same in every Unicode version.
LATIN_END = "\u0250"


class _Letters(dict):
    """What the tokenizer's model sees of a lower-case letter, by code point."""

    def __init__(self, tokenizer):
        super().__init__()
        self.parts = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda c: [(c, None)]

    def __missing__(self, code: int) -> str:
        self[code] = "".join(part for part, _ in self.parts(chr(code)))
        return self[code]


class _Remembered(dict):
    """Little-endian ids of words as bytes, encoded on first use.

    A word is put together from its letters and the marks behind them, and Latin letters go in lower case
    to the model alone, so that most new words need no run of the whole tokenizer.
    """

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.encode, self.tokenize, self.kind = tokenizer.encode, tokenizer.model.tokenize, kind
        self.letters = _Letters(tokenizer)
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self._parts(word)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = out
        return out

    def _parts(self, word: str) -> bytes:
        stem = word.rstrip(ENDING_MARKS)
        if stem and len(stem) < len(word) and stem[-1].lower().isalpha() and stem[-1] < LATIN_END:
            return self[stem] + self[word[len(stem) :]]
        lower = word.lower()
        if not (lower.isalpha() and max(lower) < LATIN_END and max(word) < LATIN_END):
            return self.whole(word)
        if lower != word:
            return self[lower]
        return np.array([t.id for t in self.tokenize(word.translate(self.letters))], dtype=self.kind).tobytes()

    def renew(self) -> None:
        """Start a new set and keep the full one behind it."""
        self.older = dict(self)
        self.clear()


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes of the smallest unsigned type.

    ``per_word`` is for tokenizers that drop white space and never look across it, lower-case letters and cut
    runs of them from marks: words between blanks and line ends are then encoded once and remembered, which
    gives the ids of the whole text.
    """

    def __init__(self, path: str, per_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words = _Remembered(self.tokenizer, self.kind)
        self.per_word = per_word

    def __call__(self, text: str | None) -> bytes:
        """A null text is empty."""
        if not self.per_word:
            return self.words.whole(text or "")
        if len(self.words) > REMEMBERED_WORDS:
            self.words.renew()
        return b"".join(map(self.words.__getitem__, (text or "").replace("\n", " ").split(" ")))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, per_word: bool) -> Encoder:
    """The encoder of this worker."""
    key = (path, per_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, per_word)
    return _ENCODERS[key]
