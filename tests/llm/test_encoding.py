"""Ids put together from words against ids of the whole text."""

import numpy as np
import pytest

from outletry.llm import encoding
from outletry.llm.queries import tokenizer_path

TEXTS = [
    "<|endoftext|>. a<|startoftext|>b, It's it's, DON'T. x'S! <|endoftext|>x,",
    "Eİ. İstanbul, ΣΑΣ. é, é̂. a,́ b.̸ c)̈ ß. ẞ, ǅ, ª. º, ʰ, ſ. K. ŉ, ﬁ",
    "a​b. naïve... (foo) foo). a1, 1.2,3. \t\r\x0b x\x0cy, a*b*c** ''s, 's.",
    "", "\n \n", "ñandú" * 30 + ".",
]


@pytest.mark.parametrize("remembered", [1, 300_000])
def test_words_give_the_ids_of_the_whole_text(monkeypatch, remembered):
    monkeypatch.setattr(encoding, "REMEMBERED_WORDS", remembered)
    whole, words = encoding.Encoder(tokenizer_path(), False), encoding.Encoder(tokenizer_path(), True)
    latin = " ".join(f"{chr(c)} a{chr(c)}b E{chr(c)}." for c in range(33, 0x260))
    for text in [*TEXTS, latin, *TEXTS]:
        assert words(text) == whole(text)
    assert words(None) == b""
    assert np.frombuffer(words("the cat"), dtype=words.kind).size == 2
