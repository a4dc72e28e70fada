"""New pre-tokens go to the library as one text; their ids are those of each alone."""

import numpy as np
import public_tokenizers

from tallyloom.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_of_joined_words_are_those_of_each_alone(monkeypatch):
    ids, library = word_bpe.Ids(word_bpe.load(PATH)), word_bpe.load(PATH).library
    texts = ["it's </w> a</w>b Straße İstanbul ĸŉ x\x1cy \x85", "<|endoftext|> naïve <|endof 12.5% ΣΑΣ 日本", "", *(chr(c) + "a " + "b" + chr(c) for c in range(0x250))]
    monkeypatch.setattr(word_bpe, "JOIN", 7)
    assert ids.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    # a word that is no single pre-token makes the counts differ: each of its batch is encoded alone
    odd = ["ab", "a b", "cd"]
    monkeypatch.setattr(ids, "alone", lambda w: True)
    assert ids.by_library(odd) == {w: np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in odd}
