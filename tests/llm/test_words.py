"""Words of op8: distinct ones of many texts, and their ids."""

import random

import numpy as np

from ringloom.llm import wavelet

from .helpers import corpus


def test_words_are_looked_up_once_and_marks_keep_their_letters():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, model = wavelet.WordEncoder(path, 50), Tokenizer.from_file(path)
    encoder.encode([b"The the THE", b"tHe"])
    assert len(encoder.known) == 1
    long = "Ab" * 40
    texts = ["H̱ ẖ T̈ İ İ", "ÉTÉ été a\0 a A\0", "", f"{long} {long.lower()} {long}x", "<|ENDOFTEXT|> x<|endoftext|>Y Z", " It's\x85x y ", "12,'s o'LLo 7's", "x" * 8 + " " + "x" * 9 + " " + "x" * 16 + " " + "x" * 17]
    texts += [t or "" for _, t in corpus(9)]
    random.Random(2).shuffle(texts)
    for _ in range(2):  # the second time from what is remembered
        for got, t in zip(encoder.encode([t.encode() for t in texts], b"\1\0\0\0"), texts, strict=True):
            assert np.frombuffer(got, np.uint32).tolist() == [*model.encode(t, add_special_tokens=False).ids, 1]
    assert encoder.encode([]) == [] and encoder.encode([None, b" "]) == [b"", b""]


def test_distinct_words():
    begin, stop, code, first = wavelet.distinct_words(b" ab abc ab  " + b"q" * 70 + b" " + b"q" * 70 + b"\t" + b"w" * 30 + b"x " + b"w" * 30 + b"y " + b"w" * 30 + b"x\n")
    size = (stop - begin).tolist()
    assert size == [2, 3, 2, 70, 70, 31, 31, 31]
    assert code[0] == code[2] != code[1] and code[3] != code[4] and code[5] == code[7] != code[6]
    assert sorted(code[first].tolist()) == list(range(6))
    assert [len(x) for x in wavelet.distinct_words(b"\n\n")] == [0, 0, 0, 0]
