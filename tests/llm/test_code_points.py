"""Encoding and counting equal the library whatever the characters."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilscan.llm.bpe import Vocabulary
from veilscan.llm.token_count import Transducer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(texts):
    library = Tokenizer.from_file(PATH)
    vocabulary, transducer = Vocabulary.at(PATH), Transducer.at(PATH)
    wrong = []
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            if np.frombuffer(vocabulary.encode(text), dtype="<i4").tolist() != want.ids or transducer.count(text) != len(want.ids):
                wrong.append(text)
    assert not wrong, [ascii(t) for t in wrong[:10]]


def test_every_code_point():
    check([f"a{c}B {c}1 x{c} {c}'s" for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000])


def test_mixed_texts():
    rng = random.Random(4)
    points = [*range(0x250), *range(0x250), *range(0x300, 0x370), *range(0x370, 0x600), 0x130, 0x3A3, 0x1E9E, 0x2019, 0x20AC, 0xA7CB, 0x10940]
    check(["".join(chr(rng.choice(points)) for _ in range(rng.randrange(40))) for _ in range(20_000)])
