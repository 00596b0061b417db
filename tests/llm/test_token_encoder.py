import random
import sys
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from veilscan.llm.token_files import _SPACES, Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_all_white_space_is_looked_for():
    assert set(_SPACES) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_pieces_begin_at_single_spaces_only():
    for c in _SPACES.strip(" "):
        assert Encoder.pieces(f"a{c} b c") == [f"a{c} b", "c"]
    assert Encoder.pieces("a  b c") == ["a", " b", "c"]
    assert Encoder.pieces(" a b") == [" a", "b"] and Encoder.pieces("") == [""]


def test_encoder_equals_the_library():
    encoder, library, rng = Encoder(PATH, "<u2"), Tokenizer.from_file(PATH), random.Random(3)
    parts = ["a", "é", "ß", "ǅ", "ª", "İ", "中", "'s", "1", ".", "?", "<|endoftext|>", " ", "  ", *_SPACES]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == array("H", ids).tobytes(), text
