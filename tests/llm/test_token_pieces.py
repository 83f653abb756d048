import random

import numpy as np
import pytest

from tessera.llm.queries import tokenizer_file
from tessera.llm.tokens import Ids

ODD = [
    "a\n \nb", "a  b   c\t\td ", "  lead", " x\n", "\n", "   ", "it's we'll 'd don 't's", "é è\n ñ12ab--!!  \r\nend \x0b\x0c x", "a'\ns", " 's' 't",
    "x²5 ½,3", "tail\n\n  ", "漢字かな カナ\n ", "one\n\n\n two", "", None, "…—“q” ,x.",
]


class Counting:
    """The library with a count of the texts that it is given."""

    def __init__(self, library):
        self.library, self.n = library, 0

    def encode_batch(self, texts, **how):
        self.n += len(texts)
        return self.library.encode_batch(texts, **how)

    def encode_batch_fast(self, texts, **how):
        self.n += len(texts)
        return self.library.encode_batch_fast(texts, **how)


@pytest.mark.parametrize(("kind", "file"), [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
@pytest.mark.parametrize("most", [None, 3])
def test_ids_around_white_space_are_the_librarys(kind, file, most):
    ids = Ids(tokenizer_file(file), kind, "<u4", most)
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("ab'sé1,. \n\t ") for _ in range(60)) for _ in range(300)]
    want = [np.array(ids.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ids.encode_all(texts) == want and ids.encode_all(texts[::-1]) == want[::-1]


def test_new_pieces_reach_the_library_together():
    ids = Ids(tokenizer_file("byte_bpe_50k.json"), "byte", "<u4")
    draw = random.Random(4)
    text = "x " + " ".join("".join(draw.choice("abcdefgh") for _ in range(9)) + "," for _ in range(2000))
    want = np.array(ids.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    ids.library = Counting(ids.library)
    assert ids.encode(text) == want and ids.library.n < 100  # was one for each of 2,000 words
