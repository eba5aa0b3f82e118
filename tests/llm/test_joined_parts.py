"""Common pieces are cut by Arrow and their new parts read many at a time, with the ids of the library."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerline.llm.encode import Encoder
from ledgerline.llm.queries import tokenizer_path


class Counting:
    """A tokenizer that counts the calls of its model."""

    def __init__(self, of):
        self.of, self.model, self.calls = of, self, 0

    def tokenize(self, text):
        self.calls += 1
        return self.of.model.tokenize(text)

    def __getattr__(self, name):
        return getattr(self.of, name)


def test_new_parts_are_read_many_at_a_time():
    path = tokenizer_path("byte_bpe_50k.json")
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    encoder.tokenizer = told = Counting(encoder.tokenizer)
    words = [f"{a}{b}{c}é" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzABCD"]
    bound, ids = encoder.encode(pa.array([" ".join(words)]))
    assert ids.tolist() == library.encode(" ".join(words), add_special_tokens=False).ids and bound.tolist() == [0, len(ids)]
    assert told.calls <= 3 and not encoder.cache


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit", [700_000, 20])
def test_ids_of_mixed_pieces_are_those_of_the_library(name, limit):
    r = random.Random(limit)
    signs = ["a", "B", "é", "ÿ", "ß", "À", "×", "7", "42", " ", " ", "\n", ",", "'s", "-", "<|endoftext|>", "\x01", "\x00", "日本", "и", "\t", "😀", "|", "Ġ"]
    texts = ["".join(r.choices(signs, k=r.randrange(40))) for _ in range(1500)] + ["", None, " ", "\n", "a ", " a", "a\n"]
    path = tokenizer_path(name)
    encoder, library = Encoder(path, limit=limit), Tokenizer.from_file(path)
    bound, ids = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    # a part that a merge could join to its neighbour is read alone
    assert (encoder.gap is None) == (name == "word_bpe_49k.json")
