"""Encoding, Huffman files and packing: exact round trips and limits."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import huffman_ids as h
from ledgerline.llm.common import Scratch
from ledgerline.llm.encode import Encoder
from ledgerline.llm.packing import pack_examples
from ledgerline.llm.queries import tokenizer_path

ODD = ["  a  b\t c\n\n d\x1c e f  \n x", " ", "\n", "a\n", "\na b", "it's don't <|endoftext|> x<|endoftext|>y", "Á ́e É Σας", "a \n b\r\nc", "a　b c\x85d", None, "", "\x01a \x01b", "名前 12345 ½"]


MARKED = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|><|endoftext|>\n x", " \n<|endoftext|>\t", "<|endof<|endoftext|>text|>", "<|ENDOFTEXT|> <|endoftext |>", "it'<|startoftext|>s"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limit", [700_000, 4])
def test_encoder(texts, name, limit):
    from tokenizers import Tokenizer

    e = Encoder(tokenizer_path(name), limit)
    library = Tokenizer.from_file(tokenizer_path(name))  # as it is, nothing set
    every = ODD + MARKED + [t for _, t in texts]
    for group in (every, ODD, MARKED, [t for _, t in texts], [], [None]):
        bound, ids = e.encode(pa.array(group, pa.string()))
        for k, t in enumerate(group):
            assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_as_text(name):
    """By parameter only, a spelled out added token is text."""
    e = Encoder(tokenizer_path(name), specials=False)
    bound, ids = e.encode(pa.array(MARKED))
    for k, t in enumerate(MARKED):
        assert ids[bound[k] : bound[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert not set(ids.tolist()) & set(e.tokenizer.get_added_tokens_decoder())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts_with_added_tokens(name):
    import random

    from tokenizers import Tokenizer

    r, library, e = random.Random(4), Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "word", "It's", "é", "e\u0301", "12", "!", "<|", "名"]
    made = ["".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(3000)]
    bound, ids = e.encode(pa.array(made))
    for k, t in enumerate(made):
        assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 2, 3, 300])
def test_huffman_code(n):
    rng = np.random.default_rng(n)
    count = np.zeros(n + 5, np.int64)
    count[:n] = (2.0 ** rng.uniform(0, 40, n)).astype(np.int64) + 1
    size = h.code_lengths(count)
    assert ((size > 0) == (count > 0)).all() and size.max(initial=0) <= h.LONGEST
    if n > 1:
        assert sum(2.0 ** -int(x) for x in size if x) == 1.0
    if n:
        ids = np.concatenate([rng.integers(0, n, 5000), np.arange(n)]).astype(np.uint32)
        marks, bits = h.encode_bits(ids, size, h.canonical(size))
        assert (h.decode_bits(bits, marks, len(ids), h.decode_table(size)) == ids).all()


def test_length_limit_is_optimal():
    """Without a binding limit the cost equals the greedy merge's."""
    import heapq

    count = np.random.default_rng(1).integers(1, 1000, 200)
    heap, cost = list(count), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (h.code_lengths(count) * count).sum() == cost


def test_files(spark, docs, texts, no_docs):
    path = Scratch(spark).path("t")
    name = tokenizer_path("byte_bpe_50k.json")
    h.write_ids(docs, path, name)
    e = Encoder.at(name)
    start = 0
    want = []
    for d, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in h.read_ids(spark, path).drop("ids").orderBy("start").collect()] == want
    empty = Scratch(spark).path("t")
    h.write_ids(no_docs, empty, name)
    assert h.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize(("segments", "loss", "prompt"), [(256, None, None), (3, 700, None), (8, 500, "source")])
def test_packing(docs, texts, segments, loss, prompt):
    name = tokenizer_path("word_bpe_49k.json")
    out = pack_examples(docs, name, max_segments=segments, max_loss=loss, prompt=prompt).collect()
    by_seq, total = defaultdict(list), 0
    for r in out:
        by_seq[r.sequence_id].append(r)
        total += r.length
    e = Encoder.at(name)
    lead = len(e.tokenizer.encode("s", add_special_tokens=False).ids) if prompt else 0
    assert total == sum(len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 + lead for _, t in texts)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 2048 and len(rows) <= segments and sum(r.loss_tokens for r in rows) <= (loss or 2048)
    if not prompt:
        for d in (8, 12, 17):
            ids = e.tokenizer.encode(dict(texts)[d], add_special_tokens=False).ids + [1]
            for r in (r for r in out if r.doc_id == d):
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_packing_empty(no_docs):
    assert pack_examples(no_docs, tokenizer_path("word_bpe_49k.json")).count() == 0
