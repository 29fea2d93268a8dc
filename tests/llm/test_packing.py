"""Packing against the plain tokenizer and a first-fit decreasing that looks at every bin."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import packing
from quillstone.llm.queries import TOKENIZER

from .data import corpus, frame, words

PLAIN = Tokenizer.from_file(TOKENIZER)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ab'ésß\n\t.,1 \u0085　 中😀#<|>"), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_segments_give_the_ids_of_whole_texts(texts):
    texts = texts + [" " + t for t in texts] + [t + "<|endoftext|> it's  x" for t in texts]
    got = [x.tolist() for _, rows in packing.tokenized(pa.array(texts), packing.Encoder(TOKENIZER)) for x in rows]
    assert got == [plain_ids(t) for t in texts]


def test_ids_of_longer_texts():
    rng = random.Random(2)
    texts = [words(rng, 3000), "x" * 5000, "ü" * 900 + " " + words(rng, 50), " ".join(["don't"] * 2000), None, "", "\n\n  a  b \n"]
    encoder = packing.Encoder(TOKENIZER)
    for _ in range(2):  # from new segments, and from kept ones
        assert [x.tolist() for _, rows in packing.tokenized(pa.array(texts), encoder) for x in rows] == [plain_ids(t) for t in texts]


@pytest.mark.parametrize("seed", range(8))
def test_tournament_tree_is_first_fit(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, [1023, 300, 40][seed % 3]) for _ in range(rng.randint(0, 300))], np.int64)
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b in bins:
            if sum(lengths[b]) + lengths[i] <= 1024:
                b.append(i)
                break
        else:
            bins.append([i])
    assert packing.first_fit_decreasing(lengths, 1024) == bins
    full = packing.filled(bins, lengths, 1024)
    parts = sorted(p for b in full for p in b)
    assert [sum(n for j, _, n in parts if j == i) for i in range(len(lengths))] == lengths.tolist()
    assert all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:]) if a[0] == b[0])
    sizes = [sum(n for _, _, n in b) for b in full]
    assert all(s > 1024 - packing.LEAST_CUT or s & (s - 1) == 0 for s in sizes)


def check(rows, texts, length):
    """Pieces tile their documents, and sequences have no gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    waste = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        waste += 0 if at & (at - 1) == 0 else length - at
    for i, all_ids in texts.items():
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs[i]) == sorted((r.start, r.length, zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()), len(ids)) for r in docs[i] for ids in all_ids[:1])
        spans = sorted((r.start, r.length) for r in docs[i])
        assert sum(n for _, n in spans) == sum(map(len, all_ids))
    return waste


@pytest.mark.parametrize("group_docs", [4096, 7])
def test_packed_documents(spark, group_docs):
    rows = corpus() + [(None, "no id", "en", "s", 5), (900, " ".join(["long"] * 30_000), "en", "s", 1)]
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(plain_ids(t))
    df = frame(spark, rows, extra=True)
    got = packing.digest(packing.packed(df, TOKENIZER, group_docs=group_docs, keep_ids=False)).collect()
    tokens = sum(len(x) for v in texts.values() for x in v)
    assert check(got, texts, 1024) <= tokens / 100
    # with ids, they are those of the documents
    whole = packing.packed(df, TOKENIZER, length=64, group_docs=group_docs).collect()
    for r in whole:
        assert np.frombuffer(r.ids, "<u4").tolist() == texts[r.doc_id][0][r.start : r.start + r.length]


def test_nothing_to_pack(spark):
    assert packing.digest(packing.packed(frame(spark, []), TOKENIZER, keep_ids=False)).collect() == []


def test_public_vocabulary_is_byte_level():
    assert packing._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))[1].min() >= 1
