"""Phrases, their counts and scores against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import collocations
from quillstone.llm.common import chunks

from .data import corpus, frame


def plain_pieces(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", t) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, top, cover=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for w in plain_pieces(text):
            n[lang or "und"] += len(w)
            for j in range(1, 5):
                for i in range(len(w) - j + 1):
                    f[lang or "und"][tuple(w[i : i + j])] += 1
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in c.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for q, b in c.items())
            if not inside:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def talk(seed, n=40):
    """Texts over few words, so that phrases of all lengths repeat, with all separators and both blanks."""
    rng = random.Random(seed)
    vocabulary = ["of", "the", "New", "york", "é", "a-b", "über", "x" * 70, "日本", " ", "in", "spite"]
    out = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice([rng.choice(vocabulary), "in spite of", "New York", "the the the the"]) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r", "\x0b", "!"]))
        out.append((k, "".join(parts), [None, "en", "de"][k % 3], "s", 1))
    return out + [(100, "", "en", "s", 0), (101, None, "fr", "s", 0), (102, "Ends here", "en", "s", 0), (103, "of the", "en", "s", 0)] + out[:4]


def result(df, top):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, top=top, least=5).collect())


@pytest.mark.parametrize("heavy", [10**9, 40, 1])
def test_collocations_match_brute_force(spark, monkeypatch, heavy):
    # from no beginning that is dealt by more words, over some, to nearly all
    monkeypatch.setattr(collocations, "THOUSANDTH", {10**9: 1, 40: 40, 1: 10**6}[heavy])
    monkeypatch.setattr(collocations, "PART_BYTES", 2000)
    monkeypatch.setattr(collocations.survey, "__defaults__", (6 if heavy == 40 else 18,))
    rows = talk(heavy % 7)
    assert result(frame(spark, rows, extra=True), 25) == brute(rows, 5, 25)


def test_collocations_of_the_corpus(spark):
    rows = corpus() + [(i, "a\x00b \x00 c. " * 6, "en", "s", 1) for i in (800, 801)] + [(700, "word " * 20_000, "en", "s", 1)]
    assert result(frame(spark, rows), 2000) == brute(rows, 5, 2000)


def test_nothing_has_no_collocations(spark):
    assert result(frame(spark, []), 10) == []
    assert result(frame(spark, [(1, None, None, None, None), (2, " ,. ", "en", "s", 1)]), 10) == []


@pytest.mark.parametrize("seed", range(4))
def test_pieces(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aB \t.,\né日") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "x", "y"]
    for limit in (1 << 20, 16):
        got = []
        for c in chunks(pa.array(texts), limit):
            found, row = collocations.chunk_pieces(c)
            got += [(int(c.first + r), p) for p, r in zip(found.to_pylist(), row)]
        assert got == [(i, " ".join(w)) for i, t in enumerate(texts) for w in plain_pieces(t)]


def test_scores_are_exact(spark):
    big = 3 * 10**15 + 1
    rows = [("en", 2, "a b", big), ("en", 1, "a", big + 7), ("en", 1, "b", 2 * big), ("en", 0, "", 9)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big, big + 7, 2 * big, 2_000_000 * big // (3 * big + 7))]


def test_languages_hash_alike():
    assert collocations._lang_hash(["en", "de"]).tolist() == collocations._lang_hash(["en", "de"]).tolist() != np.zeros(2).tolist()
