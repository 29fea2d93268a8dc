"""Words, near words and roots against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import spelling

from .data import corpus, frame


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for i, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def texts(seed, words=40):
    """Words with misspellings of misspellings, so chains have several steps; equal letters in a row; accents."""
    rng = random.Random(seed)
    letters = "abnéÀß"
    out, base = [], ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(words)] + ["aaaaaa", "aaaaaaa", "aaabbb", "ÀÉaaaaÿ"]
    for w in base:
        n = rng.choice([5, 30, 150, 800])
        out += [w] * n
        while n >= 10:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            n //= 5
            out += [w] * n
    rng.shuffle(out)
    return [(k, " ".join(out[k : k + 40]).replace("b ", "B "), "en", "s", 1) for k in range(0, len(out), 40)]


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(spelling, "BUCKET_ROWS", 64)
    rows = texts(seed) + [(None, "walkin walkin walking", "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0)]
    rows += rows[:1]
    want = brute(rows)
    assert len({r[2] for r in want}) < len(want) and any(r[1] and r[2] != r[1] for r in want)
    assert result(frame(spark, rows, extra=True)) == want


def test_variants_of_the_corpus(spark):
    rows = corpus() + [(500 + k, "y" * 3000 + " " + "y" * 2999 + " " + "É" * 70, "en", "s", 1) for k in range(6)]
    assert result(frame(spark, rows)) == brute(rows)


def test_nothing_has_no_variants(spark):
    assert result(frame(spark, [])) == []


@pytest.mark.parametrize("seed", range(6))
def test_near_pairs(seed):
    rng = random.Random(seed)
    c, letters = rng.randint(1, 9), "ab" if seed % 2 else "abcdefgh"
    draw = lambda m, n: sorted({"".join(rng.choice(letters) for _ in range(m)) for _ in range(n)})
    short, long = draw(c, 60), draw(c + 1, 60 if seed else 0)
    to = lambda ws, m: np.frombuffer("".join(ws).encode(), np.uint8).reshape(-1, m)
    got, more = [], []
    for positions in (range(c // 2), range(c // 2, c + 1)):
        a, b, u, v = spelling.near_pairs(to(short, c), to(long, c + 1), positions)
        got += [(short[x], short[y]) for x, y in zip(a, b)]
        more += [(short[x], long[y]) for x, y in zip(u, v)]
    assert sorted(got) == sorted((x, y) for x in short for y in short if one_edit(x, y))
    assert sorted(more) == sorted((x, y) for x in short for y in long if one_edit(x, y))


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    values = rng.permutation(200)
    tree = spelling.WaveletTree(values)
    a = rng.integers(0, 201, (50, 4))
    left, right, low, high = a[:, 0], a[:, 1], a[:, 2], a[:, 3]
    q, v = tree.report(left, right, low, high)
    assert sorted(zip(q.tolist(), v.tolist())) == sorted((k, int(x)) for k in range(50) for x in values[left[k] : right[k]] if low[k] <= x < high[k])


def test_crc_of_runs():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = np.array([0, 10, 100, 300, 2000])
    end = np.array([1, 17, 164, 365, 2999])
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(5)], np.uint32)
    assert spelling.crc32_of(data, start, end, before).tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(start, end, before)]
