import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import chaining, components, jaccard, suffixes

from .data import corpus, frame, words


def brute_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter()
    for _, b in texts:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        r = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], r.astype(int)))) == 1).sum())
        out.append((i, len(b), int(r.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~r].tobytes()).hexdigest(), int(r.sum()) / max(1, len(b)), bool(r.any())))
    return sorted(out)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = corpus()
    got = suffixes.digest(suffixes.repeats(frame(spark, rows, extra=True)))
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 400)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_suffix_dedup_of_rows_without_an_id(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(8)
    shared = [words(rng, 100) for _ in range(4)]
    texts = [(1, f"one {shared[0]} end"), (-9, f"two {shared[0]}"), (-9, f"{shared[1]} three"), (-9, shared[2]), (-9, shared[2]), (0, shared[3]), (-9, shared[3]), (-9, None), (-9, None), (-9, ""), (-9, "short"), (-9, words(rng, 200))]
    texts += [(-9, f"{k} {shared[1]}") for k in range(5)]
    got = suffixes.digest(suffixes.repeats(frame(spark, [(None if i == -9 else i, t, "en", "s", 1) for i, t in texts], extra=True)))
    assert sorted((-9 if i is None else i, *rest) for i, *rest in got.collect()) == brute_repeats(texts, 400)


def test_suffix_rounds_match_brute_force():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"ab"), 60)) for _ in range(12)]
    texts += [texts[0][:40] + b"zz", b"q" * 3 + texts[1]]
    left = np.array([10] * 12 + [10, 13])
    group = np.array([0] * 7 + [1] * 5 + [0, 0])
    got = suffixes.repeated(texts, left, group, 20)
    for t, text in enumerate(texts):
        want = [
            k for k in range(len(text) - 19)
            if any(o != t and group[o] == group[t] and 0 <= (j := k - left[t] + left[o]) and texts[o][j : j + 20] == text[k : k + 20] for o in range(len(texts)))
        ]
        assert got[t].tolist() == want


def test_suffix_long_text_by_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 3000)
    rows = corpus(seed=5, n=30)
    got = suffixes.digest(suffixes.repeats(frame(spark, rows)))
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 400)


def brute_classes(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i)) for i, a in sets)


def test_jaccard_is_exact(spark):
    rows = corpus(seed=2)
    assert sorted(map(tuple, jaccard.classes(frame(spark, rows, extra=True)).collect())) == brute_classes(rows)


def test_jaccard_chain_of_near_copies(spark):
    # each links with the next only: one component whatever the hub
    w = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w[5 * k : 5 * k + 60]), "en", "s", 1) for k in range(25)]
    got = sorted(map(tuple, jaccard.classes(frame(spark, rows)).collect()))
    assert got == brute_classes(rows) and {r[2] for r in got} == {0}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (7, 7), (-5, 4)], "a long, b long")
    assert {(r["node"], r["label"]) for r in components.components(e).collect()} == {(n, -5) for n in (1, 2, 3, 4, -5)} | {(9, 8), (8, 8)}


def test_passages(spark):
    rows = corpus(seed=3)
    got = chaining.passages(frame(spark, rows, extra=True)).collect()
    seen = defaultdict(set)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    want = set().union(*[s for s in seen.values() if len(s) > 1])
    assert want <= {r["doc_id"] for r in got}
    assert all(r["doc_id"] != r["other_id"] and r["similarity"] >= 0.75 and r["end"] - r["start"] >= 50 for r in got)


def found_in(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = defaultdict(set)
    for r in chaining.passages(df).collect():
        out[r["doc_id"]].add((r["start"], r["end"]))
    return out


def test_passage_that_a_hub_holds_in_part(spark):
    # every third text holds the first 40 to 49 of 60 words that the next two share
    rng = random.Random(4)
    texts = []
    for k in range(60):
        passage = words(rng, 60).split()
        texts += [" ".join([words(rng, 30), *passage[: 40 + k % 10], words(rng, 40)]), " ".join([words(rng, 20), *passage, words(rng, 25)]), " ".join([words(rng, 10), *passage, words(rng, 35)])]
    got = found_in(spark, texts)
    for d in range(len(texts)):
        at = {1: 20, 2: 10}.get(d % 3)
        assert at is None or any(s <= at and e >= at + 60 for s, e in got[d]), d


def test_passages_of_repeated_words_and_copies_in_one_text(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        passage, one = words(rng, 60), words(rng, 1)
        texts += [" ".join([words(rng, 20), passage, words(rng, 10), passage, words(rng, 5)]), " ".join([words(rng, 12), passage, words(rng, 30)])]
        texts += [" ".join([words(rng, 20), *[one] * 60, words(rng, 10), *[one] * 60]), " ".join([words(rng, 12), *[one] * 60, words(rng, 30)])]
    got = found_in(spark, texts)
    for d in range(len(texts)):
        for at in (20, 90) if d % 2 == 0 else (12,):
            assert any(s < at + 60 and e > at and e - s >= 50 for s, e in got[d]), (d, at)


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_recall_of_passages_with_words_changed(spark, share):
    # brute force knows the truth: pairs of 60 words, 78 % or more of them equal in their places
    rng = random.Random(int(100 * share))
    some = words(rng, 4000).split()
    rows, pairs = [], []
    while len(pairs) < 80:
        p = rng.choices(some, k=60)
        q = [rng.choice(some) if rng.random() < share else w for w in p]
        if sum(a == b for a, b in zip(p, q)) >= 0.78 * 60:
            pairs.append(len(rows))
            rows += [" ".join(rng.choices(some, k=30) + p + rng.choices(some, k=25)), " ".join(rng.choices(some, k=12) + q + rng.choices(some, k=44))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["other_id"]) for r in chaining.passages(df).collect()}
    assert sum((a, a + 1) in got for a in pairs) >= 0.9 * len(pairs)
    assert all(abs(a - b) == 1 and min(a, b) % 2 == 0 for a, b in got)


def test_all_pairs_of_families(spark):
    # ten texts share a passage of 60 words, each with a tenth of them changed
    rng = random.Random(8)
    some = words(rng, 4000).split()
    texts, copies = [], []
    for _ in range(12):
        p = rng.choices(some, k=60)
        for _ in range(10):
            copies.append([rng.choice(some) if rng.random() < 0.1 else w for w in p])
            texts.append(" ".join(rng.choices(some, k=rng.randint(5, 40)) + copies[-1] + rng.choices(some, k=rng.randint(5, 40))))
    want = {(a, b) for a in range(120) for b in range(a + 1, a - a % 10 + 10) if sum(x == y for x, y in zip(copies[a], copies[b])) >= 0.78 * 60}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(min(r["doc_id"], r["other_id"]), max(r["doc_id"], r["other_id"])) for r in chaining.passages(df).collect()}
    # what is missing has no sampled seed
    assert len(want) > 350 and len(want & got) >= 0.97 * len(want) and all(a // 10 == b // 10 for a, b in got)


def test_token_buckets_have_no_upper_bound():
    token = np.random.default_rng(0).integers(0, 2**63, 400_000).astype(np.uint64)
    bucket = jaccard._token_bucket(token, 200_000)
    assert bucket.min() >= 0 and bucket.max() > 190_000 and len(np.unique(bucket)) > 150_000


def test_reach_keeps_to_the_threshold():
    assert chaining.reach(np.array([True] * 40 + [False] + [True] * 4)) == 45
    assert chaining.reach(np.array([True] * 40 + [False] + [True] * 2)) == 40


def test_chain_and_alignment():
    # brute force over all chains of a few matches
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = sorted(rng.integers(0, 60, 8).tolist())
        y = rng.integers(0, 60, 8).tolist()
        best = chaining.chain(x, y)
        assert sorted(i for p in best for i in p) == list(range(8))
        assert all(x[a] < x[b] and y[a] < y[b] for p in best for a, b in zip(p, p[1:]))
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate([a[:40], np.array([999], np.uint64), a[41:70], a[72:]])
    s, e, u, v, same = chaining.align(a, b, np.array([10, 50, 80]), np.array([10, 50, 78]))
    assert (s, e, u, v) == (0, 100, 0, 98) and same == 97
    assert chaining.common_subsequence(np.array([1, 2, 3, 4]), np.array([2, 4, 9])) == 2


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for v in a:
        new = [0]
        for k, w in enumerate(b):
            new.append(max(row[k] + (v == w), row[k + 1], new[-1]))
        row = new
    return row[-1]


def plain_align(a, b, xs, ys):
    core, x, y = 0, int(xs[0]), int(ys[0])
    for u, v in zip(xs.tolist(), ys.tolist()):
        core += int((a[x:u] == b[y:v]).sum()) if u - x == v - y else plain_subsequence(a[x:u].tolist(), b[y:v].tolist())
        x, y = u, v
    end = min(chaining.K, len(a) - x, len(b) - y)
    core += int((a[x : x + end] == b[y : y + end]).sum())
    x, y = x + end, y + end
    n, m = min(len(a) - x, len(b) - y), min(int(xs[0]), int(ys[0]))
    on, back = a[x : x + n] == b[y : y + n], (a[xs[0] - m : xs[0]] == b[ys[0] - m : ys[0]])[::-1]
    for loss in chaining.LOSSES:
        more, less = chaining.reach(on, loss), chaining.reach(back, loss)
        found = int(xs[0]) - less, x + more, int(ys[0]) - less, y + more, core + int(on[:more].sum()) + int(back[:less].sum())
        if found[4] >= chaining.SIMILAR * max(found[1] - found[0], found[3] - found[2]):
            break
    return found


def some_chains(rng, n):
    """Two texts' words each, few of them different, and matches that rise in both; some at their very ends."""
    out = []
    for _ in range(n):
        a = rng.integers(0, 40, rng.integers(1, 160)).astype(np.uint32)
        b = np.where(rng.random(len(a)) < 0.3, rng.integers(0, 40, len(a)), a).astype(np.uint32)[: rng.integers(1, len(a) + 1)]
        k = rng.integers(1, 6)
        xs, ys = np.unique(rng.integers(0, len(a), k)), np.unique(rng.integers(0, len(b), k))
        k = min(len(xs), len(ys))
        xs, ys = xs[:k], np.where(rng.random() < 0.5, ys[:k], xs[:k] if xs[k - 1] < len(b) else ys[:k])
        out.append((a, b, xs.astype(np.int32), ys.astype(np.int32)))
    return out


def test_chains_are_aligned_as_one_by_one():
    made = some_chains(np.random.default_rng(2), 400)
    for a, b, xs, ys in made:
        assert chaining.align(a, b, xs, ys) == plain_align(a, b, xs, ys)
        assert chaining.common_subsequence(a, b) == plain_subsequence(a.tolist(), b.tolist())


def test_chains_of_a_batch_are_aligned_at_once():
    rng = np.random.default_rng(3)
    made = []
    for _ in range(3000):
        a = rng.integers(0, 40, 80).astype(np.uint32)
        made.append((a, np.where(rng.random(80) < 0.3, 99, a).astype(np.uint32), np.array([24, 40], np.int32), np.array([24, 40], np.int32)))
    n = len(made)
    ends = {"x0": 0, "x1": 104, "y0": 0, "y1": 104}  # past both texts' ends, as spans are
    batch = pa.RecordBatch.from_pydict(
        {"hub": list(range(n)), "key": list(range(n))} | {k: pa.array([v] * n, pa.int32()) for k, v in ends.items()}
        | {c: pa.array([m[k].tobytes() for m in made], pa.binary()) for c, k in (("xs", 2), ("ys", 3), ("words_x", 0), ("words_y", 1))}
    )
    began = time.process_time()
    want = {k: v for k, m in enumerate(made) if (v := plain_align(*m))[4] >= 0.75 * max(v[1] - v[0], v[3] - v[2]) and min(v[1] - v[0], v[3] - v[2]) >= 50}
    plain, began = time.process_time() - began, time.process_time()
    got = pa.Table.from_batches(list(chaining._aligned(iter([batch])))).to_pylist()
    # one by one takes as long as plain
    assert time.process_time() - began < plain / 3
    assert {r["hub"]: (r["other_start"], r["other_end"], r["start"], r["end"], r["matched"]) for r in got} == want and len(want) > 100


def test_repeated_rows_of_an_id_add_no_passage(spark):
    rng = random.Random(6)
    passage = words(rng, 70)
    rows = [(k, " ".join([words(rng, 10 + k), passage, words(rng, 20)])) for k in range(6)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + rows[:3] * 3 + [(4, rows[4][1].replace(" ", " . "))], "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, chaining.passages(once).collect())) == sorted(map(tuple, chaining.passages(many).collect()))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffixes.digest(suffixes.repeats(none)).count() == 0
    assert jaccard.classes(none).count() == 0
    assert chaining.passages(none).count() == 0
