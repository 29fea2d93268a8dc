"""Secret scans: fixed base patterns, and probabilistic automata inferred from labelled credentials.

Base kinds, leftmost non-overlapping for each: assign, access, hex (see BASE).
Further spans of kind `format` come from the automata. Prefix trees of labelled
credentials, one for each format, are folded into probabilistic automata by
merging states whose futures are statistically compatible (a Hoeffding bound on
the frequencies of ending and of each next symbol, recursively). Symbols are the
characters themselves, so a format's fixed prefix becomes states of its own. More
automata are inferred from kinds of labelled harmless tokens. Every candidate (a run
of `[A-Za-z0-9+/_=-]`, 20 characters or more) is scored: the best log-likelihood a
character under a credential format less the best under a harmless kind. Candidates
at or above the threshold that no base span overlaps are added.

The labelled tokens are made by rule from publicly documented credential formats
(a fixed seed, `labelled()`); another labelled set is a parameter. Null or empty
texts have no spans; repeated rows are answered each; no text is cut, however long; an
empty table gives no rows; a column of docs named secret_spans gives way to the result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, chunks

#: The base patterns and least lengths of the contract.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "format"]
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"api"]

LEAST_CANDIDATE = 20
ALPHA = 0.05
THRESHOLD = 0.3

HEX = np.zeros(256, bool)
HEX[48:58] = HEX[97:103] = True
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = True
TOKEN[[43, 47, 95, 61, 45]] = True

#: Symbols of the automata: each character of a token by itself, so that a format's prefix can be learned; one for all others.
CHARACTERS = string.digits + string.ascii_letters + "+/_=-"
SYMBOL = np.full(256, len(CHARACTERS), np.int64)
SYMBOL[[ord(c) for c in CHARACTERS]] = np.arange(len(CHARACTERS))
N_SYMBOLS = len(CHARACTERS) + 1


def labelled(each: int = 300, seed: int = 11) -> list[tuple[str, str]]:
    """(label, token) by rule: documented credential formats, and `harmless` tokens of ordinary text."""
    rng = random.Random(seed)
    alnum, base64, lower = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    out = []
    for _ in range(each):
        out += [
            ("access", "AKIA" + pick(string.ascii_uppercase + "234567", 16)),
            ("hex", pick("0123456789abcdef", rng.choice([32, 40, 64]))),
            ("prefixed", rng.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36)),
            ("live", rng.choice(["sk_live_", "rk_live_", "pk_live_"]) + pick(alnum, 24)),
            ("base64", pick(base64, rng.choice([40, 43, 44]))),
            ("signed", "eyJ" + pick(alnum + "_-", rng.randint(30, 60))),
            ("harmless words", "".join(pick(lower, rng.randint(2, 9)) + rng.choice(["-", "_", "/", ""]) for _ in range(rng.randint(3, 6)))),
            ("harmless words", "".join(pick(lower, rng.randint(2, 9)) + rng.choice("-_/") for _ in range(rng.randint(3, 5))) + pick(string.digits, rng.randint(1, 5))),
            ("harmless letters", pick(lower, rng.randint(20, 60))),
            ("harmless letters", pick(lower, 1).upper() + pick(lower, rng.randint(19, 40))),
            ("harmless names", "".join(pick(lower, rng.randint(3, 8)).capitalize() for _ in range(rng.randint(3, 6)))),
            ("harmless capitals", pick(string.ascii_uppercase, rng.randint(20, 40))),
            ("harmless capitals", "_".join(pick(string.ascii_uppercase, rng.randint(2, 9)) for _ in range(rng.randint(3, 6)))),
            ("harmless digits", pick(string.digits, rng.randint(20, 30))),
            ("harmless dates", f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}/" + pick(lower, rng.randint(8, 20))),
            ("harmless rules", rng.choice("-=_") * rng.randint(20, 70)),
        ]
    return out


#: Runs that are left when a step for all of them is no longer worth it.
FEW = 32


class Automaton:
    """A probabilistic automaton from a sample, by state merging."""

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.total, self.final = [0], [0]
        self.child: list[dict[int, int]] = [{}]
        self.flow: list[dict[int, int]] = [{}]  # how many tokens took each edge
        for token in sample:
            self._add(SYMBOL[np.frombuffer(token.encode(), np.uint8)].tolist())
        red = [0]
        while edge := next(((p, s) for p in red for s in sorted(self.child[p]) if self.child[p][s] not in red), None):
            q = self.child[edge[0]][edge[1]]
            for r in reversed(red):  # the newest first: a rare state goes with its neighbourhood, not with the start
                if self._compatible(r, q):
                    self.child[edge[0]][edge[1]] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
        number = {q: k for k, q in enumerate(red)}
        self.states = n = len(red)
        # a symbol that a state has never seen leads to a state where all are alike and dear
        self.next = np.full((n + 1, N_SYMBOLS), n, np.int64)
        self.cost = np.full((n + 1, N_SYMBOLS), -math.log(N_SYMBOLS) - 1.0)
        for q in red:
            whole = self.total[q] + 0.05 * N_SYMBOLS
            for s in range(N_SYMBOLS):
                self.cost[number[q], s] = math.log((self.flow[q].get(s, 0) + 0.05) / whole)
                if s in self.child[q]:
                    self.next[number[q], s] = number[self.child[q][s]]

    def _add(self, symbols: list[int]) -> None:
        at = 0
        for s in symbols:
            self.total[at] += 1
            self.flow[at][s] = self.flow[at].get(s, 0) + 1
            if s not in self.child[at]:
                self.child[at][s] = len(self.total)
                self.total.append(0)
                self.final.append(0)
                self.child.append({})
                self.flow.append({})
            at = self.child[at][s]
        self.total[at] += 1
        self.final[at] += 1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the states' futures may be one: every frequency within the Hoeffding bound, and so on below."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.total[a], self.total[b]
            most = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.final[a] / na - self.final[b] / nb) > most:
                return False
            for s in {*self.flow[a], *self.flow[b]}:
                if abs(self.flow[a].get(s, 0) / na - self.flow[b].get(s, 0) / nb) > most:
                    return False
                if s in self.child[a] and s in self.child[b]:
                    stack.append((self.child[a][s], self.child[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a: its counts, and its branches that a lacks."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            self.final[a] += self.final[b]
            for s, n in self.flow[b].items():
                self.flow[a][s] = self.flow[a].get(s, 0) + n
            for s, q in self.child[b].items():
                if s in self.child[a]:
                    stack.append((self.child[a][s], q))
                else:
                    self.child[a][s] = q

    def score(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log-likelihood a character of each run of symbols; runs step together while many are left, then long ones alone."""
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        live = np.arange(len(start))
        step = 0
        while len(live) > FEW:
            s = symbols[start[live] + step]
            total[live] += self.cost[state[live], s]
            state[live] = self.next[state[live], s]
            step += 1
            live = live[length[live] > step]
        follow, cost = self.next.tolist(), self.cost.tolist()
        for k in live.tolist():
            at, value = int(state[k]), float(total[k])
            for s in symbols[start[k] + step : start[k] + length[k]].tolist():
                value += cost[at][s]
                at = follow[at][s]
            total[k] = value
        return total / np.maximum(length, 1)


def train(tokens: list[tuple[str, str]] | None = None, alpha: float = ALPHA) -> tuple[list[Automaton], list[Automaton]]:
    """Automata of the credential formats, and those of the kinds of harmless tokens (labels that begin with `harmless`)."""
    by: dict[str, list[str]] = {}
    for label, token in tokens or labelled():
        by.setdefault(label, []).append(token)
    made = [(k.startswith("harmless"), Automaton(v, alpha)) for k, v in sorted(by.items())]
    return [a for harmless, a in made if not harmless], [a for harmless, a in made if harmless]


def likelihood(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, model) -> np.ndarray:
    """Best format less harmless, a character."""
    best = lambda automata: np.max([a.score(symbols, start, length) for a in automata], axis=0)
    return best(model[0]) - best(model[1])


def runs(inside: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs of True, cut at the rows' borders, of `least` or more."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    b = off[:-1][off[:-1] < len(inside)]
    begin[b] = inside[b]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    e = off[1:] - 1
    e = e[e >= 0]
    end[e] = inside[e]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = stop - start >= least
    return start[long], (stop - start)[long]


def rows_with(raw: bytes, off: np.ndarray, words: list[bytes]) -> list[int]:
    """Rows whose bytes hold one of the words."""
    found = set()
    for w in words:
        at = raw.find(w)
        while at >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            if at + len(w) <= off[row + 1]:
                found.add(row)
                at = raw.find(w, int(off[row + 1]))
            else:
                at = raw.find(w, at + 1)
    return sorted(found)


def scan(data: np.ndarray, off: np.ndarray, model, threshold: float = THRESHOLD) -> list[list[tuple[int, int, int]]]:
    """For each row its spans (start byte, kind's index, end byte), in order."""
    raw = data.tobytes()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    for r in rows_with(raw.lower(), off, KEYWORDS):
        for m in ASSIGN.finditer(raw[off[r] : off[r + 1]]):
            if len(m[2]) >= LEAST_ASSIGN:
                out[r].append((m.start(), 0, m.end()))
    for r in rows_with(raw, off, [b"AKIA"]):
        for m in ACCESS.finditer(raw[off[r] : off[r + 1]]):
            if m.end() - m.start() >= LEAST_ACCESS:
                out[r].append((m.start(), 1, m.end()))
    start, length = runs(HEX[data], off, LEAST_HEX)
    for s, n in zip(start.tolist(), length.tolist()):
        r = int(np.searchsorted(off, s, "right")) - 1
        out[r].append((s - int(off[r]), 2, s + n - int(off[r])))
    start, length = runs(TOKEN[data], off, LEAST_CANDIDATE)
    if len(start):
        good = likelihood(SYMBOL[data], start, length, model) >= threshold
        for s, n in zip(start[good].tolist(), length[good].tolist()):
            r = int(np.searchsorted(off, s, "right")) - 1
            a, b = s - int(off[r]), s + n - int(off[r])
            if not any(x < b and a < y for x, _, y in out[r]):
                out[r].append((a, 3, b))
    return [sorted(x) for x in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scanned(docs: DataFrame, text: str = "text", tokens: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs and secret_spans: start, end (code points, end exclusive) and kind, by start, then kind as listed."""
    model = train(tokens)

    def make():
        def work(batch):
            spans = []
            for chunk in chunks(batch.column(batch.schema.get_field_index(text))):
                data, off = chunk.data, chunk.off
                found = scan(data, off, model, threshold)
                for r, row in enumerate(found):
                    if not row:
                        spans.append([])
                        continue
                    points = np.cumsum((data[off[r] : off[r + 1]] & 0xC0) != 0x80)
                    at = lambda b, p=points: int(p[b - 1]) if b else 0
                    spans.append([{"start": at(a), "end": at(b), "kind": KINDS[k]} for a, k, b in row])
            return [spans]

        return work

    return annotated(docs, make, [("secret_spans", SPANS, "array<struct<start:long,end:long,kind:string>>")])


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of scanned() for each document."""
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] != "format")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("secret_spans")).alias("spans"),
    )


def redacted(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of scanned() with each run of overlapping spans replaced by the mark."""

    def make():
        def work(batch):
            out = []
            for value, row in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("secret_spans")).to_pylist()):
                if value is None or not row:
                    out.append(value)
                    continue
                parts, at, end = [], 0, -1
                for s in row:
                    if s["start"] >= end:
                        parts += [value[at : s["start"]], mark]
                    end = max(end, s["end"])
                    at = end
                out.append("".join([*parts, value[at:]]))
            return [pa.array(out, pa.string())]

        return work

    return annotated(found, make, [(text, pa.string(), "string")]).select(*found.columns)


def sha256_of(spans: list[str]) -> str:
    """base_sha256 of spans as text."""
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
