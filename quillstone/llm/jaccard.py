"""Near-duplicate join on word shingles: exact links, found by prefix filters under several token orders.

A document's set is its distinct shingles of k words. Two sets link when
100 * intersection >= 75 * union. A set of n shares ceil(3n/4) or more tokens with
any set that it links with, all of them tokens that at least two sets have. So of
its c such tokens, any c - ceil(3n/4) + 1 hold a shared one, under every order of
tokens. Candidates must pass three orders:

R  rarest first: the posting lists of these prefixes make the candidate pairs. A
   set with c below ceil(3n/4) drops out, and words that most documents use come
   last in this order, so they are hardly ever candidates' only tie. A token's
   place in a set's order bounds what a pair that meets there can share, and so
   the other set's size; both sets must be within the other's bound.
A  by hash, and
B  by hash from the other end: both on the two sets, before they are compared.

Equal sets are one from the start (a 64-bit sum of hashes names them), so copies
cost nothing and aren't expanded. In each posting list every set is compared with the
one that has fewest tokens of its own (a text that others were made from has none);
sets so linked share a label. In lists that then hold several
labels, all sets but those of the commonest label are compared with the rest. After
that no pair that shares a list, differs in label and could link is uncompared, so
components are exact.

Tokens travel in blobs, a row for each chunk of documents and bucket of hashes; the
number of buckets grows with the bytes of text, without an upper bound. Tokens are
64-bit hashes: their bucket, taken from all 64 bits, and 48 of the bits, so two of a
corpus of n different shingles are taken for one with a chance of about n * n / 2**65
or, below 65,536 buckets, n * n / (2**49 * buckets); sets are named by 64-bit sums. A bucket's frequencies go to the
sets' buckets for common tokens only. Null and empty texts have no shingles and
link with nothing; a very long text is a chunk of its own; repeated rows are answered
each; rows without an id take no part; other columns, whatever their names, are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, U64, Powers, Words, by_bucket, byte_table, chunks, discard, groups, joined, mix, shingles, written
from .components import components

K = 5
LEAST_OF, OUT_OF = 75, 100
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
CHUNK = 1 << 20
POSTINGS = np.dtype([("token", "<u8"), ("key", "<i8"), ("df", "<u4")])
META = np.dtype([("key", "<i8"), ("n", "<i8")])
DOCS = np.dtype([("doc", "<i8"), ("key", "<i8"), ("n", "<i8")])


def needed(n):
    """The least intersection of a set of n with any that links: ceil(3n/4)."""
    return -(-n * LEAST_OF // OUT_OF)


def token_sets(chunk, power, table, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, one after the other, and the rows' borders."""
    h, row, _ = shingles(Words(chunk, SPACE, table, power(len(chunk.data) + 1)), k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(chunk) + 1))


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name for each set, the same for equal sets."""
    sums = np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))))
    return mix((sums[at[1:]] - sums[at[:-1]]) + (at[1:] - at[:-1]).astype(np.uint64)).view(np.int64)


def _emit(batches, doc_id: str, text: str, k: int, buckets: int):
    """Blobs: kind 0 postings by hash bucket; 1 (key, n) by key bucket; 2 (doc, key, n) as they come."""
    power, table = Powers(), byte_table()
    turn = 0
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(doc_id)).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(batch.schema.get_field_index(text)), CHUNK):
            h, at = token_sets(chunk, power, table, k)
            n = np.diff(at)
            key = set_keys(h, at)
            docs = np.zeros(len(chunk), DOCS)
            docs["doc"], docs["key"], docs["n"] = ids[chunk.first : chunk.first + len(chunk)], np.where(n > 0, key, 0), n
            out = [(2, (int(docs["doc"][0]) + turn) % buckets, docs.tobytes(), None)]
            turn += 1
            _, one = np.unique(key, return_index=True)
            one = np.sort(one[n[one] > 0])
            meta = np.zeros(len(one), META)
            meta["key"], meta["n"] = key[one], n[one]
            for b, m in by_bucket(_bucket_of(meta["key"], buckets), meta):
                out.append((1, b, m.tobytes(), None))
            size = n[one]
            which = np.repeat(np.arange(len(one)), size)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            token = h[at[:-1][one][which] + inner]
            for bucket, t, w in by_bucket(_token_bucket(token, buckets), token, which):
                s, c = groups(w)
                for x in range(0, len(s), 4096):
                    part = slice(s[x], s[x + 4096] if x + 4096 < len(s) else len(t))
                    six = np.ascontiguousarray(t[part].view(np.uint8).reshape(-1, 8)[:, :6])
                    out.append((0, bucket, six.tobytes(), key[one][w[s[x : x + 4096]]].tobytes() + c[x : x + 4096].astype(np.uint32).tobytes()))
            kinds, places, blobs, more = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], names=["kind", "bucket", "blob", "runs"])


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % U64(buckets)).astype(np.int64)


def _token_bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(token ^ U64(0x7F4A7C159E3779B9)) % U64(buckets)).astype(np.int64)


def _frequencies(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket of hashes: postings of tokens that two sets or more have, by key bucket. Other kinds pass."""
    kind = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kind != 0)).select(["kind", "bucket", "blob"])
    mine = table.filter(pa.array(kind == 0))
    out = [passed]
    if len(mine):
        tokens, keys = [], []
        for blob, runs in zip(mine.column("blob").to_pylist(), mine.column("runs").to_pylist()):
            six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
            eight = np.zeros((len(six), 8), np.uint8)
            eight[:, :6] = six
            tokens.append(eight.view("<u8").ravel())
            m = len(runs) // 12
            keys.append(np.repeat(np.frombuffer(runs[: 8 * m], np.int64), np.frombuffer(runs[8 * m :], np.uint32)))
        token, key = np.concatenate(tokens), np.concatenate(keys)
        order = np.argsort(token)
        token, key = token[order], key[order]
        start, size = groups(token)
        many = np.repeat(size > 1, size)
        token, key = token[many], key[many]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[new], key[new]
        start, size = groups(token)
        df = np.repeat(size, size)
        post = np.zeros(int((df > 1).sum()), POSTINGS)
        good = df > 1
        # the bucket keeps tokens of different buckets apart
        post["token"], post["key"], post["df"] = token[good] | (U64(int(mine.column("bucket")[0].as_py()) & 0xFFFF) << U64(48)), key[good], df[good]
        post = post[np.argsort(post["key"], kind="stable")]
        made = list(by_bucket(_bucket_of(np.ascontiguousarray(post["key"]), buckets), post))
        out.append(pa.table({"kind": pa.array([0] * len(made), pa.int32()), "bucket": pa.array([b for b, _ in made], pa.int32()), "blob": pa.array([p.tobytes() for _, p in made], pa.binary())}))
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _prefixes(table: pa.Table) -> pa.Table:
    """A bucket of keys: the rarest common tokens of each set that may link (kind 0), its common tokens (kind 1), and the rows of documents (kind 2)."""
    kind = table.column("kind").to_numpy()
    blobs = table.column("blob")
    part = lambda k, d: joined(blobs.filter(pa.array(kind == k)), d)
    post, meta, docs = part(0, POSTINGS), np.unique(part(1, META)), part(2, DOCS)
    post = post[np.lexsort((post["token"], post["df"], post["key"]))]
    start, size = groups(post["key"])
    n = meta["n"][np.searchsorted(meta["key"], post["key"][start])] if len(start) else np.zeros(0, np.int64)
    live = size >= needed(n)
    post, start, size, n = post[np.repeat(live, size)], start[live], size[live], n[live]
    start = np.cumsum(size) - size
    nth = np.arange(len(post)) - np.repeat(start, size)
    rare = nth < np.repeat(size - needed(n) + 1, size)
    first, wide, own = post[rare], np.repeat(n, size)[rare], np.repeat(n - size, size)[rare]
    # a pair whose first shared token is this one shares no more than the tokens from it on, so the other set's size has a bound
    cap = ((LEAST_OF + OUT_OF) * (np.repeat(size, size) - nth)[rare] - LEAST_OF * wide) // LEAST_OF
    sets = [np.sort(post["token"][s : s + c]).tobytes() for s, c in zip(start, size)]
    a, b, c = len(first), len(sets), len(docs)
    col = lambda *x: pa.array(np.concatenate(x), pa.int64())
    zero = lambda k: np.zeros(k, np.int64)
    return pa.table(
        {
            "kind": pa.array(np.repeat([0, 1, 2], [a, b, c]).astype(np.int32)),
            "token": col(first["token"].astype(np.int64), zero(b), zero(c)),
            "key": col(first["key"], post["key"][start], docs["key"]),
            "n": col(wide, n, docs["n"]),
            "own": col(own, zero(b), zero(c)),
            "cap": col(cap, zero(b), zero(c)),
            "doc_id": col(zero(a), zero(b), docs["doc"]),
            "tokens": pa.array([None] * a + sets + [None] * c, pa.binary()),
        }
    )


def _linked(batches):
    """Pairs with both sets' common tokens: those that link, after orders A and B."""
    for batch in batches:
        x, y, nx, ny = (batch.column(batch.schema.get_field_index(c)) for c in ("tokens_a", "tokens_b", "n_a", "n_b"))
        good = []
        for a, b, m, n in zip(x, y, nx.to_numpy(), ny.to_numpy()):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            p, q = len(a) - needed(m) + 1, len(b) - needed(n) + 1
            if not len(np.intersect1d(a[:p], b[:q], True)) or not len(np.intersect1d(a[-p:], b[-q:], True)):
                good.append(False)
                continue
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            good.append(OUT_OF * common >= LEAST_OF * (m + n - common))
        yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach): a row for each document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    blobs = docs.mapInArrow(lambda it: _emit(it, "doc_id", "text", k, buckets), "kind int, bucket int, blob binary, runs binary")
    counted = blobs.groupBy("bucket").applyInArrow(lambda t: _frequencies(t, buckets), "kind int, bucket int, blob binary")
    rows = written(counted.groupBy("bucket").applyInArrow(_prefixes, "kind int, token long, key long, n long, own long, cap long, doc_id long, tokens binary"), "jaccard-postings")
    named = rows.where("kind = 2").select("doc_id", "key", F.col("n").alias("n_shingles"))
    by_token = Window.partitionBy("token")
    lists = rows.where("kind = 0").select("token", "key", "n", "own", "cap")
    sets = rows.where("kind = 1").select("key", "n", "tokens")

    # a text that copies were made from has the fewest tokens of its own: it links with most of them
    lists = lists.withColumn("_least", F.min("n").over(by_token)).where("cap >= _least")
    hubs = lists.withColumn("_hub", F.min(F.struct("own", "key", "n", "cap")).over(by_token))
    stars = hubs.where("_hub.key <> key and n <= _hub.cap and _hub.n <= cap").select(F.col("_hub.key").alias("a"), F.col("key").alias("b")).distinct()
    stars = written(stars, "jaccard-stars")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
        right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
        return pairs.join(right, "b").join(left, "a").mapInArrow(_linked, "a long, b long")

    links = written(verified(stars), "jaccard-links")
    labels = components(links)
    labelled = lists.join(labels, lists["key"] == labels["node"], "left").select("token", "key", "n", "cap", F.coalesce("label", "key").alias("label"))
    mixed = labelled.withColumn("_several", F.min("label").over(by_token) < F.max("label").over(by_token)).where("_several")
    mixed = mixed.withColumn("_same", F.count("*").over(Window.partitionBy("token", "label")))
    mixed = written(mixed.withColumn("_most", F.max(F.struct("_same", "label")).over(by_token)).select("token", "key", "n", "cap", "label", (F.col("label") == F.col("_most.label")).alias("common")), "jaccard-mixed")
    few = mixed.where("not common").select("token", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("cap").alias("cap_a"), F.col("label").alias("label_a"))
    rest = mixed.select("token", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("cap").alias("cap_b"), F.col("label").alias("label_b"), "common")
    could = (few["token"] == rest["token"]) & (F.col("n_a") <= F.col("cap_b")) & (F.col("n_b") <= F.col("cap_a")) & (F.col("label_a") != F.col("label_b")) & (F.col("common") | (F.col("a") < F.col("b")))
    pairs = few.join(rest, could)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    more = written(verified(pairs), "jaccard-more-links")
    if not more.isEmpty():
        # later links join whole components: an edge between their labels is enough
        name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        joins = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        top = components(joins)
        labels = labels.unionByName(joins.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("label"))).distinct()
        labels = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("_top")), "label", "left").select("node", F.coalesce("_top", "label").alias("label"))
    discard(mixed)
    discard(stars)
    least = named.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("_least"))
    of_key = least.join(labels, least["key"] == labels["node"], "left").select("key", "_least", F.coalesce("label", "key").alias("label"))
    of_label = of_key.groupBy("label").agg(F.min("_least").alias("component_id"))
    found = of_key.join(of_label, "label").select("key", "component_id")
    linked = named.where("n_shingles > 0").join(found, "key").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
