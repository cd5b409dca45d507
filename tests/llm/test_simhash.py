import random

import numpy as np
import pytest
import xxhash
from odd_rows import TEXTS, rows_of

from claimgraph.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius=4):
    """Smallest position reachable over pairs within the radius."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(draw, n):
    """Random fingerprints and walks of small steps from them."""
    out = []
    for _ in range(n):
        fp = draw.getrandbits(64)
        out.append(fp)
        for _ in range(draw.randrange(5)):
            for bit in draw.sample(range(64), draw.randrange(7)):
                fp ^= 1 << bit
            out.append(fp)
    return sorted(set(out))


@pytest.mark.parametrize("bits", [6, 9, 14])
def test_every_link_meets_in_a_bucket(bits):
    fps = near(random.Random(bits), 40)
    masks = S.flips(bits, 2)
    assert sum(map(len, masks.values())) == 1 + 64 + 2016
    sent = {}
    for bucket, block in S.scatter(np.array(fps, np.uint64), bits, np.array(sorted(masks), np.int64)):
        sent.setdefault(bucket, []).append(block)
    links = {tuple(x) for b, blocks in sent.items() for x in S.meet(np.concatenate(blocks), b, bits, masks).tolist()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    at = {fp: k for k, fp in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(fps))] == brute_groups(fps)


def test_buckets_grow_with_the_data():
    assert S.bucket_bits(1000, 2081) == S.FEWEST_BUCKET_BITS
    assert S.bucket_bits(1 << 30, 2081) == 16 + 1


def test_stars_of_random_graphs(spark):
    draw = random.Random(1)
    for n, m in ((30, 20), (200, 190), (50, 0)):
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(20)] if m else [])
        pairs = [(a, b) for a, b in pairs if a != b]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        want = sorted((k, find(k)) for k in range(n) if find(k) != k)
        assert rows_of(S.stars(spark.createDataFrame(pairs, "a bigint, b bigint"))) == sorted(want, key=repr)


def texts():
    draw = random.Random(9)
    base = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(50)) for _ in range(400)) for _ in range(8)]
    out = list(base)
    for text in base[:4]:
        words = text.split()
        for k in (1, 2):
            out.append(" ".join(words[:-k] + ["new"] * k))
    return out + [base[0], base[0], base[1].upper()]


def test_groups_of_documents(spark, odd_docs, no_docs):
    rows = list(enumerate(texts()))
    fps = [brute_fingerprint(t) for _, t in rows]
    want = [(k, f"{fp:016x}", root) for (k, _), fp, root in zip(rows, fps, brute_groups(fps), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(S.near_duplicates(docs)) == sorted(want, key=repr)
    kept = {r["doc_id"] for r in S.keep_one(docs).collect()}
    assert kept == {root for _, _, root in want}
    rows = [*TEXTS.items(), (9, "one"), (None, "no id here at all")]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_groups(fps)
    least = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    want = [(d, f"{fp:016x}", least.get(root)) for (d, _), fp, root in zip(rows, fps, roots, strict=True)]
    assert rows_of(S.near_duplicates(odd_docs)) == sorted(want, key=repr)
    assert rows_of(S.near_duplicates(no_docs)) == [] and rows_of(S.keep_one(no_docs)) == []
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(roots))
