import zlib
from collections import Counter, defaultdict

import math

import xxhash

from tidemark.llm import sharding

from .cases import documents, rows


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def hashed(key, shard):
    first = xxhash.xxh64(key.encode(), seed=42).intdigest()
    return _hash_int(shard, first)


def _hash_int(value, seed):
    """xxHash64 of one 32-bit integer."""
    return xxhash.xxh64(value.to_bytes(4, "little"), seed=seed).intdigest()


def best(key, weights):
    scores = []
    for k, w in enumerate(weights):
        u = ((hashed(key, k) >> 11) + 0.5) / 2.0**53
        scores.append((-w / math.log(u), k))
    return max(scores)[1]


def test_against_brute_force(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    got = sharding.shard(documents(spark), weights, [*weights, 1.0], buckets=3).collect()
    want = Counter()
    for doc, text, *_ in rows():
        body = (text or "").encode()
        key = "" if doc is None else str(doc)
        want[doc, len(body) + 16, zlib.crc32(body), best(key, weights), best(key, [*weights, 1.0])] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_and_growth(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    got = sharding.shard(docs, [1.0, 3.0], [1.0, 3.0, 1.0]).collect()
    share = sum(r.shard == 1 for r in got) / len(got)
    moved = sum(r.shard != r.grown_shard for r in got) / len(got)
    assert abs(share - 0.75) < 0.02 and abs(moved - 0.2) < 0.02
    assert sharding.shard(docs.limit(0), [1.0], [1.0, 1.0]).count() == 0
