import random
import re

import xxhash

from glyphora.llm import components as components_module
from glyphora.llm import simhash
from glyphora.llm.components import connected_components

from .helpers import components, edge_documents, empty_documents


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1") <= 3


def test_fingerprints_and_components(spark):
    docs = edge_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    given = docs.collect()
    assert len(rows) == len(given)
    fps = sorted(slow_fingerprint(d.text) for d in given)
    assert sorted(r.fp % (1 << 64) for r in rows) == fps
    least = components(sorted(set(fps)), near)
    ids = {}
    for d in given:
        if d.doc_id is not None:
            root = least[slow_fingerprint(d.text)]
            ids[root] = min(ids.get(root, d.doc_id), d.doc_id)
    for r in rows:
        assert r.component_id == ids.get(least[r.fp % (1 << 64)])


def test_index_against_brute_force(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base} | {rng.getrandbits(64) for _ in range(300)}
    for _ in range(700):
        v = base
        for _ in range(rng.randint(1, 9)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = components(values, near)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for n, hot in ((1, None), (simhash.FOUR + 1, None), (simhash.FIVE + 1, None), (1, 16)):  # coarse, fine and finer blocks; the last deal most buckets out again
        got = dict(connected_components(simhash.links(df, n, hot)).collect())
        assert all(got.get(v, v) == want[v] for v in values)


def test_blocks():
    rng = random.Random(1)
    for blocks in (4, 5, 6):
        assert all(any((a ^ b) & m == 0 for m in simhash.masks(blocks)) for a, b in near_pairs(rng, 500))
    for a, b in near_pairs(rng, 500):
        mask = rng.getrandbits(64) & ~(a ^ b)
        assert any((a ^ b) & m == 0 for m in simhash.finer(mask)) and all(m & mask == mask for m in simhash.finer(mask))
    assert simhash.finer((1 << 64) - 1) == [] and len(simhash.finer((1 << 64) - 8)) == 3


def near_pairs(rng, n):
    for _ in range(n):
        a = rng.getrandbits(64)
        yield a, a ^ sum(1 << k for k in rng.sample(range(64), 3))


def test_a_hub_is_in_no_task_whole(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 2000)] + [(i, i + 5000) for i in range(1, 300)], "u long, v long")
    both = edges.union(edges.selectExpr("v as u", "u as v"))
    full = components_module._with_least(both, 2 * edges.count(), components_module._least(both))
    held = full.selectExpr("spark_partition_id() as p", "u").where("u = 0").groupBy("p").count().collect()
    assert full.where("u = 0").count() == 1999 and max(r["count"] for r in held) < 1200 and full.where("u = 0 and m <> 1").count() == 0
    assert {r.root for r in connected_components(edges).collect()} == {0}


def test_gray_rank_orders_neighbours(spark):
    rows = spark.range(16).selectExpr("id ^ shiftrightunsigned(id, 1) as fp", "id")
    ranks = [r.r - -(1 << 63) for r in rows.select(simhash.gray_rank(rows.fp).alias("r"), "id").orderBy("id").collect()]
    assert ranks == list(range(16))


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (3, 2)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 1000 for i in range(1001, 1200))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    docs = edge_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and 12 not in ids and 8 not in ids and 7 in ids
    assert len(rows) == len({r.root for r in simhash.near_duplicates(docs).collect()})
    assert simhash.keep_one(empty_documents(spark)).count() == 0
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
