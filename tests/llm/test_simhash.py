import random

import pytest
import xxhash

from crawlspark.llm import simhash
from crawlspark.llm.common import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    """fps: list of (id, fp) → component id per row, comparing every pair."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def texts(rng, n):
    words = ["alpha", "Beta", "gamma", "délta", "eps", "Zeta", "ÉTA", "theta", "iota", "kappa"]
    out = [None, "", " \n\t", "one", "one two three", "ONE two three", "nb sp one"]
    while len(out) < n:
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            out.append("\n".join(near))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(texts(rng, 250))]
    rows += [rows[10], (None, "alone here"), (500, rows[20][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, fp string, root int, key int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f, c) for (d, f), c in zip(fps, plain_classes(fps))), key=str)
    assert got == want


def test_large_key_is_dealt_out_and_whole(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:  # a dense group that shares most keys, a chain, and strangers
        fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    linked = {r.node: r.root for r in components(simhash.links(df, key_rows=50)).collect()}
    # the brute force labels by smallest id; take the number as id
    want = plain_classes([(f, f % (1 << 64)) for f in signed])
    assert [linked.get(f, f) for f in signed] == want


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(5, long), (3, long + " "), (3, long), (9, "other words entirely here"), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, "de", None) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text.strip()) for r in left.collect()) == [(2, ""), (3, long), (9, "other words entirely here")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.drop_near_duplicates(df).collect() == []


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}
