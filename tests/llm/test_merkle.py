import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from crawlspark.llm import merkle

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string, skey int, pos string, block int"


def plain_leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, per node: siblings level by level as [(before, after)])."""
    path, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a:a + 16]
            for k, leaves in enumerate(at[a:a + 16]):
                for i in leaves:
                    path[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha256("".join(run).encode()).hexdigest())
            under.append([i for leaves in at[a:a + 16] for i in leaves])
        nodes, at = above, under
    return nodes[0], path


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = []
    for source in sorted(by):
        own = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        leaves = [plain_leaf(r) for r in own]
        trees.append((own, leaves, *plain_tree(leaves)))
    root, tops = plain_tree([t[2] for t in trees])
    out = []
    for (own, leaves, subroot, paths), top in zip(trees, tops):
        for r, leaf, path in zip(own, leaves, paths):
            whole = path + top
            node = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = plain_leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in whole:
                node = sha256((a + node + b).encode()).hexdigest()
            proof = sha256("".join(a + b for a, b in whole).encode()).hexdigest()
            out.append((r[0], leaf, subroot, root, proof, node, node == root, len(whole)))
    return out


def run(spark, rows, parts, levels=merkle.BLOCK_LEVELS):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS).repartition(parts)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return [tuple(r) for r in merkle.manifest(df, tampered, levels).collect()]


def documents(rng, sizes):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        source = [None, "", "Été", "z", "a b"][k] if k < 5 else f"s{k}"
        for _ in range(n):
            at += rng.randrange(1, 4)
            rows.append((at, source, rng.choice([None, "de"]), rng.choice([None, 3]), rng.choice([None, "", "Some Text é", "all low", "X" * rng.randrange(99)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[1], [17, 1], [300, 2, 31, 16] + [3] * 20])
def test_against_brute_force(spark, sizes):
    rows = documents(random.Random(len(sizes)), sizes)
    assert sorted(run(spark, rows, 5)) == sorted(brute(rows))


@pytest.mark.parametrize("levels", [1, 2])
def test_many_blocks_and_rounds(spark, levels):
    rows = documents(random.Random(levels), [1, 700, 256, 257, 16] + [2] * 30)
    assert sorted(run(spark, rows, 7, levels)) == sorted(brute(rows))


def test_equal_rows_null_ids_and_long_texts(spark):
    rows = [(1, "a", None, 1, "T")] * 40 + [(None, "a", "x", None, None)] * 3 + [(None, None, None, None, "Q" * 3_000_000), (7, "b", "x", 2, "Ab" * 2_000_000)]
    got = run(spark, rows, 3)
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert run(spark, [], 1) == []


def test_witness_grows_with_later_siblings():
    tree, witnesses = merkle.OpenTree(), [[] for _ in range(40)]
    nodes = [merkle.digest(str(i).encode()) for i in range(40)]
    for i, (node, w) in enumerate(zip(nodes, witnesses)):
        tree.append(node, w)
        # a witness holds the runs that are complete above its leaf, no more
        assert [len(x) for x in witnesses] == [1 if j // 16 < (i + 1) // 16 else 0 for j in range(40)]
    root = tree.close()
    assert {merkle.fold(n, w) for n, w in zip(nodes, witnesses)} == {root}
    assert merkle.unpack(merkle.pack(witnesses[39])) == witnesses[39]
