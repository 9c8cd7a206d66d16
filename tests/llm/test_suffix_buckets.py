import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from crawlspark.llm import suffix_buckets as s


def plain(rows, size=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(d) else 0
        out.append((doc_id, len(d), int(gone.sum()), spans, sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id bigint, text string, first int, key string, text_hash int")
    return sorted((tuple(r) for r in s.digests(df.repartition(6), **settings).collect()), key=str)


def corpus(rng):
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [take(n) for n in (30, 40, 45, 60, 200)]
    rows = []
    for i in range(60):
        rows.append((i, take(rng.randrange(0, 40)) + " ".join(rng.choice([*shared, take(30)]) for _ in range(rng.randrange(4))) + take(rng.randrange(40))))
    # near copies: one letter changed here and there
    base = take(300)
    for i in range(12):
        text = list(base)
        for at in rng.sample(range(len(text)), rng.randrange(5)):
            text[at] = "#"
        rows.append((100 + i, "".join(text)))
    # strings of exactly 199, 200 and 201 bytes in other surroundings
    for k, n in enumerate((199, 200, 201)):
        common = "".join(rng.choice("xyzw") for _ in range(n))
        rows += [(200 + 10 * k + j, take(50) + "<" * (j + 1) + common + ">" * (j + 1) + take(50)) for j in range(3)]
    # periods, copies, a repeat within one text, overlaps, edges
    rows += [(300, "a" * 199), (301, "b" * 200), (302, "c" * 201), (303, "dé" * 400), (304, base[:150] + base), (305, "e" * 700 + "f" * 250)]
    rows += [(306, base), (307, base), (307, base), (None, base[10:400]), (None, None), (308, ""), (309, None), (310, "q" * 199 + "é")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bucket_rows", [(1, s.BUCKET_ROWS), (2, 3)])
def test_against_brute_force(spark, seed, bucket_rows):
    rows = corpus(random.Random(seed))
    got = run(spark, rows, bucket_rows=bucket_rows)
    assert got == plain(rows)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_hot_passage_and_large_group_of_copies(spark):
    rng = random.Random(3)
    take = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = take(260), take(500)
    rows = [(i, take(100) + passage + take(100)) for i in range(80)] + [(100 + i, copy) for i in range(80)]
    assert run(spark, rows, bucket_rows=10) == plain(rows)


def test_long_texts_are_read_in_parts(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij ") for _ in range(900_000))
    at = 3 * s.CHUNK - 150  # a repeat across the end of a part
    rows = [(1, long), (2, long[at:at + 300] + "".join(rng.choice("xyz") for _ in range(500)))]
    got = run(spark, rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 300, 1), (2, 300, 1)]


def test_every_string_has_one_owner():
    rng = random.Random(5)
    for letters in ("ab", "abcdefgh"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 900))).encode() for _ in range(20)]
        ends = np.cumsum([len(t) for t in texts])
        first, count, place, key = s.owners(np.frombuffer(b"".join(texts), np.uint8), ends)
        want = [int(e) - len(t) + i for t, e in zip(texts, ends) for i in range(len(t) - 199)]
        assert [x for a, n in zip(first, count) for x in range(a, a + n)] == want
        assert ((place >= first + count - 1) & (place + s.GRAM <= first + s.WINDOW)).all()
        assert (place - first < s.GRAMS).all()


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short")]) == plain([(1, None), (2, "short")])
