import random

import pytest

from crawlspark.llm import decontaminate as d


def plain_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, x in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        k, best = rng.randrange(0, 40), plain_distance(p, t)
        assert d.distance_within(p, t, k) == (best if best <= k else None)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[k] = rng.choice("xyz")
        elif kind == 1:
            text.insert(k, rng.choice("xyz"))
        else:
            del text[k]
    return "".join(text)


@pytest.mark.parametrize("block", [200, 100_000])
def test_against_all_pairs(spark, block):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(8, 30))) for i in range(14)] + [(90, None), (91, ""), (92, "tiny"), (93, "a b " * 30)]
    docs = [(0, None), (1, ""), (2, "a b " * 200)]
    for k in range(3, 60):
        text = prose(rng.randrange(1, 40))
        if k % 3:
            item = items[rng.randrange(14)][1]
            text += rng.choice([" ", "\n", ". "]) + edited(rng, item.title() if k % 2 else item.replace(" ", ",\n "), rng.randrange(0, 9)) + " " + prose(10)
        docs.append((k, text))
    docs += [(200, "So: is the ANSWER, 42?"), (201, "is the answer 421"), (202, "tinyish, untiny"), (203, "so tiny"), (204, "tiny"), (205, "zz " * 500 + "tiny")]
    items += [(94, "Is the answer 42"), (95, "?!")]
    df = spark.createDataFrame([(a, t, 1, "u") for a, t in docs], "doc_id bigint, text string, item_id int, edits string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, doc_id int")
    want = set()
    for a, t in docs:
        for i, x in items:
            x = d.normalise(x or "")
            if 0 < len(x) < d.SHORT_ITEM_CHARS:
                if f" {x} " in f" {d.normalise(t or '')} ":
                    want.add((a, i, 0))
            elif x:
                best = plain_distance(x, d.normalise(t or ""))
                if best <= int(d.ERROR_RATE * len(x)):
                    want.add((a, i, best))
    got = {(r.doc_id, r.item_id, r.edits) for r in d.contaminations(df, bench, block_chars=block).collect()}
    assert got == want and len({e for _, _, e in got}) > 1
    left = d.drop_contaminated(df, bench, block_chars=block)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {a for a, _ in docs} - {a for a, _, _ in want}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.contaminations(docs, none).collect() == []
    assert d.drop_contaminated(docs, none).count() == 1
    bench = spark.createDataFrame([(1, "a test item of some length")], "item_id bigint, text string")
    assert d.contaminations(docs.limit(0), bench).collect() == []
    assert d.drop_contaminated(docs.limit(0), bench).count() == 0
