import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crawlspark.llm import spelling


def plain_words(docs):
    out = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_variants(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and x != w and distance(w, x) == 1] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def corpus(rng):
    parts = ["ment", "tion", "eau", "re", "é", "ça", "s", "ana", "x"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 6))) for _ in range(60)]
    # chains of variants whose counts grow tenfold
    base = "wonderfully"
    vocabulary += [base] * 300 + ["wonderfuly"] * 30 + ["wonderfuy"] * 3 + ["aaaaaaa"] * 4 + ["aaaaaaaa"] * 3 + ["ÄÖÜäöü÷"] * 2
    docs = []
    for i in range(150):
        take = [rng.choice(vocabulary) for _ in range(60)]
        for k in range(0, 60, 4):
            w, at = take[k], rng.randrange(len(take[k]))
            take[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + "q" + w[at:], w[:at] + "é" + w[at + 1:], w.upper()])
        docs.append((i, rng.choice([" ", ", ", "1"]).join(take)))
    return docs + [(None, " ".join(vocabulary[:20])), (900, None), (901, ""), docs[3], (902, "short words in it"), (903, "k" * 50_000 + " " + "k" * 49_999)] + [
        (1000 + i, "y" * 300 + " " + "y" * 299 + "z " + "y" * 301) for i in range(2)]


@pytest.mark.parametrize("settings", [{}, {"qmin": 2, "qmax": 4, "size": 40, "key_rows": 7}, {"qmin": 2, "qmax": 6, "size": 2000, "key_rows": 50}])
def test_against_all_pairs(spark, settings):
    docs = corpus(random.Random(1))
    df = spark.createDataFrame([(d, t, "x", 3, 4) for d, t in docs], "doc_id bigint, text string, word string, n int, size int").repartition(5)
    got = sorted((tuple(r) for r in spelling.variants(df, **settings).collect()), key=str)
    want = plain_variants(plain_words(docs))
    assert got == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_bound_of_affected_grams_holds():
    """Words one edit apart share all grams but the bound, and a list."""
    rng = random.Random(2)
    for k in range(4000):
        letters = "abcde"[:rng.randrange(1, 6)]
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 14)))
        qmin = rng.choice([2, 3])
        qmax = rng.randrange(qmin + 1, 7)
        grown = [word[p:p + q] for q in range(qmin, qmax) for p in range(len(word) - q + 1)]
        frequent = {g for g in grown if rng.random() < 0.5} | {"".join(rng.choice(letters) for _ in range(rng.randrange(qmin, qmax))) for _ in range(20)}
        grams = spelling.Grams(frequent, qmin, qmax)
        at = rng.randrange(len(word))
        other = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + "e" + word[at + 1:], word + rng.choice(letters)])
        if other == word or len(other) < 7:
            continue
        cut = {w: Counter(w[p:e] for p, e in grams.split(w)) for w in (word, other)}
        shared = sum((cut[word] & cut[other]).values())
        bounds = {w: grams.affected(w, grams.split(w)) for w in (word, other)}
        assert shared >= max(sum(cut[w].values()) - bounds[w] for w in bounds)
        counts = np.array([rng.randrange(3) for _ in range(spelling.SKETCH)]) if k % 400 == 0 else np.zeros(spelling.SKETCH, np.int64)
        assert set(spelling.keys_of(word, grams, counts)) & set(spelling.keys_of(other, grams, counts))
        assert spelling.one_edit(word, other) and spelling.one_edit(other, word) and distance(word, other) == 1


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(f"{i:x}".replace("0", "g").rjust(9, "a"), 2) for i in range(3000)], "word string, n bigint")
    words = words.withColumn("word", words.word)
    found = spelling.frequent_grams(words, 2, 5, 50)
    assert 0 < len(found) < 50
    assert spelling.frequent_grams(words.limit(0), 2, 5, 50) == set()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(df).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "no long ones")], "doc_id bigint, text string")).collect() == []
