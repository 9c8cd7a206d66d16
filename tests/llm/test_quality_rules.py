import random
import re
from collections import Counter

import numpy as np
import pytest

from crawlspark.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts(n=300):
    rng = random.Random(1)
    bits = ["a", "b", "the", "x#", "|", "é", " ", "\x1c", "\x85", "WORD", "!!", " ", "\n", "\t", "\v", "\r", "line one\n", "line one\n", "  \n", "日本"]
    return [None, "", "\n\n", "a a a a", "a b c a b c"] + [
        "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_counts():
    for t in texts():
        assert q.count(t)[:5] == brute(t), repr(t)
    long = " ".join(f"w{i % 70000}" for i in range(140000))
    assert q.count(long)[:5] == brute(long)


@pytest.mark.parametrize("kinds", [5, 1 << 40])
def test_repeats_with_many_kinds(kinds):
    ids = np.random.default_rng(1).integers(0, 5, 200)
    assert q.repeated_words(ids, kinds) == q.repeated_words(ids, 5)


def test_estimation_finds_planted_rates():
    rng = np.random.default_rng(2)
    good = rng.random(40000) < 0.85
    rates = [(0.7, 0.02), (0.6, 0.05), (0.8, 0.01), (0.5, 0.1)]  # bad votes on bad, on good
    columns = []
    for bad, fine in rates:
        vote = np.where(rng.random(len(good)) < np.where(good, fine, bad), "b", "g")
        columns.append(np.where(rng.random(len(good)) < 0.2, "-", vote))
    patterns = sorted(Counter(map("".join, zip(*columns))).items())
    prior, rate = q.estimate(patterns)
    assert abs(prior - 0.85) < 0.02
    assert np.abs(rate - np.array(rates)).max() < 0.05


def test_judged_rows(spark):
    good = "This is a line of plain words that nobody repeats {}.\n"
    rows = [(i, "".join(f"{chr(97 + (i * 7 + k) % 26)}{'xyzwv'[k % 5]}{i}q{k} and some {k}th words here.\n" for k in range(40))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{i}x{k}### ***" for k in range(80))) for i in range(8)]
    rows += [(200, None), (201, ""), (202, good.format(1)), (203, "again and again " * 60), rows[0]]
    df = spark.createDataFrame([(d, t, "z", True) for d, t in rows], "doc_id bigint, text string, counts string, kept boolean")
    got = sorted(q.judge(df).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: r[0])):
        n, chars, symbols, dup, repeat = brute(t)
        assert (r.counts.n_words, r.counts.word_chars, r.counts.n_symbols, r.counts.n_dup_lines, r.counts.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (d < 100)
    left = q.keep_good(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in rows if d < 100)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert q.judge(df).collect() == [] and q.keep_good(df).collect() == []
