import random

from crawlspark.llm import sentence_spans as s


def brute(rows, n=s.SENTENCES, min_words=s.MIN_WORDS):
    """Text left per row, by comparing every run of the whole corpus in order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), [None] * len(rows)
    for i in order:
        text = rows[i][1]
        if text is None:
            continue
        ends, sizes, keys = s.sentences(text)
        if not ends:  # no word: nothing to cut
            out[i] = text
            continue
        gone = set()
        for a in range(len(keys)):
            b = a + n
            while b <= len(keys) and sum(sizes[a:b]) < min_words:
                b += 1
            if b > len(keys):
                continue
            run = tuple(keys[a:b])
            if run in seen:
                gone |= set(range(a, b))
            seen.add(run)
        out[i] = "".join(text[x:y] for k, (x, y) in enumerate(zip([0, *ends], ends)) if k not in gone)
    return out


def corpus(rng):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "!", ".\n"]) for _ in range(n))

    shared = [prose(60), prose(90), " ".join(rng.choice(vocabulary) for _ in range(70)), "Short. One. Two.", "line\n" * 30]
    rows = [(i, " ".join(rng.choice([prose(40), prose(200), rng.choice(shared)]) for _ in range(rng.randrange(1, 5)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, " \n "), (503, rows[3][1]), (None, "nothing here"), (504, "\n\n" + shared[0] + "\n")]


def test_pieces_cover_the_text():
    rng = random.Random(1)
    for _, t in corpus(rng):
        if t and t.split():
            ends, sizes, keys = s.sentences(t)
            assert ends[-1] == len(t) and ends == sorted(set(ends))
            assert sum(sizes) == len(t.split())
            assert b" ".join(keys) == " ".join(t.split()).lower().encode()


def test_against_brute_force(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = corpus(rng)
        rng.shuffle(rows)
        df = spark.createDataFrame([(d, t, "c", 0, None) for d, t in rows], "doc_id bigint, text string, first string, stop int, h1 bigint")
        out = s.remove_repeats(df)
        assert out.columns == [*df.columns, "dedup"]
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == {d: t for (d, _), t in zip(rows, brute(rows))}


def test_passage_is_found_wherever_it_stands(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = take(60)  # one sentence without any mark
    rows = [(i, f"{take(30)} {passage} {take(30)}") for i in range(20)] + [(100 + i, take(100)) for i in range(20)]
    got = {r.doc_id: r for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    inside = " ".join(passage.split()[15:45])
    assert inside in got[0].text and got[0].dedup.n_removed == 0
    assert not any(inside in got[i].text for i in range(1, 20))
    assert all(got[100 + i].text == dict(rows)[100 + i] for i in range(20))


def test_equal_rows_and_empty_table(spark):
    text = "One sentence of five words. Two sentences of five words. Three sentences of five words."
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in s.remove_repeats(df).collect()) == [(1, text), (1, text), (2, "")]
    assert s.remove_repeats(df.limit(0)).collect() == []


def test_any_51_words_hold_a_shared_run():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for k in range(3000):
        n = 51 + k % 10
        passage = take(n) if k % 5 else " ".join(rng.choice(words[:1 + k % 4]) for _ in range(n))
        marks = rng.choice(["", "", ".", "\n"])
        a, b = (f"{take(rng.randrange(40))}{rng.choice([' ', '. '])}{passage}{marks} {take(rng.randrange(40))}" for _ in range(2))
        first, second = ({tuple(h) for h in s.spans(t)[0]} for t in (a, b))
        assert first & second
        assert max(s.sentences(a)[1]) <= s.WINDOW


def test_a_passage_loses_all_but_its_ends(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    take = lambda n: [rng.choice(words) for _ in range(n)]
    rows, inside = [], {}
    for i in range(100):
        passage = take(51 + i % 30)
        for d in (i, 1000 + i):
            rows.append((d, " ".join(take(30) + passage + take(30))))
        inside[1000 + i] = " ".join(passage[15:len(passage) - 22])
    got = {r.doc_id: r.text for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(p in got[d] for d, p in inside.items())
    assert all(got[i] == dict(rows)[i] for i in range(100))


def test_equal_rows_gather_each_run_once(spark):
    text = " ".join(f"w{i % 97}x{i}" for i in range(200))
    df = spark.createDataFrame([(1, text)] * 50 + [(0, text)], "doc_id bigint, text string")
    (row,) = s.covered_runs(df).collect()
    assert row.doc_id == 1 and len(row.covered) == len(set(row.covered)) <= len(s.sentences(text)[0])


def test_a_frequent_run_over_many_partitions(spark):
    """Borders between partitions fall inside runs, also inside equal rows."""
    text = "One sentence of five words. Two sentences of five words. Three sentences of five words."
    rows = [(i, text) for i in range(200)] + [(3, text)] * 60 + [(None, text)] * 60
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = sorted(((r.doc_id, r.text) for r in s.remove_repeats(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == sorted([(i, "") for i in range(200)] + [(3, "")] * 60 + [(None, text)] * 60, key=str)
