"""The pipeline against the plain versions of its stages, run over whole tables in Python."""

from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from test_decontaminate import plain_distance
from test_packing import check_pieces
from test_quality_rules import brute as plain_counts
from test_sentence_spans import brute as plain_spans
from test_simhash import plain_classes, plain_fingerprint

import corpus_pipeline
from crawlspark.llm import decontaminate, quality_rules

SF = "/root/testdata/sf0.001"


def plain_votes(text):
    c = dict(zip(quality_rules.COUNTS, quality_rules.count(text)))
    share = lambda a, b: c[a] / c[b] if c[b] else None
    letters = c["n_upper"] + c["n_lower"]
    n, kinds = c["n_words"], share("n_distinct", "n_words")
    tests = [
        (share("n_symbols", "n_words"), lambda v: v <= 0.05, lambda v: v > 0.2),
        (share("n_letters", "word_chars"), lambda v: v >= 0.9, lambda v: v < 0.8),
        (share("n_repeat_words", "n_words"), lambda v: v <= 0.25, lambda v: v > 0.5),
        (share("n_dup_lines", "n_lines"), lambda v: v <= 0.2, lambda v: v > 0.5),
        (share("word_chars", "n_words"), lambda v: 3 <= v <= 10, lambda v: v < 2 or v > 15),
        (share("n_top", "n_words"), lambda v: v <= 0.15, lambda v: v > 0.3 and n >= 20),
        (c["n_upper"] / letters if letters else None, lambda v: v <= 0.25, lambda v: v > 0.6),
        (kinds, lambda v: n >= 100 and v > 0.1, lambda v: n >= 100 and v < 0.03),
        (share("n_shouts", "n_words"), lambda v: v <= 0.1, lambda v: v > 0.3),
    ]
    return "".join("-" if v is None else "b" if bad(v) else "g" if good(v) else "-" for v, good, bad in tests)


def test_pipeline_against_plain_stages(spark):
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    bench = con.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()

    votes = [plain_votes(t) for _, t in docs]
    prior, rate = quality_rules.estimate(sorted(Counter(votes).items()))
    kept = []
    for (d, t), v in zip(docs, votes):
        n, _, _, _, repeat = plain_counts(t)
        log = np.log(prior / (1 - prior)) + sum(
            np.log(g / b) if x == "b" else np.log((1 - g) / (1 - b)) if x == "g" else 0 for x, (b, g) in zip(v, rate))
        if n >= 50 and 100 * repeat <= 50 * n and log >= 0:
            kept.append((d, t))
    assert 0 < len(kept) < len(docs)
    classes = plain_classes([(d, plain_fingerprint(t)) for d, t in kept])
    unique = [(d, t) for (d, t), c in zip(kept, classes) if d == c]
    assert len(unique) < len(kept)
    cut = [(d, t) for (d, _), t in zip(unique, plain_spans(unique)) if t.strip()]
    assert cut != unique
    items = [decontaminate.normalise(t) for (t,) in bench]
    clean = {}
    for d, t in cut:
        norm = decontaminate.normalise(t)
        # only a text that holds a piece unchanged can hold the item
        near = [x for x in items if any(
            x[j * len(x) // (k + 1): (j + 1) * len(x) // (k + 1)] in norm for k in [int(decontaminate.ERROR_RATE * len(x))] for j in range(k + 1))]
        if not any(plain_distance(x, norm) <= int(decontaminate.ERROR_RATE * len(x)) for x in near):
            clean[d] = t
    assert 0 < len(clean) < len(cut)
    check_pieces(corpus_pipeline.run(spark, SF).collect(), clean, 4096)
    assert public_tokenizers.path(corpus_pipeline.TOKENIZER)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x " * 30000, "en", "s", 1)], table.schema)
    for docs in (table.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            else:
                assert out.columns == docs.columns
                out.collect()
