import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from crawlspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


STRANGE = ["", None, " ", "\n", "É. é, İx. ΣΑΣ. it's. 12,3. x y\tz\x1cq é don't, ABC'S ", "a<|endoftext|>b <|EndOfText|> c",
           "., .. ,. a.b,c. ..x", "x" * 500, "日本語。テキスト, ok", "ß ẞ ǅ ŉ"]


def test_ids_are_the_tokenizers():
    enc = packing.Encoder(PATH)
    rng = random.Random(1)
    bits = ["the", "The", "THE", "é", "É", "Σ", "ΑΣ", "don't", "'s", ".", ",", "!?", "<|endoftext|>", "***", "###", "()", "-", "_x", "1", "23", " ", "  ", "\n", "\t", " ", "\x85", "İ", "ﬁ", "word", "Ünï"]
    texts = [t for t in STRANGE if t is not None] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(800)]
    for part in (texts, texts[::-1], texts[:3], ["plain", None, ""]):
        ids, at = enc.encode(pa.array(part, pa.string()))
        for t, a, b in zip(part, at, at[1:]):
            assert ids[a:b].tolist() == TOKENIZER.encode(t or "", add_special_tokens=False).ids, repr(t)
    for t in texts[:200]:  # no special token in the batch: letters are lowered at once
        ids, _ = enc.encode(pa.array([t]).slice(0))
        assert ids.tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_tokenizer_of_another_kind_is_refused(tmp_path):
    from tokenizers import models, pre_tokenizers

    words = {"[UNK]": 0, "a": 1, "b": 2}
    joined = Tokenizer(models.WordLevel({**words, "a b": 3}, unk_token="[UNK]"))  # white space does not part words
    large = Tokenizer(models.WordLevel({**words, "c": 1 << 16}, unk_token="[UNK]"))
    large.pre_tokenizer = pre_tokenizers.Whitespace()
    cased = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    for name, tokenizer in (("joined", joined), ("large", large), ("cased", cased)):
        tokenizer.save(str(tmp_path / name))
        with pytest.raises(ValueError):
            packing.Encoder(str(tmp_path / name))


def test_slices_keep_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * 10, None, "", "x" * 95, "x", "x" * 300, "y"])], names=["a", "b"])
    parts = list(packing.slices(iter([batch.slice(0, 2), batch.slice(2, 0), batch.slice(2, 2), batch.slice(4)]), 100))
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(7)) and len(parts) > 2


def check_pieces(rows, docs, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at: at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)
    return by_seq


def texts(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 300, 1200]))) for _ in range(n)]


def test_each_id_once_and_no_padding(spark):
    rng = random.Random(2)
    docs = dict(enumerate(STRANGE + texts(rng, 120)))
    docs |= {1000 + i: "the same again. " * 40 for i in range(60)}
    rows = [(d, t, "x", 1) for d, t in docs.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int")
    for window, shard in ((512, 4000), (4096, 2_000_000)):
        got = packing.pack(df, PATH, window=window, shard_tokens=shard).collect()
        check_pieces(got, docs, window)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id bigint, text string")
    got = packing.pack(df, PATH).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got for _ in range(1) if r.start == 0) == [("1", 3), ("1", 3), ("2", 1), ("None", 2)]
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_neighbours_are_those_of_bm25():
    rng = np.random.default_rng(3)
    rests = [rng.zipf(1.3, rng.integers(5, 200)).clip(1, 3000).astype("<u2") for _ in range(80)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=packing.ID_LIMIT)
    idf = np.log1p((len(rests) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(r) for r in rests])
    shard = packing.Shard(rests, idf, mean)
    shard.used[[3, 4]] = True
    # both kinds of ids are looked up: those with a row of weights and those with postings
    assert 0 < len(shard.dense) < len(np.unique(np.concatenate(rests)))
    for seed in range(10):
        query = set(rests[seed].tolist())
        score = {}
        for d, r in enumerate(rests):
            n = {t: int((r == t).sum()) for t in query if t in r}
            s = sum(idf[t] * k * (packing.K1 + 1) / (k + packing.K1 * (1 - packing.B + packing.B * len(r) / mean)) for t, k in n.items())
            if s and d not in (3, 4):
                score[d] = s
        got = list(shard.neighbours(seed))
        assert set(got) == set(score)
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_equal_scores_keep_the_order_of_the_shard():
    same = np.array([5, 6, 7], "<u2")
    rests = [same] * 200 + [np.array([9], "<u2")]
    shard = packing.Shard(rests, np.ones(packing.ID_LIMIT), 3.0)
    shard.used[0] = True
    assert list(shard.neighbours(0)) == list(range(1, 200))
    assert [[d for d, _, _ in w] for w in packing.Shard(rests, np.ones(packing.ID_LIMIT), 3.0).windows(30)] == [
        list(range(at, min(at + 10, 201))) for at in range(0, 201, 10)]


def test_related_documents_meet(spark):
    rng = random.Random(4)
    docs = {}
    for topic in range(12):
        own = [f"{chr(97 + topic)}{''.join(rng.choice('qxzvk') for _ in range(6))}" for _ in range(30)]
        for k in range(20):
            docs[topic + 12 * k] = " ".join(rng.choice(own) for _ in range(60))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    seqs = check_pieces(packing.pack(df, PATH, window=2048).collect(), docs, 2048)
    same = other = 0
    for pieces in seqs.values():
        topics = [r.doc_id % 12 for r in pieces]
        same += sum(a == b for a, b in zip(topics, topics[1:]))
        other += sum(a != b for a, b in zip(topics, topics[1:]))
    assert same > 4 * other
