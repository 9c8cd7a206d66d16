"""Lexical retrieval packing: windows filled with a document's BM25 neighbours.

Documents are cut into token ids; whole windows of long documents stand alone. What is left of
each document is indexed in shards: every shard has an inverted index of its documents over token
ids, weighted with the statistics of the whole corpus. All terms of a seed document are looked up, the
best unused neighbours are appended until the window is full, and the part of the last one that
did not fit is the next seed. Only the end of a shard is left over; it is laid out in windows
of powers of two, which need no padding.
"""

from __future__ import annotations

import math
import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare, stored

WINDOW = 4096
END_ID = 2
# ids are stored in two bytes
ID_LIMIT = 1 << 16
SHARD_TOKENS = 2_000_000
# ids of more than one in so many documents of a shard have a row of weights
DENSE = 8
# neighbours that are sorted at once
FIRST_NEIGHBOURS = 64
K1, B = 1.2, 0.75
# words remembered per generation while a task runs: two are about 100 MB
MEMO_WORDS = 250_000

# marks that end a word; an apostrophe may belong to letters after it
MARKS = string.punctuation.replace("'", "")
# bytes of text encoded at once: a word is looked up once for all of them
ENCODED_BYTES = 8_000_000

# words by which a tokenizer file is tested when it is loaded
PROBES = ("a", "b", "Word", "WORDS,", "naïve", "Ünïted", "don't", "x.y", "12,5", "ΣΑΣ", "日本語")

FULL, REST, TERMS = 0, 1, 2
_ROWS = "kind int, doc_id bigint, start bigint, length bigint, crc bigint, doc_tokens bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _byte_letters() -> dict[int, str]:
    """Byte → letter, as byte-level vocabularies spell bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class Encoder:
    """Columns of texts to token ids, each distinct word of a batch looked up once.

    The tokenizer never joins text across ASCII white space, drops it, and lowers letters, so the ids
    of a text are those of its words in order. Arrow splits a batch into words and numbers the
    distinct ones; their ids are remembered, and numpy lays them out in order. A word of letters
    alone goes to the vocabulary directly; of letters with marks after them, the tokenizer parts the
    two, and so does this; all others go through the whole tokenizer. The last and the present
    generation of remembered words are kept, so frequent ones stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._check()

    def _check(self) -> None:
        """Refuse a tokenizer for which words looked up alone would give other ids."""
        def whole(text: str) -> bytes:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if max(ids, default=0) >= ID_LIMIT:
                raise ValueError("an id does not fit into two bytes")
            return array("H", ids).tobytes()

        if max(self.tokenizer.get_vocab().values(), default=0) >= ID_LIMIT:
            raise ValueError("an id does not fit into two bytes")
        if any(self._ids(w) != whole(w) for w in PROBES):
            raise ValueError("the tokenizer does not lower letters or spell bytes as expected")
        for gap in (" ", "  ", "\n", "\t "):
            if whole(gap + gap.join(PROBES) + gap) != b"".join(map(whole, PROBES)):
                raise ValueError("the tokenizer does not part words at white space")
        self.words, self.older = {}, {}

    def forget(self) -> None:
        """Give the memory back: a worker goes on to tasks of other kinds."""
        self.words, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self._ids(word)
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            low = word.lower()
            if low == word:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if low.isalpha() and "\u03a3" not in word:  # the lower case of a sigma depends on its place
                return self._word(low)
        base = word.rstrip(MARKS)
        if len(base) < len(word) and base.isalpha() and (
                base.isascii() or base.lower().isalpha() and unicodedata.is_normalized("NFC", base)):
            return self._word(base) + self._word(word[len(base):])
        return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the end); null is empty."""
        if len(self.words) > MEMO_WORDS:
            self.older, self.words = self.words, {}
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found before letters are lowered
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.get, distinct))
        coded = [self._word(w) if ids is None else ids for w, ids in zip(distinct, known)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        flat = np.frombuffer(b"".join(coded), "<u2")
        word = numbered.indices.to_numpy(zero_copy_only=False)
        n = sizes[word]
        ends = np.r_[0, np.cumsum(n)]
        begin = np.r_[0, np.cumsum(sizes)][:-1]
        ids = flat[np.repeat(begin[word] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def slices(batches: Iterator[pa.RecordBatch], size: int = ENCODED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about `size` bytes of text (column 1), at least one row each."""
    held, held_bytes = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(n) + held_bytes) // size
        bounds = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        for lo, hi in zip(bounds, bounds[1:]):
            if lo or (held and part[0]):
                yield _joined(held)
                held, held_bytes = [], 0
            held.append(batch.slice(lo, hi - lo))
            held_bytes += int(n[lo:hi].sum())
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, window: int, end_id: int):
    """Rows of three kinds: whole windows, rests with their ids, and a task's document frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen, last = np.zeros(ID_LIMIT, np.int64), np.zeros(ID_LIMIT, np.int64)
        docs = tokens = 0
        for part in slices(batches):
            rows = []
            all_ids, at_ = enc.encode(part.column(1))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                ids = np.append(all_ids[at_[k]: at_[k + 1]], np.uint16(end_id))
                n = len(ids)
                whole = n // window * window
                for at in range(0, whole, window):
                    rows.append((FULL, doc_id, at, window, crc(ids[at: at + window]), n, None))
                if n > whole:
                    rows.append((REST, doc_id, whole, n - whole, 0, n, ids[whole:].tobytes()))
                    tokens += n - whole
                    docs += 1
                place = np.arange(n)
                last[ids] = place  # an id counts once a document: at its last place
                seen[ids[last[ids] == place]] += 1
            yield _batch(rows)
        enc.forget()
        yield _batch([(TERMS, None, docs, tokens, 0, 0, seen.astype("<i8").tobytes())])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    names = [c.split()[0] for c in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents holding each id, rests, tokens in rests): the tables of all tasks summed by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.frombuffer(raw, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    tables = rows.filter(F.col("kind") == TERMS)
    df = np.zeros(ID_LIMIT, np.int64)
    # one row per token id, however many documents there are
    for r in tables.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[r.id] = r.n
    total = tables.agg(F.sum("start").alias("docs"), F.sum("length").alias("tokens")).first()
    return df, total.docs or 0, total.tokens or 0


class Shard:
    """Inverted index over the rests of one shard, packed greedily.

    A seed is looked up by all its distinct ids. Ids that more than one in `DENSE` documents hold have
    a row of weights over all documents, others a list of postings: adding a row costs less than
    scattering a long list. The rows have at most `DENSE` numbers for each posting they replace.
    """

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.rests, self.used = rests, np.zeros(len(rests), bool)
        n, lengths = len(rests), np.fromiter(map(len, rests), np.int64, len(rests))
        key = np.concatenate(rests) * np.int64(n) + np.repeat(np.arange(n), lengths)
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(first, append=len(key))
        term, self.docs = np.divmod(key[first], n)
        self.weights = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[self.docs] / mean_length))
        self.at = np.searchsorted(term, np.arange(ID_LIMIT + 1))
        held = np.diff(self.at)
        often = np.flatnonzero(held * DENSE > n)
        self.row = np.full(ID_LIMIT, -1)
        self.row[often] = np.arange(len(often))
        row = self.row[term]
        self.dense = np.zeros((len(often), n))
        self.dense[row[row >= 0], self.docs[row >= 0]] = self.weights[row >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for the distinct ids of the seed, 0 for used ones."""
        own = np.unique(self.rests[seed])
        row = self.row[own]
        spans = [slice(self.at[t], self.at[t + 1]) for t in own[row < 0].tolist()]
        scores = np.zeros(len(self.rests))
        if spans:
            scores += np.bincount(
                np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), len(scores))
        for r in row[row >= 0].tolist():
            scores += self.dense[r]
        scores[self.used] = 0
        return scores

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share an id with the seed, best BM25 score first."""
        scores = self.scores(seed)
        if len(scores) > FIRST_NEIGHBOURS:  # seldom are more needed: the others are sorted only then
            bound = np.partition(scores, -FIRST_NEIGHBOURS)[-FIRST_NEIGHBOURS]
            best = np.flatnonzero((scores >= bound) & (scores > 0))
            yield from best[np.argsort(-scores[best], kind="stable")].tolist()
            scores[best] = 0
        found = np.flatnonzero(scores)
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()

    def windows(self, size: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, from, to) that fill a window each; the last may be shorter."""
        left, next_ = None, 0
        while True:
            if left is None:
                while next_ < len(self.rests) and self.used[next_]:
                    next_ += 1
                if next_ == len(self.rests):
                    return
                left = (next_, 0)
                self.used[next_] = True
            seed, at = left
            window, room, left = [], size, None

            def take(d: int, at: int) -> None:
                nonlocal room, left
                n = min(room, len(self.rests[d]) - at)
                window.append((d, at, at + n))
                room -= n
                self.used[d] = True
                if at + n < len(self.rests[d]):
                    left = (d, at + n)

            take(seed, at)
            if room:
                for d in self.neighbours(seed):
                    take(d, 0)
                    if not room:
                        break
            while room and next_ < len(self.rests):  # no neighbour is left: go on in order
                if not self.used[next_]:
                    take(next_, 0)
                next_ += 1
            yield window


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A short window cut into windows whose lengths are powers of two, the longest first."""
    left = sum(b - a for _, a, b in pieces)
    pieces = list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            d, a, b = pieces.pop(0)
            n = min(room, b - a)
            window.append((d, a, a + n))
            room -= n
            if a + n < b:
                pieces.insert(0, (d, a + n, b))
        yield window


def _packed(df: np.ndarray, n_docs: int, mean_length: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc_id, start, doc_tokens, rests = [], [], [], []
        for batch in batches:  # a shard: about SHARD_TOKENS ids
            doc_id += batch.column(0).to_pylist()
            start += batch.column(1).to_pylist()
            doc_tokens += batch.column(2).to_pylist()
            rests += [np.frombuffer(raw, "<u2") for raw in batch.column(3).to_pylist()]
        if not rests:
            return
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        sequence, rows = TaskContext.get().partitionId() << 32, []
        for filled in Shard(rests, idf, mean_length).windows(window):
            full = sum(b - a for _, a, b in filled) == window
            for pieces in [filled] if full else powers_of_two(filled):
                offset = 0
                for d, a, b in pieces:
                    rows.append((doc_id[d], start[d] + a, b - a, crc(rests[d][a:b]), doc_tokens[d], 2 * sequence, offset))
                    offset += b - a
                sequence += 1
            if len(rows) > 10_000:
                yield _pieces(rows)
                rows = []
        if rows:
            yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.int64()) for v in zip(*rows)], names=[c.split()[0] for c in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text; other columns are not looked at. tokenizer: a tokenizers file that every
    worker can read; it has to lower letters, part words at white space and have ids below 65,536, which
    is tested when it is loaded (ValueError). A document is its token ids and `end_id`; a null or empty text is `end_id`
    alone. Every id lies in exactly one piece. Rows with equal or null doc_id are documents of their
    own. Sequences have `window` ids, or a power of two at the end of a shard. sequence_id is even
    for packed rests and odd for whole windows. An empty table gives an empty result.

    A shard gets rests with the same rarest id first, by ranges over (rarest id, doc_id): ranges are
    even whatever one id's share, as equal ids are split by doc_id.
    """
    prepare(docs.sparkSession)
    rows = stored(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_tokenised(tokenizer, window, end_id), _ROWS),
        "tokens")
    df, n_docs, tokens = _frequencies(rows)
    shards = max(1, math.ceil(tokens / shard_tokens))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rarest = []
                for raw in batch.column(3).to_pylist():
                    ids = np.frombuffer(raw, "<u2")
                    rarest.append(int(ids[np.argmin(df[ids])]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rarest, pa.int32())], names=[*batch.schema.names, "route"])

    rests = rows.filter(F.col("kind") == REST).select("doc_id", "start", "doc_tokens", "ids").mapInArrow(
        routed, "doc_id bigint, start bigint, doc_tokens bigint, ids binary, route int")
    packed = (
        rests.repartitionByRange(shards, "route", "doc_id").sortWithinPartitions("route", "doc_id", "start", "ids").drop("route")
        .mapInArrow(_packed(df, n_docs, tokens / max(1, n_docs), window), PIECES))
    whole = rows.filter(F.col("kind") == FULL).select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.union(whole)
