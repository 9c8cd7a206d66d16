"""Spelling variants: words one edit apart, by an index of grams of variable length.

Grams that occur often are grown by a letter, so a frequency-pruned dictionary of the frequent grams
decides how long the gram at each place of a word is. For every word a bound tells how many of its
grams one edit can affect at most. Two words one edit apart therefore share all but so many grams of
either, and meet in the lists of the bound plus one rarest grams of each. A shared gram that the edit
did not touch has the edit on one side of it: the text on its other side is equal too, and belongs to
the key of the list. What meets is verified.

A word of which one edit may affect every gram has its trigrams in the index as well, of which one
edit affects three at most; two such words meet there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare, stored

MIN_LETTERS = 7
MIN_COUNT = 2
FORM_TIMES = 10
DELETE_EVERY = 31
# shortest and longest gram
QMIN, QMAX = 3, 5
# a gram is frequent if it has more than one in so many of all places; so the dictionary has fewer grams than this
DICTIONARY_GRAMS = 20_000
# counts by hash that order the grams of a word; equal counts only make the order less telling
SKETCH = 1 << 17
# a list with more words than this is dealt out over several tasks
KEY_ROWS = 8192
# a task hands its counts on when it holds so many different words
HELD_WORDS = 200_000
# longer words are compared one by one
WIDE = 48
_PAIRS = 1 << 18

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LETTERS)


def words_of(doc_id: int | None, text: str) -> Counter:
    """Words of one text with their counts; a run that the hash names loses one letter."""
    found = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    out = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETE_EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < MIN_LETTERS:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word with enough occurrences; each task adds up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update(words_of(doc_id, text))
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class Grams:
    """Decomposes words by the dictionary of frequent grams."""

    def __init__(self, frequent: set[str], qmin: int, qmax: int) -> None:
        self.frequent, self.qmin, self.qmax = frequent, qmin, qmax
        # what can follow the place of an edit inside a gram that grows over it
        self.endings = {g[k:] for g in frequent for k in range(1, len(g))}

    def split(self, word: str) -> list[tuple[int, int]]:
        """(begin, end) of the grams: at each place the shortest, grown while it is frequent; those inside another are left out."""
        out, last, n = [], 0, len(word)
        for p in range(n - self.qmin + 1):
            e = p + self.qmin
            while e < n and e - p < self.qmax and word[p:e] in self.frequent:
                e += 1
            if e > last:
                out.append((p, e))
                last = e
        return out

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams of a word that one edit can change, hide or remove.

        A gram left of the edit depends on its own letters alone, unless the end of the word cut it
        short. One right of it is hidden if a gram over the edit grows past it, which takes a frequent
        gram that ends with the letters between.
        """
        n, worst, first = len(word), 0, 0
        for i in range(n + 1):
            changed = inserted = 0
            while first < len(grams) and grams[first][1] < i:
                first += 1
            for p, e in grams[first:]:
                if p > i and e > i + self.qmax:
                    break
                if p <= i < e or p > i and word[i + 1:e - 1] in self.endings:
                    changed += 1
                if p < i < e or p >= i and word[i:e - 1] in self.endings or (
                        i == e == n and e - p < self.qmax and word[p:] in self.frequent):
                    inserted += 1
            worst = max(worst, changed if i < n else 0, inserted)
        return worst


def frequent_grams(words: DataFrame, qmin: int, qmax: int, size: int) -> set[str]:
    """The dictionary: grams shorter than the longest with more than one in `size` of all places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                held.update(w[p:p + q] for q in range(qmin, qmax) for p in range(len(w) - q + 1))
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"gram": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"gram": list(held), "n": list(held.values())})

    counts = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    places = words.agg(F.sum(sum(F.greatest(F.length("word") - q + 1, F.lit(0)) for q in range(qmin, qmax)))).first()[0] or 0
    return {r.gram for r in counts.filter(F.col("n") * size > places).select("gram").collect()}


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SKETCH


def gram_counts(words: DataFrame, grams: Grams) -> np.ndarray:
    """How often the grams of each hash slot occur in the words' decompositions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            slots = [_slot(w[p:e]) for w in batch.column(0).to_pylist() for p, e in grams.split(w)]
            total += np.bincount(np.array(slots, np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = words.select("word").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def keys_of(word: str, grams: Grams, counts: np.ndarray) -> Iterator[str]:
    """The lists in which a word stands: two for each gram of its prefix, by the equal text to its left or right."""
    own = grams.split(word)
    bound = grams.affected(word, own)
    rarest = sorted(own, key=lambda g: (counts[_slot(word[g[0]:g[1]])], word[g[0]:g[1]], g[0]))
    for p, e in rarest[:bound + 1]:
        yield f"l{p} {word[:e]}"
        yield f"r{e - p} {word[p:]}"
    if bound >= len(own):
        three = sorted(range(len(word) - 2), key=lambda p: (counts[_slot(word[p:p + 3])], word[p:p + 3], p))
        for p in three[:4]:
            yield f"L{p} {word[:p + 3]}"
            yield f"R{word[p:]}"


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one replaced, inserted or deleted letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the words from the left and from the right, in rows of equal width, and their lengths."""
    size = np.array([len(w) for w in words])
    wide = min(int(size.max()), WIDE)
    left = b"".join(w[:wide].encode("latin-1").ljust(wide, b"\0") for w in words)
    right = b"".join(w[::-1][:wide].encode("latin-1").ljust(wide, b"\0") for w in words)
    return *(np.frombuffer(x, np.uint8).reshape(-1, wide) for x in (left, right)), size


def near_pairs(group: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs one edit apart within the groups; rows are sorted by group and length."""
    left, right, size = _letters(words)
    # partners of a row: those behind it in its group that are at most one letter longer
    _, number = np.unique(group, return_inverse=True)
    order = number.astype(np.int64) * (int(size.max()) + 3) + size
    stop = np.searchsorted(order, order + 1, "right")
    partners = stop - np.arange(len(words)) - 1
    a, b = [], []
    ends = np.cumsum(partners)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        part = partners[lo:hi]
        x = np.repeat(np.arange(lo, hi), part)
        if len(x):
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(part) - part, part)
            same = size[x] == size[y]
            gap = left[x] != left[y]
            fits = same & (gap.sum(axis=1) == 1)
            longer = np.flatnonzero(~same)
            if len(longer):
                back = right[x[longer]] != right[y[longer]]
                fits[longer] = gap[longer].argmax(axis=1) + back.argmax(axis=1) >= size[x[longer]]
            for k in np.flatnonzero(size[y] > WIDE):
                fits[k] = one_edit(words[x[k]], words[y[k]])
            a.append(x[fits])
            b.append(y[fits])
        lo = hi
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, size, word, n) sorted by group and size → near pairs; a group may span batches."""
    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        x, y = near_pairs(rows.column("group").to_numpy(), words)
        if len(x):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in x]), pa.array(n[x]), pa.array([words[k] for k in y]), pa.array(n[y])],
                names=["word", "n", "other", "other_n"])

    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.num_rows
        if held < 2 * KEY_ROWS:
            continue
        rows = pa.Table.from_batches(waiting)
        groups = rows.column("group").to_numpy()
        ended = np.flatnonzero(groups != groups[-1])
        done = int(ended[-1]) + 1 if len(ended) else 0
        if done:
            yield from out(rows.slice(0, done))
        waiting, held = rows.slice(done).combine_chunks().to_batches(), 0
    if waiting:
        yield from out(pa.Table.from_batches(waiting))


def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, size: int = DICTIONARY_GRAMS, key_rows: int = KEY_ROWS) -> DataFrame:
    """word, n, other, other_n: every pair of stored words one edit apart, once."""
    grams = Grams(frequent_grams(words, qmin, qmax, size), qmin, qmax)
    counts = gram_counts(words, grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [[xxhash.xxh3_64_intdigest(k) for k in set(keys_of(w, grams, counts))] for w in batch.column(0).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(k) for k in found]))
                keys = np.array([k for f in found for k in f], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "word", "n"])

    listed = stored(words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint"), "gram_lists")
    several = listed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    met = listed.join(several, "key").withColumn("parts", F.ceil(F.col("rows") / key_rows).cast("int"))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = met.withColumn("part", part).withColumn(
        "group", F.explode(F.when(F.col("parts") == 1, F.array(F.col("key"))).otherwise(F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda t: F.xxhash64("key", F.least("part", t), F.greatest("part", t))))))
    pairs = (
        dealt.select("group", F.length("word").alias("size"), "word", "n")
        .repartition("group").sortWithinPartitions("group", "size")
        .mapInArrow(_near, "word string, n bigint, other string, other_n bigint"))
    # a pair may meet in several lists
    first = F.col("word") < F.col("other")
    both = [F.when(first, F.struct("word", "n")).otherwise(F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))),
            F.when(first, F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))).otherwise(F.struct("word", "n"))]
    return pairs.select(both[0].alias("a"), both[1].alias("b")).distinct().select(
        "a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of every word with a near word; form is null if none occurs often enough."""
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    fits = -F.col("best.less") >= FORM_TIMES * F.col("n")
    return found.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))


def roots(edges: DataFrame) -> DataFrame:
    """word, root from word, form: forms followed to the last, the distance doubled each round.

    Counts grow tenfold with each step, so there are no circles and few rounds.
    """
    at = stored(edges.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if on.join(at, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, qmin: int = QMIN, qmax: int = QMAX, size: int = DICTIONARY_GRAMS, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    docs: doc_id and text; other columns are not looked at. Words are the runs of letters of all texts,
    lower-cased (A-Z); a run that the hash of doc_id and itself names has lost a letter. A null doc_id
    is hashed as empty; null and empty texts have no words. Repeated rows count again. Of equally
    frequent near words the smallest is the form. Words of any length are compared whole. Without
    words, an empty table included, the result is empty.
    """
    prepare(docs.sparkSession)
    words = stored(word_counts(docs), "words")
    found = stored(forms(words, near_words(words, qmin, qmax, size, key_rows)), "forms")
    linked = roots(found.filter("form is not null").select("word", "form"))
    return words.join(found, "word", "left").join(linked, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
