"""Quality rules by weak supervision.

Each rule looks at counts of one whole text and votes good, bad, or abstains. What the votes are
worth is not fixed: expectation-maximisation estimates, from the votes of all documents, how
often each rule votes bad on a good and on a bad document, and the prior of a good one. A
document's posterior probability then decides, instead of every rule having to pass.

The votes of a corpus are summed up by how often each combination of votes occurs. With R rules
there are at most 3^R of them whatever the number of documents, so the fit gathers only that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare, stored

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_POSTERIOR = 0.5
ITERATIONS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_open_lines", "n_distinct", "n_top", "n_upper", "n_lower", "n_shouts", "n_letters")

GOOD, BAD = "g", "b"


def repeated_words(ids: np.ndarray, kinds: int, window: int = 3) -> int:
    """Words inside windows that occur twice or more, the first time included; each word once."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code = ids[:n]
    for k in range(1, window):
        size = int(code.max()) + 1
        if size > (1 << 62) // max(kinds, 1):
            code = np.unique(code, return_inverse=True)[1]
        code = code * kinds + ids[k: n + k]
    _, place, times = np.unique(code, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[place] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[again + k] = True
    return int(covered.sum())


def count(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS, over the whole text; null counts as no text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(per_byte[0x80:0xC0].sum())
    spaces = int(per_byte[np.frombuffer(SPACES, np.uint8)].sum())
    words = raw.split()
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    seen: set[bytes] = set()
    lines = dup = open_ = 0
    for line in raw.split(b"\n"):
        if tail := line.rstrip():
            lines += 1
            open_ += tail[-1:] not in b".!?:\"'"
            if line in seen:
                dup += 1
            seen.add(line)
    return (
        len(words), points - spaces, int(per_byte[np.frombuffer(SYMBOLS, np.uint8)].sum()), dup,
        repeated_words(ids, len(kinds)), lines, open_, len(kinds),
        int(np.bincount(ids).max()) if len(ids) else 0,
        (upper := int(per_byte[65:91].sum())), (lower := int(per_byte[97:123].sum())), int(per_byte[ord("!")]),
        upper + lower + points - int(per_byte[:0x80].sum()))


def with_counts(docs: DataFrame) -> DataFrame:
    """The documents with a struct column `counts`."""
    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return docs.withColumn("counts", counted(F.col("text").cast("string")))


def _share(part: str, whole: str) -> Column:
    n = F.col(f"counts.{whole}")
    return F.when(n > 0, F.col(f"counts.{part}") / n)


def rules() -> dict[str, tuple[Column, Column]]:
    """Name → (votes good, votes bad); a rule for which neither holds, or is null, abstains."""
    symbols, repeats, dups = _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    length, top, kinds = _share("word_chars", "n_words"), _share("n_top", "n_words"), _share("n_distinct", "n_words")
    letters = F.col("counts.n_upper") + F.col("counts.n_lower")
    upper = F.when(letters > 0, F.col("counts.n_upper") / letters)
    plain = _share("n_letters", "word_chars")
    shouts, n = _share("n_shouts", "n_words"), F.col("counts.n_words")
    return {
        "few_symbols": (symbols <= 0.05, symbols > 0.2),
        "mostly_letters": (plain >= 0.9, plain < 0.8),
        "few_repeats": (repeats <= 0.25, repeats > 0.5),
        "few_dup_lines": (dups <= 0.2, dups > 0.5),
        "word_length": (length.between(3, 10), (length < 2) | (length > 15)),
        "no_top_word": (top <= 0.15, (top > 0.3) & (n >= 20)),
        "lower_case": (upper <= 0.25, upper > 0.6),
        "many_words": ((n >= 100) & (kinds > 0.1), (n >= 100) & (kinds < 0.03)),
        "no_shouting": (shouts <= 0.1, shouts > 0.3),
    }


def votes() -> Column:
    """One letter per rule: g, b, or - for an abstention."""
    return F.concat(*[
        F.when(F.coalesce(bad, F.lit(False)), BAD).when(F.coalesce(good, F.lit(False)), GOOD).otherwise("-")
        for good, bad in rules().values()])


def estimate(patterns: list[tuple[str, int]], iterations: int = ITERATIONS) -> tuple[float, np.ndarray]:
    """(prior of good, table [rule, class] of the probability to vote bad when voting).

    Expectation-maximisation over vote combinations and how often each occurs. Classes are bad (0)
    and good (1). Votes are taken as independent given the class, abstentions say nothing. It starts
    from "any bad vote is a bad document". A rule that would vote bad more often on good documents
    than on bad ones is held at equal rates, which makes it count for nothing.
    """
    if not patterns:
        return 0.5, np.zeros((0, 2))
    letters = np.array([list(p) for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    bad, good = letters == BAD, letters == GOOD
    posterior = np.where(bad.any(axis=1), 0.05, 0.95)
    for _ in range(iterations):
        prior = float(np.clip((n @ posterior + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
        weight = np.stack([n * (1 - posterior), n * posterior], axis=1)
        voted_bad, voted = bad.T @ weight, (bad | good).T @ weight
        rate = (voted_bad + np.array([0.5, 0.005])) / (voted + 1.0)
        wrong = rate[:, 0] < rate[:, 1]
        rate[wrong] = ((voted_bad.sum(axis=1) + 0.5) / (voted.sum(axis=1) + 1.0))[wrong, None]
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        log = np.log(prior / (1 - prior)) + bad @ np.log(rate[:, 1] / rate[:, 0]) + good @ np.log(
            (1 - rate[:, 1]) / (1 - rate[:, 0]))
        posterior = 1 / (1 + np.exp(-np.clip(log, -700, 700)))
    return prior, rate


def posterior(prior: float, rate: np.ndarray) -> Column:
    """Probability of a good document from its column `votes`."""
    log = F.lit(float(np.log(prior / (1 - prior))))
    for k, (bad, good) in enumerate(rate):
        letter = F.substring("votes", k + 1, 1)
        log = log + F.when(letter == BAD, float(np.log(good / bad))).when(
            letter == GOOD, float(np.log((1 - good) / (1 - bad)))).otherwise(0.0)
    return 1 / (1 + F.exp(-log))


def _judged(rows: DataFrame) -> DataFrame:
    """Stored rows with counts and votes → base_failed, posterior and kept too."""
    patterns = [(r.votes, r.n) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    n, repeats = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    judged = rows.withColumn("base_failed", (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n))
    judged = judged.withColumn("posterior", posterior(*estimate(sorted(patterns))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts (struct), votes, base_failed, posterior, kept.

    docs: doc_id and text; other columns are not looked at. Words are runs without ASCII white
    space. Null and empty texts have no words and fail the base rule. Repeated rows are each
    judged. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return _judged(stored(with_counts(docs.select("doc_id", "text")).withColumn("votes", votes()).drop("text"), "votes"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with all their columns, whatever their names."""
    prepare(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]
    counted = with_counts(docs.toDF(*plain).withColumn("text", F.col(text))).withColumn("votes", votes()).drop("text")
    return _judged(stored(counted, "docs_votes")).filter("kept").select(*plain).toDF(*docs.columns)
