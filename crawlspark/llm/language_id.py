"""Language identification by compression: the dictionary that makes a text smallest wins."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare

# documents per language drawn for the dictionaries, and bytes kept of their texts together: an even share of each
SAMPLE_DOCS = 96
DICTIONARY_BYTES = 112_000
LEVEL = 6
# a short text needs matches of three bytes, which only the slow levels look for
SHORT_BYTES = 512
SHORT_LEVEL = 19
# a text is compressed in blocks so that it cannot become its own dictionary
BLOCK_BYTES = 2048
MIN_MARGIN = 0.02
UNKNOWN = "und"


def learning_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Texts by language of at most `sample_docs` documents each: those with the smallest hashes.

    Rows with a null id, text or language are not learned from. Only ids are ranked; the texts of
    the chosen ones are read afterwards.
    """
    known = docs.filter("doc_id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs)
    chosen = known.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    # languages by how many documents they have, so that ties go to the more common one
    counts = known.groupBy("lang").count().collect()
    out: dict[str, list[str]] = {r.lang: [] for r in sorted(counts, key=lambda r: (-r["count"], r.lang))}
    # rows that share an id are one: the smallest text
    once = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    for r in sorted(once.select("doc_id", "lang", "text").collect()):
        out[r.lang].append(r.text)
    return out


def dictionaries(sample: dict[str, list[str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionary per language: an even share of each sampled text, lower-cased."""
    out = {}
    for lang, texts in sample.items():
        texts = [t.lower().encode() for t in sorted(texts, key=len)]
        raw, left = [], size
        for k, t in enumerate(texts):
            share = left // (len(texts) - k)
            raw.append(t[:share])
            left -= len(raw[-1])
        out[lang] = b"\n".join(raw)
    return out


class Sizes:
    """Compressed size of texts under each dictionary."""

    def __init__(self, raw: dict[str, bytes], block: int = BLOCK_BYTES):
        self.langs, self.block = list(raw), block
        self.long, self.short = ([self._with(data, level) for data in raw.values()] for level in (LEVEL, SHORT_LEVEL))

    @staticmethod
    def _with(data: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level)
        return zstandard.ZstdCompressor(
            dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i: i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in (self.long if len(raw) > SHORT_BYTES else self.short)]


def decide(langs: list[str], sizes: list[int]) -> tuple[str, float, float]:
    """(language, score, margin): the smallest size wins, ties go to the earlier, more common language.

    score treats a compressed byte as evidence, tempered as bytes of one text are not independent.
    margin is how much smaller the winner is than the next, as a share of the next.
    """
    best = min(range(len(langs)), key=lambda k: sizes[k])
    others = [s for k, s in enumerate(sizes) if k != best]
    margin = (min(others) - sizes[best]) / max(1, min(others)) if others else 1.0
    weight = sum(2.0 ** (-(s - sizes[best]) / 2) for s in sizes)
    return langs[best], 1 / weight, margin


def identify(docs: DataFrame, learn: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents' doc_id with lang_pred, score, margin, rejected.

    docs: doc_id and text; learn: doc_id, text, lang. Whole texts are compressed. `und` (score 0)
    if text is null or has no letter, or nothing was learned. `rejected` is true where the margin
    is under `min_margin`: lang_pred is then a best guess that a caller should not rely on.
    Repeated rows are each judged; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    raw = dictionaries(learning_sample(learn))
    made: list[Sizes] = []

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Sizes(raw))
        rows = []
        for t in texts:
            if not raw or t is None or not any(map(str.isalpha, t)):
                rows.append((UNKNOWN, 0.0, 0.0))
            else:
                rows.append(decide(made[0].langs, made[0].of(t)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "margin"])

    return docs.select("doc_id", judged(F.col("text").cast("string")).alias("j")).select(
        "doc_id", "j.lang_pred", "j.score", "j.margin", (F.col("j.margin") < min_margin).alias("rejected"))
