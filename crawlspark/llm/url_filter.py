"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

Everything is DataFrame expressions and Spark's own regression; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare

# (host, path prefix, verdict); a rule holds for the host and all its subdomains
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# a small labelled table: 1 is to be blocked
LABELLED = tuple((url, 1) for url in (
    "http://casino-win.example.com/en/1", "http://m.casino-win.example.org/de/22", "https://best-casino.test/play",
    "https://www.casino-bonus.test/en/slots", "http://online-casino.test/fr/88", "https://free-bets.example.com/en/5",
    "https://m.free-bets.example.net/en/17.html", "http://free-bets.example.org/fr/3", "http://bet-now.test/odds",
    "https://www.sports-bets.test/live", "https://cheap-pills.example.com/en/7", "http://www.cheap-pills.example.org/en/9/",
    "http://blog.cheap-pills.example.net/es/31", "https://buy-pills.test/shop", "http://pills-online.test/order",
    "https://ads-track.example.com/en/2", "http://m.ads-track.example.org/en/415", "https://blog.ads-track.example.net/de/6",
    "http://ad-tracker.test/pixel", "https://track-ads.test/click?id=1", "https://spam-farm.example.org/en/728",
    "http://www.spam-farm.example.com/fr/11", "http://m.spam-farm.example.net/en/64#top", "https://spam-links.test/seo",
    "https://link-farm.test/buy-links", "https://adult-x.example.net/en/19", "http://blog.adult-x.example.org/es/44",
    "https://m.adult-x.example.com/en/8", "http://xxx-adult.test/video", "https://adult-cams.test/live",
    "http://win-money.test/free", "https://free-slots.test/casino", "https://poker-bonus.test/en/4", "http://cheap-loans.test/apply",
)) + tuple((url, 0) for url in (
    "http://ththre.example.com/fr/825", "https://m.ththth.example.net/en/25", "https://thther.example.org/en/685",
    "http://therha.example.com/en/676", "https://therin.example.net/en/770", "https://blog.tiontion.example.com/en/853/",
    "http://blog.ththan.example.net/en/960", "https://m.therou.example.com/en/474.html", "https://ththin.example.com/en/671",
    "https://blog.tionsh.example.net/es/533/", "https://www.tionble.example.org/de/12", "http://m.thon.example.org/en/90",
    "https://www.anthe.example.net/fr/7", "http://erin.example.org/de/301", "https://library.test/catalog/1",
    "https://www.city-museum.test/en/visit", "http://news.test/2024/05/report", "https://docs.test/guide/intro",
    "https://university.test/research/papers", "http://recipes.test/soup", "https://weather.test/en/today",
    "https://blog.garden.test/spring", "https://www.school.test/de/kurse", "http://m.travel.test/es/rutas",
    "https://science.test/articles/17", "https://www.history.test/fr/archives", "http://forum.test/thread/99",
    "https://music.test/albums/3", "https://maps.test/en/route", "http://books.test/en/44.html",
    "https://www.health-info.test/en/sleep", "https://code.test/project/readme", "http://art.test/en/gallery", "https://en.wiki.test/page",
))

GRAMS = (3, 4)
FEATURES = 1 << 16
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    rules: a short list held in the plan; a rule's length is that of host and path together. Of
    equally long rules the first in the list wins.
    """
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: Column, path: Column, sizes=GRAMS) -> Column:
    """Character n-grams of host and path, marked by where they come from."""
    def of(mark: str, text: Column) -> Column:
        ends = F.concat(F.lit("^"), text, F.lit("$"))

        def of_size(n: int) -> Column:
            starts = F.when(F.length(ends) >= n, F.sequence(F.lit(1), F.length(ends) - (n - 1))).otherwise(
                F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(ends, i, F.lit(n))))

        return F.flatten(F.array(*[of_size(n) for n in sizes]))

    return F.concat(of("h", host), of("p", path))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(
        df.withColumn("grams", grams(F.col("host"), F.col("path"))))


def train(spark: SparkSession, labelled=LABELLED) -> LogisticRegressionModel:
    """The regression on a small labelled table of (url, 0 or 1), 1 meaning block."""
    rows = spark.createDataFrame(list(labelled), "url string, label double").coalesce(1) if not isinstance(labelled, DataFrame) else labelled
    parts = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double"))
    return LogisticRegression(maxIter=50, regParam=0.01, elasticNetParam=0.0).fit(_features(parts).select("features", "label"))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    pages: page_id and url; other columns are not looked at. verdict is that of the longest rule
    that fits; where none fits (rule is null) the regression decides: block if block_score, its
    probability, is at least `threshold`. A null url or one without `://` has empty host and path,
    no rule, and is judged by the regression on those. Repeated rows are each judged; an empty
    table gives an empty result.
    """
    model = train(prepare(pages.sparkSession), [(u, float(y)) for u, y in labelled])
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.setProbabilityCol("probability").transform(_features(parts))
    return scored.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "block_score", vector_to_array("probability")[1]).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "block_score")
