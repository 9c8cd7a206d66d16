import numpy as np

from crawlspark.llm import pu_quality as pu
from crawlspark.llm.queries import op3_positive_unlabelled

SF = "/root/testdata/sf0.01"


def rows_of(spark, x, positive):
    df = spark.createDataFrame([(v.tolist(), int(p)) for v, p in zip(x, positive)], "x array<float>, positive int")
    return df.repartition(3)


def planted(seed=1, n=4000, prior=0.7):
    """Two classes in the first columns; 30 % of positives are known."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    x = np.zeros((n, pu.WIDTH), np.float32)
    x[:, :4] = rng.normal(size=(n, 4)) + np.where(y, 1.4, -1.4)[:, None]
    x[:, 4] = 3.0  # constant
    known = y & (rng.random(n) < 0.3)
    return x, y, known


def test_fit_on_planted_classes(spark):
    x, y, known = planted()
    known[:1200] = False  # unlabelled rows have the true share of positives
    positive = np.where(known, 1, np.where(np.arange(len(y)) < 1200, 0, -1))
    model = pu.fit(rows_of(spark, x, positive))
    assert abs(model.prior - y[:1200].mean()) < 0.1
    score = model.score(x)
    # 1200 unlabelled rows leave some noise in the prior and so in the threshold, little in the order
    assert ((score >= 0.5) == y).mean() > 0.9
    assert np.mean(score[y][:500, None] > score[~y][None, :500]) > 0.98


def test_risk_is_never_negative_in_its_second_part():
    sums = np.array([10, 10, 30.0, 40.0, 2.0])
    value, negative = pu.risk(0.9, sums)
    assert negative < 0 and np.isclose(value, 0.9 * (40 - 30) / 10)


def test_newton_reaches_the_minimum(spark):
    x, y, known = planted(2, 1500)
    positive = np.where(known, 1, 0)
    rows = rows_of(spark, x, positive).cache()
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-4, x.std(axis=0), 1)
    w = pu.minimise(rows, 0.5, mean, scale, np.zeros(pu.WIDTH + 1), passes=12)
    z = pu._scaled(x.astype(float), mean, scale)

    def value(w):
        g = z @ w
        p, u = positive == 1, positive == 0
        soft = np.logaddexp(0, g)
        return 0.5 * np.mean(soft[p] - g[p]) + max(0, soft[u].mean() - 0.5 * soft[p].mean()) + pu.RIDGE / 2 * w[1:] @ w[1:]

    rng = np.random.default_rng(3)
    best = value(w)
    assert all(value(w + d * rng.normal(size=len(w))) >= best - 1e-6 for d in (1e-3, 1e-2, 0.1) for _ in range(30))


def test_cases(spark):
    docs = spark.createDataFrame([(1, "Some words here.", 9), (2, None, 9), (3, "", 9), (3, "x" * 100000, 9), (None, "a", 9)], "doc_id bigint, text string, score int")
    ids = docs.select("doc_id")
    out = pu.classify(docs, ids.filter("doc_id = 1"), ids, ids.filter("doc_id = 3")).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = pu.classify(docs, ids.limit(0), ids, ids).collect()
    assert {r.score for r in none} == {0.5}
    assert pu.classify(docs.limit(0), ids, ids, ids).collect() == []
    assert not pu.features(None).any() and not pu.features("").any()


def test_held_out_quality(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op3_positive_unlabelled(spark, SF).filter("held_out").join(truth, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.9
