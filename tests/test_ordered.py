"""Buckets by quantiles, ranking and running sums over skewed, tied and all-distinct values."""

import random

import pytest
from assayframe.functions import probability as P
from assayframe.operators import metrics, ordered
from assayframe.sources.fixtures import METHODS
from pyspark.sql import functions as F


def brute(rows):
    """(AUROC, average precision) of (score, positive): ties count half, and form one threshold."""
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    if not pos:
        return None, None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    hits = sum(sum(q >= p for q in pos) / sum(s >= p for s, _ in rows) for p in pos)
    return (wins / (len(pos) * len(neg)) if neg else None), hits / len(pos)


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(1)
    out = [("distinct", rng.random() ** 9, rng.random() < 0.3) for _ in range(3000)]  # most of them near zero
    out += [("tied", rng.choice((0.0, 0.25, 0.25, 1.0)), rng.random() < 0.5) for _ in range(800)]
    out += [("half", 0.5 if i % 2 else rng.random(), rng.random() < 0.5) for i in range(1000)]
    return out + [("positive", 0.1, True), ("negative", 0.2, False), (None, 0.3, True), (None, 0.2, False)]


def test_ranking_against_pairs(spark, scores):
    rows = spark.createDataFrame([(g, s, p) for g, s, p in scores], "g string, s double, p boolean").repartition(5)
    for r in metrics.ranking(rows, ["g"], "s", F.col("p")).collect():
        auroc, precision = brute([(s, p) for g, s, p in scores if g == r.g])
        assert r.auroc == pytest.approx(auroc, abs=1e-12) and r.average_precision == pytest.approx(precision, abs=1e-12)


def test_no_bucket_is_large(spark):
    """Distinct values that crowd together, and one value in half of the rows."""
    n = 40_000
    rows = spark.range(n).select("id", F.exp(-F.col("id") / 100.0).alias("crowded"), F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / n).alias("half"))
    for value, tie in (("crowded", None), ("half", "id")):
        for down in (False, True):
            cut = ordered.bucketed(rows, F.col(value), tie and F.col(tie), down, buckets=256)
            sizes = [r["count"] for r in cut.groupBy("_bucket").count().collect()]
            assert sum(sizes) == n and max(sizes) <= 3 * n / 256 + n / 2 / (ordered.PARTS + 1), max(sizes)
            spans = cut.groupBy("_bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy("_bucket").collect()
            for a, b in zip(spans, spans[1:], strict=False):
                assert a.lo >= b.hi if down else a.hi <= b.lo


def test_running_over_a_shared_value(spark):
    rng = random.Random(2)
    data = [(rng.choice((None, "a", "b")), i, rng.choice((0.5, 0.5, 0.5, rng.random()))) for i in range(4000)]
    rows = spark.createDataFrame(data, "g string, id long, v double").repartition(6)
    cut = ordered.bucketed(rows, F.col("v"), F.col("id"), descending=True, buckets=64)
    got = ordered.running(cut, ["g"], F.col("_bucket"), [F.desc("v"), "id"], {"upto": F.col("id")}, totals=True).collect()
    want = {}
    for g in (None, "a", "b"):
        own = sorted(((i, v) for h, i, v in data if h == g), key=lambda r: (-r[1], r[0]))
        total = 0
        for k, (i, _) in enumerate(own, 1):
            total += i
            want[i] = (g, k, len(own), total, sum(j for j, _ in own))
    assert {r.id: (r.g, r.place, r["size"], r.upto, r.all_upto) for r in got} == want


def test_average_ranks_of_a_hot_score(spark):
    rng = random.Random(3)
    data = [(i, 0.5 if i % 2 else round(rng.random(), 2)) for i in range(3000)]
    got = {r.doc_id: r.avg_rank for r in metrics.average_ranks(spark.createDataFrame([("m", *d) for d in data], "method string, doc_id long, s double"), ["method"], "s").collect()}
    places = {}
    for k, (_, s) in enumerate(sorted(data, key=lambda d: d[1]), 1):
        places.setdefault(s, []).append(k)
    assert got == {i: sum(places[s]) / len(places[s]) for i, s in data}


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, id long, v double")
    cut = ordered.bucketed(none, F.col("v"), F.col("id"))
    assert ordered.running(cut, ["g"], F.col("_bucket"), ["v"], {}).count() == 0
    assert metrics.ranking(none, ["g"], "v", F.col("id") > 0).count() == 0


def test_opposite_margins_tie_as_in_sql(spark):
    """Confidences of every margin of the fixtures at every temperature: SQL's doubles decide which of two opposite margins round alike."""
    duckdb = pytest.importorskip("duckdb")
    p = P.sigmoid(F.col("m") / F.col("t"))
    grid = spark.range(-5700, 5701).select((F.col("id") / 500.0).alias("m"), F.explode(F.array(*(F.lit(t) for _, t in METHODS))).alias("t"))
    told = grid.select("m", "t", P.to_tie(P.confidence(p)).alias("c"), P.to_tie(1 - P.confidence(p)).alias("e")).toArrow()
    con = duckdb.connect()
    con.register("told", told)
    q = "SELECT *, 1 / (1 + exp(-m / t)) AS p FROM told"
    assert told.num_rows == 11_401 * len(METHODS)
    assert con.execute(f"SELECT m, t FROM ({q}) WHERE c <> round(greatest(p, 1 - p), 12) OR e <> round(1 - greatest(p, 1 - p), 12)").fetchall() == []
    far = spark.createDataFrame([(-800.0,), (-740.0,), (800.0,), (None,)], "m double").select(P.sigmoid(F.col("m")).alias("p")).collect()
    assert far[0].p == 0 and 0 < far[1].p < 1e-300 and far[2].p == 1 and far[3].p is None


def _border(spark):
    """Two opposite margins that SQL rounds to two confidences, the higher one with the greater id, and a lower one."""
    data = [(1, 2.996, 0), (2, -2.996, 0), (3, 1.0, 1)]
    rows = spark.createDataFrame([(i, q, "original", "baseline", 2.9551, m) for i, m, q in data], "doc_id long, quality int, condition string, method string, temperature double, margin double")
    return metrics.evaluate(rows)


def test_curve_by_scope_at_a_border_of_rounding(spark):
    got = metrics.risk_coverage(metrics.with_scope(_border(spark)), ["method", "scope"]).collect()
    assert {(r.scope, r.doc_id, r.retained, r.errors) for r in got} == {(s, *x) for s in ("overall", "original") for x in ((2, 1, 0), (1, 2, 1), (3, 3, 1))}


def test_thinned_curve_at_a_border_of_rounding(spark):
    got = metrics.thinned(metrics.risk_coverage(_border(spark), ["method"]), every=2).collect()
    assert {(r.doc_id, r.retained, r.errors) for r in got} == {(2, 1, 0), (1, 2, 1)}


def test_digits_as_in_sql(spark):
    """Quotients on a border of nine digits, both signs, large and special values."""
    duckdb = pytest.importorskip("duckdb")
    from assayframe.plans import catalog

    q = F.explode(F.array(*(F.col("id") / F.lit(k) for k in (1024, 5120, 25600, 128000)))).alias("x")
    grid = spark.range(25601).select(q).select(F.explode(F.array(F.col("x"), 1 - F.col("x"), -F.col("x"), F.col("x") * 1e12)).alias("x"))
    special = spark.createDataFrame([(1e300,), (-1e300,), (float("inf"),), (float("nan"),), (None,), (5e-324,)], "x double")
    rows = grid.unionByName(special)
    told = catalog.rounded(rows.select(F.col("x").cast("string").alias("s"), "x")).toArrow()
    con = duckdb.connect()
    con.register("told", told)
    assert told.num_rows == 4 * 4 * 25601 + 6
    assert con.execute("SELECT s, x FROM told WHERE x IS DISTINCT FROM round(CAST(s AS DOUBLE), 9)").fetchall() == []


def _risk_of_border(spark):
    """Of 5,120 rows 41 are wrong, so the last risk is 0.0080078125, which is 0.008007812 for doubles."""
    return spark.range(5120).select(
        F.col("id").alias("doc_id"), F.lit("baseline").alias("method"), F.lit("original").alias("condition"), F.lit(0.75).alias("conf_cal"), (F.col("id") >= 41).alias("correct")
    )


def test_risk_by_scope_on_a_border_of_nine_digits(spark):
    from assayframe.plans import catalog

    curve = metrics.risk_coverage(metrics.with_scope(_risk_of_border(spark)), ["method", "scope"])
    assert {r.scope: r.risk for r in catalog.rounded(curve).where("retained = 5120").collect()} == {"overall": 0.008007812, "original": 0.008007812}


def test_thinned_risk_on_a_border_of_nine_digits(spark):
    from assayframe.plans import catalog

    curve = metrics.thinned(metrics.risk_coverage(_risk_of_border(spark), ["method"]), every=5120)
    assert {r.retained: r.risk for r in catalog.rounded(curve).collect()} == {1: 1.0, 5120: 0.008007812}
