"""Score fusion, models, sequences, splits and reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.config import Settings
from wirelens.operators import models, scoring, sequence
from wirelens.operators.iforest import (IsolationForest, IsolationForestModel, forest_arrays,
                                        forest_score, grow_tree, path_constant, tree_draws)
from wirelens.plans import reports as rp
from wirelens.plans import scoring_job
from wirelens.sources import trace


def test_threat_score(spark):
    cases = [("BENIGN", 1.0, 0.0, 0.0, 0.0, "BENIGN"),
             ("BENIGN", 0.5, 0.5, 0.0, 22.5, "LOW RISK"),
             ("DoS", 0.9, 0.5, 0.0, 60.0, "MEDIUM RISK"),
             ("DoS", 0.9, 1.0, 0.0, 75.0, "HIGH RISK / ATTACK"),
             ("DoS", 1.0, 1.0, 1.0, 100.0, "HIGH RISK / ATTACK")]
    df = spark.createDataFrame(
        [(i, c, k, a, s) for i, (c, k, a, s, _, _) in enumerate(cases)],
        "i int, attack_type string, confidence double, anomaly_score double,"
        " sequence_score double")
    out = {r.i: r for r in scoring.threat_score(df).collect()}
    for i, (_, _, _, _, score, band) in enumerate(cases):
        assert (out[i].threat_score, out[i].risk_level) == (score, band)
    assert out[2].component_breakdown.classification == 90.0
    assert out[0].recommended_action.startswith("Normal traffic")
    strict = scoring.threat_score(df, cfg=Settings(band_threshold=20)).collect()
    assert strict[2].risk_level == "HIGH RISK / ATTACK"


def test_classify_and_fallback(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2], "DoS"), ([0.5, 0.5, 0.0], "Novel")],
                               "p array<double>, label string")
    out = scoring.classify(df, "p", ["BENIGN", "DoS", "Bot"]).collect()
    assert (out[0].attack_type, out[0].confidence, out[0].class_index) == ("DoS", 0.7, 1)
    assert out[0].all_probabilities == {"BENIGN": 0.1, "DoS": 0.7, "Bot": 0.2}
    assert out[1].attack_type == "BENIGN"
    hot = df.select(scoring.one_hot("label").alias("h")).collect()
    assert hot[0].h == [0, 1, 0, 0, 0, 0, 0, 0] and hot[1].h == [1, 0, 0, 0, 0, 0, 0, 0]
    x = spark.range(1).select(scoring.anomaly_score(None).alias("n"),
                              scoring.anomaly_score(F.lit(-0.7)).alias("hi"),
                              scoring.anomaly_score(F.lit(0.2)).alias("mid")).first()
    assert (x.n, x.hi) == (0.5, 1.0) and x.mid == pytest.approx(0.3)


def test_sequence_score(spark):
    var = [0.0, 0.02, 0.04, 0.01, 0.03, 0.05, 0.0]
    df = spark.createDataFrame([("a", i * 25_000_000, i, v) for i, v in enumerate(var)]
                               + [("b", 5, 100, 9.0), ("b", 6, 101, 9.0)],
                               "k string, ts long, id long, v double")
    out = {r.id: r.sequence_score for r in
           sequence.sequence_score(df, ["k"], "ts", "id", variance="v").collect()}
    assert out[0] == 0.0 and out[2] == pytest.approx(0.2)
    for i in range(1, 7):
        assert out[i] == pytest.approx(min(1.0, 10 * np.mean(var[max(0, i - 4):i + 1])))
    assert (out[100], out[101]) == (0.0, 1.0)


def test_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (0.0, None, 0.0)], "a double, b double, c double")
    out = [r.s for r in sequence.with_spread(df, "s", ["a", "b", "c"]).collect()]
    assert out == [pytest.approx(np.var([1, 2, 6])), 0.0]


@pytest.mark.parametrize("versus", ["first_row", "window_start"])
def test_sequence_windows(spark, versus):
    labels = ["x", "x", "x", "y", "x", "x", "x", "x"]
    df = spark.createDataFrame([(i * 40_000_000, i, [float(i)], c) for i, c in enumerate(labels)],
                               "ts long, id long, v array<double>, label string")
    out = sequence.sequence_windows(df, "ts", "id", "v", "label", 3, versus).collect()
    got = {r.start: ([x[0] for x in r.sequence], r.target) for r in out}
    want = {}
    for i in range(len(labels) - 3):
        base = labels[0] if versus == "first_row" else labels[i]
        want[i] = ([float(j) for j in range(i, i + 3)],
                   int(any(c != base for c in labels[i:i + 3])))
    assert got == want


def test_forest_traversal_matches_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    import pandas as pd
    cols = ["tree", "node", "feature", "threshold", "left", "right", "size"]
    trees = [grow_tree(x[rng.choice(200, 64, replace=False)], t, 1) for t in range(5)]
    nodes = pd.DataFrame([n for t in trees for n in t], columns=cols)
    got = forest_score(forest_arrays(nodes, 64), x)
    for row, value in zip(x, got, strict=True):
        total = 0.0
        for t in trees:
            at, depth = t[0], 0
            while at[2] >= 0:
                at = t[at[4] if row[at[2]] <= at[3] else at[5]]
                depth += 1
            total += depth + float(path_constant(at[6]))
        assert value == pytest.approx(-2 ** (-total / 5 / float(path_constant(64))))


@pytest.mark.parametrize("rows", [1, 20, 700])
def test_trees_draw_from_all_rows(spark, rows):
    """The rows of a tree are those with its least draws, whatever the table's size and layout."""
    forest = IsolationForest(trees=5, sample=64)
    df = spark.range(rows).repartition(9)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id", F.lit(forest.seed)).alias("k"))
            .collect()}
    ids = np.array(sorted(keys))
    packed = np.array([keys[i] for i in ids], dtype="int64").view("uint64")
    got = forest._drawn(df).collect()
    for tree in range(5):
        want = ids[np.argsort(tree_draws(packed, tree))[:64]]
        assert {r.id for r in got if r.tree == tree} == set(want.tolist())


def test_isolation_forest_finds_outliers(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(400)]
    rows += [(1000 + i, [9.0 + i, -9.0, 9.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    model = IsolationForest(trees=40).fit(df, "id", F.col("v"))
    again = IsolationForest(trees=40).fit(df.repartition(7), "id", F.col("v"))
    assert again.nodes.equals(model.nodes) and again.offset == model.offset
    scores = model.transform(df, F.col("v")).orderBy(F.desc("anomaly_score")).limit(4).collect()
    assert {r.id for r in scores} == {1000, 1001, 1002, 1003}
    flagged = df.filter(model.decision(spark, F.col("v")) < 0).count()
    assert abs(flagged - 0.1 * 404) <= 2
    model.save(spark, str(tmp_path / "m"))
    loaded = IsolationForestModel.load(spark, str(tmp_path / "m"))
    a = model.transform(df, F.col("v")).agg(F.sum("anomaly_score")).first()[0]
    b = loaded.transform(df, F.col("v")).agg(F.sum("anomaly_score")).first()[0]
    assert a == pytest.approx(b)


def test_classifier_split_and_report(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        c = ["BENIGN", "DoS", "Bot"][min(i % 10, 2) if i % 10 < 3 else 0]
        base = {"BENIGN": 0.0, "DoS": 4.0, "Bot": -4.0}[c]
        rows.append((i, c, [float(base + rng.normal()), float(rng.normal())]))
    df = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    split = models.stratified_split(df, "label", "id")
    sizes = {(r.label, r.is_train): r["count"] for r in
             split.groupBy("label", "is_train").count().collect()}
    assert sizes == {("BENIGN", True): 192, ("BENIGN", False): 48, ("DoS", True): 24,
                     ("DoS", False): 6, ("Bot", True): 24, ("Bot", False): 6}
    train = split.filter("is_train")
    for clf in (models.AttackClassifier(trees=15, depth=5),
                models.AttackClassifier(boosted=True, rounds=3, boost_depth=3)):
        model = clf.fit(train)
        assert model.classes == ["BENIGN", "Bot", "DoS"]
        out = model.transform(split.filter("NOT is_train"))
        report = {r["class"]: r for r in models.classification_report(
            out, prediction="attack_type").collect()}
        assert report["accuracy"].precision > 0.9 and report["accuracy"].support == 60
        sums = out.select(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s"))
        assert all(r.s == pytest.approx(1.0) for r in sums.collect())
        model.save(str(tmp_path / "clf"))
        loaded = models.AttackClassifierModel.load(spark, str(tmp_path / "clf"))
        assert loaded.classes == model.classes
        assert sorted(map(str, loaded.transform(split).select("id", "attack_type").collect())) == \
            sorted(map(str, model.transform(split).select("id", "attack_type").collect()))


@pytest.mark.parametrize("ranked", [100_000, 3])
def test_stratified_split_is_exact_and_moves_no_rows(spark, monkeypatch, ranked):
    monkeypatch.setattr(models, "_RANKED", ranked)
    df = spark.range(20_000).selectExpr(
        "id", "CASE WHEN id % 500 = 0 THEN NULL WHEN id % 7 = 0 THEN 'x' WHEN id = 3 THEN 'one' "
        "ELSE 'BENIGN' END AS label")
    split = models.stratified_split(df, "label", "id")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    sizes = {r.label: (r.t, r.n) for r in split.groupBy("label").agg(
        F.count_if("is_train").alias("t"), F.count("*").alias("n")).collect()}
    assert sizes == {k: (int(n * 0.8 + 0.5), n) for k, (_, n) in sizes.items()} and len(sizes) == 4
    first = {r.id for r in split.where("is_train").collect()}
    again = models.stratified_split(df.repartition(7), "label", "id")
    assert first == {r.id for r in again.where("is_train").collect()}
    other = models.stratified_split(df, "label", "id", seed=1).where("is_train").collect()
    assert first != {r.id for r in other}


def test_training_report_is_of_rows_the_model_has_not_seen(spark):
    from wirelens.plans.scoring_job import training_report

    # labels that follow from the vector, but for noise that only a model shown the row could know
    df = spark.range(600).selectExpr(
        "id", "array(double(id % 3), double(id)) AS vector",
        "IF(xxhash64(id) % 10 = 0, 'noise', concat('k', id % 3)) AS label")
    model, report = training_report(df, "id", "vector", classifier=models.AttackClassifier(40, 5))
    rows = {r["class"]: r for r in report.collect()}
    held = df.groupBy("label").count().collect()
    for r in held:
        assert rows[r.label].support == r["count"] - int(r["count"] * 0.8 + 0.5)
    assert model.classes == sorted(r.label for r in held)
    assert rows["k1"].recall > 0.9 and rows["noise"].recall < 0.3


def test_score_flows_end_to_end(spark, tmp_path):
    from wirelens.operators.features import feature_array, flow_features
    from wirelens.plans.catalog import stand_in_scores
    from wirelens.schemas import FLOWS

    packets = trace.packets(spark, "/root/testdata/sf0.001")
    rows = stand_in_scores(flow_features(packets)).select(
        "id", F.col("attack_type").alias("label"), feature_array().alias("vector"))
    fitted = scoring_job.train(rows, "id", "vector", forest=IsolationForest(trees=10),
                               classifier=models.AttackClassifier(trees=5, depth=4))
    fitted.save(spark, str(tmp_path / "m"))
    fitted = scoring_job.Models.load(spark, str(tmp_path / "m"))
    out = scoring_job.score_flows(packets, fitted)
    assert set(FLOWS.fieldNames()) <= set(out.columns)
    assert len(out.schema["features"].dataType.fields) == 55
    rows = out.collect()
    assert len(rows) == 157 and all(0 <= r.threat_score <= 100 for r in rows)
    assert all(r.dpi_result.http_host is None for r in rows)
    assert scoring_job.suspicious(out).count() == sum(r.anomaly_score >= 0.6 for r in rows)


def test_report_filters(spark):
    flows = spark.createDataFrame(
        [(i, 100.0 + i, f"10.0.0.{i}", "B", "TCP" if i % 2 else "UDP", "LOW RISK", 10.0 * i)
         for i in range(8)],
        "id long, timestamp double, src_ip string, dst_ip string, protocol string,"
        " risk_level string, threat_score double")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(rp.recent_flows(flows, limit=3)) == [7, 6, 5]
    assert ids(rp.recent_flows(flows, limit=3, offset=2, protocol="TCP")) == [3, 1]
    assert ids(rp.recent_flows(flows, src_ip="0.0.3", dst_ip="b")) == [3]
    assert ids(rp.recent_flows(flows, src_ip="", time_from=105.0, time_to=106.0)) == [6, 5]
    assert ids(rp.flows_page(flows, 2, size=3)) == [4, 3, 2]
    assert rp.average_threat(flows).first()[0] == 35.0
    assert rp.average_threat(flows.limit(0)).first()[0] == 0.0
    assert ids(rp.alerts_by_band(flows, "MEDIUM RISK").orderBy("id")) == [5, 6, 7]
    for bad in (lambda: rp.recent_flows(flows, limit=0), lambda: rp.recent_flows(flows, limit=1001),
                lambda: rp.recent_alerts(flows, layer="L4"),
                lambda: rp.traffic_timeseries(flows, 0.0, 1441)):
        with pytest.raises(ValueError):
            bad()


def test_minutes_are_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = spark.range(1).select(rp.utc_minute(F.lit(1_704_067_259_999_999)).alias("m")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out.m == "2024-01-01 00:00"


def test_isolation_scores_in_pieces_equal_a_walk_per_row(monkeypatch):
    """Rows are scored in pieces that fit a cache; a missing value fails every comparison."""
    import pandas as pd
    monkeypatch.setattr("wirelens.operators.iforest._SCORED_ROWS", 7)
    rng = np.random.default_rng(8)
    x = rng.random((50, 4))
    x[::9, 1] = np.nan
    grown = [grow_tree(rng.random((32, 4)), tree, 42) for tree in range(3)]
    nodes = pd.DataFrame([n for t in grown for n in t],
                         columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    def length(tree, row):
        at, steps = 0, 0
        while tree[at][2] >= 0:
            at, steps = tree[at][4 if row[tree[at][2]] <= tree[at][3] else 5], steps + 1
        return steps + float(path_constant(tree[at][6]))

    want = [-2 ** -(np.mean([length(t, row) for t in grown]) / float(path_constant(32))) for row in x]
    np.testing.assert_allclose(forest_score(forest_arrays(nodes, 32), x), want, rtol=1e-12)


def test_isolation_scores_of_short_rows_are_refused():
    import pandas as pd
    grown = grow_tree(np.random.default_rng(2).random((32, 4)), 0, 42)
    nodes = pd.DataFrame(grown, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])
    with pytest.raises(IndexError):
        forest_score(forest_arrays(nodes, 32), np.zeros((5, 2)))
