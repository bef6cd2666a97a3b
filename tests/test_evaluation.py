"""Scores, probes, plug-ins, written tables and fitted models against plain versions."""

import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele import config as C
from clientele.operators import metrics as M
from clientele.operators import ml as ML
from clientele.operators import profile as PR
from clientele.operators import scale as SC
from clientele.operators.probe import LabelProbe
from clientele.operators.ranking import factorize_ranking
from clientele.plans.context import Ctx
from clientele.sources import readers as R

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def factors(spark, key, n, rng, missing):
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(n) if i not in missing]
    return spark.createDataFrame(rows, f"{key} long, factors array<double>"), dict(rows)


@pytest.mark.parametrize("block", [2, 1024])
def test_blocked_scores_equal_the_plain_product(spark, monkeypatch, block):
    monkeypatch.setattr(ML, "SCORE_BLOCK", block)
    rng = random.Random(1)
    cf, c = factors(spark, "client_id", 7, rng, {2})
    itf, it = factors(spark, "item", 9, rng, {4, 5})
    clients = spark.createDataFrame([(i,) for i in range(8)] + [(3,)], "client_id long")
    targets = spark.createDataFrame([(i, i) for i in range(1, 9)], "item long, pos int")
    want = {}
    for i in range(8):
        known = [float(np.dot(c[i], it[j])) for j in range(1, 9) if j in it] if i in c else []
        for j in range(1, 9):
            want[i, j] = (float(np.dot(c[i], it[j])) if j in it else statistics.mean(known)) if i in c else 0.0
    got = {(r["client_id"], r["item"]): r["score"] for r in ML.propensity_scores(clients, cf, itf, targets).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = defaultdict(list)
    for r in ML.propensity_scores(clients, cf, itf, targets, best=3).collect():
        best[r["client_id"]].append(r["item"])
    for i in range(8):
        assert sorted(best[i]) == sorted(sorted(range(1, 9), key=lambda j: (-round(want[i, j], 9), j))[:3])


def test_categories_take_the_mean_of_their_items(spark):
    itf = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0]), (3, [9.0, 9.0])], "item long, factors array<double>")
    members = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 10)], "item long, category long")
    assert [tuple(r) for r in ML.aggregate_factors(itf, members, "category").collect()] == [(10, [2.0, 4.0])]


def newton(x, y, ridge):
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), g)
    return w


def test_probe_finds_the_optimum_of_every_label(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(200, 3)) * [1, 5, 0.2], np.ones(200)])
    emb = spark.createDataFrame([(i, v[:3].tolist()) for i, v in enumerate(x)], "client_id long, embedding array<double>")
    y = np.column_stack([x[:, 0] + rng.normal(size=200) > 0, x[:, 1] - rng.normal(size=200) > 1, np.zeros(200)]).astype(int)
    seen = rng.random((200, 3)) < 0.8  # clients may lack labels
    rows = [("a" if k else "b", i, 10 * k, int(y[i, k])) for i in range(200) for k in range(3) if seen[i, k]]
    targets = spark.createDataFrame([*rows, ("a", 999, 10, 1)], "task string, client_id long, item long, label int")
    probe = LabelProbe(targets, emb, ridge=0.01)
    first = probe.loss.copy()
    probe.run(3)
    middle = probe.loss.copy()
    probe.run(25)
    assert (middle < first).all() and (probe.loss <= middle).all()
    at = {key: k for k, key in enumerate(probe.labels)}
    for k in range(3):
        w = newton(x[seen[:, k]], y[seen[:, k], k], 0.01)
        assert probe.weights[at["a" if k else "b", 10 * k]] == pytest.approx(w, abs=1e-4)
    got = probe.score(targets, emb).collect()
    assert len(got) == len(rows)
    for r in got[::37]:
        assert r["score"] == pytest.approx(x[r["client_id"]] @ probe.weights[at[r["task"], r["item"]]])


def test_a_wrong_client_list_is_rejected(spark):
    from clientele.plans.q_eval import evaluate_profile
    ctx = Ctx(spark, SF)
    emb = ctx._vector_of(ctx.relevant_clients, "client_id", 0, "embedding")
    for wrong in (emb.where(F.col("client_id") != emb.first()["client_id"]), emb.unionByName(emb.limit(1))):
        with pytest.raises(ValueError, match=C.MSG_IDS_NOT_PERMUTATION):
            evaluate_profile(ctx, wrong)


def visits(spark, n=400, hot=0.4):
    rng = random.Random(2)
    rows = [(0 if rng.random() < hot else rng.randint(1, 9), T0 + timedelta(minutes=rng.randint(0, 20_000)), rng.randint(0, 30)) for _ in range(n)]
    return spark.createDataFrame(rows, "client_id long, timestamp timestamp_ntz, url long").repartition(6), rows


def test_mergeable_plugin_equals_the_whole_history(spark):
    ev, rows = visits(spark)
    calc = PR.mergeable_calculator(
        lambda pdf: [len(pdf), pdf["url"].max(), *sorted(pdf["url"].unique())],
        lambda a, b: [a[0] + b[0], max(a[1], b[1]), *sorted({*a[2:], *b[2:]})], lambda s: [s[0], s[1], float(len(s) - 2)], 3)
    out, width = calc(ev)
    by = defaultdict(list)
    for c, _, u in rows:
        by[c].append(u)
    assert width == 3
    assert {r["client_id"]: r["features"] for r in out.collect()} == {c: [len(u), max(u), len(set(u))] for c, u in by.items()}
    states = PR.mergeable_states(ev, lambda pdf: [len(pdf)], lambda a, b: [a[0] + b[0]], 86400)
    hot = states.where("client_id = 0").select(F.max(F.col("state")[0])).first()[0]
    assert hot < 0.2 * len(by[0])  # no state holds the client


def test_plugin_metric_merges_states(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else "t" + str(i % 2), float(i)) for i in range(50)], "task string, score double").repartition(4)
    got = M.plugin_metric(df, lambda p: [p["score"].sum(), len(p)], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: s[0] / s[1], ["task"])
    want = {k: statistics.mean(float(i) for i in range(50) if (None if i % 5 == 0 else "t" + str(i % 2)) == k) for k in (None, "t0", "t1")}
    assert {r["task"]: r["value"] for r in got.collect()} == pytest.approx(want)


def test_sequences_split_a_hot_client_and_keep_the_order(spark):
    rows = [(7, p, f"e{p}") for p in range(3000)] + [(c, p, "x") for c in range(20) if c != 7 for p in range(40)]
    seq = spark.createDataFrame(rows, "client_id long, pos int, event_type string").repartition(5)
    path = R.write_sequences(seq, "seq-test", n_parts=8)
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    sizes = [r["rows"] for r in manifest]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * statistics.median(sizes)
    assert all(a["last"] < b["first"] for a, b in zip(manifest, manifest[1:]))
    assert len(R.sequence_parts(spark, path, 7)) > 3
    assert [r["event_type"] for r in R.read_sequence(spark, path, 7).collect()] == [f"e{p}" for p in range(3000)]
    data = spark.read.parquet(f"{path}/data")
    for part in (0, 3):  # rows lie in order in a part's file
        got = [(r["client_id"], r["pos"]) for r in data.where(F.col("part") == part).coalesce(1).collect()]
        assert got == sorted(got)


def test_reused_tables_follow_their_inputs(spark, tmp_path):
    src, calls = str(tmp_path / "in"), []
    name = "once-" + tmp_path.name

    def compute():
        calls.append(1)
        return spark.read.parquet(src).select((F.col("id") * 2).alias("x"))

    spark.range(5).write.parquet(src)
    with pytest.raises(FileNotFoundError):
        R.materialize_once(spark, name, None)
    first = sorted(r["x"] for r in R.materialize_once(spark, name, compute).collect())
    again = R.materialize_once(spark, name, compute)
    assert first == [0, 2, 4, 6, 8] and again.inputFiles() == R.materialize_once(spark, name, None).inputFiles()
    spark.range(5, 7).write.mode("append").parquet(src)
    assert R.materialize_once(spark, name, compute).count() == 7

    def second_writer():  # publishes while the first is computing
        if len(calls) < 10:
            calls.extend([0] * 10)
            R.materialize_once(spark, name, second_writer)
        return spark.read.parquet(src).select("id")

    spark.range(9).write.mode("overwrite").parquet(src)
    both = R.materialize_once(spark, name, second_writer)
    base = both.inputFiles()[0].rsplit("/", 2)[0]
    assert both.count() == 9 and both.inputFiles() == R.materialize_once(spark, name, None).inputFiles()
    jpath, fs = R._fs(spark, base)
    folders = [s.getPath().getName() for s in fs.listStatus(jpath)]
    assert sum(f.startswith("data-") for f in folders) == 3 and not any(f.endswith(".tmp") for f in folders)


def test_clusters_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 255)) / 7 for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "sku long, embedding array<double>")
    found = [{r["sku"]: (r["cluster_id"], tuple(r["centroid"])) for r in ML.kmeans_clusters(d, "sku", k=6, max_iter=5).collect()}
             for d in (df.repartition(1), df.orderBy(F.desc("sku")).repartition(40))]
    assert found[0] == found[1] and len({c for c, _ in found[0].values()}) == 6
    few = ML.kmeans_clusters(df.limit(3), "sku", k=6, max_iter=2)
    assert few.count() == 3 and few.select("cluster_id").distinct().count() == 3
    assert ML.kmeans_clusters(df.where("false"), "sku", k=6).count() == 0


def test_lambda_beyond_the_first_grid(spark):
    rng = np.random.default_rng(5)
    x = {"a": rng.exponential(0.01, 300), "b": -rng.exponential(0.02, 300), "c": rng.normal(3, 1, 300), "d": np.ones(300)}
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*x.values())], "a double, b double, c double, d double")

    def loglik(v, lam):
        up = v >= 0
        with np.errstate(all="ignore"):
            psi = np.where(up, (np.power(np.abs(v) + 1, lam) - 1) / lam if lam else np.log1p(np.abs(v)),
                           -(np.power(np.abs(v) + 1, 2 - lam) - 1) / (2 - lam) if lam != 2 else -np.log1p(np.abs(v)))
        return -len(v) / 2 * np.log(psi.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    found = SC.fit_yeo_lambdas(df, list(x))
    assert found["d"] == 1.0 and found["a"] < -20 and found["b"] > 20
    for c in "abc":
        near = [loglik(x[c], found[c] + d) for d in (-0.02, 0.0, 0.02)]
        far = [loglik(x[c], found[c] + d) for d in (-5.1, 5.1)]
        assert near[1] >= max(near) - 1e-6 and max(far) < near[1]


@pytest.mark.parametrize("block_rows", [250_000, 60])
def test_ranking_factors_order_held_out_items(spark, block_rows):
    rng = random.Random(3)
    rows, held = [], []
    for c in range(120):
        for i in range(40):
            liked = rng.random() < (0.5 if i % 2 == c % 2 else 0.04)
            (rows if rng.random() < 0.6 else held).append((c, i, 1.0 if liked else 0.0))
    w = spark.createDataFrame([r for r in rows if r[2]], "client_id long, item long, weight double")
    t = spark.createDataFrame([(c, i, int(x)) for c, i, x in held], "client_id long, item long, label int")
    cf, itf = factorize_ranking(w, rank=4, block_rows=block_rows)
    scores = ML.propensity_scores(t.select("client_id"), cf, itf, t.select("item").distinct())
    assert M.auc_per_client(scores.join(t, ["client_id", "item"])).first()["auc"] > 0.7
