"""Unit tests on literal fixtures (FIXTURES.md section 3) and property checks."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from clientele.functions.scalars import conversion_ratio
from clientele.functions.vectors import parse_vector_lenient, parse_vector_strict
from clientele.operators import entropy as E
from clientele.operators import joins as J
from clientele.operators import metrics as M
from clientele.operators import ml as ML
from clientele.operators import scale as SC
from clientele.operators import sessions as S
from clientele.operators import validate as V
from clientele.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def ts(s):
    return T0 + dt.timedelta(seconds=s)


def test_sessions_threshold_fixture(spark):
    offs = [0, 1200, 2400, 2401, 4801, 4802, 9000]
    df = spark.createDataFrame([(1, ts(o), i) for i, o in enumerate(offs)],
                               "client_id long, timestamp timestamp_ntz, url long")
    sess = S.sessionize(df, 2400)
    # session key = position of the session's first event
    assert [r["session"] for r in sess.orderBy("timestamp").collect()] == [1, 1, 1, 4, 4, 6, 7]
    got = [r["session"] for r in S.number_sessions(sess).orderBy("timestamp").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 4]


def test_sessions_match_loop_random(spark):
    rng = random.Random(7)
    rows, T = [], 100
    for c in range(5):
        t = 0
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250, 3 * 86400])
            rows.append((c, ts(t)))
    df = spark.createDataFrame(rows, "client_id long, timestamp timestamp_ntz").dropDuplicates()
    out = S.number_sessions(S.sessionize(df, T, bucket_s=3600, heavy_rows=0)).collect()
    light = {(r["client_id"], r["timestamp"]): r["session"] for r in
             S.number_sessions(S.sessionize(df, T)).collect()}
    assert light == {(r["client_id"], r["timestamp"]): r["session"] for r in out}
    got = {(r["client_id"], r["timestamp"]): r["session"] for r in out}
    by_c = {}
    for c, t in sorted(set(rows)):
        by_c.setdefault(c, []).append(t)
    for c, tl in by_c.items():
        total, sess, prev = 0, 1, None
        for t in tl:
            if prev is not None:
                g = int((t - prev).total_seconds())
                if total + g > T:
                    sess, total = sess + 1, 0
                else:
                    total += g
            assert got[(c, t)] == sess
            prev = t
    # invariant: session length ≤ threshold (whole-second gaps)
    coll = S.session_collapse(S.sessionize(df, T), "timestamp").collect()
    assert all(r["time_diff"] <= T for r in coll)


def test_conversion_fixture(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (1, 4), (4, 2)], "b long, a long")
    got = [r[0] for r in df.select(conversion_ratio("b", "a")).collect()]
    assert got == [0.0, 1.0, 0.25, 2.0]


def test_vector_text(spark):
    ok = spark.createDataFrame([("[11 2 3]",), ("[ 1  2 ]",), ("[]",)], "t string")
    assert [r[0] for r in ok.select(parse_vector_strict("t")).collect()] == [[11, 2, 3], [1, 2], []]
    for bad in ["[1,2]", "1 2", "[-1]", "[a]"]:
        df = spark.createDataFrame([(bad,)], "t string")
        with pytest.raises(Exception):
            df.select(parse_vector_strict("t")).collect()
        assert df.select(parse_vector_strict("t", raise_on_error=False)).first()[0] is None
    len_df = spark.createDataFrame([("[1, 2]",), ("[a]",), ("[3 4]",)], "t string")
    assert [r[0] for r in len_df.select(parse_vector_lenient("t")).collect()] == [[1, 2], None, [3, 4]]


def test_asof_fixture(spark):
    sess = spark.createDataFrame([(1, ts(100), 50, 7), (1, ts(200), 60, 8)],
                                 "client_id long, session_start timestamp_ntz, time_diff long, url long")
    ev = spark.createDataFrame([(1, ts(t)) for t in [100, 150, 151, 200, 260, 261]] + [(2, ts(100))],
                               "client_id long, timestamp timestamp_ntz")
    # tolerance 0: extended ends are 150 and 260
    m = S.asof_session(ev, sess, tolerance_s=0, carry=["url"], bucket_s=120, heavy_rows=0).collect()
    m2 = S.asof_session(ev, sess, tolerance_s=0, carry=["url"]).collect()
    assert sorted(map(tuple, m)) == sorted(map(tuple, m2))
    got = sorted((r["client_id"], (r["timestamp"] - T0).seconds, (r["session_start"] - T0).seconds) for r in m)
    assert got == [(1, 100, 100), (1, 150, 100), (1, 200, 200), (1, 260, 200)]


def test_entropy_fixture(spark):
    one = spark.createDataFrame([(1, 10)] * 3, "client_id long, sku long")
    h = E.key_entropy(one, "sku", "h").first()["h"]
    p = 0.999999
    assert abs(h - (-p * math.log2(p + 1e-9))) < 1e-12
    two = spark.createDataFrame([(1, 10), (2, 10)], "client_id long, sku long")
    assert abs(E.key_entropy(two, "sku", "h").first()["h"] - 1.0) < 1e-6
    # entropy is never negative
    rows = [(random.Random(i).randint(1, 5), random.Random(i + 99).randint(1, 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "client_id long, sku long")
    assert all(r["h"] >= 0 for r in E.client_entropy(df, "sku", "h").collect())


def test_scaling_fixture(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (float("nan"), 5.0), (3.0, 5.0)], "x double, c double")
    out = SC.scale_minmax(df, ["x", "c"]).collect()
    xs = [r["x"] for r in out]
    assert xs[0] == -1.0 and xs[1] == 0.0 and math.isnan(xs[2]) and xs[3] == 1.0
    assert all(r["c"] == -1.0 for r in out)
    lg = SC.scale_log(df, ["x"]).collect()
    vals = [r["x"] for r in lg if not math.isnan(r["x"])]
    assert min(vals) == -1.0 and max(vals) == 1.0


def test_yeo_bounds(spark):
    rows = [(float(x),) for x in [0, 0, 1, 1, 1, 2, 3, 5, 8, 13, 40, 100]]
    df = spark.createDataFrame(rows, "x double")
    lam = SC.fit_yeo_lambdas(df, ["x"])["x"]
    assert -4.5 < lam < 4.5
    out = [r["x"] for r in SC.scale_yeo(df, ["x"], {"x": lam}).collect()]
    assert min(out) == pytest.approx(-1.0) and max(out) == pytest.approx(1.0)


def test_yeo_lambda_has_no_bounds(spark):
    """Skewed columns whose likelihood peaks far below -4, against a fine grid in numpy."""
    import numpy as np
    rng = np.random.default_rng(1)
    cols = {"z": np.where(rng.random(2000) < 0.9, 0, rng.geometric(0.5, 2000)).astype(float), "b": rng.beta(1, 9, 2000)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in cols.values()])), "z double, b double")
    found = SC.fit_yeo_lambdas(df, ["z", "b"])
    for c, v in cols.items():
        grid = np.arange(-30, -1, 0.01)
        ll = [-len(v) / 2 * np.log(np.var(((v + 1) ** g - 1) / g)) + (g - 1) * np.log1p(v).sum() for g in grid]
        assert found[c] == pytest.approx(grid[int(np.argmax(ll))], abs=0.03) and found[c] < -4.5


def _emb(spark, rows, schema="client_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def test_validator_cascade(spark):
    rel = spark.createDataFrame([(1,), (2,)], "client_id long")
    good = _emb(spark, [(1, [0.1, 0.2]), (2, [0.3, 0.4])])
    assert V.validation_report(good, rel).count() == 0
    cases = {
        "duplicate": (_emb(spark, [(1, [0.1]), (1, [0.2])]), "client ids are not a permutation of relevant clients"),
        "missing": (_emb(spark, [(1, [0.1])]), "client ids are not a permutation of relevant clients"),
        "wide": (_emb(spark, [(1, [0.0] * 2049), (2, [0.0] * 2049)]),
                 "maximum embeddings dimensionality i.e. 2048 has been exceeded"),
        "nan": (_emb(spark, [(1, [float("nan")]), (2, [0.0])]), "embeddings should not contain nans"),
        "inf": (_emb(spark, [(1, [float("inf")]), (2, [0.0])]), "embeddings should not contain infs"),
        "range": (_emb(spark, [(1, [70000.0]), (2, [0.0])]), "embeddings dtype should be float16 instead got values outside the float16 range"),
    }
    for name, (df, msg) in cases.items():
        rep = [r["message"] for r in V.validation_report(df, rel).collect()]
        assert rep and rep[0] == msg, name


def test_hybrid_concat(spark):
    a = _emb(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])])
    b = _emb(spark, [(1, [5.0, 6.0, 7.0]), (2, [8.0, 9.0, 1.0])])
    out = ML.concat_embeddings([a, b], expected_width=5).orderBy("client_id").collect()
    assert [len(r["embedding"]) for r in out] == [5, 5]
    c = _emb(spark, [(1, [5.0, 6.0, 7.0]), (3, [8.0, 9.0, 1.0])])
    with pytest.raises(Exception):
        ML.concat_embeddings([a, c]).collect()
    with pytest.raises(Exception):
        J.align_embeddings(a, c).collect()
    bl = ML.blend_embeddings(a, a.select("client_id", F.transform("embedding", lambda x: x * 2).alias("embedding")))
    assert bl.orderBy("client_id").first()["embedding"] == pytest.approx([1.3, 2.6])


def test_best_epoch_guard(spark):
    m = spark.createDataFrame([("churn", 0, 0.5), ("churn", 1, 0.7), ("churn", 2, 0.7)],
                              "task string, epoch int, weighted_metric double")
    r = W.best_epoch(m, n_epochs=3).first()
    assert (r["best_epoch"], r["best_score"]) == (1, 0.7)
    with pytest.raises(Exception):
        W.best_epoch(m, n_epochs=4).collect()


def test_properties_checked(spark):
    ev = spark.createDataFrame([(1, 10)], "client_id long, sku long")
    dup = spark.createDataFrame([(10, 1), (10, 2)], "sku long, category long")
    with pytest.raises(ValueError):
        J.join_properties_checked(ev, dup)
    miss = spark.createDataFrame([(11, 1)], "sku long, category long")
    with pytest.raises(Exception):
        J.join_properties_checked(ev, miss).collect()


def test_auroc_matches_all_pairs(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([0.1, 0.2, 0.2, 0.5, 0.9])), rng.randint(0, 1))
            for g in range(4) for _ in range(30)]
    df = spark.createDataFrame(rows, "g long, score double, label int")
    got = {r["g"]: r["auroc"] for r in M.auroc(df, ["g"], n_buckets=4).collect()}
    for g in range(4):
        pos = [s for gg, s, l in rows if gg == g and l == 1]
        neg = [s for gg, s, l in rows if gg == g and l == 0]
        exp = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
        assert got[g] == pytest.approx(exp / (len(pos) * len(neg)))
    one = M.auroc(df.select("score", "label")).first()["auroc"]
    pos = [s for _, s, l in rows if l == 1]
    neg = [s for _, s, l in rows if l == 0]
    exp = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    assert one == pytest.approx(exp / (len(pos) * len(neg)))


def test_contiguous_index(spark):
    ids = spark.createDataFrame([(x,) for x in [5, 3, 3, 10**12, 7, -2]], "id long")
    got = {r["id"]: r["idx"] for r in J.contiguous_index(ids, "id").collect()}
    assert got == {-2: 0, 3: 1, 5: 2, 7: 3, 10**12: 4}


def test_nearest_centroid_property(spark):
    rng = random.Random(1)
    cents = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(5)],
                                  "cluster_id long, centroid array<double>")
    vecs = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(40)],
                                 "id long, embedding array<double>")
    c = {r["cluster_id"]: r["centroid"] for r in cents.collect()}
    for r in ML.nearest_centroid(vecs, cents).collect():
        d = {k: sum((a - b) ** 2 for a, b in zip(r["embedding"], v)) for k, v in c.items()}
        assert r["cluster_id"] == min(d, key=lambda k: (d[k], k))


def test_propensity_score_rules(spark):
    clients = spark.createDataFrame([(1,), (2,)], "client_id long")
    cf = spark.createDataFrame([(1, [1.0, 2.0])], "client_id long, factors array<float>")
    itf = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0])], "item long, factors array<float>")
    tg = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "item long, pos int")
    got = {(r["client_id"], r["item"]): r["score"] for r in ML.propensity_scores(clients, cf, itf, tg).collect()}
    assert got[(1, 10)] == 1.0 and got[(1, 20)] == 2.0 and got[(1, 30)] == 1.5
    assert got[(2, 10)] == 0.0 and got[(2, 30)] == 0.0
    known = ML.propensity_scores(clients, cf, itf, tg, known_only=True)
    assert known.select("client_id").distinct().count() == 1


def test_client_sequences_order(spark):
    rows = [(1, ts(t)) for t in [5, 1, 3, 90000, 2]] + [(2, ts(7))]
    df = spark.createDataFrame(rows, "client_id long, timestamp timestamp_ntz")
    out = S.client_time_scan(df, bucket_s=60, heavy_rows=0).collect()
    got = sorted((r["client_id"], r["_rn"], (r["timestamp"] - T0).seconds + (r["timestamp"] - T0).days * 86400) for r in out)
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 5), (1, 5, 90000), (2, 1, 7)]


def test_parallel_island_split_matches_loop(spark):
    """The pointer-doubling path (forced with huge_island_rows=0) equals the sequential rule."""
    rng = random.Random(11)
    rows, T = [], 100
    for c in range(4):
        t = 0
        for _ in range(rng.randint(1, 60)):
            t += rng.choice([0, 1, 7, 30, 55, 99, 100, 101, 3 * 86400])
            rows.append((c, ts(t)))
    df = spark.createDataFrame(sorted(set(rows)), "client_id long, timestamp timestamp_ntz")
    par = {(r["client_id"], r["timestamp"]): r["session"] for r in
           S.sessionize(df, T, huge_island_rows=0, heavy_rows=0, bucket_s=600).collect()}
    seq = {(r["client_id"], r["timestamp"]): r["session"] for r in S.sessionize(df, T).collect()}
    assert par == seq


def test_gaps_ignore_session_time_zone(spark):
    """Wall-clock gaps of time-zone-free timestamps do not change with the session zone."""
    from clientele.functions.scalars import whole_seconds_between
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30))],
                               "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = df.select(whole_seconds_between("a", "b")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ny == 7200 == df.select(whole_seconds_between("a", "b")).first()[0]


def test_statistics_aggregate_the_events_once(spark, tmp_path):
    from clientele.operators import product_stats as PS
    from clientele.plans.pipelines import PRODUCT_ENTROPY_SPECS
    rows = [(s % 5 or None, s % 3, "product_buy" if s % 2 else "add_to_cart", s % 2, s % 4) for s in range(40)]
    spark.createDataFrame(rows, "sku long, client_id long, event_type string, category long, cluster_id long").write.parquet(f"{tmp_path}/ev")
    out = PS.attach_statistics(spark.read.parquet(f"{tmp_path}/ev"), with_clusters=True, entropy_specs=PRODUCT_ENTROPY_SPECS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "event_type#" in line for line in plan.splitlines()) == 1  # the join back
    buys = [r[0] for r in rows if r[2] == "product_buy"]
    assert all(r["count_buy"] == (buys.count(r["sku"]) if r["sku"] else None) for r in out.collect())


def test_pad_never_truncates(spark):
    from clientele.operators import encode as EN
    seq = spark.createDataFrame([(1, p, [1.0, 0.0]) for p in range(4)] + [(2, 0, [0.0, 1.0])],
                                "client_id long, pos int, vec array<double>")
    out = EN.pad_sequences(seq, "vec", length=2)
    counts = {r["client_id"]: r["n"] for r in out.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {1: 4, 2: 2}
    lengths = {r["client_id"]: r["length"] for r in EN.sequence_length(out, "vec").collect()}
    assert lengths == {1: 4, 2: 1}


def test_padded_steps_are_not_broadcast(spark):
    from clientele.operators import encode as EN
    seq = spark.createDataFrame([(c, p, [float(c), 1.0]) for c in range(5) for p in range(c + 1)], "client_id long, pos int, vec array<double>")
    out = EN.masked_mean_pool(EN.pad_sequences(seq, "vec"), "vec")
    assert {(r["client_id"], r["pos"]): r["value"] for r in out.collect()} == {(c, i): v for c in range(5) for i, v in ((0, float(c)), (1, 1.0))}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def _plain_sessions(rows, threshold):
    """Sessions per client by a loop over the sorted times; null is a client."""
    out = {}
    for c in {r[0] for r in rows}:
        times = sorted(r[1] for r in rows if r[0] == c)
        start, total, sizes = None, 0, []
        for a, b in zip([None, *times], times):
            gap = 0 if a is None else int((b - a).total_seconds())
            if a is None or gap > threshold or total + gap > threshold:
                sizes.append(0)
                total = 0
            else:
                total += gap
            sizes[-1] += 1
        out[c] = sizes
    return out


@pytest.mark.parametrize("heavy,huge,bucket", [(10**6, 10**6, 3600), (5, 10**6, 600), (5, 4, 600), (0, 10**6, 60)])
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_sessions_with_ties_and_null_clients(spark, heavy, huge, bucket, broadcast):
    import datetime as dt
    import random

    from clientele.operators.sessions import prev_event_gap, sessionize
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, 3, None]), t0 + dt.timedelta(seconds=600 * rng.randint(0, 60)), i) for i in range(240)]
    df = spark.createDataFrame(rows, "client_id long, timestamp timestamp, k long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = sessionize(df, 2400, bucket_s=bucket, heavy_rows=heavy, huge_island_rows=huge).collect()
        gaps = prev_event_gap(df, bucket_s=bucket, heavy_rows=heavy).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows) == gaps
    for c, sizes in _plain_sessions(rows, 2400).items():
        of = {}
        for r in got:
            if r.client_id == c:
                of[r.session] = of.get(r.session, 0) + 1
        assert [of[s] for s in sorted(of)] == sizes


def test_top_values_skip_null(spark):
    from clientele.operators.profile import top_values
    df = spark.createDataFrame([(None,), (None,), (None,), (4,), (4,), (7,)], "category long")
    assert [(r.rank, r.value, r["count"]) for r in top_values(df, ["category"], 5).orderBy("rank").collect()] == [(1, 4, 2), (2, 7, 1)]


def test_stats_calculator_vectors(spark):
    from clientele.operators.profile import held_top_values, stats_calculator, top_values
    schema = "client_id long, timestamp timestamp_ntz, a long, b long"
    day = 86400
    rows = [(1, ts(0), 5, None), (1, ts(9 * day), 6, 2), (2, ts(10 * day), 5, 2), (2, ts(10 * day), 6, 3), (3, ts(0), None, None)]
    df = spark.createDataFrame(rows, schema)
    tops, n, last = held_top_values(df, ["a", "b"], 2)
    # 5 and 6 tie: the smaller value first
    want = [("a", 5, 2, 1), ("a", 6, 2, 2), ("b", 2, 2, 1), ("b", 3, 1, 2)]
    for found in (tops, top_values(df, ["a", "b"], 2)):
        assert sorted((r.column_name, r.value, r["count"], r["rank"]) for r in found.collect()) == want
    assert (n, last) == (4, ts(10 * day))
    out, size = stats_calculator(["a", "b"], [1, 30], 2)(df)
    assert size == 9
    assert {r.client_id: list(r.features) for r in out.collect()} == {
        1: [2, 0, 1, 1, 0, 1, 1, 1, 0], 2: [2, 1, 1, 1, 1, 1, 1, 1, 1], 3: [1] + [0] * 8}
    out, size = stats_calculator(["a", "b"], [1, 30], 2)(spark.createDataFrame([], schema))
    assert size == 1 and out.collect() == []
