"""Whole-table queries against brute force on small tables."""

import numpy as np
from pyspark.sql import functions as F

from gridlore.plans import catalog


def embeddings(spark, path, vectors, first=0):
    rows = [(first + i, [float(x) for x in e], i % 3) for i, e in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return f"{path}"


def test_seams_of_all_tiles(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((90, 8, 8)).astype("float32")
    x[75, :, 0] = x[80, :, 7]
    sf = embeddings(spark, tmp_path, x.reshape(90, 64))
    unit = lambda s: (s - s.mean(axis=1, keepdims=True)) / np.linalg.norm(s - s.mean(axis=1, keepdims=True), axis=1, keepdims=True)
    c = unit(x[:, :, 7].astype(float)) @ unit(x[:, :, 0].astype(float)).T
    off = c[~np.eye(90, dtype=bool)]
    np.fill_diagonal(c, -np.inf)
    z = {r.a: r.z for r in catalog.queries()["w14_best_match_z"](spark, sf).collect()}
    assert z.keys() == set(range(90)) and all(abs(z[i] - (c[i].max() - off.mean()) / off.std()) < 1e-5 for i in z)
    got = {(r.a, r.b) for r in catalog.queries()["w15_reciprocal_best"](spark, sf).collect()}
    assert got == {(i, int(c[i].argmax())) for i in range(90) if c[:, c[i].argmax()].argmax() == i} and (80, 75) in got


def test_seam_tops_equal_sums_term_by_term_on_ties():
    from gridlore.plans.spatial import tops, units

    r = np.random.default_rng(8)
    x, y = (units(list(r.integers(0, 4, (n, 8)).astype(float))) for n in (1203, 900))
    y[700], y[30], x[5] = y[11], y[11], 0.0
    same = (np.array([3, 501, 900]), np.array([11, 0, 899]))
    rho = sum(x[:, d, None] * y[None, :, d] for d in range(8))
    rho[same] = -np.inf
    best, at = tops(x, y, same)
    assert (best == rho.max(axis=1)).all() and (at == rho.argmax(axis=1)).all()
    best, at = tops(y, x, same[::-1])
    assert (best == rho.max(axis=0)).all() and (at == rho.argmax(axis=0)).all()
    best, at = tops(x[:1], y[:1], (np.array([0]), np.array([0])))
    assert np.isneginf(best).all()


def test_predictions_are_shuffled_once_by_order(spark):
    """One exchange of the lines serves their aggregate and their join with orders, and a tally does not join matches back."""
    from gridlore.operators import matching as M
    from gridlore.plans.views import Views

    v = Views(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(v.pred()).count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_orderkey#" in plan(v.pred()) and ", l_linenumber" not in "".join(x for x in plan(v.pred()).split("\n") if "Exchange" in x)
    got = {(r.score, r.tp1, r.n1) for r in M.tally(v.pred(), v.cand(), 0.5, []).collect()}
    want = v.records().groupBy("score").agg(F.sum("is_tp").alias("tp1"), F.count(F.lit(1)).alias("n1")).collect()
    assert got == {(r.score, r.tp1, r.n1) for r in want}


SF = "/root/testdata/sf0.001"


def test_distance_joins_meet_all_of_the_reference(spark):
    from gridlore.plans.views import Views

    v = Views(spark, SF)
    mid = lambda df: np.array([((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2) for r in df.orderBy("det_id").collect()])
    p = v.map_pred().where("score >= 0.7")
    ids, a, b = [r.det_id for r in p.orderBy("det_id").select("det_id").collect()], mid(p), mid(v.map_gt())
    hit = np.stack([((b - x) ** 2).sum(axis=1) <= 400 for x in a])
    got = [r.det_id for r in catalog.queries()["j8_distance_semi_join"](spark, SF).orderBy("det_id").collect()]
    assert got == [i for i, h in zip(ids, hit.any(axis=1), strict=True) if h]
    m = catalog.queries()["m19_concordance"](spark, SF).first()
    assert abs(m.concordance - 100 * hit.any(axis=1).mean()) < 1e-5 and abs(m.recovery - 100 * hit.any(axis=0).mean()) < 1e-5


def test_draws_reach_all_tiles(spark, tmp_path):
    # Ids with gaps, all of them above the fixed ranges of 500 and 600.
    import hashlib

    sf = embeddings(spark, tmp_path, np.arange(40)[:, None] ** 2 * np.ones(64), first=1000)
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{sf}/orders.parquet")
    draw = lambda s, i: int(hashlib.md5(f"{s}{i}".encode()).hexdigest()[:8], 16) % 40
    gaps = [abs(x * x - y * y) for x, y in ((draw("a", i), draw("b", i)) for i in range(4000)) if x != y]
    assert abs(catalog.queries()["c12_random_pairs"](spark, sf).first().p99 - np.percentile(gaps, 99)) < 1e-5
    got = {r.det_id for r in catalog.queries()["j13_point_in_raster"](spark, sf).collect()}
    assert got == {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect() if r.o_orderkey % 40 == 0} and got


def test_sorts_and_membership_keep_all_rows(spark):
    from gridlore.plans.spatial import paired
    from gridlore.plans.views import Views

    sf = SF.replace("0.001", "0.01")
    v, q = Views(spark, sf), catalog.queries()
    keys = sorted((r.key for r in paired(v).select("key").collect()), key=lambda k: int(k[3:]))
    assert len(keys) > 50 and [r.key for r in q["o1_numeric_suffix_sort"](spark, sf).orderBy("rank").collect()] == keys
    rows = sorted((-r.score, r.x0, r.y0, r.det_id) for r in v.map_pred().collect())
    got = q["o2_multi_key_sort"](spark, sf).collect()
    assert len(rows) > 100 and {r.rank: r.det_id for r in got} == {i: r[3] for i, r in enumerate(rows, 1)}
    tiles = {(r.aoi, "train" if r.tile_id % 5 else "val", r.tile_id) for r in v.tiles().collect()}
    assert {tuple(r) for r in q["k9_membership_record"](spark, sf).select("aoi", "split", "tile_id").collect()} == tiles


def test_principal_components_and_clusters_equal_numpy(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    norms = [r.norm for r in catalog.queries()["c6_principal_components"](spark, SF).orderBy("vec_id").collect()]
    assert np.allclose(norms, np.linalg.norm(x @ v[:8].T, axis=1), rtol=1e-6)
    at = np.array([r.cluster for r in catalog.queries()["c7_clusters"](spark, SF).orderBy("vec_id").collect()])
    centres = np.array([x[at == k].mean(axis=0) for k in range(10)])
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (near.argmin(axis=1) == at).mean() > 0.9  # settled but for the last of its rounds
    assert near.min(axis=1).sum() < 0.99 * ((x - x.mean(axis=0)) ** 2).sum()


def test_welch_p_equals_simulation_free_integral(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type", "value").collect():
        rows.setdefault(r.event_type, []).append(r.value)
    for r in catalog.queries()["a23_welch_p"](spark, SF).collect():
        a, b = np.array(rows[r.a]), np.array(rows[r.b])
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        t, df = abs((a.mean() - b.mean()) / np.sqrt(va + vb)), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
        y = np.linspace(0, t, 200_001)
        f = (1 + y * y / df) ** (-(df + 1) / 2)
        whole = np.linspace(0, 200, 2_000_001)
        g = (1 + whole * whole / df) ** (-(df + 1) / 2)
        assert abs(r.p - (1 - np.trapezoid(f, y) / np.trapezoid(g, whole))) < 1e-5


def test_balanced_folds_equal_a_plain_loop(spark):
    counts = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "vec_id").collect():
        own = counts.setdefault(r.label, [0, 0, 0, 0])
        own[0] += 1
        own[1 + r.vec_id % 3] += 1
    fill, want = [[0, 0, 0, 0] for _ in range(5)], {}
    for label, own in sorted(counts.items(), key=lambda c: (-c[1][0], c[0])):
        cost = [sum((a + b) ** 2 - a * a for a, b in zip(f, own, strict=True)) for f in fill]
        fold = cost.index(min(cost))
        fill[fold] = [a + b for a, b in zip(fill[fold], own, strict=True)]
        want[label] = fold
    assert {r.label: r.fold for r in catalog.queries()["c9_balanced_folds"](spark, SF).collect()} == want
