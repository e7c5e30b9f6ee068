"""States that merge, and state kept by key in a stream."""

import itertools

import numpy as np

from gridlore.operators import evaluator
from gridlore.operators import matching as M
from gridlore.plans.views import Views
from gridlore.streaming import metrics

SF = "/root/testdata/sf0.001"


def test_states_merge_in_any_order(spark):
    v = Views(spark, SF)
    gt = v.gt().cache()
    batches = [v.pred().where(c) for c in ("tile_id % 3 = 0", "tile_id % 2 = 0", "true")]
    states = [evaluator.Partial.of(gt, b, i) for i, b in enumerate(batches)]
    for s in states:
        s.cache()
    rows = lambda df: sorted(tuple(r) for r in df.select("image", "batch", "score", "tp", "n").collect())
    merge = evaluator.Partial.merge
    want = rows(merge(*states))
    for a, b, c in itertools.permutations(states):
        assert rows(merge(merge(a, b), c)) == want == rows(merge(a, merge(b, c, b), a))
    first = {t: min(i for i, c in enumerate((t % 3 == 0, t % 2 == 0, True)) if c) for t in {r[0] for r in want}}
    assert {(r[0], r[1]) for r in want} == set(first.items())
    whole = M.best(M.sweep(v.records(), gt.count())).first()
    assert evaluator.Partial.finalise(merge(*states), gt.count()).first() == whole


def test_states_in_files_replace_what_a_batch_left(spark, tmp_path):
    v = Views(spark, SF)
    ev = evaluator.States(v.gt(), f"file://{tmp_path}/s")
    for batch, pred in ((1, v.pred()), (0, v.pred().where("tile_id < 5")), (1, v.pred())):
        ev.process(pred, batch)
    assert ev.evaluate().first() == M.best(M.sweep(v.records(), v.gt().count())).first()
    assert {r.batch for r in ev.state().select("batch").distinct().collect()} == {0, 1}


def test_running_counts_of_batches(spark, tmp_path):
    g = np.random.default_rng(1)
    want, rounds = {}, {}
    for batch in range(3):
        users = [int(u) for u in g.integers(0, 12, 40)]
        rows = [(100 * batch + i, None, u, "a", float(i), "") for i, u in enumerate(users)]
        spark.createDataFrame(rows, metrics.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{batch}")
        for e, _, u, _, x, _ in rows:
            n, total, first = want.get(u, (0, 0.0, e))
            want[u] = (n + 1, total + x, min(first, e))
        for u in set(users):
            rounds.setdefault(u, []).append(want[u])
    rows = metrics.running(metrics.events(spark, f"{tmp_path}/in/*"), "user_id", f"file://{tmp_path}/out").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.round):
        got.setdefault(r.key, []).append((r.n, r.total, r.first))
    assert {u: x[-1] for u, x in got.items()} == want
    assert sorted(map(len, got.values())) == sorted(map(len, rounds.values()))
