"""Structure from motion on made-up scenes."""

import numpy as np
import pandas as pd

from vantage.operators import estimators as E
from vantage.operators import reconstruction as R


def scene(n=80, views=5, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.uniform(-1, 1, (n, 3))
    rows, centres = [], []
    for v in range(views):
        r = E.rodrigues(np.array([0.02 * v, 0.15 * (v - 2), 0.01 * v]))
        t = np.array([0.1 * v, -0.05 * v, 5.0])
        centres.append(-r.T @ t)
        x = points @ r.T + t
        uv = 1.1 * x[:, :2] / x[:, 2:]
        rows += [("a", i, v, *uv[i]) for i in range(n) if rng.random() < 0.9]
    return points, np.array(centres), pd.DataFrame(rows, columns=["scene", "track", "view", "u", "v"])


def test_reconstruct(spark):
    points, centres, table = scene()
    # A few wrong observations, a scene that is too small, and a null.
    table.loc[[5, 90, 170], "u"] += 0.3
    small = pd.DataFrame([("b", 0, 0, 0.1, 0.1), ("b", 0, 1, 0.2, 0.1)], columns=table.columns)
    both = spark.createDataFrame(pd.concat([table, small]), "scene string, track long, view int, u double, v double")
    cams, pts = R.reconstruct(both, {v: 1.1 for v in range(5)})
    c, p = cams.toPandas(), pts.toPandas()
    assert set(c.scene) == {"a"} and sorted(c["view"]) == [0, 1, 2, 3, 4] and len(p) >= 75
    got = np.array([-np.reshape(r, (3, 3)).T @ t for r, t in zip(c.rot, c.trans, strict=True)])
    at = np.stack(p.pos)
    every = np.concatenate([got, at])
    assert np.allclose(got.mean(0), 0, atol=1e-6) and np.isclose((every.max(0) - every.min(0)).max(), 10)
    rot, scale, move = R.register(at, points[p.track])
    assert R.registration_error(scale * at @ rot.T + move, points[p.track]) < 1e-4
    assert np.abs(scale * got @ rot.T + move - centres).max() < 0.05


def test_large_errors_and_restored_observations():
    _, _, table = scene(40, 3, 2)
    s = R.Scene(table, {v: 1.1 for v in range(3)}, 1)
    s.run()
    assert set(s.pose) == {0, 1, 2}
    t = next(t for t in s.point if all(t in s.seen[v] for v in s.pose))
    s.dropped[2, t] = s.seen[2].pop(t)
    assert s.restore(2) == 1 and t in s.seen[2]
    s.point[t] = s.point[t] + 3
    assert s.drop_large_errors() >= 1 and t not in s.point and s.add_points() >= 1 and t in s.point
    assert R.pair_score(200, 40, 8.0) > R.pair_score(200, 120, 8.0) > R.pair_score(200, 150, 8.0) == 0 and R.pair_score(10, 1, 8.0) == 0
