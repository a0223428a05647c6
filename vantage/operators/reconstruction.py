"""Structure from motion: a scene's tracks become camera poses and points, incrementally.

Observations are rows (scene, track, view, u, v) in units of the image's larger side about its centre. A scene is solved in
one task, many scenes by many; within a task nothing is larger than the scene's observations.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import estimators as E

#: Least matches and homography-free angle of the first pair, least views of a point, share of inliers that a new
#: view needs, and least common points of a candidate.
MIN_MATCHES, MIN_ANGLE, MIN_VIEWS, MIN_INLIERS, MIN_POINTS = 24, np.radians(5.0), 2, 0.33, 6
CAMERAS = "scene string, view int, flen double, k1 double, k2 double, rot array<double>, trans array<double>"
POINTS = "scene string, track long, pos array<double>, views array<int>"


def logistic(x: float) -> float:
    return float(np.clip(2 / (1 + np.exp(x)) - 1, 0, 1))


def pair_score(matches: int, inliers: int, degrees: float) -> float:
    return logistic((20 - matches) * 6 / 200) * logistic((1 - degrees) * 6 / 8) * logistic((inliers / matches - 0.7) * 6 / 0.4)


class Scene:
    """Observations of one scene by view, with what is known of cameras (focal length, distortion, pose) and points."""

    def __init__(self, table: pd.DataFrame, flens: dict[int, float], seed: int = 0) -> None:
        self.seen = {int(v): dict(zip(g["track"], g[["u", "v"]].to_numpy(float), strict=True)) for v, g in table.groupby("view")}
        self.flen = {v: flens.get(v, 1.0) for v in self.seen}
        self.dist = {v: np.zeros(2) for v in self.seen}
        self.pose: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.point: dict[int, np.ndarray] = {}
        self.dropped: dict[tuple[int, int], np.ndarray] = {}
        self.rng = np.random.default_rng(seed)

    def calibrated(self, view: int, tracks: list[int]) -> np.ndarray:
        """Undistorted image points in units of the focal length."""
        f = self.flen[view]
        return np.array([E.undistort_feature(self.seen[view][t] / f, *self.dist[view], 1.0) for t in tracks]).reshape(-1, 2)

    def common(self, a: int, b: int) -> list[int]:
        return sorted(set(self.seen[a]) & set(self.seen[b]))

    def relative_pose(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Of the four poses the one with all points in front of both cameras."""
        f, inliers = E.ransac_fundamental(p, q, self.rng, 200)
        if f is None or len(inliers) < 8:
            return None
        e = E.enforce_essential(E.fundamental_least_squares(p[inliers], q[inliers]))
        own = np.column_stack([np.eye(3), np.zeros(3)])
        best = None
        for r, t in E.poses_from_essential(e):
            poses = np.stack([own, np.column_stack([r, t])])
            x = np.array([E.triangulate(poses, np.stack([a, b])) for a, b in zip(p[inliers], q[inliers], strict=True)])
            front = int(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).sum())
            if best is None or front > best[0]:
                best = front, r, t
        return best[1:] if best[0] > len(inliers) / 2 else None

    def angle(self, a: int, b: int, pose: tuple[np.ndarray, np.ndarray]) -> float:
        """The upper median of the angles between the views' rays."""
        tracks = self.common(a, b)
        rays = [E.homogeneous(self.calibrated(v, tracks)) for v in (a, b)]
        rays[1] = rays[1] @ pose[0]
        cos = (rays[0] * rays[1]).sum(1) / np.linalg.norm(rays[0], axis=1) / np.linalg.norm(rays[1], axis=1)
        return float(np.arccos(np.clip(np.sort(cos)[len(cos) // 2], -1, 1)))

    def initial_pair(self) -> tuple[int, int] | None:
        """By number of matches the first pair whose homography explains less than 0.6 of them and whose angle is wide enough;
        else the one of the best score."""
        views = sorted(self.seen)
        pairs = sorted(((-len(self.common(a, b)), a, b) for i, a in enumerate(views) for b in views[i + 1 :] if len(self.common(a, b)) >= MIN_MATCHES))
        best = None
        for n, a, b in pairs:
            tracks = self.common(a, b)
            p, q = self.calibrated(a, tracks), self.calibrated(b, tracks)
            _, flat = E.ransac_homography(p, q, self.rng, 100)
            pose = self.relative_pose(p, q)
            if pose is None:
                continue
            angle = self.angle(a, b, pose)
            score = pair_score(-n, len(flat), float(np.degrees(angle)))
            good = len(flat) < 0.6 * -n and angle >= MIN_ANGLE
            if good or best is None or score > best[0]:
                best = score, a, b, pose
            if good:
                break
        if best is None:
            return None
        _, a, b, pose = best
        self.pose = {a: (np.eye(3), np.zeros(3)), b: pose}
        return a, b

    def next_views(self) -> list[int]:
        """Views without a pose by their number of known points, most first, larger ids first; those of too few are left out."""
        n = {v: sum(t in self.point for t in seen) for v, seen in self.seen.items() if v not in self.pose}
        return sorted((v for v, k in n.items() if k > MIN_POINTS), key=lambda v: (-n[v], -v))

    def add_view(self, view: int, threshold: float = 0.005) -> bool:
        """The pose of a view from known points; observations that don't fit go and are kept for later."""
        tracks = [t for t in sorted(self.seen[view]) if t in self.point]
        seen = self.calibrated(view, tracks)
        pose, inliers = E.ransac_pose(np.array([self.point[t] for t in tracks]), seen, self.rng, 200, threshold)
        if pose is None or len(inliers) < MIN_INLIERS * len(tracks):
            return False
        self.pose[view] = pose
        for i in set(range(len(tracks))) - set(inliers.tolist()):
            self.dropped[view, tracks[i]] = self.seen[view].pop(tracks[i])
        return True

    def add_points(self, threshold: float = 0.01, angle: float = np.radians(1.0)) -> int:
        """Points of tracks that enough posed views see; views that miss a point lose its observation."""
        made = 0
        for t in sorted({t for v in self.pose for t in self.seen[v]} - set(self.point)):
            views = [v for v in sorted(self.pose) if t in self.seen[v]]
            if len(views) < MIN_VIEWS:
                continue
            poses = np.array([np.column_stack(self.pose[v]) for v in views])
            got = E.triangulate_robust(poses, np.concatenate([self.calibrated(v, [t]) for v in views]), threshold, angle, MIN_VIEWS)
            if got is None:
                continue
            self.point[t], made = got[0], made + 1
            for i in got[1]:
                self.dropped[views[i], t] = self.seen[views[i]].pop(t)
        return made

    def arrays(self):
        views, tracks = sorted(self.pose), sorted(self.point)
        at = {t: i for i, t in enumerate(tracks)}
        obs = [(i, at[t], uv) for i, v in enumerate(views) for t, uv in sorted(self.seen[v].items()) if t in at]
        cams = np.array([[self.flen[v], *self.dist[v], *self.pose[v][1], 0, 0, 0] for v in views])
        rots = np.array([self.pose[v][0] for v in views])
        return views, tracks, cams, rots, np.array([self.point[t] for t in tracks]), np.array([o[0] for o in obs]), np.array([o[1] for o in obs]), np.array([o[2] for o in obs])

    def adjust(self, mode: str = "full", rounds: int = 50) -> float:
        """Bundle adjustment of all cameras and points; the mean squared error."""
        views, tracks, cams, rots, points, ci, pi, seen = self.arrays()
        cams, rots, points, _, mse = E.bundle_adjust(cams, rots, points, ci, pi, seen, mode, rounds, fixed_intrinsics=len(views) < 3)
        for i, v in enumerate(views):
            self.flen[v], self.dist[v], self.pose[v] = float(cams[i, 0]), cams[i, 1:3], (rots[i], cams[i, 3:6])
        self.point = dict(zip(tracks, points, strict=True))
        return mse

    def drop_large_errors(self, factor: float = 10.0) -> int:
        """Points whose mean squared error is above factor times the upper median go."""
        _, tracks, cams, rots, points, ci, pi, seen = self.arrays()
        e = (E.residuals(cams, rots, points, ci, pi, seen) ** 2).sum(1)
        n = np.bincount(pi, minlength=len(tracks))
        mean = np.bincount(pi, e, minlength=len(tracks)) / np.maximum(n, 1)
        bad = np.flatnonzero(mean > max(factor * np.sort(mean)[len(mean) // 2], 1e-20))
        for i in bad:
            del self.point[tracks[i]]
        return len(bad)

    def restore(self, view: int, threshold: float = 0.01) -> int:
        """Observations taken from a view come back where they now fit."""
        back = 0
        for (v, t), uv in list(self.dropped.items()):
            if v == view and t in self.point:
                self.seen[v][t] = uv
                e = E.reprojection_errors(self.pose[v], self.point[t][None], self.calibrated(v, [t]))[0]
                if e < threshold**2:
                    back += 1
                    del self.dropped[v, t]
                else:
                    del self.seen[v][t]
        return back

    def normalise(self) -> None:
        """The mean of the camera centres at the origin, and the largest extent of points and centres 10."""
        centres = np.array([-r.T @ t for r, t in self.pose.values()])
        every = np.concatenate([centres, np.array(list(self.point.values())).reshape(-1, 3)])
        scale, middle = 10 / max((every.max(0) - every.min(0)).max(), 1e-12), centres.mean(0)
        self.pose = {v: (r, (t + r @ middle) * scale) for v, (r, t) in self.pose.items()}
        self.point = {t: (x - middle) * scale for t, x in self.point.items()}

    def run(self) -> None:
        if self.initial_pair() is None:
            return
        self.add_points()
        if not self.point:
            self.pose = {}
            return
        self.adjust()
        while True:
            added = next((v for v in self.next_views() if self.add_view(v)), None)
            if added is None:
                break
            self.add_points()
            self.adjust()
            self.restore(added)
            self.drop_large_errors()
        self.normalise()


def register(points: np.ndarray, survey: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """The similarity that brings triangulated survey points to their known places; None under three."""
    return E.determine_transform(points, survey)


def registration_error(points: np.ndarray, survey: np.ndarray) -> float:
    return float(((points - survey) ** 2).sum(1).mean())


def reconstruct(observations: DataFrame, flens: dict[int, float] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """observations (scene, track, view, u, v) -> cameras (scene, view, flen, k1, k2, rot, trans) and points (scene, track, pos,
    views). Scenes without a first pair give no rows; rows with nulls are left out. Both tables come of the same seeded
    computation, which each of them runs: write one of them first where that counts."""
    known = flens or {}

    def solved(t: pd.DataFrame) -> tuple[str, Scene]:
        name = t["scene"].iloc[0]
        s = Scene(t.sort_values(["view", "track"]).drop_duplicates(["view", "track"]), known, seed + zlib.crc32(name.encode()))
        s.run()
        return name, s

    def cameras(t: pd.DataFrame) -> pd.DataFrame:
        name, s = solved(t)
        return pd.DataFrame([(name, v, s.flen[v], *map(float, s.dist[v]), r.ravel().tolist(), x.tolist()) for v, (r, x) in sorted(s.pose.items())], columns=[c.split()[0] for c in CAMERAS.split(", ")])

    def points(t: pd.DataFrame) -> pd.DataFrame:
        name, s = solved(t)
        return pd.DataFrame([(name, k, x.tolist(), [v for v in sorted(s.pose) if k in s.seen[v]]) for k, x in sorted(s.point.items())], columns=[c.split()[0] for c in POINTS.split(", ")])

    rows = observations.select("scene", "track", "view", "u", "v").dropna()
    return rows.groupBy("scene").applyInPandas(cameras, CAMERAS), rows.groupBy("scene").applyInPandas(points, POINTS)
