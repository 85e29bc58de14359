"""Shape functions of hexahedra, wedges and pyramids, and where a position lies in such cells."""

from __future__ import annotations

import numpy as np

#: Steps of Newton's method at most, the step that ends it, and how far outside counts as inside; fixed values.
STEPS, CLOSE, SLACK = 50, 1e-5, 1e-6
HEX, WEDGE, PYRAMID = 8, 6, 5
#: Local positions of a hexahedron's corners.
HEX_CORNERS = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)])


def shape(points: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values (n, points), derivatives (n, points, 3)) of the shape functions at local positions."""
    u, v, w = r[:, 0], r[:, 1], r[:, 2]
    if points == HEX:
        near = HEX_CORNERS
        part = np.where(near[None], r[:, None], 1 - r[:, None])
        sign = np.where(near, 1.0, -1.0)[None]
        d = np.stack([sign[..., a] * part[..., (a + 1) % 3] * part[..., (a + 2) % 3] for a in range(3)], axis=-1)
        return part.prod(axis=2), d
    if points == WEDGE:  # a triangle's weights times a line's
        tri = np.stack([1 - u - v, u, v], axis=1)
        dtri = np.array([(-1, -1), (1, 0), (0, 1)], float)
        n = np.concatenate([tri * (1 - w)[:, None], tri * w[:, None]], axis=1)
        du = np.concatenate([dtri[None, :, 0] * (1 - w)[:, None], dtri[None, :, 0] * w[:, None]], axis=1)
        dv = np.concatenate([dtri[None, :, 1] * (1 - w)[:, None], dtri[None, :, 1] * w[:, None]], axis=1)
        return n, np.stack([du, dv, np.concatenate([-tri, tri], axis=1)], axis=-1)
    if points == PYRAMID:  # a quadrilateral that shrinks to the apex
        quad = np.stack([(1 - u) * (1 - v), u * (1 - v), u * v, (1 - u) * v], axis=1)
        du, dv = np.stack([v - 1, 1 - v, v, -v], axis=1), np.stack([u - 1, -u, u, 1 - u], axis=1)
        up, zero = (1 - w)[:, None], np.zeros((len(r), 1))
        n = np.concatenate([quad * up, w[:, None]], axis=1)
        return n, np.stack([np.concatenate([du * up, zero], axis=1), np.concatenate([dv * up, zero], axis=1), np.concatenate([-quad, zero + 1], axis=1)], axis=-1)
    raise ValueError(f"no shape functions for {points} points")


def hex_weights(r: np.ndarray) -> np.ndarray:
    """The eight weights at local positions in a hexahedron."""
    ends = [(1 - r[:, a], r[:, a]) for a in range(3)]
    out = np.empty((len(r), HEX))
    for k, (a, b, c) in enumerate(HEX_CORNERS):
        out[:, k] = ends[0][a] * ends[1][b] * ends[2][c]
    return out


def weights(position: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights (n, points), inside) of positions (n, 3) in cells (n, points, 3).

    Newton's method from the cell's middle; a parallelepiped takes one step, and only rows that are not yet close go on."""
    points = corners.shape[1]
    r = np.full((len(position), 3), 0.5 if points != WEDGE else 1 / 3)
    ok, open_ = np.ones(len(position), bool), np.arange(len(position))
    for _ in range(STEPS):
        n, d = shape(points, r[open_])
        miss = np.einsum("np,npx->nx", n, corners[open_]) - position[open_]
        jacobian = np.einsum("npr,npx->nxr", d, corners[open_])
        flat = np.abs(np.linalg.det(jacobian)) < 1e-20
        jacobian[flat] = np.eye(3)
        step = np.linalg.solve(jacobian, miss[..., None])[..., 0]
        ok[open_[flat]] = False
        r[open_] = np.clip(r[open_] - step, -10, 10)
        open_ = open_[(np.abs(step).max(axis=1, initial=0) >= CLOSE) & ~flat]
        if not len(open_):
            break
    n, _ = shape(points, r)
    reached = np.abs(np.einsum("np,npx->nx", n, corners) - position).max(axis=1, initial=0) <= 1e-4 * np.ptp(corners, axis=1).max(axis=1, initial=0) + 1e-12
    inside = ((r >= -SLACK) & (r <= 1 + SLACK)).all(axis=1)
    if points == WEDGE:
        inside &= r[:, 0] + r[:, 1] <= 1 + SLACK
    return n, ok & inside & reached
