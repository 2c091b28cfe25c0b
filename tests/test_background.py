"""Background-subtracted channels against plain numpy."""

import math

import numpy as np

from tissuelake.operators import planes

SCHEMA = "stack_id int, frame int, y int, x int, label int, ch0 double"


def plain(image, labels, bin_size, sigma):
    h, w = image.shape
    nulls = np.isnan(image)
    ny, nx = -(-h // bin_size), -(-w // bin_size)
    free = (labels == 0) & ~nulls
    level = image[free].mean() if free.any() else 0.0
    grid = np.full((ny, nx), level)
    for i in range(ny):
        for j in range(nx):
            part = np.s_[i * bin_size : (i + 1) * bin_size, j * bin_size : (j + 1) * bin_size]
            if free[part].any():
                grid[i, j] = image[part][free[part]].mean()
    ys, xs = (np.clip((np.arange(n) + 0.5) / bin_size - 0.5, 0, k - 1) for n, k in ((h, ny), (w, nx)))
    along = np.array([np.interp(xs, np.arange(nx), row) for row in grid])
    back = np.array([np.interp(ys, np.arange(ny), column) for column in along.T]).T
    out = image - back + image[~nulls].std()
    if sigma:
        reach = int(4 * sigma + 0.5)
        weights = np.array([math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)])
        for axis in (0, 1):
            padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            out = np.apply_along_axis(lambda v: np.convolve(v, weights / weights.sum(), "valid"), axis, padded)
    return np.maximum(out, 0)


def table(spark, images):
    rows = [(s, f, y, x, int(labels[y, x]), None if np.isnan(image[y, x]) else float(image[y, x])) for (s, f), (image, labels) in images.items() for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_numpy(spark):
    """Sizes that blocks do not divide, blocks and frames without background, two stacks, a flat frame."""
    rng = np.random.default_rng(4)
    images = {(s, f): (rng.uniform(0, 90, (22, 31)) + 3 * np.arange(31), (rng.random((22, 31)) < 0.7).astype(int)) for s in (0, 1) for f in (0, 1)}
    images[0, 0][1][:10, :10] = 1
    images[0, 1][1][:] = 5
    images[1, 1] = (np.full((22, 31), 7.0), np.zeros((22, 31), int))
    for sigma in (0, 1.2):
        got = planes.background_subtracted(table(spark, images), "ch0", 22, 31, bin_size=8, sigma=sigma).collect()
        assert len(got) == 4 * 22 * 31
        want = {key: plain(*pair, 8, sigma) for key, pair in images.items()}
        assert max(abs(r.value - want[r.stack_id, r.frame][r.y, r.x]) for r in got) < 1e-8


def test_nulls_and_no_rows(spark):
    image, labels = np.arange(30.0).reshape(5, 6), np.zeros((5, 6), int)
    image[2, 3] = np.nan
    got = planes.background_subtracted(table(spark, {(0, 0): (image, labels)}), "ch0", 5, 6, bin_size=3, sigma=0).collect()
    want = plain(image, labels, 3, 0)
    assert all(abs(r.value - want[r.y, r.x]) < 1e-9 for r in got if (r.y, r.x) != (2, 3))
    assert [r.value for r in got if (r.y, r.x) == (2, 3)] == [None]
    assert planes.background_subtracted(spark.createDataFrame([], SCHEMA), "ch0", 5, 6).count() == 0
