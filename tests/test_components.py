"""Principal components in passes over all rows against NumPy on the whole table."""

import numpy as np
import pytest

from segmentry.operators import components as C


def taken():
    """A function that workers get by value, as they cannot import this file."""

    def dense(batch):
        return batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    return dense


def frame(spark, x, parts):
    return spark.createDataFrame([([float(a) for a in row],) for row in x], "h array<double>").repartition(parts)


@pytest.mark.parametrize(("rows", "columns", "rank", "parts", "kept"), [(400, 40, 40, 40, 5), (300, 60, 12, 3, 8), (30, 50, 29, 5, 4), (200, 8, 8, 20, 8)])
def test_subspace_equals_that_of_the_table(spark, rows, columns, rank, parts, kept):
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, rank)) * 0.7 ** np.arange(rank) @ rng.normal(size=(rank, columns)) + 5
    x[:, -1] = 3.0
    made = C.fit(frame(spark, x, parts), taken(), kept, 60)
    scale = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(scale > 1e-12, scale, 1)
    _, values, right = np.linalg.svd(z, full_matrices=False)
    k = len(made.values)
    assert k == min(kept, int((values > values[0] * 1e-12).sum()))
    assert np.allclose(made.values, values[:k], rtol=1e-9) and np.allclose(made.shares(), values[:k] ** 2 / (values**2).sum())
    # The sine of the largest angle between both subspaces.
    apart = made.vectors - made.vectors @ right[:k].T @ right[:k]
    assert np.linalg.norm(apart, 2) < 1e-6
    assert np.allclose(made.vectors @ made.vectors.T, np.eye(k), atol=1e-9) and made.n == rows


def test_no_rows_one_row_and_equal_rows(spark):
    assert C.fit(frame(spark, [[1.0, 2.0]], 1).limit(0), taken(), 2, 5) is None
    for x in ([[1.0, 2.0]], [[1.0, 2.0]] * 7):
        made = C.fit(frame(spark, x, 3), taken(), 2, 5)
        assert len(made.values) == 0 and made.vectors.shape == (0, 2) and made.n == len(x)
