"""Every query against its SQL on the small tables, and the shapes of those without SQL."""

import pytest
from conftest import rows_of

from segmentry.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


#: On the smallest tables no filter has enough information over 500 windows.
MAY_BE_EMPTY = {"motif_hypotheses"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0 or name in MAY_BE_EMPTY



def test_one_hot_long_encodes_every_letter(spark, sf):
    from segmentry.fixtures import frame

    seqs = {r["seq_key"]: r["seq"] for r in frame(spark, sf, "sequences").select("seq_key", "seq").collect()}
    got = QUERIES["one_hot_long"](spark, sf).toPandas()
    assert len(got) == len(seqs) * 210 * 4
    for key, rows in got.groupby("seq_key"):
        s = seqs[key].ljust(210, "N")
        want = [0.25 if s[p] not in "ACGT" else float(s[p] == "ACGT"[c]) for p, c in zip(rows["pos"], rows["channel"])]
        assert rows["v"].tolist() == want


def test_projection_is_that_of_all_rows(spark, sf):
    import numpy as np
    import pyarrow as pa

    from segmentry.operators import raw

    rows = QUERIES["raw_vectors"](spark, sf)
    x = raw.dense_rows(pa.RecordBatch.from_pandas(rows.orderBy("seq_key").toArrow().to_pandas()[["x"]], schema=rows.select("x").toArrow().schema))
    assert np.allclose(x[:, : 4**5].sum(axis=1)[x[:, : 4**5].any(axis=1)], 1) and x.shape[1] == 3614
    made = raw.fit(rows)
    assert made.n == len(x) and np.allclose(made.mean, x.mean(axis=0)) and np.allclose(made.vectors @ made.vectors.T, np.eye(raw.COMPONENTS), atol=1e-8)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    _, values, right = np.linalg.svd(z, full_matrices=False)
    # The spectrum is flat: six passes find nearly as much variance as the best components hold.
    assert (made.values**2).sum() > 0.97 * (values[: raw.COMPONENTS] ** 2).sum()
    assert np.allclose(np.abs(made.vectors[:2] @ right[:2].T), np.eye(2), atol=1e-3)
    got = np.stack(raw.project(rows, made).orderBy("seq_key").toPandas()["p"])
    assert np.allclose(got, z @ made.vectors.T, atol=1e-6)


def test_shares_of_explained_variance(spark, sf):
    import numpy as np

    from segmentry.fixtures import frame

    h = np.array([r["h"] for r in frame(spark, sf, "activations").collect()], dtype=float)
    z = (h - h.mean(axis=0)) / h.std(axis=0, ddof=1)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = [r["share"] for r in QUERIES["principal_variance"](spark, sf).orderBy("component").collect()]
    assert np.allclose(got, (values / values.sum())[:10], atol=1e-9)


def test_clusters_and_probes_are_in_range(spark, sf):
    agreement = QUERIES["cluster_agreement"](spark, sf).first()
    assert -0.5 <= agreement["ari"] <= 1 and agreement["inertia"] > 0
    probes = {r["target"]: r["accuracy"] for r in QUERIES["linear_probes"](spark, sf).collect()}
    assert set(probes) == {"class_id", "family_id"} and all(0 <= a <= 1 for a in probes.values())


def test_weight_matrices_sum_to_one(spark, sf):
    sums = QUERIES["motif_matrices"](spark, sf).groupBy("f", "off").agg({"p": "sum"}).collect()
    assert sums and all(abs(r["sum(p)"] - 1) < 1e-5 for r in sums)
    assert all(0 <= r["bits"] <= 38 and len(r["consensus"]) == 19 for r in QUERIES["motif_information"](spark, sf).collect())
