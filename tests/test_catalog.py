"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinelake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
SLOW = {"hidden_msm", "mbar_energies", "tram_energies"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(df):
    cols = sorted(df.columns)
    text = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in text.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["i", "j", "p"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_own_limits(monkeypatch):
    """The queries of iterative operators leave tolerances and iteration limits to the operators."""

    class Asked(Exception):
        pass

    def asked(*args, **options):
        raise Asked(options)

    def options(name):
        with pytest.raises(Asked) as e:
            catalog.queries()[name](None, DATA)
        return e.value.args[0]

    for f in ("samples", "states", "embeddings"):
        monkeypatch.setattr(catalog, f, lambda spark, d: None)
    for name, module, operator in (("mbar_energies", catalog.T, "mbar"), ("tram_energies", catalog.T, "TRAM"), ("hidden_msm", catalog, "HMSMEstimator"), ("kmeans_dtrajs", catalog.C, "KMeans"), ("mini_batch_kmeans_dtrajs", catalog.C, "MiniBatchKMeans"), ("bayesian_msm", catalog.K, "BayesianMSM"), ("oom_reweighted_msm", catalog, "OOMEstimator")):
        monkeypatch.setattr(module, operator, asked)
        assert not options(name).keys() & {"maxiter", "maxerr", "maxit", "max_iter", "init", "nbs", "nsamples"}, name
