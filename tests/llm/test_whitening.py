import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from corpusframe.llm import whitening as W

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())),
                     StructField("x", StringType()), StructField("n", StringType()), StructField("whitened", StringType())])


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", "w") for i, v in rows], SCHEMA)


def plain(rows, components=16):
    """The contract with a dense eigensolver. rows: usable (id, vector)."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    fit = np.array(sorted(set(map(tuple, x.tolist()))))
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    z = ((x * n - s) / n) @ u[:, :k] / np.sqrt(e[:k])
    dev = [sum(int(n * a - b) ** 2 for a, b in zip(r, s)) for r in x.tolist()]
    return n, dev, z, e[:k] / np.trace(v)


def check(rows, got, components=16):
    got = list(got)
    n, dev, z, share = plain(rows, components)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(rows) * z.shape[1]
    signs = None
    for (i, _), d, line in zip(rows, dev, z):
        mine = sorted(by[i], key=lambda r: r["component"])[: z.shape[1]]
        assert [r["component"] for r in mine] == list(range(1, z.shape[1] + 1))
        assert all(r["n"] == n and r["deviation"] == d for r in mine)
        assert np.allclose([r["explained"] for r in mine], share, rtol=1e-9)
        w = np.array([r["whitened"] for r in mine])
        assert np.allclose(np.abs(w), np.abs(line), atol=1e-6)
        signs = np.where(np.abs(line) > 0.1, np.sign(w * line), 0) if signs is None else signs
        both = (np.abs(line) > 0.1) & (signs != 0)
        assert (np.sign(w * line)[both] == signs[both]).all()  # one sign for all rows
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def vectors(n, d, seed=0):
    g = np.random.default_rng(seed)
    return [(i, [float(c) for c in v]) for i, v in enumerate(g.normal(size=(n, d)) @ g.normal(size=(d, d)) + 3)]


@pytest.mark.parametrize("n,d", [(400, 24), (40, 3), (300, 64)])
def test_matches_a_dense_solver(spark, n, d):
    rows = vectors(n, d)
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:50])]  # repeats count once in the fit
    check(rows, W.whitening_report(table_of(spark, rows).repartition(5)).collect())


def test_rows_left_out_and_repeats(spark):
    rows = vectors(60, 5) + [(800, [1.0] * 5)]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (904, []), (905, [1.0, 2.0]), (906, [1e300] * 5)]
    got = W.whitening_report(table_of(spark, rows + bad + rows[-1:] * 39)).collect()
    assert sum(r["vec_id"] == 800 for r in got) == 40 * 5
    check(rows, {(r["vec_id"], r["component"]): r for r in got}.values())


def test_few_distinct_vectors_and_empty_table(spark):
    assert W.whitening_report(table_of(spark, [])).count() == 0
    assert W.whitening_report(table_of(spark, [(1, [1.0, 2.0])] * 4)).count() == 0
    got = W.whitening_report(table_of(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 1.0]), (3, [3.0, 2.0, 1.0])])).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == {(1, 1), (2, 1), (3, 1)}  # rank one
    assert np.allclose([abs(r["whitened"]) for r in got], 1) and abs(got[0]["explained"] - 1) < 1e-12


def test_deviation_past_64_bits_is_exact_or_null(spark):
    big = 2.0**28
    rows = [(1, [big, 0.0]), (2, [-big, 1.0]), (3, [0.0, 5.0])]
    got = W.whitening_report(table_of(spark, rows)).collect()
    want = [v if v < 1 << 63 else None for v in plain(rows)[1]]
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, w) for (i, _), w in zip(rows, want)} and None in want


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_inertia_counts(d):
    g = np.random.default_rng(d)
    for _ in range(20):
        a = g.normal(size=(d, d))
        a = a + a.T
        a[0, 0] = 0.0
        e = np.linalg.eigvalsh(a)
        for s in [*g.normal(size=5), 0.0, *((e[:-1] + e[1:]) / 2)]:
            assert W.count_above(a, s) == int((e > s).sum())


def test_close_and_equal_eigenvalues():
    g = np.random.default_rng(5)
    q, _ = np.linalg.qr(g.normal(size=(30, 30)))
    for e in ([9.0] * 3 + [5.0, 5.0 + 1e-9, 5.0 + 2e-9] + [1.0] * 24, list(np.linspace(1, 1.001, 30)), [4.0] * 30, [1e9, 1e3, 1.0] + [1e-3] * 27):
        e = np.sort(np.array(e))[::-1]
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = W.leading_eigenpairs(a, 16)
        assert len(values) == 16 and np.allclose(values, e[:16], rtol=0, atol=1e-12 * e[0])
        assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)
        assert np.linalg.norm(a @ vectors - vectors * values) < 1e-11 * e[0]


def test_float_vectors_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert isinstance(df.schema["embedding"].dataType.elementType, FloatType)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(rows, W.query(spark, "/root/testdata/sf0.001").collect())
