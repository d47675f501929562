import numpy as np
import pytest

pytest.importorskip("stellate.llm")
from stellate.llm import ann  # noqa: E402


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ q
            o = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [int(ids[j]) for j in o]
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_recall_and_scores(spark, block):
    r = np.random.default_rng(2)
    x = (r.standard_normal((20, 16))[r.integers(0, 20, 1200)] + 0.3 * r.standard_normal((1200, 16))) * r.uniform(0.5, 2, (1200, 1))
    ids = np.arange(1200)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(df, lambda i: i % 20 == 0, 10, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
        assert row["score"] == pytest.approx(float(x[row["vec_id"]] @ x[row["query_id"]]), rel=1e-12)
    want = brute(ids, x, 10, 20)
    assert sum(len({*got[q]} & {*w}) for q, w in want.items()) / (10 * len(want)) >= 0.9


def brute_rows(rows, is_query, k):
    """Sorted rows (query id, rank, id, score): every row but the query's own, told apart by place."""
    import math

    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if is_query(i):
            others = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(fine) if b != a and len(v) == len(q))
            out += [(i, r, j, pytest.approx(-s, rel=1e-12)) for r, (s, j) in enumerate(others[:k], 1)]
    return sorted(out, key=lambda x: x[:3])


ODD = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, 0.5]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (20, [3.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (40, []), (60, [1e200, 1e-200]), (80, [-1e-200, 1e-200])]


@pytest.mark.parametrize(("block", "k"), [(8192, 2), (8192, 20), (2, 3)])
def test_odd_vectors_and_repeated_rows(spark, block, k):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in ODD], "vec_id long, embedding array<double>, id long, rank int, tag int").repartition(3)
    got = sorted(map(tuple, ann.nearest(df, lambda i: i % 20 == 0, k, block=block).collect()), key=lambda x: x[:3])
    assert got == brute_rows(ODD, lambda i: i % 20 == 0, k)
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [8192, 8])
def test_repeated_ids_find_all_rows_but_their_own(spark, block):
    r = np.random.default_rng(5)
    x = r.standard_normal((30, 4)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (20, x[3].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, ann.nearest(df, lambda i: i == 20, 40, block=block).collect()), key=lambda x: x[:3])
    assert got == brute_rows(rows, lambda i: i == 20, 40)


def test_many_equal_vectors_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i), -1.0, 0.5]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for block in (8192, 50):
        got = sorted(map(tuple, ann.nearest(df, lambda i: i % 300 == 0, 15, block=block).collect()), key=lambda x: x[:3])
        assert got == brute_rows(rows, lambda i: i % 300 == 0, 15)


def test_one_short_vector_first_leaves_the_rest(spark):
    rows = [(0, [1.0]), (3, [2.0]), (20, [1.0, 0.0]), (21, [3.0, 0.0]), (22, [0.5, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, lambda i: i % 20 == 0, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (20, 1, 21, 3.0), (20, 2, 22, 0.5)]


def test_the_stopping_point():
    assert ann.chi_square_point(0.95, 8) == pytest.approx(15.507, abs=1e-3)
