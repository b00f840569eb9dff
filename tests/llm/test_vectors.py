import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, size string, other0 string, key string, code string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 6) for r in rows], SCHEMA)


def rows(seed=4, n=120, dims=32, spread=0.2):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(dims, dims))
    data = [[float(np.float32(v)) for v in row] for row in rng.normal(size=(n, dims)) @ mixed * spread / 4]
    out = [(k, v, k % 3 if k % 5 else None) for k, v in enumerate(data)]
    out += [(200 + k, data[7], 1) for k in range(60)]  # a vector that many rows share
    out += [(300, None, 1), (301, [*data[1][:-1], None], 1), (302, [*data[1][:-1], math.nan], 2), (303, [math.inf, *data[1][1:]], 2)]
    out += [(304, data[3][: dims // 2], None), (305, [], 0), (None, data[4], 0), (5, data[5], 2), (5, data[6], 2), out[9], (306, [-0.0] * dims, 1)]
    return out


def whole(data):
    kept = [(k, v, label) for k, v, label in data if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    dims = max((len(v) for _, v, _ in kept), default=0)
    return [(k, tuple(math.floor(256 * e) for e in v) + (0,) * (dims - len(v)), label) for k, v, label in kept], dims


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6).flatmap(lambda d: st.lists(st.lists(st.one_of(st.integers(-3, 3), st.integers(-(2**61), 2**61), st.sampled_from([-128, 127, 128, -32768, 32768])), min_size=d, max_size=d), min_size=1, max_size=8)))
def test_packing_of_vectors(data):
    x = np.array(data, np.int64).reshape(len(data), -1)
    values = vectors.packed(x)
    assert (vectors.unpacked(pa.array(values, pa.binary()), x.shape[1]) == x).all()
    assert all((a == b) == (u == v) for a, u in zip(data, values) for b, v in zip(data, values))


def test_whitening_against_exact_sums(spark):
    kept, dims = whole(rows())
    got = whitening.whiten(table(spark, rows())).toPandas()
    fit = sorted({x for _, x, _ in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert set(got.n) == {n} and len(got) == 4 * len(kept)
    want = Counter((k, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x, _ in kept)
    first = got[got.component == 1]
    assert Counter((None if math.isnan(k) else int(k), int(d)) for k, d in zip(first.vec_id, first.deviation)) == want
    assert (got.identity_error < 1e-9).all() and set(got.component) == {1, 2, 3, 4}
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    explained = got.groupby("component").explained.agg(["min", "max"])
    assert np.allclose(explained["min"], values[::-1][:4] / values.sum(), rtol=1e-9) and (explained["min"] == explained["max"]).all()
    by_row = got.dropna(subset=["vec_id"]).groupby(["vec_id", "component"]).whitened.first().unstack()
    for c in range(1, 5):
        axis = axes[:, -c] / math.sqrt(values[-c])
        own = {k: sum(float(Fraction(n * a - s, n)) * e for a, s, e in zip(x, sums, axis)) for k, x, _ in kept if k not in (None, 5)}
        ratio = {round(by_row.loc[k, c] / v, 6) for k, v in own.items() if abs(v) > 1e-3}
        assert ratio in ({1.0}, {-1.0})


def test_whitening_of_a_large_mean(spark):
    """Variance of one part in 2**40 of the mean: lost by products that aren't centred first."""
    rng = np.random.default_rng(1)
    data = [(k, [float(2**31 + v) for v in rng.integers(0, 3, 6)], 0) for k in range(300)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(frame).toPandas()
    assert (got.identity_error < 1e-9).all()
    assert abs(got[got.vec_id == 0].explained.sum() - 1) < 0.4
    kept, dims = whole(data)
    fit = sorted({x for _, x, _ in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert dict(zip(got.vec_id, got.deviation)) == {k: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for k, x, _ in kept}


def test_whitening_without_variance(spark):
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], None)])).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one) == [(v, c, 1, 0, None, 0.0, 0.0) for v in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 7.0], 0) for k in range(9)])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all()
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None, 0), (2, [], 0)])).count() == 0


def brute_codes(data, parts, entries, rounds):
    kept, dims = whole(data)
    size = -(-dims // parts)
    kept = [(k, x + (0,) * (parts * size - dims), label) for k, x, label in kept]
    # equal keys: by the packed vector, as the docstring says "by their vectors"
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    cut = lambda x: [x[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(x)[p] for _, x, _ in order[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        own = [defaultdict(list) for _ in range(parts)]
        for _, x, _ in kept:
            for p, v in enumerate(cut(x)):
                own[p][near(v, books[p])[1]].append(v)
        books = [[[sum(c) // len(own[p][e]) for c in zip(*own[p][e])] if own[p][e] else list(c) for e, c in enumerate(book)] for p, book in enumerate(books)]
    out, by_label = [], Counter()
    for k, x, label in kept:
        found = [near(v, books[p]) for p, v in enumerate(cut(x))]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((k, "".join(f"{e:02x}" for _, e in found), error, label))
    return Counter((k, code, error, by_label[label]) for k, code, error, label in out), vector_codes.digest(np.array(books))


def test_codes_against_brute_force(spark):
    for parts, entries, rounds, data in ((16, 64, 2, rows()), (3, 8, 1, rows(seed=9, n=40, dims=10)), (4, 50, 3, rows(seed=2, n=20, dims=4, spread=0.01))):
        data = [r for r in data if r[0] != 5 or r[2] != 2]  # one order of the first rows
        got = vector_codes.compress(table(spark, data), parts, entries, rounds).collect()
        want, sha = brute_codes(data, parts, entries, rounds)
        assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
        assert {r.codebooks_sha256 for r in got} == {sha}


def test_codes_of_little(spark):
    assert vector_codes.compress(table(spark, [])).count() == 0
    assert vector_codes.compress(table(spark, [(1, None, 0)])).count() == 0
    got = vector_codes.compress(table(spark, [(1, [], 0), (2, [], None), (2, [], None)])).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(k, "00" * 16, 0, 0) for k in (1, 2, 2)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 40), st.integers(0, 2**32))
def test_nearest_is_exact(dims, entries, bits, seed):
    """Also where float32 can't tell entries apart, and with ties."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**bits), 2**bits + 1, dims)
    c = base + rng.integers(-2, 3, (entries, dims))
    x = base + rng.integers(-2, 3, (30, dims))
    index, d = vector_codes.nearest(x, c)
    for row, e, own in zip(x.tolist(), index.tolist(), d.tolist()):
        assert (own, e) == min((sum((a - b) ** 2 for a, b in zip(row, entry)), k) for k, entry in enumerate(c.tolist()))


def test_screening_is_rigorous_and_tight():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-100, 100, (2000, 4)), rng.integers(-100, 100, (64, 4))
    possible = vector_codes.screened(x, c)
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert possible[np.arange(len(x)), exact.argmin(axis=1)].all()
    assert possible.sum() < 1.2 * len(x)
    huge = np.array([[2**61, 0]])
    assert vector_codes.nearest(huge, np.array([[0, 0], [2**61, 1], [2**61, -1]]))[0].tolist() == [1]


@pytest.mark.parametrize("bad", [1e30, -1e300, 1.7e308])
def test_entries_that_a_long_cannot_hold(bad):
    with pytest.raises(ArithmeticError):
        vectors.whole(pa.array([[bad]], pa.list_(pa.float64())))
