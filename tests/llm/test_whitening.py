"""Whitening against a direct decomposition, rank-one updates, odd rows."""

import math

import numpy as np
import pytest

from claimgraph.llm import queries, whitening
from claimgraph.llm.whitening import Spectrum, fit, quantised, report, secular_roots, update

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string, deviation int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(k, v, 1, "clash", 2) for k, v in enumerate(vectors)], SCHEMA).repartition(parts)


def direct(vectors):
    """Quantised vectors, their distinct list, and its spectrum by falling eigenvalue."""
    x = np.array([[math.floor(64 * np.float32(c).astype(float)) + 1_000_000 for c in v] for v in vectors])
    listed = np.unique(x, axis=0)
    centred = listed - listed.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(listed))
    return x, listed, values[::-1], vectors[:, ::-1]


def compare(rows, vectors, ids, components):
    x, listed, values, turn = direct(vectors)
    n, total = len(listed), listed.sum(axis=0)
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == len(ids) * components
    whitened = (x - total / n) @ turn[:, :components] / np.sqrt(values[:components])
    mine = np.array([[found[i, c + 1].whitened for c in range(components)] for i in ids])
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * sign - whitened).max() < 1e-8
    for k, i in enumerate(ids):
        r = found[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], total, strict=True))
        assert abs(r.explained - values[0] / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_against_a_direct_decomposition(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = docs.select("vec_id", "embedding").collect()
    compare(queries.op12_whitening(spark, "/root/testdata/sf0.01").collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 16)


def test_few_dimensions_repeats_and_unequal_spread(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 5)) * [100, 30, 30, 1, 0.2]).astype(np.float32).tolist()
    vectors += [vectors[0]] * 200
    compare(report(table(spark, vectors, 7)).collect(), vectors, list(range(len(vectors))), 5)


def test_rows_that_cannot_be_used_go(spark):
    good = [[1.0, 2.0, 0.5], [2.0, -1.0, 0.0], [0.0, 3.0, 9.0], [4.0, 4.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    rows = report(table(spark, good + bad)).collect()
    compare(rows, good, range(4), 3)


def test_no_spread_no_rows(spark):
    assert report(table(spark, [[1.0, 2.0]] * 5)).collect() == []
    empty = report(table(spark, [[1.0]]).where("vec_id < 0"))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # Two points have one direction.
    assert {r.component for r in report(table(spark, [[1.0, 2.0], [3.0, 5.0]])).collect()} == {1}


def test_null_and_repeated_ids_repeat(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (5, [3.0, 1.0]), (5, [0.0, 4.0])], "vec_id bigint, embedding array<double>")
    assert sorted((str(r.vec_id), r.component) for r in report(df).collect()) == [
        ("5", 1), ("5", 1), ("5", 2), ("5", 2), ("None", 1), ("None", 2)]


def test_deviations_beyond_63_bits(spark):
    big = [[2.0 ** 40, 0.0], [0.0, 1.0], [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id bigint, embedding array<double>")
    found = {r.vec_id: r.deviation for r in report(df).collect()}
    assert found == {0: None, 1: None, 2: None}
    medium = [[2.0 ** 20, 0.0], [0.0, 1.0], [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(medium)), "vec_id bigint, embedding array<double>")
    x = [[math.floor(64 * c) + 10 ** 6 for c in v] for v in medium]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: r.deviation for r in report(df).collect()} == {
        k: sum((3 * a - s) ** 2 for a, s in zip(v, total, strict=True)) for k, v in enumerate(x)}


@pytest.mark.parametrize("dims", [1, 2, 9, 40])
def test_secular_roots_and_updates(dims):
    rng = np.random.default_rng(dims)
    d, z = np.sort(rng.normal(size=dims)), rng.normal(size=dims) * np.geomspace(1, 1e-6, dims)
    origin, offset = secular_roots(d, z)
    assert np.allclose(d[origin] + offset, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-12, atol=1e-13)
    values, vectors = update(d, np.eye(dims), z)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, np.diag(d) + np.outer(z, z), atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(dims)).max() < 1e-13


def test_equal_eigenvalues_and_unreached_directions_are_deflated():
    values, vectors = update(np.array([0.0, 1.0, 1.0, 1.0, 4.0]), np.eye(5), np.array([0.0, 1.0, 2.0, 2.0, 0.0]))
    assert np.allclose(values, [0, 1, 1, 4, 10]) and np.allclose(vectors.T @ vectors, np.eye(5))
    same, kept = update(values, vectors, np.zeros(5))
    assert same is values and kept is vectors


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_blocks_and_combination_give_one_spectrum(block):
    rng = np.random.default_rng(block)
    x = rng.integers(-3, 4, size=(90, 12)).astype(float)
    x[40:60] = x[0]
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    parts = []
    for part in np.split(x, [30, 31]):
        parts.append(Spectrum(12))
        for at in range(0, len(part), block):
            parts[-1].add(part[at:at + block])
    whole = Spectrum.unpack(parts[0].pack(), 12)
    for other in parts[1:]:
        whole.combine(other)
    assert whole.n == 90 and np.allclose(whole.mean, x.mean(axis=0))
    assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, scatter, atol=1e-9)


def test_many_tasks_are_combined_in_levels(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 4)).tolist()
    found = fit(quantised(table(spark, vectors, 40)).repartition(40))
    _, _, values, _ = direct(vectors)
    assert np.allclose(found.values, values) and whitening.FAN_IN < 40
