import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.operators import conflicts as X
from claimgraph.operators import retrieval as R
from claimgraph.operators import similarity as V


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    """Tight groups, strays and a third of the rows as copies of one vector."""
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(12, 16)))
    grouped = unit(centres[rng.integers(0, 12, 300)] + 0.12 * rng.normal(size=(300, 16)))
    strays = unit(rng.normal(size=(60, 16)))
    copies = np.repeat(grouped[:1], 180, axis=0)
    return np.vstack([grouped, strays, copies]).astype(np.float32)


def frame(spark, vectors, id_name="vec_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{id_name} bigint, vector array<float>").repartition(5)


def scores_of(left, right):
    return np.round(unit(left.astype(np.float64)) @ unit(right.astype(np.float64)).T, V.SCORE_DIGITS)


def best(scores, ids, k):
    return [i for _, i in sorted((-s, i) for s, i in zip(scores, ids))[:k]]


def search(spark, points, k=7):
    queries = spark.createDataFrame([(q, q % 2, points[q * 11].tolist()) for q in range(20)], "query_id bigint, want int, vector array<float>")
    items = frame(spark, points, "item_id").withColumn("ties", F.array(
        F.col("item_id"), F.when(F.col("item_id") % 3 == 0, F.col("item_id"))))
    got = {}
    for r in V.top_k(queries, items, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    for q in range(20):
        ids = [i for i in range(len(points)) if q % 2 == 0 or i % 3 == 0]
        s = scores_of(points[q * 11:q * 11 + 1], points)[0]
        assert got[q] == best(s[ids], ids, k), q


def test_top_k_matches_brute_force(spark, points):
    search(spark, points)


def test_top_k_in_blocks_matches_brute_force(spark, points, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_BYTES", 5 * 8 * points.shape[1])
    search(spark, points)
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "STATE_BYTES", 1)
    search(spark, points)


def test_more_wanted_than_there_are(spark):
    vectors = np.eye(3, dtype=np.float32)
    items = frame(spark, vectors, "item_id").withColumn("ties", F.array("item_id"))
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0])], "query_id bigint, want int, vector array<float>")
    assert [r.item_id for r in V.top_k(queries, items, 10).orderBy("rank").collect()] == [0, 1, 2]
    assert V.top_k(queries.limit(0), items, 10).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.82, 0.95])
@pytest.mark.parametrize("pivots,block_rows", [(4, 20_000), (40, 37)])
def test_similarity_join_is_exact(spark, points, threshold, pivots, block_rows):
    distinct = points[:360]
    got = {(r.left_id, r.right_id) for r in V.similar_vectors(frame(spark, distinct), threshold, pivots, block_rows=block_rows).collect()}
    s = scores_of(distinct, distinct)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= threshold))}


def test_chunk_neighbours_match_brute_force_with_a_third_of_copies(spark, points):
    rows = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(points)], "chunk_id bigint, document_id bigint, vector array<float>")
    got = {(r.chunk_a, r.chunk_b) for r in X.chunk_neighbours(rows).collect()}
    s = scores_of(points, points)
    want = set()
    for i in range(len(points)):
        ids = [j for j in range(len(points)) if s[i, j] >= 0.82]
        want |= {(i, j) for j in best(s[i, ids], ids, 6) if j != i and j // 4 != i // 4}
    assert got == want


def test_assertions_of_a_crowded_chunk(spark):
    """A chunk with most assertions hands on no more than k of them."""
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.8, 0.6]), (3, 3, [0.0, 1.0])], "chunk_id bigint, document_id bigint, vector array<float>")
    rows = [(100 + i, 2, "normative" if i % 2 else "constative") for i in range(50)] + [(1, 1, "constative"), (2, 3, "normative")]
    claims = spark.createDataFrame(rows, "assertion_id bigint, chunk_id bigint, validity_claim_type string")
    queries = spark.createDataFrame([(7, "mixed", [1.0, 0.0])], "query_id bigint, epistemic_type string, vector array<float>")
    got = {}
    for r in R.top_assertions(R.requests_for(queries), claims, vectors, 4).orderBy("want", "rank").collect():
        got.setdefault(r.want, []).append(r.assertion_id)
    assert got == {0: [1, 100, 101, 102], 1: [101, 103, 105, 107], 2: [1, 100, 102, 104]}


def test_groups_grow_where_cells_prune_nothing():
    """Without clusters a vector is copied once per block; where few cells are reached groups stay small."""
    sizes, everywhere = np.full(2000, 500), np.ones((50, 2000), dtype=bool)
    grown = V.cell_groups(sizes, everywhere, 2048, 65_536)
    assert 1_000_000 // 65_536 <= grown.max() + 1 <= 1_000_000 // 65_536 + 1
    assert np.bincount(grown, weights=sizes).max() <= 65_536 + 500
    few = np.zeros((50, 2000), dtype=bool)
    few[:, :20] = True
    assert V.cell_groups(sizes, few, 2048, 65_536).max() + 1 > 400


def test_similarity_join_copies_no_blocks(spark, monkeypatch):
    """Blocks that meet are sent piece by piece and not shuffled once per pair; pieces change no result."""
    rng = np.random.default_rng(5)
    vectors = unit(rng.normal(size=(1200, 24))).astype(np.float32)
    joined = V.similar_vectors(frame(spark, vectors), 0.6, pivots=16, block_rows=300, group_rows=300)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "CoGroups" not in text, text
    whole = {(r.left_id, r.right_id, r.score) for r in joined.collect()}
    s = scores_of(vectors, vectors)
    assert {p[:2] for p in whole} == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.6))}
    monkeypatch.setattr(V, "BROADCAST_BYTES", 4 * 24 * 500)
    assert {tuple(r) for r in V.similar_vectors(frame(spark, vectors), 0.6, pivots=16, block_rows=300, group_rows=300).collect()} == whole
    best = {(r.left_id, r.right_id) for r in V.similar_vectors(frame(spark, vectors), 0.6, pivots=16, block_rows=300, group_rows=300, keep=2).collect()}
    assert best == {(int(i), int(j)) for i in range(1200) for j in sorted(np.flatnonzero(s[i] >= 0.6), key=lambda j: (-s[i, j], j))[:2]}


def test_similarity_join_without_clusters_is_exact(spark):
    """Groups as large as blocks, and single precision as a first look, lose no pair and change no score."""
    rng = np.random.default_rng(11)
    vectors = unit(rng.normal(size=(3000, 24))).astype(np.float32)
    got = V.similar_vectors(frame(spark, vectors), 0.6, pivots=16, group_rows=64).collect()
    s = scores_of(vectors, vectors)
    assert {(r.left_id, r.right_id) for r in got} == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.6))}
    assert all(r.score == s[r.left_id, r.right_id] for r in got)


def noisy_copies(rng, directions, copies, dims, noise):
    centres = unit(rng.normal(size=(directions, dims)))
    return unit(np.repeat(centres, copies, axis=0) + noise * unit(rng.normal(size=(directions * copies, dims)))).astype(np.float32)


@pytest.mark.parametrize("dims,noise,share", [(64, 0.47, 0.15), (64, 0.01, 0.15), (6, 0.6, 2.0)])
def test_blocks_meet_once_and_bundle_by_bundle(monkeypatch, dims, noise, share):
    """Vectors of one direction are compared as one; both orders of a pair come from one meeting, and none is lost."""
    vectors = noisy_copies(np.random.default_rng(2), 100, 20, dims, noise)[np.random.default_rng(4).permutation(2000)]
    theta, compared, hits = V._threshold_angle(0.82), [], V._hits

    def counted(strip, tiles):
        compared.append(sum(len(strip) * t[1].shape[1] for t in tiles))
        return hits(strip, tiles)

    monkeypatch.setattr(V, "_hits", counted)
    home, other, ids = vectors[:1000], vectors[1000:], np.arange(2000)
    label = V.bundles(home, min(0.9 * theta, V.BUNDLE_REACH - theta))
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.diff(label[order], prepend=-1))
    centres, least = V._centres(V._unit(home[order]), starts, theta)
    for keep in (None, 3):
        got = {tuple(r) for b in V._near_pairs(ids[:1000][order], home[order], starts, centres, least, ids[1000:], other, other, 0.82, keep, True)
               for r in zip(*(c.to_pylist() for c in b.columns))}
        s = scores_of(vectors, vectors)
        s[:1000, :1000] = s[1000:, 1000:] = -1.0
        assert got == {(i, int(j), s[i, j]) for i in range(2000)
                       for j in sorted(np.flatnonzero(s[i] >= 0.82), key=lambda j: (-s[i, j], j))[:keep]}
    assert sum(compared) <= 2 * share * 1000 * 1000


@pytest.mark.parametrize("both", [True, False])
def test_pairs_that_can_not_be_kept_are_not_held(monkeypatch, both):
    """Of a crowd in one direction each block reports every vector's best partners, ties by the smaller id."""
    vectors = noisy_copies(np.random.default_rng(6), 2, 300, 16, 0.2)
    vectors[300:600:7] = vectors[300]
    home, other, ids = vectors[::2], vectors[1::2], np.arange(600)
    unit_a, starts = V._unit(home), np.array([0, 150])
    centres, least = V._centres(unit_a, starts, V._threshold_angle(0.82))
    monkeypatch.setattr(V, "HELD_PAIRS", 2000)
    found = [r for b in V._near_pairs(ids[::2], home, starts, centres, least, ids[1::2], other, V._unit(other).astype(np.float32), 0.82, 3, both)
             for r in zip(*(c.to_pylist() for c in b.columns))]
    s = scores_of(vectors, vectors)
    s[::2, ::2] = s[1::2, 1::2] = -1.0
    got = {}
    for a, b, score in set(found):
        assert score == s[a, b]
        got.setdefault(a, []).append((-score, b))
    for i in range(600) if both else range(0, 600, 2):
        assert sorted(got[i])[:3] == sorted((-s[i, j], int(j)) for j in np.flatnonzero(s[i] >= 0.82))[:3]
    assert both or set(got) <= set(range(0, 600, 2))
    assert len(found) < (s >= 0.82).sum() / 4


def test_vectors_dealt_out_again_by_bundles_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = np.vstack([noisy_copies(rng, 150, 8, 32, 0.47), unit(rng.normal(size=(300, 32))).astype(np.float32)])
    turns, regroup = [], V._regroup
    monkeypatch.setattr(V, "_regroup", lambda points, widest: turns.append(len(points)) or regroup(points, widest))
    monkeypatch.setattr(V, "REGROUP_ROWS", 100)
    monkeypatch.setattr(V, "VISITS", 2)
    monkeypatch.setattr(V, "PIECE_BYTES", 4 * 32 * 500)
    monkeypatch.setattr(V, "FOLD", 0)
    got = V.similar_vectors(frame(spark, vectors), 0.82, pivots=32, group_rows=100, block_rows=200).collect()
    s = scores_of(vectors, vectors)
    assert len(turns) == V.REGROUPINGS
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == {(int(i), int(j), s[i, j]) for i, j in zip(*np.nonzero(s >= 0.82))}
    best = {(r.left_id, r.right_id) for r in V.similar_vectors(frame(spark, vectors), 0.82, pivots=32, group_rows=100, block_rows=200, keep=3).collect()}
    assert best == {(i, int(j)) for i in range(len(vectors)) for j in sorted(np.flatnonzero(s[i] >= 0.82), key=lambda j: (-s[i, j], j))[:3]}
