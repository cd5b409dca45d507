"""Rendezvous sharding against a plain model: owners, growth, weights, places, odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimgraph.llm import queries, sharding
from claimgraph.llm.sharding import assign, layout, numbered, owner, read_shard, record_key, write_shards


def model_owner(key, weights):
    waits = []
    for s, w in enumerate(weights):
        if w > 0:
            digits = hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13]
            waits.append((-math.log((int(digits, 16) + 0.5) / 16 ** 13) / w, s))
    return min(waits)[1]


def owners(spark, keys, weights):
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.s for r in rows.select("k", owner(F.col("k"), weights).alias("s")).collect()}


@pytest.mark.parametrize("weights", [[1.0], [1.0] * 8, [3.0, 1.0, 0.0, 0.5]])
def test_owner_against_a_model(spark, weights):
    keys = [str(k) for k in range(300)]
    assert owners(spark, keys, weights) == {k: model_owner(k, weights) for k in keys}


def test_shares_follow_weights(spark):
    keys = [str(k) for k in range(8000)]
    found = Counter(owners(spark, keys, [4.0, 2.0, 1.0, 1.0]).values())
    for shard, share in enumerate([0.5, 0.25, 0.125, 0.125]):
        assert abs(found[shard] / 8000 - share) < 0.02


def test_a_further_shard_takes_only_into_itself_and_a_changed_weight_moves_only_that_shard(spark):
    keys = [str(k) for k in range(2000)]
    before, after = owners(spark, keys, [1.0] * 8), owners(spark, keys, [1.0] * 9)
    moved = [k for k in keys if before[k] != after[k]]
    assert {after[k] for k in moved} == {8} and abs(len(moved) / 2000 - 1 / 9) < 0.03
    heavier = owners(spark, keys, [1.0, 2.0] + [1.0] * 6)
    assert {heavier[k] for k in keys if heavier[k] != before[k]} == {1}


@pytest.mark.parametrize("weights", [[], [0.0], [1.0, -1.0]])
def test_weights_without_a_taker_are_refused(spark, weights):
    with pytest.raises(ValueError):
        owner(F.lit("k"), weights)


def test_layout_of_odd_rows(spark, odd_docs):
    rows = odd_docs.collect()
    got = layout(odd_docs, [1.0] * 3, [1.0] * 4).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        key = "null" if r.doc_id is None else r.doc_id
        data = (r.text or "").encode()
        want[r.doc_id, len(data) + 1, zlib.crc32(data), model_owner(key, [1.0] * 3), model_owner(key, [1.0] * 4)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.law for r in got} == {"key"}


def test_no_rows(spark, no_docs):
    got = layout(no_docs, [1.0] * 3)
    assert got.count() == 0 and got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_slots_of_a_record_with_most_rows(spark):
    rows = [("same", 1)] * 2500 + [(str(k), 1) for k in range(300)] + [("other", 2)] * 1001
    got = numbered(spark.createDataFrame(rows, "mark string, shard int"), "shard", "slot").collect()
    assert Counter((r.mark, r.shard) for r in got) == Counter(rows)
    assert sorted(r.slot for r in got if r.shard == 1) == list(range(2800))
    assert sorted(r.slot for r in got if r.shard == 2) == list(range(1001))


def test_places_do_not_depend_on_the_layout_of_the_input(spark, odd_docs):
    def sets(df):
        return Counter(tuple(r) for r in layout(df, [1.0] * 3).collect())
    assert sets(odd_docs) == sets(odd_docs.coalesce(1)) == sets(odd_docs.repartition(7, "n_chars"))


def test_written_shards_hold_whole_rows(spark, odd_docs, tmp_path):
    clash = odd_docs.withColumn("shard", F.lit("mine")).withColumn("grown_shard", F.lit(7))
    folder = str(tmp_path / "shards")
    write_shards(clash, record_key(F.col("doc_id")), [1.0] * 3, folder)
    got = [read_shard(spark, folder, k) for k in range(3)]
    assert all(g.columns == clash.columns for g in got)
    assert sorted((tuple(r) for g in got for r in g.collect()), key=repr) == sorted((tuple(r) for r in clash.collect()), key=repr)
    for k, g in enumerate(got):
        assert all(model_owner("null" if r.doc_id is None else r.doc_id, [1.0] * 3) == k for r in g.collect())


def test_keys_of_several_columns_keep_nulls_apart(spark):
    rows = spark.createDataFrame([(1, None), (1, "x"), (None, "x")], "a int, b string")
    assert len({r.k for r in rows.select(record_key(F.col("a"), F.col("b")).alias("k")).collect()}) == 3


def test_plan_is_native_and_moves_no_text(spark):
    df = assign(queries.table(spark, "/root/testdata/sf0.001", "documents"), record_key(F.col("doc_id")), [1.0] * 8)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = queries.op13_rendezvous_shards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "text#" not in plan.replace("text_crc32", "")
    assert sharding.BLOCK_DIGITS == 3
