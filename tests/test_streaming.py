import datetime as dt
import json

from claimgraph.operators import ledger as L
from claimgraph.streaming import costs as K
from claimgraph.streaming import ingest as I
from claimgraph.streaming import tables

BODY = " ".join(["word"] * 120)


def run(query):
    query.awaitTermination()


def ingest(spark, base):
    run(I.ingest_articles(I.article_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint"))
    read = lambda name, schema: tables.read(spark, f"{base}/out/{name}", schema)
    return read("documents", I.DOCUMENTS), read("chunks", I.CHUNKS), read("rejected", I.REJECTED)


def article(base, name, title, content=BODY):
    (base / "in").mkdir(exist_ok=True)
    (base / "in" / name).write_text(json.dumps({"title": title, "content": content, "url": name}))


def test_ingest_resumes_and_keeps_each_id_once(spark, tmp_path):
    article(tmp_path, "a.json", "Basel I")
    article(tmp_path, "b.json", "Basel II")
    (tmp_path / "in" / "bad.json").write_text("{broken")
    documents, chunks, rejected = ingest(spark, tmp_path)
    assert sorted(r.document_id for r in documents.collect()) == ["Basel_I", "Basel_II"]
    assert rejected.count() == 1 and chunks.count() == 2
    # A restart with a known title, a new one and nothing lost.
    article(tmp_path, "c.json", "Basel I", "other " * 200)
    article(tmp_path, "d.json", "Basel III")
    documents, chunks, rejected = ingest(spark, tmp_path)
    assert sorted(r.document_id for r in documents.collect()) == ["Basel_I", "Basel_II", "Basel_III"]
    assert sorted(r.document_id for r in chunks.collect()) == ["Basel_I", "Basel_II", "Basel_III"]
    assert rejected.count() == 1


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = I.DOCUMENTS
    tables.prepare(spark, path, schema)
    row = spark.createDataFrame([("d", "t", "u", "c", "x")], schema)
    for _ in range(2):
        tables.write_batch(row, path, 0)
    assert tables.read(spark, path, schema).count() == 1
    assert tables.read_before(spark, path, schema, 0).count() == 0


def test_a_broken_answer_does_not_hide_a_good_one(spark, tmp_path):
    good = json.dumps([{"claim_text": "A firm must report.", "subject": "firm", "predicate_type": "requires"}])
    rows = [("c1", "d1", "t", "!broken"), ("c1", "d1", "t", good), ("c2", "d1", "t", "!broken")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, I.RESPONSES).coalesce(1).write.json(source)
    go = lambda: run(I.ingest_responses(I.response_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "check")))
    go()
    stored = spark.read.parquet(str(tmp_path / "out" / "assertions"))
    assert [r.chunk_id for r in stored.collect()] == ["c1"]
    assert [r.chunk_id for r in I.open_failures(spark, str(tmp_path / "out")).collect()] == ["c2"]
    # A later good answer resolves the failure.
    spark.createDataFrame([("c2", "d1", "t", good)], I.RESPONSES).coalesce(1).write.mode("append").json(source)
    go()
    assert I.open_failures(spark, str(tmp_path / "out")).count() == 0


COSTS = "record_id bigint, ts timestamp, model string, stage string, input_tokens bigint, output_tokens bigint"


def calls(spark, path, rows):
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h, m), model, "extract", n, 0) for i, h, m, model, n in rows], COSTS).coalesce(1).write.mode("append").parquet(path)


def test_ceiling_is_found_across_batches(spark, tmp_path):
    path, million = f"{tmp_path}/in", 1_000_000
    prices = L.prices(spark)

    def step():
        stream = spark.readStream.schema(COSTS).parquet(path)
        run(K.watch_ceiling(stream, prices, 2.0, f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
        return [(r.record_id, round(r.running_total, 6)) for r in tables.read(spark, f"{tmp_path}/out/alerts", K.ALERTS).collect()]

    calls(spark, path, [(1, 0, 0, "gemini-1.5-pro", million), (2, 0, 5, "unpriced-model", 50 * million)])
    assert step() == []
    calls(spark, path, [(3, 1, 0, "gemini-1.5-pro", million // 2), (4, 1, 1, "gemini-1.5-pro", million), (5, 2, 0, "gemini-1.5-pro", million)])
    assert step() == [(4, 3.125)]
    calls(spark, path, [(6, 3, 0, "gemini-1.5-pro", million)])
    assert step() == [(4, 3.125)]


def test_spend_closes_windows_and_splits_late_calls_off(spark, tmp_path):
    path, million, prices = f"{tmp_path}/in", 1_000_000, L.prices(spark)
    target = f"{tmp_path}/out"

    def step(*rows):
        calls(spark, path, rows)
        run(K.track_spend(spark.readStream.schema(COSTS).parquet(path), prices, target, f"{tmp_path}/checkpoint"))

    def found(flush):
        return sorted((r.window_start.hour, r.calls, float(r.cost)) for r in K.spend(spark, target, flush).collect())

    step((1, 0, 30, "gemini-1.5-pro", million), (2, 2, 0, "gemini-1.5-pro", million))
    assert found(False) == [] and found(True) == [(0, 1, 1.25), (2, 1, 1.25)]
    # The first window closed at 1:50; the second call of it is late, the one at 1:55 is not.
    step((3, 0, 40, "gemini-1.5-pro", million), (4, 1, 55, "gemini-1.5-pro", 2 * million))
    assert [(r.record_id, r.window_start.hour, float(r.cost), r.batch) for r in K.late_calls(spark, target).collect()] == [(3, 0, 1.25, 1)]
    assert found(False) == [(0, 1, 1.25)] and found(True) == [(0, 1, 1.25), (1, 1, 2.5), (2, 1, 1.25)]
    # A window takes calls of several batches, and a call without a time is late.
    spark.createDataFrame([(5, None, "gemini-1.5-pro", "extract", million, 0)], COSTS).coalesce(1).write.mode("append").parquet(path)
    step((6, 2, 10, "gemini-1.5-pro", million))
    assert sorted(r.record_id for r in K.late_calls(spark, target).collect()) == [3, 5]
    assert found(True) == [(0, 1, 1.25), (1, 1, 2.5), (2, 2, 2.5)]


def test_a_batch_reads_one_row_of_the_batch_before_it(spark, tmp_path, monkeypatch):
    read = []
    plain = tables.read_batch
    monkeypatch.setattr(tables, "read_batch", lambda s, p, schema, b: (read.append((p.rsplit("/", 1)[1], b)), plain(s, p, schema, b))[1])
    monkeypatch.setattr(tables, "read_before", None)
    path, prices = f"{tmp_path}/in", L.prices(spark)
    for hour in range(3):
        calls(spark, path, [(hour, hour, 0, "gemini-1.5-pro", 1_000_000)])
        run(K.track_spend(spark.readStream.schema(COSTS).parquet(path), prices, f"{tmp_path}/out", f"{tmp_path}/a"))
        run(K.watch_ceiling(spark.readStream.schema(COSTS).parquet(path), prices, 3.0, f"{tmp_path}/out", f"{tmp_path}/b"))
    assert sorted(read) == sorted([(name, b) for name in ("marks", "totals") for b in (-1, 0, 1)])
    assert [r.record_id for r in tables.read(spark, f"{tmp_path}/out/alerts", K.ALERTS).collect()] == [2]


def test_ledger_in_batch(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0), "gemini-1.5-flash", "a", 1_000_000, 1_000_000), (2, dt.datetime(2024, 1, 1, 0, 0), "text-embedding-004", "b", 1000, 9),
            (3, dt.datetime(2024, 1, 2, 0, 0), "new-model", "b", 1_000_000, 0), (4, dt.datetime(2024, 1, 3, 0, 0), "gemini-1.5-pro", "a", 1_000_000, 0)]
    priced = L.with_cost(spark.createDataFrame(rows, COSTS), L.prices(spark))
    totals = L.running_total(priced)
    assert [round(r.running_total, 6) for r in totals.orderBy("record_id").collect()] == [0.375, 0.375025, 0.375025, 1.625025]
    assert L.ceiling_crossing(totals, 0.375025).first().record_id == 2
    assert L.ceiling_crossing(totals, 99.0).count() == 0
    assert [r.model for r in L.unpriced_models(priced).collect()] == ["new-model"]


def test_one_moment_with_most_of_the_ledger_is_cut(spark):
    hot = dt.datetime(2024, 1, 1, 5, 0)
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=i), "gemini-1.5-pro", "a", 1_000_000, 0) for i in range(1000)]
    rows += [(5000 + i, hot, "gemini-1.5-pro", "a", 2_000_000, 0) for i in range(4000)]
    priced = L.with_cost(spark.createDataFrame(rows, COSTS), L.prices(spark))
    sizes = [r["count"] for r in priced.groupBy(L.ledger_piece(priced, 32).alias("piece")).count().collect()]
    assert max(sizes) < 5000 / 16
    got = [r.running_total for r in L.running_total(priced).orderBy("ts", "record_id").collect()]
    total, want = 0.0, []
    for _, _, _, _, n, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        total += n / 1_000_000 * 1.25
        want.append(total)
    assert got == want
