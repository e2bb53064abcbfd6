"""Operators on the small cases that their rules are known by, and streams against batches."""

import pytest
from pyspark.sql import functions as F

from quarrylight import model
from quarrylight.operators import classify, federation, identity, keys, planner, telemetry, text, timeline, topology, vectors, workflow
from quarrylight.operators.ranges import earlier
from quarrylight.security import Caller, allowed, glob, valid_scope
from quarrylight.streaming import identity_stream, telemetry_stream

INGEST = "arrival long, event_id long, generation long, epoch long, physical_ms long, flags long, tenant_id long"


def test_ingest_statuses(spark):
    rows = [(1, 1, 1, 9, 1000, 4), (2, 1, 1, 10, 1000, 4), (3, 1, 1, 10, 1000, 4), (4, 2, 2, 12, 1100, 4), (5, 3, 3, 12, 1200, 1), (6, 4, 2, (1 << 62) + 1, 0, 0), (8, 5, 1000, 12, 0, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], INGEST)
    got = [r["status"] for r in identity.ingest_status(df, "tenant_id", start_epoch=10).orderBy("arrival").collect()]
    assert got == ["STALE_FENCING_EPOCH", "OK", "DUPLICATE", "OK", "TOMBSTONE_APPLIED", "CORRUPT", "OK"]


def test_a_duplicate_with_a_higher_epoch_leaves_the_fence(spark):
    import pandas as pd

    rows = pd.DataFrame([(1, 1, 1, 0), (1, 9, 1, 0), (2, 2, 1, 0)], columns=["event_id", "epoch", "generation", "flags"])
    assert identity_stream.decide(rows, 0, {})[0] == ["OK", "DUPLICATE", "OK"]


def test_batch_statuses_are_those_of_record_after_record(spark):
    import random

    import pandas as pd

    rng = random.Random(7)
    rows = [(i, rng.randint(0, 60), 1, rng.choice([1, 1, 2, 3, 5 + i // 60, (1 << 62) + 1]), 0, rng.choice([0, 1]), rng.choice([1, 1, 1, 2])) for i in range(400)]
    got = {r["arrival"]: r["status"] for r in identity.ingest_status(spark.createDataFrame(rows, INGEST), "tenant_id").collect()}
    for tenant in (1, 2):
        own = pd.DataFrame([r for r in rows if r[6] == tenant], columns=[c.split()[0] for c in INGEST.split(", ")])
        assert [got[a] for a in own["arrival"]] == identity_stream.decide(own, 0, {})[0]
    assert set(got.values()) == {"CORRUPT", "STALE_FENCING_EPOCH", "DUPLICATE", "TOMBSTONE_APPLIED", "OK"}


def test_running_figures_of_a_hot_series(spark):
    rows = [("hot" if i % 10 else None, (i * 37) % 1000, float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(7)
    got = earlier(df, ["k"], "at", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).collect()
    want = {}
    for k in ("hot", None):
        total, most = None, None
        for _, at, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want[k, at] = (total, most)
            total, most = (total or 0) + v, max(most or 0, v)
    assert {(r["k"], r["at"]): (r["s"], r["m"]) for r in got} == want
    assert not earlier(df.where("at < 0"), ["k"], "at", {"s": ("sum", F.col("v"))}).count()
    samples = spark.createDataFrame([(1, "m", i, float(i % 5), i) for i in range(50)], "node_id long, metric string, physical_ms long, value double, arrival long")
    folded = 0.0
    for i in range(50):
        folded = 0.2 * (i % 5) + 0.8 * folded if i else 0.0
    assert abs(telemetry.ewma(samples).first()["ewma"] - folded) < 1e-9


def test_object_ids(spark):
    def fnv(h, data):
        for b in data:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return h

    rows = [(1, "abc"), (1, ""), (70000, "é" * 40), (2, "abc"), (None, "x"), (3, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t long, r string").select(model.object_id(F.col("t"), F.col("r"))).collect()]
    for (t, r), value in zip(rows[:4], got):
        raw = b"DIRECTEYE-CANONICAL-v1" + t.to_bytes(4, "big") + r.encode()
        a, b = (fnv(start, raw) for start in (14695981039346656037, 7809847782465536322))
        a, b = a & ~(0xF << 12) | 5 << 12, b & ((1 << 62) - 1) | 1 << 63
        text = f"{a:016x}{b:016x}"
        assert value == "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))
    assert got[4:] == [None, None]


def test_artifacts(spark):
    cases = {
        "Mail A.b@C.org:Pa$s|x http://us@host.io:8/x?Q rest": [("email", 5, "a.b@c.org"), ("password", 15, "Pa$s"), ("url", 22, "http://us"), ("email", 29, "us@host.io"), ("password", 40, "8/x?Q")],
        "a@b@c.de": [("email", 2, "b@c.de")],
        "é x@y.zz;": [("email", 3, "x@y.zz")],
        "http HTTPS://A.b @.c a@b": [("url", 5, "https://a.b")],
        "": [],
    }
    docs = spark.createDataFrame(list(enumerate([*cases, None])), "doc_id long, text string")
    got = text.artifacts(docs).collect()
    for i, want in enumerate(cases.values()):
        assert [(r["kind"], r["byte_offset"], r["value"]) for r in got if r["doc_id"] == i] == want
    raw = spark.createDataFrame([(b"0123456789abc\ndef",), (b"x" * 300 + b"HIT" + b"y" * 300,), (b"ab",)], "r binary")
    shown = [r[0] for r in raw.select(text.model_context(F.col("r"), F.lit(11), F.lit(2))).collect()]
    assert tuple(shown[0]) == ("bc", "0123456789a", " def", True) and shown[2] is None
    wide = raw.select(text.model_context(F.col("r"), F.lit(300), F.lit(3))).collect()[1][0]
    assert wide["artifact"] == "HIT" and len(wide["pre"]) == len(wide["post"]) == 255 and not wide["is_truncated"]


def test_nearest_is_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(900, None), (901, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = table.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    x = {i: np.array(v) for i, v in rows if v is not None}
    for metric in ("cosine", "l2", "dot"):
        def far(a, b):
            if metric == "l2":
                return ((a - b) ** 2).sum()
            unit = [v / np.linalg.norm(v) if metric == "cosine" and v.any() else v for v in (a, b)]
            return 1 - unit[0] @ unit[1] if metric == "cosine" else -(a @ b)

        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.nearest(table, asked, 4, metric).collect()}
        for q in range(10):
            assert [got[q, k] for k in (1, 2, 3, 4)] == [i for _, i in sorted((round(float(far(x[i], x[q])), 9), i) for i in x)[:4]]
    assert vectors.nearest(table, asked.where("query_id < 0"), 4).count() == 0


TIMES = "physical_ms long, logical long, node_id long, object_id long, flags long, arrival long"


def test_timeline(spark):
    rows = [(1_000_000 + 10 * i, 0, 1, i % 2, 1 if i % 50 == 0 else 0, i) for i in range(1000)]
    t = spark.createDataFrame(rows, TIMES)
    assert timeline.in_range(t, 1_000_100, 1_000_500).count() == 41
    assert timeline.history(t, 0, 1_000_100, 1_000_500).count() == 21
    assert [r["physical_ms"] for r in timeline.latest(t, 10).collect()] == list(range(1_009_990, 1_009_890, -10))
    assert [r["event_count"] for r in timeline.buckets(t, 1_000_000, 1_000_500, 100).orderBy("bucket_start_ms").collect()] == [10] * 5
    assert timeline.buckets(t, 0, 1000, 100).count() == 10 and timeline.buckets(t, 0, 1000, 100, most=3).count() == 3


def test_deleted_as_of(spark):
    rows = [(6_000_100, 4), (6_000_200, 4), (6_000_300, 1), (6_000_400, 4)]
    t = spark.createDataFrame([(ms, 0, 1, 1, f, i) for i, (ms, f) in enumerate(rows)], TIMES)
    for bound, deleted, active in ((6_000_250, False, 2), (6_000_350, True, 0), (6_000_400, False, 4)):
        assert timeline.deleted_as_of(t, bound).first()["is_deleted"] == deleted
        assert timeline.active_history(t, bound).count() == active


def test_key_search(spark):
    cases = [([-12, -4, 0, 9, 17, 32], [-12, -5, 0, 31, 32, 100], [0, None, 2, None, 5, None]), ([-3, 0, 5, 9, 11], [5, 5, 7, 7, 11, 11], [2, 2, None, None, 4, 4]), ([1, 3, 3, 3, 5, 7, 9], [3, 3, 4, 7], [1, 1, None, 5])]
    for data, wanted, places in cases:
        table = spark.createDataFrame([(x,) for x in data], "k long")
        queries = spark.createDataFrame(list(enumerate(wanted)), "q long, w long")
        got = {r["q"]: r["ordinal"] for r in keys.batch_search(table, "k", queries, "w").collect()}
        assert [got[i] for i in range(len(wanted))] == places


def test_labels(spark):
    rows = [(1, 1, 0, 0), (3, 1, 0, 0), (1, 2, 0, 0), (1, 0, 32, 0), (1, 1, 0, 4), (0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "classification long, tenant_id long, flags long, sci long")

    def seen(caller, **more):
        return [r[0] for r in df.select(allowed(caller, **more)).collect()]

    assert seen(None) == [False] * 6
    assert seen(Caller(2, 1, 3)) == [True, False, False, False, False, True]
    assert seen(Caller(3, 1, 7)) == [True, True, False, True, True, True]
    assert seen(Caller(2, 1, 3), shared_tenant=False) == [True, False, False, False, False, False]
    with pytest.raises(PermissionError):
        Caller(1, 1, 1).narrowed(2, 1, 0)
    assert Caller(3, 1, 7).narrowed(1, 1, 2) == Caller(1, 1, 2)


def test_scopes_and_globs(spark):
    df = spark.createDataFrame([("p", "w", None, None), ("p", None, "s", None), ("p!", None, None, None), (None, None, None, None)], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(valid_scope(*map(F.col, "abcd"))).collect()] == [True, False, False, False]
    names = spark.createDataFrame([("a.csv",), ("acsv",), ("b.csv.x",)], "n string")
    assert [r[0] for r in names.select(glob(F.col("n"), "*.c?v")).collect()] == [True, False, False]


def test_clock_update(spark):
    clock = "struct<physical_ms:long,logical:long,node_id:long>"
    df = spark.createDataFrame([(5, (9, 2, 1), (9, 7, 2)), (50, (9, 2, 1), (9, 7, 2)), (5, (9, 2, 1), (8, 7, 2))], f"wall long, local {clock}, remote {clock}")
    assert [tuple(r[0]) for r in df.select(model.hlc_update(F.col("wall"), F.col("local"), F.col("remote"))).collect()] == [(9, 8, 1), (50, 0, 1), (9, 3, 1)]


def test_chains_and_domains(spark):
    edges = topology.edges(spark.createDataFrame([("a", "b", 2, 1), ("b", "c", 2, 2), ("b", "x", 2, 3), ("a", "b", 2, 9), ("v", "n1", 1, 4), ("z", "z", 0, 5), ("c", "a", 2, 6)], "src string, dst string, edge_type int, seq long"))
    assert edges.count() == 5
    chain = topology.dependency_chains(edges, spark.createDataFrame([("a",)], "start string"), 4).orderBy("hop")
    assert [r["node"] for r in chain.collect()] == ["b", "c", "a", "b"]
    assert {r["node"] for r in topology.dependencies(edges, spark.createDataFrame([("a",)], "start string"), 4).collect()} == {"a", "b", "c", "x"}
    gone = spark.createDataFrame([("a", "b", 0)], "src string, dst string, edge_type int")
    assert topology.removed(edges, gone).count() == 4


def test_placement(spark):
    nodes = spark.createDataFrame(
        [(1, 7, 131072, 122880, 64, 15.0, 42.0, 1, 101, 3, 0), (2, 1, 32768, 8192, 16, 75.0, 72.0, 1, 101, 1, 0), (3, 3, 65536, 51200, 32, 25.0, 48.0, 2, 102, 2, 0)],
        "node_id long, isa_features long, ram_total_mb long, ram_available_mb long, cpu_cores long, cpu_usage_pct double, temperature_c double, numa_nodes long, domain_id long, classification long, compartment_mask long",
    )
    q = planner.Placement(classification=2, isa=2, ram_mb=32768)
    rows = planner.plan(nodes, q, 10).collect()
    assert [r["node_id"] for r in rows] == [1, 3] and rows[0]["score"] > rows[1]["score"] and all(c["satisfied"] for c in rows[0]["constraints"])
    assert [r["node_id"] for r in planner.plan(nodes, planner.Placement(2, 0, 2, 32768, avoid_domain=101), 10).collect()] == [3]


def test_domains_of_hosted_resources_and_registered_nodes(spark):
    nodes = spark.createDataFrame([(1, 101), (2, 102)], "node_id long, domain_id long")
    hosts = spark.createDataFrame([(50, 2, 3), (50, 1, 9)], "src long, dst long, seq long")
    assert [planner.domain_of(r, nodes, hosts) for r in (1, 50, 77)] == [101, 102, None]
    beats = spark.createDataFrame([(1, 10, "ok"), (1, 20, "down"), (2, 5, "ok")], "node_id long, heartbeat_ms long, health string")
    assert {r["node_id"]: r["health"] for r in federation.registered(beats).collect()} == {1: "down", 2: "ok"}


def test_reports(spark):
    t = spark.createDataFrame([(5, 0, 1, 7, 0, 1), (6, 0, 1, 7, 0, 2), (6, 1, 1, 8, 0, 3)], TIMES)
    assert timeline.activity_report(t, 0, 10).first()[0] == "10 ms: 3 events, most by 7 (2)"


def test_telemetry_thresholds_and_windows(spark):
    limits = spark.createDataFrame([("cpu", 85.0, 95.0, 3.0, False), ("errors", 1.0, 3.0, 3.0, True), ("latency", 0.0, 0.0, 3.0, False)], "metric string, warning double, critical double, z_limit double, is_fatal boolean")
    rows = [(1, "cpu", ms, 40.0 + (ms // 1000) % 3) for ms in range(1000, 11000, 1000)] + [(1, "cpu", 11000, 88.0), (1, "cpu", 12000, 97.0), (1, "errors", 13000, 4.0)]
    rows += [(1, "latency", ms, 1000.0 + (ms // 1000 % 5) * 4) for ms in range(1000, 21000, 1000)] + [(1, "latency", 21000, 1500.0)]
    s = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "node_id long, metric string, physical_ms long, value double, arrival long")
    got = {(r["metric"], r["physical_ms"]): r["severity"] for r in telemetry.classified(telemetry.baselines(s), limits).collect()}
    assert got == {("cpu", 11000): "WARNING", ("cpu", 12000): "CRITICAL", ("errors", 13000): "FATAL", ("latency", 21000): "CRITICAL"}
    ramp = spark.createDataFrame([(1, "t", 1000 * i, 10.0 + i, i) for i in range(60)], s.schema)
    f = telemetry.window_features(ramp, telemetry.WINDOWS_MS["1m"]).first()
    assert (f["n"], f["min"], f["max"], f["mean"], round(f["slope"], 9)) == (60, 10.0, 69.0, 39.5, 1.0)


def test_trigrams_and_search(spark):
    docs = spark.createDataFrame([(0, "The quick brown fox jumps over the lazy dog"), (1, "An interpolation search engine for sorted int64"), (2, "Trigram index accelerates regex search across text files"), (3, "High-performance SIMD search and data ingestion"), (4, "ab"), (5, None)], "doc_id long, text string")
    sizes = spark.createDataFrame([("hello world",), ("aaaaa",), ("ab",), ("é",)], "t string").select(F.size(text.grams(F.col("t"))))
    assert [r[0] for r in sizes.collect()] == [9, 1, 0, 0]
    for pattern, fold, hits in (("search", False, [1, 2, 3]), ("nothing of the sort", False, []), ("FOX", True, [0]), ("SEARCH", True, [1, 2, 3]), ("", False, [])):
        for posted in (None, text.postings(docs, fold)):
            assert sorted(r["doc_id"] for r in text.search(docs, pattern, fold, posted).collect()) == hits
    assert text.candidates(text.postings(docs), docs, "ab").count() == 6
    lines = spark.createDataFrame([(1, "one\r\ntwo one\n\nOne")], "doc_id long, text string")
    assert [tuple(r) for r in text.grep(lines, "one").collect()] == [(1, 1, "one"), (1, 2, "two one")]
    assert text.grep_counts(lines, "ONE", True).first()["matches"] == 3


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 1.0], 1), (3, [0.0, 2.0], 1), (4, [-1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = table.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert [r["vec_id"] for r in vectors.nearest(table, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    planes = vectors.hyperplanes(2, 6, 3)
    assert vectors.lsh_nearest(table, q, 1, planes).first()["vec_id"] == 1
    with pytest.raises(ValueError):
        vectors.scoped(table, [1.0, 0.0], 1, F.lit(True), 1, 2)
    bad = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0, 2.0],)], "embedding array<float>")
    assert [r[0] for r in bad.select(vectors.valid_vectors(None)).collect()] == [False, False, True]


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.nearest(table, q, 5).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in vectors.lsh_nearest(table, q, 5, vectors.hyperplanes(16, 12, 6)).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_registered_lsh_recall_and_few_candidates(spark):
    from quarrylight.plans import catalog

    exact, near = ({(r["query_id"], r["vec_id"]) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} for name in ("knn_exact", "lsh_nearest"))
    assert len(exact & near) >= 0.9 * len(exact)
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.1]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = table.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert vectors.lsh_nearest(table, q, 3, vectors.hyperplanes(2, 1, 8), probes=0).count() == 3


def test_lsh_finds_as_by_buckets_and_shuffles_no_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 8))
    v[100:400] = v[100]  # many equal distances
    v[7] = 0
    planes = np.array(vectors.hyperplanes(8, 1, 9))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "vec_id long, embedding array<double>").repartition(5)
    q = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vectors.lsh_nearest(table, q, 4, planes.tolist(), probes=3)
    u = v / np.where((n := np.linalg.norm(v, axis=1)) > 0, n, 1)[:, None]
    on = np.einsum("nd,tbd->ntb", u, planes) >= 0
    key = (on * (1 << np.arange(9))).sum(2)
    want, exact = set(), 0
    for i in range(0, 900, 20):
        d = (1 - u @ u[i]).round(12)
        near = [j for j in range(900) if any(key[j, t] ^ key[i, t] in (0, 1, 2, 4) for t in range(1))]
        exact += len(near) < 4
        want |= {(i, j, r) for r, j in enumerate(sorted(near if len(near) >= 4 else range(900), key=lambda j: (d[j], j))[:4], 1)}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want
    assert exact
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_workflow_pages(spark):
    rows = [(i, i, 1, 2, 7, 0, 0, 0, due, False) for i, due in enumerate([500, 200, 800, 500, 100], 1)] + [(6, 6, 1, 3, 7, 0, 0, 0, 500, False), (7, 7, 2, 2, 7, 0, 0, 0, 50, False)]
    events = spark.createDataFrame(rows, "committed_seq long, record_id long, owner_id long, workflow_type long, tenant_id long, classification long, sci long, flags long, due_at long, tombstone boolean")
    entries = workflow.state(events)
    seen, cursor = [], None
    while True:
        page = workflow.page(entries, 7, 2, 1, 2, F.lit(True), after=cursor).orderBy("due_at", "record_id").collect()
        seen += [r["due_at"] for r in page]
        if not page[-1]["has_more"]:
            break
        cursor = (page[-1]["due_at"], page[-1]["record_id"])
    assert seen == [100, 200, 500, 500, 800]
    with pytest.raises(workflow.Stale):
        workflow.page(entries, 7, 2, 1, 2, F.lit(True), watermark=7, required=8)
    assert [workflow.batch_status(7, *x) for x in ((5, 7), (7, 9), (8, 9))] == ["DUPLICATE", "OK", "GAP"]


def run_stream(spark, df, transform, tmp_path, name, pieces=3):
    folder = f"{tmp_path}/{name}"
    rows = df.orderBy("arrival").toPandas()
    step = -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = f"{tmp_path}/{name}-out"
    q = transform(stream).writeStream.foreachBatch(identity_stream.sink(out)).option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out).drop("batch")


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300")
    samples = telemetry.samples(events)
    batch = {r["arrival"]: r["z"] for r in telemetry.baselines(samples).collect()}
    stream = {r["arrival"]: r["z"] for r in run_stream(spark, samples, telemetry_stream.baselines, tmp_path, "telemetry").collect()}
    assert batch.keys() == stream.keys()
    assert all((a is None and stream[k] is None) or abs(a - stream[k]) < 1e-6 for k, a in batch.items())
    records = model.records(events).select("arrival", "event_id", "generation", "epoch", "physical_ms", "flags", "tenant_id")
    records = records.unionByName(records.where("event_id % 10 = 3").withColumn("arrival", F.col("arrival") + 1000))
    batch = {r["arrival"]: r["status"] for r in identity.ingest_status(records, "tenant_id").collect()}
    assert batch == {r["arrival"]: r["status"] for r in run_stream(spark, records, identity_stream.ingest, tmp_path, "ingest").collect()}


def test_classifier_learns_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model_ = classify.train(docs.where("doc_id % 4 <> 0"), "text", "lang")
    held = docs.where("doc_id % 4 = 0").select("lang", classify.classified(model_, F.col("text")).alias("found"))
    assert held.agg(F.avg((F.col("found.label") == F.col("lang")).cast("double"))).first()[0] > 0.9
    odd = spark.createDataFrame([(None,), ("",)], "t string").select(classify.classified(model_, F.col("t")).alias("f"))
    assert [r["f"]["label"] for r in odd.collect()] == ["UNKNOWN"] * 2


def test_classifier_takes_its_sample_by_hash_and_no_text(spark):
    import numpy as np

    rows = [(f"{lang} {i % 700} " + "ab cd"[i % 3 :] * (i % 50), lang) for i in range(3000) for lang in ("en", "de")] + [("x" * 40, "en")] * 500 + [("n", None), (None, "de"), ("", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    plain = docs.where("lang is not null").select("text", "lang", F.xxhash64("text").alias("hash")).toPandas().sort_values(["hash", "lang"])
    for limit in (50, 900, 10_000):
        sample = classify._sample(docs, "text", "lang", limit)
        assert "text" not in sample and len(sample) <= limit + 60
        at = np.repeat(np.arange(len(sample)), sample["n"])[:limit]
        want = plain.head(limit)
        assert sample["hash"].to_numpy()[at].tolist() == want["hash"].tolist()
        assert sample["label"].to_numpy()[at].tolist() == want["lang"].tolist()
        assert np.array_equal(np.stack(sample["features"].to_list())[at], np.stack([classify.features(t) for t in want["text"]]))
    assert classify.train(docs, "text", "lang", 900, steps=3).labels == sorted(set(plain.head(900)["lang"]))
    assert classify.train(docs.where("lang = 'none'"), "text", "lang").labels == []


def test_a_hot_string_is_looked_up_by_several_tasks(spark):
    from quarrylight.operators import keys

    table = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 900), (None, 901)], "s string, at long").coalesce(1)
    wanted = spark.createDataFrame([(i, "a") for i in range(200)] + [(7, "a"), (500, "b"), (501, "c"), (502, None)], "k long, q string").coalesce(1)
    found = keys.lookup_all(table, "s", "at", wanted, "q")
    assert found.columns == ["k", "q", "offset"]
    assert sorted(tuple(r) for r in found.collect()) == sorted([(i, "a", j) for i in [*range(200), 7] for j in range(300)] + [(500, "b", 900)])
    assert found.where("q = 'a'").select(F.spark_partition_id()).distinct().count() > 1


def test_lookup_all_gives_every_pair_and_shuffles_packs(spark):
    from quarrylight.operators import keys

    def shuffled():
        """Rows that each stage so far has shuffled, by its id."""
        jvm = spark.sparkContext._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    sizes = {"hot": (2000, 1500), "one query": (70_000, 1), "one place": (1, 3000), "not asked": (20_000, 0), "not there": (0, 4000), "even": (255, 1), "few": (3, 2)}
    table = spark.createDataFrame([(s, None if i == 5 else i // 2 * 2) for s, (n, _) in sizes.items() for i in range(n)] + [(None, 1)], "s string, at long")
    wanted = spark.createDataFrame([(i // 3, s) for s, (_, m) in sizes.items() for i in range(m)] + [(1, None)], "k long, q string")
    found = keys.lookup_all(table, "s", "at", wanted, "q").groupBy("k", "q", "offset").count().localCheckpoint()
    plain = wanted.join(table, F.col("q") == F.col("s")).groupBy("k", "q", F.col("at").alias("offset")).count()
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert found.agg(F.sum("count")).first()[0] == sum(n * m for n, m in sizes.values())

    before = shuffled()
    keys.lookup_all(table, "s", "at", wanted, "q").write.format("noop").mode("overwrite").save()
    after = shuffled()
    assert 0 < sum(after[i] for i in after.keys() - before.keys()) < sum(n + m for n, m in sizes.values()) / 5
