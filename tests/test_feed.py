import json

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import text
from quarrylight.security import Caller, allowed
from quarrylight.sources import feed


def row(offset, event, generation, flags=4, tenant=77, payload="manifest", obj="o1", ms=None, clearance=2):
    return (offset, "suite.manifest", "suite/artifact/" + obj[1:], clearance, 1, tenant, generation, payload, event, "n", obj, 1, ms or 1000 + generation, 0, flags, 42)


def test_feed(spark):
    rows = [row(1, "e1", 1), row(2, "e1", 1), row(3, "e2", 2), row(4, "e3", 3, flags=1), row(5, "e4", 1, obj="o2"), row(2000, "e5", 2, obj="o2")]
    events = spark.createDataFrame(rows, feed.SCHEMA)
    current = {r["object_id"]: (r["generation"], r["flags"]) for r in feed.applied(events).collect()}
    assert current == {"o1": (3, 1), "o2": (2, 4)}
    assert [r["offset"] for r in feed.gaps(events).collect()] == [2000]
    assert feed.conflicting(events).count() == 0
    assert feed.conflicting(events.union(spark.createDataFrame([row(7, "e2", 9)], feed.SCHEMA))).count() == 1
    assert feed.enforced(events, feed.within_scope(77, 3, 1, "suite/")).count() == 6
    with pytest.raises(Exception, match="outside the scope"):
        feed.enforced(events, feed.within_scope(77, 1, 1, "suite/")).collect()


def test_projection_and_search(spark):
    partial = json.dumps({"schema": "v1", "disassembly": "rbx+0x20", "fidelity": "partial", "artifact_id": "a-9"})
    events = spark.createDataFrame([row(1, "e1", 1, clearance=3), row(2, "e2", 1, obj="o2", clearance=1, payload=partial)], feed.SCHEMA)
    rows = feed.projection(feed.applied(events)).persist()
    assert {r["artifact_id"]: r["is_incomplete"] for r in rows.collect()} == {"1": False, "a-9": True}
    for caller, pattern, n in ((Caller(1, 77, 1), "ARTIFACT", 1), (Caller(3, 77, 1), "artifact", 2), (Caller(3, 99, 1), "artifact", 0), (Caller(3, 77, 0), "artifact", 0), (Caller(3, 77, 1), "rbx+0x20", 1), (Caller(3, 77, 1), "%", 0)):
        assert text.authorised(rows, pattern, allowed(caller, shared_tenant=False), 1).count() == n
    expected = rows.select("object_id", F.col("payload_sha384").alias("expected"))
    assert feed.verified_payloads(feed.applied(events), expected).count() == 2
    assert feed.verified_payloads(feed.applied(events), expected.withColumn("expected", F.lit("0" * 96))).count() == 0


def test_seals(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "record_id long, t string")
    proof = feed.seal(a, 5, b"key")
    assert proof == feed.seal(a.orderBy(F.desc("record_id")), 5, b"key")
    assert feed.unsealed(a, 5, b"key", proof).count() == 2
    for other, watermark, key in ((a.limit(1), 5, b"key"), (a, 6, b"key"), (a, 5, b"other")):
        with pytest.raises(ValueError):
            feed.unsealed(other, watermark, key, proof)


def test_equal_rows_count_in_seals_and_digests(spark):
    from quarrylight.sources import generations

    def rows(*names):
        return spark.createDataFrame([(n,) for n in names], "t string")

    real, forged = rows("a", "a", "z"), rows("forged", "forged", "z")
    assert feed.seal(real, 5, b"key") != feed.seal(forged, 5, b"key") != feed.seal(rows("z"), 5, b"key")
    digests = [tuple(generations.digest(t).first()) for t in (real, forged, rows("z", "a", "a"), rows("z"))]
    assert digests[0] == digests[2] and len(set(digests)) == 3


def test_strict_application(spark):
    good = [row(1, "e1", 1), row(2, "e1", 1), row(3, "e2", 2, flags=1), row(4, "e3", 3), row(5, "e4", 1, obj="o2")]
    events = spark.createDataFrame(good, feed.SCHEMA)
    assert {r["object_id"]: r["generation"] for r in feed.strictly_applied(events).collect()} == {"o1": 3, "o2": 1}
    dead = feed.strictly_applied(spark.createDataFrame(good[:3], feed.SCHEMA)).first()
    assert dead["flags"] == 1 and dead["payload"] == ""
    bad = {"conflicting content": row(9, "e2", 7), "version_fell": row(9, "e9", 2), "resurrected": row(9, "e9", 9, obj="o3", ms=5)}
    for message, more in bad.items():
        rows = [*good, row(8, "e8", 8, flags=1, obj="o3", ms=50), more]
        with pytest.raises(ValueError, match=message):
            feed.strictly_applied(spark.createDataFrame(rows, feed.SCHEMA))
    with pytest.raises(ValueError, match="too much"):
        feed.strictly_applied(events, most_objects=1)


def test_consume_once(spark, tmp_path):
    from quarrylight.sources.generations import Publication

    publication, told = Publication(spark, str(tmp_path / "published")), []

    def consume(cursors, to):
        def page(after, limit):
            return to, spark.createDataFrame([(i, c) for i, c in enumerate(cursors)], "place long, cursor long")

        return feed.consume_once(publication, page, lambda p: {"events": p}, lambda c: told.append(c) or c)

    assert consume([3, 5], 6) == 6 and consume([7], 7) == 7 and told == [6, 7]
    for cursors, to in (([7, 8], 8), ([9, 9], 9), ([8, 12], 11), ([], 3)):
        with pytest.raises(ValueError, match="out of order"):
            consume(cursors, to)
    assert told == [6, 7] and publication.open_latest()[0] == 2
