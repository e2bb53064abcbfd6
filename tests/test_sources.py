"""Files, archives, envelopes, events, generations."""

import io
import json
import os
import tarfile
import uuid

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import text
from quarrylight.sources import archives, envelopes, files, generations


def archive(path, compress):
    members = {
        "numbers.txt": "\n".join(map(str, range(0, 2001, 2))),
        "numbers.csv": "value9\n" + "\n".join(map(str, range(0, 3001, 3))),
        "numbers.json": json.dumps(list(range(0, 5001, 5))),
        "corrupt.txt": "no numbers\nhere either",
        "corrupt.csv": "value\n123\nbad,data\n456",
        "corrupt.json": '[1, 2, "bad", 4] 77',
        "odd.txt": "-5 +7 99999999999999999999 9223372036854775808 12",
    }
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content.encode()))
    path.write_bytes(compress(raw.getvalue()))


@pytest.fixture(scope="module")
def members(spark, tmp_path_factory):
    zstandard = pytest.importorskip("zstandard")
    folder = tmp_path_factory.mktemp("archives")
    archive(folder / "a.tar.zst", zstandard.ZstdCompressor().compress)
    archive(folder / "b.tar", bytes)
    return archives.members(spark, f"{folder}/*").persist()


def test_archive_keys(members):
    keys = archives.member_keys(members.where("archive like '%zst'"), skip_header=True).persist()
    got = {r["member"]: (r["n"], r["first_key"], r["last_key"]) for r in archives.sidecar(keys).collect()}
    assert got == {"numbers.txt": (1001, 0, 2000), "numbers.csv": (1001, 0, 3000), "numbers.json": (1001, 0, 5000), "corrupt.csv": (2, 123, 456), "corrupt.json": (3, 1, 4), "odd.txt": (3, -5, 12)}
    found = archives.search_indexed(keys, archives.sidecar(keys), 1000)
    assert {(r["member"], r["ordinal"]) for r in found.collect()} == {("numbers.txt", 500), ("numbers.json", 200)}
    assert archives.search_indexed(keys, archives.sidecar(keys), 999_999).count() == 0


def test_all_archives_and_patterns(spark, members):
    assert members.count() == 14
    docs = archives.documents(members.where("member = 'corrupt.txt'"))
    assert text.search(docs, "here either").count() == 2
    assert archives.telemetry_events(archives.member_keys(members)).where("timestamp = 123").count() == 4  # in two members of two archives


def test_crawl(spark, tmp_path):
    root = tmp_path / "some.root"
    for name, content in {"a.txt": b"one\ntwo", "b.bin": b"x\0y", ".hidden": b"h", "node_modules/c.txt": b"c", "deep/er/d.txt": b"d", "empty": b"", ".git/e.txt": b"e"}.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(content)
    got = {r["path"].split("some.root/")[1]: r["text"] for r in files.text_files(spark, str(root)).collect()}
    assert got == {"a.txt": "one\ntwo", "deep/er/d.txt": "d"}


def test_envelopes(spark):
    record = dict(flags=4, object_type=42, tenant_id=7, classification=2, generation=9, epoch=3, physical_ms=1000, logical=1, object_id=str(uuid.uuid4()), event_id=str(uuid.uuid4()), node_id=str(uuid.uuid4()), sci=5)
    whole, bare = envelopes.pack(record, b"payload"), envelopes.pack(record)
    assert len(bare) == 124
    broken = [whole[:-1], whole[:50], b"", bytes([whole[0] ^ 1]) + whole[1:], whole[:-1] + b"?", None]
    good, bad = envelopes.decoded(spark.createDataFrame([(x,) for x in [whole, bare, *broken]], "frame binary"))
    rows = good.collect()
    assert sorted(bytes(r["payload"]) for r in rows) == [b"", b"payload"] and bad.count() == len(broken)
    assert {k: rows[0][k] for k in record} == record


def test_capability_frames(spark):
    frame = b"node-a".ljust(40, b"\0") + bytes([3, 1, 0, 0]) + (4096).to_bytes(4, "little") + (1250).to_bytes(2, "little")
    got = envelopes.node_capabilities(spark.createDataFrame([(frame,), (b"short",)], "frame binary")).collect()
    assert [tuple(r) for r in got] == [("node-a", 3, True, False, 4096, 12.5)]


def test_strict_events(spark):
    a, b = str(uuid.uuid4()), str(uuid.uuid4())
    fine = {"schema": 1, "tenant_id": 7, "key": f"t:7/canonical/v1/{a}", "mutation": "upsert", "operation_id": b, "object_id": a, "classification": 1, "sci": 0, "cursor": 5, "record": {"x": 1}}
    bad = [json.dumps(fine).replace('"x": 1', '"x": 1, "x": 2'), json.dumps({**fine, "schema": 2}), json.dumps({**fine, "mutation": "delete"}), json.dumps({**fine, "key": "t:8/canonical/v1/" + a}), json.dumps({**fine, "object_id": a.upper()}), "{", None]
    lines = [json.dumps(fine), json.dumps({**fine, "mutation": "delete", "record": None}), *bad]
    good, rest = envelopes.events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r["mutation"] for r in good.collect()) == ["delete", "upsert"] and rest.count() == len(bad)


def test_projected_pages(spark):
    rows = [(1, 7, 100), (2, 7, 100), (3, 7, 100), (4, 7, 105)]
    page = spark.createDataFrame(rows, "cursor long, tenant_id long, physical_ms long")
    assert [(r["cursor"], r["logical"]) for r in envelopes.projected_page(page, 1).orderBy("cursor").collect()] == [(2, 0), (3, 1), (4, 0)]
    with pytest.raises(Exception, match="clock fell back"):
        envelopes.projected_page(page.union(spark.createDataFrame([(5, 7, 90)], page.schema)), 0).collect()


def test_generations(spark, tmp_path):
    publication = generations.Publication(spark, f"file://{tmp_path}/published")
    assert publication.open_latest() is None
    for g in (1, 2, 3):
        publication.publish(g, 10 * g, exact=spark.range(g), timeline=spark.range(2 * g))
    assert publication.active() == 3 and publication.manifest(3)["cursor"] == 30
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/published/gen={3:012d}/exact")  # no longer what the manifest says
    number, tables = publication.open_latest()
    assert number == 2 and tables["exact"].count() == 2 and tables["timeline"].count() == 4
    assert publication.generations() == [1, 2] and (tmp_path / "published/quarantine" / f"gen={3:012d}").exists()


def test_integers_of_texts(spark):
    df = spark.createDataFrame([("a1 -2 +3", "x.txt"), ("h5\n6", "x.csv"), ("7 [8, 9]", "x.JSON"), (None, "x")], "t string, n string")
    assert [r[0] for r in df.select(files.keys_of(F.col("n"), F.col("t"), True)).collect()] == [[1, -2, 3], [6], [8, 9], None]
