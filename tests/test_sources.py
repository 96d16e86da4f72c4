import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docaudit.schemas import DOCUMENTS
from docaudit.sources import files, tables
from docaudit.streaming import intake

c = F.col


def test_uploads(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"abc")
    (tmp_path / "b.exe").write_bytes(b"abc")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "noext").write_bytes(b"x")
    got = files.read_uploads(spark, str(tmp_path)).select("filename", "file_hash").collect()
    assert [tuple(r) for r in got] == [("a.PDF", hashlib.sha256(b"abc").hexdigest())]


def test_tickets(spark, tmp_path):
    for name, body in (("0001_x", json.dumps({"number": 1, "slug": "0001_x", "status": "RESOLVED", "created_at": "2020-01-01T00:00:00+00:00",
                                              "section": "s", "document_id": 4, "message": "m", "images": [], "context": {"errors": []}})),
                       ("0002_y", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "context.json").write_text(body)
    got = [(r.number, r.slug, r.status, r.document_id) for r in files.read_tickets(spark, str(tmp_path)).collect()]
    assert got == [(0, "0002_y", "OPEN", None), (1, "0001_x", "RESOLVED", 4)]


def test_database_options():
    plain = tables.database_options("h", "d", "dbo.documents")
    assert plain["partitionColumn"] == "id" and "integratedSecurity=true" in plain["url"] and "user" not in plain
    assert tables.database_options("h", "d", "t", "u", "p")["password"] == "p"
    with pytest.raises(TypeError):
        tables.read_database(None, host="h", database="d", table="t")


def test_windows_and_stale_timers(spark):
    from docaudit.session import shared_dir

    t0 = datetime(2024, 1, 1)
    rows = [(1, "PROCESSING", t0), (2, "PROCESSING", t0), (2, "PENDING", t0 + timedelta(minutes=5)),
            (3, "PROCESSING", t0 + timedelta(minutes=100)), (4, "PENDING", t0 + timedelta(minutes=120))]
    changes = spark.createDataFrame(rows, "id long, status string, at timestamp")
    assert [r.id for r in intake.stale_in_batches(changes).collect()] == [1]

    folder = shared_dir(spark, "changes")
    changes.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(changes.schema).parquet(folder)
    got = intake.collect_stream(intake.stream_stale(stream).filter(c("id").isNotNull()), "stale")
    assert [(r.id, r.status) for r in got.collect()] == [(1, "FAILED")]


def test_a_stream_goes_on_where_it_stopped(spark):
    from docaudit.session import shared_dir

    source, folder = shared_dir(spark, "source"), shared_dir(spark, "state")
    part = lambda i: spark.createDataFrame([(i, f"h{i}", "f", "p"), (i + 10, "same", "f", "p")], "arrival long, file_hash string, filename string, stored_path string")
    part(1).coalesce(1).write.parquet(f"{source}/a")
    stored = spark.createDataFrame([], DOCUMENTS)

    def drain():
        stream = spark.readStream.schema(part(1).schema).option("recursiveFileLookup", "true").parquet(source)
        docs, outcomes = intake.stream_reserve(stream, stored, "2024-01-01T00:00:00+00:00", folder)
        return sorted(r.file_hash for r in docs.collect()), sorted((r.arrival, r.skipped) for r in outcomes.collect())

    assert drain() == (["h1", "same"], [(1, False), (11, False)])
    part(2).coalesce(1).write.parquet(f"{source}/b")
    want = (["h1", "h2", "same"], [(1, False), (2, False), (11, False), (12, True)])
    assert drain() == want and drain() == want


def test_a_late_change_never_replaces_a_newer_one(spark):
    from docaudit.session import shared_dir

    t0 = datetime(2024, 1, 1)
    source = shared_dir(spark, "late")
    schema = "id long, status string, at timestamp"
    spark.createDataFrame([(1, "PENDING", t0 + timedelta(minutes=3)), (9, "PENDING", t0)], schema).coalesce(1).write.parquet(f"{source}/a")
    spark.createDataFrame([(1, "PROCESSING", t0), (9, "PENDING", t0 + timedelta(days=1))], schema).coalesce(1).write.parquet(f"{source}/b")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    assert intake.collect_stream(intake.stream_stale(stream), "stale").count() == 0


def test_session_windows(spark):
    from docaudit.session import shared_dir

    t0 = datetime(2024, 1, 1)
    rows = [("critical", t0), ("critical", t0 + timedelta(minutes=10)), ("critical", t0 + timedelta(hours=2)), ("warning", t0 + timedelta(days=9))]
    folder = shared_dir(spark, "sessions")
    df = spark.createDataFrame(rows, "severity string, ts timestamp")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = intake.collect_stream(intake.error_windows(stream, c("ts"), "session"), "session")
    assert sorted(r.n for r in got.filter("severity = 'critical'").collect()) == [1, 2]


def test_a_table_is_a_stream_be_it_a_file_or_a_folder_of_parts(spark, tmp_path):
    rows = spark.range(12).selectExpr("id as arrival", "concat('h', id % 5) as file_hash")
    rows.repartition(3).write.parquet(f"{tmp_path}/parts.parquet")
    whole = spark.read.parquet(f"{tmp_path}/parts.parquet").toPandas()
    whole.to_parquet(f"{tmp_path}/whole.parquet")
    for name in ("parts", "whole"):
        stream = intake.stream_table(spark, str(tmp_path), name)
        assert sorted(r[0] for r in intake.collect_stream(stream, name).select("arrival").collect()) == list(range(12))
        hashes = intake.dedupe_in_stream(intake.stream_table(spark, str(tmp_path), name)).select("file_hash")
        assert sorted(r[0] for r in intake.collect_stream(hashes, "hashes").collect()) == [f"h{i}" for i in range(5)]
