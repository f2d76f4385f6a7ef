"""File sources and sinks on a temporary folder."""

import hashlib

from quire.sources import files
from quire.streaming import events


def test_folder_scan_and_resume(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in (("a.pdf", b"%PDF-1"), ("b.PDF", b"no"), ("c.txt", b"x"), ("deep/d.pdf", b"%PDF-22")):
        (tmp_path / name).write_bytes(content)
    rows = files.folder(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["name"], r["magic_ok"]) for r in rows] == [("a.pdf", True), ("b.PDF", False), ("d.pdf", True)]
    assert rows[0]["sha256"] == hashlib.sha256(b"%PDF-1").hexdigest()
    assert files.folder(spark, str(tmp_path), after=rows[0]["path"]).count() == 2
    assert files.folder(spark, str(tmp_path), most_bytes=2).count() == 1
    out = str(tmp_path / "stream")
    first = events.run(files.folder_stream(spark, f"{tmp_path}/*"), out)
    assert first.count() >= 2
    (tmp_path / "deep" / "e.pdf").write_bytes(b"%PDF-3")
    assert events.run(files.folder_stream(spark, f"{tmp_path}/*"), out).where("path like '%e.pdf'").count() == 1


def test_query_set_and_snapshot(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('# head\n\n{"query": "a b", "expected": {"article_id": 3}, "tags": ["x"]}\n{"tags": []}\n')
    rows = files.query_set(spark, str(tmp_path / "q.jsonl")).collect()
    assert [(r["query"], r["expected"]["article_id"]) for r in rows] == [("a b", 3)]
    tables = {"one": spark.range(5), "none": spark.range(0)}
    files.snapshot(tables, str(tmp_path / "s"))
    assert all(r["ok"] for r in files.verify_snapshot(spark, str(tmp_path / "s")).collect())


def test_windowed_stream_closes_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02}:{i % 60:02}:00") for i in range(0, 600, 10)]
    frame = spark.createDataFrame(rows, "event_id long, at string").selectExpr("event_id", "cast(at as timestamp) as ts")
    for k in range(3):
        frame.where(f"event_id between {200 * k} and {200 * k + 199}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = events.windowed(events.source(spark, f"{tmp_path}/in/*", 1), "ts", "1 hour", "30 minutes")
    got = {r["window_start"].hour: r["n"] for r in events.run(stream, str(tmp_path / "run")).collect()}
    assert got and all(n == 6 for n in got.values()) and set(got) <= set(range(10)) and 8 in got
