import pytest
from pyspark.sql import functions as F

from quillmere.sources.files import file_digests, markdown_lines, markdown_rows, read_document, read_lines, read_tolerant, write_documents, write_lines
from quillmere.streaming.pending import confirmations, confirmations_stream
from quillmere.streaming.resume import append_new, first_of_each, run_once


def test_documents_and_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "samples": [\n {"id": "a", "n": 1},\n {"id": null}]\n}')
    assert [r[:] for r in read_document(spark, str(tmp_path / "d.json"), "id string, n int", "samples").collect()] == [("a", 1), (None, None)]
    rows = spark.createDataFrame([("a", ["x", "y"]), (None, [])], "id string, l array<string>")
    write_lines(rows, str(tmp_path / "out"))
    assert sorted(read_lines(spark, str(tmp_path / "out"), rows.schema).collect(), key=str) == sorted(rows.collect(), key=str)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_lines(rows, str(tmp_path / "out"))
    write_lines(rows, str(tmp_path / "out"), append=True)
    assert read_lines(spark, str(tmp_path / "out"), rows.schema).count() == 4


def test_tolerant_read(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": [1]}')
    (tmp_path / "bad.json").write_text('{"a": ')
    paths = [str(tmp_path / n) for n in ("good.json", "bad.json", "none.json")]
    assert {r["path"].rpartition("/")[2]: r["code"] for r in read_tolerant(spark, paths).select("path", "code").collect()} == {"good.json": None, "bad.json": "JSON_SYNTAX", "none.json": "FILE_MISSING"}


def test_digests_and_markdown(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    assert file_digests(spark, str(tmp_path / "x.bin")).select("bytes", "sha256").first()[:] == (3, hashlib.sha256(b"abc").hexdigest())
    rows = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert markdown_rows(rows, ["x", "y"]).first()[0] == "| a｜b |  |"
    (tmp_path / "l.md").write_text("# t\r\n- [x] A\n")
    assert [r["line"] for r in markdown_lines(spark, str(tmp_path / "l.md")).orderBy("line_no").collect()] == ["# t", "- [x] A", ""]


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, t string")
    for part in (rows.where("id = 1"), rows, rows):
        append_new(part, str(tmp_path / "log"), ["id"])
    assert spark.read.schema(rows.schema).json(str(tmp_path / "log")).count() == 3


EVENTS = [(1, 1, 0, "issue"), (1, 2, 100, "confirm"), (1, 3, 200, "confirm"), (1, 4, 300, "issue"), (1, 5, 901, "confirm"), (2, 6, 0, "confirm"), (2, 7, 5, "issue"), (2, 8, 605, "confirm")]
OUTCOMES = [(1, 2, 1, "confirmed"), (1, 3, 1, "replayed"), (1, 5, 4, "expired"), (2, 6, None, "unknown"), (2, 8, 7, "confirmed")]


def _events(spark):
    return spark.createDataFrame(EVENTS, "user_id long, event_id long, s long, kind string").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "kind")


def test_confirmations_in_batch_and_stream(spark, tmp_path):
    events = _events(spark)
    assert sorted(r[:] for r in confirmations(events).collect()) == OUTCOMES
    folder = str(tmp_path / "in")
    # two files in two micro-batches: the state of the first is used in the second
    events.where("s < 150").coalesce(1).write.parquet(folder)
    events.where("s >= 150").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("latestFirst", False).parquet(folder)
    assert sorted(r[:] for r in run_once(confirmations_stream(stream), "pending").collect()) == OUTCOMES


def test_documents_are_readable_and_ordered(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(2, "b", 'x": ,"y', None), (1, "b", None, ["q"]), (3, None, "z", [])], "n int, part string, t string, l array<string>")
    write_documents(rows, str(tmp_path / "out"), "part", ["n"], "samples")
    texts = {f.parent.name: f.read_text() for f in (tmp_path / "out").rglob("part-*.txt")}
    assert json.loads(texts["of_part=b"]) == {"samples": [{"l": ["q"], "n": 1, "part": "b", "t": None}, {"l": None, "n": 2, "part": "b", "t": 'x": ,"y'}]}
    assert json.loads(texts["of_part=null"]) == {"samples": [{"l": [], "n": 3, "part": None, "t": "z"}]}
    assert list(json.loads(texts["of_part=b"])["samples"][0]) == ["l", "n", "part", "t"]


def test_a_log_goes_on_with_its_own_settings_only(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id int")
    append_new(rows, str(tmp_path / "log"), ["id"], {"model": "a", "seed": "1"})
    append_new(rows, str(tmp_path / "log"), ["id"], {"seed": "1", "model": "a"})
    with pytest.raises(ValueError, match="seed"):
        append_new(rows, str(tmp_path / "log"), ["id"], {"model": "a", "seed": "2"})
    assert spark.read.schema("id int").json(str(tmp_path / "log")).count() == 1


def test_stream_limit_and_watermark(spark, tmp_path):
    events = _events(spark)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    shorter = {r["confirm_id"]: r["outcome"] for r in run_once(confirmations_stream(stream, 50), "short").collect()}
    assert shorter == {r["confirm_id"]: r["outcome"] for r in confirmations(events, 50).collect()} and shorter[2] == "expired"
    later = stream.withColumn("ts", F.col("ts") + F.expr("interval 400 days"))  # a watermark begins at the epoch
    kept = sorted(r[:] for r in run_once(confirmations_stream(later, delay="1 hour"), "watermark").collect())
    assert kept == OUTCOMES
    firsts = run_once(first_of_each(later.withColumn("s", F.col("ts")), ["user_id", "kind"], "s", "1 hour"), "firsts")
    assert firsts.count() == 4


def test_the_gate_speaks_again_at_a_confirm(spark, tmp_path):
    """A confirm that the gate doesn't allow any more is rejected and uses the token up, in batch and stream."""
    events = _events(spark).withColumn("allowed", F.when(F.col("event_id") == 2, False).when(F.col("event_id") != 8, True))
    want = [(1, 2, 1, "rejected"), (1, 3, 1, "replayed"), (1, 5, 4, "expired"), (2, 6, None, "unknown"), (2, 8, 7, "rejected")]
    assert sorted(r[:] for r in confirmations(events).collect()) == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert sorted(r[:] for r in run_once(confirmations_stream(stream), "gate").collect()) == want
