import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.sources import files, index, loaders
from framewise.sources.srt import read_srt_tree
from framewise.streaming import progress


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content) if isinstance(content, bytes) else path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def test_json_array_prefix(spark, tmp_path):
    put(tmp_path / "cut.json", '  [{"a": 1}, {"a": 2, "b": "]"}, {"a": 3, "b": ')
    put(tmp_path / "whole.json", [{"a": 9}])
    put(tmp_path / "other.json", {"a": 5})
    got = files.read_json_prefix(spark, str(tmp_path), T.StructType([T.StructField("a", T.IntegerType())]))
    rows = sorted((r.path.rsplit("/", 1)[1], r.pos, r.item.a) for r in got.collect())
    assert rows == [("cut.json", 0, 1), ("cut.json", 1, 2), ("whole.json", 0, 9)]


def test_lvb_keeps_entries_with_a_burned_video_in_category_order(spark, tmp_path):
    item = lambda k, cat: {"id": k, "video_id": f"v{k}", "video_path": f"v{k}.mp4", "subtitle_path": f"v{k}.json", "question": f"Q{k}?", "question_category": cat, "candidates": ["a", "b"], "correct_choice": 1}
    put(tmp_path / "lvb_val.json", [item(1, "X"), item(2, "Y"), item(3, "X"), item(4, "Y")])
    for k in (1, 2, 3):
        put(tmp_path / f"burned/burn-subtitles/v{k}.mp4", b"x")
    got = loaders.load_lvb(spark, str(tmp_path), str(tmp_path / "burned")).collect()
    assert [r.metadata.video_id for r in got] == ["v1", "v3", "v2"]
    assert got[0].correct_choice == "1" and got[0].question.endswith("Question: Q1? \n") and got[0].paths.video_path.endswith("burn-subtitles/v1.mp4")
    assert json.loads(got[0].metadata.original_data)["question"] == "Q1?"


def test_lvbench_splits_options_from_the_question(spark, tmp_path):
    put(tmp_path / "lvbench.json", [{"key": "a", "question": "Who?\n(A) x\n(B) y", "gt": "B"}, {"key": "gone", "question": "?", "answer": "A"}])
    put(tmp_path / "videos/a.mp4", b"x")
    (row,) = loaders.load_lvbench(spark, str(tmp_path)).collect()
    assert row.candidates == ["(A) x", "(B) y"] and row.correct_choice == "B" and row.category == "general"


def test_videomme_needs_one_of_two_videos(spark, tmp_path):
    put(tmp_path / "videomme.json", [{"videoID": x, "question_id": x + "-1", "question": "Q", "options": ["a"], "answer": "A"} for x in ("raw", "burned", "none")])
    put(tmp_path / "data/raw.mp4", b"x")
    put(tmp_path / "burn-subtitles/burned.mp4", b"x")
    got = {r.metadata.video_id: r.paths for r in loaders.load_videomme(spark, str(tmp_path)).collect()}
    assert set(got) == {"raw", "burned"} and got["raw"].video_path.endswith("data/raw.mp4") and got["burned"].raw_video_path is None


def test_mlvu_merges_category_files(spark, tmp_path):
    q = lambda v, a: {"question": "Q", "candidates": ["x", "y"], "answer": a, "video": v}
    put(tmp_path / "json/1_plotQA.json", [q("a.mp4", "y"), q("b.mp4", "zzz")])
    put(tmp_path / "json/2_needle.json", {"data": [q("c.mp4", "x")]})
    put(tmp_path / "json/3_ego.json", q("d.mp4", "x"))
    for p in ("1_plotQA/a", "1_plotQA/b", "2_needle/c", "3_ego/d"):
        put(tmp_path / f"video/{p}.mp4", b"x")
    got = [(r.pos, r.category, r.correct_choice, r.metadata.video_id) for r in loaders.load_mlvu(spark, str(tmp_path)).collect()]
    assert got == [(0, "1_plotQA", "1", "1_plotQA/a"), (2, "2_needle", "0", "2_needle/c"), (3, "3_ego", "0", "3_ego/d")]


def test_cgbench_takes_the_first_file_and_normalises_choices(spark, tmp_path):
    put(tmp_path / "cgbench_mini.json", {"questions": [{"qid": 1, "video_uid": "v", "question": "Q", "choices": ["x", "y"], "right_answer": "B"}]})
    put(tmp_path / "videos/v.mp4", b"x")
    (row,) = loaders.load_cgbench(spark, str(tmp_path)).collect()
    assert row.correct_choice == "1" and row.metadata.id == "1"
    with pytest.raises(FileNotFoundError):
        loaders.load_cgbench(spark, str(tmp_path / "videos"))


def test_file_index_later_root_wins(spark, tmp_path):
    put(tmp_path / "a/sub/x.mp4", b"1")
    put(tmp_path / "b/x.mp4", b"22")
    got = {r.key: r.path for r in files.file_index(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert set(got) == {"sub/x.mp4", "x", "x.mp4"} and got["x"].endswith("b/x.mp4")


def test_parquet_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "k int, split string")
    path = files.write_splits(df, str(tmp_path / "out"), 8, "tag", rows_per_file=1)
    assert sorted((r.k, r.split) for r in spark.read.parquet(path).collect()) == [(1, "train"), (2, "test"), (3, "train")]
    assert files.write_verified(df, str(tmp_path / "zstd")) == 3
    assert {(r.column, r.rows) for r in files.describe_parquet(spark, str(tmp_path / "zstd")).collect()} == {("k", 3), ("split", 3)}
    files.append_results(df, str(tmp_path / "log"))
    files.append_results(df, str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), df.schema).count() == 6
    assert len(files.parquet_paths(str(tmp_path / "zstd"))) >= 1
    with pytest.raises(FileNotFoundError):
        files.parquet_paths(str(tmp_path / "nothing"))


def test_srt_tree(spark, tmp_path):
    put(tmp_path / "x/a.srt", "1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    put(tmp_path / "b.srt", "broken")
    assert [(r.start, r.line) for r in read_srt_tree(spark, str(tmp_path)).collect()] == [(1.0, "Hi")]


def test_index_search(spark, tmp_path):
    root = str(tmp_path / "index")
    e = lambda x: [x, 1.0] + [0.0] * 62
    rows = spark.createDataFrame([("v", 0, e(1.0)), ("v", 1, e(5.0)), ("w", 0, e(9.0))], "video_id string, window_idx int, embedding array<float>")
    index.save_table(rows.withColumns({"dataset": F.lit("d"), "window_size": F.lit(8)}), root, "window_embeddings")
    queries = spark.createDataFrame([(1, [1.0] + [0.0] * 63)], "query_id int, query_embedding array<float>")
    assert [(r.video_id, r.window) for r in index.search(spark, root, "d", queries, 1, video_id="v").collect()] == [("v", 1)]
    assert [(r.video_id, r.window) for r in index.search(spark, root, "d", queries, 1).collect()] == [("w", 0)]
    assert index.search(spark, root, "d", queries, 1, video_id="zz").collect() == []
    todo = spark.createDataFrame([("v",), ("new",)], "video_id string")
    assert [r.video_id for r in index.missing(todo, spark, root, "d").collect()] == ["new"]
    with pytest.raises(ValueError):
        index.search(spark, root, "d", queries, 1, mode="other")


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    t = lambda m: datetime(2024, 1, 1, m // 60, m % 60)
    spark.createDataFrame([(t(1), 1, "a", 1.0), (t(20), 1, "a", 2.0), (t(70), 1, "b", 3.0), (t(300), 2, "a", 4.0)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = progress.read_results(spark, str(tmp_path / "in"), schema)
    q = progress.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.hour, r.event_type, r.n) for r in spark.table("windows").collect()) == [(0, "a", 2), (1, "b", 1), (5, "a", 1)]
    for _ in range(2):
        progress.append_once(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    s = progress.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    s.processAllAvailable()
    s.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]
