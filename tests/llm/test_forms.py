"""Every operator over tables with nulls in any column, repeated rows, and extra columns whose names the operators use inside."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framewise.llm import components, neighbours, overlap, packing, runs, sentences, tokenise, topn

CLASHING = "v src dst label component a b place code cls side k s h1 h2 c1 c2 nth rep sim score group chunk context idx seq step border n size slice rank ids n_tokens start_pos video asked home unit word".split()
T = datetime(2025, 1, 1)


def crowded(df):
    """With clashing extra columns, every row twice, and a row of nulls."""
    nulls = df.sparkSession.createDataFrame([tuple([None] * len(df.columns))], df.schema)
    rows = df.unionByName(nulls)
    extra = [c for c in CLASHING if c not in rows.columns]
    return rows.unionByName(rows).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture
def entries(spark):
    return crowded(spark.createDataFrame([(1, "d", "v000000001", "Who left?", "A. x\nB. y", "train"), (2, "d", "2", "who left", "A. x\nB. y", "test"), (3, "d", "1", "Who left?", "(A) y (B) x", "test")], "entry_id long, data_source string, video_id string, question string, options string, split string"))


def test_components(spark, entries):
    assert [tuple(r) for r in components.tied_pairs(entries).collect()] == [("v000000001", "v000000002")]
    plan = spark.createDataFrame([("train", 0.8), ("test", 0.2), (None, None)], "split string, share double")
    assert {r.split for r in components.grouped_splits(entries, plan).where("entry_id is not null").collect()} <= {"train", "test"}


def test_overlaps(entries):
    assert sorted((r.entry_a, r.entry_b) for r in overlap.overlaps(entries).collect()) == [(1, 3)] * 4


def test_windows(spark):
    rows = crowded(spark.createDataFrame([(1, "v", [1.0, 2.0])], "vec_id long, video_id string, embedding array<float>"))
    probes = crowded(spark.createDataFrame([(1, "p", [1.0, 1.0])], "probe_id int, proposition string, embedding array<float>")).dropDuplicates()
    assert [tuple(r) for r in topn.best_windows(rows, probes, 4).collect()] == [(1, "v", 1, 3.0)] * 2


def test_neighbours(spark):
    base = [float(k % 7) + 1 for k in range(64)]
    rows = spark.createDataFrame([(1, base), (2, [x * 2 for x in base]), (None, base), (3, None)], "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASHING})
    assert [tuple(r) for r in neighbours.similar_pairs(rows).collect()] == [(1, 2, 1.0)]


def test_runs(spark):
    frames = crowded(spark.createDataFrame([("v", 0, ["a", "a", None], T)], "video_id string, frame_idx int, subtitles array<string>, loaded_at timestamp"))
    windows = crowded(spark.createDataFrame([("v", 0, ["a"], T)], "video_id string, window_start int, subtitles array<string>, loaded_at timestamp"))
    assert [(r.seq, r.first_pos, r.last_pos, r.n_lines) for r in runs.subtitle_runs(frames, windows).collect()] == [("frame", 0, 1, 2)]


def test_documents(spark):
    docs = crowded(spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string"))
    ids = [(r.doc_id, len(r.ids)) for r in tokenise.encode_column(docs.drop("ids"), ["doc_id"]).collect()]
    assert sorted(ids, key=str) == [(1, 4), (1, 4), (None, 0), (None, 0)]
    assert sorted((r.start_pos, r.end_pos) for r in sentences.document_sentences(docs).collect()) == [(0, 4), (0, 4), (5, 9), (5, 9)]
    sizes = docs.drop("n_tokens").withColumn("n_tokens", F.length("text"))
    plan = crowded(spark.createDataFrame([(1, 20)], "plan_id int, capacity_tokens int"))
    rows = packing.packing(sizes, plan).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(1, 9), (1, 9)] and len({r.container for r in rows}) == 1
