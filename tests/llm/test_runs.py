from datetime import datetime

from framewise.llm import runs

FRAME = "video_id string, frame_idx int, subtitles array<string>, loaded_at timestamp"
WINDOW = "video_id string, window_start int, subtitles array<string>, loaded_at timestamp"
T = datetime(2025, 1, 1)


def found(spark, frames, windows=()):
    df = runs.subtitle_runs(spark.createDataFrame(list(frames), FRAME), spark.createDataFrame(list(windows), WINDOW))
    return sorted(tuple(r) for r in df.select("seq", "video_id", "first_idx", "first_pos", "last_idx", "last_pos", "n_lines", "duration").collect())


def test_gaps_blanks_slips_and_repeats(spark):
    frames = [
        ("v", 0, ["Hello there, Velm!"], T), ("v", 1, ["<i>hello   there Velm</i>"], T), ("v", 1, ["<i>hello   there Velm</i>"], datetime(2025, 2, 1)), ("v", 3, ["Hello there, Velm!"], T),
        ("v", 4, [""], T), ("v", 5, ["Hello there, Velm!"], T), ("v", 6, None, T), ("v", 7, ["Step 1: lantern", "", None, "Step 1: lanterrn"], T), ("v", 8, ["Step 2: lantern"], T), (None, 0, ["x", "x"], T), ("w", None, ["x", "x"], T),
    ]
    assert found(spark, frames) == [("frame", "v", 0, 0, 1, 0, 2, 2), ("frame", "v", 7, 0, 7, 3, 2, 1)]


def test_runs_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 4)
    frames = [("v", k, ["same line"], T) for k in range(13)] + [("v", 13, ["other"], T), ("v", 14, ["other", "last"], T)]
    windows = [("v", 8 * k, ["w", "w"], T) for k in range(6) if k != 3]
    assert found(spark, frames, windows) == [("frame", "v", 0, 0, 12, 0, 13, 13), ("frame", "v", 13, 0, 14, 0, 2, 2), ("window", "v", 0, 0, 16, 1, 6, 24), ("window", "v", 32, 0, 40, 1, 4, 16)]


def test_slipped_showings_meet_over_other_variants(spark, monkeypatch):
    line = lambda w: [f"Velm went to the {w} again"]
    for chunk in (2048, 2, 3):
        monkeypatch.setattr(runs, "CHUNK", chunk)
        clean_first = [("a", k, line(w), T) for k, w in enumerate(["market", "markket", "maket", "market"])]
        clean_last = [("b", k, line(w), T) for k, w in enumerate(["markket", "maket", "market", "canoe"])]
        apart = [("c", k, line(w), T) for k, w in enumerate(["markket", "maket"])] + [("c", 3, line("market"), T)]
        got = found(spark, clean_first + clean_last + apart)
        if chunk == 2048:
            assert got == [("frame", "a", 0, 0, 3, 0, 4, 4), ("frame", "b", 0, 0, 2, 0, 3, 3)]
        else:  # a chunk sees one step of the chunk before
            assert all(g[0] == "frame" and g[6] >= 2 for g in got)


def test_empty(spark):
    assert found(spark, []) == []
