import json

from framewise.sources import files, paths


def items(text, size):
    raw, at = text.encode(), [0]

    def read(n):
        at[0], part = at[0] + n, raw[at[0] : at[0] + n]
        return part

    return [json.loads(x) for x in files.array_items(read, size)]


def test_arrays_in_chunks_of_any_size():
    values = [{"a": "x" * 40, "b": [1, 2]}, 12345, "é片", None, True, [], -1.5]
    text = json.dumps(values, ensure_ascii=False, indent=1)
    for size in (1, 2, 3, 7, 64, 10_000):
        assert items(text, size) == values
        assert items("﻿ " + text[:-8], size)[:6] == values[:6]
        assert items(text[: text.index("12345") + 3], size)[:1] == values[:1]
        assert items('{"a": 1}', size) == items("", size) == items("  ", size) == items("[]", size) == []


def test_paths_with_and_without_scheme(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert not paths.holds_files(spark, str(tmp_path)) and paths.is_folder(spark, f"file://{tmp_path}") and not paths.exists(spark, str(tmp_path / "c"))
    for name in ("b/2.parquet", "b/1.parquet"):
        (tmp_path / name).write_text("")
    assert paths.holds_files(spark, f"file:{tmp_path}")
    assert paths.matching(spark, f"{tmp_path}/b/*.parquet") == [f"{tmp_path}/b/{k}.parquet" for k in (1, 2)] == files.parquet_paths(f"file://{tmp_path}/b")
    assert paths.inner(spark, f"file://{tmp_path}/b") == f"{tmp_path}/b/"
