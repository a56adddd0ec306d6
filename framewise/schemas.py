"""Explicit schemas of the domain's records; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

PATHS = T.StructType([T.StructField(n, T.StringType()) for n in ("raw_video_path", "subtitle_path", "video_path")])
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("video_id", "id", "original_data")])
PULS = T.StructType([T.StructField("proposition", T.ArrayType(T.StringType())), T.StructField("specification", T.StringType())])
#: One multiple-choice question on one video; the choice is text.
ENTRY = T.StructType([T.StructField("question", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("correct_choice", T.StringType()), T.StructField("paths", PATHS), T.StructField("metadata", METADATA)])
ENTRY_PULS = T.StructType([*ENTRY.fields, T.StructField("puls", PULS)])
FRAMES = T.ArrayType(T.StructType([T.StructField("window_idx", T.IntegerType()), T.StructField("encoded_frames", T.ArrayType(T.BinaryType()))]))
EXECUTE = T.StructType([
    T.StructField("topk", T.IntegerType()), T.StructField("video_id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("puls", PULS),
    T.StructField("precomputed_frames", FRAMES), T.StructField("video_summary", T.ArrayType(T.BinaryType())),
])
TOOLS = T.StructType([T.StructField("video_search", T.StructType([T.StructField("execute_kwargs", EXECUTE)]))])
EXTRA = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("question", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("correct_choice", T.StringType()),
    T.StructField("metadata", METADATA), T.StructField("paths", PATHS), T.StructField("split", T.StringType()), T.StructField("tools_kwargs", TOOLS),
])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
RL_ROW = T.StructType([
    T.StructField("data_source", T.StringType()), T.StructField("prompt", T.ArrayType(MESSAGE)), T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType())])), T.StructField("extra_info", EXTRA),
])
CUE = T.StructType([T.StructField("timestamp", T.ArrayType(T.DoubleType()))] + [T.StructField(n, T.StringType()) for n in ("start", "end", "line", "text")])
VIDEO_INFO = T.StructType([
    T.StructField("video_id", T.StringType()), T.StructField("video_format", T.StringType()), T.StructField("frame_width", T.IntegerType()), T.StructField("frame_height", T.IntegerType()),
    T.StructField("original_frame_count", T.LongType()), T.StructField("original_fps", T.DoubleType()), T.StructField("original_duration", T.DoubleType()), T.StructField("processed_fps", T.DoubleType()),
    T.StructField("processed_frame_count", T.IntegerType()), T.StructField("frame_step", T.IntegerType()),
])
RESULT = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("video_id", T.StringType()), T.StructField("gt", T.StringType()), T.StructField("pred", T.ArrayType(T.StringType())), T.StructField("parsed_pred", T.ArrayType(T.StringType())),
    T.StructField("majority_vote", T.StringType()), T.StructField("is_majority_correct", T.BooleanType()), T.StructField("correct_count", T.IntegerType()), T.StructField("total_passes", T.IntegerType()),
    T.StructField("turns", T.ArrayType(T.StringType())), T.StructField("pass_latencies_sec", T.ArrayType(T.DoubleType())),
])
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
AGENT_OUTPUT = T.StructType([T.StructField(n, T.StringType()) for n in ("thought", "answer", "search", "subtitle")])
TRAJECTORY = T.StructType([T.StructField("outputs", T.ArrayType(AGENT_OUTPUT)), T.StructField("is_found_answer", T.BooleanType()), T.StructField("is_error", T.BooleanType()), T.StructField("error_message", T.StringType()), T.StructField("answer", T.StringType())])
RETRIEVAL = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("frame_indices", T.ArrayType(T.IntegerType())), T.StructField("topk", T.IntegerType()), T.StructField("video_id", T.StringType()),
    T.StructField("total_embeddings", T.LongType()), T.StructField("puls", T.MapType(T.StringType(), T.DoubleType())),
])
