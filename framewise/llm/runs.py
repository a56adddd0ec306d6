"""Runs of one subtitle line shown over and over.

Boundary-only rows: of the line events of a video only those stay that differ from their predecessor; ``lead`` over
these starts gives each run's end (the next start's predecessor) and its count (difference of positions).  Two slipped showings of a line can differ more than each from the line itself, so an event
that differs from its predecessor still goes on if it equals another variant of the same run, and a variant that also
equals one of the run just before takes that run in.

A video's events are cut into chunks of ``CHUNK`` steps, each with the last step of the chunk before as context, so a
video of any length is spread over many tasks.  Only runs that touch a chunk's border are joined over the whole
video afterwards: two rows a chunk at most.

Defined cases: a row loaded twice counts once (the latest); rows without video or index belong to no sequence; null
and blank lines are no lines; a row that is missing or shows no line ends a run; lines without any word or number
(such as a lone note sign) are the same line.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import cut
from framewise.llm.normal import line_key, same_words

#: Steps (rows) of one video that one task reads at a time.
CHUNK = 2048
#: Sorts behind every position of a chunk.
END = 2**31 - 1
#: Distinct lines a worker remembers in normalised form.
KEPT_LINES = 100_000

BOUNDARY = "seq string, video_id string, chunk long, idx int, pos int, prev_idx int, prev_pos int, nth long, joins boolean, line string"
NAMES = [x.split()[0] for x in BOUNDARY.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]


def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence, video, chunk and index to their boundary rows, with one closing row a chunk."""
    keys: dict[str, tuple[str, ...] | None] = {}
    group, out = None, []
    prev_key = prev_idx = prev_pos = seen_idx = None
    variants: dict[tuple[str, ...], None] = {}
    before: dict[tuple[str, ...], None] = {}
    nth = 0

    def flush(keep: int) -> pa.RecordBatch:
        """All boundary rows but the last ones, which a later variant may still change."""
        done = out[: len(out) - keep]
        del out[: len(out) - keep]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), TYPES)], names=NAMES)

    def close() -> None:
        if group is not None and nth:
            out.append((*group, END, 0, prev_idx_last, prev_pos_last, nth, False, None))

    prev_idx_last = prev_pos_last = None
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("seq", "video_id", "chunk", "context", "idx", "step", "subtitles")]
        for seq, video, chunk, context, idx, step, lines in zip(*cols):
            if group != (seq, video, chunk):
                close()
                group, nth = (seq, video, chunk), 0
                prev_key = prev_idx = seen_idx = None
                variants, before = {}, {}
            if idx == seen_idx:
                continue
            seen_idx = idx
            follows = prev_key is not None and prev_idx is not None and prev_idx + step == idx
            shown = False
            for pos, line in enumerate(lines or []):
                if line is None:
                    continue
                if line in keys:
                    key = keys[line]
                else:
                    if len(keys) > KEPT_LINES:
                        keys.clear()
                    key = keys[line] = line_key(line)
                if key is None:
                    continue
                same = (shown or follows) and (same_words(prev_key, key) or len(variants) > 1 and any(same_words(v, key) for v in variants))
                if not same:
                    variants, before = {}, variants if shown or follows else {}
                fresh = key not in variants
                variants[key] = None
                shown = True
                if not context:
                    if not same or nth == 0:
                        out.append((seq, video, chunk, idx, pos, prev_idx_last if nth else None, prev_pos_last if nth else None, nth, bool(same), line))
                    nth += 1
                    prev_idx_last, prev_pos_last = idx, pos
                if same and fresh and before and any(same_words(v, key) for v in before):
                    variants, before = before | variants, {}
                    if not context:
                        # The run's first row was no boundary; as the first of its chunk it stays and joins the one before.
                        row = out.pop()
                        if row[7] == 0:
                            out.append((*row[:8], True, row[9]))
                prev_key, prev_pos = key, pos
            if shown:
                prev_idx = idx
            else:
                prev_key = prev_idx = None
        if len(out) > 20_000:
            yield flush(1)
    close()
    if out:
        yield flush(0)


def line_rows(df: DataFrame, seq: str, idx: str, step: int) -> DataFrame:
    """A subtitle table in the common shape, with chunk numbers and context rows."""
    span = step * CHUNK
    rows = df.where(F.col("video_id").isNotNull() & F.col(idx).isNotNull()).select(F.lit(seq).alias("seq"), "video_id", F.col(idx).cast("int").alias("idx"), F.lit(step).alias("step"), "subtitles", "loaded_at")
    chunk = F.floor(F.col("idx") / F.lit(span)).cast("long")
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("context"))
    ahead = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("context"))
    places = F.when(F.col("idx") >= (chunk + 1) * span - step, F.array(own, ahead)).otherwise(F.array(own))
    return rows.select("*", F.explode(places).alias("place")).select("seq", "video_id", "place.chunk", "place.context", "idx", "step", "subtitles", "loaded_at")


def repeated_lines(rows: DataFrame, span: dict[str, int]) -> DataFrame:
    """Every longest run of two or more lines: seq, video_id, first and last place, n_lines, duration, line.

    ``span`` gives the index step of each seq; a run lasts from the start of its first row to the end of its last.
    """
    sorted_rows = rows.repartition("seq", "video_id", "chunk").sortWithinPartitions("seq", "video_id", "chunk", "idx", F.col("loaded_at").desc_nulls_last())
    starts = sorted_rows.mapInArrow(boundaries, BOUNDARY)
    w = W.partitionBy("seq", "video_id", "chunk").orderBy("idx", "pos")
    step = F.coalesce(*[F.when(F.col("seq") == s, F.lit(n)) for s, n in span.items()])
    pieces = starts.select(
        "seq", "video_id", "chunk", F.col("idx").alias("first_idx"), F.col("pos").alias("first_pos"), F.lead("prev_idx").over(w).alias("last_idx"), F.lead("prev_pos").over(w).alias("last_pos"),
        (F.lead("nth").over(w) - F.col("nth")).alias("n_lines"), "joins", "line", (F.lead("idx").over(w) == END).alias("closes"), step.alias("step"),
    ).where(F.col("first_idx") != END)
    ends = F.col("closes") & (F.col("last_idx") >= (F.col("chunk") + 1) * F.col("step") * CHUNK - F.col("step"))
    # Both branches below read the pieces; written once, the lines are compared once.
    pieces = cut(pieces.withColumn("border", F.col("joins") | ends).where("border or n_lines >= 2"))
    result = ["seq", "video_id", "first_idx", "first_pos", "last_idx", "last_pos", "n_lines", "step", "line"]
    inner = pieces.where("not border").select(*result)
    over = W.partitionBy("seq", "video_id").orderBy("chunk", "first_idx", "first_pos")
    joined = (
        pieces.where("border").withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(over))
        .groupBy("seq", "video_id", "island", "step")
        .agg(F.min(F.struct("first_idx", "first_pos", "line")).alias("a"), F.max(F.struct("last_idx", "last_pos")).alias("z"), F.sum("n_lines").alias("n_lines"))
        .select("seq", "video_id", "a.first_idx", "a.first_pos", "z.last_idx", "z.last_pos", "n_lines", "step", "a.line")
    )
    return inner.unionByName(joined).where("n_lines >= 2").withColumn("duration", F.col("last_idx") - F.col("first_idx") + F.col("step")).drop("step")


def subtitle_runs(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs in ``frame_subtitles`` (a row a second) and ``window_subtitles`` (a row every 8 frames)."""
    rows = line_rows(frames, "frame", "frame_idx", 1).unionByName(line_rows(windows, "window", "window_start", 8))
    return repeated_lines(rows, {"frame": 1, "window": 8})
