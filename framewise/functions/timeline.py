"""Column functions on times, frames, windows and samples of frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the video length buckets in seconds; the last bucket is open.
LENGTHS = ((60.0, "0-1min"), (600.0, "1-10min"), (3600.0, "10-60min"), (None, "60min+"))


def clock_seconds(c: Column) -> Column:
    """``HH:MM:SS,mmm`` or ``HH:MM:SS.mmm`` as seconds; null for other text."""
    m = r"^\s*(\d+):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)\s*$"
    part = lambda k: F.replace(F.regexp_extract(c, m, k), F.lit(","), F.lit(".")).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def clock_whole_seconds(c: Column) -> Column:
    """``H:M:S.ms`` as whole seconds: the fraction is dropped."""
    return F.floor(clock_seconds(c)).cast("long")


def any_seconds(c: Column) -> Column:
    """A number, numeric text or ``HH:MM:SS`` as seconds; else null."""
    text = c.cast("string")
    return F.coalesce(F.trim(text).try_cast("double"), clock_seconds(text))


def srt_clock(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS,mmm``."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def cue_end(end: Column, duration: Column) -> Column:
    """End of a cue; the video's duration where it is missing or no number."""
    return F.coalesce(F.nullif(end.try_cast("double"), F.lit(float("nan"))), duration)


def cue_span(start: Column, end: Column, offset: Column, duration: Column) -> Column:
    """(start, end, middle) of a cue on the clock of a video that starts at ``offset``; an end that is no number is the duration."""
    a, b = start - offset, cue_end(end, duration) - offset
    return F.struct(a.alias("start"), b.alias("end"), ((a + b) / 2).alias("middle"))


def repaired_cue(start: Column, end: Column, duration: Column) -> Column:
    """(start, end) for burning in: cues under a second become one around their middle, clamped to the video; null when outside."""
    middle, short = (start + end) / 2, (end - start) < 1
    a, b = F.when(short, middle - 0.5).otherwise(start), F.when(short, middle + 0.5).otherwise(end)
    fits = (b >= 0) & (a <= duration)
    return F.when(fits, F.struct(F.greatest(F.lit(0.0), a).alias("start"), F.least(duration, b).alias("end")))


def length_bucket(seconds: Column) -> Column:
    """Bucket of a video length: [0,60), [60,600), [600,3600), [3600,)."""
    out = None
    for limit, name in LENGTHS:
        if limit is None:
            return out.when(seconds >= LENGTHS[-2][0], name)
        out = F.when((seconds >= 0) & (seconds < limit), name) if out is None else out.when(seconds < limit, name)
    return out


def frame_step(fps: Column, interval: float = 1.0) -> Column:
    """Frames between samples, at least 1; rounds half to even."""
    return F.greatest(F.lit(1), F.bround(fps * interval).cast("int"))


def window_of(frame: Column, size: int = 8) -> Column:
    return F.floor(frame / size).cast("int")


def window_frames(window: Column, size: int = 8, total: Column | None = None) -> Column:
    """Frames of a window, cut at the video's last frame."""
    last = (window + 1) * size
    last = F.least(last, total) if total is not None else last
    return F.when(last > window * size, F.sequence((window * size).cast("int"), (last - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def window_count(total: Column, size: int = 8) -> Column:
    return F.ceil(total / size).cast("int")


def uniform_sample(n: Column, k: Column | int, rule: str = "linspace") -> Column:
    """``k`` positions out of ``n``: ``linspace`` truncates, ``round`` rounds half to even, ``stride`` is floor(i n / k)."""
    k = F.lit(k) if isinstance(k, int) else k
    index = F.sequence(F.lit(0), k - 1)
    step = {
        "linspace": lambda i: F.when(k == 1, F.lit(0)).otherwise(F.floor((i * (n - 1)) / F.greatest(k - 1, F.lit(1))).cast("int")),
        "round": lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int"),
        "stride": lambda i: F.floor(i * n / k).cast("int"),
    }[rule]
    return F.when((n > 0) & (k > 0), F.when((k >= n) & F.lit(rule != "stride"), F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.transform(index, step))).otherwise(F.array().cast("array<int>"))


def centre_or_linspace(n: Column, k: int) -> Column:
    """The middle for one frame, else evenly spread positions."""
    return F.array(F.floor(n / 2).cast("int")) if k == 1 else uniform_sample(n, k, "linspace")


def segment_centres(start: Column, end: Column, segments: int = 32) -> Column:
    """Centre of each of ``segments`` equal segments of [start, end]."""
    size = (end - start) / F.lit(float(segments))
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.floor(start + size / 2 + F.bround(size * i)).cast("int"))


def step_sample(n: Column, parts: int = 8) -> Column:
    """``range(0, n, n // parts)`` cut to ``parts``."""
    step = F.greatest(F.floor(n / parts).cast("int"), F.lit(1))
    return F.when(n > 0, F.slice(F.sequence(F.lit(0), (n - 1).cast("int"), step), 1, parts)).otherwise(F.array().cast("array<int>"))


def last_frames(frames: Column, k: int = 16) -> Column:
    return F.when(F.size(frames) > k, F.slice(frames, -k, k)).otherwise(frames)


def eight_frames(n: Column) -> Column:
    """Exactly 8 positions: by stride, or all padded with the last."""
    few = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.least(i, n - 1).cast("int"))
    step = F.floor(n / 8).cast("int")
    return F.when(n >= 8, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i * step).cast("int"))).when(n > 0, few)


def segments_of_positions(positions: Column, reach: int = 100) -> Column:
    """Frames of inclusive pairs of positions; an odd last one reaches ``reach`` to both sides; distinct, sorted, from 0."""
    pairs = F.floor(F.size(positions) / 2).cast("int")
    whole = F.when(pairs > 0, F.flatten(F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.sequence(F.greatest(positions[i * 2], F.lit(0)), F.greatest(positions[i * 2 + 1], F.lit(0)))))).otherwise(F.array().cast("array<int>"))
    last = F.element_at(positions, -1)
    odd = F.when(F.size(positions) % 2 == 1, F.sequence(F.greatest(last - reach, F.lit(0)), last + reach)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(whole, odd)))


def speed_factors(important: Column, total: Column, target: Column) -> Column:
    """Speed of the important and of the other frames when the first get two thirds of the output."""
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return F.struct(ratio(important, target * F.lit(2.0 / 3)).alias("important"), ratio(total - important, target * F.lit(1.0 / 3)).alias("other"))


def fit_scale(width: Column, height: Column, max_width: int, max_height: int) -> Column:
    """Factor that fits a frame into a box; never enlarges."""
    return F.least(F.lit(1.0), F.lit(float(max_width)) / width, F.lit(float(max_height)) / height)


def longest_side_scale(width: Column, height: Column, longest: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def closest_ratio(width: Column, height: Column, ratios: list[tuple[int, int]], side: int) -> Column:
    """The (across, down) of ``ratios`` whose quotient is nearest the frame's; of equally near ones a later one is taken
    where the frame has more than half the area of its tiles of ``side`` pixels."""
    best = F.array(F.lit(1), F.lit(1))
    apart = F.lit(float("inf"))
    given = F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in ratios])
    state = F.struct(apart.alias("d"), best.alias("r"))

    def step(s: Column, r: Column) -> Column:
        d = F.abs(width / height - r[0] / r[1])
        take = (d < s["d"]) | ((d == s["d"]) & (width * height > F.lit(0.5 * side * side) * r[0] * r[1]))
        return F.struct(F.least(d, s["d"]).alias("d"), F.when(take, r).otherwise(s["r"]).alias("r"))

    return F.aggregate(given, state, step)["r"]


def capped_images(given: Column, before: Column, most: int = 150) -> Column:
    """How many of a turn's images fit when ``before`` were sent already and a conversation holds ``most``."""
    return F.greatest(F.lit(0), F.least(given, F.lit(most) - before))


def repeated_captions(captions: Column, times: int) -> Column:
    return F.flatten(F.transform(captions, lambda c: F.array_repeat(c, times)))


def numbered_captions(captions: Column, sign: str = "#C") -> Column:
    return F.array_join(F.transform(captions, lambda c, i: F.concat(F.lit(f"{sign} "), (i + 1).cast("string"), F.lit(": "), c)), "\n")
