"""Operators that build, split, merge and repair question datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order; never by arrival."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def keep_last(df: DataFrame, keys: list[str], value: Column, order: Column, name: str) -> DataFrame:
    """Last value of each key: later entries replace earlier ones."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def shuffle_key(ident: Column, seed: int) -> Column:
    """Order of a seeded shuffle; the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")))


def ranked(df: DataFrame, order: list, name: str = "place", parts: int = 4096) -> DataFrame:
    """Global position from 0 without one task seeing all rows: counts per hash range plus a rank inside each.

    ``order`` starts with a hexadecimal text column such as :func:`shuffle_key`; its leading digits give ``parts`` ranges or
    more.
    """
    digits = max(1, -(-(parts - 1).bit_length() // 4))
    rows = df.withColumn("_part", F.conv(F.substring(order[0], 1, digits), 16, 10).cast("int"))
    return placed_in_parts(rows, ["_part"], order, name).drop("_part")


def placed_in_parts(rows: DataFrame, parts: list[str], order: list, name: str) -> DataFrame:
    """Position of each row in the order of ``parts``, then ``order``; only the counts of parts meet in one task."""
    counts = rows.groupBy(*parts).agg(F.count("*").alias("_n"))
    earlier = W.orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*[F.col(p).alias(f"_of{p}") for p in parts], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*parts).orderBy(*order)) - 1
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_of{p}")) for p in parts])
    return rows.join(F.broadcast(before), same).withColumn(name, F.col("_before") + inside).drop("_before", *[f"_of{p}" for p in parts])


def train_test_split(df: DataFrame, ident: str, ratio: float, seed: int = 42) -> DataFrame:
    """Exactly floor(n * ratio) rows in ``train`` by seeded shuffle, the rest in ``test``."""
    placed = ranked(df, [shuffle_key(F.col(ident), seed), F.col(ident)], "_place")
    total = df.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_train"))
    return placed.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("_place") < F.col("_train"), "train").otherwise("test")).drop("_place", "_train")


def contiguous_shard(placed: DataFrame, total: int, rank: int, world: int, place: str = "place") -> DataFrame:
    """Rows of shard ``rank`` of ``world`` contiguous ones; the first shards take the remainder."""
    return placed.where(shard_of(F.col(place), F.lit(total), world) == rank)


def shard_of(place: Column, total: Column, world: int) -> Column:
    """Number of the contiguous shard a position lies in."""
    size, more = F.floor(total / world), total % world
    long = (size + 1) * more
    return F.when(place < long, F.floor(place / (size + 1))).otherwise(F.floor((place - more) / F.greatest(size, F.lit(1)))).cast("long")


def round_robin(placed: DataFrame, world: int, place: str = "place") -> DataFrame:
    return placed.withColumn("shard", F.pmod(F.col(place), F.lit(world)).cast("int"))


def sample_positions(df: DataFrame, ident: str, most: int, seed: int = 42) -> DataFrame:
    """All rows if they are few, else ``most`` by seeded shuffle, in the original order."""
    return df.orderBy(shuffle_key(F.col(ident), seed), ident).limit(most).orderBy(ident)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def merged_shards(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of shards; a key in two of them is an error."""
    whole = merged(parts)
    twice = duplicate_keys(whole, keys).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    return whole


def overlay(base: DataFrame, changed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``base`` with the columns of ``changed`` where it has the key."""
    new = changed.select(key, F.struct(*columns).alias("_new"))
    joined = base.join(new, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


#: Rows of one file that share a task when they are numbered.
PART_ROWS = 1_000_000


def running_offset(files: DataFrame, file: str | None, order: str, *ties: str) -> DataFrame:
    """Global ``index`` over files in order: rows of the files before plus the position inside, by the number ``order``.

    A file of any size is cut into ranges of ``order`` at quantiles, so no task sorts all of it; the driver holds the cuts.
    """
    rows = files if file else files.withColumn("_file", F.lit(0))
    n = min(4096, files.count() // PART_ROWS)
    cuts = sorted(set(files.select(F.percentile_approx(order, [k / (n + 1) for k in range(1, n + 1)], 20_000)).first()[0] or [])) if n else []
    part = F.lit(0)
    for low in range(0, len(cuts), 64):  # two steps: which block of cuts, which cut of it
        inner = reduce(lambda a, c: a + (F.col(order) >= c).cast("int"), cuts[low : low + 64], F.lit(low))
        part = F.when(F.col(order) >= cuts[low], inner).otherwise(part) if low else inner
    return placed_in_parts(rows.withColumn("_cut", part), [file or "_file", "_cut"], [order, *ties], "index").drop("_cut", "_file")


def repaired_rows(df: DataFrame) -> DataFrame:
    """RL rows with text video ids and choices at every nested place."""
    info = F.col("extra_info")
    info = info.withField("correct_choice", info["correct_choice"].cast("string")).withField("metadata", info["metadata"].withField("video_id", info["metadata"]["video_id"].cast("string")))
    tools = info["tools_kwargs"]["video_search"]["execute_kwargs"]
    info = info.withField("tools_kwargs.video_search.execute_kwargs.video_id", tools["video_id"].cast("string"))
    return df.withColumn("extra_info", info)


def padded(options: Column, n: int = 5, cut: bool = True) -> Column:
    """Options padded to ``n`` with empty ones."""
    filled = F.concat(options, F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size(options), F.lit(0))))
    return F.slice(filled, 1, n) if cut else filled


def members(df: DataFrame, wanted: DataFrame, keys: list[str], question: str | None = None) -> DataFrame:
    """Rows whose key is wanted; with ``question`` also by question unless the wanted set has none for the key."""
    if question is None:
        return df.join(wanted.select(*keys).distinct(), keys, "left_semi")
    some = wanted.groupBy(*keys).agg(F.count(question).alias("_asked"))
    pairs = wanted.where(F.col(question).isNotNull()).select(*keys, question).distinct().withColumn("_hit", F.lit(True))
    return df.join(some, keys).join(pairs, [*keys, question], "left").where((F.col("_asked") == 0) | F.col("_hit")).select(*[df[c] for c in df.columns])


def substring_join(big: DataFrame, text: str, small: DataFrame, part: str, most: int = 10_000) -> DataFrame:
    """Rows of ``big`` whose text contains a part.

    Up to ``most`` parts are broadcast; more are joined by equality with the pieces of the texts of the lengths parts have.
    """
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), F.contains(F.col(text), F.col(part)))
    cut = pieces(big.where(F.col(text).isNotNull()), F.col(text), small.select(F.length(part).alias("_n")).distinct(), "_piece")
    return cut.join(small, F.col("_piece") == F.col(part)).drop("_piece")


def pieces(df: DataFrame, text: Column, lengths: DataFrame, name: str) -> DataFrame:
    """Every row once for each distinct piece of its text of one of the ``lengths`` (``_n``), which are few."""
    places = F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)
    fits = df.crossJoin(F.broadcast(lengths)).where(F.length(text) >= F.col("_n"))
    return fits.withColumn(name, F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.col("_n")))))).drop("_n")


def fuzzy_match(wanted: DataFrame, files: DataFrame, key: str, name: str) -> DataFrame:
    """File of each key: equal normalised name first, else the first (by name) that contains the key.

    Names are joined by equality on their parts of the lengths that keys have, each part with its first name, so any
    number of keys and files goes the same way; only the lengths are broadcast.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    w, f = wanted.select(key, norm(F.col(key)).alias("_k")), files.select(name, norm(F.col(name)).alias("_f"))
    exact = w.join(f, F.col("_k") == F.col("_f"))
    left = w.join(exact.select(key).distinct(), key, "left_anti")
    lengths = left.select(F.length("_k").alias("_n")).distinct()
    parts = pieces(f, F.col("_f"), lengths, "_k")
    loose = left.join(parts.groupBy("_k").agg(F.min(name).alias(name)), "_k")
    both = exact.select(key, name, F.lit(0).alias("rank")).unionByName(loose.select(key, name, F.lit(1).alias("rank")))
    return both.groupBy(key).agg(F.min(F.struct("rank", name)).alias("b")).select(key, F.col("b")[name].alias(name), (F.col("b.rank") == 0).alias("exact"))


def caption_plan(asked: DataFrame, existing: DataFrame, most: int | None = None, workers: int = 4) -> DataFrame:
    """Videos to caption: first-seen order, without existing ones, up to ``most``, spread over workers."""
    firsts = asked.groupBy("video_id").agg(F.min("pos").alias("pos"))
    todo = firsts.join(existing.select("video_id").distinct(), "video_id", "left_anti")
    todo = todo.orderBy("pos", "video_id").limit(most) if most is not None else todo
    placed = running_offset(todo, None, "pos", "video_id").withColumn("place", F.col("index").cast("int"))
    return placed.select("video_id", "pos", "place", (F.col("place") % workers).alias("worker"))
