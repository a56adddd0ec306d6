"""Most similar vectors for every vector, by multi-index hashing.

Every distinct vector gets ``CODE_BITS`` sign bits under rotations learned on a bounded sample (iterative quantisation).
Substrings of the code (``TABLES`` or more, each a table) are indexed; the vectors of a substring's bucket are compared
with each other and with those of all buckets within ``RADIUS`` bits of it.  Pairs whose whole codes are close are
reranked by their floats.  How close, and how many tables it takes, follows from the least similarity asked for
(:func:`plan_search`); where too many would be needed, the exact way compares all vectors block by block.

Tables are cut into blocks by the leading bits of the substring once they exceed ``BLOCK_ROWS`` vectors.  A vector goes to
one block of each table, so a task holds one block and the rows sent are a table's vectors whatever the collection's size;
that the leading bits must then be equal is made up for by more tables, ``TABLES`` of them in one shuffle.  No bucket is
capped: vectors with more than ``CROWD`` near ones in their bucket are compared by floats in blocks, which never puts out
all pairs of a dense group.

Vectors that are null, of another length, NaN-bearing or all zero have no similarity.  Exact copies are searched once:
the neighbours of a copy are those of its group, of which the smallest ids count first, so groups of any size cost a
few rows.  Similarity is the cosine rounded to 6 decimals; equal ones go by smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import cut, release, stored, vectors

CODE_BITS = 128
TABLES = 5
RADIUS = 2
#: Vectors one task indexes, and the least in a bucket on average.
BLOCK_ROWS, BUCKET_ROWS = 1 << 20, 8
#: Vectors the rotations are learned on.
SAMPLE = 6_000
#: Share of the pairs of the least similarity that the tables must be expected to retrieve, and the most tables for that.
EXPECTED, MOST_TABLES = 0.99, 192
#: Codes are near if they are at most the mean and so many deviations apart for the least similarity: whole, first half.
SLACK, HALF_SLACK = 3.75, 5.0
#: Bits of the filter that keeps the floats of candidates: so many times their ids, within bounds (8 MB are broadcast at
#: most).  A fuller filter only lets more floats through to the joins, which take those of candidates alone.
FILTER_SHARE, LEAST_FILTER, MOST_FILTER = 8, 1 << 20, 1 << 26
#: Vectors in each of the two blocks that a task of the exact way compares.
EXACT_ROWS = 20_000
#: Near codes in its bucket up to which a vector is paired with them; vectors with more go the exact way among themselves,
#: which keeps the best of each and not every pair.
CROWD = 2_000
#: Odd factor below 2^31 that spreads 32 bits over the filter without overflow.
MIX = 0x5E3779B1


def learn_rotations(sample: np.ndarray, seed: int = 7, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dim x CODE_BITS): square blocks, each turned until the signs fit the sample best."""
    dim = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    moved = unit - centre
    random = np.random.default_rng(seed)
    blocks = []
    for _ in range(-(-CODE_BITS // dim)):
        turn = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            signs = np.where(moved @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(moved.T @ signs)
            turn = u @ v
        blocks.append(turn)
    return centre, np.concatenate(blocks, axis=1)[:, :CODE_BITS]


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows, matrix = vectors(column, dim)
    fine = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
    return rows[fine], matrix[fine]


CODED = "vec_id long, h1 long, h2 long, c1 long, c2 long"


def coder(centre: np.ndarray, turn: np.ndarray):
    """Batches of (vec_id, embedding) to content hash and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, matrix = usable(b.column("embedding"), len(centre))
            unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            bits = np.packbits(unit @ turn >= centre @ turn, axis=1)
            codes = np.ascontiguousarray(bits).view("<i8").reshape(len(rows), -1)
            h = content_hashes(matrix)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), *[pa.array(np.ascontiguousarray(x)) for x in (h[:, 0], h[:, 1], codes[:, 0], codes[:, 1])]], names=["vec_id", "h1", "h2", "c1", "c2"])

    return run


@dataclass(frozen=True)
class Search:
    """Bits of a substring and of the block number in it, tables, the most bits near codes differ in (whole, first half), and
    the most near codes in its bucket that a vector is paired with."""

    bits: int
    block_bits: int
    tables: int
    near: int
    near_half: int
    crowd: int


def plan_search(n: int, least: float) -> Search:
    """How to search ``n`` codes for pairs of at least this cosine.

    The bits of two codes differ with a chance of angle / pi.  A table retrieves a pair if the block bits of its substrings
    are equal and the others differ in ``RADIUS`` bits at most, so the chance of all tables missing it tells how many are
    needed.
    """
    block_bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK_ROWS))))
    inner = max(1, int(np.log2(max(1, (n >> block_bits) / BUCKET_ROWS))))
    p = float(np.arccos(np.clip(least, -1.0, 1.0)) / np.pi)
    tables = next((t for t in range(TABLES, MOST_TABLES + 1) if retrieved(p, block_bits, inner, t) >= EXPECTED), None)
    if tables is None:
        raise ValueError(f"more than {MOST_TABLES} tables would be needed for a similarity of {least}; use exact=True")
    far = lambda size, slack: int(size * p + slack * sqrt(size * p * (1 - p)))
    return Search(block_bits + inner, block_bits, tables, far(CODE_BITS, SLACK), far(CODE_BITS // 2, HALF_SLACK), CROWD)


def retrieved(p: float, block_bits: int, inner: int, tables: int) -> float:
    """Share of the pairs whose bits differ with chance ``p`` that the tables retrieve.

    Tables that read bits of their own miss a pair independently.  Once bits are used again they do so only given how many
    bits of the whole code differ.
    """
    bits = block_bits + inner
    if bits * tables <= CODE_BITS:
        one = (1 - p) ** block_bits * sum(comb(inner, r) * p**r * (1 - p) ** (inner - r) for r in range(RADIUS + 1))
        return 1 - (1 - min(one, 1.0)) ** tables
    share = 0.0
    for d in range(CODE_BITS + 1):
        one = sum(comb(inner, r) * comb(CODE_BITS - bits, d - r) for r in range(min(RADIUS, d) + 1)) / comb(CODE_BITS, d)
        share += comb(CODE_BITS, d) * p**d * (1 - p) ** (CODE_BITS - d) * (1 - (1 - one) ** tables)
    return share


def substring_bits(bits: int, tables: int) -> list[np.ndarray]:
    """Places of the code each table reads, fixed by the numbers: the code in a random order, and in others when it is used up."""
    random = np.random.default_rng(11)
    order = np.concatenate([random.permutation(CODE_BITS) for _ in range(-(-bits * tables // CODE_BITS))])
    if bits * tables > CODE_BITS:  # a substring never holds a bit twice
        each = CODE_BITS // bits
        order = np.concatenate([order[k * CODE_BITS : k * CODE_BITS + each * bits] for k in range(len(order) // CODE_BITS)] + [random.permutation(CODE_BITS)[: each * bits] for _ in range(tables)])
    return [order[t * bits : (t + 1) * bits] for t in range(tables)]


def substring_key(c1: Column, c2: Column, places: np.ndarray) -> Column:
    """The substring as an integer, in the JVM (needed for the block number only)."""
    key = F.lit(0).cast("long")
    for k, p in enumerate(places):
        # packbits puts the first bit of a byte at its high end
        word, at = (c1, c2)[int(p) // 64], int(p) % 64
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, 8 * (at // 8) + 7 - at % 8).bitwiseAND(F.lit(1).cast("long")), k))
    return key


def read_key(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    key = np.zeros(len(codes), dtype=np.int64)
    for k, p in enumerate(places):
        at = int(p) % 64
        key |= ((codes[:, int(p) // 64] >> np.uint64(8 * (at // 8) + 7 - at % 8)) & np.uint64(1)).astype(np.int64) << k
    return key


def masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(most + 1) for c in combinations(range(bits), r)]


def close_pairs(ids: np.ndarray, codes: np.ndarray, key: np.ndarray, bits: int, at_home: np.ndarray, radius: np.ndarray | int, search: Search, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows ``at_home`` whose keys are within the radius and whose whole codes are near; a crowded row, one with
    more than ``search.crowd`` near rows in its bucket, is paired with itself and with no other crowded row."""
    home = np.flatnonzero(at_home)
    order = home[np.argsort(key[home], kind="stable")]
    offset = np.zeros((1 << bits) + 1, dtype=np.int64)
    np.cumsum(np.bincount(key[order], minlength=1 << bits), out=offset[1:])
    first, second, own_ids = np.ascontiguousarray(codes[order, 0]), np.ascontiguousarray(codes[order, 1]), ids[order]
    size = np.diff(offset)
    crowded = np.zeros(len(order), dtype=bool)
    differ, count, close = np.empty(chunk, dtype=np.uint64), np.empty(chunk, dtype=np.uint8), np.empty(chunk, dtype=bool)

    def hits(jobs: list[tuple[int, int, int, int]], used: int, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near rows among the first ``used`` places of the buffer."""
        np.bitwise_count(differ[:used], out=count[:used])
        # The first half alone drops nearly all.
        at = np.flatnonzero(np.less_equal(count[:used], search.near_half, out=close[:used]))
        begin, row, column, width = np.array(jobs, dtype=np.int64).T
        job = np.searchsorted(begin, at, side="right") - 1
        down, along = np.divmod(at - begin[job], width[job])
        u, v = row[job] + down, right[column[job] + along]
        both = np.flatnonzero(count[at] + np.bitwise_count(second[u] ^ second[v]) <= search.near)
        if len(both):
            yield u[both], v[both]

    def near(buckets: np.ndarray, right: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near rows among those of each bucket and its part of ``right``, which are up to ``ends``."""
        halves = first[right]
        jobs, used, start = [], 0, 0
        for top, bottom, end in zip(offset[buckets].tolist(), offset[buckets + 1].tolist(), ends.tolist()):
            for column in range(start, end, chunk):
                half = halves[column : min(end, column + chunk)]
                step = chunk // len(half)
                for row in range(top, bottom, step):
                    left = first[row : min(bottom, row + step)]
                    n = len(left) * len(half)
                    if used + n > chunk:
                        yield from hits(jobs, used, right)
                        jobs, used = [], 0
                    np.bitwise_xor(left[:, None], half, out=differ[used : used + n].reshape(len(left), len(half)))
                    jobs.append((used, row, column, len(half)))
                    used += n
            start = end
        if used:
            yield from hits(jobs, used, right)

    for bucket in np.flatnonzero(size > search.crowd):
        begin, end = int(offset[bucket]), int(offset[bucket + 1])
        others = np.zeros(end - begin, dtype=np.int64)
        for u, v in near(np.array([bucket]), np.arange(begin, end), np.array([end - begin])):
            others += np.bincount(u[u != v] - begin, minlength=len(others))
        crowded[begin:end] = others > search.crowd
    if crowded.any():
        yield own_ids[crowded], own_ids[crowded]
    # Every bucket meets itself and those of larger number in reach, as many buckets at once as meet about two chunks of rows.
    buckets = np.flatnonzero(size)
    reach = np.array(masks(bits, int(np.max(radius, initial=0))), dtype=np.int64)
    met = np.zeros(len(buckets), dtype=np.int64)
    for mask in reach:
        there = buckets ^ mask
        met += np.where(there >= buckets, size[there], 0)
    total, begin = np.cumsum(met), 0
    while begin < len(buckets):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + 2 * chunk, side="right")))
        some = buckets[begin:end, None]
        there = some ^ reach
        there = there[there >= some]
        n = size[there]
        right = np.repeat(offset[there] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for u, v in near(buckets[begin:end], right, total[begin:end] - done):
            once = (u < v) & ~(crowded[u] & crowded[v])
            if once.any():
                yield own_ids[u[once]], own_ids[v[once]]
        begin = end


PAIRS = "u long, v long"


def block_search(search: Search, begin: int):
    """Search every (table, block) that a partition holds; ``begin`` is the first table sent."""
    inner = search.bits - search.block_bits
    places = substring_bits(search.bits, search.tables)[begin:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        block = pa.Table.from_batches(held)
        held.clear()
        task = block["task"].to_numpy()
        ids = block["vec_id"].to_numpy()
        codes = np.stack([block["c1"].to_numpy(), block["c2"].to_numpy()], axis=1).view(np.uint64)
        for one in np.unique(task):
            key = read_key(codes, places[int(one) >> search.block_bits][:inner])
            found, rows = [], 0
            for x, y in close_pairs(ids, codes, key, inner, task == one, RADIUS, search):
                found.append((np.minimum(x, y), np.maximum(x, y)))
                rows += len(x)
                if rows >= 1 << 20:
                    yield pairs_batch(found)
                    found, rows = [], 0
            if found:
                yield pairs_batch(found)

    return run


def pairs_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], names=["u", "v"])


def candidate_pairs(codes: DataFrame, search: Search) -> DataFrame:
    """Distinct pairs u < v of ``codes`` (vec_id, c1, c2) that the tables retrieve, near by whole code; u = v marks crowded ones.

    ``TABLES`` at most are shuffled at once, and their shuffle is released before the next, so the disk it takes doesn't grow with them.
    """
    places = substring_bits(search.bits, search.tables)
    inner = search.bits - search.block_bits
    parts, step = [], -(-search.tables // -(-search.tables // TABLES))
    for begin in range(0, search.tables, step):
        some = places[begin : begin + step]
        blocks = [F.lit(t << search.block_bits) + substring_key(F.col("c1"), F.col("c2"), p[inner:]).cast("int") for t, p in enumerate(some)]
        sent = codes.select("vec_id", "c1", "c2", F.explode(F.array(*blocks)).alias("task"))
        pairs = sent.repartitionById(len(some) << search.block_bits, F.col("task")).mapInArrow(block_search(search, begin), PAIRS).distinct()
        if search.tables <= TABLES:
            return pairs
        parts.append(stored(pairs))
        del sent, pairs
        release(codes.sparkSession)
    return reduce(DataFrame.unionByName, parts).distinct()


def exact_pairs(items: DataFrame, reps: DataFrame, n: int, k: int, least: float, dim: int) -> DataFrame:
    """Distinct pairs u < v of ``reps`` (vec_id), each among the other's best, by comparing all vectors block by block.

    A block has about ``EXACT_ROWS`` vectors; a task holds two and leaves of each vector the k + 1 best of the other block.
    The work grows with the square of n, the state of a task does not.
    """
    blocks = max(1, -(-n // EXACT_ROWS))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    sides = items.join(reps.select("vec_id"), "vec_id", "left_semi").select("vec_id", "embedding", own.alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = sides.select("vec_id", "embedding", "own", other.alias("other")).select("vec_id", "embedding", (F.col("own") <= F.col("other")).alias("first"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(block: pa.Table) -> pa.Table:
        ids, floats = block["vec_id"].to_numpy(), block["embedding"].combine_chunks()
        rows, matrix = usable(floats, dim)
        ids, unit = ids[rows], matrix.astype(np.float32).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        first = block["first"].to_numpy()[rows]
        one_block = block["i"][0].as_py() == block["j"][0].as_py()
        groups = [(np.arange(len(ids)), np.arange(len(ids)))] if one_block else [(np.flatnonzero(first), np.flatnonzero(~first)), (np.flatnonzero(~first), np.flatnonzero(first))]
        us, vs = [], []
        for a, b in groups:
            for begin in range(0, len(a), 500):
                part = a[begin : begin + 500]
                sim = np.round(unit[part] @ unit[b].T, 6)
                r, c = np.nonzero((sim >= least) & (ids[part][:, None] != ids[b][None, :]))
                order = np.lexsort((ids[b[c]], -sim[r, c], r))
                r, c = r[order], c[order]
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, dtype=np.int64)
                nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                r, c = r[nth <= k], c[nth <= k]
                us.append(ids[part[r]])
                vs.append(ids[b[c]])
        u, v = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (us, vs))
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return sent.groupBy("i", "j").applyInArrow(compare, PAIRS).distinct()


def filter_bits(ids: int) -> int:
    """Size of a filter for so many ids: a power of two."""
    return min(MOST_FILTER, max(LEAST_FILTER, 1 << (FILTER_SHARE * ids).bit_length()))


def filter_slot(column: str, size: int) -> Column:
    """Place of an integer in a filter of ``size`` bits; :func:`slot` is the same in numpy."""
    return F.expr(f"shiftright((({column} ^ shiftrightunsigned({column}, 32)) & 4294967295L) * {MIX}L, 24) & {size - 1}")


def slot(values: np.ndarray, size: int) -> np.ndarray:
    v = values.view(np.uint64)
    return (((((v ^ (v >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) * np.uint64(MIX)) >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)


def id_filter(ids: DataFrame, size: int) -> np.ndarray:
    """A bit array of ``size`` that holds the slots of all ids (and so of some others)."""
    words = ids.select(filter_slot("id", size).alias("at")).groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def in_filter(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 6] >> (at & 63)) & 1).astype(bool)


def content_hashes(matrix: np.ndarray) -> np.ndarray:
    """128-bit hash of every row as two integers; equal vectors (with either zero) have equal hashes."""
    raw = np.ascontiguousarray(matrix + 0.0, dtype=np.float64)
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in raw), dtype="<i8").reshape(-1, 2)


def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.float32).reshape(b.num_rows, -1).astype(np.float64) for c in ("x", "y"))
        cosine = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(np.round(cosine, 6))], names=["u", "v", "sim"])


def similar_pairs(items: DataFrame, k: int = 5, least: float = 0.93, dim: int = 64, exact: bool = False) -> DataFrame:
    """``vec_a < vec_b, sim``: b is among the k most similar of a or a among those of b, with similarity ``least`` or more.

    ``items`` has vec_id (unique) and embedding.  With ``exact`` every two distinct vectors are compared, in blocks.
    """
    items = items.select("vec_id", "embedding")
    n = items.count()  # of all rows: no column is read for it
    items = items.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim))
    nothing = items.sparkSession.createDataFrame([], "vec_a long, vec_b long, sim double")
    every = max(1, n // SAMPLE)
    picked = items.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(2 * SAMPLE).toArrow()
    picked = picked.sort_by("vec_id")  # so that the rotations don't depend on the order of arrival
    sample = usable(picked["embedding"].combine_chunks(), dim)[1] if picked.num_rows else np.zeros((0, dim))
    if len(sample) < 2:
        sample = np.random.default_rng(5).normal(size=(256, dim))
    if n == 0:
        return nothing
    centre, turn = learn_rotations(sample)
    coded = items.mapInArrow(coder(centre, turn), CODED)
    w = W.partitionBy("h1", "h2").orderBy("vec_id")
    members = stored(coded.withColumn("nth", F.row_number().over(w)).withColumn("rep", F.first("vec_id").over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("nth") <= k + 1))
    reps = members.where("nth = 1")
    if exact:
        pairs = cut(exact_pairs(items, reps, reps.count(), k, least, dim))
    else:
        pairs = cut(candidate_pairs(reps.select("vec_id", "c1", "c2"), plan_search(reps.count(), least)))
        crowd = pairs.where("u = v").select(F.col("u").alias("vec_id"))
        if (many := crowd.count()) > 0:
            pairs = cut(pairs.where("u < v").unionByName(exact_pairs(items, crowd, many, k, least, dim)).distinct())

    # One more look at the table: the floats of candidates, and the copies beyond the k + 1 smallest ids of crowded groups.
    crowded = members.where(F.col("nth") == k + 1).select("h1", "h2", F.col("rep").alias("x"), F.col("vec_id").alias("sixth"))
    any_crowded = not crowded.isEmpty()
    context = items.sparkSession.sparkContext
    size = filter_bits(2 * pairs.count())
    wanted = context.broadcast(id_filter(pairs.select(F.explode(F.array("u", "v")).alias("id")), size))
    crowded_size = filter_bits(crowded.count()) if any_crowded else 0
    copied = context.broadcast(id_filter(crowded.select(F.col("h1").alias("id")), crowded_size)) if any_crowded else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, matrix = usable(b.column("embedding"), dim)
            near = in_filter(wanted.value, b.column("at").to_numpy()[rows])
            h = np.zeros((len(rows), 2), dtype=np.int64)
            more = np.zeros(len(rows), dtype=bool)
            if copied is not None and len(rows):
                h = content_hashes(matrix)
                more = in_filter(copied.value, slot(h[:, 0], crowded_size))
            hit = np.flatnonzero(near | more)
            floats = matrix.astype(np.float32)
            x = pa.array([floats[i].tobytes() if near[i] else None for i in hit], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows[hit])), x, *[pa.array(h[hit, j], mask=~more[hit]) for j in range(2)]], names=["id", "x", "h1", "h2"])

    seen = stored(items.withColumn("at", filter_slot("vec_id", size)).mapInArrow(keep, "id long, x binary, h1 long, h2 long"))
    floats = seen.where("x is not null").select("id", "x")
    scored = (
        pairs.join(floats.select(F.col("id").alias("u"), "x"), "u").join(floats.select(F.col("id").alias("v"), F.col("x").alias("y")), "v")
        .mapInArrow(rerank, "u long, v long, sim double").where(F.col("sim") >= least)
    )
    scored = cut(scored)

    # Each distinct vector's k + 1 best, over the smallest ids of every near group, its own included.
    copies = members.where("nth >= 2").select("rep", F.col("vec_id").alias("member"), "nth")
    copies = cut(copies.unionByName(copies.where("nth = 2").select("rep", F.col("rep").alias("member"), F.lit(1).alias("nth"))))
    directed = scored.select(F.col("u").alias("x"), F.col("v").alias("y"), "sim").unionByName(scored.select(F.col("v").alias("x"), F.col("u").alias("y"), "sim"))
    directed = directed.unionByName(copies.where("nth = 1").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("sim")))
    spread = directed.join(copies.select(F.col("rep").alias("y"), "member"), "y", "left").select("x", F.coalesce("member", "y").alias("y"), "sim")
    best = W.partitionBy("x").orderBy(F.desc("sim"), "y")
    lists = spread.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # A distinct vector's list holds for every copy of it; each leaves itself out and takes k.
    owners = lists.join(copies.select(F.col("rep").alias("x"), F.col("member").alias("owner"), "nth"), "x", "left")
    chosen = owners.select(F.coalesce("owner", "x").alias("x"), "y", "sim", "place").where("x <> y")
    final = W.partitionBy("x").orderBy("place")
    taken = chosen.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    pair = [F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "sim"]
    result = taken.select(*pair).distinct()
    if any_crowded:
        # The copies beyond the k + 1 smallest are in no list: theirs holds as it is, and nothing else gives their pairs.
        rest = seen.where("h1 is not null").select("id", "h1", "h2").join(crowded, ["h1", "h2"]).where("id > sixth").select("x", F.col("id").alias("owner"))
        result = result.unionByName(lists.where(F.col("place") <= k).join(rest, "x").select(F.col("owner").alias("x"), "y", "sim").select(*pair))
    return result
