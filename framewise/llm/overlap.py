"""Same or near-same records across splits.

Similarity-hash fingerprints: every distinct record text gets a 128-bit code.  The code is cut into eight segments of 16
bits, as it stands and under ``PERMUTATIONS - 1`` fixed permutations of its bits.  Records of two splits that share a segment
within one place (video and sequence of numbers, which must be equal anyway), and whose codes are at most ``RADIUS`` bits
apart, are compared as texts.  A segment of 16 bits is equal by chance once in 65,536 pairs, so a place of many different
records gives few candidates.  All codes at most seven bits apart share a segment (pigeonhole), a pair with one slip nearly
always does, and with each further slip it is less sure.  Pairs that no segment brings together meet by their frames: the
words that no slip may change, with a place for each of the others.  Records that are the same have equal frames, so none
is lost whatever its code.  Rows with the same text form one class first, so copies meet once, not in pairs.

Two records are the same if their questions have the same words and numbers in order, and their choices pair off, apart
from notation, lead-ins, number words and slips in longer words.  Rows with a null video, question, options or split
(or one that says nothing) give no case.  Repeated rows each count.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import cut, spread
from framewise.llm.normal import asked, choice_set, frame, same_choices, same_words, video_key

CODE_BITS, SEGMENT = 128, 16
#: Orders of the bits in which codes are cut into segments.
PERMUTATIONS = 2
#: Codes further apart than this don't meet by segments: a slip changes 8 bits or so.
RADIUS = 24

#: Between choices; words never hold it.
CHOICE = "\x1f"

PREPARED = "entry_id long, data_source string, side string, cls binary, place long, c1 long, c2 long, segments array<long>, frame long, question string, options string"
NAMES = [x.split()[0] for x in PREPARED.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()]


def features(word: str) -> list[str]:
    """Short words and numbers whole, longer words by their two ends, so that a slip changes one feature at most."""
    return [word] if len(word) < 5 or word.isdigit() else [word[:3] + "<", word[-3:] + ">"]


class Codes:
    """Similarity hashes of texts; a worker keeps the sign sums of words it has met."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, CODE_BITS), dtype=np.int8)
        turn = np.random.default_rng(13)
        self.orders = [np.arange(CODE_BITS), *[turn.permutation(CODE_BITS) for _ in range(PERMUTATIONS - 1)]]

    def row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.rows)
            if at == len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            for f in features(word):
                self.sums[at] += np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(f), dtype=np.uint8)).astype(np.int8) * 2 - 1
        return at

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x 2 integers) and segments (n x 8 a permutation; each holds its number above its bits).  No text is empty."""
        if len(self.rows) > 100_000:
            self.__init__()
        bits = np.zeros((len(texts), CODE_BITS), dtype=bool)
        for begin in range(0, len(texts), 1000):
            part = [[self.row(w) for w in words] for words in texts[begin : begin + 1000]]
            starts = np.cumsum([0, *[len(x) for x in part[:-1]]])
            total = np.add.reduceat(self.sums[np.concatenate(part)], starts, axis=0, dtype=np.int32)
            bits[begin : begin + len(part)] = total > 0
        codes = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
        cut_up = [np.ascontiguousarray(np.packbits(bits[:, o], axis=1)).view(">u2").astype(np.int64) for o in self.orders]
        segments = np.concatenate(cut_up, axis=1) if len(texts) else np.zeros((0, PERMUTATIONS * CODE_BITS // SEGMENT), dtype=np.int64)
        return codes, segments + (np.arange(segments.shape[1]) << SEGMENT)


def prepare(entries: DataFrame) -> DataFrame:
    """Normalised rows: ``cls`` names the text, ``place`` the video and numbers, ``frame`` hashes what slips leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codes()
        for b in batches:
            rows, texts = [], []
            for entry, source, video, question, options, side in zip(*[b.column(c).to_pylist() for c in ("entry_id", "data_source", "video_id", "question", "options", "split")]):
                video, side = video_key(video), side.strip().lower()
                words, choices = asked(question), choice_set(options)
                if not (video and words and choices and side):
                    continue
                joined, parts = " ".join(words), [" ".join(c) for c in choices]
                numbers = " ".join(w for w in words if w.isdecimal())
                place = xxhash.xxh3_64_intdigest(f"{video} {numbers}") - 2**63
                left = CHOICE.join([frame(words), *sorted(frame(c) for c in choices)])
                rows.append((entry, source, side, xxhash.xxh3_128_digest(CHOICE.join([video, joined, *parts])), place, xxhash.xxh3_64_intdigest(left) - 2**63, joined, CHOICE.join(parts)))
                texts.append([*words, *[w for c in choices for w in c]])
            codes, segments = coder.of(texts)
            cols = list(zip(*rows)) if rows else [[]] * 8
            width = segments.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(segments.reshape(-1)))
            plain = [pa.array(c, t) for c, t in zip(cols, TYPES[:5] + TYPES[8:])]
            yield pa.RecordBatch.from_arrays([*plain[:5], pa.array(codes[:, 0]), pa.array(codes[:, 1]), lists, *plain[5:]], names=NAMES)

    full = " and ".join(f"{c} is not null" for c in ("entry_id", "video_id", "question", "options", "split"))
    return spread(entries.where(full).select("entry_id", "data_source", "video_id", "question", "options", "split")).mapInArrow(run, PREPARED)


def same_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q1, q2, o1, o2 = (b.column(c).to_pylist() for c in ("question_a", "question_b", "options_a", "options_b"))
        choices = lambda t: [tuple(c.split(" ")) for c in t.split(CHOICE)]
        good = [same_words(x.split(" "), y.split(" ")) and same_choices(choices(u), choices(v)) for x, y, u, v in zip(q1, q2, o1, o2)]
        yield b.select(["cls_a", "cls_b"]).filter(pa.array(good, pa.bool_()))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that may be the same record: those that fingerprints find, and those of one frame.

    ``classes`` has cls, place, c1, c2, segments, frame, learns, tests.
    """
    # Only places with two texts or more, of both sides, can hold a pair; most hold one.
    useful = classes.groupBy("place").agg(F.count("*").alias("n"), F.max("learns").alias("l"), F.max("tests").alias("t")).where("n > 1 and l and t").select("place")
    kept = cut(classes.join(useful, "place", "left_semi"))
    both = [F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")]
    crossed = ((F.col("a.learns") & F.col("b.tests")) | (F.col("a.tests") & F.col("b.learns"))) & (F.col("a.cls") < F.col("b.cls"))
    keyed = kept.select("cls", "place", "c1", "c2", "learns", "tests", F.explode("segments").alias("segment"))
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.bit_count(F.col("a.c1").bitwiseXOR(F.col("b.c1"))) + F.bit_count(F.col("a.c2").bitwiseXOR(F.col("b.c2")))
    near = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.segment") == F.col("b.segment")) & crossed).where(apart <= RADIUS).select(*both)
    a, b = kept.alias("a"), kept.alias("b")
    framed = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.frame") == F.col("b.frame")) & crossed).select(*both)
    return near, framed


def class_links(rows: DataFrame, train: str) -> DataFrame:
    """``cls_a`` (with rows in training) and ``cls_b`` (with rows elsewhere) that are the same record, a class itself included."""
    learns = F.col("side") == train
    firsts = [F.first(c).alias(c) for c in ("place", "c1", "c2", "segments", "frame")]
    classes = cut(rows.groupBy("cls").agg(*firsts, F.max(learns).alias("learns"), F.max(~learns).alias("tests")))
    near, framed = candidates(classes)
    met = cut(near.unionByName(framed).distinct())
    ends = met.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    texts = rows.join(ends, "cls", "left_semi").groupBy("cls").agg(F.first("question").alias("question"), F.first("options").alias("options"))
    side = lambda x: texts.select(*[F.col(c).alias(f"{c}_{x}") for c in texts.columns])
    same = met.join(side("a"), "cls_a").join(side("b"), "cls_b").mapInArrow(same_texts, "cls_a binary, cls_b binary")
    equal = classes.where("learns and tests").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    return same.unionByName(same.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"))).unionByName(equal)


def overlaps(entries: DataFrame, train: str = "train") -> DataFrame:
    """Every pair of a training row and a row of another split that are the same record.

    Columns entry_a < entry_b, split_a, split_b, data_source_a, data_source_b.
    """
    rows = cut(prepare(entries))
    learns = F.col("side") == train
    linked = class_links(rows, train)
    left = rows.where(learns).select(F.col("cls").alias("cls_a"), F.col("entry_id").alias("t_id"), F.col("side").alias("t_split"), F.col("data_source").alias("t_source"))
    right = rows.where(~learns).select(F.col("cls").alias("cls_b"), F.col("entry_id").alias("e_id"), F.col("side").alias("e_split"), F.col("data_source").alias("e_source"))
    pairs = left.join(linked, "cls_a").join(right, "cls_b")
    first = F.col("t_id") < F.col("e_id")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return pairs.select(
        F.least("t_id", "e_id").alias("entry_a"), F.greatest("t_id", "e_id").alias("entry_b"), pick("t_split", "e_split", "split_a"), pick("e_split", "t_split", "split_b"),
        pick("t_source", "e_source", "data_source_a"), pick("e_source", "t_source", "data_source_b"),
    )


def overlap_report(entries: DataFrame, train: str = "train") -> DataFrame:
    """Per evaluation split and source: pairs, and evaluation rows with at least one pair; from class counts, no pair of rows is built."""
    rows = cut(prepare(entries))
    learns = F.col("side") == train
    linked = class_links(rows, train)
    taught = rows.where(learns).groupBy(F.col("cls").alias("cls_a")).agg(F.count("*").alias("partners"))
    partners = linked.join(taught, "cls_a").groupBy(F.col("cls_b").alias("cls")).agg(F.sum("partners").alias("partners"))
    asked_rows = rows.where(~learns).groupBy("cls", F.col("side").alias("split"), "data_source").agg(F.count("*").alias("n"))
    return asked_rows.join(partners, "cls").groupBy("split", "data_source").agg(F.sum(F.col("n") * F.col("partners")).alias("pairs"), F.sum("n").alias("rows"))
