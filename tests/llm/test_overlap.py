from framewise.llm import overlap

SCHEMA = "entry_id long, data_source string, video_id string, question string, options string, split string, cls string"
Q = "Who hands the lantern to the dripping juggler inside the campsite at minute 9?"
O = "A. Stacking the lantern\nB. Kicking the barrel\nC. It was hid 3 times"


def test_same_records_across_splits(spark):
    rows = [
        (1, "a", "v000000001", Q, O, "train", ""), (2, "b", "1", "Well, who hands the lantren to the dripping juggler inside the campsite at minute nine?", '["Kicking the barrrel", "It was hid three times", "Stacking the lantern"]', "test", ""),
        (3, "a", "v000000001", Q.replace("9", "8"), O, "test", ""), (4, "a", "v000000002", Q, O, "test", ""), (5, "a", "v000000001", Q, O.replace("3 times", "4 times"), "test", ""),
        (6, "a", "v000000001", Q, O, "train", ""), (7, "a", "v000000001", Q, O, "validation", ""), (8, "a", "v000000001", None, O, "test", ""), (9, "a", "v000000001", Q, None, "test", ""), (10, "a", None, Q, O, "test", ""), (11, "a", "v000000001", Q, O, None, ""), (12, "a", "v000000001", "", "", "test", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.entry_a, r.entry_b) for r in overlap.overlaps(df).collect()}
    assert got == {(1, 2), (2, 6), (1, 7), (6, 7)}
    report = {(r.split, r.data_source): (r.pairs, r.rows) for r in overlap.overlap_report(df).collect()}
    assert report == {("test", "b"): (2, 1), ("validation", "a"): (2, 1)}


def test_short_records_with_several_slips_are_found(spark):
    import itertools

    words, slips = ["juggler", "lantern", "campsite", "barrel"], ["jugglre", "lnatern", "campsiet", "barrle"]
    change = lambda on: " ".join(s if k in on else w for k, (w, s) in enumerate(zip(words, slips)))
    rows, want = [], set()
    for k, on in enumerate(itertools.chain.from_iterable(itertools.combinations(range(4), n) for n in range(1, 5))):
        video = str(k + 1)
        rows += [(2 * k, "a", video, change(()), '["whistle", "trumpet"]', "train", ""), (2 * k + 1, "a", video, change(on), '["trumpte", "whislte"]', "test", "")]
        want.add((2 * k, 2 * k + 1))
    assert {(r.entry_a, r.entry_b) for r in overlap.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_empty(spark):
    assert overlap.overlaps(spark.createDataFrame([], SCHEMA)).collect() == []


def test_codes_within_seven_bits_share_a_segment_and_slips_move_few_bits():
    import random

    import numpy as np

    rng, coder = random.Random(4), overlap.Codes()
    texts = [["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(45)] for _ in range(200)]
    slipped = [[w if k != 7 else w[:-1] + "x" for k, w in enumerate(t)] for t in texts]
    (codes, segments), (others, other_segments) = coder.of(texts), coder.of(slipped)
    apart = np.bitwise_count((codes ^ others).view(np.uint64)).sum(axis=1)
    assert apart.mean() < 12 and codes.shape == (200, 2) and segments.shape == (200, 16)
    assert (segments == other_segments).any(axis=1).mean() > 0.95
    assert (segments[apart <= 7] == other_segments[apart <= 7]).any(axis=1).all()
    assert all((coder.of([t])[0] == c).all() for t, c in zip(texts[:5], codes))


def test_a_crowded_place_gives_few_candidates(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(5000):
        q, o = rng.sample(words, 14), [" ".join(rng.sample(words, 6)) for _ in range(4)]
        rows += [(2 * k, "a", "7", " ".join(q), " | ".join(o), "train", ""), (2 * k + 1, "a", "7", " ".join(w if len(w) < 7 or k % 3 else w[:-1] + "q" for w in q), " | ".join(o[::-1]), "test", "")]
    prepared = overlap.prepare(spark.createDataFrame(rows, SCHEMA)).cache()
    classes = prepared.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("place", "c1", "c2", "segments", "frame")], F.max(F.col("side") == "train").alias("learns"), F.max(F.col("side") != "train").alias("tests"))
    assert classes.select("place").distinct().count() == 1
    near, framed = overlap.candidates(classes)
    assert near.distinct().count() < 20_000 and framed.count() < 20_000
    got = {(r.entry_a, r.entry_b) for r in overlap.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(5000)}
    prepared.unpersist()


def test_report_equals_counted_pairs(spark):
    rows = [(k, f"s{k % 3}", "v000000001", Q if k % 2 else Q.replace("lantern", "lantren"), O, ("train", "test", "validation")[k % 3 if k < 40 else 0], "") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in overlap.overlaps(df).collect():
        late = r.split_a == "train"
        key = (r.split_b, r.data_source_b) if late else (r.split_a, r.data_source_a)
        want.setdefault(key, []).append(r.entry_b if late else r.entry_a)
    assert {(r.split, r.data_source): (r.pairs, r.rows) for r in overlap.overlap_report(df).collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}
