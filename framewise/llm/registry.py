"""The pN_ queries over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import components, neighbours, overlap, packing, runs, sentences, tokenise, topn
from framewise.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of videos that must share a split."""
    return components.tied_pairs(table(spark, sf_dir, "data_input"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row."""
    return components.grouped_splits(table(spark, sf_dir, "data_input"), table(spark, sf_dir, "split_plan"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best windows of every video for every probe."""
    best = topn.best_windows(table(spark, sf_dir, "window_embeddings"), table(spark, sf_dir, "probes"), 4)
    return best.select("probe_id", "video_id", "vec_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every run of one subtitle line."""
    return p3_runs(spark, sf_dir).select("seq", "video_id", "first_idx", "first_pos", "last_idx", "last_pos")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as one line with count and duration."""
    return runs.subtitle_runs(table(spark, sf_dir, "frame_subtitles"), table(spark, sf_dir, "window_subtitles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embeddings of which one is among the other's 5 most similar."""
    both = [table(spark, sf_dir, t).select("vec_id", "embedding") for t in ("window_embeddings", "subtitle_embeddings")]
    return neighbours.similar_pairs(both[0].unionByName(both[1])).select("vec_a", "vec_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training row and an evaluation row that are the same record."""
    return overlap.overlaps(table(spark, sf_dir, "data_input")).select("entry_a", "entry_b")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    return overlap.overlap_report(table(spark, sf_dir, "data_input"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document under byte_bpe_50k."""
    return tokenise.encode_column(table(spark, sf_dir, "documents"), ["doc_id"])


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_column(table(spark, sf_dir, "documents"), ["doc_id"], sizes_only=True)


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (or piece) for every capacity."""
    return packing.packing(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_plan"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and space filled per capacity."""
    return packing.packing_report(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_plan"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every sentence of every document."""
    return sentences.document_sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_splits, p2_found, p3_found, p3_runs, p4_found, p5_found, p5_report, p6_ids, p7_packing, p7_report, p8_found)
}

SQL: dict[str, str] = {
    "p2_found": """
SELECT probe_id, video_id, vec_id FROM (
  SELECT p.probe_id, w.video_id, w.vec_id,
         row_number() OVER (PARTITION BY p.probe_id, w.video_id
                            ORDER BY list_dot_product(w.embedding::DOUBLE[], p.embedding::DOUBLE[]) DESC, w.vec_id) AS place
  FROM window_embeddings w CROSS JOIN probes p
  WHERE w.video_id IS NOT NULL AND len(w.embedding) = 64
    AND len(list_filter(w.embedding, lambda x: x IS NULL OR isnan(x))) = 0)
WHERE place <= 4
""",
}
