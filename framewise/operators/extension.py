"""Where models and users plug in: embedders, model calls, reward and parser registries, rows of other tools."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions import scoring, text
from framewise.operators.dataset import members


class DatasetManager(Protocol):
    """A dataset: entries as a DataFrame and where its index goes."""

    def load(self) -> DataFrame: ...

    def save_index(self, root: str) -> None: ...


class Embedder(Protocol):
    """A model that turns a batch of texts or encoded frames into vectors; made once per worker."""

    def __call__(self, batch: list) -> np.ndarray: ...


def hashed_embedder(dim: int = 64) -> Callable[[], Embedder]:
    """A deterministic stand-in for a model: equal inputs give equal unit vectors."""

    def make() -> Embedder:
        def embed(batch: list) -> np.ndarray:
            out = np.empty((len(batch), dim), dtype=np.float32)
            for k, x in enumerate(batch):
                raw = x if isinstance(x, bytes) else str(x).encode()
                seed = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
                v = np.random.default_rng(seed).normal(size=dim)
                out[k] = v / np.linalg.norm(v)
            return out

        return embed

    return make


def embedded(df: DataFrame, column: str, make: Callable[[], Embedder], name: str = "embedding", batch_size: int = 32) -> DataFrame:
    """``df`` with the embedding of a column; null inputs give null.  The model is made once a task and sees whole batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            values = batch.column(column).to_pylist()
            known = [k for k, v in enumerate(values) if v is not None]
            out: list = [None] * len(values)
            for k in range(0, len(known), batch_size):
                part = known[k : k + batch_size]
                for place, vec in zip(part, model([values[i] for i in part])):
                    out[place] = vec.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def embedded_once(df: DataFrame, column: str, make: Callable[[], Embedder], name: str = "embedding") -> DataFrame:
    """As :func:`embedded`, but every distinct value is embedded once and joined back."""
    return df.join(embedded(df.select(column).where(F.col(column).isNotNull()).distinct(), column, make, name), column, "left")


class NoRetry(Exception):
    """An error of a model call that repeating cannot mend."""


def model_calls(df: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], tries: int = 3, wait: float = 5.0) -> DataFrame:
    """``df`` with ``response`` and ``error`` of an injected client; waits grow with each try, :class:`NoRetry` ends at once.

    Failed rows stay, with the error as data.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            answers, errors = [], []
            for p in frame[prompt]:
                answer = error = None
                for k in range(tries):
                    try:
                        answer, error = client(p), None
                        break
                    except NoRetry as e:
                        error = str(e)
                        break
                    except Exception as e:  # noqa: BLE001 any other failure is repeated
                        error = str(e)
                        if k + 1 < tries:
                            time.sleep(wait * (k + 1))
                answers.append(answer)
                errors.append(error)
            yield frame.assign(response=answers, error=errors)

    return df.mapInPandas(run, schema)


REWARDS: dict[str, Callable[..., Column]] = {"em": scoring.compute_score, "sub_em": scoring.compute_score_subem}
TOOL_PARSERS: dict[str, Callable[[Column], Column]] = {
    "tag": lambda c: text.tag_tool_calls(c, ("search", "search_subtitle")), "summary": text.tag_tool_calls, "fanout": text.tag_tool_calls, "json": text.json_tool_calls, "function": text.function_calls,
}


def registered(kind: dict, name: str) -> Callable[..., Column]:
    if name not in kind:
        raise KeyError(f"{name} is none of {sorted(kind)}")
    return kind[name]


def post_processed(df: DataFrame, column: str, step: Callable[[Column], Column] | None) -> DataFrame:
    """A column after an injected step; none leaves it as it is."""
    return df.withColumn(column, step(F.col(column))) if step else df


def search_errors(query: Column, mode: Column) -> Column:
    """What is wrong with a search request, as data; null if nothing is."""
    return F.when(F.coalesce(query, F.lit("")) == "", "'query' must be a non-empty string").when(~F.coalesce(mode, F.lit("")).isin("base", "subtitle", "summary"), "'mode' must be 'base', 'subtitle' or 'summary'")


def one_action(answer: Column, search: Column, subtitle: Column) -> Column:
    """Whether exactly one of the three is given."""
    return answer.isNotNull().cast("int") + search.isNotNull().cast("int") + subtitle.isNotNull().cast("int") == 1


def find_column(df: DataFrame, names: list[str]) -> str | None:
    """First of ``names`` the table has, in any case, as the table writes it."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def right_answer(pred: Column, gt: Column) -> Column:
    """Equal, with a truth that is not empty."""
    return F.coalesce((gt != "") & (pred == gt), F.lit(False))


def reward_rows(df: DataFrame, score: Column, tokens: str = "valid_tokens") -> DataFrame:
    """Scores placed at the last valid token, with what they were made of."""
    return df.select("*", F.struct(score.alias("score"), (F.col(tokens) - 1).alias("position")).alias("reward"))


def selected_payload(rows: DataFrame, mined: DataFrame) -> DataFrame:
    """Entries of mined videos (and of the asked questions, where a video has some) with ``selection_meta``."""
    wanted = mined.select("data_source", "video_id", F.explode_outer("questions").alias("_q")).withColumn("_q", text.question_key(F.col("_q")))
    kept = members(rows.withColumn("_q", text.question_key(F.col("question"))), wanted, ["data_source", "video_id"], "_q").drop("_q")
    meta = mined.select("data_source", "video_id", F.struct("max_turn", "correct_count").alias("selection_meta"))
    return kept.join(meta, ["data_source", "video_id"])


def soft_minimum(a: float, b: float, c: float, gamma: float) -> float:
    low = min(a, b, c)
    return low - gamma * np.log(sum(np.exp(-(x - low) / gamma) for x in (a, b, c)))


def soft_dtw(x: np.ndarray, y: np.ndarray, gamma: float = 1.0) -> float:
    """Soft dynamic time warping of two sequences of numbers with squared differences."""
    cost = (x[:, None] - y[None]) ** 2
    best = np.full((len(x) + 1, len(y) + 1), np.inf)
    best[0, 0] = 0.0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i, j] = cost[i - 1, j - 1] + soft_minimum(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1], gamma)
    return float(best[-1, -1])


def soft_dtw_column(a: str, b: str, gamma: float = 1.0) -> Column:
    """Soft dynamic time warping of two array columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else soft_dtw(np.asarray(p, float), np.asarray(q, float), gamma) for p, q in zip(x, y)])

    return run(F.col(a), F.col(b))


def word_tokens(df: DataFrame, column: str, path: str, name: str = "ids") -> DataFrame:
    """``df`` with ids of a lower-case word tokenizer file; entities and white space are cleaned first, null gives an empty list."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import html

        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        tool.encode_special_tokens = True
        for batch in batches:
            clean = [" ".join(html.unescape(html.unescape(t or "")).split()) for t in batch.column(column).to_pylist()]
            ids = [e.ids for e in tool.encode_batch(clean, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def single_line(c: Column) -> Column:
    return text.strip(F.regexp_replace(c, r"\s+", " "))


def stamped(path: Column, at: Column) -> Column:
    """File name with a time before its ending, or folder name with it after."""
    mark = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    ending = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_"), mark, ending)


def text_keys(m: Column) -> Column:
    """A map with keys as text, as JSON has them."""
    return F.transform_keys(m, lambda k, _: k.cast("string"))


def number_keys(m: Column) -> Column:
    """The inverse: text keys back to numbers."""
    return F.transform_keys(m, lambda k, _: k.cast("int"))
