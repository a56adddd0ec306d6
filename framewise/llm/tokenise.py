"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Each partition opens DuckDB, loads the tokenizer's merge table, and encodes the words it has not met yet with a
recursive query: token-position rows join the merge table, and every step contracts each word's minimum-rank pair
(leftmost first, all its places that do not overlap) until no pair of the word is in the table.  Contracting all places of one rank at once gives
what contracting them one by one gives, because a pair made by a merge has a later rank than that merge.  Words are
cached per worker, so a word is merged once however often the corpus repeats it.  Texts are encoded whole.

Empty and null texts give an empty list.  The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framewise.llm.common import spread

#: Folder of the public tokenizer files; a parameter of every operator here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Words the worker keeps; beyond that it starts afresh.  Only speed depends on it.
KEPT_WORDS = 400_000
#: Fixed value: the pre-tokenizer pattern of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MERGE_SQL = """
WITH RECURSIVE step(word, pos, tok, it) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN made ELSE tok END, it + 1
  FROM (
    SELECT *, lag(hit, 1, false) OVER w AS gone
    FROM (
      SELECT *, best AND (row_number() OVER (PARTITION BY word, island ORDER BY pos)) % 2 = 1 AS hit
      FROM (
        SELECT *, sum(CASE WHEN best THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) * 2 + CASE WHEN best THEN 1 ELSE 0 END AS island
        FROM (
          SELECT p.word, p.pos, p.tok, p.it, m.made, m.rank IS NOT NULL AND m.rank = min(m.rank) OVER (PARTITION BY p.word) AS best, min(m.rank) OVER (PARTITION BY p.word) AS least
          FROM (SELECT word, pos, tok, it, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step) p
          LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r
        )
        WHERE least IS NOT NULL AND it < {steps}
      )
    )
    WINDOW w AS (PARTITION BY word ORDER BY pos)
  )
  WHERE NOT gone
)
SELECT word, list(tok ORDER BY pos) AS ids, max(last) = {steps} AS open
FROM (SELECT *, max(it) OVER (PARTITION BY word) AS last FROM step)
WHERE it = last
GROUP BY word
"""
#: Contractions of one query; a word that needs more goes into another, so no query holds more states of a word.
STEPS = 48

DECODE_SQL = """
SELECT d.row, string_agg(v.hex, '' ORDER BY d.pos) AS hex
FROM given d JOIN vocab v ON d.tok = v.tok
GROUP BY d.row
"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeEncoder:
    """Byte-level BPE over DuckDB; one per worker process."""

    _open: dict[str, BpeEncoder] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        self.byte_ids = {b: vocab[c] for c, b in letters.items()}
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.register("loaded", pa.table({"l": [vocab[a] for a, _ in pairs], "r": [vocab[b] for _, b in pairs], "rank": list(range(len(pairs))), "made": [vocab[a + b] for a, b in pairs]}))
        self.db.execute("CREATE TABLE merges AS SELECT l::INT AS l, r::INT AS r, rank::INT AS rank, made::INT AS made FROM loaded")
        self.db.unregister("loaded")
        spelled = [(i, bytes(letters[c] for c in t).hex()) for t, i in vocab.items() if all(c in letters for c in t)]
        self.db.register("loaded", pa.table({"tok": [i for i, _ in spelled], "hex": [h for _, h in spelled]}))
        self.db.execute("CREATE TABLE vocab AS SELECT tok::INT AS tok, hex FROM loaded")
        self.db.unregister("loaded")
        # Bytes that stand side by side in no token are never merged; words fall apart there.
        self.joined = {pair for _, h in spelled for b in [bytes.fromhex(h)] for pair in zip(b, b[1:])}

    @classmethod
    def at(cls, path: str) -> BpeEncoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def pieces(self, word: str) -> list[bytes]:
        """Bytes of a word, cut where no token of the vocabulary reaches across."""
        raw = word.encode("utf-8", "surrogatepass")
        cuts = [0, *[k for k in range(1, len(raw)) if (raw[k - 1], raw[k]) not in self.joined], len(raw)]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(self, words: list[str], rows_at_once: int = 100_000) -> None:
        """Encode words by the recursive query and remember them."""
        parts = {w: self.pieces(w) for w in words}
        fresh = sorted({p for ps in parts.values() for p in ps})
        done: dict[bytes, list[int]] = {}
        begin = 0
        while begin < len(fresh):
            end, size = begin, 0
            while end < len(fresh) and (end == begin or size + len(fresh[end]) <= rows_at_once):
                size += len(fresh[end])
                end += 1
            state = {k: [self.byte_ids[b] for b in fresh[k]] for k in range(begin, end)}
            while state:
                self.db.register("start", pa.table({"word": pa.array([k for k, t in state.items() for _ in t], pa.int32()), "pos": pa.array([i for t in state.values() for i in range(len(t))], pa.int32()), "tok": pa.array([x for t in state.values() for x in t], pa.int32())}))
                got = self.db.execute(MERGE_SQL.format(steps=STEPS)).fetchall()
                self.db.unregister("start")
                state = {k: ids for k, ids, unfinished in got if unfinished}
                done |= {fresh[k]: ids for k, ids, unfinished in got if not unfinished}
            begin = end
        for w, ps in parts.items():
            self.known[w] = done[ps[0]] if len(ps) == 1 else [i for p in ps for i in done[p]]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        fresh = {w for ws in split for w in ws}.difference(self.known)
        if fresh:
            self.learn(sorted(fresh))
        known, out = self.known, []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            out.append(ids)
        return out

    def decode(self, lists: list[list[int] | None]) -> list[str]:
        """Texts of id lists by an ordered aggregation; null and empty lists give an empty text."""
        row = [k for k, ids in enumerate(lists) for _ in ids or []]
        self.db.register("given", pa.table({"row": pa.array(row, pa.int32()), "pos": pa.array([p for ids in lists for p in range(len(ids or []))], pa.int32()), "tok": pa.array([i for ids in lists for i in ids or []], pa.int32())}))
        got = dict(self.db.execute(DECODE_SQL).fetchall())
        self.db.unregister("given")
        return [bytes.fromhex(got.get(k, "")).decode("utf-8", "replace") for k in range(len(lists))]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds a bounded amount of text (or one text)."""
    for batch in batches:
        begin, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for k, n in enumerate(lengths):
            if held and held + n > most_chars:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def encode_column(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k.json", folder: str | None = None, sizes_only: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` (or ``n_tokens`` with ``sizes_only``) of every row's text."""
    path = os.path.join(folder or TOKENIZERS, tokenizer)
    out = T.StructField("n_tokens", T.IntegerType()) if sizes_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([df.schema[c] for c in keep] + [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BpeEncoder.at(path)
        for batch in slices(batches, text):
            lists = coder.encode(batch.column(text).to_pylist())
            last = pa.array([len(x) for x in lists], pa.int32()) if sizes_only else pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], last], names=[*keep, out.name])

    return spread(df.select(*keep, *([] if text in keep else [text]))).mapInArrow(run, schema)


def decode_column(df: DataFrame, keep: list[str], ids: str = "ids", tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """``keep`` columns and the text of every id list; the inverse of :func:`encode_column`."""
    path = os.path.join(folder or TOKENIZERS, tokenizer)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BpeEncoder.at(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(coder.decode(batch.column(ids).to_pylist()), pa.string())], names=[*keep, "text"])

    return df.select(*keep, *([] if ids in keep else [ids])).mapInArrow(run, schema)
