"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled with its documents.

The tokenizer never joins a word with the blank after it, so a text's count is the sum over its pre-tokens (blanks and the
word that follows). Tier 1 is a compact table of the frequent pre-tokens' counts, found over all documents (each task
sends its `per_task` heaviest, the sums' `table_size` heaviest are kept: a fixed bound) and broadcast. Tier 2 encodes
what the table misses and keeps it in a bounded cache of the Python worker. The table only saves time: counts are exact.

Edge cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; strings that look like
special tokens are ordinary text, as in the library; repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import most_frequent, text_of

LIMIT = 4096
TABLE_SIZE, PER_TASK, LONGEST, CACHE = 65_536, 4_000, 32, 300_000
_BLANKS = re.compile(" +[^ ]*")
_MODELS: dict = {}


def _library(model: str):
    if model not in _MODELS:
        import public_tokenizers
        import sentencepiece

        _MODELS[model] = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    return _MODELS[model]


class Lengths(dict):
    """Words (without their first blank) to numbers of tokens; a miss is encoded and kept."""

    def __init__(self, model: str, table: dict[str, int]):
        super().__init__(table)
        self.library, self.table = _library(model), table

    def __missing__(self, word: str) -> int:
        n = len(self.library.encode(word))
        if len(word) <= LONGEST:
            if len(self) >= len(self.table) + CACHE:
                self.clear()
                self.update(self.table)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace("▁", " ")  # the library's own mark of a blank
        words = text.split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total = 0
        for part in _BLANKS.findall(" " + text):
            if part.strip(" "):
                total += self[part[1:]]
            else:  # blanks at the end
                total += len(self.library.encode("a" + part)) - len(self.library.encode("a"))
        return total


def frequent_words(df: DataFrame, model: str, table_size: int = TABLE_SIZE, per_task: int = PER_TASK) -> dict[str, int]:
    """The most frequent words of df._text with their numbers of tokens."""

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.replace("▁", " ").split(" "))
            if len(seen) > 40 * per_task:
                seen = Counter(dict(seen.most_common(20 * per_task)))
        top = [(w, n) for w, n in seen.most_common(per_task) if 0 < len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    sums = df.select("_text").mapInArrow(heaviest, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = sorted(x["w"] for x in most_frequent(sums, "n", table_size)[0].select("w").collect())
    return dict(zip(top, map(len, _library(model).encode(top, num_threads=1)), strict=True)) if top else {}


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT, table_size: int = TABLE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit."""
    df = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(df, model, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _worker_lengths(model, table)
        for batch in batches:
            texts = batch.column("_text")
            n = [lengths.count(t) for t in texts.to_pylist()]
            sizes = pc.binary_length(texts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), sizes.cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


_WORKER: dict = {}


def _worker_lengths(model: str, table) -> Lengths:
    """The worker's cache outlives its tasks; a new table starts a new one."""
    words = table.value
    if _WORKER.get("model") != model or _WORKER["lengths"].table is not words:
        _WORKER.update(model=model, lengths=Lengths(model, words))
    return _WORKER["lengths"]
