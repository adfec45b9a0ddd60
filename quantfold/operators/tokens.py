"""Token budgets by a pluggable tokenizer.

A tokenizer maps a list of texts to the character offsets at which each text's tokens end, so a text is cut at the n-th
token's end and never put together again from tokens.  It is loaded once per Python worker and called on pieces of Arrow
batches of bounded text, each of which leaves the worker before the next one is cut.  The regex form (:func:`quantfold.functions.text.truncate_tokens`) stays in the JVM.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .prompts import MAX_SEQ_LENGTH, build_prompt, target_text

#: Bytes of text that are handed to a tokenizer at once (a longer text is handed over alone).
PIECE = 1 << 18


class Tokenizer(Protocol):
    """Small and picklable: it travels to tasks and loads its model there."""

    def ends(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the ascending offsets, in characters, at which its tokens end."""


_LOADED: dict[str, object] = {}


@dataclass(frozen=True)
class TokenizerFile:
    """A file of the ``tokenizers`` library, which all executors can read at ``path``; no special tokens are added."""

    path: str

    def _model(self):
        if self.path not in _LOADED:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism: no threads with memory of their own
            from tokenizers import Tokenizer as Model

            _LOADED[self.path] = Model.from_file(self.path)
            _give_back()
        return _LOADED[self.path]

    def ends(self, texts: list[str]) -> list[np.ndarray]:
        model = self._model()
        return [np.array([e for _, e in model.encode(t, add_special_tokens=False).offsets], np.int64) for t in texts]


@dataclass(frozen=True)
class RegexTokens:
    """Matches of a pattern."""

    pattern: str = r"\S+\s*"

    def ends(self, texts: list[str]) -> list[np.ndarray]:
        import re

        found = re.compile(self.pattern)
        return [np.array([m.end() for m in found.finditer(t)], np.int64) for t in texts]


def _give_back() -> None:
    """Hand memory that the allocators keep back to the machine: workers live on."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose text is at most ``PIECE`` bytes (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def _with_columns(df: DataFrame, column: str, tokenizer: Tokenizer, limit: int | None) -> DataFrame:
    added = [T.StructField("n_tokens", T.LongType())] + ([T.StructField("truncated", T.StringType())] if limit is not None else [])
    if clash := {f.name for f in added} & set(df.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")

    def piece(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(column).to_pylist()]
        counts, cuts = [], []
        for text, ends in zip(texts, tokenizer.ends(texts)):
            counts.append(len(ends))
            if limit is not None:
                cuts.append(text if len(ends) <= limit else text[: int(ends[limit - 1])] if limit > 0 else "")
        null = pc.is_null(b.column(column))
        new = [pc.if_else(null, pa.scalar(0, pa.int64()), pa.array(counts, pa.int64()))]
        if limit is not None:
            new.append(pc.if_else(null, pa.scalar(None, pa.string()), pa.array(cuts, pa.string())))
        return pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *[f.name for f in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                yield from map(piece, _pieces(b, column))
        finally:
            _give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def counted(df: DataFrame, column: str, tokenizer: Tokenizer) -> DataFrame:
    """Add ``n_tokens`` of a text column (0 for NULL)."""
    return _with_columns(df, column, tokenizer, None)


def truncated(df: DataFrame, column: str, n: int, tokenizer: Tokenizer) -> DataFrame:
    """Add ``n_tokens`` and ``truncated``: the text up to the end of its n-th token (unchanged if it has fewer; NULL stays NULL)."""
    return _with_columns(df, column, tokenizer, n)


def overheads(df: DataFrame, currencies: str, tokenizer: Tokenizer, budget: int = MAX_SEQ_LENGTH, with_target: bool = True) -> DataFrame:
    """Replace the list of codes by ``n_currencies``, ``overhead_tokens`` of the prompt (and answer) around an empty article and
    ``remaining_tokens`` of the budget.

    A prompt depends on its codes alone, so each distinct list is tokenized once and joined back."""
    prompt = build_prompt(F.lit(""), F.lit(""), currencies)
    if with_target:
        prompt = F.concat(prompt, target_text(currencies, F.create_map().cast("map<string,string>")))
    lists = df.select(F.col(currencies)).distinct().select(F.col(currencies).alias("_codes"), F.coalesce(prompt, F.lit("")).alias("_prompt"))
    known = materialize(counted(lists, "_prompt", tokenizer).select("_codes", "n_tokens"))
    rest = [c for c in df.columns if c != currencies]
    out = df.join(known, F.col(currencies).eqNullSafe(F.col("_codes")))
    return out.select(*rest, F.coalesce(F.size(currencies), F.lit(0)).cast("bigint").alias("n_currencies"), F.col("n_tokens").alias("overhead_tokens"), (F.lit(budget) - F.col("n_tokens")).cast("bigint").alias("remaining_tokens"))
