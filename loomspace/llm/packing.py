"""Filling containers of fixed capacity with items, by bounded-space online best fit.

Each input partition is packed as it streams by. A fixed number of bins is open at a time, filed by free space, and a
bitset marks the free spaces for which there is an open bin: the best fit for a size is the lowest marked bit at or above
it. If no open bin has room and all places are taken, the fullest bin closes and a new one opens. An item above the capacity
is the only one that is split: it fills bins of its own, and its remainder is packed like any item.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.plans.runtime import ship


class BestFit:
    """Open bins keyed by free space. ``put`` returns the bin's number and where the item starts in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.at: dict[int, list[int]] = {}
        self.open = 0
        self.next = 0

    def put(self, size: int) -> tuple[int, int]:
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, number = self.capacity, self.next
            self.next += 1
            self.open += 1
        left = free - size
        if left:
            self.at.setdefault(left, []).append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.at[free]
        number = own.pop()
        if not own:
            del self.at[free]
            self.bits &= ~(1 << free)
        return number


def vocabulary_folder() -> str:
    """Where the public tokenizer files lie; a parameter of everything that reads them."""
    return os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")


def byte_tokens(text: Column) -> Column:
    """Size under a byte-level tokenizer: one token for each UTF-8 byte and one end token; NULL for NULL."""
    return F.octet_length(text) + 1


def vocabulary_tokens(path: str) -> Callable[[Column], Column]:
    """Size under a public tokenizer file (``tokenizers`` JSON, ``tiktoken`` ranks or a SentencePiece model), plus one end token."""

    @F.pandas_udf(T.IntegerType())
    def count(text: pd.Series) -> pd.Series:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(path).encode
            length = lambda t: len(encode(t, add_special_tokens=False).ids)
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            length = lambda t: len(model.encode(t))
        else:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            coder = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
            length = lambda t: len(coder.encode_ordinary(t))
        return pd.Series([None if t is None else length(t) + 1 for t in text], dtype="Int32")

    return lambda text: count(text)


def pack(df: DataFrame, item: str, size: Column, capacity: int, open_bins: int = 64) -> DataFrame:
    """Assign every item to containers: ``item, piece, pieces, container, start, tokens``.

    ``pieces`` is 1 for an item that fits; a larger one is cut into full containers and a remainder. ``container`` is unique over
    all partitions, ``start`` the offset within it. A NULL item or size is no item; a size of 0 or less takes no space and gets no
    row; an empty input gives no rows; repeated ids are separate items; other columns are ignored. The result depends only on the
    order of rows within the input partitions, so a task that is run again gives the same containers.
    """
    ship(df.sparkSession)
    items = df.select(F.col(item), size.cast("long").alias("__size")).filter(F.col(item).isNotNull() & (F.col("__size") > 0))
    items = items.withColumn("__p", F.spark_partition_id())
    names = ["piece", "pieces", "container", "start", "tokens"]
    schema = T.StructType([items.schema[item], *(T.StructField(n, T.LongType()) for n in names)])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(capacity, open_bins)
        for b in batches:
            base = np.int64(b["__p"].iat[0]) << np.int64(33) if len(b) else np.int64(0)
            out: list[tuple[int, int, int, int, int, int]] = []
            for i, n in enumerate(b["__size"].tolist()):
                if n <= capacity:
                    out.append((i, 0, 1, *bins.put(n), n))
                    continue
                pieces = -(-n // capacity)
                for j in range(pieces):
                    take = min(capacity, n - j * capacity)
                    if take == capacity:
                        out.append((i, j, pieces, bins.next, 0, take))
                        bins.next += 1
                    else:
                        out.append((i, j, pieces, *bins.put(take), take))
            cols = np.array(out, np.int64).reshape(-1, 6)
            made = pd.DataFrame(cols[:, 1:], columns=names)
            made["container"] += base
            made.insert(0, item, b[item].to_numpy()[cols[:, 0]])
            yield made

    return items.mapInPandas(fill, schema)
