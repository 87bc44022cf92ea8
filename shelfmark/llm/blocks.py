"""Documents as blocks of word numbers, so that a word crosses the network once per block and not once per place.

A block holds some whole documents: their words are numbered by a dictionary of
the block, most frequent first.  What an operator has to know about a word is
looked up by the distinct words of each block, dealt into hash buckets; the
answers go back to the block by word number.  A word in every document is one row
per block at most, so frequent words are no hot keys.

Words are what lies between ASCII white space.  Byte strings are kept: no text is
cut, and a single document larger than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.llm.rows import whole_text

#: Bytes of text in a block; sets the memory of a task.
BLOCK_BYTES = 20_000_000
#: Distinct words (of all blocks) that meet in one bucket.
BUCKET_ITEMS = 500_000
#: Of compression, for what crosses the network.
LEVEL = 9

BLOCK_SCHEMA = "block bigint, doc_ids array<bigint>, lengths array<int>, n_words bigint, codes binary, words binary"


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Compressed array of numbers from 0 to 2**31: lowest bytes lie together by the bytes above them, which they depend on."""
    high = numbers.astype(np.int32) >> 8
    order = np.argsort(high.astype(np.uint16) if not len(high) or high.max() < 1 << 16 else high, kind="stable")
    planes = np.ascontiguousarray(high.view(np.uint8).reshape(-1, 4)[:, :3].T)
    return zstandard.ZstdCompressor(LEVEL).compress(planes.tobytes() + (numbers & 255).astype(np.uint8)[order].tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 4
    high = np.zeros((n, 4), np.uint8)
    high[:, :3] = raw[:3 * n].reshape(3, n).T
    high = high.view(np.int32).ravel()
    order = np.argsort(high.astype(np.uint16) if not n or high.max() < 1 << 16 else high, kind="stable")
    out = high << 8
    out[order] |= raw[3 * n:]
    return out


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(LEVEL).compress(b"\n".join(words))


def unpack_words(data: bytes, n: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n") if n else []


class _Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_blocks(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lower: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A stored table of blocks; ``lower`` folds A-Z."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        numbers, codes, ids, lengths, size = _Numbers(), [], [], [], 0

        def block() -> pd.DataFrame:
            raw = np.array(codes, np.int32)
            order = np.argsort(-np.bincount(raw, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(numbers), np.int32)
            rank[order] = np.arange(len(numbers), dtype=np.int32)
            words = list(numbers)
            return pd.DataFrame({
                "block": [first], "doc_ids": [ids], "lengths": [lengths], "n_words": [len(words)],
                "codes": [pack_numbers(rank[raw])], "words": [pack_words([words[i] for i in order])],
            })

        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["text"]):
                data = content.encode("utf-8", "surrogatepass")
                pieces = (data.lower() if lower else data).split()
                codes.extend(map(numbers.__getitem__, pieces))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(pieces))
                size += len(data) + 1
                if size >= block_bytes:
                    yield block()
                    first += 1
                    numbers, codes, ids, lengths, size = _Numbers(), [], [], [], 0
        if ids:
            yield block()

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return cut(chosen.mapInPandas(run, BLOCK_SCHEMA))


def bucket_count(items: int) -> int:
    """Buckets for this many items: their number grows with the input, their size does not."""
    return max(1, -(-items // BUCKET_ITEMS))


def spans(lengths) -> Iterator[tuple[int, int]]:
    """Start and end of each document in the words of its block."""
    ends = list(accumulate(lengths))
    return zip([0, *ends[:-1]], ends)
