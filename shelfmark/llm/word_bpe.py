"""BPE encoding and decoding through a table of distinct words.

Spark splits the documents into words (``blocks``), brings the distinct words of
all blocks together by hash and encodes each of them once with the tokenizer's
own library; the ids go back to every place where the word stands, and an
id-to-piece join decodes them.  The split is safe because this kind of tokenizer
drops white space before it looks for pieces, so no piece spans two words.

The tokenizer has to drop white space and have no decoder and no normaliser that
looks beyond a word (``word_bpe_49k.json`` is such a file).  Decoding joins pieces
by one blank, as the library does without a decoder.

Defined results: a null text counts as empty and gives no ids; repeated rows give
repeated results; null ids are kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.blocks import (
    BLOCK_BYTES, bucket_count, pack_numbers, pack_words, spans, unpack_numbers, unpack_words, word_blocks,
)

#: Words handed to the library at once.
_AT_ONCE = 20_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str | None]:
    tokenizer = _tokenizer(path)
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def _by_bucket(blocks: DataFrame, buckets: int) -> DataFrame:
    """The distinct words of every block, dealt by the hash of the word: one row per block and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, n, packed in zip(batch["block"], batch["n_words"], batch["words"]):
                words = unpack_words(packed, n)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, n) % buckets
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, order[x:z]) for b, x, z in zip(range(buckets), edges, edges[1:]) if z > x]
                yield pd.DataFrame({
                    "bucket": [b for b, _ in rows], "block": block, "n": [len(o) for _, o in rows],
                    "numbers": [pack_numbers(np.diff(o, prepend=0).astype(np.int32)) for _, o in rows],
                    "words": [pack_words([words[i] for i in o]) for _, o in rows],
                })

    return blocks.select("block", "n_words", "words").mapInPandas(
        run, "bucket int, block bigint, n int, numbers binary, words binary")


def encoded_words(blocks: DataFrame, buckets: int, path: str) -> DataFrame:
    """The distinct-word table: every word is encoded once in its bucket; one row per block and bucket has its ids."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        uses = []
        for n, packed in zip(group["n"], group["words"]):
            uses.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in unpack_words(packed, n)), np.int64, n))
        words = [w.decode("utf-8", "surrogatepass") for w in numbers]
        ids: list[np.ndarray] = []
        tokenizer = _tokenizer(path)
        for at in range(0, len(words), _AT_ONCE):
            ids += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch(words[at:at + _AT_ONCE], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return pd.DataFrame({
            "block": group["block"], "numbers": group["numbers"],
            "sizes": [pack_numbers(sizes[use]) for use in uses],
            "ids": [pack_numbers(np.concatenate([ids[i] for i in use])) for use in uses],
        })

    return _by_bucket(blocks, buckets).groupBy("bucket").applyInPandas(
        run, "block bigint, numbers binary, sizes binary, ids binary")


def encode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) per row."""
    blocks = word_blocks(docs, id_column, text, block_bytes=block_bytes)
    words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    answers = encoded_words(blocks, bucket_count(words), path)

    def place(block: pa.Table, answer: pa.Table) -> pa.Table:
        """Ids back to the places of their words; pieces by id."""
        pieces = _pieces(path)
        n = block["n_words"][0].as_py()
        sizes, starts, flat, at = np.zeros(n, np.int32), np.zeros(n, np.int32), [], 0
        for numbers, size, ids in zip(*[answer[c].to_pylist() for c in ("numbers", "sizes", "ids")]):
            own, count = np.cumsum(unpack_numbers(numbers)), unpack_numbers(size)
            sizes[own] = count
            starts[own] = at + np.concatenate(([0], np.cumsum(count[:-1])))
            flat.append(unpack_numbers(ids))
            at += len(flat[-1])
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        as_text = [pieces[i] for i in ids.tolist()]
        decoded = [" ".join(as_text[s:s + k]) for s, k in zip(starts.tolist(), sizes.tolist())]
        codes = unpack_numbers(block["codes"][0].as_py())
        offsets, out_ids, texts = [0], [], []
        for x, z in spans(block["lengths"][0].as_py()):
            own = codes[x:z]
            count = sizes[own]
            total = int(count.sum())
            first = np.repeat(starts[own] - (np.cumsum(count) - count), count)
            out_ids.append(ids[first + np.arange(total)])
            offsets.append(offsets[-1] + total)
            texts.append(" ".join(filter(None, map(decoded.__getitem__, own.tolist()))))
        return pa.table({
            "doc_id": pa.array(block["doc_ids"][0].as_py(), pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out_ids), pa.int32())),
            "decoded": pa.array(texts, pa.string()),
        })

    def join(block: pa.Table, answer: pa.Table) -> pa.Table:
        return place(block, answer)

    return (
        blocks.select("block", "doc_ids", "lengths", "n_words", "codes").groupBy("block")
        .cogroup(answers.groupBy("block")).applyInArrow(join, "doc_id bigint, ids array<int>, decoded string")
    )
