"""Language-model scores with stupid backoff, from counts of the corpus itself.

Documents become n-grams, which are counted over the whole corpus in tables
partitioned by hash, joined back to the n-grams of every document and summed per
document:

    S(w | history) = c(history w) / c(history)          if the n-gram was seen
                   = 0.4 * S(w | shorter history)       otherwise
    S(w)           = c(w) / N, and 1 / (N + 1) for a word that was not seen

A document does not vouch for itself: what it contributes to a count is taken off
before its score is formed (``leave_out``).

The work is dealt in blocks of documents (``blocks``): an n-gram is a 64-bit hash
and crosses the network once per block that holds it, sorted and packed, together
with the count of the block; its bucket adds the counts up and sends the totals
back to the same blocks.  The most frequent n-gram is one entry per block like
any other.  N-grams do not span documents.

Defined results: a null or empty text has no words, ``n_words`` 0 and the null
score; repeated rows are documents of their own; a null id is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.blocks import BLOCK_BYTES, bucket_count, spans, unpack_numbers, unpack_words, word_blocks

ORDER = 2
BACKOFF = 0.4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _gram_hashes(hashes: np.ndarray, order: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at every word, and which places have a whole one within their document."""
    inside = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = hashes
    for back in range(1, order):
        earlier = np.concatenate([np.zeros(back, np.uint64), hashes[:-back]])[:len(hashes)]
        out = (out ^ (out >> np.uint64(31))) * _MIX + (earlier ^ np.uint64(back)) * np.uint64(0xD6E8FEB86659FD93)
    return out, inside >= order - 1


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences."""
    return _zip(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_counts(counts: np.ndarray) -> bytes:
    return _zip(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _block_grams(codes: bytes, words: bytes, n_words: int, lengths: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = _word_hashes(unpack_words(words, n_words))[unpack_numbers(codes)]
    return _gram_hashes(hashes, order, np.asarray(lengths, np.int64))


def _counted(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Distinct n-grams of every block with their counts, one row per block, length of n-gram and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for n in range(1, order + 1):
                    hashes, whole = _block_grams(row.codes, row.words, row.n_words, row.lengths, n)
                    grams, counts = np.unique(hashes[whole], return_counts=True)
                    # Buckets are ranges of the hash, so that a bucket of a sorted array is a slice.
                    bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    edges = np.searchsorted(bucket, np.arange(buckets + 1))
                    cut = [(b, x, z) for b, x, z in zip(range(buckets), edges, edges[1:]) if z > x]
                    yield pd.DataFrame({
                        "block": row.block, "n": n, "bucket": [b for b, _, _ in cut],
                        "grams": [_pack_sorted(grams[x:z]) for _, x, z in cut],
                        "counts": [_pack_counts(counts[x:z]) for _, x, z in cut],
                    })

    return blocks.select("block", "lengths", "n_words", "codes", "words").mapInPandas(
        run, "block bigint, n int, bucket int, grams binary, counts binary")


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """The count table of one bucket, looked up for every block that asked."""
    grams = [_unpack_sorted(g) for g in group["grams"]]
    counts = [_unpack_counts(c) for c in group["counts"]]
    table, place = np.unique(np.concatenate(grams), return_inverse=True)
    sums = np.bincount(place, np.concatenate(counts), len(table)).astype(np.int64)
    return pd.DataFrame({
        "block": group["block"], "n": group["n"], "bucket": group["bucket"],
        "totals": [_pack_counts(sums[np.searchsorted(table, g)]) for g in grams],
    })


def backoff_scores(counts: list[np.ndarray], own: list[np.ndarray], inside: np.ndarray, total: int, own_total: int) -> np.ndarray:
    """log S of every word of a document; ``counts[n]`` and ``own[n]`` are of the (n + 1)-gram that ends there."""
    left = [c - o for c, o in zip(counts, own)]
    n_left = total - own_total
    score = np.where(left[0] > 0, left[0] / max(1, n_left), 1.0 / (n_left + 1))
    for n in range(1, len(counts)):
        history = np.concatenate([[0], left[n - 1][:-1]])
        seen = (inside >= n) & (left[n] > 0) & (history > 0)
        score = np.where(seen, left[n] / np.maximum(1, history), np.where(inside >= n, BACKOFF * score, score))
    return np.log(score)


def score(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", order: int = ORDER, leave_out: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, log_score (sum of the logarithms) and perplexity per row."""
    blocks = word_blocks(docs, id_column, text, lower=True, block_bytes=block_bytes)
    size = blocks.select(F.explode("lengths").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    totals = _counted(blocks, order, bucket_count(size // 4)).groupBy("n", "bucket").applyInPandas(
        _totals, "block bigint, n int, bucket int, totals binary")

    def join(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        lengths = np.asarray(row["lengths"], np.int64)
        places, known = [], []
        for n in range(1, order + 1):
            hashes, whole = _block_grams(row["codes"], row["words"], row["n_words"], lengths, n)
            grams, place = np.unique(hashes[whole], return_inverse=True)
            found = answers[answers["n"] == n].sort_values("bucket")
            sums = np.concatenate([_unpack_counts(t) for t in found["totals"]]) if len(found) else np.zeros(0, np.int64)
            at = np.zeros(len(hashes), np.int64)
            at[whole] = sums[place]
            number = np.full(len(hashes), -1, np.int64)
            number[whole] = place
            known.append(at)
            places.append(number)
        out = []
        for doc_id, (x, z) in zip(row["doc_ids"], spans(lengths.tolist())):
            if x == z:
                out.append((doc_id, 0, None, None))
                continue
            own = []
            for number in places:
                _, inverse, counts = np.unique(number[x:z], return_inverse=True, return_counts=True)
                own.append(counts[inverse] if leave_out else np.zeros(z - x, np.int64))
            logs = backoff_scores([c[x:z] for c in known], own, np.arange(z - x), size, z - x if leave_out else 0)
            out.append((doc_id, z - x, float(logs.sum()), float(np.exp(-logs.mean()))))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "log_score", "perplexity"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return (
        blocks.select("block", "doc_ids", "lengths", "n_words", "codes", "words").groupBy("block")
        .cogroup(totals.groupBy("block")).applyInPandas(join, "doc_id bigint, n_words bigint, log_score double, perplexity double")
    )
