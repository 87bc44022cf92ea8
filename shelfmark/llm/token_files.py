"""Token files: texts as ids of a byte-level tokenizer, compressed by a grammar of repeated pairs.

A file holds shards, a shard some whole documents in order: a directory (document,
number of ids) and blocks of at most ``BLOCK_IDS`` ids, each with a grammar of its
own.  Re-Pair makes the grammar: pairs of neighbouring symbols that are frequent
become rules, their places one symbol each, and again until a round saves too
little.  Rules carry the number of ids they expand to, and every ``STEP``-th
symbol of a block its place, so ids can be decoded from any place on.

Layout (little endian; numbers of symbols take three bytes):
``TIDS`` | bytes of the shard u64 | part u32 | shard u32 | documents u32 | blocks u32 |
ids of the part before it u64 | ids u64 |
documents: doc_id i64, is null u8, ids u64 | blocks, each:
ids u32 | first rule u32 | rules u32 | symbols u32 | rules: left u24, right u24, ids u32 |
symbols u24 | places of every ``STEP``-th symbol u32.

Defined results: a null text counts as empty and has the end id only; null ids come
first; repeated rows are written as often as they stand there; an empty table gives
no rows; other columns are ignored, whatever their names.

Texts are encoded chunk by chunk.  The tokenizer's split never joins a chunk that
ends in a visible character with one that starts with a blank and a visible
character, so a text may be cut there and equal chunks encoded once as long as the
Python worker, which runs one task after another, remembers them.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.functions.lineage import ensure_checkpoint_dir
from shelfmark.llm.rows import whole_text

MAGIC = b"TIDS"
#: Ids that a shard is closed at; a longer document is a shard of its own.
SHARD_IDS = 1 << 21
#: Ids that share a grammar; sets the memory of Re-Pair.
BLOCK_IDS = 1 << 20
#: Places at which a pair must be replaced to become a rule.
LEAST_PLACES = 6
#: Re-Pair ends with the round that saves less than this share of the symbols.
LEAST_SAVING = 0.04
#: Symbols between two stored places.
STEP = 1024
#: Shards in one file.
SHARDS_PER_FILE = 16
#: Chunks known to a worker before it forgets the rare ones, and characters of a text taken at a time.
KNOWN_CHUNKS = 1_000_000
SLICE_CHARS = 4_000_000
#: Characters of texts that are looked up together.
GROUP_CHARS = 2_000_000

_HEAD = struct.Struct("<4sQIIIIQQ")
_BLOCK = struct.Struct("<IIII")
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8")])
#: Code points that some version of the tokenizer's tables may take for white space or split apart from letters.
_UNSAFE = frozenset(["", *map(chr, [*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010),
                              *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF])])

# ---------------------------------------------------------------- encoding

@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Chunks(dict):
    """Numbers of pieces in the order in which they come; ``new`` are those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class _Column:
    """A numpy array that grows at its end."""

    def __init__(self, dtype) -> None:
        self.data, self.used = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, len(self.data)), self.data.dtype)])
        self.data[self.used:need] = values
        self.used = need


class Encoder:
    """Ids of whole texts; the library encodes a distinct chunk once, as long as it is remembered."""

    def __init__(self, path: str, known: int = KNOWN_CHUNKS, slice_chars: int = SLICE_CHARS) -> None:
        self.tokenizer, self.limit, self.slice_chars = _tokenizer(path), known, slice_chars
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Byte-level tokens write a blank as U+0120; of a chunk only the first token begins with one.
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.special = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Chunks()
        self.pieces: list[str] = []
        self.ids = _Column(np.int32)
        #: Of every piece: place and number of its ids, whether a chunk may begin or end with it, how often it was seen.
        self.first, self.size = _Column(np.int64), _Column(np.int64)
        self.opens, self.closes = _Column(bool), _Column(bool)
        self.seen = _Column(np.int64)

    def _forget(self) -> None:
        """Keep what was seen again, at most half of what may be known; what is not seen any more fades."""
        seen = self.seen.data[:self.seen.used]
        kept = np.flatnonzero(seen > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-seen[kept], kind="stable")[:self.limit // 2]])
        pieces = [self.pieces[i] for i in kept.tolist()]
        ids, size = self._gather(self.ids.data, self.first.data[kept], self.size.data[kept]), self.size.data[kept]
        opens, closes, seen = self.opens.data[kept], self.closes.data[kept], seen[kept] // 2
        self._clear()
        self.numbers.update(zip(pieces, range(len(pieces))))
        self.pieces = pieces
        self._extend(ids, size, opens, closes)
        self.seen.extend(seen)

    def _extend(self, ids: np.ndarray, size: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> None:
        self.first.extend(self.ids.used + np.cumsum(size) - size)
        self.ids.extend(ids)
        self.size.extend(size)
        self.opens.extend(opens)
        self.closes.extend(closes)

    def _look_up(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces between blanks, and where the pieces of every slice begin."""
        split = pc.split_pattern(pa.array(slices, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        places = coded.indices.to_numpy()
        self.seen.extend(np.zeros(len(self.numbers) - self.seen.used, np.int64))
        self.seen.data[numbers] += np.bincount(places, minlength=len(numbers))
        return numbers[places], split.offsets.to_numpy().astype(np.int64)[:-1]

    def _learn(self) -> None:
        """Encode the new pieces, each as a chunk after a blank.

        Pieces that begin or end invisibly, or hold a special token, get no ids: no cut is made beside them.
        """
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        opens = np.fromiter((x[:1] not in _UNSAFE for x in new), bool, len(new))
        closes = np.fromiter((x[-1:] not in _UNSAFE for x in new), bool, len(new))
        for text in self.special:
            if text in "\n".join(new):
                special = np.fromiter((text in x for x in new), bool, len(new))
                opens &= ~special
                closes &= ~special
        plain = opens & closes
        chunks = [new[i] for i in np.flatnonzero(plain).tolist()]
        size = np.zeros(len(new), np.int64)
        ids = np.zeros(0, np.int32)
        if chunks:
            rows = [" " + " ".join(chunks[k:k + 256]) for k in range(0, len(chunks), 256)]
            ids = np.concatenate([
                np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)])
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(chunks):
                raise ValueError("not a tokenizer that splits at blanks")
            size[plain] = np.diff(np.append(begin, len(ids)))
        self.pieces.extend(new)
        self._extend(ids, size, opens, closes)

    @staticmethod
    def _gather(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        where = np.repeat(first - (np.cumsum(count) - count), count)
        where += np.arange(len(where))
        return ids[where]

    def _place(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices from the numbers of their pieces, and where the ids of every slice begin.

        What is no plain chunk goes to the library as it stands.
        """
        opens, closes = self.opens.data[codes], self.closes.data[codes]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = closes[:-1] & opens[1:]
        cut[starts] = True
        single = opens & closes & cut[:-1] & cut[1:]
        single[starts] = False  # no blank before it
        heads = np.flatnonzero(cut)
        loose = np.flatnonzero(~single[heads[:-1]])
        begins = heads[loose]
        inner = np.ones(len(codes), bool)
        inner[starts] = False
        texts = [
            (" " if blank else "") + " ".join([self.pieces[i] for i in codes[x:z].tolist()])
            for x, z, blank in zip(begins.tolist(), heads[loose + 1].tolist(), inner[begins].tolist())]
        rest = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.where(single, self.size.data[codes], 0)
        count[begins] = own = np.fromiter(map(len, rest), np.int64, len(rest))
        first = self.first.data[codes]
        first[begins] = self.ids.used + np.cumsum(own) - own
        known = self.ids.used
        self.ids.extend(np.concatenate([np.zeros(0, np.int32), *rest]))  # behind the known ids, for this group only
        ids = self._gather(self.ids.data, first, count)
        self.ids.used = known
        return ids, (np.cumsum(count) - count)[starts]

    def _slices(self, text: str) -> Iterator[str]:
        """A very long text in slices that begin where a chunk begins."""
        at = 0
        while len(text) - at > self.slice_chars:
            cut = text.find(" ", at + self.slice_chars)
            while 0 < cut and not (cut + 1 < len(text) and text[cut - 1] not in _UNSAFE and text[cut + 1] not in _UNSAFE
                                   and not any(s in text[cut - len(s):cut + len(s) + 1] for s in self.special)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def _encode_group(self, group: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts, each given as its slices.  Leaves nothing half learnt, for the next task goes on from here."""
        try:
            codes, starts = self._look_up([x for slices in group for x in slices])
            self._learn()
            ids, begins = self._place(codes, starts)
            if len(self.numbers) > self.limit:
                self._forget()
        except BaseException:
            self._clear()
            raise
        firsts = np.cumsum([0, *map(len, group)])[:-1]
        return np.split(ids, begins[firsts][1:])

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """For every text the ids that the library gives for the whole of it."""
        group: list[list[str]] = []
        waiting = 0
        for text in texts:
            # The first piece of a later slice is empty: the blank before its chunk.
            group.append(list(self._slices(text)))
            waiting += len(text)
            if waiting >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, waiting = [], 0
        if group:
            yield from self._encode_group(group)


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The encoder of a Python worker: its tasks run one after another and know the chunks of those before."""
    return Encoder(path)


# ---------------------------------------------------------------- grammar

def compress(ids: np.ndarray, least_places: int = LEAST_PLACES, least_saving: float = LEAST_SAVING):
    """Re-Pair: (first rule, rules as rows left and right, ids per rule, symbols).

    Each round counts the pairs of neighbours, and wherever a frequent pair
    stands it is replaced unless a more frequent one overlaps it.  Pairs are
    counted in a table by hash, one pair per place of the table; pairs that share
    a place wait for a later round, which hashes differently.
    """
    symbols = ids.astype(np.uint32)
    first = int(symbols.max()) + 1 if len(symbols) else 0
    rules, top, round_ = [], first, 0
    bits = max(10, int(len(symbols)).bit_length() - 3)
    representative = np.zeros(1 << bits, np.int32)
    numbers = np.arange(len(symbols), dtype=np.int32)
    while len(symbols) > 1:
        pairs = symbols[:-1].astype(np.uint64) << np.uint64(32)
        pairs |= symbols[1:]
        place = pairs * np.uint64(0x9E3779B97F4A7C15 + (round_ << 33 | round_ << 1))
        place >>= np.uint64(64 - bits)
        place = place.view(np.int64)
        representative[place] = numbers[:len(place)]
        same = pairs[representative[place]] == pairs
        counts = np.bincount(place[same], minlength=1 << bits)
        # Rank of a pair by its frequency, equal ones told apart by their place in the table; 0 stays as it is.
        frequent = np.flatnonzero(counts >= least_places)
        ranks = np.zeros(1 << bits, np.int32)
        ranks[frequent[np.argsort(counts[frequent], kind="stable")]] = np.arange(1, len(frequent) + 1, dtype=np.int32)
        rank = ranks[place]
        rank *= same
        best = rank > 0
        best[1:] &= rank[1:] > rank[:-1]
        best[:-1] &= rank[:-1] >= rank[1:]
        taken = np.flatnonzero(best)
        where = place[taken]
        enough = np.bincount(where, minlength=1 << bits) >= least_places
        kept = enough[where]
        taken, where = taken[kept], where[kept]
        if len(taken) < max(1, least_saving * len(symbols)):
            break
        chosen = np.flatnonzero(enough)
        names = np.zeros(1 << bits, np.uint32)
        names[chosen] = top + np.arange(len(chosen), dtype=np.uint32)
        known = representative[chosen]
        rules.append(np.stack([symbols[known], symbols[known + 1]], 1))
        symbols = symbols.copy()
        symbols[taken] = names[where]
        keep = np.ones(len(symbols), bool)
        keep[taken + 1] = False
        symbols = symbols[keep]
        top += len(chosen)
        round_ += 1
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return first, table, rule_sizes(first, table), symbols


def rule_sizes(first: int, table: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to.  Rules refer to earlier ones only."""
    sizes = np.zeros(len(table), np.int64)
    todo = np.arange(len(table))
    known = np.zeros(len(table), bool)
    while len(todo):
        inner = [np.where(table[todo, side] >= first, table[todo, side].astype(np.int64) - first, -1) for side in (0, 1)]
        ready = (known[inner[0]] | (inner[0] < 0)) & (known[inner[1]] | (inner[1] < 0))
        now = todo[ready]
        sizes[now] = sum(np.where(x[ready] < 0, 1, sizes[x[ready]]) for x in inner)
        known[now] = True
        todo = todo[~ready]
    return sizes


def expand(symbols: np.ndarray, first: int, table: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Ids that symbols stand for; ``sizes`` are those of the rules, if known.

    For many symbols the rules are written out once and copied from there, if they are short enough.
    """
    sizes = rule_sizes(first, table) if sizes is None else sizes
    if len(symbols) > first + 2 * len(table) and sizes.sum(dtype=np.int64) <= 4 * len(symbols):
        count = np.append(np.ones(first, np.int64), sizes)
        begin = np.cumsum(count) - count
        rules = expand(np.arange(first, first + len(table), dtype=np.uint32), first, table, sizes)
        written = np.append(np.arange(first, dtype=np.uint32), rules)
        count, begin = count[symbols], begin[symbols]
        begin -= np.cumsum(count) - count
        where = np.repeat(begin, count)
        where += np.arange(len(where))
        return written[where]
    while len(symbols):
        inner = symbols >= first
        if not inner.any():
            break
        starts = np.arange(len(symbols)) + np.cumsum(inner) - inner
        out = np.empty(len(symbols) + int(inner.sum()), np.uint32)
        out[starts] = symbols
        rule = table[symbols[inner].astype(np.int64) - first]
        out[starts[inner]], out[starts[inner] + 1] = rule[:, 0], rule[:, 1]
        symbols = out
    return symbols


# ---------------------------------------------------------------- file format

def _pack3(numbers: np.ndarray) -> bytes:
    if len(numbers) and int(numbers.max()) >= 1 << 24:
        raise ValueError("symbols beyond three bytes: use smaller blocks")
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpack3(data: memoryview) -> np.ndarray:
    # Four bytes are read at every third one; the last of them belongs to the next number.
    wide = np.ndarray(len(data) // 3, "<u4", bytes(data) + b"\0", strides=(3,))
    return wide & np.uint32(0xFFFFFF)


def build_block(ids: np.ndarray) -> bytes:
    first, table, sizes, symbols = compress(ids)
    size = _symbol_sizes(symbols, first, sizes)
    places = (np.cumsum(size) - size)[::STEP]
    return b"".join([
        _BLOCK.pack(len(ids), first, len(table), len(symbols)), _pack3(table.ravel()), sizes.astype("<u4").tobytes(),
        _pack3(symbols), places.astype("<u4").tobytes(),
    ])


def _symbol_sizes(symbols: np.ndarray, first: int, sizes: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    out[inner] = sizes[symbols[inner].astype(np.int64) - first]
    return out


class Block:
    """One grammar with its symbols, over the bytes of a shard."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.n_ids, self.first, rules, symbols = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        self.table = _unpack3(data[at:at + 6 * rules]).reshape(-1, 2)
        at += 6 * rules
        self.sizes = np.frombuffer(data, "<u4", rules, at)
        at += 4 * rules
        self.symbols = data[at:at + 3 * symbols]
        at += 3 * symbols
        self.places = np.frombuffer(data, "<u4", -(-symbols // STEP), at)
        self.end = at + self.places.nbytes

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``; only the symbols that stand for them are expanded."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        if stop - start == self.n_ids:
            return expand(_unpack3(self.symbols), self.first, self.table, self.sizes)
        x, z = int(np.searchsorted(self.places, start, "right")) - 1, int(np.searchsorted(self.places, stop, "left"))
        symbols = _unpack3(self.symbols[3 * STEP * x:3 * STEP * z])
        ends = int(self.places[x]) + np.cumsum(_symbol_sizes(symbols, self.first, self.sizes))
        a = int(np.searchsorted(ends, start, "right"))
        z = int(np.searchsorted(ends, stop, "left")) + 1
        base = int(ends[a - 1]) if a else int(self.places[x])
        return expand(symbols[a:z], self.first, self.table, self.sizes)[start - base:stop - base]


class Shard:
    """Directory and blocks of one shard at a place of a file."""

    def __init__(self, data: memoryview, at: int = 0) -> None:
        magic, size, self.part, self.number, docs, blocks, self.before, self.n_ids = _HEAD.unpack_from(data, at)
        if magic != MAGIC or at + size > len(data):
            raise ValueError("not a shard of token ids")
        self.end = at + size
        self.documents = np.frombuffer(data, _DOC, docs, at + _HEAD.size)
        at += _HEAD.size + self.documents.nbytes
        self._data, self._at, self._blocks = data[:self.end], at, blocks

    def blocks(self) -> Iterator[Block]:
        at = self._at
        for _ in range(self._blocks):
            block = Block(self._data, at)
            at = block.end
            yield block

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``, counted within the shard."""
        out, base = [np.zeros(0, np.uint32)], 0
        for block in self.blocks():
            if base < stop and start < base + block.n_ids:
                out.append(block.ids(start - base, stop - base))
            base += block.n_ids
        return np.concatenate(out)


def shards_of(data: bytes) -> Iterator[Shard]:
    view, at = memoryview(data), 0
    while at < len(view):
        shard = Shard(view, at)
        at = shard.end
        yield shard


class _Writer:
    """Documents of one task, in order, as shards."""

    def __init__(self, part: int, shard_ids: int, block_ids: int) -> None:
        self.part, self.number, self.before = part, 0, 0
        self.shard_ids, self.block_ids = shard_ids, block_ids
        self._open()

    def _open(self) -> None:
        self.documents: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held, self.n_ids, self.blocks = 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.documents.append((doc_id or 0, doc_id is None, len(ids)))
        self.n_ids += len(ids)
        for at in range(0, len(ids), self.block_ids):
            self.waiting.append(ids[at:at + self.block_ids])
            self.held += len(self.waiting[-1])
            while self.held >= self.block_ids:
                self._block(self.block_ids)
        if self.n_ids >= self.shard_ids:
            yield self.close()

    def _block(self, size: int) -> None:
        ids = np.concatenate(self.waiting)
        self.blocks.append(build_block(ids[:size]))
        self.waiting, self.held = [ids[size:]], len(ids) - min(size, len(ids))

    def close(self) -> bytes:
        if self.held:
            self._block(self.held)
        documents = np.array(self.documents, _DOC).tobytes()
        # The last byte is the line feed that Spark's text writer puts after a row.
        size = _HEAD.size + len(documents) + sum(map(len, self.blocks)) + 1
        out = b"".join([_HEAD.pack(MAGIC, size, self.part, self.number, len(self.documents), len(self.blocks),
                                   self.before, self.n_ids), documents, *self.blocks])
        self.number, self.before = self.number + 1, self.before + self.n_ids
        self._open()
        return out


# ---------------------------------------------------------------- jobs

def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text",
    shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of every text, each with ``end_id`` after it, under ``folder`` in ascending order of the documents.

    Order: null ids first, then by id; documents of one id by the hash of their
    text, equal rows as they come.  A range shuffle deals the documents, so that
    even rows of one id go to many tasks.  Each task encodes, compresses and
    writes its range as a stream; it holds one shard at a time.
    """
    order = ["doc_id", "_hash", "_place"]
    ranged = (
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
        .withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = _Writer(TaskContext.get().partitionId(), shard_ids, block_ids), worker_encoder(tokenizer)
        end = np.array([end_id], np.int32)

        def members() -> Iterator[bytes]:
            for batch in batches:
                texts = (x.as_py() for x in batch.column("text"))
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                    yield from writer.add(doc_id, np.concatenate([ids, end]))
            if writer.documents:
                yield writer.close()

        for member in members():
            yield pa.RecordBatch.from_arrays([pa.array([member], pa.binary())], ["member"])

    # The cast keeps the bytes as they are.
    (ranged.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", SHARDS_PER_FILE).text(folder, lineSep="\n"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _directory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, read from the heads: path, part, shard, before (ids before it in its part), n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [(path, s.part, s.number, s.before, s.n_ids) for s in shards_of(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names)

    names = ["path", "part", "shard", "before", "n_ids"]
    return _files(spark, folder).mapInArrow(run, "path string, part bigint, shard bigint, before bigint, n_ids bigint")


def _part_starts(directory: DataFrame) -> DataFrame:
    """Ids before each part: one row per task that wrote, so the window and the broadcast stay small."""
    parts = directory.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_first"))


def shard_directory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard: path, part, shard, first (ids of all documents before it), n_ids."""
    directory = _directory(spark, folder)
    return directory.join(F.broadcast(_part_starts(directory)), "part").select(
        "path", "part", "shard", (F.col("before") + F.col("part_first")).alias("first"), "n_ids")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_ids, ids (unsigned 32-bit, little endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard in shards_of(content.as_py()):
                    counts = shard.documents["ids"].astype(np.int64)
                    ends = np.cumsum(counts)
                    ids = shard.ids(0, shard.n_ids).astype("<u4")
                    offsets = np.append(0, 4 * ends)
                    if offsets[-1] >= 1 << 31:
                        raise ValueError("a document beyond 2 GB")
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(ends), shard.part)),
                        pa.array(shard.documents["doc_id"].astype(np.int64), mask=shard.documents["null"].astype(bool)),
                        pa.array(shard.before + ends - counts), pa.array(counts),
                        pa.Array.from_buffers(pa.binary(), len(ends), [
                            None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                    ], ["part", "doc_id", "before", "n_ids", "ids"])

    documents = _files(spark, folder).mapInArrow(run, "part bigint, doc_id bigint, before bigint, n_ids bigint, ids binary")
    return documents.join(F.broadcast(_part_starts(_directory(spark, folder))), "part").select(
        "doc_id", (F.col("before") + F.col("part_first")).alias("start"), "n_ids", "ids")


def read_spans(spark: SparkSession, folder: str, spans: DataFrame) -> DataFrame:
    """Any spans of the whole sequence of ids: for ``spans`` (span_id, start, n_ids) the ids as an array of int.

    A span is joined to the shards it meets by stretches of ``SHARD_IDS`` ids;
    only those files are opened and only the symbols of the span expanded.  What
    lies outside of the sequence is cut off; a span with a null gives no ids.
    """
    stretch = lambda x: F.floor(x / SHARD_IDS).cast("bigint")
    over = lambda first, n: F.explode(F.sequence(stretch(first), stretch(first + n - 1)))
    shards = shard_directory(spark, folder).filter("n_ids > 0").withColumn("_stretch", over(F.col("first"), F.col("n_ids")))
    total = shards.agg(F.max(F.col("first") + F.col("n_ids"))).first()[0] or 0
    asked = spans.filter("start IS NOT NULL AND n_ids IS NOT NULL").select(
        "span_id", F.col("start").cast("bigint").alias("_from"),
        (F.col("start") + F.col("n_ids")).cast("bigint").alias("_to"))
    inside = asked.withColumns({
        "_from": F.greatest("_from", F.lit(0)), "_to": F.least("_to", F.lit(total)),
    }).filter("_from < _to").withColumn("_stretch", over(F.col("_from"), F.col("_to") - F.col("_from")))
    met = (
        inside.join(shards, "_stretch")
        .filter("_from < first + n_ids AND first < _to")
        .dropDuplicates(["span_id", "_from", "_to", "path", "shard"])
        .select("path", "shard", "span_id", (F.col("_from") - F.col("first")).alias("x"),
                (F.col("_to") - F.col("first")).alias("z"), F.greatest("_from", "first").alias("at"))
    )

    def cut(files: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        for content in files["content"]:
            shards = {s.number: s for s in shards_of(content.as_py())}
            for row in wanted.to_pylist():
                ids = shards[row["shard"]].ids(row["x"], row["z"])
                out.append({"span_id": row["span_id"], "at": row["at"], "ids": ids.tolist()})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("span_id", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    pieces = _files(spark, folder).join(met.select("path").distinct(), "path", "left_semi").groupBy("path").cogroup(
        met.withColumn("span_id", F.col("span_id").cast("bigint")).groupBy("path")
    ).applyInArrow(cut, "span_id bigint, at bigint, ids array<int>")
    found = pieces.groupBy("span_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return spans.select("span_id").distinct().join(found, "span_id", "left").select(
        "span_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of ``docs`` into a new folder of the shared checkpoint folder and read them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer, end_id)
    return read_ids(spark, folder)
