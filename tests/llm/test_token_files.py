"""Token files against the tokenizers library on whole texts, and exact round trips of the grammar."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shelfmark.functions.lineage import ensure_checkpoint_dir
from shelfmark.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, _hash string, ids string, start string"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\tb", "don't we'll 'tis", "x<|endoftext|>y z", "<|endoftext|>",
       "a <|endoftext|> b", "naïve café 12 345", "汉字 漢字　全角", "a b c d", "\x1c \x1d\x85 e", "é​ f", "🙂 🙂🙂 x",
       "a\r\n\r\n b", "word," * 3 + " word", "᠎ a ﻿ b"]


def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library_on_odd_texts():
    want = library()
    for known, cut in ((1_000_000, 4_000_000), (3, 8)):
        texts = [*ODD, " ".join(ODD), "b".join(ODD), " x ".join(reversed(ODD))]
        for text, ids in zip(texts, tf.Encoder(PATH, known, cut).encode(texts), strict=True):
            assert ids.tolist() == want(text), (known, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,.'\n\t  é中1<|endoftx>\x1f‍"), max_size=40), max_size=6))
def test_encoder_equals_library(texts):
    want = library()
    for text, ids in zip(texts, tf.Encoder(PATH, 5, 6).encode(texts), strict=True):
        assert ids.tolist() == want(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip(ids, start, stop):
    ids = np.array(ids, np.int32)
    first, table, sizes, symbols = tf.compress(ids, least_places=2, least_saving=0.0)
    assert tf.expand(symbols, first, table).tolist() == ids.tolist()
    assert [len(tf.expand(np.array([first + k], np.uint32), first, table)) for k in range(len(table))] == sizes.tolist()
    block = tf.Block(memoryview(tf.build_block(ids)), 0)
    assert block.ids(start, stop).tolist() == ids[start:stop].tolist()


def test_repeated_text_becomes_rules():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50_000, 200)
    ids = np.concatenate([x for _ in range(300) for x in (passage, rng.integers(0, 50_000, 5))]).astype(np.int32)
    block = tf.build_block(ids)
    assert len(block) < len(ids)  # two bytes an id would be twice that
    read = tf.Block(memoryview(block), 0)
    for start, stop in ((0, 1), (5_000, 5_003), (len(ids) - 1, len(ids) + 9), (0, len(ids))):
        assert read.ids(start, stop).tolist() == ids[start:stop].tolist()


def test_chunks_seen_again_are_remembered_from_task_to_task(monkeypatch):
    want, asked = library(), []
    encoder = tf.worker_encoder(PATH)
    assert tf.worker_encoder(PATH) is encoder
    encoder = tf.Encoder(PATH, known=40)
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda: (asked.extend(encoder.numbers.new), learn()))
    often = [f"often{k}" for k in range(10)]
    for task in range(6):
        texts = ["x " + " ".join([*often, *often, *[f"rare{task}x{k}" for k in range(20)]]), "", *ODD]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == want(text)
    assert len(encoder.numbers) <= 40 + len(ODD) * 8
    assert sorted(x for x in asked if x.startswith("often")) == sorted(often)
    assert len({x for x in asked if x.startswith("rare")}) == 120


def rows():
    rng = random.Random(11)
    words = ["alpha", "beta,", "Gamma.", "d\n\ne", "", "été", "12", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    out = [(i * 3 % 151, x) for i, x in enumerate(texts)]
    out += [(900, x) for x in ODD] + [(None, "no id"), (None, None), (-5, None), (901, "copy"), (901, "copy")]
    out += [(902, "again and " * 40_000)] + [(903, "hot row")] * 200
    return [(*r, "clash", "clash", "clash") for r in out]


def brute(table):
    want, start, out = library(), 0, []
    for doc_id, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*want(text), 2], "<u4").tobytes()
        out.append((doc_id, len(ids) // 4, zlib.crc32(ids)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_ids": 500, "block_ids": 130}])
def test_round_trip(spark, sizes):
    table = rows()
    frame = spark.createDataFrame(random.Random(2).sample(table, len(table)), SCHEMA).repartition(5)
    folder = f"{ensure_checkpoint_dir(spark)}/ids-test-{len(sizes)}"
    tf.write_ids(frame, folder, PATH, 2, **sizes)
    got = sorted(tf.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    found = [(r["doc_id"], r["n_ids"], zlib.crc32(bytes(r["ids"]))) for r in got]
    want = brute([r[:2] for r in table])
    assert sorted(found, key=str) == sorted(want, key=str)
    assert [r[0] for r in found] == [r[0] for r in want]
    ends = np.cumsum([r["n_ids"] for r in got]).tolist()
    assert [r["start"] for r in got] == [0, *ends[:-1]]

    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    rng = random.Random(4)
    asked = [(k, rng.randrange(-20, len(whole)), rng.choice([0, 1, 7, 900, 30_000])) for k in range(40)] + [(99, None, 4)]
    spans = tf.read_spans(spark, folder, spark.createDataFrame(asked, "span_id bigint, start bigint, n_ids bigint"))
    wanted = {k: [] if s is None else whole[max(s, 0):max(s + n, 0)].tolist() for k, s, n in asked}
    assert {r["span_id"]: r["ids"] for r in spans.collect()} == wanted


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert tf.round_trip(frame, PATH, 2).collect() == []


def test_rules_written_out_once():
    rng = np.random.default_rng(3)
    # Long runs and repeats give rules of rules; ids up to the largest that three bytes hold beside the rules.
    for ids in (np.tile(rng.integers(0, 50, 40), 400), np.zeros(9_000, int), rng.integers(0, 7, 20_000), np.array([5]), np.array([], int),
                np.full(4, (1 << 24) - 9), np.append(np.tile([1, 2, 3, 4], 3_000), 60_000)):
        first, table, sizes, symbols = tf.compress(ids.astype(np.int32), 2, 0.0001)
        got = tf.expand(symbols, first, table, sizes)
        assert got.dtype == np.uint32 and np.array_equal(got, ids)
        each = [tf.expand(symbols[i:i + 1], first, table, sizes) for i in range(min(len(symbols), 50))]
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *each]), ids[:sum(map(len, each))])
        block = tf.Block(memoryview(tf.build_block(ids.astype(np.int32))), 0)
        assert np.array_equal(block.ids(0, len(ids)), ids) and np.array_equal(block.ids(1, len(ids) - 1), ids[1:-1])
