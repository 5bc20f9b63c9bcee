"""Tree-reduced byte-level BPE against the tokenizer's own library, and round trips."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import tiktoken
from pyspark.sql import functions as F

from foliant.llm import bpe

RANKS = bpe.read_ranks(bpe.vocabulary())
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "b", "the", " ", "  ", "\n", "'s", "'re", "'r", "'", "e", "ll", "1", "23", "é", "東", "😀", "\x1c", "\xa0", "\x85", "-", "--", "==", "_", "A", "ing", "tion", "\t", "<|endoftext|>"]


def ids(codec, text):
    raw = codec.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize(("chars", "size"), [(1, 1), (3, 2), (8, 4), (bpe.LEAF_CHARS, bpe.LEAF_BYTES)])
def test_equals_the_library_for_all_sizes_of_leaves(chars, size):
    rng, codec = random.Random(chars), bpe.Codec(RANKS, bpe.pattern(), chars, size)
    for _ in range(1500):
        text = "".join(rng.choices(PARTS[: rng.randint(2, len(PARTS))], k=rng.randint(0, 60)))
        assert ids(codec, text) == LIBRARY.encode_ordinary(text), text
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("size", [2, 8])
def test_joined_tokens_of_one_piece_are_those_of_the_whole(size):
    rng, codec = random.Random(size), bpe.Codec(RANKS, bpe.pattern(), leaf_bytes=size)
    for letters in ("ab", "aeinrst", "=-", "acgt", "é東a"):
        for _ in range(150):
            raw = "".join(rng.choices(letters, k=rng.randint(1, 90))).encode()
            assert codec.of_bytes(raw) == LIBRARY._core_bpe.encode_single_piece(raw) or raw in RANKS


@pytest.mark.parametrize("text", ["a" * 60_001, "ab" * 30_000, " " * 30_001 + "x", "=" * 40_000 + "-" * 9_000, "é" * 30_001, "x\n" * 20_000, "'re" * 20_000, "word " * 30_000, "\n \n" * 20_000 + "'"])
def test_long_texts_and_pieces(text):
    codec = bpe.Codec(RANKS, bpe.pattern())
    assert ids(codec, text) == LIBRARY.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    codec = bpe.Codec(RANKS, bpe.pattern())
    text = " ".join(f"w{i} w{i % 7}" for i in range(500))
    assert ids(codec, text) == LIBRARY.encode_ordinary(text) and len(codec.known) <= 10 and len(codec.old) <= 10


def test_frames(spark):
    rows = [(1, "Plain text, it's 3.14."), (None, None), (3, ""), (3, ""), (5, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("own"), "bytes": F.lit(1)})
    back = bpe.decode(bpe.encode(df, ["doc_id", "text"]), ["doc_id", "text"]).collect()
    assert len(back) == 5 and all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)
    numbers = bpe.token_ids(df)
    assert numbers.columns == [*df.columns, "ids_"] and all(r["ids_"] == LIBRARY.encode_ordinary(r["text"] or "") for r in numbers.collect())
    assert bpe.encode(df.where("false"), ["doc_id"]).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(nothing, ["doc_id"]).first()["bytes"] is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r)[1:] for r in bpe.op13_bpe(spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        tokens = LIBRARY.encode_ordinary(text or "")
        raw = struct.pack(f"<{len(tokens)}I", *tokens)
        assert got.pop(doc_id) == (len(tokens), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert not got
