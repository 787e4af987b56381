"""Encoding, decoding, counting and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_texts import ODD_TEXTS, prose
from orderloom.llm import bpe_codec, packing, token_counts
from orderloom.llm.bpe import merge_heap, merge_scanning, pair
from tokenizers import Tokenizer

LETTERS = "aAbB éÉß İΣσς\n\t\r\x0b\x1c\x85\xa0 　'sS<|>▁́漢かな한３4½_-.,!*#@😀‍\x00"


def texts():
    draw = random.Random(4)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(40))) for _ in range(1500)]
    return [t or "" for t in ODD_TEXTS] + made + [prose(5, 200), "  a  b ", "x" * 500 + "é" * 400, "don't 's 'S"]


def test_word_codec_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe_codec.codec(path)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_counts_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path)
    assert len(own.whole) > 30_000
    for text in texts():
        assert own.count(text) == len(library.encode(text))


def test_byte_codec_equals_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in texts():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_both_ways_of_merging_agree():
    draw = random.Random(6)
    ranks = {(a, b): draw.randrange(30) for a in ("a", "b", "ab", "ba", "aa") for b in ("a", "b", "ab", "aba")}
    for _ in range(300):
        word = [draw.choice("ab") for _ in range(draw.randrange(1, 30))]
        assert merge_scanning(list(word), ranks, pair) == merge_heap(list(word), ranks, pair)


def test_round_trip_query(odd_docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = bpe_codec.digests(bpe_codec.round_trip(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    wanted = []
    for row in odd_docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        wanted.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)


def test_column_functions(odd_docs):
    from pyspark.sql import functions as F

    encoded = odd_docs.where("doc_id is not null").select("doc_id", bpe_codec.encode(F.col("text")).alias("ids"))
    both = bpe_codec.round_trip(odd_docs).where("doc_id is not null")
    assert sorted(encoded.collect(), key=repr) == sorted(both.select("doc_id", "ids").collect(), key=repr)
    decoded = encoded.select(bpe_codec.decode(F.col("ids")).alias("text"))
    assert {r.text for r in decoded.collect()} == {r.decoded for r in both.collect()}


def test_token_count_query(odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = []
    for row in odd_docs.collect():
        n = len(library.encode(row.text or ""))
        wanted.append((row.doc_id, len((row.text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, token_counts.token_counts(odd_docs).collect()), key=repr) == sorted(wanted, key=repr)


def check_packing(pieces, capacity=1024):
    """Every sequence is filled from 0 without gaps and not beyond its capacity."""
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_query(odd_docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(odd_docs).collect()
    sequences = check_packing(pieces)
    total = sum(p.length for p in pieces)
    assert -(-total // 1024) <= sequences <= -(-total // 1024) + 1
    left = {}
    for p in pieces:
        left.setdefault(p.doc_id, []).append((p.piece, p.start, p.length, p.ids_crc32))
    seen = set()
    for row in odd_docs.collect():
        if row.doc_id is None or row.doc_id == 3 and 3 in seen:
            continue
        seen.add(row.doc_id)
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [2]
        own = sorted(set(left[row.doc_id]))
        assert all(length == 1024 for _, _, length, _ in own[1:]) and sum(o[2] for o in own) == len(ids)
        for piece, start, length, crc in own:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


@pytest.mark.parametrize("shape", ["even", "long", "short", "one", "none", "whole"])
def test_plan_takes_every_piece(shape):
    draw = np.random.default_rng(8)
    histogram = np.zeros(1025, dtype=np.int64)
    lengths = {
        "even": draw.integers(1, 1024, 20_000), "long": draw.integers(500, 1024, 5000), "short": draw.integers(1, 9, 5000),
        "one": np.full(7, 300), "none": np.array([], dtype=int), "whole": np.full(3, 512),
    }[shape]
    np.add.at(histogram, lengths, 1)
    runs = packing.plan(histogram, 1024)
    used = np.zeros_like(histogram)
    ranks = {}
    for run in runs:
        assert sum(run.lengths) <= 1024
        for length, first in zip(run.lengths, run.first_ranks):
            used[length] += run.repeats
            ranks.setdefault(length, []).extend(range(first, first + run.repeats))
    assert (used == histogram).all()
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    if shape == "even":
        assert sum(run.repeats for run in runs) <= 1.01 * lengths.sum() / 1024 + 1


def test_empty_tables(make_docs):
    docs = make_docs([])
    assert bpe_codec.digests(bpe_codec.round_trip(docs)).count() == 0
    assert token_counts.token_counts(docs).count() == 0
    assert packing.pack_documents(docs).count() == 0
