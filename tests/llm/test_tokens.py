"""Packing and the piece lattice against plain tokenizers and enumeration."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from almanac.llm import packing, piece_lattice
from almanac.llm.common import saved, tokenizer_file


def ids_of(rows):
    tokenizer = Tokenizer.from_file(tokenizer_file(packing.VOCABULARY))
    return [np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows]


@pytest.mark.parametrize("capacity,part", [(4096, 50_000), (64, 20)])
def test_packing(docs, rows, capacity, part):
    want = [(r[0], n, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()))
            for r, ids in zip(rows, ids_of(rows)) for n, s in enumerate(range(0, len(ids), capacity))]
    pieces = saved(packing.token_pieces(docs, capacity=capacity), "pieces")
    placed = packing.pack(pieces, capacity, part).collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in placed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    bound = packing.lower_bound(np.array([r["length"] for r in placed]), capacity)
    assert packing.surplus(packing.pack(pieces, capacity, part), capacity)[1] <= bound * 0.05 + 1
    assert packing.surplus(packing.pack(pieces, capacity, part, rounds=0), capacity)[1] >= 0
    assert bound <= len(bins) <= bound * 1.05 + 1


def test_sequences_hold_the_ids(docs, rows):
    pieces = saved(packing.token_pieces(docs, with_ids=True), "pieces")
    placed = packing.pack(pieces.drop("ids"))
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, placed).collect()}
    for r in placed.collect():
        part = np.array(joined[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]


def test_bounds_never_exceed_a_packing():
    draw = random.Random(5)
    for _ in range(300):
        capacity = draw.choice([10, 64, 100])
        lengths = np.array(sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 40))), reverse=True))
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        assert packing.lower_bound(lengths, capacity) <= bins.max() + 1
        assert (offsets + lengths <= capacity).all()
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # by more than the sum


def test_packing_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0 and packing.surplus(packing.pack_documents(nothing)) == (0, 0)


def toy():
    pieces = [(p, n, s) for n, (p, s) in enumerate([(" ", -6.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), (" a", -4.0), (" ab", -7.0), ("ba", -5.0), ("  ", -9.0)])]
    return piece_lattice.make_vocabulary(pieces, list(range(8, 264)), 264)


def every(v, text):
    full, out = " " + text if text else "", []

    def go(at, score, ids):
        if at == len(full):
            out.append((score, ids))
            return
        for to in range(at + 1, len(full) + 1):
            known = v.pieces.get(full[at:to])
            if known:
                go(to, score + known[1], ids + (known[0],))
            elif to == at + 1:
                data = full[at].encode()
                go(to, score + v.byte_score * len(data), ids + tuple(v.byte_ids[b] for b in data))

    go(0, 0.0, ())
    return sorted((s for s, _ in out), reverse=True), {ids for _, ids in out}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_against_enumeration(n):
    draw = random.Random(n)
    for v in (toy(), piece_lattice.load_vocabulary(tokenizer_file(piece_lattice.VOCABULARY))):
        for _ in range(150):
            text = "".join(draw.choice("abab  the\né▁") for _ in range(draw.randint(0, 8)))
            scores, valid = every(v, text)
            got = piece_lattice.encode_n_best(v, text, n)
            assert [s for s, _ in got] == scores[:n]
            assert len({ids for _, ids in got}) == len(got)
            for _, ids in got:
                assert tuple(np.frombuffer(ids, "<u4").tolist()) in valid
                assert piece_lattice.decode(v, ids) == text


def test_encoding_and_decoding_tables(docs, rows, nothing):
    summary = piece_lattice.summaries(docs).collect()
    assert len(summary) == len(rows) and all(r["round_trip"] for r in summary)
    encoded = piece_lattice.encode_documents(docs, n=2)
    first = piece_lattice.decode_documents(encoded.where("rank = 0"))
    assert sorted(((r[0], r[1]) for r in first.collect()), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert piece_lattice.summaries(nothing).count() == 0


def test_encoder_gives_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(packing, "CACHE_PRE_TOKENS", 40)
    monkeypatch.setattr(packing, "JOINED", 7)
    path = tokenizer_file(packing.VOCABULARY)
    tokenizer, encode, draw = Tokenizer.from_file(path), packing.Encoder(path), random.Random(8)
    signs = "abcsdtrevml''''***  .,!-1290éßÄÜœŒſİıǅςΣσ́ \u0085 Ა一二中<|>\t\n\x1c\x00\x7f½²٣ª×÷"
    assert encode.by_pre_token
    for _ in range(3000):
        text = "".join(draw.choice(signs) if draw.random() < 0.95 else draw.choice(["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "n't", "x" * 70])
                       for _ in range(draw.randint(0, 40)))
        assert encode(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        assert len(encode.chunks) <= 50 and len(encode.pre_tokens) <= 40


def test_long_stretches_in_bounded_memory():
    v, draw = piece_lattice.load_vocabulary(tokenizer_file(piece_lattice.VOCABULARY)), random.Random(9)
    for text in ("".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEF+/é一") for _ in range(200_000)), "a" * 200_000):
        tracemalloc.start()
        found = piece_lattice.encode_n_best(v, text, 4)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 250e6
        assert len({ids for _, ids in found}) == 4 and all(piece_lattice.decode(v, ids) == text for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
