"""SentencePiece encoding with the N best segmentations, and decoding.

A text with a space put before it is cut where no piece of the vocabulary can reach across: before the
first space of a run, and around characters that no piece holds. Each stretch is a small lattice of
pieces. Forward Viterbi scores of its places are exact heuristics for an A-star search from its end
backwards, which finds the best segmentations one after the other. The N best of the whole text differ
from its best in the N - 1 stretches with the smallest loss at most, so only these are searched.

Scores are those of the vocabulary; characters without a piece fall back to their bytes, at a loss
below every piece's score.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow, tokenizer_file

VOCABULARY = "piece_bpe_32k.model"
N_BEST = 4
#: Stretches whose best segmentation a Python worker remembers, and the longest of them in characters.
CACHE_STRETCHES, CACHE_CHARS = 800_000, 40
BYTE_LOSS = 10.0

_SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, n_best long, best_scores array<double>, best_crc32 array<long>"


@dataclass
class Vocabulary:
    """Pieces with spaces written as spaces; ``bytes_of`` gives each id's bytes for decoding."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    byte_score: float
    bytes_of: list[bytes]
    longest: int
    cut: re.Pattern
    #: Pieces by their characters, a level each; "" leads to a piece's (packed id, score).
    trie: dict
    best: dict = field(default_factory=dict)
    searched: dict = field(default_factory=dict)


def _packed(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def make_vocabulary(pieces: list[tuple[str, int, float]], byte_ids: list[int], size: int) -> Vocabulary:
    """From (piece with spaces, id, score), the ids of the 256 bytes, and the number of ids."""
    if any(" " in p.lstrip(" ") for p, _, _ in pieces):
        raise ValueError("a piece holds a space after another character; texts can't be cut before spaces")
    bytes_of = [b""] * size
    for piece, number, _ in pieces:
        bytes_of[number] = piece.encode()
    for value, number in enumerate(byte_ids):
        bytes_of[number] = bytes([value])
    known = "".join(sorted({c for p, _, _ in pieces for c in p} - {" "}))
    cut = re.compile(f" +[{re.escape(known)}]*|[{re.escape(known)}]+|[^ ]")
    lowest = min((s for _, _, s in pieces if s > -1e8), default=0.0)
    trie: dict = {}
    for piece, number, score in pieces:
        node = trie
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = (_packed((number,)), score)
    longest = max(len(p) for p, _, _ in pieces)
    return Vocabulary({p: (n, s) for p, n, s in pieces}, byte_ids, lowest - BYTE_LOSS, bytes_of, longest, cut, trie)


@lru_cache(2)
def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    pieces = [(model.id_to_piece(n).replace("▁", " "), n, model.get_score(n)) for n in range(size)
              if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))]
    byte_ids = [model.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
    return make_vocabulary(pieces, byte_ids, size)


def _forward(v: Vocabulary, stretch: str) -> list[float]:
    """The Viterbi score of each place: that of the best way from the start to it."""
    size, low = len(stretch), float("-inf")
    scores = [0.0] + [low] * size
    for i in range(size):
        own, node, j = scores[i], v.trie, i
        if stretch[i] not in v.pieces:
            scores[i + 1] = max(scores[i + 1], own + v.byte_score * len(stretch[i].encode("utf-8", "replace")))
        for c in stretch[i:i + v.longest]:
            node = node.get(c)
            if node is None:
                break
            j += 1
            piece = node.get("")
            if piece and own + piece[1] > scores[j]:
                scores[j] = own + piece[1]
    return scores


def _ways(v: Vocabulary, stretch: str, forward: list[float], at: int, behind: float) -> list[tuple]:
    """The pieces that end at a place, those on the best ways first: (bound, start, ids, score)."""
    out = []
    for i in range(max(0, at - v.longest), at):
        found = v.pieces.get(stretch[i:at])
        if found:
            out.append((-(forward[i] + found[1] + behind), i, (found[0],), found[1]))
        elif i == at - 1:
            data = stretch[i].encode("utf-8", "replace")
            s = v.byte_score * len(data)
            out.append((-(forward[i] + s + behind), i, tuple(v.byte_ids[b] for b in data), s))
    return sorted(out)


def segmentations(v: Vocabulary, stretch: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best (score, ids) of a stretch, by backward A-star; of equal bounds the way that has come
    nearest the start goes first.

    An entry of the queue is a way from some place to the end: its first piece and a link to the entry
    behind it. Only the best way on is queued when an entry is taken, and with it the next best beside
    the entry itself, so that the queue holds at most two entries for each one taken.
    """
    forward = _forward(v, stretch)
    heap, found, number = [(-forward[-1], len(stretch), 0, 0.0, None, (), None, 0)], [], 0
    while heap and len(found) < n:
        entry = heapq.heappop(heap)
        total, at, _, behind, link, ids, past, rank = entry
        if link is not None:  # the next best piece before the same place
            ways = _ways(v, stretch, forward, past, link[3])
            if rank + 1 < len(ways):
                bound, start, own, s = ways[rank + 1]
                number += 1
                heapq.heappush(heap, (bound, start, number, s + link[3], link, own, past, rank + 1))
        if at:
            bound, start, own, s = _ways(v, stretch, forward, at, behind)[0]
            number += 1
            heapq.heappush(heap, (bound, start, number, s + behind, entry, own, at, 0))
            continue
        parts = []
        while entry is not None:
            parts.extend(entry[5])
            entry = entry[4]
        found.append((-total, tuple(parts)))
    return found


def _best(v: Vocabulary, stretch: str) -> tuple[float, bytes, float]:
    """Score and ids of the best segmentation, and what the second best loses (infinite if there is none).

    One forward pass with the two best scores of each place; of equal ways into a place the one from
    nearest the start is kept, as in the search from the end.
    """
    known = v.best.get(stretch)
    if known:
        return known
    size, low = len(stretch), float("-inf")
    first, second, into = [0.0] + [low] * size, [low] * (size + 1), [None] * (size + 1)
    trie, pieces, longest = v.trie, v.pieces, v.longest
    for i in range(size):
        best, next_best, node, j = first[i], second[i], trie, i
        if stretch[i] not in pieces:
            data = stretch[i].encode("utf-8", "replace")
            ids = _packed(tuple(v.byte_ids[b] for b in data))
            node = {stretch[i]: {**trie.get(stretch[i], {}), "": (ids, v.byte_score * len(data))}}
        for c in stretch[i:i + longest]:
            node = node.get(c)
            if node is None:
                break
            j += 1
            if "" not in node:
                continue
            edge, s = node[""]
            score, held = best + s, first[j]
            if score > held:
                other = next_best + s
                second[j] = held if held > other else other
                first[j] = score
                into[j] = i, edge
            elif score > second[j]:
                second[j] = score
    at, parts = size, []
    while at:
        at, edge = into[at]
        parts.append(edge)
    parts.reverse()
    out = first[-1], b"".join(parts), first[-1] - second[-1]
    if len(v.best) < CACHE_STRETCHES and size <= CACHE_CHARS:
        v.best[stretch] = out
    return out


def _alternatives(v: Vocabulary, stretch: str, n: int) -> list[tuple[float, bytes]]:
    """The best segmentations as (loss, ids), the first without loss."""
    key = (stretch, n)
    if key not in v.searched:
        if len(v.searched) >= 20_000:
            v.searched.clear()
        own = segmentations(v, stretch, n)
        v.searched[key] = [(own[0][0] - score, _packed(ids)) for score, ids in own]
    return v.searched[key]


def encode_n_best(v: Vocabulary, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
    """The ``n`` best (score, ids as little-endian words) of a text, best first; ties go to the change
    nearest the start."""
    stretches = v.cut.findall(" " + text) if text else []
    known = [v.best.get(s) or _best(v, s) for s in stretches]
    ids = [k[1] for k in known]
    total = sum([k[0] for k in known])
    found = [(total, b"".join(ids))]
    if n < 2 or not known:
        return found
    losses = np.array([k[2] for k in known])
    if len(losses) >= n:
        limit = np.partition(losses, n - 2)[n - 2]
        places = np.concatenate([np.flatnonzero(losses < limit), np.flatnonzero(losses == limit)])[:n - 1]
    else:
        places = np.arange(len(losses))
    places = sorted(int(p) for p in places if np.isfinite(losses[p]))
    choices = [_alternatives(v, stretches[p], n) for p in places]
    heap, seen = [(0.0, (0,) * len(places))], {(0,) * len(places)}
    found = []
    while heap and len(found) < n:
        loss, picks = heapq.heappop(heap)
        for place, own, pick in zip(places, choices, picks):
            ids[place] = own[pick][1]
        found.append((total - loss, b"".join(ids)))
        for k, own in enumerate(choices):
            step = picks[:k] + (picks[k] + 1,) + picks[k + 1:]
            if step[k] < len(own) and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (sum(c[p][0] for c, p in zip(choices, step)), step))
    return found


def decode(v: Vocabulary, ids: bytes) -> str:
    """The text of ids as little-endian words; ids of no piece or byte give nothing."""
    data = b"".join(map(v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return data.decode("utf-8", "replace")[1:]


def _encode(batch: pa.RecordBatch, path: str, n: int) -> Iterator[pa.RecordBatch]:
    v = load_vocabulary(path)
    out: list[list] = [[] for _ in range(6)]
    for text in batch.column(1).to_pylist():
        found = encode_n_best(v, text or "", n)
        best = found[0][1]
        crcs = [zlib.crc32(ids) for _, ids in found]
        row = (len(best) // 4, crcs[0], decode(v, best) == (text or ""), len(found), [s for s, _ in found], crcs)
        for column, value in zip(out, row):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                     names=[part.split()[0] for part in _SCHEMA.split(", ")])


def _ids(batch: pa.RecordBatch, path: str, n: int) -> Iterator[pa.RecordBatch]:
    v, which, ranks, scores, ids = load_vocabulary(path), [], [], [], []
    for row, text in enumerate(batch.column(1).to_pylist()):
        for rank, (score, own) in enumerate(encode_n_best(v, text or "", n)):
            which.append(row)
            ranks.append(rank)
            scores.append(score)
            ids.append(np.frombuffer(own, "<i4"))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(which, pa.int64())), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()),
         pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "rank", "score", "ids"])


def _decoded(batch: pa.RecordBatch, path: str) -> Iterator[pa.RecordBatch]:
    v = load_vocabulary(path)
    texts = [None if ids is None else decode(v, _packed(tuple(ids))) for ids in batch.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def summaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, n: int = N_BEST) -> DataFrame:
    """One row per row of ``docs``: size and checksum of the best ids, whether they decode to the text,
    and scores and checksums of the ``n`` best. Null counts as empty: one segmentation of no pieces."""
    return map_arrow(_rows(docs, doc_id, text), partial(_encode, path=vocabulary or tokenizer_file(VOCABULARY), n=n), _SCHEMA, "text")


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, n: int = N_BEST) -> DataFrame:
    """(doc_id, rank, score, ids) of the ``n`` best segmentations of each row."""
    return map_arrow(_rows(docs, doc_id, text), partial(_ids, path=vocabulary or tokenizer_file(VOCABULARY), n=n),
                     "doc_id long, rank int, score double, ids array<int>", "text")


def decode_documents(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return map_arrow(rows, partial(_decoded, path=vocabulary or tokenizer_file(VOCABULARY)), "doc_id long, text string")
