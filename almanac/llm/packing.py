"""Best-fit packing of token sequences, certified by lower bounds from dual feasible functions.

Pieces are dealt by hash into partitions of about ``PART_PIECES``. Each partition packs its pieces by
best-fit decreasing and compares its number of bins with the largest bound that dual feasible
functions give for its lengths. A partition that meets its bound is certified: its bins are final, but
for the emptiest, where the rounding of the bound sits. A partition with a gap keeps its full bins and
gives all others up. What was given up is dealt anew into fewer partitions and packed again, until one
partition is left or a round settles too little; a partition never holds more than its share.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow, saved, tokenizer_file

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of a partition; bounds a task's memory.
PART_PIECES = 50_000
#: Rounds of exchange, and the least share of the pieces that a round settles if there is to be another.
ROUNDS, LEAST_SETTLED = 8, 0.1
#: Chunks of text and pre-tokens whose ids a Python worker remembers, and the longest of them.
CACHE_CHUNKS, CACHE_PRE_TOKENS, CACHE_BYTES = 600_000, 300_000, 64

PIECE_SCHEMA = "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, settled boolean, certified boolean"

#: Letters that normalisation and lower case treat alike in any library, and what the vocabulary's
#: pre-tokenizer cuts chunks of them into; other chunks go through the tokenizer whole.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Unseen pre-tokens that are encoded in one call.
JOINED = 500


def _remember(cache: dict, new: dict, most: int) -> None:
    """Adds the short ones to a cache; a full one gives up its older half."""
    new = {key: ids for key, ids in new.items() if len(key) <= CACHE_BYTES}
    if len(cache) + len(new) > most:
        for old in list(itertools.islice(cache, most // 2)):
            del cache[old]
    if len(cache) + len(new) <= most:
        cache.update(new)


class Encoder:
    """Ids of texts as little-endian words. The vocabulary never joins what white space parts, nor what its
    pre-tokenizer parts: chunks between white space are remembered, and the pre-tokens of unseen ones.

    Unseen pre-tokens are encoded many to a call, joined by spaces; each ends with a token that ends a
    word, which tells their ids apart. Chunks that hold special tokens or characters beyond ``PLAIN`` are
    encoded whole, as texts of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[n for t, n in vocabulary.items() if t.endswith(suffix) and t not in special]] = True
        self.by_pre_token = bool(suffix) and _cuts_words(rules["pre_tokenizer"])
        self.chunks: dict[bytes, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _together(self, words: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(words), JOINED):
            part = words[start:start + JOINED]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):  # not one end for each
                out += self._alone(part)
                continue
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *cuts], cuts)]
        return out

    def _unseen(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the chunks."""
        odd, cut, get = [], {}, self.pre_tokens.get
        for chunk in chunks:
            text = chunk.decode()
            if not self.by_pre_token or not PLAIN.fullmatch(text) or self.special.search(text):
                odd.append((chunk, text))
            else:
                cut[chunk] = PRE_TOKEN.findall(text.lower())
        known = {part: get(part) for parts in cut.values() for part in parts}
        new = [part for part, ids in known.items() if ids is None]
        if new:
            found = dict(zip(new, self._together(new)))
            known |= found
            _remember(self.pre_tokens, found, CACHE_PRE_TOKENS)
        out = {chunk: b"".join([known[p] for p in parts]) for chunk, parts in cut.items()}
        if odd:
            out |= zip([c for c, _ in odd], self._alone([t for _, t in odd]))
        return out

    def __call__(self, text: bytes) -> bytes:
        chunks = text.split()
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            found = self._unseen(list({c for c, i in zip(chunks, ids) if i is None}))
            ids = [found[c] if i is None else i for c, i in zip(chunks, ids)]
            _remember(self.chunks, found, CACHE_CHUNKS)
        return b"".join(ids)


def _cuts_words(rules: dict | None) -> bool:
    """Whether a pre-tokenizer cuts as ``PRE_TOKEN`` does, for plain chunks: the public vocabulary's pattern."""
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return any(r.get("pattern") == {"Regex": pattern} for r in (rules or {}).get("pretokenizers", []))


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batch: pa.RecordBatch, path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path)
    end = int(end_id).to_bytes(4, "little")
    out: list[list] = [[] for _ in range(6 + with_ids)]
    texts = batch.column(2).cast(pa.binary()).to_pylist()
    for doc_id, row_no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
        ids = encode(text or b"") + end
        for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[start:start + 4 * capacity]
            row = [doc_id, row_no, piece, start // 4, len(part) // 4, zlib.crc32(part)]
            for column, value in zip(out, row + [np.frombuffer(part, "<u4").astype("i4").tolist()] * with_ids):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "row_no", "piece", "start", "length", "ids_crc32", "ids"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names[:len(out)])


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each row: its text's ids (null: empty text), then ``end_id``.

    Only longer documents are cut. ``row_no`` tells rows with equal or null doc_id apart. ``with_ids``
    adds the ids themselves.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"),
                       F.col(text).cast("string").alias("text"))
    work = partial(_pieces, path=vocabulary or tokenizer_file(VOCABULARY), end_id=end_id, capacity=capacity,
                   with_ids=with_ids)
    return map_arrow(rows, work, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""), "text")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that the lengths can need, by two families of dual feasible functions.

    Each function maps shares of a bin so that what fits one bin still sums to at most one; the sum over
    all pieces, rounded up, is a bound. Whole numbers throughout.
    """
    return bound_of_counts(*np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True), capacity)


def bound_of_counts(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of lengths given as different sizes, in rising order, and how often each occurs."""
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for cut in sizes[sizes <= capacity // 2]:  # below the cut nothing, above its complement a whole bin
        share = np.where(sizes > capacity - cut, capacity, np.where(sizes >= cut, sizes, 0))
        best = max(best, -(-int((share * counts).sum()) // capacity))
    best = max(best, int(counts[2 * sizes > capacity].sum()))
    for k in range(1, 33):  # shares rounded down to multiples of 1 / (k + 1), counted as 1 / k
        times = (k + 1) * sizes
        share = np.where(times % capacity == 0, k * sizes, times // capacity * capacity)
        best = max(best, -(-int((share * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, the lengths sorted from long to short."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with room r is open
    n = 0
    for i, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if length and fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own, n = capacity, n, n + 1
        bins[i], offsets[i] = own, capacity - room
        room -= length
        if room:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins, offsets


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, turn: int, last: bool) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).sort_by([("length", "descending"), ("row_no", "ascending"), ("piece", "ascending")])
    lengths = rows.column("length").to_numpy()
    bins, offsets = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    certified = len(fill) == lower_bound(lengths, capacity)
    settled = np.ones(len(fill), bool) if certified or last else fill == capacity
    if not last:
        settled[np.argmin(fill)] = fill.min() == capacity
    place = (turn << 56) | (TaskContext.get().partitionId() << 30)
    extra = {"sequence_id": place + bins, "offset": offsets, "settled": settled[bins],
             "certified": np.full(len(bins), certified)}
    for name, values in extra.items():
        rows = rows.append_column(name, pa.array(values))
    yield from rows.combine_chunks().to_batches()


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS,
         least_settled: float = LEAST_SETTLED) -> DataFrame:
    """Adds sequence_id and offset to each piece, every sequence at most ``capacity`` long and gapless.

    ``certified`` tells whether the partition of the piece met its lower bound. What is given up is packed
    again in at most ``rounds`` rounds, and as it lies after a round that settles less than the share
    ``least_settled``; ``surplus`` tells what that costs. Pieces longer than a sequence are an error of the
    caller. An empty table gives an empty result.
    """
    names = [n.split()[0] for n in PIECE_SCHEMA.split(", ")]
    full = pieces.where(F.col("length") >= capacity).select(
        *names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest, done, turn = pieces.where(F.col("length") < capacity).select(*names), [full], 0
    n = rest.count()
    while n:
        parts, last = math.ceil(n / part_pieces), n <= part_pieces or turn >= rounds
        dealt = rest.repartition(parts, F.xxhash64("row_no", "piece", F.lit(turn)))
        placed = saved(dealt.mapInArrow(partial(_pack, capacity=capacity, turn=turn, last=last), PLACED_SCHEMA), "packed")
        done.append(placed.where("settled").drop("settled"))
        if last:
            break
        rest, turn, before = placed.where("not settled").select(*names), turn + 1, n
        n = rest.count()
        if n > (1 - least_settled) * before:
            turn = max(turn, rounds)  # this round settled too little: the next one settles all
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def surplus(placed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a result, and how many of them are above the lower bound for all its pieces together.
    There is one row for each different length, at most ``capacity``, at the driver."""
    used = placed.select("sequence_id").distinct().count()
    held = sorted(tuple(r) for r in placed.groupBy("length").count().collect())
    sizes, counts = np.array(held, dtype=np.int64).reshape(-1, 2).T
    return used, used - bound_of_counts(sizes, counts, capacity)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of all documents and their places in sequences; every text is tokenised once."""
    return pack(saved(token_pieces(docs, doc_id, text, vocabulary, capacity, end_id), "pieces"), capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The sequences themselves (sequence_id, ids), from pieces made ``with_ids`` and their places."""
    joined = pieces.select("row_no", "piece", "ids").join(placed.select("row_no", "piece", "sequence_id", "offset"),
                                                          ["row_no", "piece"])
    lists = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return lists.select("sequence_id", F.flatten("parts.ids").alias("ids"))
