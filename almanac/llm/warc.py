"""WARC records and a fixity audit of their replicas by Merkle trees.

A record's digest is a leaf. The records that start in one range of ``RANGE_BYTES`` of a file, in order
of their offsets, make a range node; ``FANOUT`` neighbouring nodes make the next one, up to the file's
root, and roots of files are joined in the same way up to one root. Two replicas whose roots differ are
compared level by level, each time only below nodes that differ, until the records are found. There
records are matched by their digests, then by their record ids, and only then by their offsets, so that a
record cut or gone, which moves all that follows it in its file, is one finding.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow, saved

FILE_BYTES = 64 << 20
RANGE_BYTES = 256 << 10
FANOUT_BITS = 8
FANOUT = 1 << FANOUT_BITS
#: Levels above a task's files; FANOUT ** TASK_LEVELS tasks share one root.
TASK_LEVELS = 2
#: Bits of a file number that count a task's files; the rest is the task.
FILE_BITS = 20
DATE = "2024-01-01T00:00:00Z"

_START = re.compile(rb"WARC/\d\.\d\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)
_ADDRESS = re.compile(rb"\r\nwarc-target-uri:[ \t]*([^\r\n]*)", re.I)
#: A header is looked for in so many bytes.
HEADER_BYTES = 64 << 10
#: Parsed bytes that are handed on at once; a longer record goes alone.
BATCH_BYTES = 4 << 20

_RECORDS = "page_id long, url string, file long, offset long, record binary"


def warc_record(url: str | None, body: bytes, date: str = DATE) -> bytes:
    """One resource record; line ends in the address can't break the header."""
    address = " ".join((url or "").split())
    name = hashlib.md5(address.encode() + b"\n" + body).hexdigest()
    uid = "-".join((name[:8], name[8:12], name[12:16], name[16:20], name[20:]))
    head = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Date: {date}\r\n"
            f"WARC-Target-URI: {address}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return head.encode() + body + b"\r\n\r\n"


def _record_end(content: bytes, at: int) -> int | None:
    """End of the record that starts at ``at``, if it is whole."""
    if not _START.match(content, at):
        return None
    end = content.find(b"\r\n\r\n", at)
    length = _LENGTH.search(content, at, end + 2) if end >= 0 else None
    stop = end + 4 + int(length[1]) + 4 if length else len(content) + 1
    return stop if stop <= len(content) and content.startswith(b"\r\n\r\n", stop - 4) else None


def pieces(content: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes, intact) of all of a file: records by their Content-Length, and damaged ranges, which
    reach to the next start of a record."""
    at = 0
    while at < len(content):
        stop = _record_end(content, at)
        intact = stop is not None
        if not intact:
            after = _START.search(content, at + 1)
            stop = after.start() if after else len(content)
        yield at, content[at:stop], intact
        at = stop


def split_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the intact records of a file, also of those behind damaged ones."""
    return ((at, record) for at, record, intact in pieces(content) if intact)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, offset = TaskContext.get().partitionId() << FILE_BITS, 0
    for batch in batches:
        files, offsets, records = [], [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            record = warc_record(url, html or b"")
            if offset and offset + len(record) > FILE_BYTES:
                file, offset = file + 1, 0
            files.append(file)
            offsets.append(offset)
            records.append(record)
            offset += len(record)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files, pa.int64()), pa.array(offsets, pa.int64()),
                                          pa.array(records, pa.binary())], names=["page_id", "url", "file", "offset", "record"])


def to_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as WARC records with their file and offset. A task fills files of its own one after the
    other, so files are even whatever the keys. Null pages are empty ones; other columns are not read."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_laid_out, _RECORDS)


_MEMBER = b"\x1f\x8b\x08"
_STEP = 1 << 16


def _inflated(content: memoryview, start: int) -> tuple[int, bytes] | None:
    """End and contents of the compressed member at ``start``; None if it is damaged or cut off."""
    state, at, parts = zlib.decompressobj(31), start, []
    try:
        while not state.eof and at < len(content):
            parts.append(state.decompress(content[at:at + _STEP]))
            at += _STEP
    except zlib.error:
        return None
    return (min(at, len(content)) - len(state.unused_data), b"".join(parts)) if state.eof else None


def members(content: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, contents, intact) of the members of a compressed file; what lies between two members that
    can be read is one damaged range, as it stands."""
    view, at, bad = memoryview(content), 0, None
    while (start := content.find(_MEMBER, at)) >= 0:
        if bad is None and start > at:
            bad = at
        found = _inflated(view, start)
        if found is None:
            bad, at = start if bad is None else bad, start + 1
            continue
        if bad is not None:
            yield bad, bytes(view[bad:start]), False
            bad = None
        yield start, found[1], True
        at = found[0]
    if bad is not None or at < len(content):
        yield (at if bad is None else bad), bytes(view[at if bad is None else bad:]), False


def _records_of(content: bytes) -> Iterator[tuple[int, bytes, bool]]:
    if not content.startswith(_MEMBER[:2]):
        yield from pieces(content)
        return
    for offset, data, intact in members(content):
        if intact:
            yield from ((offset, record, whole) for _, record, whole in pieces(data))
        else:
            yield offset, data, False


def parse_files(files: DataFrame) -> DataFrame:
    """(path, offset, record, intact) of WARC files given as (path, content), for example by Spark's
    binaryFile source; a damaged range is a row that isn't intact. Compressed files are read member by member;
    a record's offset is then that of its member. Null and empty files give no rows."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held, size = [], 0
            for found in _records_of(content or b""):
                held.append(found)
                size += len(found[1])
                if size > BATCH_BYTES:
                    yield rows(path, held)
                    held, size = [], 0
            if held:
                yield rows(path, held)

    def rows(path: str, held: list) -> pa.RecordBatch:
        offsets, records, intact = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(offsets, pa.int64()), pa.array(records, pa.binary()),
                                           pa.array(intact, pa.bool_())], names=["path", "offset", "record", "intact"])

    return map_arrow(files.select("path", "content"), work, "path string, offset long, record binary, intact boolean", "content")


def _parsed(file: int, content: bytes) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        n = len(held)
        urls = [m[1].decode("utf-8", "replace") if (m := _ADDRESS.search(r, 0, HEADER_BYTES)) else None for _, r in held]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(urls, pa.string()), pa.array([file] * n, pa.int64()), pa.array([o for o, _ in held], pa.int64()),
             pa.array([r for _, r in held], pa.binary())], names=["page_id", "url", "file", "offset", "record"])

    held, size = [], 0
    for offset, record, _ in pieces(content):
        if held and size + len(record) > BATCH_BYTES:
            yield batch()
            held, size = [], 0
        held.append((offset, record))
        size += len(record)
    if held:
        yield batch()


def _read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, content = None, bytearray()
    for batch in batches:
        for own, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != file:
                yield from _parsed(file, bytes(content))
                file, content = own, bytearray()
            content += record or b""
    yield from _parsed(file, bytes(content))


def read_back(records: DataFrame) -> DataFrame:
    """What a reader finds in the files of a replica: the bytes of each file laid end to end in order of
    their old offsets, and parsed again. Records stand where they are now, damaged ranges are rows of
    their own; addresses come from the records, and page ids, which no record holds, are null.

    A task holds one file of about ``FILE_BYTES`` at a time; there is a partition for each.
    """
    size = records.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))
    rows = records.select("file", "record", "offset").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read_again, _RECORDS)


def leaves(records: DataFrame, keep: list[str]) -> DataFrame:
    """(file, range, offset, length, sha256, record_id) of each record, and the columns ``keep``."""
    head = F.decode(F.substring("record", 1, HEADER_BYTES), "ISO-8859-1")
    return records.select(*keep, "file", F.shiftright("offset", RANGE_BYTES.bit_length() - 1).alias("range"), "offset",
                          F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"),
                          F.regexp_extract(head, r"(?i)^WARC/[^\n]*\n(?:[^\r\n]+\r\n)*?WARC-Record-ID:\s*([^\s]+)", 1).alias("record_id"))


def _node_hash(*parts: str) -> Column:
    return F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*parts)))), 256).alias("hash")


def tree(leaf: DataFrame) -> list[tuple[DataFrame, int, int]]:
    """Levels of (file, node, hash) from ranges up to one root; each with the bits by which a node and a
    file are shifted to their parent's. Only a node's few children meet in one row; every level is stored,
    so that each is made once, from the one below."""
    nodes = saved(leaf.groupBy("file", F.col("range").alias("node")).agg(_node_hash("offset", "length", "sha256")), "ranges")
    levels, span = [], max(1, FILE_BYTES // RANGE_BYTES)
    while span > 1:  # inside files
        levels.append((nodes, FANOUT_BITS, 0))
        nodes = saved(nodes.groupBy("file", F.shiftright("node", FANOUT_BITS).alias("node")).agg(_node_hash("node", "hash")), "level")
        span = -(-span // FANOUT)
    for bits in [FILE_BITS] + [FANOUT_BITS] * TASK_LEVELS:  # files of a task, then groups of tasks
        levels.append((nodes, 0, bits))
        nodes = saved(nodes.groupBy(F.shiftright("file", bits).alias("file"), "node").agg(_node_hash("file", "hash")), "level")
    return [*levels, (nodes, 0, 0)]


def differing(first: list, second: list) -> DataFrame:
    """(file, node) of the ranges that differ, found from the root down below nodes that differ."""
    wrong = None
    for (a, node_bits, file_bits), (b, _, _) in zip(reversed(first), reversed(second)):
        sides = []
        for n, nodes in enumerate((a, b)):
            nodes = nodes.select("file", "node", F.col("hash").alias(f"hash_{n}"))
            if wrong is not None:
                up = (F.shiftright("file", file_bits) == F.col("_file")) & (F.shiftright("node", node_bits) == F.col("_node"))
                nodes = nodes.join(wrong, up, "left_semi")
            sides.append(nodes)
        both = sides[0].join(sides[1], ["file", "node"], "full").where(~F.col("hash_0").eqNullSafe(F.col("hash_1")))
        wrong = saved(both.select(F.col("file").alias("_file"), F.col("node").alias("_node")), "differ")
    return wrong


def _matched(sides: list[DataFrame], by: list[str], keep: list[str]) -> DataFrame:
    """The sides (columns with _0 and _1) joined in full by ``by``, equals in order of their offsets."""
    found = []
    for n, side in enumerate(sides):
        side = side.withColumn("same", F.row_number().over(Window.partitionBy(*by).orderBy("offset", "sha256")))
        found.append(side.select(*by, "same", *[F.col(c).alias(f"{c}_{n}") for c in keep if c not in by]))
    return found[0].join(found[1], [*by, "same"], "full")


def _left(pairs: DataFrame, n: int, by: list[str], columns: list[str]) -> DataFrame:
    """Rows of side ``n`` that found no partner."""
    return pairs.where(F.col(f"length_{1 - n}").isNull()).select(*[F.col(c if c in by else f"{c}_{n}").alias(c) for c in columns])


def audit(first: DataFrame, second: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Records in which the replica ``second`` differs from ``first``: file, offset (in ``first``, of extra
    records in ``second``), both digests, status (altered, truncated or extended by their lengths, missing,
    extra) and ``keep`` of either side.

    Records of a file are matched by digest, then by record id, then by offset; a record that has only
    moved in its file is no difference. Equal replicas, empty ones too, give no rows. ``keep`` may be named
    like anything but the columns of the result.
    """
    clash = set(keep) & {"file", "offset", "status", "sha256_first", "sha256_second"}
    if clash:
        raise ValueError(f"columns of the result can't be kept beside them: {sorted(clash)}")
    names, keep = keep, [f"_keep_{n}" for n in range(len(keep))]
    own = [saved(leaves(side.select(*[F.col(c).alias(k) for c, k in zip(names, keep)], "file", "offset", "record"), keep), "leaves")
           for side in (first, second)]
    wrong = differing(*[tree(side) for side in own])
    columns = [*dict.fromkeys([*keep, "file", "offset", "length", "sha256", "record_id"])]
    sides = [side.join(wrong, (side["file"] == wrong["_file"]) & (side["range"] == wrong["_node"]), "left_semi").select(columns) for side in own]
    # digests that a file holds as often in both replicas are done with; counts are partial before their shuffle
    each = [side.select("file", "sha256", F.lit(1 - 2 * n).alias("d")) for n, side in enumerate(sides)]
    uneven = saved(each[0].unionByName(each[1]).groupBy("file", "sha256").agg(F.sum("d").alias("d")).where("d <> 0").drop("d"), "uneven")
    by = ["file", "sha256"]
    pairs = _matched([side.join(uneven, by, "left_semi") for side in sides], by, columns)
    rest = saved(_left(pairs, 0, by, columns).withColumn("side", F.lit(0)).unionByName(
        _left(pairs, 1, by, columns).withColumn("side", F.lit(1))), "rest")
    named = rest.where("record_id <> ''")
    by_id = saved(_matched([named.where(F.col("side") == n) for n in (0, 1)], ["file", "record_id"], columns), "by-id")
    ends = [_left(by_id, n, ["file", "record_id"], columns).unionByName(
        rest.where((F.col("record_id") == "") & (F.col("side") == n)).select(columns)) for n in (0, 1)]
    by_place = _matched(ends, ["file", "offset"], columns)
    both = [F.col(f"{c}_{n}") for n in (0, 1) for c in columns if c not in ("file", "offset", "record_id")]
    rows = by_id.where("length_0 is not null and length_1 is not null").select("file", F.col("offset_0").alias("offset"), *both).unionByName(
        by_place.select("file", "offset", *both))
    status = (F.when(F.col("sha256_1").isNull(), "missing").when(F.col("sha256_0").isNull(), "extra")
              .when(F.col("length_1") < F.col("length_0"), "truncated").when(F.col("length_1") > F.col("length_0"), "extended")
              .otherwise("altered"))
    return rows.select(*[F.coalesce(f"{c}_0", f"{c}_1").alias(name) for c, name in zip(keep, names)], "file", "offset", status.alias("status"),
                       F.col("sha256_0").alias("sha256_first"), F.col("sha256_1").alias("sha256_second"))


def damaged_copy(records: DataFrame) -> DataFrame:
    """Records of a second replica for the query, for ``read_back`` to lay out: of about 256 records each, one has a byte changed, one is cut by
    ten bytes, one is gone. Which ones is told by the MD5 of the page's id."""
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    size = F.octet_length("record")
    changed = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit("#").cast("binary"),
                       F.expr("substring(record, octet_length(record) - 3, 4)"))
    record = F.when(mark == "00", changed).when(mark == "01", F.expr("substring(record, 1, octet_length(record) - 10)")).otherwise(F.col("record"))
    return records.where((mark != "02") & (size > 0)).select("page_id", "url", "file", "offset", record.alias("record"))
