"""Helpers shared by the operators on training documents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import shared_folder

#: Words are runs of anything but ASCII white space; Python's ``bytes.split()`` cuts at the same bytes.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Text that a Python task works on at once; bounds its memory whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{folder}/almanac-llm-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors.

    Every call takes a folder of its own; ``drop_scratch`` removes all of an application's folders.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Removes what ``saved`` wrote in this application; call it when its results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(text.cast("string"), F.lit(""))


def in_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``SLICE_BYTES`` of ``column``; a longer row stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        start = held = 0
        for row, size in enumerate(sizes.to_pylist()):
            if held and held + (size or 0) > SLICE_BYTES:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _mapped(batches, work, column, schema):
    for piece in in_slices(batches, column) if column else batches:
        for out in work(piece):
            if out.num_rows:
                yield out


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str,
              text: str | None = None) -> DataFrame:
    """``mapInArrow`` over slices of bounded text; ``work`` gets a slice and yields record batches."""
    return df.mapInArrow(partial(_mapped, work=work, column=text, schema=schema), schema)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; the folder is a parameter, else the installed package's."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
