"""Words, landed tables and Arrow helpers that the document operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.session import land  # noqa: F401  (the operators' landed tables)

#: Bytes that part words: ``[\x20\x09-\x0D]``. ``bytes.split()`` and ``bytes.lower()`` follow the same rule.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch: whole texts are long, and a batch lies in memory on both sides.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to BATCH_ROWS rows if they are larger."""
    settings = df.sparkSession.conf
    if not 0 < int(settings.get(_BATCH_SETTING, "10000")) <= BATCH_ROWS:
        settings.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``divisor`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % divisor


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column (in any case) is named so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def raw(column: pa.Array) -> list[bytes | None]:
    """Strings as their UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """All words of ``data`` in order, in lists from about ``size`` bytes each, so that one long text stays bounded."""
    start, end = 0, len(data)
    while end - start > size:
        cut = start + size
        while cut < end and data[cut] not in SPACES:
            cut += 1
        yield data[start:cut].split()
        start = cut
    yield data[start:].split()
