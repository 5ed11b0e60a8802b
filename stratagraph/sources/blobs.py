"""Out-of-line bytes: a table of chunks beside the records, which keep only a descriptor."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptRecord

CHUNKS = "blob_oid bigint, seq int, start bigint, bytes binary"
CHUNK = 1 << 20


#: Chunks held at once while a blob is written, and read ahead while one is read.
WRITE_CHUNKS, READ_CHUNKS = 32, 8


def _cut(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of parts in chunks; one empty chunk if there are none."""
    pending, some = bytearray(), False
    for part in parts:
        pending += part
        while len(pending) >= CHUNK:
            some = True
            yield bytes(pending[:CHUNK])
            del pending[:CHUNK]
    if pending or not some:
        yield bytes(pending)


class BlobTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, blob_oid: int, size: int, chunks: Callable[[], Iterable[bytes]]) -> dict:
        """Stores a source that can be opened twice: once for its hash, once for its bytes, WRITE_CHUNKS chunks at a time. A size that doesn't hold is an error."""
        digest, n = hashlib.sha256(), 0
        for part in chunks():
            digest.update(part)
            n += len(part)
        if n != size:
            raise ValueError(f"the source has {n} bytes, {size} were declared")
        rows: list[tuple] = []

        def flush() -> None:
            self.spark.createDataFrame(rows, CHUNKS).write.mode("append").parquet(self.path)
            rows.clear()

        for seq, data in enumerate(_cut(chunks())):
            rows.append((blob_oid, seq, seq * CHUNK, data))
            if len(rows) >= WRITE_CHUNKS:
                flush()
        if rows:
            flush()
        return {"blob_oid": blob_oid, "size": size, "sha256": digest.hexdigest()}

    def write_column(self, rows: DataFrame, oid: str, data: str) -> DataFrame:
        """Stores a binary column in chunks; gives (oid, descriptor)."""
        n = F.greatest(F.ceil(F.length(data) / CHUNK), F.lit(1)).cast("int")
        parts = rows.where(F.col(data).isNotNull()).select(F.col(oid).alias("blob_oid"), data, F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
        start = F.col("seq").cast("bigint") * CHUNK
        parts.select("blob_oid", "seq", start.alias("start"), F.substring(F.col(data), (start + 1).cast("int"), F.lit(CHUNK)).alias("bytes")).write.mode("append").parquet(self.path)
        return rows.select(oid, F.when(F.col(data).isNotNull(), F.struct(F.col(oid).alias("blob_oid"), F.length(data).cast("bigint").alias("size"), F.sha2(data, 256).alias("sha256"))).alias("descriptor"))

    def ranges(self, wanted: DataFrame) -> DataFrame:
        """(blob_oid, pos, len, bytes) for each wanted (blob_oid, pos, len): only the chunks that overlap are touched."""
        c = self.spark.read.schema(CHUNKS).parquet(self.path)
        end = F.col("pos") + F.col("len")
        # all chunks but a blob's last have CHUNK bytes, so the places give the numbers of the chunks
        first, last = F.floor(F.greatest("pos", F.lit(0)) / CHUNK), F.floor(F.greatest(end - 1, F.lit(0)) / CHUNK)
        asked = wanted.where("len > 0").select("blob_oid", "pos", "len", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("seq"))
        met = asked.join(c, ["blob_oid", "seq"]).where((F.col("start") < end) & (F.col("start") + F.length("bytes") > F.col("pos")))
        low = F.greatest(F.col("pos") - F.col("start"), F.lit(0))
        part = F.substring(F.col("bytes"), (low + 1).cast("int"), (F.least(end - F.col("start"), F.length("bytes").cast("bigint")) - low).cast("int"))
        joined = met.groupBy("blob_oid", "pos", "len").agg(F.sort_array(F.collect_list(F.struct("seq", part.alias("b")))).alias("p"))
        return joined.select("blob_oid", "pos", "len", F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["b"])).alias("bytes"))

    def open(self, descriptor: dict) -> BlobReader:
        """One blob as a seekable stream that fetches chunks as they are read."""
        return BlobReader(self, descriptor)

    def verified(self, descriptor: dict) -> BlobReader:
        """As open, after one pass over the bytes has held them against the blob's hash."""
        digest, reader = hashlib.sha256(), self.open(descriptor)
        while part := reader.read(READ_CHUNKS * CHUNK):
            digest.update(part)
        if digest.hexdigest() != descriptor["sha256"]:
            raise CorruptRecord(f"blob {descriptor['blob_oid']} doesn't match its hash")
        reader.seek(0)
        return reader


class BlobReader(io.RawIOBase):
    """A read-only stream over the chunks of one blob; READ_CHUNKS of them are at hand."""

    def __init__(self, table: BlobTable, descriptor: dict):
        self.table, self.oid, self.size = table, descriptor["blob_oid"], descriptor["size"]
        self.at, self.held = 0, {}

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        seq, within = divmod(self.at, CHUNK)
        if self.at >= self.size:
            return 0
        if seq not in self.held:
            rows = self.table.spark.read.schema(CHUNKS).parquet(self.table.path)
            rows = rows.where((F.col("blob_oid") == self.oid) & F.col("seq").between(seq, seq + READ_CHUNKS - 1))
            self.held = {r["seq"]: bytes(r["bytes"]) for r in rows.select("seq", "bytes").collect()}
            if seq not in self.held:
                raise CorruptRecord(f"blob {self.oid} lacks chunk {seq}")
        part = self.held[seq][within : within + len(buffer)]
        buffer[: len(part)] = part
        self.at += len(part)
        return len(part)


def from_path(path: str) -> tuple[int, Callable[[], Iterable[bytes]]]:
    """(size, opener) of a local file as a blob source."""
    from os.path import getsize

    def chunks() -> Iterable[bytes]:
        with open(path, "rb") as f:
            while part := f.read(CHUNK):
                yield part

    return getsize(path), chunks
