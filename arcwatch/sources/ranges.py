"""Large binary files by byte ranges: captures and memory cores that are larger
than a task's memory.

A table of ranges (file, start, size) is dealt over tasks, and each task reads
its own through pyarrow's file systems, which seek on local disks, HDFS and
object stores.  Files are listed by Spark, which reads no content for that.

Records of a capture have no mark of their own, so a range that begins inside a
file looks for the first place from which record headers follow one another for
longer than any record is.  Whether that was right is then certain: a range must
begin where the one before ends.  Ranges that do not are walked again from there
until all do, so the rows are those of one walk over the whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packets import PACKET, decode

#: Bytes of a range.
SIZE = 64 << 20
#: No record of a capture is longer.
LONGEST = 1 << 18
_ORDERS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_PACKET = [f.split() for f in PACKET.split(", ")]


def _open(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file:" + path.removeprefix("file:"))
    return system.open_input_file(inner)


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """file and length of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")


def ranges_of(files: DataFrame, size: int = SIZE) -> DataFrame:
    """file, length, start: each file cut in ranges."""
    return files.filter("length > 0").withColumn("start", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")))


def _read(source: pa.NativeFile, start: int, size: int) -> bytes:
    source.seek(start)
    return source.read(size)


class Records:
    """The records of a capture from a place in it on."""

    def __init__(self, source: pa.NativeFile, length: int):
        self.source, self.length = source, length
        head = _read(source, 0, 24)
        self.order, self.parts = _ORDERS.get(head[:4], (None, 1))
        self.snap = LONGEST

    def header(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(microseconds, size) of the record header there, if it can be one."""
        if at + 16 > len(data):
            return None
        seconds, part, size, whole = struct.unpack_from(self.order + "IIII", data, at)
        if size > self.snap or size > whole or whole > self.snap or part >= 1_000_000 * self.parts:
            return None
        return seconds * 1_000_000 + part // self.parts, size

    def first(self, start: int) -> int:
        """The first record that begins at start or later."""
        if start <= 24:
            return 24
        data = _read(self.source, start, 4 * self.snap + 32)
        for place in range(min(len(data), self.snap + 16)):
            at, end = place, place + 2 * self.snap
            while at < end and (found := self.header(data, at)):
                at += 16 + found[1]
            # the chain is longer than a record, or ends with the file
            if at >= end or start + at == self.length:
                return start + place
        return self.length

    def walk(self, at: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """(place, microseconds, frame) of the records that begin before end;
        a cut one ends the capture."""
        held, base = b"", at
        while at < end:
            if at + 16 - base > len(held):
                held, base = _read(self.source, at, 1 << 20), at
            if len(held) < at - base + 16:
                return
            seconds, part, size, _ = struct.unpack_from(self.order + "IIII", held, at - base)
            if at + 16 + size > self.length:
                return
            if at - base + 16 + size > len(held):
                held, base = _read(self.source, at, max(1 << 20, size + 16)), at
            body = at - base + 16
            yield at, seconds * 1_000_000 + part // self.parts, held[body : body + size]
            at += 16 + size


def _measured(size: int):
    """entry, next and n of a range: its first record, the first after it, how
    many are between; ``entry`` is looked for where it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with _open(row["file"]) as source:
                    records = Records(source, row["length"])
                    if records.order is None:
                        continue
                    entry = row["entry"] if row["entry"] is not None else records.first(row["start"])
                    n, after = 0, entry
                    for at, _, frame in records.walk(entry, row["start"] + size):
                        n, after = n + 1, at + 16 + len(frame)
                out.append((row["file"], row["length"], row["start"], entry, after, n))
            names = ["file", "length", "start", "entry", "after", "n"]
            yield pa.record_batch([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*out) if out else [()] * 6)], names)

    return run


_MEASURED = "file string, length long, start long, entry long, after long, n long"


def capture_ranges(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """file, length, start, entry and frames of every range that holds records:
    where its first record is and how many came before it in the file."""
    cut = ranges_of(files_under(spark, path), size).withColumn("entry", F.lit(None).cast("long"))
    known = {(r["file"], r["start"]): r for r in cut.repartition("file", "start").mapInArrow(_measured(size), _MEASURED).collect()}
    while True:
        wrong, place, before, ended = [], {}, {}, set()
        for key in sorted(known):
            r = known[key]
            file, end, expected = r["file"], r["start"] + size, place.get(r["file"], 24)
            before[key] = None
            # a range inside one record passes on where that ends
            if file in ended or expected >= end:
                continue
            if r["entry"] != expected:
                wrong.append((file, r["length"], r["start"], expected))
                break
            place[file], before[key] = r["after"], expected
            # a walk that stops early has come to a cut record: the capture's end
            if r["after"] < end:
                ended.add(file)
        if not wrong:
            break
        fixed = spark.createDataFrame(wrong, "file string, length long, start long, entry long").mapInArrow(_measured(size), _MEASURED).collect()
        known |= {(r["file"], r["start"]): r for r in fixed}
    rows, count = [], {}
    for key in sorted(known):
        r = known[key]
        if before[key] is not None and r["n"]:
            rows.append((r["file"], r["length"], r["start"], r["entry"], count.get(r["file"], 0)))
            count[r["file"]] = count.get(r["file"], 0) + r["n"]
    return spark.createDataFrame(rows, "file string, length long, start long, entry long, frames long")


def read_captures(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """The packets of all captures under path, as ``packets.read_captures`` gives
    them; a file is read by as many tasks as it has ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in _PACKET], [name for name, _ in _PACKET])

        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                with _open(row["file"]) as source:
                    walk = Records(source, row["length"]).walk(row["entry"], row["start"] + size)
                    for number, (_, us, frame) in enumerate(walk, row["frames"] + 1):
                        if (found := decode(frame)) is not None:
                            rows.append({"file": row["file"], "frame_no": number, "us": us} | found)
                        if len(rows) == 8192:
                            yield made(rows)
                            rows = []
                yield made(rows)

    places = capture_ranges(spark, path, size)
    return places.repartition("file", "start").mapInArrow(run, PACKET)


# -- memory cores -------------------------------------------------------------------------

_SEGMENT = "file string, kind string, vaddr long, flags int, offset long, size long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loadable and note segments from the program headers; of a file that is
    cut, as far as it goes."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            with _open(row["file"]) as source:
                head = _read(source, 0, 64)
                if len(head) < 64 or head[:4] != b"\x7fELF":
                    continue
                order, wide = "<" if head[5] != 2 else ">", head[4] != 1
                if wide:
                    table, (width, n) = struct.unpack_from(order + "Q", head, 32)[0], struct.unpack_from(order + "HH", head, 54)
                else:
                    table, (width, n) = struct.unpack_from(order + "I", head, 28)[0], struct.unpack_from(order + "HH", head, 42)
                headers = _read(source, table, width * n)
            for at in range(0, len(headers) - (40 if wide else 28) + 1, max(width, 1)):
                if wide:
                    kind, flags, offset, vaddr, _, size = struct.unpack_from(order + "IIQQQQ", headers, at)
                else:
                    kind, offset, vaddr, _, size, _, flags = struct.unpack_from(order + "IIIIIII", headers, at)
                size = min(size, row["length"] - offset)
                if kind in (1, 4) and size > 0:
                    out.append((row["file"], "load" if kind == 1 else "note", vaddr - (vaddr >> 63 << 64), flags, offset, size))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], [f.split()[0] for f in _SEGMENT.split(", ")])


def core_segments(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (load, note), vaddr, flags, offset and size of the segments of
    all cores under path; other files have none."""
    return files_under(spark, path).mapInArrow(_segments, _SEGMENT)


def read_cores(spark: SparkSession, path: str, size: int = SIZE, overlap: int = 4096) -> DataFrame:
    """The content of all segments, a range a row: file, region, perms, vaddr,
    data; what hosts.memory_findings reads (pid is 0).

    A range goes on for ``overlap`` bytes into the next, so that a mark of at
    most so many bytes on an edge is whole in one of them.
    """
    rows = core_segments(spark, path).withColumn("start", F.explode(F.expr(f"sequence(0L, size - 1, {size}L)")))
    letter = lambda bit, c: F.when(F.col("flags").bitwiseAND(bit) != 0, c).otherwise("-")
    place = F.concat(F.lit("0x"), F.lower(F.hex(F.col("vaddr") + F.col("start"))))
    rows = rows.select("file", F.concat(F.col("kind"), F.lit(":"), place).alias("region"), F.concat(letter(4, "r"), letter(2, "w"), letter(1, "x")).alias("perms"), (F.col("vaddr") + F.col("start")).alias("vaddr"), (F.col("offset") + F.col("start")).alias("at"), F.least(F.lit(size + overlap), F.col("size") - F.col("start")).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["file"]) as source:
                    data = _read(source, row["at"], row["bytes"])
                yield pa.record_batch([pa.array([v]) for v in (row["file"], 0, row["region"], row["perms"], row["vaddr"])] + [pa.array([data], pa.binary())], ["file", "pid", "region", "perms", "vaddr", "data"])

    # ranges of one file go to as many tasks as there are
    return rows.repartition("file", "at").mapInArrow(run, "file string, pid long, region string, perms string, vaddr long, data binary")
