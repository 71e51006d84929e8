"""Binary hash traces: seven versions read, version 7 written.

`read` parses files that Spark loads whole (any store, up to 2 GB a file) and yields headers,
files or chunks; for headers and files the chunk records are skipped, not parsed. The data
source `hashtrace` does the same for files that workers can open, one partition a file, and
writes one trace per partition.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC = 0xDEADDEAD
NAME_BYTES = 4096
FIXED, VARIABLE = 1, 2
CHUNKING = {1: "FIXED", 2: "VARIABLE"}
HASHING = {1: "MD5", 2: "SHA256", 3: "MD5_48", 4: "MURMUR", 5: "MD5_64", 6: "SHA1"}
ALGORITHMS = {1: "RANDOM", 2: "SIMPLE_MATCH", 3: "RABIN"}
SYMLINK, KIND_MASK = 0o120000, 0o170000

HEAD = struct.Struct(f"<IIQ{NAME_BYTES}sQI44sII")
TIMES = struct.Struct(f"<{NAME_BYTES}sQQ")
FILE_OLD = struct.Struct(f"<{NAME_BYTES}sQQ")
FILE_SHORT = struct.Struct("<QQI")
FILE_STAT = struct.Struct("<QIIQQQQQQQQII")
FILE_BLOCKS = struct.Struct("<QQIIQQQQQQQQII")

SCHEMAS = {
    "headers": "trace string, version int, files long, chunks long, bytes long, root string, sysid string, start_time long, end_time long, chnk_method string, "
    "chnk_params struct<chunk_size:long,algo:string,window_size:long,bits_to_compare:long,pattern:string,min_csize:long,max_csize:long>, hsh_method string, hash_bits int",
    "files": "trace string, file_no long, path string, file_size long, blocks long, uid long, gid long, perm long, atime long, mtime long, ctime long, hardlinks long, deviceid long, inodenum long, chunks long, target_path string",
    "chunks": "trace string, file_no long, chunk_no long, hash string, size long, cratio short",
}


class TraceError(ValueError):
    """The file is not a readable trace."""


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _params(method: int, raw: bytes) -> dict:
    out = dict.fromkeys(("chunk_size", "algo", "window_size", "bits_to_compare", "pattern", "min_csize", "max_csize"))
    if method == FIXED:
        return out | {"chunk_size": struct.unpack_from("<I", raw)[0]}
    (algo,) = struct.unpack_from("<I", raw)
    low, high = struct.unpack_from("<II", raw, 36)
    out |= {"algo": ALGORITHMS.get(algo), "min_csize": low, "max_csize": high}
    if algo == 2:
        bits, pattern = struct.unpack_from("<IQ", raw, 4)
        out |= {"bits_to_compare": bits, "pattern": f"{pattern:x}"}
    elif algo == 3:
        window, _, _, bits, pattern = struct.unpack_from("<IQQIQ", raw, 4)
        out |= {"window_size": window, "bits_to_compare": bits, "pattern": f"{pattern:x}"}
    return out


@dataclass
class Trace:
    """A cursor over one trace's bytes."""

    raw: memoryview
    name: str

    def __post_init__(self):
        self.at = 0
        magic, self.version, self.n_files, root, self.n_chunks, self.method, params, self.hashing, self.bits = self._take(HEAD)
        if magic != MAGIC:
            raise TraceError(f"{self.name}: not a trace")
        if not 1 <= self.version <= 7:
            raise TraceError(f"{self.name}: version {self.version}")
        self.root, self.params, self.sysid, self.start, self.end, self.total = _text(root), _params(self.method, params), None, None, None, None
        if self.version >= 3:
            sysid, self.start, self.end = self._take(TIMES)
            self.sysid = _text(sysid)
        if self.version >= 5:
            (self.total,) = self._take(struct.Struct("<Q"))
        size_bytes = 0 if self.method != VARIABLE or self.version < 3 else 4 if self.version == 7 else 8
        self.record = np.dtype([(n, t) for n, t in (("size", f"<u{size_bytes}" if size_bytes else None), ("hash", f"V{self.bits // 8}"), ("cratio", "u1" if self.version >= 6 else None)) if t])

    def _take(self, layout: struct.Struct) -> tuple:
        if self.at + layout.size > len(self.raw):
            raise TraceError(f"{self.name}: cut short")
        out = layout.unpack_from(self.raw, self.at)
        self.at += layout.size
        return out

    def _bytes(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise TraceError(f"{self.name}: cut short")
        self.at += n
        return bytes(self.raw[self.at - n : self.at])

    def header(self) -> tuple:
        names = CHUNKING.get(self.method), tuple(self.params.values()), HASHING.get(self.hashing)
        return (self.name, self.version, self.n_files, self.n_chunks, self.total, self.root, self.sysid, self.start, self.end, *names, self.bits)

    def files(self) -> Iterator[tuple[tuple, np.ndarray]]:
        """Every file's row and its chunk records, which are a view and cost nothing to skip."""
        for no in range(self.n_files):
            stat: tuple = (None,) * 10
            target = None
            if self.version == 1:
                path, size, chunks = self._take(FILE_OLD)
                path = _text(path)
            elif self.version <= 3:
                size, chunks, length = self._take(FILE_SHORT)
                path = self._bytes(length).decode("utf-8", "replace")
            else:
                values = self._take(FILE_STAT if self.version == 4 else FILE_BLOCKS)
                size, rest = values[0], values[1:] if self.version >= 5 else (None, *values[1:])
                *fields, chunks, length, target_length = rest
                stat = tuple(fields)
                path = self._bytes(length).decode("utf-8", "replace")
                if stat[3] & KIND_MASK == SYMLINK:
                    target = self._bytes(target_length).decode("utf-8", "replace")
            at = self.at
            self._skip(chunks * self.record.itemsize)
            records = np.frombuffer(self.raw, self.record, chunks, at)
            yield (self.name, no, path, size, *stat, chunks, target), records

    def _skip(self, n: int) -> None:
        if self.at + n > len(self.raw):
            raise TraceError(f"{self.name}: cut short")
        self.at += n

    def chunks(self) -> Iterator[pd.DataFrame]:
        for row, records in self.files():
            n = len(records)
            if not n:
                continue
            size = np.zeros(n, np.int64)
            if "size" in records.dtype.names:
                size = records["size"].astype(np.int64)
            elif self.method == FIXED and self.version >= 1:
                width = self.params["chunk_size"]
                size = np.full(n, width, np.int64)
                size[-1] = min(max(row[3] - (n - 1) * width, 0), width)
            ratio = records["cratio"].astype(np.int16) if "cratio" in records.dtype.names else np.zeros(n, np.int16)
            width = self.bits // 8
            digits = np.ascontiguousarray(records["hash"]).tobytes().hex()
            hashes = [digits[2 * width * i : 2 * width * (i + 1)] for i in range(n)]
            yield pd.DataFrame({"trace": row[0], "file_no": row[1], "chunk_no": np.arange(n), "hash": hashes, "size": size, "cratio": ratio})


def rows_of(raw: bytes | memoryview, name: str, table: str) -> Iterator[pd.DataFrame]:
    """One trace's headers, files or chunks as frames."""
    columns = [c.strip().split(" ")[0].split(":")[0] for c in _top_level(SCHEMAS[table])]
    trace = Trace(memoryview(raw), name)
    if table == "headers":
        yield pd.DataFrame([trace.header()], columns=columns)
    elif table == "files":
        found = [row for row, _ in trace.files()]
        if found:
            yield pd.DataFrame(found, columns=columns)
    else:
        yield from trace.chunks()


def _top_level(schema: str) -> list[str]:
    parts, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def read(spark: SparkSession, path: str, table: str = "chunks", mode: str = "FAILFAST") -> DataFrame:
    """Headers, files or chunks of all traces below a path; `trace` is the file's name.

    Files that start with a dot are skipped. With mode PERMISSIVE unreadable traces give no rows.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    yield from rows_of(content, at.rsplit("/", 1)[-1], table)
                except TraceError:
                    if mode != "PERMISSIVE":
                        raise

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, SCHEMAS[table])


def fingerprints(chunks: DataFrame) -> DataFrame:
    """Chunk streams (trace, file_no, chunk_no, fp, size, cratio) from a trace's chunks."""
    return chunks.withColumn("fp", F.substring("hash", 1, 12)).drop("hash")


def with_names(headers: DataFrame) -> DataFrame:
    """Headers with printable chunking and hashing methods; unknown methods stay null."""
    p = F.col("chnk_params")
    span = F.format_string("[%d:%d]", p["min_csize"], p["max_csize"])
    chunking = (
        F.when(F.col("chnk_method") == "FIXED", F.format_string("Fixed-%d", p["chunk_size"]))
        .when(p["algo"] == "SIMPLE_MATCH", F.concat(F.format_string("Variable-simple_match, bits=%d, pattern=%s", p["bits_to_compare"], p["pattern"]), span))
        .when(p["algo"] == "RABIN", F.concat(F.format_string("Variable-rabin bits=%d, pattern=%s, Window size=%d", p["bits_to_compare"], p["pattern"], p["window_size"]), span))
        .when(p["algo"] == "RANDOM", F.concat(F.lit("Variable-random"), span))
    )
    family = F.when(F.col("hsh_method").isin("MD5", "MD5_48"), "MD5").when(F.col("hsh_method").isin("SHA256", "SHA1", "MURMUR"), F.col("hsh_method"))
    return headers.withColumns({"chunking": chunking, "hashing": F.concat(family, F.format_string("-%d", "hash_bits"))})


class TraceWriter:
    """Writes one version 7 trace; files are added in order, chunks follow their file."""

    def __init__(self, path: str, method: int = VARIABLE, hashing: int = 3, hash_bits: int = 48, root: str = "/", chunk_size: int = 0, min_csize: int = 0, max_csize: int = 0, start_time: int = 0):
        if hash_bits % 8 or method not in CHUNKING or hashing not in HASHING:
            raise ValueError("hash sizes are whole bytes, and methods must be known")
        self.path, self.method, self.hashing, self.bits, self.root, self.start = path, method, hashing, hash_bits, root, start_time
        if method == FIXED:
            self.params = struct.pack("<I40x", chunk_size)
        else:
            self.params = struct.pack("<I32xII", 3, min_csize, max_csize)
        self.body: list[bytes] = []
        self.current: dict | None = None
        self.files = self.chunks = self.bytes = 0

    def add_file(self, path: str, size: int, target: str = "", **stat) -> None:
        self._end_file()
        self.current = {"path": path.encode(), "target": target.encode(), "size": size, "stat": stat, "chunks": [], "n": 0}
        self.files += 1
        self.bytes += size

    def add_chunk(self, digest: bytes, size: int = 0, cratio: int = 0) -> None:
        if self.current is None or len(digest) * 8 != self.bits:
            raise ValueError("a chunk needs a file and a hash of the trace's size")
        head = struct.pack("<I", size) if self.method == VARIABLE else b""
        self.current["chunks"].append(head + digest + bytes([cratio]))
        self.chunks += 1

    def _end_file(self) -> None:
        if self.current is None:
            return
        c, s = self.current, self.current["stat"]
        perm = s.get("perm", 0o100644)
        target = c["target"] if perm & KIND_MASK == SYMLINK else b""
        fields = [s.get(k, 0) for k in ("atime", "mtime", "ctime", "hardlinks", "deviceid", "inodenum")]
        self.body.append(FILE_BLOCKS.pack(c["size"], s.get("blocks", 0), s.get("uid", 0), s.get("gid", 0), perm, *fields, len(c["chunks"]), len(c["path"]), len(target)))
        self.body += [c["path"], target, *c["chunks"]]
        self.current = None

    def close(self, end_time: int = 0) -> None:
        self._end_file()
        head = HEAD.pack(MAGIC, 7, self.files, self.root.encode(), self.chunks, self.method, self.params, self.hashing, self.bits)
        new = f"{self.path}.{uuid.uuid4().hex}"
        with open(new, "wb") as out:
            out.write(head + TIMES.pack(b"", self.start, end_time) + struct.pack("<Q", self.bytes))
            out.writelines(self.body)
        os.replace(new, self.path)


@dataclass
class _FilePartition(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, mode: str):
        self.path, self.table, self.mode = path, table, mode

    def partitions(self):
        if os.path.isfile(self.path):
            return [_FilePartition(self.path)]
        return [_FilePartition(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith((".", "_"))]

    def read(self, partition):
        import mmap

        if partition is None:
            return
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
            try:
                for frame in rows_of(bytes(raw) if self.table == "chunks" else memoryview(bytes(raw)), os.path.basename(partition.path), self.table):
                    for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                        yield row
            except TraceError:
                if self.mode != "PERMISSIVE":
                    raise


@dataclass
class _Done(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        """A partition's rows (file_no, chunk_no, hash, size, cratio) in order as one trace."""
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        at = os.path.join(self.path, f"trace-{TaskContext.get().partitionId():05d}")
        rows = sorted(iterator, key=lambda r: (r["file_no"], r["chunk_no"]))
        if rows:
            out = TraceWriter(at, hash_bits=len(rows[0]["hash"]) * 4)
            last = None
            sizes: dict = {}
            for r in rows:
                sizes[r["file_no"]] = sizes.get(r["file_no"], 0) + r["size"]
            for r in rows:
                if r["file_no"] != last:
                    last = r["file_no"]
                    out.add_file(str(last), sizes[last])
                out.add_chunk(bytes.fromhex(r["hash"]), r["size"], r["cratio"])
            out.close()
        return _Done(at)


class HashTraceSource(DataSource):
    """`spark.read.format("hashtrace").option("table", ...)`, after registering the class."""

    @classmethod
    def name(cls):
        return "hashtrace"

    def schema(self):
        return SCHEMAS[self.options.get("table", "chunks")]

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("table", "chunks"), self.options.get("mode", "FAILFAST"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])
