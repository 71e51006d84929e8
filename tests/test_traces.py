import struct

import pytest

from stratadup.sources import nodes, traces


def old_trace(version, method):
    """A hand-packed trace: one file of 3 chunks, an empty file, and from version 4 on a symlink."""
    params = struct.pack("<I40x", 100) if method == 1 else struct.pack("<I32xII", 3, 10, 90)
    link = version >= 4
    head = struct.pack("<IIQ4096sQI44sII", 0xDEADDEAD, version, 2 + link, b"/data", 3, method, params, 3, 48)
    if version >= 3:
        head += struct.pack("<4096sQQ", b"host", 11, 22)
    if version >= 5:
        head += struct.pack("<Q", 250)

    def file(path, size, chunks, perm=0o100644, target=b""):
        if version == 1:
            return struct.pack("<4096sQQ", path, size, chunks)
        if version <= 3:
            return struct.pack("<QQI", size, chunks, len(path)) + path
        blocks = struct.pack("<Q", 8) if version >= 5 else b""
        return struct.pack("<Q", size) + blocks + struct.pack("<IIQQQQQQQQII", 5, 6, perm, 1, 2, 3, 4, 7, 9, chunks, len(path), len(target)) + path + target

    def chunk(i, size):
        width = {True: {7: "<I"}.get(version, "<Q")}.get(method == 2 and version >= 3)
        return (struct.pack(width, size) if width else b"") + bytes([i] * 6) + (b"\x02" if version >= 6 else b"")

    body = file(b"a", 250, 3) + chunk(1, 100) + chunk(2, 100) + chunk(3, 50) + file(b"b", 0, 0)
    return head + body + (file(b"l", 1, 0, 0o120777, b"to") if link else b"")


@pytest.mark.parametrize("method", [1, 2])
@pytest.mark.parametrize("version", range(1, 8))
def test_all_versions(version, method):
    raw = old_trace(version, method)
    (head,) = traces.rows_of(raw, "t", "headers")
    h = head.iloc[0]
    assert (h.version, h.files, h.chunks, h.root, h.hash_bits, h.hsh_method) == (version, 2 + (version >= 4), 3, "/data", 48, "MD5_48")
    assert (h.end_time == 22) == (version >= 3) and (h.bytes == 250) == (version >= 5)
    (files,) = traces.rows_of(raw, "t", "files")
    assert list(files.path) == ["a", "b"] + ["l"] * (version >= 4) and list(files.chunks)[:2] == [3, 0]
    if version >= 4:
        assert files.target_path[2] == "to" and files.uid[0] == 5 and files.inodenum[0] == 9
        assert (files.blocks[0] == 8) == (version >= 5)
    (chunks,) = traces.rows_of(raw, "t", "chunks")
    assert list(chunks.hash) == ["01" * 6, "02" * 6, "03" * 6]
    assert list(chunks["size"]) == ([100, 100, 50] if method == 1 or version >= 3 else [0, 0, 0])
    assert set(chunks.cratio) == {2 if version >= 6 else 0}


def test_damaged_traces():
    good = old_trace(7, 2)
    for bad in (b"\0" + good[1:], good[:4] + struct.pack("<I", 8) + good[8:], good[:100], good[:-30]):
        with pytest.raises(traces.TraceError):
            for table in ("headers", "files", "chunks"):
                list(traces.rows_of(bad, "t", table))


def test_write_and_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for t in range(3):
        w = traces.TraceWriter(str(folder / f"t{t}"), min_csize=10, max_csize=99, start_time=5)
        w.add_file("/x", 300, uid=3)
        for i in range(t * 2):
            w.add_chunk(bytes([t, i, 0, 0, 0, 1]), 50 + i, 1)
        w.add_file("/l", 0, target="/x", perm=0o120777)
        w.close(end_time=9)
    heads = traces.with_names(traces.read(spark, str(folder), "headers")).orderBy("trace").collect()
    assert [(h.trace, h.chunks, h.end_time, h.hashing) for h in heads] == [("t0", 0, 9, "MD5-48"), ("t1", 2, 9, "MD5-48"), ("t2", 4, 9, "MD5-48")]
    assert heads[0].chunking == "Variable-rabin bits=0, pattern=0, Window size=0[10:99]"
    files = traces.read(spark, str(folder), "files").orderBy("trace", "file_no").collect()
    assert [f.target_path for f in files] == [None, "/x"] * 3 and files[0].uid == 3
    chunks = traces.fingerprints(traces.read(spark, str(folder))).orderBy("trace", "chunk_no").collect()
    assert [(c.trace, c.chunk_no, c.fp, c.size) for c in chunks[:2]] == [("t1", 0, "010000000001", 50), ("t1", 1, "010100000001", 51)]
    (folder / "junk").write_bytes(b"no trace at all")
    assert traces.read(spark, str(folder), mode="PERMISSIVE").count() == 6
    with pytest.raises(Exception, match="not a trace|cut short"):
        traces.read(spark, str(folder)).count()


def test_data_source(spark, tmp_path):
    spark.dataSource.register(traces.HashTraceSource)
    rows = [(f, i, f"{f:02x}{i:02x}00000000", 10 + i, 0) for f in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "file_no long, chunk_no long, hash string, size long, cratio int").coalesce(1)
    out = str(tmp_path / "out")
    df.write.format("hashtrace").mode("append").save(out)
    back = spark.read.format("hashtrace").load(out)
    assert sorted((r.hash, r.size) for r in back.collect()) == sorted((r[2], r[3]) for r in rows)
    assert spark.read.format("hashtrace").option("table", "files").load(out).count() == 3
    assert spark.read.format("hashtrace").option("table", "headers").load(out).first().chunks == 12


def test_node_list(spark, tmp_path):
    p = tmp_path / "nodes"
    p.write_text(" 10.0.0.1:80 \n\n10.0.0.2 : 81\n")
    assert [tuple(r) for r in nodes.read(spark, str(p), 2).orderBy("node").collect()] == [(0, "10.0.0.1", 80), (1, "10.0.0.2", 81)]
    with pytest.raises(ValueError):
        nodes.read(spark, str(p), 3)
