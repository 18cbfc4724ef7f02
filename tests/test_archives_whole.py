"""Zipped and loose JSONL files: what is read of them, and in what pieces."""

from __future__ import annotations

import zipfile

from assay.sources import archives as A


def test_members_and_lines(spark, tmp_path):
    week = "2024-09-22_2024-09-28"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"x/{week}_Win32_test.jsonl", '{"a": 1}\n\n{"a": 2}\r\n')
        z.writestr(f"x/{week}_ELF_test.jsonl", "{}\n")
        z.writestr(f"x/{week}_Win64_test.jsonl", "")
        z.writestr(f"x/{week}_Win32_train.jsonl", "{}\n")
    (tmp_path / f"{week}_challenge.jsonl").write_text('{"c": "ü"}')
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "b.zip", "w") as z:
        z.writestr(f"{week}_challenge.jsonl", "{}\n{}\n")  # the loose file wins
    found = A.discover_members(spark, str(tmp_path), ["Win32", "Win64"]).collect()
    assert sorted((r.name, r.split, r.file_type, r.in_zip) for r in found) == [(f"{week}_challenge.jsonl", "challenge", None, False), (f"x/{week}_Win32_test.jsonl", "test", "Win32", True), (f"x/{week}_Win64_test.jsonl", "test", "Win64", True)]
    lines = A.read_archives(spark, f"file://{tmp_path}", ["Win32"]).collect()
    assert sorted((r.split, r.line, r.value) for r in lines) == [("challenge", 0, '{"c": "ü"}'), ("test", 0, '{"a": 1}'), ("test", 1, '{"a": 2}')]


def test_partitions_and_ranges(tmp_path):
    """Members are dealt by their packed sizes; planning and reading touch no more of a file than they need."""
    big = "".join(f'{{"n": {i}}}\n' for i in range(200_000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(5):
            z.writestr(f"w{k}_Win32_test.jsonl", big)
    options = {"path": str(tmp_path), "types": "Win32", "partitionbytes": str(len(big) * 2)}
    source = A.ArchiveSource(options)
    reader = A.ArchiveReader(type("S", (), {"names": ["name", "line"]}), options)
    parts = reader.partitions()
    assert sorted(len(p.parts) for p in parts) == [1, 2, 2] and source.name() == "jsonl_archives"
    first = next(iter(reader.read(parts[0])))
    assert 0 < first.num_rows < 200_000  # a batch, not the member
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5 * 200_000


def test_loose_lines_over_block_edges(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "BATCH_BYTES", 7)
    (tmp_path / "w_challenge.jsonl").write_text("".join(f"line {i}\n" for i in range(50)) + "last")
    reader = A.ArchiveReader(type("S", (), {"names": ["value"]}), {"path": str(tmp_path)})
    assert [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()] == [f"line {i}" for i in range(50)] + ["last"]


def test_archives_are_written_as_rows_come(spark, tmp_path):
    """A few rows at a time are taken, whatever the file's size, and files hold their members' lines."""
    import pyarrow as pa

    drawn = []

    def batches():
        for k in range(4):
            drawn.append(k)
            yield pa.RecordBatch.from_pydict({"file": ["a.zip"] * 1000, "member": ["m"] * 1000, "value": [str(k)] * 1000})

    runs = A._runs(batches())
    assert len(next(runs)[2]) <= 256 and drawn == [0]
    assert sum(len(v) for _, _, v in runs) > 3700
    rows = [("a.zip", f"w{i % 3}_Win32_test.jsonl", f"{i}") for i in range(3000)] + [("w_challenge.jsonl", None, f"é{i}") for i in range(700)] + [("b.zip", "w9_Win64_test.jsonl", "x")]
    done = A.write_archives(spark.createDataFrame(rows, "file string, member string, value string").repartition(5), f"file://{tmp_path}/x").collect()
    assert sorted(tuple(r) for r in done) == [("a.zip", 3000), ("b.zip", 1), ("w_challenge.jsonl", 700)]
    lines = A.read_archives(spark, f"file://{tmp_path}/x", ["Win32", "Win64"]).collect()
    assert sorted((r.name, r.value) for r in lines) == sorted((m or f, v) for f, m, v in rows) and max(r.line for r in lines) == 999
