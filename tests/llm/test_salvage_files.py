"""Damaged archives as files, read by Spark: what is sound comes back, the rest is logged, and nothing raises."""

import hashlib
import zlib

import pytest

from tests.llm.test_operators import members, warc


def covered(rows, size):
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at < r.end
        at = r.end
    assert at == size


def read(spark, folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{folder}/{name}",) for name in files], "path string")
    out = {}
    for r in warc.read_archives(paths).collect():
        out.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_every_single_byte(spark, tmp_path, packed):
    parts = members(2, packed)
    data = b"".join(parts)
    files = {}
    for i in range(len(data)):
        hurt = bytearray(data)
        hurt[i] ^= 0x55
        files[f"{i:05d}"] = bytes(hurt)
    found = read(spark, tmp_path, files)
    assert set(found) == set(files)
    for name, rows in found.items():
        covered(rows, len(data))
        other = 1 if int(name) < len(parts[0]) else 0
        assert f"<urn:page:{other}>" in {r.record_id for r in rows if r.reason is None}


@pytest.mark.parametrize("packed", [True, False])
def test_lengths_of_any_number_of_digits(spark, tmp_path, packed):
    payload = b"p" * 150
    sound = members(1, packed)[0]
    files = {}
    for digits in (*range(1, 25), 400, 5000):
        record = warc.record_bytes(7, "u", payload, hashlib.sha256(payload).hexdigest(), "response", None).replace(b"Content-Length: 150", b"Content-Length: " + b"9" * digits)
        if packed:
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            record = pack.compress(record) + pack.flush()
        files[str(digits)] = record + sound
    for name, rows in read(spark, tmp_path, files).items():
        covered(rows, len(files[name]))
        assert [r.record_id for r in rows if r.reason is None] == ["<urn:page:0>"], name


def test_cut_off_empty_and_foreign_files(spark, tmp_path):
    parts = members(2)
    files = {"cut": parts[0] + parts[1][:-5], "foreign": b"<html>" * 1000, "nothing": b"", "zeros": bytes(3_000_000) + parts[0]}
    found = read(spark, tmp_path, files)
    assert "nothing" not in found
    assert [r.record_id for r in found["cut"]] == ["<urn:page:0>", None] and found["cut"][1].reason == "member is cut off"
    assert [r.record_id for r in found["foreign"]] == [None] and found["foreign"][0].end == 6000
    assert sorted(str(r.record_id) for r in found["zeros"]) == ["<urn:page:0>", "None"]


def test_large_members_and_headers(spark, tmp_path):
    data = b"".join(members(2))
    reader = warc.Salvage(warc.BytesSource(data), most=100)
    assert not list(reader.records()) and {w for _, _, w in reader.gaps} == {"member is too large"}
    df = spark.createDataFrame([(1, "u" * (2 << 20), "x" * 200, "clash"), (2, "v", "x" * 200, None)], "page_id long, url string, html string, digest string")
    rows = warc.read_archives(warc.write_archives(warc.first_of_equal(df))).collect()
    assert sorted((r.record_id, r.record_type) for r in rows) == [("<urn:page:1>", "response"), ("<urn:page:2>", "revisit")]
    assert all(r.reason is None for r in rows)
