"""WARC archives: a writer that lets later equal payloads revisit the first, and a reader that salvages broken archives."""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_tag, materialize, narrow, new_folder

#: Payloads of fewer bytes are always stored. Bytes at which a writer starts the next archive. Salts of a hot digest.
SMALL, ARCHIVE_BYTES, SALTS = 100, 32 << 20, 32
#: Bytes that a record's headers and an unpacked member may have: what has more is quarantined. No string of Spark's is as large as the latter.
HEADERS, LARGEST = 1 << 28, (1 << 31) + (1 << 28)
#: Written as each record's date: archives of equal input are equal.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC, _VERSION, _READ = b"\x1f\x8b\x08", b"WARC/1.", 1 << 20
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def first_of_equal(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, payload, digest (hex SHA-256), record_type and refers_to of each row.

    A null text is an empty payload. Of rows with equal payloads of SMALL bytes or more, those with the smallest id are
    responses and the others revisit it; rows with a null id are responses, and none revisits them.
    """
    rows = narrow(pages, id_col, url_col, text_col).toDF("id", "url", "text").withColumn("id", F.col("id").cast("long"))
    rows = rows.withColumn("payload", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).drop("text").withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= SMALL
    firsts = rows.filter(large).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))).join(salted, ["digest", "salt"], "left")
    refers = F.when(large & (F.col("first") < F.col("id")), F.col("first"))
    return rows.select("id", "url", "payload", "digest", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), refers.alias("refers_to"))


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = [("WARC-Type", record_type), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    if url is not None:
        head.append(("WARC-Target-URI", _one_line(url)))
    if record_type == "revisit":
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _PROFILE)]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def _write(folder: str):
    def run(batches):
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task, attempt = first_tag() >> 33, TaskContext.get().taskAttemptId()
        out, done, n, size, here = None, [], 0, 0, ""

        def close():
            out.close()
            final = f"{base}/part-{task:05d}-{len(done):05d}.warc.gz"
            files.move(here, final)  # a task that runs again puts the same bytes there
            done.append((f"{folder}/{os.path.basename(final)}", n, size))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    here, n, size = f"{base}/.{task:05d}-{len(done):05d}.{attempt}", 0, 0
                    out = files.open_output_stream(here, compression=None)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pack.compress(record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"])) + pack.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes first_of_equal()'s rows as gzipped records, one member each; returns path, records and bytes of each archive."""
    folder = folder or new_folder(records.sparkSession, "warc")
    return materialize(records.mapInArrow(_write(folder), "path string, records long, bytes long"), "archives")


class Salvage:
    """Records of an archive, and the byte ranges that hold none that passes its checks.

    source needs read(offset, n) and size. records() gives (start, end, headers, payload); gaps holds (start, end,
    reason), merged where they touch. A record must have a version line, headers that end, the content that its length
    names with the end mark after it, and, where it names the payload's SHA-256, that payload; a gzip member must unpack
    with a right check sum and to at most `most` bytes. After a failure the reader looks for the next place where a member or a version line starts.
    """

    def __init__(self, source, most: int = LARGEST):
        self.source, self.gaps, self.most = source, [], most

    def _gap(self, start: int, end: int, reason: str) -> None:
        if self.gaps and self.gaps[-1][1] == start:
            self.gaps[-1] = (self.gaps[-1][0], end, self.gaps[-1][2])
        elif end > start:
            self.gaps.append((start, end, reason))

    def _next(self, at: int) -> int:
        """The first place from `at` on where a member or a record may start."""
        while at < self.source.size:
            block = self.source.read(at, _READ + 16)
            if m := _START.search(block):
                return at + m.start()
            at += _READ
        return self.source.size

    def _member(self, at: int) -> tuple[bytes, int]:
        unpack, parts, start, total = zlib.decompressobj(31), [], at, 0
        while not unpack.eof:
            block = self.source.read(at, 1 << 16)
            if not block:
                raise ValueError("member is cut off")
            parts.append(unpack.decompress(block, self.most - total + 1))
            total += len(parts[-1])
            if total > self.most or unpack.unconsumed_tail:
                raise ValueError("member is too large")
            at += len(block)
            if len(parts) == 1 and parts[0] and not parts[0].startswith(_VERSION[: len(parts[0])]):
                raise ValueError("member holds no record")
        end = at - len(unpack.unused_data)
        if end <= start:
            raise ValueError("member is empty")
        return b"".join(parts), end

    @staticmethod
    def _parse(read, size: int) -> tuple[dict, bytes, int]:
        """Headers, payload and length of the record at the start of what read(offset, n) gives."""
        head, want = b"", 1 << 12
        while (stop := head.find(b"\r\n\r\n")) < 0:
            if len(head) >= min(size, HEADERS):
                raise ValueError("headers don't end")
            head = read(0, min(want, size))
            want *= 4
        lines = head[:stop].decode("utf-8", "replace").split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError("no version line")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not re.fullmatch(r"[0-9]+", told := headers.get("content-length", "")):
            raise ValueError("no content length")
        length = int(told) if len(told) < 20 else size
        if stop + 8 + length > size:  # before anything of that length is read
            raise ValueError("content and its length differ")
        body = read(stop + 4, length + 4)
        if len(body) < length + 4 or body[length:] != b"\r\n\r\n":
            raise ValueError("content and its length differ")
        payload, told = body[:length], headers.get("warc-payload-digest", "")
        if told.startswith("sha256:") and headers.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != told[7:]:
            raise ValueError("payload and its digest differ")
        return headers, payload, stop + 8 + length

    def records(self):
        at = 0
        while at < self.source.size:
            try:
                if self.source.read(at, 3) == _MAGIC:
                    data, end = self._member(at)
                    headers, payload, length = self._parse(lambda o, n, d=data: d[o : o + n], len(data))
                    if length != len(data):
                        raise ValueError("member holds more than a record")
                else:
                    headers, payload, length = self._parse(lambda o, n, a=at: self.source.read(a + o, n), self.source.size - at)
                    end = at + length
            except (ValueError, zlib.error) as why:
                end = self._next(at + 1)
                self._gap(at, end, str(why))
            else:
                yield at, end, headers, payload
            at = end


class BytesSource:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]


class FileSource:
    """A file of any store; what was read last is kept, so that short reads in a row are cheap."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        self.size, self.at, self.block = self.file.size(), 0, b""

    def read(self, offset: int, n: int) -> bytes:
        if not self.at <= offset <= offset + n <= self.at + len(self.block):
            self.file.seek(offset)
            self.at, self.block = offset, self.file.read(max(n, _READ))
        return self.block[offset - self.at : offset - self.at + n]


_READ_SCHEMA = "path string, start long, end long, reason string, record_type string, record_id string, target_uri string, refers_to string, digest string, payload_length long, payload binary"


def _read(batches):
    names = [x.split()[0] for x in _READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _READ_SCHEMA.split(", "), strict=True)])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            reader, rows, size = Salvage(FileSource(path)), [], 0
            for start, end, h, payload in reader.records():
                told = h.get("x-payload-length", "")
                length = int(told) if re.fullmatch("[0-9]{1,18}", told) and h.get("warc-type") == "revisit" else len(payload)
                rows.append((path, start, end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), length, payload))
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            rows += [(path, start, end, reason, *[None] * 7) for start, end, reason in reader.gaps]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows of all archives of a column path: records (reason is null), and quarantined gaps with start, end and reason.

    Each archive is read by one task, a record at a time; sound, damaged, cut-off, empty and foreign files all give rows
    for what they hold. A revisit's payload_length is the full payload's.
    """
    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(parts, "path").mapInArrow(_read, _READ_SCHEMA)
