"""WARC archives: writing pages as records, and a Python data source that reads them back.

Writing: of pages with equal payloads of at least 1000 bytes, the one with the largest id becomes a
`response` record and the others `revisit` records that refer to it; shorter payloads are all
`response`. A Bloom filter of bounded size finds the digests that may repeat; only those rows are
shuffled. Each task writes one archive with one gzip member per record. A member's size is in an
extra field of its header (`sl`), so that a reader can pass over it. The names of the archives of
the successful attempts go into a manifest that Spark writes and commits; what a lost attempt
left is not in it.

Reading: `spark.read.format("warc").load(folder)` plans one partition for about `range_bytes` of
an archive, from the manifest. Predicates on record type and headers are pushed down. A record's
headers are inflated and parsed first; a record that fails a predicate, and every payload with the
option `payload=false`, is passed over without inflating it. Archives of other writers, without a
manifest or the extra field, plain or gzipped, are read too: one partition each.

Defined results: a null page is an empty payload; a null id has no id header and reads back as
null, and never is the largest; of rows that repeat id and payload one is the response; a null
url has no target header, and line ends in a url are percent-encoded; an empty table writes no
archive and reads back as no rows; other columns are ignored.
"""

import base64
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from ordermill.llm import bloom
from ordermill.llm.frames import packed, saved, ship

LEAST_BYTES = 1000
RANGE_BYTES = 64 << 20
CHUNK = 1 << 16
MANIFEST = "_manifest"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2026-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def opened(path):
    """File system and plain path of a local path or URI."""
    if path.startswith("file:"):
        path = path[5:].replace("///", "/", 1)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _record_id(page_id, digest):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(kind, page_id, url, payload, digest, size, refers_to, own_id):
    """The bytes of one record; a revisit holds the HTTP headers of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    encoded = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", _DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    headers += [("WARC-Payload-Digest", encoded), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-ID", refers_to))
    headers.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + _END


def member(data):
    """One gzip member whose header tells its compressed size and the size of its contents."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _written(batches, folder):
    """Write the rows of a task as one archive; its manifest row names where ranges begin."""
    context = TaskContext.get()
    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
    stream, ranges, size, count = None, [0], 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            if stream is None:
                system, path = opened(folder)
                system.create_dir(path, recursive=True)
                stream = system.open_output_stream(f"{path}/{name}", compression=None)
            kind = "revisit" if row["revisit"] else "response"
            own = _record_id(row["page_id"], row["digest"]) if row["named"] else f"<urn:uuid:{uuid.uuid4()}>"
            data = member(record(kind, row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["size"], row["refers_to"], own))
            if size - ranges[-1] >= RANGE_BYTES:
                ranges.append(size)
            stream.write(data)
            size, count = size + len(data), count + 1
    if stream is not None:
        stream.close()
        columns = [pa.array([name]), pa.array([count]), pa.array([size]), pa.array([ranges], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "records", "bytes", "ranges"])


def write_archives(pages, folder, id_col="page_id", url_col="url", html_col="html", least_bytes=LEAST_BYTES):
    """Write one record per page into archives of `folder`."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = packed(pages, page_id=id_col, url=url_col, payload=payload).drop("row")
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")}).withColumn(
        "key", F.when(F.col("size") >= least_bytes, F.xxhash64("digest"))
    )
    repeats = bloom.of_repeats(rows.where("key IS NOT NULL"), "key", pages.count())
    tested = repeats.tested(rows, "key", "again").drop("key")
    alone = tested.where("NOT again").withColumns({"refers_to": F.lit(None).cast(dict(rows.dtypes)["page_id"]), "revisit": F.lit(False)})
    again = tested.where("again")
    heads = again.groupBy("digest").agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("head"))
    # Saved, so that the join deals out both sides itself and can split a frequent payload.
    heads = saved(heads.select("digest", F.col("head.page_id").alias("refers_to")))
    first = F.row_number().over(Window.partitionBy(F.struct("digest", "page_id")).orderBy(F.lit(0))) == 1
    again = again.join(heads, "digest").withColumn("revisit", ~(F.col("page_id").eqNullSafe(F.col("refers_to")) & first))
    columns = ["page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "size", "refers_to", "revisit"]
    again = again.select(*columns, (~F.col("revisit")).alias("named"))
    both = alone.select(*columns, F.lit(False).alias("named")).unionByName(again)
    both.mapInArrow(lambda b: _written(b, folder), "name string, records long, bytes long, ranges array<long>").write.json(f"{folder}/{MANIFEST}")
    return folder


class Range(InputPartition):
    def __init__(self, path, start, end):
        self.path, self.start, self.end = path, start, end


# Columns of the source that are headers of a record, and so can be tested before its payload is read.
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "page_id": "x-page-id",
    "refers_to": "x-refers-to-page-id",
}


class WarcSource(DataSource):
    """Options: path; payload (true or false: leave payloads unread)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        texts = ", ".join(f"{c} string" for c in HEADER_COLUMNS)
        return f"{texts}, headers map<string,string>, http_length long, payload binary"

    def reader(self, schema):
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests = []

    def pushFilters(self, filters):
        for test in filters:
            known = len(test.attribute) == 1 and test.attribute[0] in HEADER_COLUMNS if hasattr(test, "attribute") else False
            if known and isinstance(test, (EqualTo, In, StringStartsWith)):
                self.tests.append(test)
            else:
                yield test

    def partitions(self):
        system, folder = opened(self.folder)
        listed = system.get_file_info(fs.FileSelector(f"{folder}/{MANIFEST}", allow_not_found=True))
        if not listed:
            found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            return [Range(x.path, 0, x.size) for x in found if x.path.endswith((".warc", ".warc.gz"))]
        out = []
        for info in listed:
            if not info.path.rsplit("/", 1)[1].startswith("part-"):
                continue
            with system.open_input_stream(info.path) as stream:
                for line in stream.read().decode().splitlines():
                    row = json.loads(line)
                    ends = [*row["ranges"][1:], row["bytes"]]
                    out += [Range(f"{folder}/{row['name']}", a, b) for a, b in zip(row["ranges"], ends, strict=True)]
        return out

    def _passes(self, values):
        for test in self.tests:
            value = values[test.attribute[0]]
            if isinstance(test, EqualTo):
                ok = value == test.value
            elif isinstance(test, In):
                ok = value in test.value
            else:
                ok = value is not None and value.startswith(test.value)
            if not ok or value is None:
                return False
        return True

    def read(self, partition):
        if partition is None:
            return
        system, _ = opened(self.folder)
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for values, headers, length, payload in self._records(file, partition.start, partition.end):
                rows.append((*values.values(), headers, length, payload))
                held += len(payload or b"")
                if held > 8 << 20 or len(rows) >= 2000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, file, start, end):
        at = start
        while at < end:
            file.seek(at)
            entry = _Member(file) if file.read(2) == b"\x1f\x8b" else _Plain(file, at)
            head = entry.until(_END)
            headers = _headers(head)
            values = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
            digest = values["payload_digest"]
            if digest and digest.startswith("sha1:") and len(digest) == 37:
                values["payload_digest"] = base64.b32decode(digest[5:]).hex()
            size = int(headers.get("content-length", 0))
            if self._passes(values):
                http, body = b"", None
                if headers.get("content-type", "").startswith("application/http") and size:
                    http = entry.until(_END)
                length = _headers(http).get("content-length")
                left = size - len(http)
                if self.payload and values["record_type"] != "revisit":
                    body = entry.take(left)
                yield values, headers, int(length) if length else None, body
            at = entry.next(len(head) + size + len(_END))


class _Member:
    """One gzip member, inflated only as far as is asked for."""

    def __init__(self, file):
        self.file, self.start, self.size = file, file.tell() - 2, None
        head = file.read(10)
        if head[1] & 4:
            extra = file.read(int.from_bytes(head[8:10], "little"))
            while len(extra) >= 4:
                length = int.from_bytes(extra[2:4], "little")
                if extra[:2] == b"sl" and length == 8:
                    self.size = int.from_bytes(extra[4:8], "little")
                extra = extra[4 + length :]
        file.seek(self.start)
        self.inflate, self.data = zlib.decompressobj(31), b""

    def _more(self):
        raw = self.inflate.unconsumed_tail or self.file.read(CHUNK)
        if not raw or self.inflate.eof:
            return False
        self.data += self.inflate.decompress(raw, CHUNK)
        return True

    def until(self, mark):
        while (found := self.data.find(mark)) < 0 and self._more():
            pass
        return self.take(found + len(mark) if found >= 0 else len(self.data))

    def take(self, count):
        parts, held = [self.data], len(self.data)
        while held < count:
            self.data = b""
            if not self._more():
                break
            parts.append(self.data)
            held += len(self.data)
        data = b"".join(parts)
        self.data = data[count:]
        return data[:count]

    def next(self, _):
        if self.size:
            return self.start + self.size
        while not self.inflate.eof:
            self.data = b""
            if not self._more():
                break
        return self.file.tell() - len(self.inflate.unused_data)


class _Plain:
    """A record that is not compressed."""

    def __init__(self, file, start):
        self.file, self.start = file, start
        file.seek(start)
        self.data = b""

    def until(self, mark):
        while (found := self.data.find(mark)) < 0:
            more = self.file.read(CHUNK)
            if not more:
                found = len(self.data)
                break
            self.data += more
        return self.take(found + len(mark))

    def take(self, count):
        if count > len(self.data):
            self.data += self.file.read(count - len(self.data))
        found, self.data = self.data[:count], self.data[count:]
        return found

    def next(self, size):
        return self.start + size


def _headers(block):
    """Header lines by lower-case name; the first line has none."""
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _batch(rows):
    names = [*HEADER_COLUMNS, "headers", "http_length", "payload"]
    types = [*[pa.string()] * len(HEADER_COLUMNS), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True))
    columns[len(HEADER_COLUMNS)] = [list(x.items()) for x in columns[len(HEADER_COLUMNS)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_archives(spark, folder, payload=True):
    """Records of the archives of a folder; tests on `HEADER_COLUMNS` are pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
