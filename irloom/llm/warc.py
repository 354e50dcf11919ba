"""Web archives: WARC files with revisits, a two-level capture index, and reads by range.

Writing: each task appends its pages, a gzip member a record, to archives of about ARCHIVE_BYTES
in one folder that all executors share, and returns where each record lies. A payload of
REVISIT_BYTES or more that was seen under a smaller page id becomes a revisit, whose record has
the digest and the first record's id but no payload. Files carry the attempt's number: what
a failed attempt wrote is never referred to.

Index: captures are sorted by key, the URL with its host reversed (`com,example)/a?b`), over
all tasks by range. Each range becomes one file of compressed blocks of BLOCK_LINES captures, and behind
them the block directory: first capture, place and length of each block. The driver keeps one row a file, its
first capture and where its directory is; their number is that of the session's shuffle partitions.

Lookup: the files' first captures tell which file has a key; queries are dealt by range of file and key,
so a file that most queries need is shared out; a task reads the file's directory, finds a block
by binary search, reads just its range, and finds the lines by binary search again. Records are
then read by range, neighbours in one read, and checked against their digests.

The folder's scheme must be one of pyarrow's file systems (a local or mounted path, hdfs, s3, gs).

Cases: a null payload is empty; empty and short payloads are always responses; rows that repeat page id
and payload are the same capture, each a response if the smallest, else each a revisit of it; a page
without id is never referred to; a null or malformed URL is its own key; equal keys go by page id; a
long payload is one record; an empty table has archives and index without captures; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import cut, text_batches

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 2000
#: Neighbouring records are fetched in reads of up to so many bytes.
READ_BYTES = 4 << 20
#: Payloads that repeat are broadcast up to so many; beyond it they are joined with SALTS salts.
BROADCAST_REPEATS, SALTS = 50_000, 32
DATE = "1970-01-01T00:00:00Z"
# Names and profile of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def capture_key(url: Column) -> Column:
    """The URL without scheme, user and fragment, its host in lower case and reversed; spaces and controls are encoded."""
    part = lambda n: F.regexp_extract(url, URL, n)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    key = F.when(F.rlike(url, F.lit(URL)), F.concat(host, part(2), F.lit(")"), F.when(part(3) == "", F.lit("/")).otherwise(part(3)))).otherwise(url)
    return F.regexp_replace(F.coalesce(key, F.lit("-")), r"[\x00-\x20\x7f]", "%20")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _lines(first: str, fields: dict[str, str | None]) -> bytes:
    return (first + "\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields.items() if v is not None) + "\r\n").encode("utf-8", "replace")


def _clean(url: bytes | None, page_id: int | None) -> str:
    """A target URI that fits on a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url.decode("utf-8", "replace")) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: bytes | None, payload: bytes, digest: str, first: int | None, first_url: bytes | None, date: str = DATE) -> bytes:
    """A response, or where `first` is given a revisit of that page's record."""
    again = first is not None
    http = _lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    body = http if again else http + payload
    head = {
        "WARC-Type": "revisit" if again else "response", "WARC-Record-ID": record_id(page_id, digest + ("-revisit" if again else "")), "WARC-Date": date, "WARC-Target-URI": _clean(url, page_id),
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Profile": PROFILE if again else None, "WARC-Refers-To": record_id(first, digest) if again else None, "WARC-Refers-To-Target-URI": _clean(first_url, first) if again else None,
        "X-Page-ID": str(page_id) if page_id is not None else None, "X-Refers-To-Page": str(first) if again else None, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
    }
    return _lines(VERSION, head) + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = {n.lower(): v for n, v in (line.split(": ", 1) for line in lines)}
    n = int(fields["content-length"])
    if first != VERSION or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {first!r}")
    return fields, rest[:n]


def _with_firsts(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, key, url, payload and, of payloads that a page with a smaller id has, that page as `first`."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), capture_key(F.col(url_col)).alias("key"), F.col(url_col).cast("binary").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    seen = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("of"), F.count("*").alias("n"))
    seen = cut(seen.where("n > 1 AND of IS NOT NULL").select(F.col("digest").alias("r_digest"), F.col("of.page_id").alias("first"), F.col("of.url").alias("first_url")))
    same = F.col("digest") == F.col("r_digest")
    if seen.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS:
        rows = rows.join(F.broadcast(seen), same, "left")
    else:
        salted = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("r_salt")), "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "key", "url", "payload", "digest", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Writes the archives below `folder`; the captures: key, page_id, file, offset and length of every record."""
    text_batches(pages.sparkSession)

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        task, n, out, name, at = TaskContext.get(), 0, None, "", 0
        try:
            for batch in batches:
                cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                files, places, lengths = [], [], []
                for j in range(batch.num_rows):
                    data = member(record(*(cols[c][j].as_py() for c in ("page_id", "url", "payload", "digest", "first", "first_url")), date))
                    if out is None or at + len(data) > archive_bytes and at > 0:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.gz"
                        out, n = fs.open_output_stream(f"{base}/{name}", compression=None), n + 1
                        info = member(_lines(VERSION, {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, name), "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": "0"}) + b"\r\n\r\n")
                        out.write(info)
                        at = len(info)
                    out.write(data)
                    files.append(name)
                    places.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([cols["key"], cols["page_id"], pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return cut(_with_firsts(pages, id_col, url_col, html_col, least).mapInArrow(run, CAPTURES))


Capture = tuple[bytes, bool, int]  # key, whether there is a page id, page id


def _capture(key: str, page_id: int | None) -> Capture:
    return key.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


def _line(line: bytes) -> tuple[Capture, tuple]:
    key, page, name, offset, length = line.split(b" ")
    page_id = None if page == b"-" else int(page)
    return (key, page_id is not None, page_id or 0), (page_id, name.decode(), int(offset), int(length))


class Index:
    """The files of an index in order: first capture of each, and where its block directory lies."""

    def __init__(self, folder: str, files: list[tuple[Capture, str, int, int]]):
        self.folder, self.files = folder, sorted(files)

    def parts_of(self, low: Capture, high: Capture) -> range:
        """The files that may hold captures from low to high."""
        firsts = [f[0] for f in self.files]
        return range(max(bisect.bisect_left(firsts, low) - 1, 0), bisect.bisect_right(firsts, high))


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts the captures into files of compressed blocks with a directory behind them."""

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, out, at, directory, held, first = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx", None, 0, [], [], None

        def put(lines: list[bytes]) -> int:
            data = zlib.compress(b"\n".join(lines))
            out.write(data)
            directory.append([*lines[0].split(b" ", 2)[:2], at, len(data)])
            return at + len(data)

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        out, first = fs.open_output_stream(f"{base}/{name}", compression=None), row
                    page = "-" if row["page_id"] is None else row["page_id"]
                    held.append(f"{row['key']} {page} {row['file']} {row['offset']} {row['length']}".encode("utf-8", "surrogatepass"))
                    if len(held) == block_lines:
                        at, held = put(held), []
            if out is not None:
                if held:
                    at = put(held)
                listed = zlib.compress(json.dumps([[k.decode("utf-8", "surrogatepass"), p.decode(), *place] for k, p, *place in directory]).encode())
                out.write(listed)
                yield pa.RecordBatch.from_pylist([{"key": first["key"], "page_id": first["page_id"], "file": name, "offset": at, "length": len(listed)}], schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    order = ["key", "page_id", "file", "offset"]
    files = cut(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, CAPTURES))
    return Index(folder, [(_capture(r.key, r.page_id), r.file, r.offset, r.length) for r in files.collect()])  # a row a file


class _File:
    """One index file: its directory, and the block that was read last."""

    def __init__(self, folder: str, entry: tuple[Capture, str, int, int]):
        fs, base = file_system(folder)
        _, name, at, n = entry
        self.source = fs.open_input_file(f"{base}/{name}")
        listed = json.loads(zlib.decompress(self.source.read_at(n, at)))
        self.firsts = [_capture(k, None if p == "-" else int(p)) for k, p, _, _ in listed]
        self.places = [(at, n) for _, _, at, n in listed]
        self.number, self.lines, self.keys = -1, [], []

    def block(self, k: int) -> None:
        if k != self.number:
            at, n = self.places[k]
            parsed = [_line(x) for x in zlib.decompress(self.source.read_at(n, at)).split(b"\n")]
            self.number, self.keys, self.lines = k, [c for c, _ in parsed], [x for _, x in parsed]

    def between(self, low: Capture, high: Capture) -> Iterator[tuple]:
        k = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while k < len(self.firsts) and self.firsts[k] <= high:
            self.block(k)
            for i in range(bisect.bisect_left(self.keys, low), bisect.bisect_right(self.keys, high)):
                yield self.lines[i]
            k += 1


LAST = (True, 1 << 63)


def find(queries: DataFrame, idx: Index, every: bool = False) -> DataFrame:
    """The captures of (key, page_id); with `every`, of the key under any page id. Queries should be distinct."""
    ends = lambda key, page_id: ((k := _capture(key, page_id))[:1] + (False, 0), k[:1] + LAST) if every else ((k := _capture(key, page_id)), k)

    def route(batches):
        for batch in batches:
            out = [(q["key"], q["page_id"], n) for q in batch.to_pylist() for n in idx.parts_of(*ends(q["key"], q["page_id"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["key", "page_id", "part"])

    def look(batches):
        part, file = None, None
        for batch in batches:
            out = []
            for q in batch.to_pylist():
                if q["part"] != part:
                    part, file = q["part"], _File(idx.folder, idx.files[q["part"]])
                out += [(q["key"], *found) for found in file.between(*ends(q["key"], q["page_id"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])

    order = ["part", "key", "page_id"]
    routed = cut(queries.select("key", F.col("page_id").cast("long").alias("page_id")).mapInArrow(route, "key string, page_id long, part int"))
    return routed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(look, CAPTURES)


def ranges(rows: Iterator[tuple[str, int, int]], most: int = READ_BYTES) -> Iterator[tuple[str, int, list[int]]]:
    """Records by place put together to reads of neighbours: file, offset and the records' lengths."""
    name, at, lengths = None, 0, []
    for file, offset, length in rows:
        if lengths and (file != name or offset != at + sum(lengths) or sum(lengths) + length > most):
            yield name, at, lengths
            lengths = []
        if not lengths:
            name, at = file, offset
        lengths.append(length)
    if lengths:
        yield name, at, lengths


def fetch(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at the given places, with their own payload's size and digest; of a revisit, the digest that its header has.

    with_payload adds the payload, which a revisit lacks. A payload that is not its digest's is an error.
    """
    text_batches(captures.sparkSession)

    def run(batches):
        fs, base = file_system(folder)
        name, source, out, held = None, None, [], 0
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 6 if with_payload else 5]
        names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: len(kinds)]
        give = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        places = ((r["file"], r["offset"], r["length"]) for batch in batches for r in batch.to_pylist())
        for file, at, lengths in ranges(places):
            if file != name:
                name, source = file, fs.open_input_file(f"{base}/{file}")
            data = source.read_at(sum(lengths), at)
            start = 0
            for n in lengths:
                fields, block = parse(zlib.decompress(data[start : start + n], 31))
                start += n
                kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and hashlib.sha256(payload).hexdigest() != stated:
                    raise ValueError(f"{file} at {at}: the payload is not the one that was written")
                number = lambda f: int(fields[f]) if f in fields else None  # noqa: E731, B023
                out.append((number("x-page-id"), kind, None if payload is None else len(payload), stated, number("x-refers-to-page"), payload)[: len(kinds)])
                held += len(payload or b"") if with_payload else 64
            if held > READ_BYTES:
                yield give()
                out, held = [], 0
        yield give()

    order = ["file", "offset"]
    return captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, RECORDS + (", payload binary" if with_payload else ""))


def resolved(records: DataFrame) -> DataFrame:
    """The records, revisits with the size of the payload that they refer to. One response may have most revisits, so they are salted."""
    same = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    asked = again.select(F.col("refers_to").alias("a_id"), F.col("payload_digest").alias("a_digest")).distinct()
    found = same.join(asked, (F.col("page_id") == F.col("a_id")) & (F.col("payload_digest") == F.col("a_digest"))).select("a_id", "a_digest", F.col("payload_bytes").alias("a_bytes")).distinct()
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("a_salt"))
    full = again.join(found, (F.col("refers_to") == F.col("a_id")) & (F.col("payload_digest") == F.col("a_digest")) & (F.col("salt") == F.col("a_salt")), "left")
    size = F.coalesce("a_bytes", F.raise_error(F.lit("a revisit refers to no response")).cast("long"))
    return same.unionByName(full.select("page_id", "record_type", size.alias("payload_bytes"), "payload_digest", "refers_to"))


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and index below `folder`, looks every page up and reads its record back."""
    idx = index(write(pages, f"{folder}/archives", id_col, url_col, html_col), f"{folder}/index")
    asked = pages.select(capture_key(F.col(url_col)).alias("key"), F.col(id_col).cast("long").alias("page_id")).distinct()
    return resolved(cut(fetch(cut(find(asked, idx)), f"{folder}/archives")))
