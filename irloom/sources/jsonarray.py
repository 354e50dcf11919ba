"""A8: one JSON array of objects read by many tasks, cut by byte ranges at the ends of objects.

Where a range starts, no task knows whether it is inside a text. So each range is first read under both
assumptions, which gives how it would end and how deep it would have gone; the driver chains these, a few
numbers a range, from the first one on. Then each range is read knowing its start: a task takes the elements that begin in its
range and reads on for the end of its last one. The digest of the whole file comes from a reading of its own, in
chunks, and holds for the elements too: each range's bytes have to have the same digest in all readings.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.operators.state import cut
from irloom.sources.outputs import file_system
from irloom.sources.snapshot import InputError, _fs

SPLIT_BYTES = 32 << 20
#: Ranges at the most: the driver holds a few numbers of each, and a longer file has longer ranges.
MOST_RANGES = 1024
CHUNK = 1 << 20
#: Bytes read at a time behind the end of a range, for the rest of its last element.
TAIL = 1 << 14
#: What matters to the structure; an escaped character is passed over with its backslash.
INSIDE, OUTSIDE = re.compile(rb'\\.|"', re.DOTALL), re.compile(rb'["{}\[\]]')


class State:
    """Whether a text is open, whether its next character is escaped, and how deep brackets are."""

    def __init__(self, in_text: bool = False, escaped: bool = False, depth: int = 0):
        self.in_text, self.escaped, self.depth = in_text, escaped, depth

    def marks(self, data: bytes):
        """Go through data; yields (place, mark, depth behind it) of every bracket outside texts."""
        at = 0
        if self.escaped and data:
            at, self.escaped = 1, False
        while at < len(data):
            if self.in_text:
                if m := INSIDE.search(data, at):
                    at = m.end()
                    self.in_text = m[0] != b'"'
                else:
                    # A backslash at the very end escapes what comes next.
                    tail = len(data) - len(data.rstrip(b"\\"))
                    begun = len(data) - at
                    self.escaped = min(tail, begun) % 2 == 1
                    return
            elif m := OUTSIDE.search(data, at):
                at, mark = m.end(), m[0]
                if mark == b'"':
                    self.in_text = True
                else:
                    self.depth += 1 if mark in b"{[" else -1
                    yield m.start(), mark, self.depth
            else:
                return


def ranges(spark: SparkSession, path: str, split_bytes: int) -> list[tuple[str, int, int, int]]:
    """(file, number, start, length) of the ranges of a file, of split_bytes or, where these were too many, longer."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise InputError(f"no file {path}")
    name, size = fs.getFileStatus(p).getPath().toString(), fs.getFileStatus(p).getLen()
    split_bytes = max(split_bytes, -(-size // MOST_RANGES))
    return [(name, n, start, min(split_bytes, size - start)) for n, start in enumerate(range(0, size, split_bytes))]


def _chunks(source, start: int, length: int, end: int | None = None):
    while length > 0:
        data = source.read_at(min(CHUNK, length) if end is None else min(CHUNK, length, max(end - start, TAIL)), start)
        if not data:
            return
        yield start, data
        start, length = start + len(data), length - len(data)


def _probe(batches):
    """How each range ends from either start, its digest; for the number -1 the digests of the whole file and of its ranges."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            fs, name = file_system(r["file"])
            with fs.open_input_file(name) as source:
                h = hashlib.sha256()
                ends = [State(), State(in_text=True), State(in_text=True, escaped=True)] if r["number"] >= 0 else []
                every = []
                part, left = hashlib.sha256(), r["split"]
                for _, data in _chunks(source, r["start"], r["length"]):
                    h.update(data)
                    for s in ends:
                        for _ in s.marks(data):
                            pass
                    data = memoryview(data)
                    while r["number"] < 0 and data:
                        part.update(data[:left])
                        data, left = data[left:], left - min(left, len(data))
                        if left == 0:
                            every.append(part.hexdigest())
                            part, left = hashlib.sha256(), r["split"]
                if r["number"] < 0 and left < r["split"]:
                    every.append(part.hexdigest())
            out.append({"number": r["number"], "digest": h.hexdigest(), "ends": [[int(s.in_text), int(s.escaped), s.depth] for s in ends], "parts": every})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("number", pa.int32()), ("digest", pa.string()), ("ends", pa.list_(pa.list_(pa.int64()))), ("parts", pa.list_(pa.string()))]))


def _elements(batches):
    """The objects that begin in each range at the array's own depth, each as a text, and the range's digest."""
    for batch in batches:
        for r in batch.to_pylist():
            fs, name = file_system(r["file"])
            found, begun, held, h = [], None, bytearray(), hashlib.sha256()
            with fs.open_input_file(name) as source:
                state = State(bool(r["in_text"]), bool(r["escaped"]), r["depth"])
                end, done = r["start"] + r["length"], False
                for at, data in _chunks(source, r["start"], r["size"] - r["start"], end):
                    if at < end:
                        h.update(data[: end - at])
                    last = 0
                    for place, mark, depth in state.marks(data):
                        if mark == b"{" and depth == 2 and begun is None:
                            if at + place >= end:
                                done = True
                                break
                            begun, last = at + place, place
                        elif mark == b"}" and depth == 1 and begun is not None:
                            held += data[last : place + 1]
                            found.append((begun, held.decode()))
                            begun, held = None, bytearray()
                    if begun is not None:
                        held += data[last:]
                    if done or at + len(data) >= end and begun is None:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([r["number"]] * (len(found) + 1), pa.int32()), pa.array([b for b, _ in found] + [None], pa.int64()), pa.array([t for _, t in found] + [None], pa.string()), pa.array([None] * len(found) + [h.hexdigest()], pa.string())], names=["number", "at", "text", "range_digest"])


def read(spark: SparkSession, path: str, schema: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The objects of the array at `path` by a schema, with `digest`, the hash of the file's bytes. An array without any, or a file that is none, is an error."""
    cuts = ranges(spark, path, split_bytes)
    if not cuts:
        raise InputError(f"{path} is empty")
    size, split_bytes = sum(n for _, _, _, n in cuts), cuts[0][3]
    todo = spark.createDataFrame([*((*c, split_bytes) for c in cuts), (cuts[0][0], -1, 0, size, split_bytes)], "file string, number int, start long, length long, split long").repartition(len(cuts) + 1)
    probed = {r.number: r for r in todo.mapInArrow(_probe, "number int, digest string, ends array<array<bigint>>, parts array<string>").collect()}  # a few numbers a range
    if [probed[n].digest for _, n, _, _ in cuts] != probed[-1].parts:
        raise InputError(f"{path} changed while it was read")
    fs, name = file_system(cuts[0][0])
    with fs.open_input_file(name) as source:
        if not source.read_at(min(size, 64), 0).lstrip().startswith(b"["):
            raise InputError(f"{path} is no JSON array")
    rows, at = [], (0, 0, 0)
    for file, number, start, length in cuts:
        rows.append((file, number, start, length, size, *at))
        text, escaped, depth = probed[number].ends[at[0] + at[1]]
        at = (text, escaped, at[2] + depth)
    if at != (0, 0, 0):
        raise InputError(f"{path} is cut off")
    starts = spark.createDataFrame(rows, "file string, number int, start long, length long, size long, in_text int, escaped int, depth int").repartition(len(rows))
    found = cut(starts.mapInArrow(_elements, "number int, at long, text string, range_digest string"))
    again = {r.number: r.range_digest for r in found.where("text IS NULL").collect()}  # a digest a range
    if any(again[n] != probed[n].digest for _, n, _, _ in cuts):
        raise InputError(f"{path} changed while it was read")
    objects = found.where("text IS NOT NULL").select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("e"))
    if objects.isEmpty():
        raise InputError(f"{path} holds no objects")
    return objects.select("e.*", F.lit(probed[-1].digest).alias("digest"))


def write(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """One file with the entries (at, entry) in order as a JSON array, an entry a line; for small databases and tests: one task writes it."""

    def run(batches):
        fs, name = file_system(path)
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        n = 0
        with fs.open_output_stream(name, compression=None) as out:
            out.write(b"[\n")
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write((",\n" if n else "").encode() + text.encode())
                    n += 1
            out.write(b"\n]\n")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    entries.coalesce(1).sortWithinPartitions("at").select("entry").mapInArrow(run, "n long").collect()
