"""Sinks and sources that keep what did not change: what stands after a crash, what is read, what is written."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from irloom.operators import merge
from irloom.sources import buckets, jsonarray, outputs
from irloom.sources.snapshot import InputError, NotFoundError
from irloom.streaming import ingest

SYMBOLS, REFERENCES = "usr string, file_id long, name string", "from_usr string, to_usr string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path)
    symbols = [(f"s{i}", None if i % 9 == 0 else i % 7, f"n{i}") for i in range(80)]
    refs = [(f"s{i % 90}", f"s{i % 5}") for i in range(200)]  # some hang on symbols that are not there
    tables = {"symbols": spark.createDataFrame(symbols, SYMBOLS), "references": spark.createDataFrame(refs, REFERENCES)}
    with pytest.raises(NotFoundError):
        buckets.read(spark, path, tables)
    one = buckets.create(spark, path, tables, 4)
    assert {n: rows_of(df) for n, df in buckets.read(spark, path, tables).items()} == {"symbols": sorted(symbols, key=repr), "references": sorted(refs, key=repr)}
    fresh = [("s1", 1, "again"), ("t9", 9, "new")]  # files 1 and 9 are in one bucket
    two = buckets.replace_files(spark, path, {"symbols": spark.createDataFrame(fresh, SYMBOLS), "references": spark.createDataFrame([("t9", "s1")], REFERENCES)}, spark.createDataFrame([(1,)], "id long"))
    gone = {u for u, f, _ in symbols if f == 1}
    now = buckets.read(spark, path, tables)
    assert rows_of(now["symbols"]) == sorted([r for r in symbols if r[1] != 1] + fresh, key=repr)
    assert rows_of(now["references"]) == sorted([r for r in refs if r[0] not in gone] + [("t9", "s1")], key=repr)
    assert {(r.table, r.bucket): r.state for r in buckets.changed_folders(spark, path, one, two).collect()} == {(t, b): "written" if b == 1 else "reused" for t in tables for b in range(5)}
    assert rows_of(buckets.read(spark, path, tables, one)["symbols"]) == sorted(symbols, key=repr)  # a reader that is left on the first version
    assert buckets.drop_unnamed(spark, path) == 2 and buckets.drop_unnamed(spark, path) == 0
    assert rows_of(buckets.read(spark, path, tables)["symbols"]) == rows_of(now["symbols"])


class StoppedError(Exception):
    pass


@pytest.mark.parametrize("step", ["staged", "intended", "half", "applied", "switched"])
def test_page_set_after_a_crash(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "out")
    page = lambda *rows: spark.createDataFrame(list(rows), "name string, text string")
    assert outputs.put_pages(spark, path, page(("a", "1"), ("b", "2"), ("c", "3"))) == 3
    stands = lambda: {n: (tmp_path / "out" / n).read_text() for n in os.listdir(path) if not n.startswith(".")}
    before = (tmp_path / "out" / "b").stat().st_mtime_ns

    def after(done):
        if done == step:
            raise StoppedError
        if step == "half" and done == "intended":  # some files were put already
            (tmp_path / "out" / "a").write_text("new")
            raise StoppedError

    with pytest.raises(StoppedError):
        outputs.put_pages(spark, path, page(("a", "new"), ("b", "2"), ("d", "4")), after)
    assert outputs.recover(spark, path) == (step != "staged") and not outputs.recover(spark, path)
    first, second = {"a": "1", "b": "2", "c": "3"}, {"a": "new", "b": "2", "d": "4"}
    assert stands() == (first if step == "staged" else second)
    assert {r.name: r.digest for r in outputs.recorded(spark, path).collect()} == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in stands().items()}
    assert outputs.put_pages(spark, path, page(("a", "new"), ("b", "2"), ("d", "4"))) == (3 if step == "staged" else 0)
    assert stands() == second and (tmp_path / "out" / "b").stat().st_mtime_ns == before  # what did not change was not touched
    assert outputs.put_pages(spark, path, page()) == 3 and stands() == {}


def test_scan_reads_what_differs(spark, tmp_path):
    for n in "abcd":
        (tmp_path / n).write_text(n * 10)
    listed = outputs.listing(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    first = outputs.scan(spark.createDataFrame([], "path string, mtime_ns long, size long, sha256 string"), listed)
    kept = {os.path.basename(r.path): r for r in first.collect()}
    assert {n: (r.status, r.was_read) for n, r in kept.items()} == dict.fromkeys("abcd", ("new", True))
    stored = [(r.path, r.mtime_ns - (n == "b"), r.size, r.sha256) for n, r in kept.items()]
    (tmp_path / "c").write_text("other")
    (tmp_path / "d").unlink()
    again = outputs.scan(spark.createDataFrame(stored, "path string, mtime_ns long, size long, sha256 string"), outputs.listing(spark, str(tmp_path)), started_ns=10**18)
    got = {os.path.basename(r.path): r for r in again.collect()}
    assert {n: (r.status, r.was_read) for n, r in got.items()} == {"a": ("same", False), "b": ("healed", True), "c": ("changed", True), "d": ("gone", False)}
    assert got["c"].sha256 == hashlib.sha256(b"other").hexdigest() and got["a"].mtime_ns is None  # too young to be trusted


def test_log_text(spark, tmp_path):
    records = [(0, 3, 0, "a: bad"), (1, 1, 1, "note\nsecond line"), (2, 2, 0, ""), (3, 2, 0, "last\n")]
    path = str(tmp_path / "log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few lines are several parts
    try:
        for at in ("x", "y"):
            outputs.write_log(spark, path, spark.createDataFrame(records, "pos long, severity int, depth int, text string").repartition(3), 2, at, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted((n for n in os.listdir(path) if not n.startswith((".", "_"))), key=lambda n: (n != "header.txt", n))
    text = "".join((tmp_path / "log" / n).read_text() for n in names)
    assert text == "# diagnostics\n# generated: y\n# inputs: 2 file(s)\n# parse: incremental, 1 of 2 translation unit(s) re-parsed\n# totals: 1 note(s), 2 warning(s), 1 error(s)\n\na: bad\n  note\n  second line\n\n\n\nlast\n"
    assert len(names) > 2 and os.listdir(tmp_path) == ["log"]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_array_by_splits(spark, tmp_path, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "a", "é", ",", "\n", "\\\\"]) for _ in range(rng.randint(0, 8)))
    entries = [{"id": i, "s": word(), "n": {"x": [word(), {"y": word()}]}} for i in range(6 if size == 1 else 25)]
    data = json.dumps(entries, indent=rng.choice([None, 2]), ensure_ascii=False).encode()
    (tmp_path / "a.json").write_bytes(data)
    got = jsonarray.read(spark, str(tmp_path / "a.json"), "id int, s string, n struct<x:array<string>>", size).collect()
    assert sorted((r.id, r.s, r.n.x[0]) for r in got) == [(e["id"], e["s"], e["n"]["x"][0]) for e in entries]
    assert {r.digest for r in got} == {hashlib.sha256(data).hexdigest()}


def test_ranges_are_bounded(spark, tmp_path):
    """A long file has longer ranges, not more of them, and they still cover it."""
    (tmp_path / "a.json").write_bytes(b"[" + b'{"id": 1},' * 2000 + b'{"id": 2}]')
    cuts = jsonarray.ranges(spark, str(tmp_path / "a.json"), 2)
    assert len(cuts) <= 1024 and sum(n for _, _, _, n in cuts) == 20_011
    assert [c[2] for c in cuts[1:]] == [c[2] + c[3] for c in cuts[:-1]]


@pytest.mark.parametrize("text", ["", "[]", "[1, 2]", '{"a": 1}', '[{"a": 1}', '[{"a": "]'])
def test_arrays_that_are_none(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(InputError):
        jsonarray.read(spark, str(tmp_path / "a.json"), "a int", 3)


def test_keyed_state_survives_restarts(spark, tmp_path):
    """Started anew after each few files, late and repeated rows among them; the same as one fold over all."""
    rng, schema = random.Random(88), "seq long, usr string, is_definition int, is_documented int, spelling string"
    writes = [(i, f"u{rng.randint(0, 12)}", rng.randint(0, 1), rng.randint(0, 1), f"w{i}") for i in range(120)]
    rng.shuffle(writes)
    frame = spark.createDataFrame(writes, schema)
    for at in range(0, 120, 40):
        spark.createDataFrame(writes[at : at + 40] + writes[:at:7], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "log"))
        kept = ingest.keep_symbols(spark, str(tmp_path / "log"), frame.schema, str(tmp_path / "state"), 1)
    assert rows_of(kept.select("usr", "spelling", "is_definition", "is_documented")) == rows_of(merge.upsert_symbols(frame.withColumn("at", F.col("seq"))).select("usr", "spelling", "is_definition", "is_documented"))
    assert spark.conf.get(ingest.PROVIDER, None) != ingest.ROCKSDB
