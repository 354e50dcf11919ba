"""Steps whose work or memory must not grow with more than their input."""

import tracemalloc
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from irloom.functions import grammar, rewrite
from irloom.operators import graph, merge, signatures
from irloom.sources import outputs, snapshot


def _symbols(spark, rows):
    ddl = "usr string, parent_usr string, kind int, spelling string, display_name string, signature string"
    return spark.createDataFrame([(u, p, k, u, u + a, h) for u, p, k, a, h in rows], ddl)


def test_only_parents_are_walked_up_from(spark, monkeypatch):
    seen, walk = [], graph.ancestors
    monkeypatch.setattr(signatures.graph, "ancestors", lambda symbols: seen.append({r.usr for r in symbols.collect()}) or walk(symbols))
    rows = [("n", "", 1, "", ""), ("c", "n", 2, "<T>", "template<T>"), ("f", "c", 6, "", "f()"), ("g", "f", 9, "", ""), ("x", None, 6, "", ""), ("y", "gone", 6, "", "")]
    rows += [("a", "b", 1, "", ""), ("b", "a", 1, "", ""), ("i", "a", 6, "", ""), ("s", "s", 1, "", ""), ("t", "s", 6, "", "")]
    found = {r.usr: (r.heads, r.qualified) for r in signatures.member_qualifiers(_symbols(spark, rows)).collect()}
    head = "template<T> "
    assert found == {
        "n": ("", "n"), "c": ("", "n::c"), "f": (head, "n::c<T>::f"), "g": (head, "n::c<T>::g"), "x": ("", "x"), "y": ("", "y"),
        "a": ("", "b::a"), "b": ("", "a::b"), "i": ("", "b::a::i"), "s": ("", "s"), "t": ("", "s::t"),
    }
    assert seen == [{"n", "c", "f", "a", "b", "s"}]


def test_equal_texts_of_a_batch_are_rewritten_once():
    calls = []
    out = rewrite.text_udf(lambda x: calls.append(x) or x.upper()).func(pd.Series(["a", None, "b", "a"] * 3, dtype=object))
    assert list(out) == ["A", None, "B", "A"] * 3 and calls == ["a", "b"]


def test_comments_are_structs_a_few_at_a_time(spark, monkeypatch):
    made = []

    def rows():
        texts = [None, "", "x" * 600_000, *["/// @brief A b.\n/// @param[in] c d\n/// @ingroup e"] * 20_000]
        yield pa.array(texts)

    def handed_on():
        for out in grammar.parse_column("raw", lambda raw: made.append(raw) or grammar.parse(raw)).run(rows()):
            sizes.append((len(out), len(made)))
            yield from out.to_pylist()

    sizes = []
    monkeypatch.setattr(grammar.F, "arrow_udf", lambda run, kind: lambda *columns: SimpleNamespace(run=run))
    found = list(handed_on())
    assert [n for n, _ in sizes][:3] == [2, 1, grammar.SLICE_ROWS] and max(n for n, _ in sizes) == grammar.SLICE_ROWS
    assert sum(n for n, _ in sizes) == len(found) == 20_003 and sizes[0][1] == 2
    assert found[0] == found[1] and found[2]["brief"] == "x" * 600_000
    assert found[-1]["param"] == [{"name": "c", "description": "d", "direction": "in"}] and found[-1]["custom"] == [("ingroup", ["e"])]


def test_parsers_by_row_over_several_runs(spark):
    raw = spark.range(3000).selectExpr("id", "concat('/// a ', id, '  b') AS raw", "CASE id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'none' END AS which").repartition(1)
    which = grammar.parse_each(F.col("raw"), F.col("which"), {"plain": lambda x: grammar.plain(x) | {"custom": {"k": ["v"]}}})
    for r in raw.select("id", which.alias("c")).collect():
        assert r.c.brief == f"a {r.id} b" and r.c.custom == ({"k": ["v"]} if r.id % 3 == 0 else {}) and r.c.param == []


def test_files_are_put_without_unpacking_a_batch(tmp_path):
    texts = [f"{n} \u00e9\U0001f600" + "x" * 100_000 for n in range(200)] + ["", None]
    (tmp_path / "f201").write_text("to go")
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{n}" for n in range(202)]), pa.array(texts)], names=["name", "text"])
    put = outputs._putter(f"file://{tmp_path}")
    tracemalloc.start()
    done = [b.column(0).to_pylist() for b in put(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == [[202]] and peak < 4_000_000
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"f{n}": x for n, x in enumerate(texts) if x is not None}


def test_found_inputs_are_no_work_of_python_tasks(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n * 3)
    found = snapshot.resolve_inputs(spark, [f"{tmp_path}/b", f"{tmp_path}/*"])
    assert [(r.pos, r.path[-1], r.length) for r in found.orderBy("pos").collect()] == [(0, "b", 3), (1, "a", 3)]
    for df in (found, outputs.recorded(spark, f"{tmp_path}/none")):
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_symbols_of_deleted_files_go_by_their_file(spark, tmp_path):
    symbols = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 1)], "usr string, file_id long")
    references = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "a")], "from_usr string, to_usr string")
    kept = merge.delete_files({"symbols": symbols, "references": references}, spark.createDataFrame([(1,)], "id long"), {"references": "from_usr"})
    assert sorted(r.usr for r in kept["symbols"].collect()) == ["b", "c"] and sorted(r.from_usr for r in kept["references"].collect()) == ["b", "x"]
    assert "hashpartitioning(usr" not in kept["symbols"]._jdf.queryExecution().executedPlan().toString()
    version = snapshot.write(spark, str(tmp_path), {"symbols": symbols})
    part = next((tmp_path / version / "symbols").glob("*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"
