"""A part of the registered queries, at least one of each section, is held to its oracle by DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(v[i], 6) if isinstance(v[i], float) else v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", ["b4_children", "c3_file_roots", "c11_identity_drift", "c16_qualifiers", "d1_ancestors", "d3_include_closure", "e1_symbol_upsert", "e2_group_upsert", "e15_diagnostic_dedup", "f4_summary", "g7_unique_stems", "i2_content_hash", "a1_resolved_inputs", "a6_streamed_replace", "a8_compile_commands", "a12_documented_entities", "f13_directory_statistics", "i9_scope_suffix", "i10_repair_operators", "i11_strip_defaults", "i12_parenthesize", "i13_scope_arguments", "i14_top_level", "i15_parameter_names", "i32_plain_names", "i37_injected_names", "j4_command_words", "j5_fences", "j6_inline_markup", "j7_link_targets", "j11_command_classes", "k1_registered_parsers", "k2_overrides", "k3_other_parser", "k5_template_directories", "l9_render_validity", "l11_reset_caches", "l12_memo_modes", "m10_page_plan", "a7_touched_buckets", "a8_split_array", "a10_page_set", "a11_ordered_log", "l1_scanned_files", "l14_keyed_state", "l6_file_fingerprints"])
def test_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    from irloom.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_entry_point_imports():
    import __spark_entry__ as e

    assert "c3_file_roots" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
