"""Sources, sinks, the lease and templates: what goes wrong, and what is left then."""

import time

import pytest
from pyspark.sql import functions as F

from irloom.operators import templates
from irloom.operators.lock import NAME, LockTimeoutError, build_lock
from irloom.sources import snapshot


def test_inputs_that_are_not_there(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "d").mkdir()
    assert [r.pos for r in snapshot.resolve_inputs(spark, [str(tmp_path / "a"), f"{tmp_path}/*"]).collect()] == [0]
    assert snapshot.resolve_inputs(spark, [str(tmp_path / "d")]).count() == 0
    with pytest.raises(snapshot.InputError, match="nothing"):
        snapshot.resolve_inputs(spark, [str(tmp_path / "a"), f"{tmp_path}/nothing*"])


@pytest.mark.parametrize("text", ["[]", "{", "", '{"a": 1}'])
def test_no_compile_commands(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(snapshot.InputError):
        snapshot.compile_commands(spark, str(tmp_path / "c.json"))


def test_snapshots_that_are_none(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(snapshot.NotFoundError):
        snapshot.read(spark, path)
    meta = spark.createDataFrame([("tool", "t")], "key string, value string")
    first = snapshot.write(spark, path, {"meta": meta})
    second = snapshot.write(spark, path, {"meta": meta})
    assert snapshot.current(spark, path) == second != first
    assert snapshot.drop_old(spark, path) == 1 and snapshot.drop_old(spark, path) == 0
    assert {r.key for r in snapshot.read(spark, path)["meta"].collect()} == {"tool", "schema_version"}


def test_lease(spark, tmp_path):
    for wrong in (0, -1, float("nan"), float("inf"), None):
        with pytest.raises(ValueError), build_lock(spark, str(tmp_path), wrong):
            pass
    with build_lock(spark, str(tmp_path), 5):
        with pytest.raises(LockTimeoutError, match="process"), build_lock(spark, str(tmp_path), 0.2):
            pass
    assert not (tmp_path / NAME).exists()
    (tmp_path / NAME).write_text("process of long ago")
    time.sleep(0.6)
    with build_lock(spark, str(tmp_path), 5, lease_seconds=0.5):  # its holder does not renew it
        assert "long ago" not in (tmp_path / NAME).read_text()
        time.sleep(0.8)
        with pytest.raises(LockTimeoutError), build_lock(spark, str(tmp_path), 0.2, lease_seconds=0.5):  # this one does
            pass
    with pytest.raises(KeyError), build_lock(spark, str(tmp_path), 5):
        raise KeyError
    assert not (tmp_path / NAME).exists()


def test_templates(spark):
    fields = {"a": F.col("a"), "b": F.col("b")}
    rows = spark.createDataFrame([("x", "y"), ("", None)], "a string, b string")
    text = templates.compiled("{# no #}<{{a}}>{% if b %}[{{ b }}{% if a %}!{% endif %}]{% endif %}", fields)
    assert [r.t for r in rows.select(text.alias("t")).collect()] == ["<x>[y!]", "<>"]
    for wrong in ("{{ c }}", "{% if a %}", "{% endif %}"):
        with pytest.raises(templates.TemplateError):
            templates.compiled(wrong, fields)
    with pytest.raises(templates.TemplateError):
        templates.find(spark, [], "no such kind")


def test_stems_until_free(spark):
    """A tagged stem that another name has by itself gets underscores until no name has it."""
    import hashlib

    from irloom.operators.aggregate import unique_stems

    tag = hashlib.sha256(b"x").hexdigest()[:8]
    rows = [("x", "s"), ("y", "S"), ("z", f"s_{tag}"), ("w", f"S_{tag}_"), ("v", "lone")]
    got = {r.name: r.stem for r in unique_stems(spark.createDataFrame(rows, "name string, s string"), F.col("s")).collect()}
    assert got["v"] == "lone" and len({s.lower() for s in got.values()}) == len(rows)
    assert got["x"].startswith(f"s_{tag}") and all(got[n].startswith(s) for n, s in rows)
