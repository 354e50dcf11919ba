"""Merge rules against a sequential replay of random writes."""

import random

from irloom.operators import merge


def test_symbol_upsert_replays(spark):
    rng = random.Random(7)
    rows = [(s, f"u{rng.randint(0, 40)}", int(rng.random() < 0.2), int(rng.random() < 0.3), f"n{s}") for s in range(600)]
    want = {}
    for _, usr, d, doc, name in rows:
        old = want.get(usr)
        keep = old and old[0] == 1 and d == 0
        want[usr] = (max(d, old[0]) if old else d, max(doc, old[1]) if old else doc, old[2] if keep else name)
    rng.shuffle(rows)
    got = merge.upsert_symbols(spark.createDataFrame(rows, "seq long, usr string, is_definition int, is_documented int, spelling string")).collect()
    assert {r.usr: (r.is_definition, r.is_documented, r.spelling) for r in got} == want


def test_group_upsert_replays(spark):
    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    rows = [(s, g := f"g{rng.randint(0, 15)}", rng.random() < 0.3, pick(g, f"t{s}"), pick("", f"b{s}"), pick("", f"d{s}"), pick(None, f"p{s}")) for s in range(400)]
    want = {}
    for _, g, d, *new in rows:
        if g not in want:
            want[g] = [d, *new]
            continue
        old = want[g]
        unset = [lambda x: x == g, lambda x: x == "", lambda x: x == "", lambda x: x is None]
        for i in range(3 + 1):
            if (d and old[0]) or (d and not unset[i](new[i])) or unset[i](old[i + 1]):
                old[i + 1] = new[i]
        old[0] = old[0] or d
    rng.shuffle(rows)
    got = merge.upsert_groups(spark.createDataFrame(rows, "seq long, id string, is_definition boolean, title string, brief string, detail string, parent string")).collect()
    assert {r.id: [r.is_definition, r.title, r.brief, r.detail, r.parent] for r in got} == want


def test_replace_by_nothing_deletes(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "key string, batch int, value string")
    touched = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "key string, batch int")
    assert [r.value for r in merge.replace_sets(rows, touched, "key").collect()] == ["y"]
