"""Trees, page plans, fragments and fingerprints against plain recursion."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from irloom.operators import fingerprints as fp
from irloom.operators import graph, plan, render, tree

SYMBOLS = "usr string, parent_usr string, kind int, spelling string, qualified_name string, display_name string, signature string, is_documented int, file_id long, line long, content_hash string"


def frame(spark, rows):
    return spark.createDataFrame([(u, p, k, n, q, n, g, d, f, i, hashlib.sha256(f"{u}{n}{d}".encode()).hexdigest()) for u, p, k, n, q, g, d, f, i in rows], SYMBOLS)


def sample(seed=91, n=160):
    """usr, parent, kind, spelling, qualified, signature, documented, file, line: namespaces, records and leaves, names that clash, one parent with most children."""
    rng, rows, open_ = random.Random(seed), [], []
    for i in range(n):
        kind = rng.choice([1, 1, 2, 3, 16, 5, 6, 10, 11, 13, 18, 9])
        up = None if rng.random() < 0.15 or not open_ else ("s0" if rng.random() < 0.4 else rng.choice(open_))
        if i == 0:
            kind, up = 1, ""
        parent_kind = next((r[2] for r in rows if r[0] == up), 1)
        if kind == 1 and parent_kind != 1:
            kind = 2
        name = rng.choice(["A", "a", "B", "b_c", "b::c", "operator+", "Duo<C>", "Duo<C*>", "index"])
        above = next((r[4] for r in rows if r[0] == up), "")
        rows.append((f"s{i}", up, kind, name, f"{above}::{name}" if above else name, rng.choice(["", "f(int)", "f()"]), rng.randint(0, 1), rng.choice([1, 2]), rng.randint(1, 9)))
        if kind in (1, 2, 3, 16):
            open_.append(f"s{i}")
    return rows


def children_of(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[8], r[4], r[0])):
        out[r[1] or ""].append(r)
    return out


def test_intervals_are_preorder(spark):
    rows = [*sample(), ("x1", "x2", 2, "x", "x", "", 1, 1, 1), ("x2", "x1", 2, "x", "x", "", 1, 1, 1), ("y", "gone", 2, "y", "y", "", 1, 1, 1)]  # a cycle and a parent that is not there
    got = {r.usr: r for r in tree.intervals(plan.shown(frame(spark, rows)).withColumn("mark", F.col("usr")), ["kind", "line", "qualified_name"], ["mark"]).collect()}
    kids = children_of(rows)
    want = {}

    def walk(r, root, depth, at):
        first = at
        for c in kids[r[0]]:
            at = walk(c, root, depth + 1, at + 1)
        want[r[0]] = (root, depth, first, at - first + 1)
        return at

    for r in kids[""]:
        walk(r, r[0], 0, 0)
    assert {u: (r.mark, r.depth, r.start, r.size) for u, r in got.items()} == want and "x1" not in got and "y" not in got
    assert tree.intervals(plan.shown(frame(spark, rows[:0])), ["kind"]) is None
    line = sorted(tree.intervals(plan.shown(frame(spark, rows)), ["kind", "line", "qualified_name"], one_line=True).collect(), key=lambda r: r.start)
    assert [r.start for r in line] == list(range(len(want)))


def brute_stems(names, reserved):
    """Stems in the order of the walk, by two passes."""
    import re

    slug = lambda n: re.sub("[^0-9A-Za-z]+", "_", n).strip("_") or "global"
    digest = lambda n: hashlib.sha256(n.encode()).hexdigest()[:8]

    def stem(n, tag=""):
        x, room = slug(n), 96 - (len(tag) + 1 if tag else 0)
        return (x[: room - 9].rstrip("_") + "_" + digest(n) if len(x) > room else x) + (f"_{tag}" if tag else "")

    claims = collections.defaultdict(set)
    for n in names:
        claims[stem(n).lower()].add(n)
    seen, out = {r.lower() for r in reserved}, []
    for n in names:
        x = stem(n, digest(n)) if len(claims[stem(n).lower()]) > 1 else stem(n)
        while x.lower() in seen:
            x += "_"
        seen.add(x.lower())
        out.append(x)
    return out


@pytest.mark.parametrize("reserved", [[], ["index"], ["index", "index_", "A", "same__"]])
def test_stems(spark, reserved):
    rng = random.Random(92)
    names = [rng.choice(["index", "A", "a", "same", "same", "Duo<C>", "Duo<C*>", "x" * 120, "x" * 119 + "y", "X" * 120, "", "::"]) for _ in range(60)]
    pages = spark.createDataFrame([(f"p{i}", n, [(i, "")]) for i, n in enumerate(names)], "page string, name string, place array<struct<n:bigint,text:string>>")
    got = {r.page: r.stem for r in plan.with_stems(pages, reserved).collect()}
    assert [got[f"p{i}"] for i in range(len(names))] == brute_stems(names, reserved)


def brute_namespace_plan(rows):
    kids, pages = children_of(rows), []
    suffix = lambda r: ""  # noqa: E731, ARG005

    def lump(code, label, scope, members, out):
        if members:
            where = scope[4] if scope else ""
            key = (f"{where}::{code}" if where else code)
            pages.append((key, f"{label} in `{where}`" if where else f"{label} in the global namespace", [m[0] for m in sorted(members, key=lambda m: (m[3], m[5]))]))
            out.append((len(pages) - 1, label))

    def scope(at, members):
        out = []
        for n in sorted((m for m in members if m[2] == 1), key=lambda m: m[3]):
            inner = scope(n, kids[n[0]])
            if inner or n[6]:
                pages.append((n[4], f"Namespace `{n[4]}`", [n[0]]))
                out.append((len(pages) - 1, n[3]))
                hubs[n[0]] = inner
        for r in sorted((m for m in members if m[2] in (2, 3, 4, 16)), key=lambda m: m[3]):
            pages.append((r[4] + suffix(r), "", [r[0]]))
            out.append((len(pages) - 1, r[3]))
        named, ops = collections.defaultdict(list), []
        for f in (m for m in members if m[2] in (5, 6, 7, 8, 15)):
            (ops if f[3].startswith("operator") else named[f[3]]).append(f)
        for name in sorted(named):
            over = sorted(named[name], key=lambda m: m[5])
            pages.append((over[0][4], f"Function `{over[0][4]}`", [m[0] for m in over]))
            out.append((len(pages) - 1, name))
        lump("operators", "Operators", at, ops, out)
        lump("types", "Types", at, [m for m in members if m[2] in (11, 13, 14, 17)], out)
        lump("constants", "Constants", at, [m for m in members if m[2] in (10, 18)], out)
        lump("other", "Other", at, [m for m in members if m[2] in (0, 9, 12)], out)
        return out

    hubs = {}
    scope(None, kids[""])
    return pages, hubs


def test_namespace_plan(spark):
    rows = sample(93)
    pages, seeds, entries = plan.namespace_plan(frame(spark, rows))
    pages = plan.with_stems(pages, ["index"])
    walked = plan.numbered(pages, [], ["place", "page"]).orderBy("position").collect()
    want, hubs = brute_namespace_plan(rows)
    stems = brute_stems([n for n, _, _ in want], ["index"])
    assert [(r.name, r.title, r.stem) for r in walked] == [(n, t, s) for (n, t, _), s in zip(want, stems, strict=True)]
    shown = collections.defaultdict(list)
    for r in plan.numbered(seeds.select("page", "usr", "place"), ["page"], ["place", "usr"]).orderBy("position").collect():
        shown[r.page].append(r.usr)
    assert [shown[r.page] for r in walked] == [s for _, _, s in want]
    linked = collections.defaultdict(list)
    for r in plan.hub_entries(entries, pages).orderBy("position").collect():
        linked[r.scope].append((r.stem, r.caption))
    assert dict(linked) == {u: [(stems[i], c) for i, c in inner] for u, inner in hubs.items() if inner}
    assert any(r[6] and not hubs.get(r[0], True) for r in rows if r[2] == 1)  # a documented namespace without anything is there


def brute_symbol_pages(rows):
    """Each root's page: (usr, depth, degraded) in order, by the registry of names."""
    kids, out = children_of(rows), {}
    cls = lambda k: "function" if k in (5, 6, 7, 8, 15) else render.s.DIRECTIVE.get(k, "cpp:type")
    for root in kids[""]:
        seen, page = {}, []

        def walk(r, depth, seen=seen, page=page):
            bad = False
            if r[2] != 1 and (r[4] or r[3]):
                first = seen.setdefault(r[4] or r[3], (r[0], cls(r[2])))
                bad = first[0] != r[0] and not first[1] == cls(r[2]) == "function"
            page.append((r[0], depth, bad))
            if not bad and r[2] in (1, 2, 3, 4, 16):
                for c in kids[r[0]]:
                    walk(c, depth + 1)

        walk(root, 0)
        out[root[0]] = page
    return out


@pytest.mark.parametrize("seed", [94, 95])
def test_fragments_of_nested_pages(spark, seed):
    """Records that are degraded hide what is below them, which then declares nothing."""
    rows = sample(seed, 220)
    symbols = frame(spark, rows)
    pages, seeds = plan.symbol_plan(symbols)
    found = render.fragments(symbols, pages, seeds)
    got = collections.defaultdict(list)
    for r in found.orderBy("page", "position", "offset", "part", "piece").collect():
        got[r.page].append(r)
    by = {r[0]: r for r in rows}
    want = brute_symbol_pages(rows)
    assert set(got) == set(want) and any(bad and by[u][2] in (2, 3, 16) for page in want.values() for u, _, bad in page)
    for page, shown in want.items():
        heads = [(r.text.strip("\n").split(" ")[0], r.text.split("`")[1]) for r in got[page] if r.part == render.HEAD]
        assert heads == [("#" * min(d + 1, 6), by[u][4] or by[u][3]) for u, d, _ in shown]
        assert ["cpp\n" in r.text[:10] for r in got[page] if r.part == render.BODY] == [bad for _, _, bad in shown]
        text = "".join(r.text for r in got[page])
        assert "\n\n\n" not in text and text.startswith("# ") and text.endswith("\n")
    whole = {(r.page, r.block): r.text for r in render.page_texts(found, 7).collect()}
    longest = max(got, key=lambda p: len(got[p]))
    assert "".join(whole[longest, b] for b in range(-(-len(got[longest]) // 7))) == "".join(r.text for r in got[longest])


def test_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(render, "PIECE", 3)
    items = spark.createDataFrame([("u", i, f"i{i}") for i in range(8)] + [("v", 0, "x"), ("w", 0, "")], "usr string, ordinal int, item string")
    got = collections.defaultdict(str)
    for r in render.listed(items, ["ordinal"], "Lead ").orderBy("usr", "piece").collect():
        got[r.usr] += r.text
    assert got == {"u": "Lead i0, i1, i2, i3, i4, i5, i6, i7.\n\n", "v": "Lead x.\n\n"}


def test_closure_reads_its_edges_once(spark):
    """A chain of ten rounds, whose edges are made once and not once a round."""
    made = spark.sparkContext.accumulator(0)

    def step(n):
        made.add(1)
        return n + 1

    edges = spark.range(10).select(F.col("id").alias("src"), F.udf(step, "long")("id").alias("dst"))
    found = graph.closure(edges, spark.range(1).select(F.col("id").alias("node")))
    assert sorted((r.node, r.depth) for r in found.collect()) == [(n, n) for n in range(11)] and made.value == 10


def test_long_lists_stay_whole(spark):
    """A record with a few thousand related functions has one text, as its page shows it."""
    n = 2001
    items = spark.range(n).select(F.lit("u").alias("usr"), F.col("id").alias("ordinal"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("item"))
    got = render.listed(items, ["ordinal"], "Lead ").collect()
    assert [(r.piece, r.text) for r in got] == [(0, "Lead " + ", ".join(f"i{i}" for i in range(n)) + ".\n\n")]


def marks(spark, rows, refs, related, enums, files):
    symbols = frame(spark, rows)
    references = spark.createDataFrame(refs, "from_usr string, ref_kind int, to_usr string, to_spelling string, access int, ordinal int")
    own = fp.own_digests(symbols, references, spark.createDataFrame(related, "usr string, other string, key int, rank int"), spark.createDataFrame(enums, "usr string, enum_usr string, name string, value long, value_is_signed boolean, idx int"), wide=True)
    pages, seeds, entries = plan.namespace_plan(symbols)
    pages = plan.with_stems(pages)
    contents = plan.hub_entries(entries, pages).select(F.concat(F.lit("hub\x1f"), "scope").alias("page"), "position", "stem")
    paths = spark.createDataFrame([(r.page, p) for r in pages.select("page", "name").collect() for n, p in files.items() if r.name == n], "page string, path string")
    return fp.page_fingerprints(pages, seeds, fp.subtree_digests(symbols, own), contents, files=paths).cache()


def test_fingerprints_follow_what_pages_show(spark, monkeypatch):
    monkeypatch.setattr(fp, "RUN", 2)  # lists in many runs
    n = lambda u, p, k, name, d=1: (u, p, k, name, f"{p}::{name}" if p else name, "", d, 1, 1)
    rows = [n("N", "", 1, "N"), n("A", "N", 2, "A"), n("B", "N", 2, "B"), n("M", "A", 6, "m"), n("I", "A", 3, "I"), n("J", "I", 9, "j"), n("E", "N", 11, "E"), n("F", "N", 5, "f"), n("G", "", 5, "g"), *(n(f"X{i}", "B", 9, f"x{i}") for i in range(7))]
    refs = [("B", 0, "A", "A", 1, 0), ("G", 1, None, "int", 0, 0)]
    related, enums, files = [("A", "F", 0, 0)], [("E1", "E", "one", 1, True, 0)], {"N::A": "a/x.hpp"}
    page = {"A": "record\x1fA", "B": "record\x1fB", "N": "hub\x1fN", "E": "lump\x1fN\x1f4", "F": "function\x1fN\x1ff", "G": "function\x1f\x1fg"}
    before = marks(spark, rows, refs, related, enums, files)

    def stale(rows=rows, refs=refs, related=related, enums=enums, files=files):
        return {(r.page, r.state) for r in fp.stale_pages(marks(spark, rows, refs, related, enums, files), before).collect()}

    edit = lambda u, **new: [tuple(new.get(c, x) for c, x in zip(("usr", "parent", "kind", "name", "qualified", "signature", "documented", "file", "line"), r, strict=True)) if r[0] == u else r for r in rows]
    changed = lambda *names: {(page[x], "changed") for x in names}
    assert stale(edit("J", documented=0)) == changed("A")  # a leaf two levels below a record
    # A base changes the page of what inherits it, too; an enumerator's value and a written target only their own.
    assert stale(edit("A", documented=0), [refs[0], ("G", 1, None, "long", 0, 0)], related, [("E1", "E", "one", 2, True, 0)]) == changed("A", "B", "E", "G")
    assert stale(edit("F", documented=0)) == changed("F", "A")  # what relates to A
    rest = [r for r in edit("X5", line=2) if r[0] != "G"]  # wide tokens hold lines
    assert stale([*rest, n("K", "N", 2, "K")], refs[:1], files={"N::A": "b/x.hpp"}) == changed("A", "B", "N") | {("record\x1fK", "new"), (page["G"], "gone")}
