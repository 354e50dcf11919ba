"""Archives, capture index and reads by range against what was put in."""

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest

from irloom.llm import warc

SCHEMA = "page_id long, url string, html string, key int, file string, digest string"


def sha(html):
    return hashlib.sha256((html or "").encode()).hexdigest()


def odd_pages():
    rng = random.Random(81)
    page = lambda: "<p>" + "".join(rng.choice("abc dé\r\n") for _ in range(rng.randint(0, 400)))
    urls = [None, "", "no url at all", "http://a.example/x y\nz", "HTTPS://User@WWW.Example.COM:8080/Q?a=b#frag", "http://one.example", "http://one.example/", "ftp://é.example/ü"]
    rows = [(i, rng.choice(urls) if rng.random() < 0.5 else f"http://h{rng.randint(0, 5)}.example/{i % 40}", page()) for i in range(120)]
    same = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 100
    rows += [(200 + i, "http://hot.example/", same) for i in range(90)]  # one payload, one URL
    rows += [(300, None, None), (301, "u", ""), (302, "u", "s" * 99), (303, "u", "s" * 99), (304, "v", "s" * 100), (305, "w", "s" * 100)]
    rows += [(304, "v", "s" * 100)] * 2 + [(305, "w", "s" * 100), (None, "n", "s" * 100), (None, "n", "t" * 200), (310, "big", "é" * 700_000)]
    return rows


def want_of(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        of = first.get(html)
        again = of is not None and of != i
        out.append((i, "revisit" if again else "response", len((html or "").encode()), sha(html), of if again else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "d") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    """With hot payloads either way of joining; small blocks, archives and reads."""
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", broadcast)
    rows = odd_pages()
    folder = str(tmp_path / "w")
    got = [tuple(r) for r in warc.round_trip(frame(spark, rows), folder).collect()]
    assert sorted(got, key=repr) == sorted(want_of(rows), key=repr)


def test_archives_are_whole_and_sequential(spark, tmp_path):
    rows = odd_pages()
    captures = warc.write(frame(spark, rows), str(tmp_path), archive_bytes=3000).collect()
    assert len(captures) == len(rows)
    by_file = {}
    for c in captures:
        by_file.setdefault(c.file, []).append((c.offset, c.length, c.page_id))
    assert len(by_file) > 10
    for name, places in by_file.items():
        data = (Path(tmp_path) / name).read_bytes()
        places.sort()
        assert gzip.decompress(data)[:8] == b"WARC/1.1"  # members one after another
        end = places[0][0]
        assert warc.parse(zlib.decompress(data[:end], 31))[0]["warc-type"] == "warcinfo"
        for at, n, page_id in places:
            assert at == end
            fields, block = warc.parse(zlib.decompress(data[at : at + n], 31))
            assert fields.get("x-page-id") == (None if page_id is None else str(page_id))
            assert (fields["warc-type"] == "revisit") == ("warc-refers-to" in fields) == (block.partition(b"\r\n\r\n")[2] == b"" and fields["warc-payload-digest"] != "sha256:" + sha(""))
            end += n
        assert end == len(data)


@pytest.mark.parametrize("lines", [1, 7, 5000])
def test_lookup_by_page_and_by_url(spark, tmp_path, lines):
    rows = odd_pages()
    pages = frame(spark, rows)
    captures = warc.write(pages, str(tmp_path / "a"))
    idx = warc.index(captures, str(tmp_path / "i"), block_lines=lines)
    every = [tuple(r) for r in captures.collect()]
    asked = [("no such key", 5), ("", None), ("example,hot)/", 200), ("example,hot)/", 9999), ("example,hot)/", None), ("zzzz", 1), ("n", None)]
    keys = spark.createDataFrame(asked, "key string, page_id long")
    exact = [tuple(r) for r in warc.find(keys, idx).collect()]
    assert sorted(exact, key=repr) == sorted((c for c in every for q in asked if c[:2] == q), key=repr)
    under = [tuple(r) for r in warc.find(keys.dropDuplicates(["key"]), idx, every=True).collect()]
    assert sorted(under, key=repr) == sorted((c for c in every if c[0] in {q[0] for q in asked}), key=repr) and len(under) > 90
    payloads = {r.page_id: r.payload for r in warc.fetch(warc.find(keys.where("page_id = 200"), idx), str(tmp_path / "a"), with_payload=True).collect()}
    assert payloads[200].decode() == next(h for i, _, h in rows if i == 200)


def test_keys(spark):
    cases = {"http://www.Example.com/A?b=C#d": "com,example,www)/A?b=C", "https://u:p@x.org:81": "org,x:81)/", "plain text": "plain%20text", None: "-", "http://a.b/c d": "b,a)/c%20d", "": ""}
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.k for r in rows.select("url", warc.capture_key(rows.url).alias("k")).collect()} == cases


def test_reads_of_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("b", 25, 100), ("b", 125, 60)]
    assert list(warc.ranges(iter(rows), 100)) == [("a", 0, [10, 5]), ("a", 20, [5]), ("b", 25, [100]), ("b", 125, [60])]
    assert list(warc.ranges(iter([]))) == []


def test_damage_is_noticed(spark, tmp_path):
    captures = warc.write(frame(spark, [(1, "http://a.example/", "x" * 500)]), str(tmp_path))
    c = captures.first()
    path = Path(tmp_path) / c.file
    fields, block = warc.parse(zlib.decompress(path.read_bytes()[c.offset :], 31))
    other = warc.member(warc.record(1, b"http://a.example/", b"y" * 500, fields["warc-payload-digest"][7:], None, None))
    path.write_bytes(path.read_bytes()[: c.offset] + other)
    at = spark.createDataFrame([(c.key, 1, c.file, c.offset, len(other))], warc.CAPTURES)
    with pytest.raises(Exception, match="not the one that was written"):
        warc.fetch(at, str(tmp_path)).collect()
    lost = spark.createDataFrame([(2, "revisit", None, "d", 1)], warc.RECORDS)
    with pytest.raises(Exception, match="no response"):
        warc.resolved(lost).collect()


def test_empty(spark, tmp_path):
    assert warc.round_trip(frame(spark, []), str(tmp_path / "w")).collect() == []
