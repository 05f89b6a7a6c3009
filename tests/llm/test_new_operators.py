"""Archives and their index, whitening, hard negatives: brute force on small tables, and odd rows."""

import base64
import glob
import gzip
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import hard_negatives, store, warc, whitening
from panelspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"
VECTOR = "vec_id long, label int, embedding array<double>"


def clashing(df, *names):
    return df.withColumns({c: F.lit("x") for c in names})


# 11

def brute_records(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html), rows without an id after all others."""
    payload = [(h or "").encode() for _, _, h in rows]
    first = {}
    for (i, _, _), p in zip(rows, payload, strict=True):
        if i is not None and len(p) >= least:
            first[p] = min(i, first.get(p, i))
    out = []
    for (i, _, _), p in zip(rows, payload, strict=True):
        refers = first[p] if p in first and first[p] != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_archives_and_index(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"http://h{i % 7}.example.org/p/{rng.integers(200)}?q={i % 5}", f"<p>{rng.integers(300)} é\r\n\r\nWARC/1.1</p>") for i in range(2500)]
    rows += [(5000 + i, "http://hot.example.org/", "<p>hot</p>") for i in range(1500)]  # one url, one payload
    rows += [(None, None, None), (None, "x y\nz", "<p>hot</p>"), (7001, None, ""), (7002, "", None), (7003, "mailto:a", "😀" * 40_000), (7003, "mailto:a", "😀" * 40_000), (7004, "//a.b", "😀" * 40_000)]
    df = clashing(spark.createDataFrame(rows, PAGE), "key", "file", "first", "sha", "payload", "n").repartition(5)
    index = warc.write_archives(df)
    everything = df.select(warc.surt(F.col("url")).alias("key")).distinct()
    captures = index.captures(everything)
    assert captures.count() == len(rows)
    found = index.read(captures)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute_records(rows) and found.filter("NOT intact").count() == 0
    texts = {r["page_id"]: bytes(r["payload"]) for r in found.filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(html[i] == p for i, p in texts.items()) and found.filter("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    # one url: the blocks that may hold it, no others
    one = spark.createDataFrame([(rows[17][1],), ("http://nowhere.example.org/",)], "url string").select(warc.surt(F.col("url")).alias("key"))
    assert sorted(r["page_id"] for r in index.captures(one).collect()) == [i for i, u, _ in rows if u == rows[17][1]]
    assert index.blocks(one).count() < index.blocks(everything).select("file", "offset").distinct().count()
    hot = spark.createDataFrame([("org,example,hot)/",)], "key string")
    assert index.captures(hot).count() == 1500 and index.blocks(hot).count() > 1
    # archives are members that any reader takes, one a record
    _, at = store.located(index.folder)
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{at}/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    assert sorted(index.firsts) == list(index.firsts) and sorted(index.lasts) == list(index.lasts)


def test_small_payloads_are_stored(spark):
    rows = [(1, "http://a/", "xx"), (2, "http://a/", "xx"), (3, "http://a/", "long enough"), (4, "http://b/", "long enough")]
    found = warc.archive_and_read(spark.createDataFrame(rows, PAGE), least=5).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr) == brute_records(rows, 5)
    dated = spark.createDataFrame([(1, "http://a/", "x", "2020-01-02T03:04:05Z"), (2, "http://a/", "y", None)], PAGE + ", at string")
    index = warc.write_archives(dated, date="at")
    assert {r["page_id"]: r["date"] for r in index.read(index.captures(spark.createDataFrame([("a)/",)], "key string"))).collect()} == {1: "2020-01-02T03:04:05Z", 2: warc.DATE}


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGE)
    assert warc.archive_and_read(empty).count() == 0 and warc.write_archives(empty).files == ()


def test_broken_records_are_told():
    data = warc.record(4, "http://a/ b", b"payload", None)
    assert warc.parse(data)["intact"] and warc.parse(data)["url"] == "http://a/%20b"
    assert not warc.parse(data.replace(b"payload", b"paylaod"))["intact"] and not warc.parse(data[:-1])["intact"]
    again = warc.parse(warc.record(9, None, b"payload", 4))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["payload"]) == ("revisit", 4, 7, None)
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_keys_of_urls(spark):
    want = {"http://WWW.Example.com:80/a?b#c": "com,example,www)/a?b", "https://x@h.org:8080": "org,h:8080)/", "mailto:x": "mailto:x", "//a.b": "b,a)/", "http://[::1]:80/z y": "[::1])/z%20y", "http://a.b.?q": "b,a)/?q", None: "", "": ""}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r["u"]: r["k"] for r in df.select("u", warc.surt(F.col("u")).alias("k")).collect()} == want


def test_ranges_are_read_together(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(bytes(range(256)) * 1000)
    reads = []

    class File:
        def __init__(self):
            self.f = open(path, "rb")

        def seek(self, at):
            reads.append(at)
            self.f.seek(at)

        def read(self, n):
            return self.f.read(n)

    wanted = [(0, 10), (10, 5), (20, 1), (200_000, 7), (200_007, 0)]
    assert list(store.ranges(File(), wanted)) == [(bytes(range(256)) * 1000)[a : a + n] for a, n in wanted] and reads == [0, 200_000]
    assert list(store.ranges(File(), [])) == []


# 12

def brute_whitening(rows, kept=16):
    usable = [(i, e) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    length = max((len(e) for _, e in usable), default=0)
    x = [[int(np.floor(float(c) * 64)) + 1_000_000 for c in e] + [1_000_000] * (length - len(e)) for _, e in usable]
    fit = sorted(set(map(tuple, x)))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = lambda v: [n * a - s for a, s in zip(v, total, strict=True)]
    c = np.array([far(v) for v in fit], float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = [o for o in np.argsort(-values)[:kept] if values[o] > values.sum() * len(values) * 1e-14]
    z = np.array([far(v) for v in x], float) / n @ axes[:, order] / np.sqrt(values[order])
    return [i for i, _ in usable], n, [sum(d * d for d in far(v)) for v in x], z, values[order] / values.sum()


def check_whitening(df, rows, kept=16):
    ids, n, deviation, z, share = brute_whitening(rows, kept)
    found = whitening.whiten(df, kept).toPandas()
    assert len(found) == len(ids) * z.shape[1] and set(found["n"]) == {n} and found["identity_error"].max() < 1e-9
    got = found.sort_values(["vec_id", "component"], kind="stable")
    order = np.argsort(ids, kind="stable")
    wide = got["whitened"].to_numpy().reshape(len(ids), -1)
    # repeated ids of different rows are in any order
    if len(set(ids)) == len(ids):
        sign = np.sign((wide * z[order]).sum(0))
        assert np.abs(wide * sign - z[order]).max() < 1e-8
        assert got["deviation"].to_numpy()[:: z.shape[1]].tolist() == [deviation[o] for o in order]
    assert np.allclose(got["explained"].to_numpy()[: z.shape[1]], share, rtol=1e-9)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, base[i % 300 if i < 350 else i].tolist()) for i in range(400)]  # fifty copies
    rows += [(500, None), (501, [1.0] * 19 + [None]), (502, [float("nan")] * 20), (503, [float("inf")] + [0.0] * 19), (504, [0.5] * 3), (505, [])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "x", "part", "place", "index", "centred")
    check_whitening(df.repartition(7), rows)
    check_whitening(df.repartition(1), rows, 3)


def test_whitening_of_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        assert whitening.whiten(df(rows)).count() == 0
    two = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])]
    found = whitening.whiten(df(two)).collect()
    assert sorted((abs(round(r["whitened"], 9)), r["component"], r["n"], round(r["explained"], 9)) for r in found) == [(1.0, 1, 2, 1.0)] * 3
    assert {r["deviation"] for r in found} == {2 * 64**2} and any(r["vec_id"] is None for r in found)
    far = [(i, [1e12 * i, float(i % 3)]) for i in range(10)]
    assert {r["deviation"] for r in whitening.whiten(df(far)).collect()} == {None}  # beyond longs
    middling = [(i, [1e6 * i, float(i % 3)]) for i in range(10)]
    check_whitening(df(middling), middling)


# 13

def brute_negatives(rows, anchors, positives=5, negatives=3):
    length = max((len(e) for _, _, e in rows if e), default=0)

    def usable(table):
        return [(i, k, np.array([int(np.floor(c * 256)) for c in e] + [0] * (length - len(e)))) for i, k, e in table if None not in (i, k, e) and all(c is not None and np.isfinite(c) for c in e)]

    table, asked = usable(rows), {}
    for i, k, v in usable(anchors):
        asked[i] = min(asked.get(i, (k, v.tolist())), (k, v.tolist()))
    out = []
    for a, (label, v) in asked.items():
        score = sorted((-int(np.dot(v, x)), i, k) for i, k, x in table if i != a)
        for s, p, _ in [t for t in score if t[2] == label][:positives]:
            near = [t for t in score if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(near)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))
    rows = [(i, int(rng.integers(4)), x[i].tolist()) for i in range(900)]
    rows += [(1000 + i, i % 2, x[3].tolist()) for i in range(300)]  # a large group of copies: ties
    rows += [(2000, None, x[1].tolist()), (2001, 1, None), (2002, 1, [float("nan")] * 16), (2003, 1, [None] * 16), (None, 1, x[2].tolist()), (2004, 1, x[5].tolist()[:4]), (2005, 2, []), (2006, 9, x[7].tolist())]
    rows += rows[40:43] + [(100, 3, x[8].tolist())]
    df = clashing(spark.createDataFrame(rows, VECTOR), "v", "x", "run", "place", "score", "path").repartition(6)
    anchors = df.filter("vec_id % 50 = 0 OR vec_id = 2006")
    found = sorted(tuple(r) for r in hard_negatives.mine(df, anchors).collect())
    want = brute_negatives(rows, [r for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] == 2006)])
    assert found == want and len(found) > 200


def test_hard_negatives_of_odd_tables(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (3, 2, [-1.0, 0.0]), (4, 1, [-2.0, 0.0])], VECTOR)
    anchor = df.filter("vec_id = 0")
    assert [tuple(r) for r in hard_negatives.mine(df, anchor).collect()] == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert hard_negatives.mine(df.limit(0), anchor).count() == 0 and hard_negatives.mine(df, anchor.limit(0)).count() == 0
    assert hard_negatives.mine(df.filter("label = 1"), anchor).count() == 0  # no other label
    assert hard_negatives.mine(df.filter("label = 2"), anchor).count() == 0  # no positives
    zero = spark.createDataFrame([(0, 1, [0.0]), (1, 1, [3.0]), (2, 2, [5.0]), (3, 2, [])], VECTOR)
    assert [tuple(r) for r in hard_negatives.mine(zero, zero.filter("vec_id = 0")).collect()] == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]


def test_only_blocks_that_a_window_meets_are_read(spark, monkeypatch):
    """Clusters far apart: the intervals of most blocks miss the windows."""
    rng = np.random.default_rng(2)
    x = np.concatenate([8 * np.eye(8)[i] + 0.1 * rng.normal(size=(256, 8)) for i in range(8)])
    curve = hard_negatives.Curve(x)
    order = np.argsort(curve.places(x), kind="stable")
    blocks = x[order].reshape(-1, 64, 8)
    _, above = hard_negatives.intervals(x[:1], blocks.min(1), blocks.max(1))
    score = (blocks @ x[0]).max(1)
    assert (above[0] >= score).all() and (above[0] > 0.5 * score.max()).sum() <= 8  # of 32


def test_curve_goes_from_neighbour_to_neighbour():
    for dims, bits in ((2, 5), (3, 3), (6, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", ["op11_warc", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    found = QUERIES[name](spark, SF)
    columns = ", ".join(found.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want)) and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(spark.read.parquet(f"{SF}/embeddings.parquet"), rows)
    assert QUERIES["op12_whitening"](spark, SF).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
