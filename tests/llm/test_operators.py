"""Operators for training data: edge cases, and results against brute force on small fixtures."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import bpe, embed_dedup, html_extract, jaccard_join, lang_id, line_dedup, packing, quality, substring_dedup, topk
from panelspark.llm.components import connected_components
from panelspark.llm.queries import QUERIES, tokenizer_file
from panelspark.llm.runtime import Scratch

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, pool=5000):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, pool, n)]


def docs_of(spark, texts, sources=None, clash=True):
    rows = [(i, t, "en", (sources[i] if sources else f"s{i % 3}"), len(t) if t else 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    names = ("n_words", "n_removed", "score", "held_out", "predicted", "lang_pred", "n_lines", "key", "path", "h", "rep", "_n")
    return df.withColumns({c: F.lit("x") for c in names}) if clash else df


ODD = [None, "", " \n\t ", "one", "a b c", "É" * 9, "x" * 30_000, "y " * 20_000, "\x00\x1c 　 z", None, "a b c"]


# 1

def brute_lines(texts, sources, least):
    sites, first = defaultdict(set), {}
    for i, t in enumerate(texts):
        for p, line in enumerate(t.split("\n") if t is not None else []):
            key = line.strip(" ")
            if key:
                if sources[i] is not None:
                    sites[key].add(sources[i])
                first.setdefault(key, (i, p))
    out = {}
    for i, t in enumerate(texts):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines = t.split("\n")
        kept = [x for p, x in enumerate(lines) if not x.strip(" ") or len(sites[x.strip(" ")]) < least or first[x.strip(" ")] == (i, p)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(1)
    shared = {s: [f"line {s} {j}" for j in range(4)] for s in (2, 9, 10, 11, 25)}
    texts, sources = [], []
    for i in range(400):
        own = [f"own {i} {j}" for j in range(3)] + [""]
        for s, lines in shared.items():
            if i % 40 < s:
                own += [f" {x} " if i % 2 else x for x in rng.permutation(lines)[:3]] * (1 + i % 2)
        texts.append("\n".join(own))
        sources.append(f"site{i % 40}" if i % 7 else None)
    texts += ODD
    sources += ["z"] * len(ODD)
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_boilerplate(docs_of(spark, texts, sources)).collect()}
    assert found == brute_lines(texts, sources, 10)


def test_line_dedup_repeated_rows_and_empty(spark):
    df = docs_of(spark, ["a\nb"] * 2).unionByName(docs_of(spark, ["a\nb"] * 2))
    assert line_dedup.remove_boilerplate(df).count() == 4
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


# 2

def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    alphabet = list("aAstrevmldé字ß 5٣\n\t  ''''!?.- 　\x1c😀")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(500)] + ODD + ["don't'll we'reREAD 's", "''s", "a's's", "  \n\n"]
    df = docs_of(spark, texts)
    rows = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        starts = np.frombuffer(r["offsets"], "<u4")
        assert starts[-1] == len(text.encode()) and (np.diff(starts) > 0).all()
    nulls = bpe.encode(df.limit(2).withColumn("doc_id", F.lit(None).cast("long")), path)
    assert nulls.filter("doc_id IS NULL").count() == 2 and bpe.encode(df.limit(0), path).count() == 0


def test_long_pieces_merge_as_short_ones():
    vocabulary = bpe.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    pieces = [b"ab" * 31, b"internationalisation" * 3, b"=" * 64, bytes(range(256))[:60], b"a", b"aaaaa"]
    assert vocabulary.merge(pieces) == [vocabulary.merge_long(p) for p in pieces]
    assert vocabulary.merge([]) == []


def test_bpe_of_very_long_texts_in_segments(monkeypatch):
    """Long texts take little memory and have the library's ids, wherever segments and groups of pieces end."""
    import resource

    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(22)
    known = bpe.Vocabulary(path)
    mixed = "".join(rng.choice(list("aAstrevmldé字5\n  ''!"), 3000))
    with monkeypatch.context() as m:
        for size in (7, 100):
            m.setattr(bpe, "SEGMENT", size)
            m.setattr(bpe, "PIECES", size + 4)
            m.setattr(bpe, "CACHE_BYTES", 20_000)
            texts = [mixed, None, "", mixed[:50], "it's", mixed[:7], " "]
            for text, (ids, offsets) in zip(texts, known.encode(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")
                assert np.frombuffer(offsets, "<u4")[-1] == len((text or "").encode())
    long = " ".join(f"w{i}" for i in rng.integers(0, 10**5, 780_000))
    assert len(long) > 5_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (ids, _), (word, _) = known.encode([long, "x" * 1_000_000])
    assert known.decode([ids, word]) == [long.encode(), b"x" * 1_000_000]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(long)
    assert known.held < bpe.CACHE_BYTES + 60_000_000


# 3

def brute_embeddings(rows, cosine=0.9):
    ok = {i: np.pad(np.asarray(v, float), (0, 32 - len(v))) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    link = {i: set() for i, _ in rows}
    for a in ids:
        for b in ids:
            if a < b and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine:
                link[a].add(b)
                link[b].add(a)
    out = {}
    for i in link:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(link[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("tile", [4096, 16])
def test_embedding_dedup_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 32))
    rows = [(i, [float(x) for x in np.float32(centre[i % 12] * (0.5 + i % 3) + rng.normal(size=32) * 0.35)]) for i in range(150)]
    rows += [(200 + i, list(rows[5][1])) for i in range(30)]
    rows += [(350, [1.0]), (351, [2.0, 0.0]), (352, [])]
    rows += [(300, None), (301, [0.0] * 32), (302, [float("nan")] * 32), (303, [None] * 32), (304, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rep": F.lit(1), "cell": F.lit("a"), "kept": F.lit(0)})
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert found == brute_embeddings(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embed_dedup.near_duplicates(df.filter("vec_id = 300")).first()["component_id"] == 300


# 4

def brute_jaccard(texts, width=5, least=0.8):
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall(t.lower()) if t else []
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a].add(b)
                    links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("tile", [1024, 8])
def test_jaccard_join_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", tile)
    rng = np.random.default_rng(4)
    texts = list(ODD)
    common = words(60, 99)
    for g in range(25):
        base = words(120, g)
        for c in range(int(rng.integers(1, 9))):
            copy = list(base)
            for p in rng.integers(0, 120, int(rng.integers(0, 6))):
                copy[p] = f"edit{g}-{c}-{p}"
            texts.append(" ".join(copy))
    big = words(150, 77)
    for c in range(60):
        copy = list(big)
        copy[int(rng.integers(0, 150))] = f"v{c}"
        texts.append(" ".join(copy))
    texts += [" ".join(common + words(100, 1000 + i)) for i in range(30)]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs_of(spark, texts)).collect()}
    assert found == brute_jaccard(texts)


def test_jaccard_join_edges(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", None, ""])
    twice = df.unionByName(df.filter("doc_id = 0"))
    rows = jaccard_join.jaccard_join(twice).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == [(0, 0, 2), (0, 0, 2), (1, 0, 2), (2, 2, 0), (3, 3, 0)]
    nulls = jaccard_join.jaccard_join(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nulls) == 4 and all(r["class_id"] is None for r in nulls)
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (70, 60)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links, Scratch(spark, "test")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in (50, 60, 70)} == {50}


# 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><!-- c > d --><article><h1>Head &amp; tail</h1><p>One  <b>two</b>
three&nbsp;four<p>Five &lt;six&gt; 1 < 2<div class="comments"><p>Nice!</div><form><input value="a>b">Name</form></article><aside>Side</aside><footer>&copy; X</footer></body>"""


def test_html_blocks(spark):
    assert html_extract.main_text(PAGE, {}) == "Head & tail\nOne two three four\nFive <six> 1 < 2"
    for odd in ("", "plain", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<a b='>x", "&#0;&bogus;", "<p>" * 3000):
        html_extract.main_text(odd, {})
    rows = [(1, "http://a.b/c", None), (2, None, ""), (3, "odd", PAGE), (3, "odd", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit(1) for c in ("text", "host", "path", "_low", "_host", "site", "Page", "found", "evidence")})
    out = html_extract.extract(df).collect()
    assert [(r["page_id"], r["n_chars"], r["Page"], r["_low"]) for r in sorted(out, key=lambda r: r["page_id"])] == [(1, 0, 1, 1), (2, 0, 1, 1), (3, 47, 1, 1), (3, 47, 1, 1)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_names_only_weigh():
    text = lambda page, evidence=None: html_extract.main_text(page, evidence or {})
    assert text("<main><article><p>Teaser</p></article><p>Real body</p></main>") == "Teaser\nReal body"
    assert text('<div class="article-header"><h1>Title</h1></div><p>x</p>') == "Title\nx"
    assert text('<div class="image-widget">pic</div><p class="banner-free search">q</p>') == "pic\nq"
    assert text('<p>x <span class="ads">Buy</span> y</p><a class="ad"><div>Buy</div></a>ok') == "x\ny\nok"
    assert text('<div class="post-comments"><p>Nice</p></div><ol class="commentlist"><li class="comment">Me too</ol>z') == "z"
    assert text("<nav>a</nav><footer>b</footer>") == ""
    page = '<div class="top-banner">Open day on 3 May</div><p>x'
    path = html_extract.blocks(page)[0].path
    assert text(page) == "x" and text(page, {path: 0.9}) == "Open day on 3 May\nx"
    page = "<div id=box><b>Latest news</b></div><p>x"
    path = html_extract.blocks(page)[0].path
    assert text(page) == "Latest news\nx" and text(page, {path: -0.9}) == "x"
    assert text("<p>a<p>b", {html_extract.blocks("<p>a")[0].path: -1}) == "a\nb"  # nothing else is there


def test_html_parsing_is_linear():
    import time

    mixed = "<a '>\"<b \">'"
    for page in ("<a " * 20_000, '<a "' * 20_001, "<div>" * 20_000 + "</span>" * 20_000, "<b>" + "<div>" * 20_000 + "</b>" * 20_000, "<td><table>" + "<blockquote>" * 20_000 + "<td></td>" * 20_000,
                 "<b>" * 20_000 + "</i>" * 20_000, "<div " + "a" * 60_000 + ">x", mixed * 10_000, "<!" * 30_000, "<script>" * 20_000):
        start = time.process_time()
        html_extract.blocks(page)
        assert time.process_time() - start < 5, page[:20]


@pytest.mark.parametrize("branches", [4096, 1])
def test_style_tree_finds_what_pages_share(spark, monkeypatch, branches):
    monkeypatch.setattr(html_extract, "BRANCHES", branches)
    rows = [(i, f"https://User@Site.example:80/p{i}", f"<body><div id=top>Welcome to the site</div><div id=x><p>Story {i} of day {i * 7}</p><p>More {i}</p></div></body>") for i in range(30)]
    rows += [(100 + i, "https://small.example/", f"<body><div id=top>Welcome</div><p>Text {i}</p></body>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert found[4] == "Story 4 of day 28\nMore 4" and found[101] == "Welcome\nText 1"


def test_importance_against_brute_force(spark):
    rng = np.random.default_rng(55)
    pages = []
    for i in range(60):
        body = "".join(f"<div class=c{j}>{'same' if rng.random() < j / 5 else f'own {i} {j}'}</div>" * int(rng.integers(0, 3)) for j in range(6))
        pages.append((f"h{i % 3}", i, f"<body><p>{i % 4}</p>{body}</body>"))
    pages += pages[:7]
    got = html_extract.style_tree(html_extract.merged_pages(spark.createDataFrame(pages, "host string, page long, html string"))).collect()
    of = defaultdict(lambda: defaultdict(list))
    for site, page, html in dict.fromkeys(pages):
        for b in html_extract.blocks(html):
            of[site, b.path][page].append(b.text)
    entropy = lambda counts: -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts)
    assert {(r["host"], r["path"]) for r in got} == set(of)
    for r in got:
        per_page = of[r["host"], r["path"]]
        m = len(per_page)
        shown = entropy(list(Counter(map(len, per_page.values())).values())) / math.log(m) if m > 1 else 1.0
        spread = Counter(t for texts in per_page.values() for t in set(texts))
        said = 1 - sum(n * math.log(n) for n in spread.values()) / sum(spread.values()) / math.log(m) if m > 1 else 1.0
        assert r["pages"] == m and abs(r["importance"] - (0.9 * max(said, 0) + 0.1 * shown)) < 1e-9


# 6

def brute_repeats(texts, window=13):
    w = {i: WORDS.findall(t) if t else [] for i, t in enumerate(texts)}
    first = {}
    for i in sorted(w):
        for j in range(len(w[i]) - window + 1):
            first.setdefault(tuple(w[i][j : j + window]), i)
    out = {}
    for i, ws in w.items():
        gone = set()
        for j in range(len(ws) - window + 1):
            if first[tuple(ws[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (" ".join(x for j, x in enumerate(ws) if j not in gone), len(ws), len(gone))
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup_against_brute_force(spark, batches):
    rng = np.random.default_rng(6)
    passages = [words(int(n), 300 + i) for i, n in enumerate((12, 13, 14, 40, 200))]
    texts = list(ODD)
    for i in range(80):
        parts = words(int(rng.integers(0, 40)), i)
        for p in rng.permutation(len(passages))[: int(rng.integers(0, 3))]:
            cut = int(rng.integers(0, 5))
            parts += passages[p][cut:] + words(int(rng.integers(0, 20)), 500 + i)
        texts.append(("\t" if i % 2 else "  ").join(parts))
    texts += [texts[20], texts[21] + " end"] + ["the " * 40] * 2
    df = docs_of(spark, texts)
    out = substring_dedup.remove_repeats(df, batches=batches, fanout=2).collect()
    found = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in out}
    assert found == brute_repeats(texts) and out[0]["source"] is not None


def test_substring_dedup_edges(spark):
    text = " ".join(words(30, 1))
    df = docs_of(spark, [text]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = substring_dedup.remove_repeats(df.unionByName(df)).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]
    same = docs_of(spark, [text])
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(same.unionByName(same)).collect()] == [0, 0]
    assert substring_dedup.remove_repeats(same.limit(0)).count() == 0


def test_substring_dedup_meets_a_compacted_run(spark, monkeypatch):
    """The last batch of what queries call meets the run that earlier batches were compacted into, and finds in it what each of them had."""
    texts = [" ".join(words(20, 700 + i)) for i in range(40)]
    texts += [" ".join(words(20, 700 + i) + words(5, 900 + i)) for i in range(40)]
    met = []
    real = substring_dedup.FingerprintIndex.add
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "add", lambda self, docs: met.append([level for level, *_ in self.runs]) or real(self, docs))
    found = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert met == [[], [0], [1]]
    assert found == brute_repeats(texts) and sum(n for *_, n in found.values()) == 800


# 7

def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(7)
    texts = ODD + [" ".join(words(int(n), i, 300)) for i, n in enumerate(rng.integers(1, 1500, 120))] + ["same words here"] * 50
    path = tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs_of(spark, texts).repartition(5), path).collect()
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, want in ids.items():
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in parts) == want.tobytes()
        assert [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        assert {p["doc_tokens"] for p in parts} == {len(want)}
    short = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        short += at < packing.WINDOW
    assert short <= 1


def test_packing_ids_are_the_tokenizers(monkeypatch):
    """Whatever path a string takes: by pieces, as a whole, in stretches."""
    path = tokenizer_file("word_bpe_49k.json")
    words_of = packing.Encoder(path)
    rng = np.random.default_rng(77)
    signs = [*"aZ9'<|>endoftext .,!?-_\t\n\x0b\x1c\x85\xa0éÉßİΣςǅªº²½ſ\u0301中ﬁ٣😀Ⅷ한ᄀ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "’t"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)] + [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in range(0x21, 0xD800, 7)]
    monkeypatch.setattr(packing, "TABLE_BYTES", 50_000)
    monkeypatch.setattr(packing, "STRETCH", 20)
    for text in texts:
        assert np.frombuffer(words_of.encode(text), "<u4").tolist() == words_of.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert words_of.encode(None) == b""


def test_packing_plan_uses_combinations():
    count = np.zeros(packing.WINDOW, np.int64)
    count[[500, 1548, 700, 648]] = [1000, 900, 300, 310]
    plan = packing.Plan(count)
    assert plan.planned > 900
    seen = Counter()
    for length in np.flatnonzero(count):
        for rank in range(count[length]):
            for _, n, sequence, _ in plan.place(int(length), rank):
                seen[sequence] += n
    assert max(seen.values()) <= packing.WINDOW and sum(n < packing.WINDOW for n in seen.values()) <= 1
    combos = packing.combinations(count)
    x = packing.non_negative_least_squares(combos, count)
    assert (x >= 0).all() and (combos.sum(1) == packing.WINDOW).all()


def test_packing_edges(spark):
    df = docs_of(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = packing.pack(df.unionByName(df), tokenizer_file("word_bpe_49k.json")).collect()
    assert len(rows) == 2 and rows[0]["doc_id"] is None and zlib.crc32(bytes(rows[0]["ids"]))
    assert packing.pack(df.limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0


# 8, 9

@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    rows = QUERIES["op8_lang_id"](spark, SF.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_language_edges(spark):
    df = docs_of(spark, ODD + ["und" * 3])
    net = lang_id.train(df)
    rows = lang_id.identify(df.withColumn("lang_pred", F.lit("x")), net).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[0]["score"] == 0
    assert by[3]["lang_pred"] == "en" and 0 <= by[3]["score"] <= 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    nothing = lang_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in lang_id.identify(df, nothing).collect()} == {"und"}
    assert lang_id.identify(df.limit(0), net).count() == 0


def test_network_equals_naive_convolutions_and_gradients():
    """Pair tables against sums over one-hot bytes, and a step of the fit against differences of the loss."""
    rng = np.random.default_rng(8)
    net = lang_id.ByteNet(["a", "b", "c"], filters=2, seed=1)
    x = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])

    def forward():
        z = []
        for w, bias in zip(net.weights, net.bias, strict=True):
            maps = np.array([[[sum(w[j, row[p + j], f] for j in range(len(w))) for f in range(w.shape[2])] for p in range(len(row) - len(w) + 1)] for row in x], float)
            z.append(maps.max(1) + bias)
        logits = np.maximum(np.concatenate(z, 1), 0) @ net.out + net.out_bias
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    assert np.allclose(net.log_probabilities(x, net.pair_tables()), forward(), atol=1e-4)
    # the first step of Adam moves each weight against the sign of its gradient
    loss = lambda: -forward()[np.arange(len(y)), y].mean()
    flat = [(w, i) for w in net.weights for i in rng.integers(0, w.size, 400)] + [(net.out, i) for i in range(net.out.size)]
    slopes, before = [], []
    for w, i in flat:
        at = np.unravel_index(i, w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        slopes.append((up - loss()) / 2e-3)
        w[at] = old
        before.append(old)
    net.fit(x, y, epochs=1, least_steps=1, rate=1e-3)
    moved = np.array([w[np.unravel_index(i, w.shape)] - old for (w, i), old in zip(flat, before, strict=True)])
    steep = np.abs(slopes) > 5e-3
    assert steep.sum() > 20 and (np.sign(moved) == -np.sign(slopes))[steep].mean() > 0.97  # but for kinks of the maximum


def test_votes_against_naive_neighbours(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(words(int(n), i, 60)) for i, n in enumerate(rng.integers(1, 40, 80))] + [None, "", "a b c"]
    idf = np.linspace(0.5, 2, quality.TERMS).astype(np.float32)
    y = rng.integers(0, 2, 60).astype(float)
    known = quality.Neighbours(quality.weighted(texts[:60], idf), y, idf, latent=16)
    got = known.score(texts, block=7)
    for text, score in zip(texts, got, strict=True):
        z = quality.weighted([text], idf)[0] @ known.axes
        if not np.any(z):
            assert score == pytest.approx(known.prior)
            continue
        cosine = [float(z @ v / np.sqrt((z @ z) * (v @ v))) for v in known.vectors]
        near = sorted(range(60), key=lambda i: -cosine[i])[: quality.VOTES]
        weight = [max(cosine[i], 0) ** 4 for i in near]
        want = (sum(w * y[i] for w, i in zip(weight, near, strict=True)) + quality.PRIOR * known.prior) / (sum(weight) + quality.PRIOR)
        assert score == pytest.approx(want, abs=1e-4)


def test_training_windows_are_of_whole_texts(spark):
    long = " ".join(f"w{i}" for i in range(1800))
    df = docs_of(spark, [long] * 40 + ["zz yy"] * 3)
    sample = lang_id.training_sample(df.withColumn("lang", F.when(F.length("text") < 10, "rare").otherwise("long")), max_rows=60)
    assert len(sample) <= 60 and set(sample.lang) == {"long", "rare"}
    places = {long.find(bytes(w).decode()) // 1000 for w in sample.window[sample.lang == "long"]}
    assert len(places) > 4  # from all parts of the texts
    none = lang_id.training_sample(df.repartition(40).withColumn("lang", F.lit("long")), max_rows=1)
    assert len(none) <= 1  # most tasks draw nothing


def test_jaccard_runs_are_never_capped():
    assert jaccard_join.runs_for(0.99999, 0.8) <= jaccard_join.TOKENS and jaccard_join.runs_for(0.9, 1.0) == 1
    with pytest.raises(ValueError, match="runs"):
        jaccard_join.runs_for(0.99999, 0.3)


def test_columns_of_any_name_pass(spark):
    names = ["_rid", "_removed", "_found", "_low", "rid", "removed", "found", "of_doc", "stretches", "H", "slot", "Key"]
    df = docs_of(spark, ["a b c\nd"] * 3, clash=False).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    net = lang_id.train(df)
    for out in (line_dedup.remove_boilerplate(df, 2), substring_dedup.remove_repeats(df), lang_id.identify(df, net), quality.classify(df, quality.train(df, spark.createDataFrame([], "doc_id long, quality int")))):
        row = out.first().asDict()
        assert [row[c] for c in names] == list(range(len(names)))


def test_windows_cover_all_bytes():
    parts = [b"a" * n for n in (0, 1, 255, 256, 257, 1000)]
    start, end, doc = lang_id.cut_windows(parts)
    base = np.cumsum([0] + [len(p) for p in parts])
    for i, p in enumerate(parts):
        covered = set()
        for s, e in zip(start[doc == i], end[doc == i], strict=True):
            covered |= set(range(s, e))
        assert covered == set(range(base[i], base[i] + len(p)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_quality_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op9_quality"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_quality_edges(spark):
    df = docs_of(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)] + [(3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = quality.classify(df, quality.train(df, given)).collect()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.classify(df.limit(0), quality.train(df.limit(0), labels)).count() == 0


# 10

def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 64)
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in np.float32(centre[i % 6] + rng.normal(size=16) * 0.3)]) for i in range(600)]
    rows += [(1000 + i, list(rows[50][1])) for i in range(40)] + [(2000, None), (2050, [float("nan")] * 16), (2100, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(0), "v": F.lit("a"), "pivot": F.lit(1)})
    whole = {i: np.floor(256 * np.asarray(v, float)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    assert found == want
    # empty and shorter vectors, and repeated rows
    odd = spark.createDataFrame([(0, [0.5, 0.5]), (1, []), (2, [1.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(odd.unionByName(odd.limit(1)), odd.limit(1)).orderBy("rank").collect()]
    assert got == [(1, 3, 65536), (2, 3, 65536), (3, 2, 32768), (4, 1, 0), (5, 4, -32768)]
    far = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, -1.0]), (2, [1e6, 5.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(far, far.limit(1), 1).collect()] == [2]
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, few.filter("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 2000"), df).count() == 0


# the pipeline

@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(P.STAGES)
    kept = stage["language"](spark, docs, SF)
    assert kept.columns == P.COLUMNS and kept.count() >= 0.98 * len(texts)
    left = stage["near_copies"](spark, docs, SF)
    classes = brute_jaccard([texts[i] for i in sorted(texts)])
    order = sorted(texts)
    assert sorted(r["doc_id"] for r in left.collect()) == [order[i] for i in range(len(order)) if classes[i][0] == i]
    cleaned = {r["doc_id"]: r["text"] for r in stage["passages"](spark, docs, SF).collect()}
    brute = brute_repeats([texts[i] for i in order])
    assert cleaned == {order[i]: t for i, (t, n, g) in brute.items() if g == 0 or g < n}
    pieces = stage["packing"](spark, docs, SF)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    lined = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage["lines"](spark, docs, SF).collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    brute = brute_lines([texts[i] for i in order], [sources[i] for i in order], 10)
    assert lined == {order[i]: (t, None if t is None else len(t)) for i, (t, _, _) in brute.items()}
    assert P.run(spark, SF).count() > 0
    assert hashlib.sha256(b"").hexdigest() == docs.select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls in every column, repeated rows, an empty table, columns of other names."""
    import corpus_pipeline as P

    text = "die der und " + " ".join(words(60, 5))
    rows = [(1, text, "de", "a", 9), (1, text, "de", "a", 9), (2, None, None, None, None), (3, "", "de", "a", 0), (None, "the and of " + text, "en", None, None), (None, None, None, None, None),
            (4, "le la les " + " ".join(words(40, 6)), "fr", "b", 1), (5, "x" * 3_000, None, "c", 1)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("rid", "_found", "score", "class_id", "tokens", "N_words")})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        found = out.collect()
        assert out.columns == P.COLUMNS and stage(spark, df.limit(0), SF).count() == 0
        ids = Counter(r["doc_id"] for r in found)
        if name == "language":
            assert ids[2] == ids[3] == 0 and all(r["text"] for r in found) and ids[1] in (0, 2)
        else:
            assert ids == Counter(r[0] for r in rows), name
    pieces = P.STAGES[-1][1](spark, df, SF)
    assert pieces.filter("start = 0").count() == len(rows) and P.STAGES[-1][1](spark, df.limit(0), SF).count() == 0
    assert pieces.filter("doc_id IS NULL").count() == 2 and pieces.filter("doc_id = 2").first()["length"] == 1
