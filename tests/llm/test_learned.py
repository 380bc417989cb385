"""Sharding, language ID and main-text extraction."""

import itertools
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape
from math import exp, log, prod

import pytest
import regex
import xxhash

from latticework.llm import html_extract, language_id, sharding


def test_sharding(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(None, None, None), (5, "same", "x"), (5, "same", "x")], docs.schema))
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 60_000)
    assert sharding.bucket_count(docs) > 3
    runs = []
    for k, frame in enumerate((docs.repartition(3), docs.repartition(7))):
        sharding.write(frame, str(tmp_path / str(k)), shards=5)
        runs.append(sharding.read(spark, str(tmp_path / str(k))).collect())
    key = lambda r: (str(r.doc_id), r.text or "", r.shard, r.slot)
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))
    rows = runs[0]
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1 and len(sizes) == 5
    assert all(sorted(x) == list(range(len(x))) for x in sizes.values())
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.62 * len(ids)
    sharding.write(docs, str(tmp_path / "seed"), shards=5, seed=2)
    other = {(r.doc_id): (r.shard, r.slot) for r in sharding.read(spark, str(tmp_path / "seed")).collect()}
    assert sum(other[r.doc_id] == (r.shard, r.slot) for r in rows) < 0.1 * len(rows)
    sharding.write(docs.limit(0), str(tmp_path / "none"), shards=5)


def spark_hash(*values):
    """Spark's xxhash64: each value seeds the next, nulls do not count; ints come as (value, 4), longs as (value, 8)."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little", signed=True) if isinstance(v, bool) else v[0].to_bytes(v[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_sharding_replayed(spark, tmp_path, monkeypatch):
    """Placement against a plain replay: hash, bucket, order, Fisher-Yates; half of all rows are equal, and some have nulls."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(sharding, "RUN", 100)
    rows = [(k, f"text {k} " * 4, f"s{k % 3}") for k in range(900)] + [(7, "the same", "x")] * 1200 + [(None, None, "y")] * 5 + [(3, "few", None)] * 8 + [(3, None, "few")] * 12
    docs = spark.createDataFrame(rows, "doc_id long, shard string, slot string").withColumnRenamed("shard", "text")
    buckets = sharding.bucket_count(docs)
    assert buckets > 5
    held = {}
    for row, n in Counter(rows).items():
        parts = [x for v, kind in zip(row, "lss") for x in ((v, 8) if kind == "l" and v is not None else v, v is None)]
        k, k2 = spark_hash((sharding.SEED, 4), *parts), spark_hash((~sharding.SEED, 4), *parts)
        for copy in range(n):
            own = k if copy == 0 or n <= sharding.COPIES else spark_hash((k, 8), (copy, 8))
            held.setdefault(own % buckets, []).append((own, k2, row))
    assert max(map(len, held.values())) < 2 * len(rows) / buckets
    want, at = Counter(), 0
    for b in sorted(held):
        own = sorted(held[b], key=lambda x: x[:2])
        for place, k in enumerate(sharding.fisher_yates(len(own), sharding.SEED * 1_000_003 + b)):
            want[(*own[k][2], (at + place) % 5, (at + place) // 5)] += 1
        at += len(own)
    sharding.write(docs.repartition(6), str(tmp_path / "r"), shards=5)
    got = sharding.read(spark, str(tmp_path / "r"))
    assert got.columns == ["doc_id", "text", "slot", "slot_", "shard"]
    assert Counter((r.doc_id, r.text, r.slot, r.shard, r.slot_) for r in got.collect()) == want


def test_fisher_yates():
    seen = {tuple(sharding.fisher_yates(3, s)) for s in range(200)}
    assert len(seen) == 6
    assert sorted(sharding.fisher_yates(1000, 1)) == list(range(1000)) and len(sharding.fisher_yates(0, 1)) == 0


def test_sharding_query(spark, sf_dir):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.query(spark, sf_dir).collect()
    assert len(rows) == len(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_language_held_out(spark, sf_dir):
    rows = {r.doc_id: r for r in language_id.query(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    right = [rows[d.doc_id].lang_pred == d.lang for d in held]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    assert all(0 <= r.score <= 1 for r in rows.values())


def plain_language(rows, text):
    """Language and score by dictionaries: words first, else the mean of the longest known n-grams."""
    langs = sorted({x for x, _, _ in rows})
    words, grams = defaultdict(Counter), [defaultdict(lambda: defaultdict(float)) for _ in range(5)]
    for lang, word, n in rows:
        words[word][lang] += n
    of = lambda w, k: [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)] if k > 1 else list(w)
    for word, n in words.items():
        for k in range(1, 5):
            for g in of(word, k):
                for x in langs:
                    grams[k][g][x] += n[x] ** 0.5

    def logs(table):
        total = {x: sum(c[x] for c in table.values()) for x in langs}
        out = {}
        for name, c in table.items():
            v = [log((c[x] + 0.5) / (total[x] + 0.5 * len(table))) for x in langs]
            out[name] = [y - max(v) for y in v]
        return out

    known, parts = logs(words), [logs(g) for g in grams]
    found = regex.findall(r"\p{L}+", text.lower()) if text else []
    if not found:
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in found:
        if w in known:
            v = known[w]
        else:
            v = [0.0] * len(langs)
            for k in range(4, 0, -1):
                own = [parts[k][g] for g in of(w, k) if g in parts[k]]
                if own:
                    v = [2 * sum(x) / len(own) for x in zip(*own)]
                    break
        total = [a + b for a, b in zip(total, v)]
    p = [exp(x / len(found) * min(len(found), language_id.SURE)) for x in total]
    best = p.index(max(p))
    return langs[best], p[best] / sum(p)


def test_language_against_dictionaries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    rows = [(d.lang, w, 1) for d in docs.where("doc_id % 2 = 0").collect() if d.lang and d.text for w in regex.findall(r"\p{L}+", d.text.lower())]
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    for r in language_id.predict(docs, model).join(docs, "doc_id").collect():
        lang, score = plain_language(rows, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(k, t, x) for k, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et la maison", "fr"), (None, "en"), ("12 .. !", None), ("THE", None), ("zzqxj", None), ("la " * 50000, None), ("", "fr")])],
        "doc_id long, text string, lang string",
    )
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs.union(docs), model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 3, 4, 6, 7)] == ["en", "fr", "und", "und", "en", "fr", "und"]
    assert got[5].lang_pred in ("en", "fr") and got[2].score == 0.0
    none = language_id.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def article(source):
    """What a page's own <article> says, as a brute-force reading of the given pages."""
    m = re.search(r"<article>(.*?)</article>", source, re.S)
    blocks = re.split(r"</?(?:p|h\d|article)>", m[1] if m else "")
    clean = [" ".join(unescape(re.sub(r"<[^>]+>", lambda t: " " if t[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in clean if b)


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = html_extract.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    wrong = [r.page_id for r in rows if r.text != article(pages[r.page_id])]
    assert len(wrong) <= 0.01 * len(rows), wrong
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


STORY = "The council met on Tuesday to talk about the new bridge, and after a long debate most members agreed to the plan."


def test_other_markup(model):
    page = f"""<html><head><title>T</title></head><body><div id="header"><a href="/">Home</a> <a href="/x">News</a></div>
    <div class="cookie-notice">We use cookies. <button>OK</button></div>
    <div class="wrapper"><div class="post-content"><h1>A bridge for the town</h1><p>{STORY}</p><p>{STORY} <a href="#">More &amp; more</a>.</p><ul><li>First point of the plan is cost.</li></ul></div>
    <div class="sidebar"><ul><li><a href="/1">Other story</a></li><li><a href="/2">Next story</a></li></ul></div>
    <div class="comments"><p>I think this is a bad idea and nobody asked me about it at all.</p></div>
    <form><p>Write to us</p><input name=q></form></div><footer><p>&copy; Town Gazette.</p></footer></body></html>"""
    assert model.extract(page) == f"A bridge for the town\n\n{STORY}\n\n{STORY} More & more.\n\nFirst point of the plan is cost."
    inner = f'<body><article><h1>Title of it</h1><p>{STORY}<aside>Read also this</aside><section class="comments"><p>Nice story, thanks for it.</p></section></article></body>'
    assert model.extract(inner) == f"Title of it\n\n{STORY}"


def test_broken_markup(model):
    assert model.extract(None) == "" and model.extract("") == ""
    for page in ("<", "<p", "<p class='x", "<!-- never closed", "<script>x", "</p></p>", "a < b > c", "<a href=\"x'>y", "<" * 5000, "<p>" * 3000, "<div>" * 3000 + "x", "&amp;&#x41;&nosuch;", "<p a='" * 300):
        assert isinstance(model.extract(page), str)
    assert model.extract(f"<article><p>{STORY}<br>two\n\t words</p></article>") == f"{STORY} two words"
    long = f"<article>{f'<p>{STORY}</p>' * 3000}</article>"
    assert model.extract(long) == "\n\n".join([STORY] * 3000)


def enumerated(m, page):
    """Content marginals by summing over all labellings of the tree."""
    n = len(page.tag)
    odds = [max(-30.0, min(30.0, sum(m.odds.get(f, 0.0) for f in html_extract.features(page, k)))) for k in range(n)]
    moves = [m.move[html_extract.kind_of(page, k)] for k in range(n)]
    content, whole = [0.0] * n, 0.0
    for y in itertools.product((0, 1), repeat=n):
        weight = (0.01 if y[0] else 1.0) * prod(exp(o) for o, x in zip(odds, y) if x)
        weight *= prod(moves[k][2 * y[page.parent[k]] + y[k]] for k in range(1, n))
        whole += weight
        content = [c + weight * x for c, x in zip(content, y)]
    return [c / whole for c in content]


@pytest.mark.parametrize("source", ["<p>a", f"<body><nav><a href=x>Home</a></nav><div><p>{STORY}</p><p>x</p></div></body>", f"<div class=post><h1>T</h1>{STORY}<div class=ad>Buy</div><ul><li>a<li>b</ul></div>", f"<article><p>{STORY}</article><footer>c</footer>"])
def test_messages_against_enumeration(model, source):
    page = html_extract.parse(source)
    assert len(page.tag) <= 14
    for a, b in zip(model.marginals(page), enumerated(model, page)):
        assert abs(a - b) < 1e-9


def unmarked(source):
    """The page without the marks that labels come from: no <article> or <main>, no class, id or role."""
    return re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", re.sub(r"<(/?)(?:article|main)\b", r"<\1div", source))


def test_fit_and_test_pages_differ(spark):
    """Fitted on half of the pages, read on the other half, as they are and without any mark of the main text; against no fitting at all."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    fitted, prior = html_extract.fit(pages.where("page_id % 2 = 0")), html_extract.fit(pages.limit(0))
    other = [r.html for r in pages.where("page_id % 2 = 1").collect()]
    assert sum(fitted.extract(x) == article(x) for x in other) >= 0.99 * len(other)

    plain = lambda x: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", x)
    exact = lambda m, change: sum(m.extract(change(x)) == article(x) for x in other) / len(other)
    assert exact(fitted, plain) >= 0.99 and exact(fitted, unmarked) >= 0.95
    assert exact(prior, plain) <= 0.05 and exact(prior, unmarked) <= 0.05  # it is the fit that reads them


def test_pages_edges(spark, model):
    pages = spark.createDataFrame([(1, None, "x"), (1, "<p>a</p>", "x"), (None, "", None)], "page_id long, html string, kind string")
    assert html_extract.extract(pages, model).count() == 3
    assert html_extract.extract(pages.limit(0), model).count() == 0
    html_extract.fit(pages.limit(0))


def test_names_that_are_taken(spark, model):
    pages = spark.createDataFrame([(1, f"<article><p>{STORY}</p></article>", "mine")], "page_id long, html string, text string")
    (row,) = html_extract.extract(pages, model).collect()
    assert (row.text, row.text_) == ("mine", STORY)


def test_language_fit_is_bounded_by_rows(spark, monkeypatch):
    """Rows that share an id, or are equal, do not pass the bound."""
    monkeypatch.setattr(language_id, "FIT_DOCS", 50)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(1, f"w{word(k)}", "en") for k in range(600)] + [(None, "ein text", "de")] * 300
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert 45 <= len(model.words) <= 51


def test_messages_do_not_depend_on_order(model):
    """A thousand children: the same sums whatever comes first."""
    links = '<p><a href="x">one two three</a> <a href="y">four five six</a></p>' * 500
    prose = "<p>This is a sentence of plain prose that goes on for a while, as sentences do. And here is one more.</p>" * 500
    found = []
    for body in (links + prose, prose + links):
        page = html_extract.parse(f"<html><body><div>{body}</div></body></html>")
        p = model.marginals(page)
        assert all(0 <= x <= 1 for x in p)
        found.append((page.tag.index("div"), p, page))
    (at, a, one), (_, b, two) = found
    assert abs(a[at] - b[at]) < 1e-9
    split = lambda p, page: sorted(round(x, 9) for x, t in zip(p, page.tag) if t == "#text")
    assert split(a, one) == split(b, two)


def test_deep_and_unmatched_tags_take_linear_time():
    for source in ("<center>" * 100_000 + "deep", "</center>" * 100_000 + "deep", "<option>" * 50_000 + "<center>" * 50_000 + "deep", "<dt>" * 30_000 + "</dl></td>" * 30_000 + "deep"):
        begun = time.thread_time()
        page = html_extract.parse(source)
        assert time.thread_time() - begun < 5 and page.text[-1] == "deep"


def test_very_long_texts_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 60_000)
    rows = [(1, "the cat sat " * 100_000, "en"), (2, "der hund lag", "de"), (3, "the cat", "en"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sharding.write(docs.select("doc_id", "text"), str(tmp_path / "a"), shards=2)
    got = {r.doc_id: r.text for r in sharding.read(spark, str(tmp_path / "a")).collect()}
    assert got == {i: t for i, t, _ in rows}
    model = language_id.fit(docs)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {1: "en", 2: "de", 3: "en", 4: "und"}
    assert language_id.predict(docs.limit(0), model).count() == 0 and language_id.fit(docs.limit(0)).langs == []
