"""Each operator against brute force on small, awkward tables: nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontamination, elias_fano, fingerprints, fm_index, frames, html, language_model, near_duplicates, packing, quality, sharding, substrings, url_filters
from tessera.llm import words as W

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def text_of(draw, n, vocabulary=30):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, n=60):
    """Random texts with shared passages, copies, near copies, and the awkward cases."""
    draw = random.Random(seed)
    passage = text_of(draw, 70, 10_000)
    out = []
    for i in range(n):
        kind = draw.randrange(6)
        body = text_of(draw, draw.randrange(0, 160), 10_000)
        if kind == 0 and out:
            body = draw.choice(out)[1] or ""
        elif kind == 1:
            body = f"{body} {passage}  {text_of(draw, 5)}\n"
        elif kind == 2 and out:
            words = (draw.choice(out)[1] or "").split()
            if words:
                words[draw.randrange(len(words))] = "changed"
            body = " ".join(words)
        out.append((i, body))
    same = "Orre " * 200
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, same), (n + 4, same + "x"), (n + 5, "É é  ß 中文 " * 20), (n + 6, text_of(draw, 30_000, 5_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, doc string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- words


def test_words_match_the_pattern():
    texts = ["a bc  d", None, "", " x", "É\u00a0é\tz a", "bc", "\x0b\x1c y"]
    data, offsets = W.buffers(pa.array(texts))
    for separators, pattern, lower in ((W.SPACES, SPLIT, False), (W.NON_ALNUM, ALNUM, True)):
        found = W.find(data, offsets, separators, lower)
        got = [[found.text(i).decode() for i in range(found.first[d], found.first[d + 1])] for d in range(len(texts))]
        assert got == [pattern.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
    h = W.hashes(W.find(data, offsets, W.SPACES))
    assert h[1] == h[-3] and len(set(h.tolist())) == len(h) - 2


def test_words_of_one_pattern_have_hashes_of_their_own():
    # Words whose letters alternate by the same rule, which deceive a polynomial modulo a power of two.
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    words = [one, two, one[:64], two[:64], one[:65], two[:65], "a" * 8, "a" * 9, "a" * 16, "ab" * 4]
    found = W.find(*W.buffers(pa.array([" ".join(words)])), W.SPACES)
    h = W.hashes(found)
    assert len(set(h.tolist())) == len(words)
    letters = W.find(*W.buffers(pa.array([" ".join(one[:64]), " ".join(two[:64])])), W.SPACES)
    for n in (1, 2, 5, 8, 13, 32, 50):
        r = W.runs(W.hashes(letters), n)
        texts = {}
        for i, x in enumerate(r.tolist()):
            assert texts.setdefault(x, letters.data[letters.starts[i : i + n]].tobytes()) == letters.data[letters.starts[i : i + n]].tobytes()
        assert len(texts) == len(set(texts.values()))


# -- 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><nav><a href=1>Home</a> <a href=2>More</a></nav>
<div id="page"><header>Site</header><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>The &amp; title&nbsp;x</h1><p>First   paragraph <b>bold</b>
text &lt;b&gt; 1 &#233;.<p>Second one<br>goes on, with <a href="x">a link</a>.<script>var t="</p>"</script><ul><li>one<li>two</ul>
<div class="ad">Buy</div><form><input> Sign up</form><section id="comments"><p>Nice post, long comment text that goes on and on and on and on.</p></section></article>
<div class="related-posts"><p>Other story</p></div></div><footer>&copy; 2024</footer></body></html>"""


def test_html_article():
    assert html.main_text(PAGE).split("\n") == ["The & title x", "First paragraph bold text <b> 1 é.", "Second one goes on, with a link.", "one", "two"]


def test_html_without_article_element():
    page = '<body><div><a href=1>a</a> <a href=2>b</a></div><div class="main-text"><h2>Head</h2><p>' + "Long text here. " * 20 + "</p><p>" + "More text there. " * 20 + "</p></div><div class=footer>foot</div></body>"
    found = html.main_text(page).split("\n")
    assert found[0] == "Head" and len(found) == 3


def prose(name, n):
    return [f"{name}{i} " + " ".join(["words"] * 49) for i in range(n)]


def paragraphs(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


LINKS = "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>"


@pytest.mark.parametrize("around", ["{}", "<div id=wrap>{}</div>", "<div id=outer><div id=wrap>{}</div></div>"])
def test_html_article_split_over_siblings(around):
    a, b, c = prose("a", 3), prose("b", 8), prose("c", 5)
    page = "<body>" + LINKS + around.format("<h2>Head</h2>" + paragraphs(a) + "<div>" + paragraphs(b) + "</div>Loose <b>words</b> end.<div>" + paragraphs(c) + "</div><p>The end.</p>") + LINKS + "<div>by me</div></body>"
    assert html.main_text(page).split("\n") == ["Head", *a, *b, "Loose words end.", *c, "The end."]


@pytest.mark.parametrize(
    "part",
    [
        '<section id="discussion"><p>{}</p></section>',
        '<h2 id="comments">Comments</h2><p>{}</p>',
        '<h2 id="related-work">Related work</h2><p>{}</p>',
        '<div class="section-header"><h2>Methods</h2></div><p>{}</p>',
        '<div class="related-work"><p>{}</p></div>',
        '<pre><span class="comment">{}</span></pre>',
        '<section id="copyright"><h2>Copyright</h2><p>{}</p></section>',
    ],
)
def test_html_names_of_sections_are_kept(part):
    a, b = prose("a", 2), prose("b", 1)[0]
    page = "<body><article><h1>Head</h1>" + paragraphs(a) + part.format(b) + "</article></body>"
    assert html.main_text(page).split("\n") == ["Head", *a, *re.findall("<h2.*?>(.*?)</h2>", part), b]


@pytest.mark.parametrize("name", ["content no-sidebar", "header-fixed", "header", "banner", "ad-free"])
def test_html_names_around_most_text_are_kept(name):
    a = prose("a", 4)
    assert html.main_text(f'<body><div class="{name}"><h2>Head</h2>' + paragraphs(a) + "</div><div>by me</div></body>").split("\n") == ["Head", *a]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="sidebar-left"><p>{}</p></div>',
        '<div id="siteFooter"><p>{}</p></div>',
        '<div class="x cookie-notice"><p>{}</p></div>',
        '<div class="post-related-links"><a href=1>{}</a></div>',
        '<div id="related"><a href=1>{}</a></div>',
        '<div role="navigation"><p>{}</p></div>',
        '<h2 hidden>{}</h2>',
        '<section id="comments"><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p></section>',
    ],
)
def test_html_furniture_is_left_out(part):
    a = prose("a", 3)
    page = "<body><article><h1>Head</h1>" + paragraphs(a) + part.format(prose("b", 1)[0]) + "</article></body>"
    assert html.main_text(page).split("\n") == ["Head", *a]


def test_html_direct_paragraphs_beside_a_part():
    a, b = prose("a", 5), prose("b", 8)
    assert html.main_text("<body>" + paragraphs(a) + "<div>" + paragraphs(b) + "</div></body>").split("\n") == [*a, *b]


@pytest.mark.parametrize("page", [None, "", "<html>", "<nav>x</nav>", "<!-- x", "<script>x"])
def test_html_empty(page):
    assert html.main_text(page) == ""


def test_html_links_beside_the_paragraphs_of_a_main_part():
    links = "<ul>" + "".join(f"<li><a href=#>Link number {i}</a></li>" for i in range(20)) + "</ul>"
    a = prose("a", 8)
    for inner in (paragraphs(a) + links, links + paragraphs(a), f"<div>{paragraphs(a)}</div><div>{links}</div>", f"<div>{paragraphs(a)}{links}</div>"):
        assert html.main_text(f"<body><main>{inner}</main></body>").split("\n") == a
    few = '<ul><li><a href="#1">One note</a></li><li>Another, without a link</li></ul>'
    assert html.main_text(f"<body><article>{paragraphs(a)}{few}</article></body>").split("\n") == [*a, "One note", "Another, without a link"]


def test_html_pages_in_a_form_and_headers_of_articles():
    a = prose("a", 4)
    assert html.main_text(f"<body><form action=/><input name=q>{paragraphs(a)}<button>Send</button></form></body>").split("\n") == a
    page = f"<body><header><h1>Site</h1><a href=/>Home</a></header><article><header><h1>Title</h1><p>By me</p></header>{paragraphs(a)}<form>Sign up <input></form></article></body>"
    assert html.main_text(page).split("\n") == ["Title", "By me", *a]


def test_html_comments_in_articles_of_their_own():
    a, b = prose("a", 2), prose("b", 9)
    comments = "".join(f"<article><p>{x}</p></article>" for x in b)
    assert html.main_text(f'<body><main><article><h1>Title</h1>{paragraphs(a)}</article><section id="comments"><h2>Comments</h2>{comments}</section></main></body>').split("\n") == ["Title", *a]


@pytest.mark.parametrize("name", ["social-history", "post related", "related", "social"])
def test_html_articles_of_odd_names(name):
    a = prose("a", 4)
    for tag in ("div", "section", "article"):
        assert html.main_text(f'<body>{LINKS}<{tag} class="{name}">{paragraphs(a)}</{tag}></body>').split("\n") == a


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<div>" * 50_000 + "</b>" * 50_000, '<a "' * 100_000, '<a "x>' * 100_001, '<a "<b>" ' * 50_001, "<a it's>" * 50_001, "<ul><li>" * 50_000, "<p><b>" * 50_000, "<" * 100_000, "<!--" * 100_000, '<div class="ad x">' * 50_000 + "x"])
def test_html_takes_time_in_proportion(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 6


def test_html_frame(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a  b</p>", "x"), (1, "u", None, "x"), (None, None, "plain &amp; text", "x"), (2, "u", "<p>" + "deep <div>" * 500 + "</p>", "x")], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.text, r.n_chars) for r in html.extract(rows).collect() if r.page_id != 2}
    assert found == {(1, "a b", 3), (1, "", 0), (None, "plain & text", 12)}
    assert html.extract(rows.limit(0)).count() == 0


# -- 2


def removed(rows, window=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: math.inf if r[0] is None else r[0]):
        w = SPLIT.findall(t or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (math.inf if i is None else i):
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substrings(spark, docs, hot):
    found = substrings.deduplicate(docs, hot=hot)
    assert found.columns == ["doc_id", "text", "doc", "n", "dedup"]
    got = sorted(str((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept)) for r in found.collect())
    assert got == removed([(r.doc_id, r.text) for r in docs.collect()])


def test_substrings_repeated_and_null_ids(spark, empty):
    draw = random.Random(5)
    a, b = text_of(draw, 80, 9999), text_of(draw, 60, 9999)
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, b), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept)) for r in substrings.deduplicate(df).collect()) == removed(rows)
    assert substrings.deduplicate(empty).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substrings_of_a_passage_that_many_share(spark, hot):
    draw = random.Random(9)
    passage = text_of(draw, 120, 9999).split()
    rows = []
    for i in range(60):
        w = list(passage)
        for _ in range(draw.randrange(3)):
            w[draw.randrange(len(w))] = f"n{i}"
        gap = draw.choice([" ", "  ", "\n"])
        rows.append((draw.choice([i, i, i // 2]), text_of(draw, draw.randrange(9), 9999) + " " + gap.join(w) + " " + " ".join(w[10:70] * draw.randrange(3))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(str((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept)) for r in substrings.deduplicate(df, hot=hot).collect())
    assert got == removed(rows)


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(W, "runs", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    packed = pa.array([b"a b c d", b"a b c x", b"b c d a"], pa.binary())
    found = substrings.later_windows(packed, np.array([1, 2, 3]), 3)
    assert found.tolist() == [[1, 0, 0], [2, 0, 0]]


# -- 3


def test_fingerprints(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_with_edited(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[1][:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        bits = lambda s: [int(s[j : j + 16], 16) for j in range(0, len(s), 16)]
        alike = lambda x, y: 1 - sum((a ^ b).bit_count() for a, b in zip(bits(x), bits(y), strict=True)) / 126
        assert math.isclose(r.near_edited, alike(r.fingerprint, r.edited_fingerprint)) and math.isclose(r.near_next, alike(r.fingerprint, got[other[0]].fingerprint))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def spark_hash(value, seed=42):
    """Spark's xxhash64 of a long, an int (as a one-element tuple) or a text."""
    data = value.encode() if isinstance(value, str) else value[0].to_bytes(4, "little", signed=True) if isinstance(value, tuple) else (value & (1 << 64) - 1).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def test_fingerprint_bits_against_plain_votes(spark, docs):
    rows = docs.collect()
    found = {r.doc_id: r.text_bits for r in fingerprints.fingerprints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"], ["text"]).collect()}
    for r in rows:
        hashes = [0, *(spark_hash(w) for w in SPLIT.findall(r.text or ""))]
        terms = [spark_hash(b, spark_hash(a)) for a, b in zip(hashes, hashes[1:], strict=False)]
        for w, got in enumerate(found[r.doc_id]):
            votes = [t if w == 0 else spark_hash((w,), spark_hash(t)) for t in terms]
            assert got == sum(1 << j for j in range(63) if 2 * sum(v >> j & 1 for v in votes) > len(votes)), (r, w, len(votes))


@pytest.mark.parametrize("bytes_", [200, 5000, 10**9])
def test_next_rows_over_many_buckets(spark, bytes_):
    draw = random.Random(4)
    ids = [*draw.sample(range(-(10**15), 10**15), 60), *range(100), *[None] * 80, *[7] * 90]
    rows = [(i, f"t{k}", draw.getrandbits(63) * draw.choice([1, -1])) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "i long, t string, tie long").repartition(5)
    got = {r.t: r.next_t for r in fingerprints.with_next(df, "i", "t", "tie", F.lit(100), bytes_).collect()}
    order = [t for _, t, _ in sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 1 << 64, r[2]))]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_buckets_follow_the_order_and_divide_a_crowded_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "QUANTILES", 16)
    draw = random.Random(6)
    rows = sorted([(i, draw.getrandbits(63) * draw.choice([1, -1])) for i in [*range(0, 4000, 2), *[500] * 4000]], key=lambda r: (-r[0], r[1]))
    ids = sorted(r[0] for r in rows)
    quantiles = [ids[min(len(ids) - 1, len(ids) * k // 16)] for k in range(17)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, i long, tie long")
    found = [r.b for r in df.select("k", fingerprints._bucket(F.col("i"), F.col("tie"), quantiles, 60).alias("b")).orderBy("k").collect()]
    assert found == sorted(found, reverse=True) and 40 <= len(set(found)) <= 90 and max(Counter(found).values()) < 300


def test_fingerprint_counts_run_over_no_lane(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 40)], "id long, t string")
    want = fingerprints.fingerprints(df, ["id"], ["t"]).collect()
    monkeypatch.setattr(fingerprints, "CHUNK_TERMS", 100)
    assert fingerprints.fingerprints(df, ["id"], ["t"]).collect() == want and want[0].copies == 1


def test_fingerprints_of_many_copies_run_over_no_lane(spark, monkeypatch):
    for name, value in {"LANE": 5, "WORD_BITS": 15, "CHUNK_TERMS": 31, "LANES": 1 << 10 | 1 << 5 | 1}.items():
        monkeypatch.setattr(fingerprints, name, value)
    text = "a b c d e f g h i j"
    one, many = (fingerprints.fingerprints(spark.createDataFrame([(1, text)] * n, "id long, t string"), ["id"], ["t"]).collect() for n in (1, 40))
    assert many[0].t_bits == one[0].t_bits and (one[0].copies, many[0].copies) == (1, 40)


def test_fingerprints_repeated_null_and_single(spark, empty):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, None), (2, "x y z")]
    found = fingerprints.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    one = fingerprints.compare_with_edited(spark.createDataFrame([(7, "a b c")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    assert fingerprints.compare_with_edited(empty).count() == 0


def test_within_radius(spark):
    draw = random.Random(3)
    values = [draw.getrandbits(63) for _ in range(40)]
    values += [v ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)) for v in values[:20]] + values[:3]
    rows = [(i, [v, 5]) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (99, None)], "id long, bits array<long>")
    got = {(r.query_id, r.id, r.distance) for r in fingerprints.within(df, df.where("id % 2 = 0"), "id", "bits", 3, 6).collect()}
    want = {(i, j, (a[0] ^ b[0]).bit_count()) for i, a in rows for j, b in rows if i != j and i % 2 == 0 and (a[0] ^ b[0]).bit_count() <= 3}
    assert got == want


def test_native_operators_have_no_python_in_their_plans(spark, docs):
    for df in (fingerprints.compare_with_edited(docs), url_filters.judge(docs.select("doc_id", F.col("text").alias("url")), spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string"), "doc_id")):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# -- 4

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "allow"), ("x.net", "/e", "block")]


def judged(url, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    best = max((r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_url_filters(spark):
    urls = ["http://A.com/", "https://www.Example.com/en/1?x#y", "http://m.example.com/en/", "http://example.com", "http://q.net/es/1", "http://x.net/es/", "http://y.net/e", "ftp://org/a?b/c", "com/", None, "", "http://a.com/://b", "x://?q", "http://evil-example.com/en/", "http://" + "a." * 300 + "com/" + "p/" * 300]
    rows = [(i % 5, u) for i, u in enumerate([*urls, *urls])]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    got = sorted(map(str, (tuple(r) for r in url_filters.judge(df, rules).collect())))
    assert got == sorted(str((i, *judged(u))) for i, u in rows)
    assert url_filters.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(df, rules.limit(0), default="block").collect()} == {"block"}


# -- 5


def test_plan_fills_bins():
    draw = random.Random(4)
    for capacity in (10, 64, 1024):
        counts = Counter(min(capacity, 1 + int(draw.expovariate(4 / capacity))) for _ in range(3000))
        plan = packing.plan(dict(counts), capacity)
        used = Counter()
        for taken, times in plan:
            assert sum(n * k for n, k in taken) <= capacity
            for n, k in taken:
                used[n] += k * times
        assert used == counts
        assert sum(t for _, t in plan) <= -(-sum(n * c for n, c in counts.items()) // capacity) + 1
    assert packing.plan({}, 5) == []
    with pytest.raises(ValueError):
        packing.plan({6: 1}, 5)


def test_fullest_is_optimal():
    draw = random.Random(9)
    for _ in range(50):
        lengths = [draw.randint(1, 30) for _ in range(8)]
        best = 0
        for mask in range(1 << 8):
            s = sum(n for i, n in enumerate(lengths) if mask >> i & 1)
            if s <= 40 and any(mask >> i & 1 and n == max(lengths) for i, n in enumerate(lengths)):
                best = max(best, s)
        assert sum(n * k for n, k in packing.fullest(dict(Counter(lengths)), 40)) == best


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path).collect()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = sorted((x for x in found if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [x.length for x in own] == [len(ids) % 1024 or 1024, *[1024] * ((len(ids) - 1) // 1024)] and [x.piece for x in own] == list(range(len(own)))
        for x in own:
            assert zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    sequences = {}
    for x in found:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert packing.pack_documents(empty, path).count() == 0
    odd = spark.createDataFrame([(None, "a<|endoftext|>b"), (1, "x"), (1, "x")], "doc_id long, text string")
    with_ids = packing.pieces(odd, path, with_ids=True).collect()
    assert sorted(len(r.ids) for r in with_ids) == [2, 2, 4] and 50256 in max(with_ids, key=lambda r: len(r.ids)).ids


# -- 6


def test_jump_moves_only_into_the_new_shard():
    keys = W.mix(np.arange(20_000, dtype=np.uint64))
    before = sharding.jump(keys, 1)
    assert not before.any()
    for n in range(2, 30):
        after = sharding.jump(keys, n)
        assert set(after[after != before]) == {n - 1} and abs((after == n - 1).mean() - 1 / n) < 0.02
        before = after


def test_sharding(spark, docs, empty, tmp_path):
    found = sharding.assign(docs, 24).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    slots = {}
    for r in found:
        t = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key") and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty, 24).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "x"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sharding.assign(odd, 3).collect()
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({(r.shard, r.slot) for r in got}) == 4
    sharding.write(odd, f"file://{tmp_path}/out", 3)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4
    with pytest.raises(ValueError):
        sharding.write(odd.withColumn("shard", F.lit(1)), "x", 3)


def test_slots_of_one_large_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), "id")
    assert sorted(r.s for r in frames.slots(df, ["g"], ["id"], "s", rows_per_window=50).collect()) == list(range(1000))


def test_filter_drops_no_partner(spark):
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("doc"))
    kept = {r.doc for r in frames.possible(spark.range(5000).select(F.col("id").alias("doc")), keys, "doc").collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 800
    assert frames.possible(spark.range(9).select(F.col("id").alias("doc")), keys.limit(0), "doc").count() == 0


# -- 7


def test_quality(spark):
    draw = random.Random(6)
    good = [text_of(draw, 60, 500).capitalize() + "." for _ in range(300)]
    bad = [" ".join(f"{w}$$$" if draw.random() < 0.7 else w.upper() for w in text_of(draw, 60, 500).split()) for _ in range(120)]
    rows = [(i, t, int(t in good)) for i, t in enumerate(draw.sample(good + bad, len(good) + len(bad)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None), (99999, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels, "quality")
    found = quality.score(df, model, keep=True).where("doc_id % 3 = 0").collect()
    assert sum((r.score >= 0.3) == bool(r.truth) for r in found) >= 0.97 * len(found)
    again = quality.fit(df, labels, "quality")
    assert (model.weights == again.weights).all()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, " ")], "doc_id long, text string")
    assert len({r.score for r in quality.score(odd, model).collect()}) == 1
    assert quality.score(odd.limit(0), model).count() == 0


def test_training_against_plain_updates():
    draw = np.random.default_rng(7)
    settings = quality.Settings(bits=4, epochs=2)
    rows = []
    for _ in range(40):
        index = np.unique(draw.integers(0, 16, 5))
        rows.append((index, draw.random(len(index)), int(draw.integers(0, 2))))
    z, n, bz, bn = [0.0] * 16, [0.0] * 16, 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= settings.l1:
            return 0.0
        return -(z[k] - math.copysign(settings.l1, z[k])) / ((settings.beta + math.sqrt(n[k])) / settings.alpha + settings.l2)

    order = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for r in order.permutation(len(rows)):
            index, values, label = rows[r]
            bias = -bz / ((settings.beta + math.sqrt(bn)) / settings.alpha)
            w = {k: weight(k) for k in index}
            g = 1 / (1 + math.exp(-sum(w[k] * v for k, v in zip(index, values, strict=True)) - bias)) - label
            for k, v in zip(index, values, strict=True):
                z[k] += g * v - (math.sqrt(n[k] + (g * v) ** 2) - math.sqrt(n[k])) / settings.alpha * w[k]
                n[k] += (g * v) ** 2
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / settings.alpha * bias
            bn += g * g
    model = quality.train(rows, settings)
    assert np.allclose(model.weights, [weight(k) for k in range(16)]) and math.isclose(model.bias, -bz / ((settings.beta + math.sqrt(bn)) / settings.alpha))


def test_quality_without_labels(spark, docs):
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_ftrl_uses_every_kind_of_feature():
    words = W.find(*W.buffers(pa.array(["Ab ab ab", "x"])), W.SPACES)
    found = quality.features(words, 18)
    assert found.shape == (quality.KINDS, 4) and found[0][1] == found[0][2] and found[4][2] != found[4][1] and found[2][0] != found[2][1]


# -- 8


def test_elias_fano():
    draw = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 5000), (1000, 5000), (3000, 1 << 48)):
        values = np.unique(draw.integers(0, top, n, dtype=np.uint64))
        found = elias_fano.EliasFano(values, top)
        assert (found.access(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), draw.integers(0, top, 50, dtype=np.uint64)])
        place, equal = found.successor(asked)
        assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie():
    contexts = np.array([3, 9, 12], np.uint64)
    first = (np.array([0, 0, 2]), np.array([5, 7, 5], np.uint64), 32, np.array([1, 2, 3], np.uint8))
    second = (np.array([1, 1, 2]), np.array([4, 6, 6], np.uint64), 24, np.array([7, 8, 9], np.uint8))
    trie = elias_fano.Trie(contexts, 48, [first, second])
    at = trie.context(np.array([3, 3, 9, 12, 4], np.uint64))
    assert at.tolist() == [0, 0, 1, 2, -1]
    pairs = trie.children(0, at, np.array([7, 6, 5, 5, 5], np.uint64))
    assert pairs.tolist() == [1, -1, -1, 2, -1] and trie.code(0, pairs).tolist() == [2, 0, 0, 3, 0]
    triples = trie.children(1, pairs, np.array([6, 6, 6, 6, 6], np.uint64))
    assert triples.tolist() == [1, -1, -1, 2, -1] and trie.code(1, triples).tolist() == [8, 0, 0, 9, 0]


def lower_words(t):
    return [*SPLIT.findall((t or "").translate(LOWER)), None]


def test_language_model_base(spark, docs, empty):
    train = F.col("doc_id") % 4 != 0
    found = {r.doc_id: r for r in language_model.score(docs, train).collect()}
    rows = {r.doc_id: lower_words(r.text) for r in docs.collect()}
    counts = Counter(w for i, ws in rows.items() if i % 4 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert found.keys() == rows.keys()
    for i, ws in rows.items():
        r = found[i]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 != 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    none = language_model.score(empty, F.lit(True))
    assert none.count() == 0
    untrained = language_model.score(docs, F.lit(None).cast("boolean")).collect()
    # Nothing is known: every token is the one unknown word.
    assert {(r.train_tokens, r.base_score, r.score) for r in untrained} == {(0, 0.0, 0.0)}


def test_language_model_prefers_the_order_it_saw(spark):
    base = [(i, t) for i, t in enumerate(["a b a b a b", "a b a b", "b a b a"] * 5)]
    df = spark.createDataFrame([*base, (100, "a b a b"), (101, "b b a a"), (102, "z z z z")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_model.score(df, F.col("doc_id") < 100).collect()}
    assert math.isclose(found[100].base_score, found[101].base_score) and found[100].score > found[101].score > found[102].score
    assert found[102].n_known == 1


def trigram_scores(texts, train):
    """The model's formula on plain counts."""
    rows = [lower_words(t) for t in texts]
    one, two, three, after = Counter(), Counter(), Counter(), {}
    for words, learn in zip(rows, train, strict=True):
        if learn:
            s = ["START", *words]
            one.update(words)
            two.update(zip(s, s[1:], strict=False))
            for x in zip(s, s[1:], s[2:], strict=False):
                three[x] += 1
                after.setdefault(x[:2], set()).add(x[2])
    n, v = sum(one.values()), len(one)
    one["START"] = one[None]

    def probability(u, v_, w):
        alone = (one[w] + 0.1) / (n + 0.1 * (v + 1))
        p = (two[v_, w] + language_model.MU * alone) / (one[v_] + language_model.MU)
        c = two[u, v_]
        return max(three[u, v_, w] - language_model.D, 0) / c + language_model.D * len(after[u, v_]) / c * p if c else p

    return [sum(math.log10(probability(*x)) for x in zip([None, "START", *w], ["START", *w], w, strict=False)) for w in rows]


def test_language_model_score_against_plain_counts(spark, docs):
    rows = docs.collect()
    want = trigram_scores([r.text for r in rows], [r.doc_id % 4 != 0 for r in rows])
    found = {r.doc_id: r for r in language_model.score(docs, F.col("doc_id") % 4 != 0).collect()}
    step = -elias_fano.Codebook.LOWEST / 254
    for r, w in zip(rows, want, strict=True):
        got = found[r.doc_id]
        assert w - 2 * step * got.n_tokens <= got.score <= w + 1e-6  # codes are rounded down by less than a step each


@pytest.mark.parametrize("units, shards", [(1, 1), (3, 7), (2, 300)])
def test_units_and_shards_change_nothing(units, shards):
    texts = [t or "" for _, t in documents(5, 40)]
    train = np.arange(len(texts)) % 3 != 0
    parts = [language_model.Unit(pa.array(texts[k::units]), train[k::units], shards) for k in range(units)]
    answers, total = [[] for _ in parts], np.zeros(2, int)
    for s in range(shards):
        asked = [(k, q) for k, u in enumerate(parts) if (q := u.question(s)) is not None]
        if asked:
            found, sums = language_model._answers([q for _, q in asked])
            total += sums
            for (k, _), a in zip(asked, found, strict=True):
                answers[k].append((s, a))
    got = np.zeros(len(texts))
    for k, u in enumerate(parts):
        got[k::units] = language_model._scored(u, answers[k], *total)[2]
    whole = language_model.Unit(pa.array(texts), train, 1)
    (answer,), sums = language_model._answers([whole.question(0)])
    assert sums == total.tolist()
    # Only a word's followers, dealt over other contexts, are quantised against other totals.
    assert np.abs(got - language_model._scored(whole, [(0, answer)], *sums)[2]).max() <= 0.04 * max(len(t.split()) + 1 for t in texts)


def test_probabilities_after_a_context_sum_to_one():
    learned = ["a b a c a b d", "b a b", "c c a e", "a b a"]
    words = [*"abcde", "END", "unknown"]
    for context in (["a", "b"], ["b", "a"], ["a"], ["e", "e"], ["z", "a"]):
        asked = [" ".join([*context, *([] if w == "END" else [w])]) for w in words]
        unit = language_model.Unit(pa.array(learned + asked), np.arange(len(learned) + len(asked)) < len(learned), 1)
        (answer,), sums = language_model._answers([unit.question(0)])
        p = language_model._probabilities(unit, [(0, answer)], *sums)[2]
        total = p[unit.starts[len(learned) :] + len(context)].sum()
        assert 0.85 < total <= 1 + 1e-9


def test_language_model_beats_its_base_on_repeated_patterns(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(f"{a} {a}x" for a in draw.choices("abcdefgh", k=20))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in language_model.score(df, F.col("doc_id") % 5 != 0).collect() if not r.trained]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


# -- 9


def test_fm_index():
    draw = random.Random(2)
    for _ in range(150):
        n, k = draw.randint(0, 60), draw.randint(1, 4)
        s = np.array([draw.randrange(k) for _ in range(n)], np.int64)
        assert fm_index.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        index = fm_index.FmIndex(s, k)
        phrases = [[draw.randrange(k) for _ in range(draw.randint(1, 4))] for _ in range(8)]
        table = np.full((8, 4), -7, np.int64)
        for row, p in zip(table, phrases, strict=True):
            row[4 - len(p) :] = p
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - len(p) + 1) if s[i : i + len(p)].tolist() == p]


def contamination(docs, items, window=13):
    phrases = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            phrases.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for p, names in phrases.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit.update(range(j, j + len(p)))
                    found |= names
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(map(str, out))


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_decontamination(spark, empty, block_bytes):
    draw = random.Random(12)
    items = [(i, text_of(draw, draw.choice([0, 3, 13, 14, 40]), 6)) for i in range(12)] + [(20, None), (21, "..."), (1, text_of(draw, 20, 6)), (None, "Only-Here in null")]
    docs = [(i, " ".join([text_of(draw, 30, 6), draw.choice(items)[1] or "", text_of(draw, 10, 6)]).upper()) for i in range(40)]
    docs += [(50, None), (51, ""), (52, items[2][1]), (52, items[2][1]), (None, "only here, in NULL")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, [1]) for i, t in docs], "doc_id long, text string, spans array<int>")
    blocks = decontamination.phrase_blocks(benchmark, block_bytes=block_bytes)
    assert len(blocks) > 1 or block_bytes > 300
    found = decontamination.judged(decontamination.scan(df, blocks)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in found) == contamination(docs, items)
    assert decontamination.scan(empty, blocks).count() == 0
    none = decontamination.phrase_blocks(benchmark.limit(0))
    assert none == [] and {len(r.spans) for r in decontamination.scan(df, none).collect()} == {0}


def test_decontamination_keeps_the_rest(spark):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "A, one two  THREE! b", "z"), (2, "clean text", "z")], "doc_id long, text string, x string")
    found = decontamination.scan(df, decontamination.phrase_blocks(benchmark), keep=True)
    assert found.columns == ["doc_id", "text", "x", "n_words", "spans", "items", "kept"]
    assert {r.doc_id: r.kept for r in found.collect()} == {1: "A, ! b", 2: "clean text"}


# -- 10


def near_groups(rows):
    sets = []
    for i, t in rows:
        w = SPLIT.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return sorted(str((i, len(s), top(i), top(i) == i)) for i, s in sets)


@pytest.mark.parametrize("settings", [near_duplicates.Settings(), near_duplicates.Settings(small=2, depth=3, trees=40), near_duplicates.Settings(small=2, depth=4, trees=30, hot=3)])
def test_near_duplicates(spark, docs, settings):
    found = near_duplicates.groups(docs, settings=settings).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found) == near_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_among_many_that_are_almost_linked(spark):
    # One template: all pairs are alike (0.48 on average), few are linked. Recall is measured in links' ends.
    draw = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for _ in range(1000):
        w = list(base)
        for k in draw.sample(range(120), 5):
            w[k] = f"e{draw.randrange(10**7)}"
        docs.append(w)
    for w in docs[:300]:
        w = list(w)
        for k in draw.sample(range(120), 3):
            w[k] = f"x{draw.randrange(10**7)}"
        docs.append(w)
    draw.shuffle(docs)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in docs]
    codes = {x: k for k, x in enumerate(sorted({x for s in sets for x in s}))}
    there = np.zeros((len(docs), len(codes)), np.float32)
    for row, s in zip(there, sets, strict=True):
        row[[codes[x] for x in s]] = 1
    both, n = there @ there.T, there.sum(1)
    linked = 100 * both >= 75 * (n[:, None] + n - both)
    want = near_duplicates._components(len(docs), *np.nonzero(linked))
    got = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert 0.4 < (both / (n[:, None] + n - both)).mean() < 0.6 and len(set(want)) < 1001
    found = {r.doc_id: r.component_id for r in got}
    assert sum(found[i] == want[i] for i in range(len(docs)) if (want == want[i]).sum() > 1) >= 0.95 * sum((want == want[i]).sum() > 1 for i in range(len(docs)))
    assert all(found[i] >= want[i] for i in range(len(docs)))


def test_near_duplicates_of_an_id_with_several_texts(spark):
    draw = random.Random(13)
    a, b, c = (text_of(draw, 40, 9999) for _ in range(3))
    rows = [(5, a), (5, b), (9, b + " more"), (7, a + " more"), (6, c), (8, c + " x")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (6, 6), (8, 6)}


def test_near_duplicates_large_group_and_chain(spark):
    draw = random.Random(7)
    base = text_of(draw, 120, 9999).split()
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(draw.randrange(3)):
            w[draw.randrange(len(w))] = f"n{draw.randrange(50)}"
        rows.append((i, " ".join(w)))
    chain = text_of(draw, 100, 9999).split()
    for i in range(400, 440):
        chain[(i * 5) % 100] = f"c{i}"
        rows.append((i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.groups(df).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found) == near_groups(rows)


@pytest.mark.parametrize("limits", [{"small": 2}, {"small": 2, "hot": 9}, {"small": 64, "sure": 0.3}])
def test_near_duplicates_failed_links_are_replaced(spark, limits):
    # Estimates from few tokens mislead, so that many a first choice (leader's, nearest, smallest or forest link) fails.
    draw = random.Random(3)
    rows = []
    for _ in range(2):
        w = text_of(draw, 90, 9999).split()
        for _ in range(60):
            for _ in range(draw.randrange(1, 3)):
                w[draw.randrange(len(w))] = f"n{draw.randrange(9999)}"
            rows.append((0, " ".join(w)))
    ids = draw.sample(range(1000), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    settings = near_duplicates.Settings(depth=1, trees=12, unsure=0.01, **limits)
    found = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string"), settings=settings).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found) == near_groups(rows)


def test_near_duplicates_repeated_and_null_ids(spark, empty):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "A B C d e f g"), (None, None), (3, "x"), (4, "X"), (5, "")]
    got = sorted(str(tuple(r)) for r in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (None, 3, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]
    assert [x for x in got if not x.startswith("(None, 0")] == sorted(map(str, want))
    assert near_duplicates.groups(empty).count() == 0


def test_components(spark):
    draw = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = {r.node: r.component for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: parent[x] for a, b in edges if a != b for x in (a, b)}
