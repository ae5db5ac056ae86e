"""Operators on pages, urls and images."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docledger.llm import common as C
from docledger.llm import html_template as H
from docledger.llm import images as I
from docledger.llm import url_lists as U
from docledger.llm import warc as W


def page(k: int, body: str) -> str:
    return f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><header>Site <b>name</b></header><nav><ul><li><a href=x>Menu {k}</a></ul></nav><div class='cookie-notice'>We use cookies</div><div id=sidebar>side {k}</div><article>{body}<form>mail <input></form><div class=comments><p>first!</p></div></article><footer>&copy; 20{k}</footer></body></html>"


def test_extraction(spark):
    rows = [(k, f"http://h.example/{k}", page(k, f"<h1>Head &amp; {k}</h1><p>one\n two<br>three<p><b>four</b> &lt;5&gt; <script>x()</script></p>")) for k in range(6)]
    rows += [(50, "http://h.example/x", None), (51, None, ""), (52, "http://other/1", "plain &amp; text"), (53, "", "<p>a<p>b<!-- c --> d"), (None, None, None), (0, rows[0][1], rows[0][2]), (54, "http://h.example/54", page(54, "<p>cut off")[:-40])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "host": F.lit("h"), "template": F.lit("t")})
    got = H.extract_text(pages)
    assert {"host", "template", "page_id", "url"} <= set(got.columns)
    text = {r.page_id: r.text for r in got.collect()}
    for k in range(6):
        assert text[k] == f"Head & {k}\n\none two three\n\nfour <5>"
    assert text[50] == text[51] == text[None] == ""
    assert (text[52], text[53], text[54]) == ("plain & text", "a\n\nb d", "cut off")
    assert got.count() == len(rows)
    assert H.extract_text(pages.limit(0)).count() == 0


def test_words_of_the_template_go(spark):
    html = "<body><div>Our shop sells things</div><div><p>{0} text that only {0} has</p></div><div>Write to us today</div></body>"
    pages = spark.createDataFrame([(k, f"http://shop/{k}", html.format(f"page{k}")) for k in range(8)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_text(pages).collect()} == {f"page{k} text that only page{k} has" for k in range(8)}


def test_equal_pages_keep_their_article(spark):
    pages = spark.createDataFrame([(k, f"http://one/{k}", page(1, "<h1>Same</h1><p>text everywhere</p>")) for k in range(5)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_text(pages).collect()} == {"Same\n\ntext everywhere"}


def extracted(spark, rows: list[tuple]) -> list[str]:
    got = H.extract_text(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_articles_that_the_template_lacks(spark):
    text = [f"own{k} text of number{k}" for k in range(4)]
    one = [f"<html><body><nav>menu</nav><article><p>{t}</p></article><div class=ad>buy</div></body></html>" for t in text]
    index = "<html><body><nav>menu</nav><div><p>welcome to all</p></div></body></html>"
    two = "<html><body><nav>menu</nav><article><p>first</p></article><article><p>second</p></article></body></html>"
    assert extracted(spark, [("http://i/", h) for h in [*one, index]]) == [*text, "welcome to all"]
    assert extracted(spark, [("http://i/", h) for h in [*one, two]]) == [*text, "first\n\nsecond"]
    assert extracted(spark, [("http://i/", h) for h in [*one, one[0][:24]]]) == [*text, ""]
    ids = [f"<html><body class='postid-{k}'><main><article id=post-{k}><p>{t}</p></article><p>after {t}</p></main></body></html>" for k, t in enumerate(text)]
    assert extracted(spark, [("http://i/", h) for h in ids]) == [f"{t}\n\nafter {t}" for t in text]
    unlike = [*one[:2], f"<html><body><main><h1>{text[2]}</h1></main></body></html>", "<html><body><table><tr><td>other site</table></body></html>"]
    assert extracted(spark, [(None, h) for h in unlike]) == [*text[:3], "other site"]


def test_frequent_words_of_content_stay(spark):
    html = "<body><div>Our shop sells things</div><div><h2>About number{0}</h2><p>Thanks for reading this</p><p>{1}</p></div></body>"
    shop = [html.format(k, f"page{k} text that only page{k} has") for k in range(6)]
    same = ["Thanks for reading this" in t and "Our shop" not in t for t in extracted(spark, [("http://s/", h) for h in shop])]
    assert all(same)
    # Copies of one page, and copies that differ in a count, are no template.
    whole = "Our shop sells things\n\nAbout number0\n\nThanks for reading this\n\npage0 text that only page0 has"
    assert extracted(spark, [("http://s/", h) for h in (shop[0], shop[0], shop[1])])[0] == whole
    counts = [f"<body><h1>An article</h1><div>It has these many words of text</div><table><tr><td>{k} views</table></body>" for k in range(4)]
    assert extracted(spark, [("http://s/", h) for h in counts]) == [f"An article\n\nIt has these many words of text\n\n{k} views" for k in range(4)]
    # Words behind a void element of the template, and a heading of one word.
    void = [f"<body><input><p>text of number{k}</p><h2>Notes</h2><div>more of number{k}</div></body>" for k in range(4)]
    assert extracted(spark, [("http://s/", h) for h in void]) == [f"text of number{k}\n\nNotes\n\nmore of number{k}" for k in range(4)]


def test_attributes_and_marks(spark):
    text = "<p>the article's own text</p>"
    kept = ["style='overflow:hidden'", "title='a hidden gem'", "data-href=/a/hidden/", "class='content-sidebar-wrap'", "class='with-sidebar'", "class=header-fixed", "class=sidebar-wrap", "id=menu-page"]
    for name in ("div", "section"):
        rows = [("", f"<body><{name} {a}><article>{text}</article></{name}></body>") for a in kept]
        assert extracted(spark, rows) == ["the article's own text"] * len(kept)
    rows = [f"<body style='overflow:hidden'>{text}</body>", f"<article title='hidden gem'>{text}</article>", f"<div class=with-sidebar>{text}</div>", f"<article>{text}<figure><figcaption>caption</figcaption></figure></article>"]
    assert extracted(spark, [("", h) for h in rows]) == ["the article's own text"] * 3 + ["the article's own text\n\ncaption"]
    # Hidden elements, readers' comments, and articles of a side bar aren't the article.
    gone = ["<div hidden>x</div>", "<div HIDDEN=''>x</div>", "<div aria-hidden=true>x</div>", "<div class='a sidebar'>x</div>", "<article class=comment>x</article>", "<div id=comments><article>x</article></div>"]
    assert extracted(spark, [("", f"<body><article>{text}{g}</article></body>") for g in gone]) == ["the article's own text"] * len(gone)
    assert extracted(spark, [("", f"<body><div>{text}</div>{g}</body>") for g in gone]) == ["the article's own text"] * len(gone)
    assert extracted(spark, [("", f"<div>{text}</div><div class=sidebar><article>other</article></div>"), ("", f"<article>{text}</article><div class=related><article>other</article></div>")]) == ["the article's own text"] * 2


def shop(k: int, n: int = 3) -> str:
    """A page whose elements say nothing: an own first line, n paragraphs, and on some pages a list that repeats."""
    lines = "".join(f"<div>line{j} of page{k} has words of its own</div>" for j in range(n))
    optional = "<dl><dd>Join our club today</dd><dd>It costs you nothing</dd></dl>" if k % 4 else ""
    return f"<body><table><tr><td>Our shop sells things</td><td>Open from nine to five</td></tr></table><section><p>page{k} begins here</p>{lines}</section>{optional}<ol><li>Write to us today</li></ol></body>"


def test_template_decides_without_helpful_tags(spark, monkeypatch):
    rows = [(f"http://shop/{k}", shop(k, 2 + k % 3)) for k in range(8)]
    want = ["\n\n".join([f"page{k} begins here", *(f"line{j} of page{k} has words of its own" for j in range(2 + k % 3))]) for k in range(8)]
    got = extracted(spark, rows)
    assert got == want
    monkeypatch.setattr(H, "SUPPORT", 2.0)  # no class is frequent: templates are off
    off = extracted(spark, rows)
    assert all(a != b and "Our shop sells things" in b for a, b in zip(got, off, strict=True))


def test_template_inside_articles(spark):
    rows = [(f"http://news/{k}", f"<body><article><h1>News of the day</h1><p>text{k} of number{k}</p><div>Tell your friends about us</div></article></body>") for k in range(5)]
    assert extracted(spark, rows) == [f"News of the day\n\ntext{k} of number{k}" for k in range(5)]
    rows = [("", f"<article><p>a b</p><figure><figcaption>cap tion</figcaption></figure><label>la bel</label><div class={c}>in side</div></article>") for c in ("discussion", "side-by-side", "paper-discussion")]
    assert extracted(spark, rows) == ["a b\n\ncap tion\n\nla bel\n\nin side"] * 3


def test_classes_by_brute_force(spark):
    """Every large and frequent group of tokens with equal counts on all unlike pages, and no other."""
    pages = [("a", shop(k, 1 + k % 3)) for k in range(9)] + [("b", shop(k)) for k in range(2)] + [("c", page(k, f"<p>own {k}</p>")) for k in range(4)]
    got = H.equivalence_classes(H.unlike(spark.createDataFrame([(k, *p) for k, p in enumerate(pages + pages[:4])], "page_id long, host string, html string"))).collect()
    want = set()
    for host in "abc":
        counts = [H.Counter((h, t is not None) for h, t in H._page(html)) for name, html in pages if name == host]
        vectors = {}
        for token in set().union(*counts):
            v = tuple(c[token] for c in counts)
            if sum(n > 0 for n in v) >= max(H.LEAST_PAGES, H.SUPPORT * len(counts)) and token != (H.HEADING, True):
                vectors.setdefault(v, []).append(token)
        for v, tokens in vectors.items():
            if len(tokens) >= H.LEAST_TOKENS and len(counts) >= H.LEAST_PAGES:
                want.add((host, v == (1,) * len(counts), frozenset(h for h, text in tokens if not text), frozenset(h for h, text in tokens if text)))
    assert {(r.host, r.is_root, frozenset(r.tokens), frozenset(r.texts)) for r in got} == want and any(not w[1] for w in want)


def test_hostile_markup():
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert H.extract(deep, None) == "deep"
    long = "<article>" + "<p>some words &amp; more</p>" * 20_000 + "</article>"
    assert H.extract(long, None).count("some words & more") == 20_000
    for html in ("<", "<!--", "<div class='", "<a href=\"x>y", "</p></p>", "<script>", "&#xFFFFFFF;", "<p" * 1000, "<!doctype", "\x00<p>a"):
        assert isinstance(H.extract(html, None), str)


def test_archives(spark):
    big = "é" * 90_000
    rows = [(3, "http://a/3", big), (1, "http://a/b c\r\nX: y", big), (2, None, big), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (7, "u", ""), (1, "http://a/b", big), (None, "n", "y" * 200), (8, "u", "y" * 200)]
    folder = W.C.scratch(spark)
    archives = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), folder)
    got = W.read_archives(spark, folder, archives, payloads=True).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    n = len(big.encode())
    assert kinds == sorted([(3, "revisit", 1, n), (1, "response", None, n), (1, "response", None, n), (2, "revisit", 1, n), (4, "response", None, 99), (5, "response", None, 99), (6, "response", None, 0), (7, "response", None, 0), (-1, "response", None, 200), (8, "response", None, 200)])
    assert all(bytes(r.payload).decode() == big for r in got if r.page_id == 1)
    assert W.read_archives(spark, folder + "-none", archives.limit(0)).count() == 0
    none = C.materialize(W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder + "-empty"))
    assert none.count() == 0


def test_revisits_need_their_response(spark):
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
    rows = [(1, 200, "aa", "response", None, True), (2, 200, "aa", "revisit", 1, False), (3, 200, "bb", "revisit", 1, False), (4, 201, "aa", "revisit", 1, False), (5, 200, "aa", "revisit", 9, False), (6, 200, "cc", "response", None, False), (7, 200, "cc", "revisit", 6, False), (1, 200, "aa", "response", None, True)]
    got = {r.page_id: r.verified for r in W._revisits_verified(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert W._revisits_verified(spark.createDataFrame(rows, columns)).count() == len(rows)


def test_broken_segments():
    payload = b"z" * (W.SEGMENT * 3)
    parts = W.records(9, "u", payload, None, "0.1")
    assert len(parts) == 4 and sum(b"WARC-Segment-Total-Length" in p for p in parts) == 1
    assert W.unchunked(W.chunked(payload)) == payload
    try:
        W.unchunked(W.chunked(payload)[:-9])
    except ValueError:
        pass
    else:
        raise AssertionError("a cut body was taken")


def test_validity_and_as_of(spark):
    events = [("bad", "domain", "x.example", "add", 10), ("bad", "domain", "x.example", "remove", 20), ("bad", "domain", "x.example", "add", 30), ("bad", "domain", "x.example", "add", 30), ("tie", "domain", "x.example", "add", 5), ("tie", "domain", "x.example", "remove", 5), ("dir", "prefix", "a.x.example/p/", "add", 0), ("one", "url", "b.example/q", "add", 0), (None, "url", "b.example/q", "add", 0)]
    captures = [(1, "http://A.x.example/p/1?q", 10), (2, "http://a.x.example/p", 20), (3, "http://x.example", 31), (4, "https://b.example:80/q#f", 1), (5, None, 3), (6, "nothing", 3), (7, "http://x.example/", None), (1, "http://A.x.example/p/1?q", 10)]
    got = U.evaluate_captures(spark.createDataFrame(captures, "id long, url string, fetched long").withColumn("lists", F.lit(0)), spark.createDataFrame(events, "list string, scope string, pattern string, action string, at long"))
    rows = sorted((r.id, r.n_active, r.lists, r.blocked) for r in got.collect())
    assert rows == [(1, 2, "bad,dir", True), (1, 2, "bad,dir", True), (2, 0, "", False), (3, 1, "bad", True), (4, 1, "one", True), (5, 0, "", False), (6, 0, "", False), (7, 0, "", False)]


def test_url_lists_oracle(spark):
    c = duckdb.connect()
    c.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = c.execute(U.ORACLE_SQL)
    columns = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in U.query(spark, "/root/testdata/sf0.01").select(*columns).collect())


def textures(n: int, seed: int = 9) -> list[np.ndarray]:
    """Images of SIDE times SIDE grey levels: noise of two scales."""
    random = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = I._box(random.normal(0, 1, (1, I.SIDE, I.SIDE)), 2) * 5 + I._box(random.normal(0, 1, (1, I.SIDE, I.SIDE)), 5) * 8
        out.append(np.floor(20 + 200 * (a[0] - a.min()) / np.ptp(a)))
    return out


def test_recall_of_each_edit(spark):
    """100 images among as many edited copies of each kind, of other sizes too."""
    n, rows = 100, []
    more = {"scale 0.75": lambda a: I.warped(a, 0, 0.75), "inner half": lambda a: a[14:-14, 14:-14], "colour, larger": lambda a: I.warped(a, 0, 1.3)}
    kinds = [*I.EDITS, *more]
    for k, a in enumerate(textures(n)):
        rows.append((k, a, 1))
        rows += [(1000 * (j + 1) + k, more[kind](a) if kind in more else I.edited(a, kind, k), 3 if kind.startswith("colour") else 1) for j, kind in enumerate(kinds)]
    rows = [(k, np.repeat(a.astype(np.uint8)[:, :, None], c, axis=2).tobytes(), a.shape[1], a.shape[0]) for k, a, c in rows]
    images = spark.createDataFrame(rows, "id long, pixels binary, width int, height int").repartition(8)
    got = I.find_copies(images, F.col("id") < n).toPandas().set_index("id")
    recall = {kind: float((got.best_query.loc[[1000 * (j + 1) + k for k in range(n)]].to_numpy() == np.arange(n)).mean()) for j, kind in enumerate(kinds)}
    assert min(recall.values()) >= 0.9, recall
    assert (got.loc[range(n)].n_queries == 0).all()


def test_edited_copies_are_found(spark):
    got = I.query(spark, "/root/testdata/sf0.001").toPandas()
    copies = got[(got.id < 0) & ((-1 - got.id) % 100 == 0)]
    assert len(copies) and (copies.best_query == -1 - copies.id).mean() >= 0.9
    assert (got[got.n_queries > 0].id < 0).all()


def test_tables_find_close_descriptors():
    """Descriptors that differ in a tenth of their bits share a key of some table."""
    random = np.random.default_rng(1)
    a = random.integers(-(2**63), 2**63 - 1, (2000, 2))
    flips = np.packbits(random.random((2000, 128)) < 0.1, axis=1).view(np.int64)
    b = a ^ flips
    met = (I.keys_of(a[:, 0], a[:, 1]) == I.keys_of(b[:, 0], b[:, 1])).any(axis=1)
    assert met.mean() > 0.6


def test_consensus_by_brute_force():
    random = np.random.default_rng(5)
    for n in (1, 7, 60, 300):
        q = np.column_stack([random.uniform(0, 96, (n, 2)), random.uniform(-3, 3, n), random.choice(I.SCALES, n)])
        m = q.copy()
        m[:, :2] += 5
        wrong = random.random(n) < 0.3
        m[wrong, :2] = random.uniform(0, 96, (wrong.sum(), 2))
        best = 0
        for i in range(n):
            turn, grow = m[i, 2] - q[i, 2], q[i, 3] / m[i, 3]
            turned = q[:, :2] @ (grow * np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]]))
            good = np.hypot(*(turned - turned[i] + m[i, :2] - m[:, :2]).T) <= I.SLACK
            best = max(best, min(len({(int(a) >> 3, int(b) >> 3) for a, b in p[good, :2]}) for p in (q, m)))
        assert I.consensus(q, m) == best


def test_images_odd_rows(spark):
    flat, noise = bytes(I.SIDE**2), np.random.default_rng(2).integers(0, 255, I.SIDE**2).astype(np.uint8).tobytes()
    rows = [(0, noise), (7, noise), (100, noise), (8, flat), (9, None), (10, b"abc"), (None, noise), (0, noise)]
    got = I.find_copies(spark.createDataFrame(rows, "id long, pixels binary"), F.col("id") % 100 == 0).collect()
    assert sorted((r.id if r.id is not None else -1, r.class_id, r.n_queries) for r in got) == sorted([(0, 0, 0), (0, 0, 0), (7, 0, 0), (100, 0, 0), (8, 8, 0), (9, 9, 0), (10, 10, 0), (-1, 0, 0)])
    assert I.find_copies(spark.createDataFrame([], "id long, pixels binary"), F.col("id") % 100 == 0).count() == 0


def rows_made(spark, run) -> tuple:
    """What run() gives, and the most rows that a join or a function on batches made for it."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    bus.waitUntilEmpty()
    before = {e.executionId() for e in each(store.executionsList())}
    result = run()
    bus.waitUntilEmpty()
    most = 0
    for k in (e.executionId() for e in each(store.executionsList()) if e.executionId() not in before):
        values, it = {}, store.executionMetrics(k).iterator()
        while it.hasNext():
            pair = it.next()
            values[pair._1()] = pair._2()
        for node in each(store.planGraph(k).allNodes()):
            if "Join" in node.name() or "Arrow" in node.name():
                counts = [values.get(m.accumulatorId(), "0") for m in each(node.metrics()) if m.name() == "number of output rows"]
                most = max([most, *(int(c.replace(",", "")) for c in counts)])
    return result, most


def near_images(n: int) -> list[tuple]:
    """One texture with a little noise, n times, and as many unlike ones."""
    random, (base, *others) = np.random.default_rng(4), textures(n + 1, 8)
    group = [np.clip(base + random.normal(0, 2, base.shape), 0, 255) for _ in range(n)]
    return [(k, a.astype(np.uint8).tobytes()) for k, a in enumerate(group + others)]


def test_near_copies_make_no_row_for_a_pair(spark):
    n, asked = 90, 45
    images = spark.createDataFrame(near_images(n), "id long, pixels binary").repartition(4)
    got, most = rows_made(spark, lambda: {r.id: (r.n_queries, r.best_query is None) for r in I.find_copies(images, F.col("id") < asked).collect()})
    assert got == {k: (asked - (k < asked) if k < n else 0, k >= n) for k in range(2 * n)}
    assert n <= most <= 4 * n, most


def test_index_in_shards_finds_the_same(spark, monkeypatch):
    rows = near_images(40) + [(-1 - k, I.edited(a, I.EDITS[k % 2 * 5], k)[:96, :96].astype(np.uint8).tobytes()) for k, a in enumerate(textures(41, 8)[1:])]
    images = spark.createDataFrame(rows, "id long, pixels binary").repartition(4)
    find = lambda: sorted(map(tuple, I.find_copies(images, F.col("id") % 2 == 0).collect()), key=str)
    whole = find()
    assert sum(r[2] > 0 for r in whole) > 50
    for name, value in (("INDEX_BYTES", 1 << 20), ("SLICE_BYTES", 100_000), ("BLOCK", 8), ("AT_ONCE", 1000)):
        monkeypatch.setattr(I, name, value)
    found = []
    monkeypatch.setattr(I, "_by_shards", lambda *a, f=I._by_shards: found.append(a[3]) or f(*a))
    assert find() == whole and found[0] > 2


def test_index_meets_each_close_pair_once():
    """Against all pairs: those within RADIUS bits that share a key of some table, in any number of shards."""
    random = np.random.default_rng(6)
    a = random.integers(-(2**63), 2**63 - 1, (300, 2))
    b = np.concatenate([a ^ np.packbits(random.random((300, 128)) < p, axis=1).view(np.int64) for p in (0.0, 0.05, 0.1, 0.15)])
    place = np.zeros(len(b), np.float32)
    own = np.repeat(np.arange(30), 10)
    queries = pa.record_batch({"id": np.arange(30)} | I._lists((*[place[:300]] * 4, *a.T.copy()), np.arange(0, 301, 10)))
    differ = (np.unpackbits(a.view(np.uint8), axis=1)[:, None] != np.unpackbits(b.view(np.uint8), axis=1)[None]).sum(axis=2)
    for size in ((10, 20), (16, 24)):
        shared = (I.keys_of(a[:, 0], a[:, 1], *size)[:, None] == I.keys_of(b[:, 0], b[:, 1], *size)[None]).any(axis=2)
        other = own[:, None] != (np.arange(len(b)) % 60)[None]
        want = sorted(map(tuple, np.argwhere(shared & (differ <= I.RADIUS) & other).tolist()))
        assert len(want) > 400
        for shards in (1, 3):
            got = [(q, r) for s in range(shards) for rs, qs in I.Index(queries, size, shards, s).meet(np.arange(len(b)) % 60, *b.T.copy()) for r, q in zip(rs.tolist(), qs.tolist(), strict=True)]
            assert sorted(got) == want


def test_keys_grow_with_the_queries():
    """Close descriptors still meet, and those that meet by chance don't grow with the index."""
    random = np.random.default_rng(1)
    a = random.integers(-(2**63), 2**63 - 1, (2000, 2))
    b = a ^ np.packbits(random.random((2000, 128)) < 0.1, axis=1).view(np.int64)
    assert I.tables_for(0) == I.tables_for(I.MANY) == (I.TABLES, I.KEY_BITS)
    for times in (2, 5, 30, 1000):
        tables, bits = I.tables_for(times * I.MANY)
        assert 2 ** ((bits - I.KEY_BITS) / 1.75) >= times and bits <= I.MOST_BITS
        assert (I.keys_of(*a.T, tables, bits) == I.keys_of(*b.T, tables, bits)).any(axis=1).mean() > 0.6
