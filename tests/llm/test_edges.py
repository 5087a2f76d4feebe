"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lumentrace.llm import curriculum, line_dedup, main_text, packing, pii, quality, simhash_groups, topk, toxicity, warc

LONG = "word " * 30_000 + "end"
ROWS = [(1, "Some text of a few words here.", "a", 9), (1, "Some text of a few words here.", "a", 9), (2, None, "b", 9), (3, "", None, 9), (None, "no id", "a", 9), (4, LONG, "a", 9), (5, "café \U0001f600 中文", "b", 9), (1, "Another text under one id.", "a", 9)]
#: Columns with names that operators use inside.
CLASHING = "length place row key nth time times plans _key _nth _time _gone _text_hash _toxicity score gone again first fp root changed order slice size target begin".split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHING)
ROWS = [(*r, *[9] * (len(CLASHING) - 1)) for r in ROWS]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "packing": lambda d: packing.pack(packing.pieces(d)),
        "curriculum": curriculum.mix,
        "line_dedup": line_dedup.clean_documents,
        "pii": pii.find_private,
        "toxicity": lambda d: toxicity.drop_toxic(d, labels),
        "quality": lambda d: quality.scored(d, quality.train(d, labels)),
        "simhash": simhash_groups.near_duplicate_groups,
        "keep_first": simhash_groups.keep_first,
    }


@pytest.mark.parametrize("name", operators(None))
def test_odd_rows(name, docs, labels):
    out = operators(labels)[name](docs)
    got = out.count()
    if name in ("pii", "quality", "simhash", "line_dedup"):
        assert got == len(ROWS)
    if name in ("line_dedup", "keep_first", "curriculum", "toxicity"):
        assert out.columns == docs.columns
        assert all(r[c] == 9 for r in out.collect() for c in CLASHING)


@pytest.mark.parametrize("name", operators(None))
def test_empty_table(name, docs, labels):
    assert operators(labels)[name](docs.limit(0)).count() == 0


def test_lines_of_repeated_rows(spark):
    rows = [(1, "alpha beta\n\ngamma"), (1, "alpha beta\n\ngamma"), (1, "alpha beta\n\ngamma"), (None, "only one"), (None, "only one"), (2, "gamma\ndelta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in line_dedup.clean_documents(docs).collect())
    assert kept == [(0, ""), (0, "only one"), (1, ""), (1, ""), (1, "alpha beta\n\ngamma"), (2, "delta")]


def test_one_unbroken_word_of_megabytes(spark, labels):
    long = spark.createDataFrame([(1, "x" * 3_000_000, "a"), (2, "1" * 1_000_000, "a"), (3, "jdbc:" * 200_000, "a")], "doc_id long, text string, source string")
    for name, operator in operators(labels).items():
        assert operator(long).count() >= (0 if name == "toxicity" else 2), name


def test_lines_of_rows_without_doc_id(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, f"{line}\nalpha only"), (None, f"{line}\nbeta only"), (None, f"{line} ten\ngamma only"), (7, f"{line}\ndelta only"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in line_dedup.clean_documents(docs).collect()]
    assert len(got) == 5 and got.count(None) == 1
    kept = sorted(x for t in got if t for x in t.split("\n"))
    assert [x for x in kept if "only" in x] == ["alpha only", "beta only", "delta only", "gamma only"]
    assert len([x for x in kept if x.startswith("one")]) == 1


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>one</p>"), (3, "v", "<p>" + "long " * 50_000 + "</p>")], "page_id long, url string, html string")
    assert main_text.extract(pages).count() == 5
    assert warc.derive(warc.responses_of(pages)).count() == 10
    assert main_text.extract(pages.limit(0)).count() == 0
    assert warc.derive(warc.responses_of(pages.limit(0))).count() == 0


def test_names_of_wrappers_and_open_elements():
    tree = main_text.grow(*main_text.LABELLED())
    one, two, three = (" ".join(["This paragraph of the article tells the reader at some length what %s was about, and why it came to be so." % x] * 2) for x in ("the first", "the second", "the third"))
    nav, foot = "<nav><a href=a>Home</a> <a href=b>News</a></nav>", "<div class='footer'>All rights reserved 2020</div>"
    body = f"<h1>The title of the page</h1><p>{one}</p><p>{two}</p>"
    want = f"The title of the page\n{one}\n{two}"
    for page in (
        f"<body class='has-sidebar'>{nav}{body}{foot}</body>",
        f"<body class='sidebar'>{nav}<div class='content'>{body}</div>{foot}</body>",
        f"<body>{nav}<div class='content-with-sidebar'>{body}<div class='sidebar'>See also other things</div></div>{foot}",
        f"<body>{nav}<main class='no-comments'>{body}</main>{foot}",
        f"<body>{nav}<article class='social'>{body}</article>{foot}",
        f"<body>{nav}<div class='widget'><div class='related'>{body}</div></div>{foot}",
        f"<body>{nav}<div>{body}</div><div class='comments'><p>I liked it very much and so did all of my friends here</p></div>{foot}",
    ):
        assert main_text.main_text(page, tree) == want, page
    opened = f"<div>{nav}<div><p class='share'>Tell your friends<p>{one}<p>{two}<ul><li class='ad'><p>Buy this thing today</p><li>{three}</ul></div>{foot}</div>"
    assert [b.text for b in main_text.blocks(opened) if b.apart or b.named or b.own] == ["Home News", "Tell your friends", "Buy this thing today", "All rights reserved 2020"]
    assert main_text.main_text(opened, tree) == f"{one}\n{two}\n{three}"


def test_cards_and_names_inside_articles():
    tree = main_text.grow(*main_text.LABELLED())
    long = " ".join(["The paragraph tells the reader at some length what was found and why it came to be so."] * 2)
    want = f"The title\nPart one\n{long}\nPart two\nshort one.\n{long}\nfirst item\nsecond item"
    body = f"<h1>The title</h1><h2>Part one</h2><p>{long}</p><h2>Part two</h2><p>short one.</p><blockquote>{long}</blockquote><ul><li>first item<li>second item</ul>"
    for name in ("post", "entry-content", "article-body", "story"):
        assert main_text.main_text(f"<body><nav><a href=a>Home</a></nav><div class={name}>{body}</div><footer>All rights</footer>", tree) == want
    own = f"<div class='share-price'><p>{long}</p></div><section id='related-work'><p>{long}</p></section>"
    other = f"<div class='share-buttons'>Tell your friends</div><div class='related-posts'><p>{long}</p></div><div class='comment-list'><p>{long}</p></div>"
    assert main_text.main_text(f"<article><h1>The title</h1><p>{long}</p>{own}{other}</article>", tree) == "\n".join(["The title", long, long, long])
    card = lambda text: f"<a href=x><div><h3>Another page about things</h3><p>{text}</p></div></a>"
    found = main_text.blocks(f"<div>{card(long)}{card('short')}<a href=y>open<p>not in a link</p><a href=z>two</a></div>")
    assert [(b.text == long or b.text, b.linked) for b in found if b.linked < 1] == [("not in a link", 0.0)]
    assert main_text.main_text(f"<article><h1>The title</h1><p>{long}</p></article><div>{card(long)}{card('short')}</div>", tree) == f"The title\n{long}"


def test_quotes_open_only_behind_equals_signs():
    text = lambda html: [b.text for b in main_text.blocks(html)]
    assert text("<p title=it's>Hello don't <b>x</b> stop</p>") == ["Hello don't x stop"]
    assert text("<p 'odd' title = \"a > b\" x='c>d'>kept</p><p title=\"open>rest") == ["kept", "rest"]
    assert text("<a ='" * 50_000) == []


def test_bare_pages_and_paragraphs_with_names():
    tree = main_text.grow(*main_text.LABELLED())
    one = "Only one paragraph, of sixteen words in all, which is all that there is to read."
    assert main_text.main_text(f"<p>{one}</p>", tree) == one
    long = "This section of the paper tells what others have done before us and how our own results differ from theirs."
    page = f"<nav><a href=a>Home</a></nav><article><h1>A title</h1><p>{long}</p><p class='related-work'>{long}</p><p>{long}</p><p class='share'>Tell a friend</p></article><footer>All rights</footer>"
    assert main_text.main_text(page, tree) == "\n".join(["A title", long, long, long])


def test_link_density_decides_on_unseen_layouts():
    for unseen in ("bare", "named", "links"):
        tree = main_text.grow(*main_text.LABELLED(styles=tuple(s for s in main_text.STYLES if s != unseen)))
        x, y = main_text.LABELLED(seed=11, styles=(unseen,))
        got = main_text.classify(tree, x)
        assert (got & y).sum() >= 0.9 * y.sum() and (got & y).sum() >= 0.85 * got.sum(), unseen
        blind = x.copy()
        blind[:, [main_text.FIGURES.index(f) for f in ("linked", "linked before", "linked after")]] = 0
        assert (main_text.classify(tree, blind) != y).sum() > (got != y).sum(), unseen


def test_references_and_outlinks(spark):
    html = (
        "<p>caf&eacute; &mdash; it&rsquo;s &#8217; &#xE9;&#X41; &NotEqualTilde; &amp;lt; &copy 1 R&D &nosuch; a&nbsp;b &#xD800;</p>"
        "<a href=\"one?a=1&amp;b=2\">1</a><a class='x' HREF = 'two'>2</a><A\nhref=three>3</A><a title=\"href='no' > \" href='f\"our'>4</a>"
        "<a data-href='no'>5</a><a class=\"y\"href=six/ id=z>6</a><abbr href=no>7</abbr><a href=''>8</a>"
    )
    rows = {r.warc_type: r.block for r in warc.derive(warc.responses_of(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()}
    assert rows["conversion"].split("\n")[0] == "café — it’s ’ éA ≂̸ &lt; © 1 R&D &nosuch; a b \ufffd"
    assert [x[9:] for x in rows["metadata"].split("\r\n") if x.startswith("outlink: ")] == ["one?a=1&amp;b=2", "two", "three", 'f"our', "six/", ""]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>One &amp; two</p>"), (2, None, None)], "page_id long, url string, html string")
    records = warc.derive(warc.responses_of(pages))
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    read = {r.headers["warc-record-id"]: (bytes(r.block).decode(), r.headers["warc-refers-to"], r.headers["warc-block-digest"]) for r in back.collect()}
    assert read == {r.record_id: (r.block, r.refers_to, r.block_digest) for r in records.collect()}


def test_responses_of_files(spark, tmp_path):
    body = "<p>Gr\u00fc\u00dfe</p><a href='x'>y</a>".encode()
    block = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n%sContent-Length: %s\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(
        head % (b"request", b"0", b"", b"4") + b"GET \r\n\r\n"
        + head % (b"response", b"1", b"WARC-Payload-Digest: sha1:PAY\r\nWARC-Block-Digest: sha1:BLOCK\r\n", b"%d" % len(block)) + block + b"\r\n\r\n"
        + head % (b"response", b"2", b"", b"many")
        + head % (b"response", b"3", b"", b"%d" % len(block)) + block.replace("\u00fc".encode(), b"\xfc ") + b"\r\n\r\n"
    )
    found = warc.responses(warc.read_warc(spark, str(tmp_path)))
    assert found.count() == 3
    rows = {(r.warc_type, r.refers_to): r for r in warc.derive(found).collect()}
    one = rows["conversion", "<urn:uuid:1>"]
    assert (one.block, one.source_payload_digest, one.target_uri) == ("Gr\u00fc\u00dfe\ny", "sha1:PAY", "http://a/")
    fields = rows["metadata", "<urn:uuid:1>"].block.split("\r\n")
    assert {"source-status: HTTP/1.1 200 OK", "source-header: Server: s", "source-block-digest: sha1:BLOCK", "source-payload-digest: sha1:PAY", "outlink: x"} <= set(fields)
    assert rows["conversion", "<urn:uuid:3>"].source_payload_digest.startswith("sha256:")


def test_digests_and_encodings_of_files(spark, tmp_path):
    """Digests are those of the bytes; the text comes after transfer, content encoding and charset."""
    html = "<p>Grüße für alle</p>"
    latin, chunks = html.encode("latin-1"), b"8\r\n%s\r\n%x;x=y\r\n%s\r\n0\r\n\r\n"
    utf, packed = html.encode(), gzip.compress(html.encode())
    bodies = [
        (b"Content-Type: text/html; charset=ISO-8859-1", latin), (b"Content-Encoding: gzip", packed), (b"Transfer-Encoding: chunked", chunks % (utf[:8], len(utf) - 8, utf[8:])),
        (b"Content-Encoding: deflate", zlib.compress(utf)), (b"Content-Encoding: gzip", b"no gzip at all"), (b"Content-Type: text/html; charset=nosuch", utf),
    ]
    blocks = [b"HTTP/1.1 200 OK\r\n%s\r\n\r\n%s" % x for x in bodies]
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Length: %d\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(head % (i, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks)))
    rows = {r.refers_to: r for r in warc.derive(warc.responses(warc.read_warc(spark, str(tmp_path)))).collect() if r.warc_type == "conversion"}
    for i, (_, body) in enumerate(bodies):
        assert rows[f"<urn:uuid:{i}>"].source_payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    assert [rows[f"<urn:uuid:{i}>"].block for i in range(6)] == ["Grüße für alle"] * 4 + ["no gzip at all", "Grüße für alle"]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0])]
    vectors = topk.numbered(topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    found = topk.top_inner_products(vectors, vectors.where(F.col("vec_id") % 50 == 0)).collect()
    of = lambda i: [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i]
    assert of(0) == [(1, 1, 65536), (2, 2, 65536), (3, 50, 32768), (4, 50, 32768)]
    # Two rows of one id: each is a query, and a candidate of the other.
    assert sorted(of(50)) == sorted(2 * [(1, 1, 65536), (2, 2, 65536), (3, 0, 32768), (4, 50, 32768)])
    none = vectors.limit(0)
    assert topk.top_inner_products(none, none).count() == 0


def test_huge_vectors(spark):
    rows = [(0, [1e30, 1e30]), (1, [1e30, 1.0]), (2, [1e15, 3.0]), (3, [-1e30, 0.0]), (4, [1.0, 1e-3]), (5, [0.0, 1e300]), (6, [1e308, 0.0]), (7, [0.0, 0.0])]
    vectors = topk.numbered(topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    found = {r.vec_id: r.score for r in topk.top_inner_products(vectors, vectors.where("vec_id = 0"), k=9).collect()}
    assert found == {1: 2**63 - 1, 2: 2**63 - 1, 3: -(2**63), 4: 2**63 - 1, 5: 2**63 - 1, 7: 0}
    vectors = topk.numbered(topk.whole_vectors(spark.createDataFrame([(0, [2e6, 3.0]), (1, [1e6, -5e5]), (2, [])], "vec_id long, embedding array<double>")))
    assert {r.vec_id: r.score for r in topk.top_inner_products(vectors, vectors).where("query_id = 0").collect()} == {1: 256 * 256 * (int(2e12) - 1_500_000)}
