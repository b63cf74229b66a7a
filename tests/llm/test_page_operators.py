"""Operators on web pages."""

import hashlib
import html
import random
import re
from itertools import combinations

import duckdb

from lumicat.llm import html_diff, queries, warc_derive

SCHEMA = "page_id long, url string, html string, _host string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_articles_of_the_test_pages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_diff.main_text(table).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_zones():
    page = '<title>t</title><header>h</header><div class="side-bar ad">x</div><main><header><h1>A &lt; B</h1></header><p>one<p>two<script>if (a<b) {}</script> <i>three</i><form>f</form></main><footer>z</footer><p>open'
    texts, zones = html_diff.blocks(page)
    assert [t for t, z in zip(texts, zones) if z == html_diff.MAIN] == ["A < B", "one", "two three"]
    assert [t for t, z in zip(texts, zones) if z == html_diff.OPEN] == ["open"]
    assert html_diff.blocks(None) == ([], []) and html_diff.blocks("") == ([], [])


def test_names_never_take_the_article():
    def zones_of(page):
        return dict(zip(*html_diff.blocks(page)))

    M, C, O = html_diff.MAIN, html_diff.CHROME, html_diff.OPEN
    for top in ('<body class="single no-sidebar">', '<html class="header-fixed"><body>', '<div class="page-with-sidebar">', '<div id="nav-wrap"><div class="has-banner">'):
        assert zones_of(f'{top}<p>before</p><div class="ad">x</div><article><p>text</p></article><p>after</p><nav>n</nav>') == {"before": O, "x": C, "text": M, "after": O, "n": C}
    assert zones_of('<article><h1 class="post-header">t</h1><p class="share-price">9</p><div class="comments"><p>c</p><article>d</article></div></article><div class="side-bar ad-box">y</div>') == {"t": M, "9": M, "c": C, "d": C, "y": C}
    assert zones_of('<nav class="menu"><article>a</article></nav><p>z</p>') == {"a": C, "z": O}
    assert zones_of('<body class="no-sidebar"><p>only</p>') == {"only": O}


def test_chrome_inside_and_around_articles():
    def text_of(page):
        return [t for t, z in zip(*html_diff.blocks(page)) if z != html_diff.CHROME]

    for name in ("comment-list", "comments-area", "share-buttons", "related-posts", "cookie-banner", "ad-slot", "ad-slot-2", "newsletter-signup", "post-comments", "comment-list__item", "top-ad"):
        for around in ("main", "article"):
            assert text_of(f'<{around}><h1>T</h1><div class="{name}"><p>gone</p></div><p>text</p></{around}>') == ["T", "text"], name
    for name in ("share-price", "post-header", "no-comments", "ad-hoc", "notice-board", "story-list", "list", "entry", "post"):
        assert text_of(f'<article><h1>T</h1><div class="{name}"><p>text</p></div></article>') == ["T", "text"], name
    story = "<article><h1>T</h1><p>text of the story</p></article>"
    for other in ('<div class="comments"><article class="user">reader</article></div>', '<section id="related"><article>teaser</article><article>teaser two</article></section>', '<div class="ads"><main>x</main></div>'):
        assert text_of(story + other) == text_of(other + story) == ["T", "text of the story"]
        assert text_of(f"<main>{story}{other}</main>") == ["T", "text of the story"]
    # without another article such names don't take the text, and empty ones are none
    assert text_of(f'<div class="modal">{story}</div>') == text_of(f'<article></article><div class="modal">{story}</div>') == ["T", "text of the story"]


def test_only_the_article_with_most_text_is_protected(spark):
    M, O = html_diff.MAIN, html_diff.OPEN
    assert dict(zip(*html_diff.blocks("<main><h1>T</h1><article>long story</article><article>teaser</article></main>"))) == {"T": O, "long story": M, "teaser": O}
    assert dict(zip(*html_diff.blocks("<main><p>a long text of main</p><article>small</article></main>"))) == {"a long text of main": M, "small": O}
    rows = [(i, f"http://h.example/n/{i}", f"<main><h1>Title {i}</h1><article><p>Story {i} goes on for long</p></article><article>teaser of all pages</article></main>") for i in range(4)]
    got = {r.page_id: r.text for r in html_diff.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Title {i}\nStory {i} goes on for long" for i in range(4)}


def test_text_of_awkward_pages():
    def text_of(page):
        return [t for t, z in zip(*html_diff.blocks(page)) if z != html_diff.CHROME]

    article = "<article><h1>T</h1><p>text</p></article>"
    for page in (
        f'<body class="has-sidebar">{article}', '<article class="post no-comments"><h1>T</h1><p>text</p></article>', '<html class="ad-free"><main><h1>T</h1><p>text</p></main>', '<main class="header"><h1>T</h1><p>text</p></main>',
        '<article class="widget"><div class="article-header"><h1>T</h1></div><p>text</p></article>', '<div class="post-header"><h1>T</h1></div><p>text</p><div class="ad-box">a</div>', f'<form id="all">{article}<p role="search">s</p></form>',
        "<article><h1 title=it's>T</h1><p class=a'b>text</p></article>", '<article><h1 title="a > b" data-class="ad">T</h1><p title=\'class="ad"\'>text</p></article>', "<head><meta charset=x><body><p>T</p><p>text</p>", f"<head><title>x</title>{article}",
        '<div class="header wide"><h1>T</h1><p>text</p></div><div class="comments">c</div>', '<article><h1>T</h1><p>text<div class="ad"><b><i><u><p>gone</div></article>', '<ul><li class="ad">x<li>T<li>text</ul>', '<table><tr><td class="ad">x<td>T<tr><td>text</table>',
    ):
        assert text_of(page) == ["T", "text"], page
    assert text_of("<article><p class=it's>one</p><p>don't stop</p><p>x</p></article>") == ["one", "don't stop", "x"]
    assert text_of("<p>a<b><i><u><s>b<p>c</p>") == ["ab", "c"] and text_of("<p>a <b>c") == ["a c"] and text_of("<p>a <b c") == ["a"]


def test_very_long_pages():
    n = 200_000
    for page in ("<p>x</p>" * n, "<p class=it's>" * n, '<a b="' * n, "<a " * n, "<div>" * n + "x" + "</div>" * n, "<b>" * n + "</i>" * n + "x", '<div class="ad">' * n + "x", "<!x" * n, "<li>" * n + "x", "<p>" + "<b>" * n + "<p>x"):
        html_diff.blocks(page)  # a second or so; anything that goes over the page again for each tag would not end


def test_nothing_goes_by_differencing_without_partners(spark, monkeypatch):
    rows = [(i, f"http://h.example/n/{i}", f"<body><p>Site title</p><p>Story {i} begins</p></body>") for i in range(4)]
    assert {r.text for r in html_diff.main_text(pages(spark, rows)).collect()} == {f"Story {i} begins" for i in range(4)}
    empty = spark.createDataFrame([], "_host string, _address string, _partners array<array<bigint>>")
    monkeypatch.setattr(html_diff, "partners", lambda _: empty)
    assert {r.text for r in html_diff.main_text(pages(spark, rows)).collect()} == {f"Site title\nStory {i} begins" for i in range(4)}


def test_queries_and_copies(spark):
    """Pages that differ by query string only are compared; copies under other addresses delete nothing of each other."""
    page = lambda x: f"<body><p>Site title</p><p>Story {x} begins and goes on</p><p>All rights</p></body>"
    rows = [(i, f"http://h.example/index.php?id={i}", page(i)) for i in range(6)]
    rows += [(20 + i, f"http://h.example/a/b?session={i}", page("same")) for i in range(5)] + [(30, "http://h.example/a/c", page("other"))]
    rows += [(40 + i, f"http://copies.example/x?s={i}", page("lone")) for i in range(3)] + [(50, "http://h.example/index.php?id=3", page(3))]
    got = {r.page_id: r.text for r in html_diff.main_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i] == f"Story {i} begins and goes on" for i in range(6)) and got[50] == got[3]
    assert all(got[20 + i] == "Story same begins and goes on" for i in range(5)) and got[30] == "Story other begins and goes on"
    assert all(got[40 + i].startswith("Site title\nStory lone") for i in range(3))


def test_differencing_deletes_what_neighbours_share(spark):
    def page(i):
        return f"<body><p>Site title</p><p>Story {i} begins</p><p>and ends {i}</p><p>All rights</p></body>"

    rows = [(i, f"http://h.example/news/{100 + i}", page(i)) for i in range(5)] + [(9, "http://other.example/a", page(9)), (10, None, None), (11, "http://h.example/news/100?x=1", page(0)), (12, "", "")]
    got = {r.page_id: r.text for r in html_diff.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} begins\nand ends {i}" for i in range(5)) and got[11] == got[0]
    assert got[9].startswith("Site title") and got[10] == got[12] == ""
    assert html_diff.main_text(pages(spark, [])).count() == 0


def test_lcs_brute():
    for a, b in combinations([[], [1], [1, 2, 3, 2], [2, 2, 1, 3], [3, 1, 2, 1, 3, 2], [9, 1, 9, 2, 9, 3]], 2):
        best = max((len(s) for n in range(len(a) + 1) for s in combinations(a, n) if is_part(s, b)), default=0)
        found = html_diff.shared_positions(a, b)
        assert len(found) == best and is_part([a[i] for i in sorted(found)], b)


def test_lcs_of_repeated_and_random_lines():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.randrange(draw.choice([2, 4, 40])) for _ in range(draw.randrange(90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        found = html_diff.shared_positions(a, b)
        assert len(found) == row[-1] and is_part([a[i] for i in sorted(found)], b)


def test_lcs_of_long_pages():
    n = 100_000
    assert len(html_diff.shared_positions([1] * n, [2] + [1] * n)) == n
    mixed = [i % 2 for i in range(6000)]
    found = html_diff.shared_positions([2, *mixed], [*mixed[::-1], 3])
    assert len(found) == 5999
    a, b = [0, 7] * 10_000 + list(range(10, 10_010)), list(range(10_009, 9, -1)) + [0, 8] * 10_000
    assert len(html_diff.shared_positions(a, b)) == 10_000


def is_part(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_derivatives_link_back(spark):
    rows = [(1, "http://h.example/a", "<p>Ünïcode &amp; more</p><p>x</p>"), (2, None, None), (3, "http://h.example/c", "")]
    responses = warc_derive.responses(pages(spark, rows))
    sources = {r.page_id: r for r in warc_derive.parse(responses).collect()}
    got = warc_derive.derive(responses).collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 6
    for r in got:
        head, _, block = r.record.partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == sources[r.page_id].record_id == r.refers_to
        assert int(fields["Content-Length"]) == len(r.block.encode()) and block == r.block + "\r\n\r\n"
        assert fields.get("WARC-Target-URI") == sources[r.page_id].uri == r.uri
        assert r.source_digest == sources[r.page_id].payload_digest
        if r.record_type == "metadata":
            assert "http-header: Content-Type: text/html" in r.block and any(x.record_id in r.block for x in got if x.page_id == r.page_id and x.record_type == "conversion")
    assert {r.page_id: r.block for r in got if r.record_type == "conversion"} == {1: "Ünïcode & more\nx", 2: "", 3: ""}
    assert warc_derive.derive(warc_derive.responses(pages(spark, []))).count() == 0


def test_all_references_are_decoded(spark):
    cases = ["&#8217; &#x2014; &#233;", "caf&eacute; &mdash; &uuml;ber &hellip; &amp; &copy;", "&amp;eacute; &amp;#233; &amp;lt;", "a &lt;b&gt; &quot;c&quot; &#39;d&#39; &middot; &apos;", "x&#160;y&nbsp;z &notaname; R&D a&b=1 &", "&#X41; &AMP; &copy 1 &#0;", "&#" + "0" * 5000 + "65; &#" + "9" * 5000 + ";"]
    rows = [(i, "http://h.example/a", f"<p>{c}</p>") for i, c in enumerate(cases)]
    got = {r.page_id: r for r in warc_derive.derive(warc_derive.responses(pages(spark, rows))).where("record_type = 'conversion'").collect()}
    want = {i: html.unescape(c).replace("\xa0", " ") for i, c in enumerate(cases[:-1])} | {len(cases) - 1: "A \ufffd"}
    assert {i: r.block for i, r in got.items()} == want
    assert all(r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() for r in got.values())


def raw_record(kind, number, uri, block, length=None):
    head = f"WARC/1.{number % 2}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Date: 2020-02-0{number % 9 + 1}T00:00:00Z\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{number}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_files_of_records(spark, tmp_path):
    """Compressed and plain files, character sets, codings, blocks with separators and a cut record, read and written."""
    import gzip
    import zlib

    http = lambda body, *fields: "\r\n".join(["HTTP/1.1 200 OK", *fields]).encode() + b"\r\n\r\n" + body
    inner = raw_record("response", 90, "http://in/", b"x") + raw_record("response", 91, "http://in/", b"y")
    gz = gzip.compress("<p>Größe</p>".encode())
    sources = {
        1: http("<p>Größe &amp; Maß</p>".encode(), "Content-Type: text/html; charset=utf-8"), 2: http("<p>Größe</p>".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"),
        3: http("<meta charset='windows-1251'><p>Привет</p>".encode("cp1251"), "Content-Type: text/html"), 4: http(b"<p>a</p>" + inner + b"<p>b</p>", "Content-Type: text/html"),
        5: http(gz, "Content-Type: text/html", "Content-Encoding: gzip"), 6: http(b"4\r\n<p>a\r\n5;x=1\r\nb</p>\r\n0\r\n\r\n", "transfer-encoding: chunked"), 7: http(b"", "Content-Type: text/html"),
        8: http(b"<p>\xff\xfe ok</p>"), 9: http(zlib.compress(b"<p>z</p>")[2:-4], "Content-Encoding: deflate"), 10: b"no http at all", 11: http(b"<p>q</p>", "Content-Type: text/html; charset=nonsense"),
    }
    whole = [raw_record("response", i, f"http://h.example/{i}", b) for i, b in sources.items()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [raw_record("warcinfo", 50, "-", b"software: x"), *whole]))
    (tmp_path / "b.warc").write_bytes(raw_record("request", 60, "http://h.example/b", b"GET /") + raw_record("response", 61, "http://h.example/cut", http(b"<p>cut</p>"), 5000))
    got = {r.record_id: r for r in warc_derive.parse(warc_derive.read(spark, str(tmp_path / "*"))).collect()}
    assert sorted(got) == sorted(f"<urn:uuid:{i}>" for i in [*sources, 61])
    assert all(got[f"<urn:uuid:{i}>"].block_bytes == len(b) and got[f"<urn:uuid:{i}>"].complete and got[f"<urn:uuid:{i}>"].payload_digest == f"sha1:{i}" for i, b in sources.items())
    assert not got["<urn:uuid:61>"].complete and "<p>cut</p>" in got["<urn:uuid:61>"].payload
    made = warc_derive.derive(warc_derive.read(spark, str(tmp_path / "*"))).cache()
    texts = {r.refers_to[10:-1]: r.block for r in made.where("record_type = 'conversion'").collect()}
    assert [texts[str(i)] for i in (1, 2, 3, 5, 6, 7, 8, 9, 10, 11)] == ["Größe & Maß", "Größe", "Привет", "Größe", "ab", "", "\ufffd\ufffd ok", "z", "", "q"]
    assert texts["4"].startswith("a\n") and "WARC/1.1" in texts["4"] and texts["4"].endswith("\nb")
    assert {r.date for r in made.where("uri = 'http://h.example/3'").collect()} == {"2020-02-04T00:00:00Z"}
    warc_derive.write(made, str(tmp_path / "out"))
    back = warc_derive.read(spark, str(tmp_path / "out")).collect()
    assert sorted(bytes(r.record).rstrip() for r in back) == sorted(r.record.encode().rstrip() for r in made.collect()) and all(r.complete for r in back)


def test_codings_of_payloads():
    """Members and frames, what is cut or too long, codings that can't be undone, and payloads that are decoded already."""
    import gzip
    import zlib

    import zstandard

    read = lambda data, coding, most=1000: warc_derive.decoded_payload(data, f"Content-Encoding: {coding}", most)
    two = gzip.compress(b"hello ") + gzip.compress(b"world")
    assert read(two, "gzip") == read(two + b"\0\0", "gzip") == ("hello world", True)
    assert read(two[:-9], "gzip")[1] is False and read(two[:-9], "gzip")[0].startswith("hello ")
    assert read(gzip.compress(b"x" * 50_000_000), "gzip") == ("x" * 1000, False) and read(gzip.compress(b"x" * 1000), "gzip") == ("x" * 1000, True)
    frames = zstandard.compress(b"hello ") + zstandard.compress(b"world")
    assert read(frames, "zstd") == ("hello world", True) and read(zstandard.compress(b"y" * 5000), "zstd") == ("y" * 1000, False)
    assert read(gzip.compress(zlib.compress(b"both")), "deflate, gzip") == ("both", True)
    assert read(b"\x8b\xff\x00", "br") == ("", False) and read("schon Text ö".encode(), "br") == ("schon Text ö", True)
    assert read(b"plain", "gzip") == read(b"plain", "identity") == read(b"plain", "") == read(b"plain", "zstd") == ("plain", True)


def test_codings_mark_records(spark):
    import gzip

    http = lambda body, coding: f"HTTP/1.1 200 OK\r\nContent-Encoding: {coding}\r\n\r\n".encode() + body
    records = [raw_record("response", 1, "u", http(gzip.compress(b"<p>a</p>") + gzip.compress(b"<p>b</p>"), "gzip")), raw_record("response", 2, "u", http(b"\x8b\xff", "br"))]
    got = {r.record_id: (r.payload, r.complete) for r in warc_derive.parse(spark.createDataFrame([(bytearray(r),) for r in records], "record binary")).collect()}
    assert got == {"<urn:uuid:1>": ("<p>a</p><p>b</p>", True), "<urn:uuid:2>": ("", False)}


def test_signs_that_are_no_tags(spark):
    rows = [(1, "u", "<p>5 < 6 and 7 > 3</p><!-- c --><?x y?><b>bold</b> a<b c>d</b> 1<2"), (2, "u", "<p>a <3 b</p><>")]
    got = {r.page_id: r.block for r in warc_derive.derive(warc_derive.responses(pages(spark, rows))).where("record_type = 'conversion'").collect()}
    assert got == {1: "5 < 6 and 7 > 3\nbold ad 1<2", 2: "a <3 b\n<>"}


def test_partners_are_the_nearest_paths(spark):
    """Pages of several templates in one directory, with extensions and names of unequal length."""
    rows = []
    for i in range(12):
        for kind in ("alpha", "beta", "gamma"):
            name = f"{kind}-{'x' * (i % 4)}{100 + 7 * i * i}.html"
            rows.append((len(rows), f"http://h.example/d/{name}", f"<body><p>Top of {kind}</p><p>Story {kind} {i}</p><p>End of {kind}</p></body>"))
    got = {r.page_id: r.text for r in html_diff.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == re.search("Story [a-z]+ [0-9]+", page)[0] for i, _, page in rows)


def test_neighbours_brute(spark):
    keys = sorted({(f"h{i % 3}", f"/{i * i % 97}/{i * 31 % 89}") for i in range(150)} | {("lone", "/a")})
    common = lambda a, b: len(html_diff.commonprefix([a, b]))
    got = {(r._host, r._key): r._near for r in html_diff.neighbours(spark.createDataFrame(keys, "_host string, _key string")).collect()}
    assert sorted(got) == keys and got["lone", "/a"] is None
    for (host, key), near in got.items():
        others = [k for h, k in keys if h == host and k != key]
        assert not others or near in others and common(key, near) == max(common(key, k) for k in others)


def test_plain_text_is_that_of_the_sql(spark):
    """Line ends other than \n don't hide the end of a text from the trim; references aren't decoded twice; runs of white space are one space."""
    rows = [(1, None, "abc \x85"), (2, None, "abc &#13;"), (3, None, "<p> a&amp;lt;b &lt;&&quot; </p>\n\n<p>\t</p> &nbsp; x  <b> y</b>\r\n z &"), (4, None, "\t<SCRIPT>1</script ><!-- \n -->\x0c"), (5, None, "a\tb  c \n d"), (6, None, "")]
    got = {r.page_id: r.block for r in warc_derive.derive(warc_derive.responses(pages(spark, rows))).where("record_type = 'conversion'").collect()}
    assert got == {1: "abc \x85", 2: "abc \r", 3: 'a&lt;b <&"\nx  y z &', 4: "", 5: "a b c d", 6: ""}
    for page, _, text in rows:
        if page != 2:  # the SQL has no numbers among its references
            assert duckdb.execute(f"select {queries._DUCK_TEXT} from (select ?::varchar as html)", [text]).fetchone()[0] == got[page]
