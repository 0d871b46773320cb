"""Archives, main text and URL filter."""

import hashlib
import itertools
import math
import re
import struct
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import html_main, url_filter, warc
from quarry.llm.q_pages import URL_RULES

from . import data


def test_archives_round_trip(spark, tmp_path):
    pages = data.pages(spark)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    out = warc.read_archives(spark, path).collect()
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in out) == Counter((i, hashlib.sha256(h).hexdigest(), len(h)) for i, _, h in rows)
    first = {}
    for i, _, h in rows:
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    payload = {hashlib.sha256(h).hexdigest(): h for _, _, h in rows}
    for r in out:
        h = payload[r.payload_digest]
        revisit = h in first and first[h] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if revisit else ("response", None))
        assert r.payload == (None if revisit else h)
    assert {r.url for r in out} == {None if u is None else " ".join(u.splitlines()) for _, u, _ in rows}
    empty = str(tmp_path / "none")
    warc.write_archives(data.pages(spark, []), empty)
    assert warc.read_archives(spark, empty).count() == 0


def archive(records, dictionary=b"", skip=True):
    import zstandard

    packed = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frames = [zstandard.ZstdCompressor(dict_data=packed, write_checksum=k % 2 == 0, write_content_size=k % 3 > 0).compress(r) for k, r in enumerate(records)]
    between = warc.EMPTY_FRAME.encode() if skip else b""
    return struct.pack("<II", warc.DICT_MAGIC, len(dictionary)) + dictionary + between + between.join(frames)


def some_records(n=30):
    out = []
    for i in range(n):
        payload = (b"x" * i * 997 + bytes([i])) * (i % 4)
        out.append(warc.record(i, f"http://a/{i}", payload, len(payload), hashlib.sha256(payload).hexdigest(), None, "2000-01-01T00:00:00Z"))
    return out


@pytest.mark.parametrize("dictionary", [b"", b"Content-Type: application/http WARC-Type: response" * 20])
def test_reader_of_frames(dictionary):
    import zstandard

    records = some_records()
    assert [r["page_id"] for r in warc.records(archive(records, dictionary))] == list(range(30))
    assert [r["page_id"] for r in warc.records(archive(records, dictionary, skip=False))] == list(range(30))
    if dictionary:  # the dictionary frame may itself be compressed
        packed = zstandard.ZstdCompressor().compress(dictionary)
        plain = archive(records, dictionary)[8 + len(dictionary):]
        assert len(list(warc.records(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + plain))) == 30


def test_damage_is_found():
    good = archive(some_records(4))
    for broken in (good[:-3], good[:20] + b"\x00" + good[21:], good + b"junk!", good[:-1] + bytes([good[-1] ^ 1])):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(broken))
    r = some_records(4)[3]
    for bad in (r.replace(b"WARC/1.1", b"HTTP/1.1"), r[:-4], r.replace(b"Content-Length: ", b"Content-Length: 1", 1), r.replace(b"sha256:", b"sha256:0", 1), r.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(warc.DamagedArchive):
            warc.parse(bad)


def test_marginals_equal_summing_over_all_states():
    page = "<body><nav><a>x</a></nav><article><h1>T</h1><p>Some text here.</p><aside>note</aside></article><div class=ad>Buy</div></body>"
    nodes, _ = html_main.dom(page)
    model = html_main.Model(html_main.counts_of(page, False))
    weight, total = [0.0] * len(nodes), 0.0
    for states in itertools.product((0, 1), repeat=len(nodes)):
        p = model.root[states[0]]
        for i, (n, s) in enumerate(zip(nodes, states)):
            p *= math.exp(sum(model.node.get(f, (0.0, 0.0))[s] for f in html_main.shown(n)))
            if i:
                p *= model.pair[n.kind][2 * states[n.parent] + s]
        total += p
        for i, s in enumerate(states):
            weight[i] += p * s
    assert all(math.isclose(a, w / total, abs_tol=1e-9) for a, w in zip(model.marginals(nodes), weight))


def truth(page):
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])).split())


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    model = html_main.train(pages)
    out = html_main.extract(pages, model=model).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)
    bare = [re.sub(r"<(/?)article", r"<\1div", r.html) for r in pages.collect()]  # without the marks
    assert sum(model.text(b) == want[r.page_id] for b, r in zip(bare, pages.collect())) > 0.95 * len(bare)


PARTS = """<html><head><title>t</title><script>if (a < b) "</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice">We use cookies. Accept all of them now.</div>
<main><h1>Title &amp; more</h1><p>One long sentence that is here\n to be&nbsp;read. And another.<p>Two<br>lines <b>bold</b>ly<aside>Side note, long enough to be text.</aside>
<form><p>Name</p><input></form><section class="comments"><p>Great post! I liked it a lot, really.</p></section></main><footer>Copyright</footer></body></html>"""


def test_main_text_of_parts(spark):
    model = html_main.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert model.text(PARTS) == "Title & more One long sentence that is here to be read. And another. Two lines boldly"
    prior = html_main.train(data.pages(spark, []))  # no labelled page
    for m in (model, prior):
        assert m.text(None) == m.text("") == m.text("<!-- only -->") == "" and m.text("no tags &lt;3") == "no tags <3"
        assert m.text("<p>unclosed <b>x") == "unclosed x" and m.text("a<script>x") == "a"
    out = html_main.extract(data.pages(spark), model=model).collect()
    assert len(out) == 10 and {r.text for r in out if r.page_id == 1} == {"A & B One sentence of text, long enough to read. And more."}


SIDE = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>"
STORY = "<h1>Title</h1><p>One long sentence that is here to be read by all. And another one follows it.</p><p>The second paragraph is long as well, and ends here.</p>"
FOOT = "<div class='share-bar'><p>Share this page with your friends.</p></div><footer><p>Copyright of the owners, all rights reserved.</p></footer>"
READ = "Title One long sentence that is here to be read by all. And another one follows it. The second paragraph is long as well, and ends here."
WRAPPED = {
    "body": f"<body class='has-sidebar'>{SIDE}{STORY}{FOOT}</body>", "fixed": f"<body class='fixed-header'>{SIDE}<div>{STORY}</div>{FOOT}</body>",
    "div": f"<body><div class='page-with-navbar'>{SIDE}{STORY}{FOOT}</div></body>", "form": f"<body><form action=x>{SIDE}<div>{STORY}</div>{FOOT}</form></body>",
    "main": f"<body>{SIDE}<main class='col-8 with-sidebar'>{STORY}</main>{FOOT}</body>", "article": f"<body>{SIDE}<article class='with-sharing'>{STORY}</article>{FOOT}</body>",
    "both": f"<body class='has-sidebar'><form><div class='with-sidebar'>{SIDE}<article class='with-sharing'>{STORY}</article>{FOOT}</div></form></body>",
    "comments": f"<body>{SIDE}<div class='post'>{STORY}</div><section class='comments'>" + "<article class='comment'><p>Great post! I liked it a lot, really.</p></article>" * 9 + f"</section>{FOOT}</body>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_class_words_of_wrappers_and_marked_elements(spark, name):
    learned = html_main.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    for model in (learned, html_main.Model({})):
        assert model.text(WRAPPED[name]) == READ


def test_labelled_pages_can_outweigh_the_boiler_prior():
    lead = "<h1>Title</h1><p>A lead of some length stands before all the rest, as it often does.</p>"
    page = f"<body>{SIDE}<article>{lead}<div class='with-sharing'>{STORY}</div></article>{FOOT}</body>"
    model = html_main.Model({})
    assert READ not in model.text(page)
    learned = html_main.Model(sum((html_main.counts_of(page, False) for _ in range(20)), Counter()))
    assert learned.pair["class"][3] > 100 * model.pair["class"][3] and learned.pair["boiler"][3] <= model.pair["boiler"][3]
    assert READ in learned.text(page) and "Copyright" not in learned.text(page)


def in_other_words(page):
    """The page with all class and id words replaced by words of no list."""
    return re.sub(r"(?<![\w-])(class|id)\s*=\s*(\"[^\"]*\"|'[^']*')", lambda m: f"{m[1]}=" + re.sub("[A-Za-z]+", lambda w: "zq" + w[0].lower()[::-1], m[2]), page)


def word_f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_class_words_are_learned(spark):
    """Pages of foreign class words, half of them learned from and the other half without marks held out."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    learned = html_main.Model(sum((html_main.counts_of(in_other_words(p), i % 2 == 0) for i, p in enumerate(pages[::2])), Counter()))
    untrained = html_main.Model({})
    held_out = [(re.sub(r"<(/?)article", r"<\1div", in_other_words(p)), truth(p)) for p in pages[1::2]]
    scores = [sum(word_f1(m.text(p), want) for p, want in held_out) / len(held_out) for m in (learned, untrained)]
    assert scores[0] >= 0.99 > scores[1]
    assert any(learned.text(p) != untrained.text(p) for p, _ in held_out)


NOTICE = "<div class='aviso'><p>Usamos cookies en este sitio, como casi todos los sitios lo hacen.</p></div>"


def test_notices_of_unknown_words_and_wrappers():
    """A word beside articles is learned; one of a wrapper around them, or of parts of articles, is not."""
    page = f"<body><div class='contenedor'>{SIDE}{NOTICE}<article><div class='columna'>{STORY}</div></article><div class='columna'>x</div>{FOOT}</div></body>"
    counts = html_main.counts_of(page, False)
    once, often = html_main.Model(counts), html_main.Model(sum((html_main.counts_of(page, k % 2 == 0) for k in range(html_main.OFTEN)), Counter()))
    assert not once.learned and often.learned == {"aviso", "share", "bar"}
    other = f"<body><div class='contenedor'>{SIDE}<div class='columna'>{NOTICE}{STORY}</div>{FOOT}</div></body>"
    assert "cookies" in html_main.Model({}).text(other) and often.text(other) == READ


@pytest.mark.parametrize("mark", ["hidden", "hidden=''", "class=x hidden", "style='display:none'", 'style="color:red; DISPLAY : none"'])
def test_hidden_elements(mark):
    model = html_main.Model({})
    for tag in ("p", "div", "span", "article"):
        assert model.text(f"<body>{SIDE}<article>{STORY}<{tag} {mark}>This text is not to be seen by anybody.</{tag}></article>{FOOT}</body>") == READ
    assert model.text(f"<body {mark}>{SIDE}<article>{STORY}</article>{FOOT}</body>") == READ  # a page that a script uncovers
    assert model.text(f"<body>{SIDE}<article data-hidden=1 title='hidden' data-style='display:none'>{STORY}</article>{FOOT}</body>") == READ


def test_deep_pages_need_no_recursion(spark):
    model = html_main.Model({})
    assert model.text("<div>" * 20_000 + "deep text" ) in ("", "deep text")


def brute_segment(label, words):
    total = sum(words.values())
    unknown = math.log(total + 1) + 12.0
    best = None
    for cuts in itertools.product((0, 1), repeat=max(0, len(label) - 1)):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(label[start:i])
                start = i
        cost = sum(math.log(total) - math.log(words[p]) if p in words else unknown * len(p) for p in parts)
        if best is None or cost < best - 1e-12:
            best = cost
    return best


def test_segmentation_is_the_likeliest():
    words = {"the": 50, "them": 5, "he": 20, "men": 9, "nt": 3, "t": 1}
    for label in ("thement", "themen", "xthez", "zzz", "t", "hethemen"):
        known = {(i, k): words[label[i : i + k]] for i in range(len(label)) for k in range(1, 9) if label[i : i + k] in words and i + k <= len(label)}
        parts = url_filter.segment(label, known, sum(words.values()))
        assert "".join(parts) == label
        total, unknown = sum(words.values()), math.log(sum(words.values()) + 1) + 12.0
        cost = sum(math.log(total) - math.log(words[p]) if p in words else unknown * len(p) for p in parts)
        assert math.isclose(cost, brute_segment(label, words)), (label, parts)


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_classifier(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    url = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.judge(pages, URL_RULES).collect():
        host, path, rule, verdict = brute_rule(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("allow" if r.log_odds >= 0 else "block"))
    odd = url_filter.judge(data.pages(spark), URL_RULES).collect()
    assert len(odd) == 10
    by = {r.page_id: r for r in odd}
    assert by[3].rule == "example.org/en/1" and by[3].verdict == "block" and by[1].rule == "com/fr/"
    assert (by[4].host, by[4].path, by[5].host, by[6].path, by[8].host) == ("", "", "", "", "")
    assert by[7].host == "example.org" and by[7].rule == "example.org/es/"
    assert {r.verdict for r in url_filter.judge(data.pages(spark), []).collect()} == {"allow"}
    assert url_filter.judge(data.pages(spark, []), URL_RULES).count() == 0


def test_a_later_scheme_is_not_the_urls_own(spark):
    urls = ["http://example.org?u=http://foo.com/de/1", "https://a.com#x://y/de/2", "http://a.com/de/3?u=http://b.org/en/1", "x://y://z/de/4", "http://b.org", "a" * 20_000 + "://c.net?://d/e"]
    out = url_filter.judge(data.pages(spark, [(i, u, "<p>text") for i, u in enumerate(urls)]), URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in out} == {i: brute_rule(u)[:3] for i, u in enumerate(urls)}
    assert {r.page_id: r.path for r in out} == {0: "", 1: "", 2: "/de/3", 3: "//z/de/4", 4: "", 5: ""}


def test_classifier_learns_from_rules(spark):
    """Naive Bayes by hand over the tokens of the judged URLs."""
    html = "<p>" + "cat dog news spam shop " * 5
    rows = [(i, f"http://catnews{'' if i % 2 else 'dog'}.org/cat/{i}", html) for i in range(10)] + [(20 + i, f"http://spamshop.com/de/spam{i}", html) for i in range(10)]
    rows += [(40, "http://newscat.net/cat", html), (41, "http://shopspam.net/spam", html)]
    out = {r.page_id: r for r in url_filter.judge(data.pages(spark, rows), URL_RULES).collect()}
    assert out[40].rule is None and out[40].verdict == "allow" and out[40].log_odds > 0
    assert out[41].rule is None and out[41].verdict == "block" and out[41].log_odds < 0


def foreign(kind, block, *lines, version="WARC/1.0"):
    return "\r\n".join([version, f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """A hand-built archive: all record types, uuids, SHA-1, folded lines, no HTTP length, no dictionary."""
    import base64

    body = "<p>Grüße</p>".encode()
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\nno header line\r\nX-Folded: a\r\n b\r\n\r\n" + body
    ids = [f"WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-00000000000{i}>" for i in range(8)]
    made = [
        foreign("warcinfo", b"software: x\r\n", ids[0], "Content-Type: application/warc-fields", "WARC-Date: 2001-01-01T00:00:00Z"),
        foreign("request", b"GET / HTTP/1.0\r\n\r\n", ids[1], "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"),
        foreign("response", http, ids[2], "Content-Type: application/http;", "  msgtype=response", "WARC-Target-URI:", "\thttp://a/", f"WARC-Payload-Digest: {sha1}",
                "WARC-Block-Digest: sha1:" + hashlib.sha1(http).hexdigest(), version="WARC/1.1"),
        foreign("metadata", b"fetchTimeMs: 1", ids[3], "WARC-Payload-Digest: md5:unchecked"),
        foreign("resource", b"", ids[4], "Content-Type: text/plain"),
        foreign("revisit", b"HTTP/1.0 304 Not Modified\r\n\r\n", ids[5], "WARC-Refers-To-Target-URI: http://a/", "Content-Type: application/http"),
        foreign("response", b"HTTP/1.0 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\n3\r\nabc\r\n0\r\n\r\n", ids[6]),
        foreign("response", b"gopher text", ids[7], "Content-Type: text/plain"),
    ]
    packer = zstandard.ZstdCompressor()
    (tmp_path / "a.warc.zst").write_bytes(b"".join(packer.compress(r) for r in made))
    out = sorted(warc.read_archives(spark, str(tmp_path)).collect(), key=lambda r: r.record_id)
    assert [r.record_type for r in out] == ["warcinfo", "request", "response", "metadata", "resource", "revisit", "response", "response"]
    assert out[2].payload == body and out[2].payload_digest == sha1 and out[2].url == "http://a/" and out[2].payload_bytes == len(body)
    assert out[2].content_type == "application/http; msgtype=response" and {r.page_id for r in out} == {None}
    assert out[0].payload == b"software: x\r\n" and out[0].date == "2001-01-01T00:00:00Z" and out[4].payload == b"" and out[7].payload == b"gopher text"
    assert out[5].payload is None and out[5].payload_bytes is None and out[6].payload_bytes == 13
    good = made[2]
    for bad in (good.replace(body, b"<p>Gruesse!</p"), good.replace(b"WARC/1.1", b"WARC/2.0"), good.replace(b"sha1:", b"sha1:A", 1), good[:-2], good.replace(b"WARC-Target-URI:", b"WARC Target"),
                good.replace(b"Content-Length: ", b"Content-Length: -"), foreign("revisit", b"HTTP/1.0 200 OK\r\n\r\n"), foreign("response", b"HTTP/1.0 200 OK\r\nContent-Length: 5\r\n\r\nab")):
        with pytest.raises(warc.DamagedArchive):
            warc.parse(bad)


def test_words_of_any_script_and_length(spark):
    long = "b" * 40
    html = f"<p>Größe {long} größe enßst</p><p>enßst</p>"
    words = spark.createDataFrame([(html,)], "h string").select(F.explode(url_filter.visible_words(F.col("h"))).alias("w")).groupBy("w").count().collect()
    assert {r.w: r["count"] for r in words} == {"größe": 2, long: 1, "enßst": 2}
    assert url_filter.segment("a" + long + "c", {(1, 40): 1}, 1) == ["a", long, "c"]
    rows = [(1, f"http://{long}größe.com/x", html), (2, "http://shop.org/", "<p>shop</p>")]
    assert url_filter.judge(data.pages(spark, rows), URL_RULES).count() == 2


def test_log_odds_by_hand(spark):
    """The classifier's scores computed here from the segments and the counts, to 6 digits."""
    html = "<p>" + "cat dog news spam shop " * 5 + "</p>"
    rows = [(i, f"http://catnews{'' if i % 2 else 'dog'}.org/cat/{i}", html) for i in range(10)] + [(20 + i, f"http://spamshop.com/de/spam{i}", html) for i in range(7)]
    rows += [(40, "http://newscat.net/cat", html), (41, "http://shopspam.net/spam/12/", html), (42, None, None)]
    split = {"catnews": ["cat", "news"], "catnewsdog": ["cat", "news", "dog"], "spamshop": ["spam", "shop"], "newscat": ["news", "cat"], "shopspam": ["shop", "spam"]}

    def tokens(url):
        host, path, *_ = brute_rule(url)
        labels = [w for part in host.split(".") if part for w in split.get(part, [part])]
        found = re.findall("[a-z]+|[0-9]+", path)
        return ["h:" + w for w in labels] + ["p:" + ("#" if w.isdigit() else w) for w in found]

    seen = {"allow": [], "block": []}
    docs = {"allow": 0, "block": 0}
    for _, url, _ in rows:
        if verdict := brute_rule(url)[3]:
            seen[verdict] += tokens(url)
            docs[verdict] += 1
    vocabulary = set(seen["allow"]) | set(seen["block"])
    prior = math.log((docs["allow"] + 1) / (docs["block"] + 1))

    def odds(url):
        out = prior
        for t in tokens(url):
            if t in vocabulary:
                a, b = ((seen[k].count(t) + 1) / (len(seen[k]) + len(vocabulary)) for k in ("allow", "block"))
                out += math.log(a / b)
        return out

    got = {r.page_id: r.log_odds for r in url_filter.judge(data.pages(spark, rows), URL_RULES).collect()}
    assert got == {i: pytest.approx(odds(url), abs=2e-6) for i, url, _ in rows}
