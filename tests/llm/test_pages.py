import base64
import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from buslens.llm.extraction import common_lines, extract
from buslens.llm.html_lines import page_lines
from buslens.llm.warc import LoserTree, archive_index, read_archives, url_key, write_archives

SHAPE = "page_id long, url string, html string, digest string, Text int"


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages():
    rng = random.Random(1)
    bodies = [None, "", "<p>é</p>", "a\r\n\r\nb", "ends\r\n", "\r\n\r\n", "\r\r\n\r\n\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nx", "x" * 300_000 + "\r\n\r\n", "same"]
    data = [(i, rng.choice([None, "", f"http://www.h{i % 3}.org:80/P{i % 5}?q=1#f", "https://u@H9.com/a b\r\nX: y"]), rng.choice(bodies), "", 0) for i in range(70)]
    return data + data[:2] + [(None, "http://h1.org/", "same", "", 0), (None, None, "only here", "", 0)]


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), i, k) for k in range(rng.randint(0, 6))) for i in range(rng.randint(0, 9))]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path):
    data = pages()
    df = spark.createDataFrame(data, SHAPE).repartition(3)
    got = archive_index(df, path=str(tmp_path / "a")).collect()
    rows = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = Counter()
    for html in {d[2] or "" for d in data}:
        ids = sorted((d[0] for d in data if (d[2] or "") == html), key=lambda i: -1 if i is None else i)
        size = len(html.encode())
        want[ids[-1], size, sha(html), "response", None] += 1
        for i in ids[:-1]:
            want[i, size, sha(html), "revisit", ids[-1]] += 1
    assert rows == want
    order = sorted(got, key=lambda r: (r.range, r.position))
    keys = [(r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys)
    assert Counter(r.url_key for r in got) == Counter(url_key(re.sub(r"[\x00-\x20]", "%20", d[1] or "")) for d in data)


def test_archives_of_ids_at_both_ends_of_a_long(spark, tmp_path):
    ids = [2**63 - 1, -(2**63), 2**60, 200_000_000_000, -5, -1, 0, 7, None]
    got = archive_index(spark.createDataFrame([(i, "http://a.org/", f"p{i}", "", 0) for i in ids], SHAPE), path=str(tmp_path / "l")).collect()
    assert Counter(r.page_id for r in got) == Counter(ids) and all(r.record_type == "response" and len(r.timestamp) == 14 for r in got)
    order = [(r.timestamp, -(2**64) if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: (r.range, r.position))]
    assert order == sorted(order)


def test_archives_are_warc_files(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "http://a.org/", "é", "", 0), (2, "http://a.org/", "é", "", 0)], SHAPE).select("page_id", "url", "html"), str(tmp_path / "w"), compression="none")
    text = "".join(f.read_bytes().decode() for f in sorted(tmp_path.rglob("part-*")))
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: revisit" in text and text.endswith("\r\n\r\n")
    assert f"WARC-Payload-Digest: sha1:{sha('é')}\r\n" in text
    for r in read_archives(spark, str(tmp_path / "w")).collect():
        name = re.sub(r"^file:/+", "/", r.file)
        part = open(name, "rb").read()[r.offset:r.offset + r.length]
        assert part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n")


def test_small_payloads_are_not_shared(spark, tmp_path):
    data = [(i, "http://a.org/", h, "", 0) for i, h in enumerate(["ab", "ab", "long one", "long one", "ab"])] + [(0, "http://a.org/", "ab", "", 0)]
    got = archive_index(spark.createDataFrame(data, SHAPE), min_bytes=5, path=str(tmp_path / "s")).collect()
    assert Counter((r.page_id, r.record_type) for r in got) == Counter([(0, "response"), (0, "response"), (1, "response"), (4, "response"), (3, "response"), (2, "revisit")])
    assert archive_index(spark.createDataFrame([], SHAPE), path=str(tmp_path / "e")).collect() == []


def test_damage_is_found(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "http://a.org/", "payload", "", 0)], SHAPE).select("page_id", "url", "html"), str(tmp_path / "w"), compression="none")
    part, = [f for f in tmp_path.rglob("responses/part-*")]
    crc = part.parent / f".{part.name}.crc"
    part.write_bytes(part.read_bytes().replace(b"payload", b"pay1oad"))
    crc.write_bytes(b"") if crc.exists() else None
    with pytest.raises(Exception, match="does not match its digest|hecksum"):
        read_archives(spark, str(tmp_path / "w")).collect()


def test_common_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a, b = (rng.integers(0, 6, rng.integers(0, 12)) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        found = common_lines(a, b)
        rest = iter(b)
        assert found.sum() == table[-1, -1] and all(any(x == y for y in rest) for x in a[found])


def test_common_lines_of_long_pages_in_little_memory(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [(rng.integers(0, k, n), rng.integers(0, k, m)) for n, m, k in ((40, 60, 4), (90, 30, 30), (1, 50, 3), (70, 70, 2), (64, 200, 9))]
    want = [common_lines(a, b).sum() for a, b in pairs]
    monkeypatch.setattr("buslens.llm.extraction.CELLS", 16)
    for (a, b), n in zip(pairs, want):
        found = common_lines(a, b)
        rest = iter(b)
        assert found.sum() == n and all(any(x == y for y in rest) for x in a[found])
    monkeypatch.undo()
    a = rng.integers(0, 500, 8000)
    tracemalloc.start()
    common_lines(a, rng.permutation(a))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # a full table of lengths has 256 MB


def test_lines_of_markup():
    html = """<!doctype html><title>T</title><script>var a="</p>";</script><nav><ul><li>Home</ul></nav><header>Top</header><div class="side-bar adBox">Buy</div>
    <article><header><h1>A &amp; B</h1></header><p>one<br>two <b>bold</b>&nbsp;x<p>three<ul><li>i<li>j</ul><aside>Note</aside><form>f<input></form>
    <table><tr><td>1<td>2</table><div id="comments"><article>me too</article></div><p hidden>no</p></article><footer>&copy; end"""
    lines = page_lines(html)
    assert [x.text for x in lines if x.main and not x.chrome] == ["A & B", "one two bold x", "three", "i", "j", "1", "2"]
    assert {x.text for x in lines if x.chrome} == {"Home", "Top", "Buy", "Note", "f", "me too", "no", "© end"}
    assert page_lines("") == [] and [x.text for x in page_lines("a < b <p")] and [x.text for x in page_lines("</p></div>x<b")]


def test_names_do_not_rule_out_the_article():
    def kept(html):
        return [x.text for x in page_lines(html) if not x.chrome]

    body = '<h1>T</h1><p>Some words of an article</p>'
    for name in ('id="page" class="has-sidebar"', 'class="layout sidebar-right"', 'class="fixed-header"', 'role="banner"', 'class="comments-closed"'):
        assert kept(f'<div {name}><div class="sidebar">Side</div><article>{body}</article><div id="comments">Me</div></div>') == ["T", "Some words of an article"]
    assert kept(f'<div class="has-sidebar"><div class="sidebar">Side</div><div>{body}</div></div>') == ["T", "Some words of an article"]
    assert kept('<article><div class="post-header"><h1>T</h1></div><p>One two three</p><p class="notice">Mind the step</p><div class="social-links">Share</div></article>') == ["T", "One two three", "Mind the step"]
    # Teasers and comments that are articles themselves; comments longer than the article.
    assert kept(f'<article>{body}</article><div class="related"><article>Read on</article></div><div class="comments"><article>{"me too " * 9}</article></div>')[:2] == ["T", "Some words of an article"]
    assert "Read on" not in kept(f'<article>{body}</article><div class="related"><article>Read on</article></div>')
    assert kept(f'<div>{body}</div><div class="related"><article>Read on</article></div>') == ["T", "Some words of an article"]
    assert kept('<div class="social-post"><article>One post</article></div><div class="social-post"><article>Two</article></div>') == ["One post", "Two"]
    assert kept(f'<p>Short</p><div class="comments"><p>{"me too " * 9}</p></div>') == ["Short"]


def test_extract_by_differencing_and_markup(spark):
    def plain(i):
        return f"<html><body><div>Site of things</div><p>Text number {i}.</p><p>More   on\n{i} &lt;here&gt;.</p><div>All rights reserved</div></body></html>"

    data = [(i, f"http://Big.org/news/{i:03d}", plain(i), "", 0) for i in range(40)]
    data += [(100, "http://alone.org/x", plain(100), "", 0), (101, "http://big.org/art/1", "<nav>Site of things</nav><article><h1>T</h1><p>Same words</p></article>", "", 0)]
    data += [(102, "http://big.org/art/2", "<nav>Site of things</nav><article><h1>T</h1><p>Same words</p></article>", "", 0), (103, None, None, "", 0), (104, None, "", "", 0), (None, "x", "<p>only <", "", 0), (103, None, None, "", 0)]
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract(spark.createDataFrame(data, SHAPE).repartition(5)).collect())
    want = Counter()
    for d in data:
        text = {100: "Site of things\n\nText number 100.\n\nMore on 100 <here>.\n\nAll rights reserved", 101: "T\n\nSame words", 102: "T\n\nSame words", 103: "", 104: "", None: "only <"}.get(d[0], f"Text number {d[0]}.\n\nMore on {d[0]} <here>.")
        want[d[0], d[1], text, len(text)] += 1
    assert got == want
    assert extract(spark.createDataFrame([], SHAPE)).collect() == []


def test_unmarked_copies_keep_their_text(spark):
    def plain(words, n=12):
        return "<div>Site of things</div>" + "".join(f"<p>{words} {k}</p>" for k in range(n)) + "<div>All rights reserved</div>"

    def text(words, n=12):
        return "\n\n".join(f"{words} {k}" for k in range(n))

    a, near = plain("Article a"), plain("Article a").replace("Article a 3", "Seen 4 times")
    data = [(1, "http://h.org/a/1", a, "", 0), (2, "http://h.org/a/2", a, "", 0), (3, "http://h.org/a/3", near, "", 0), (1, "http://h.org/a/1", a, "", 0), (4, "http://h.org/b", plain("Other b"), "", 0)]
    data += [(10 + k, "http://twice.org/x", plain("Only this"), "", 0) for k in range(3)]  # no other page in the host
    data += [(20 + k, f"http://many.org/p/{k:03d}", plain("Same"), "", 0) for k in range(60)] + [(90, "http://many.org/q", plain("Else"), "", 0)]
    whole = "Site of things\n\n" + text("Only this") + "\n\nAll rights reserved"
    want = Counter()
    for d in data:
        i = d[0]
        want[i, whole if 10 <= i < 20 else text("Else") if i == 90 else text("Same") if i >= 20 else text("Other b") if i == 4 else text("Article a").replace("Article a 3", "Seen 4 times" if i == 3 else "Article a 3")] += 1
    for n in (1, 7):
        assert Counter((r.page_id, r.text) for r in extract(spark.createDataFrame(data, SHAPE).repartition(n)).collect()) == want


def test_deep_nesting_takes_linear_time():
    def seconds(html):
        begun = time.process_time()
        page_lines(html)
        return time.process_time() - begun

    for html in ("<div>", '<div class="ad">', "<b>", "</section><div>", "<li><b></i>", '<article><div class="ad">'):
        assert seconds(html * 40_000 + "x") < 15 * max(seconds(html * 8000 + "x"), 0.05)  # 25 times, were it quadratic
    assert [x.text for x in page_lines("<div>" * 50_000 + "in" + "</div>" * 50_000 + "out")] == ["in", "out"]
    assert page_lines('<div class="ad">' * 20_000 + "x" * 9 + "</div>" * 20_000 + "<p>" + "y" * 99) == [("x" * 9, False, True), ("y" * 99, False, False)]


def site(bar, own, foot):
    return "".join(f"<div>{x}</div>" for x in (*bar, *own, *foot))


def test_every_copy_of_a_long_run_loses_the_site_bar(spark):
    same = [f"Same {k}" for k in range(20)]
    data = [(k, f"http://many.org/p/{k:03d}", site(["Site"], [*same, f"Seen {k} times"], []), "", 0) for k in range(60)]
    data += [(900 + k, f"http://many.org/{p}", site(["Site"], [f"Else {k} {j}" for j in range(9)], []), "", 0) for k, p in enumerate(("a", "q", "r"))]
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in extract(spark.createDataFrame(data, SHAPE)).collect()}
        assert all(got[k] == "\n\n".join([*same, f"Seen {k} times"]) for k in range(60))
        assert all("Site" not in got[900 + k] and f"Else {k} 8" in got[900 + k] for k in range(3))
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_pages_that_are_mostly_menu_lose_it(spark):
    menu = [f"Menu {k}" for k in range(40)]
    data = [(k, f"http://menu.org/p/{k:02d}", site(menu, [f"Own {k} {j}" for j in range(3)], ["End"]), "", 0) for k in range(12)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(data, SHAPE)).collect()}
    assert got == {k: "\n\n".join(f"Own {k} {j}" for j in range(3)) for k in range(12)}


def test_differencing_equals_a_plain_pass_over_each_host(spark):
    """Pairs by brute force: every host's pages in order, runs of copies, the pages around them."""
    rng = random.Random(7)
    data = []
    for i in range(150):
        host, kind, bar = rng.randint(0, 4), rng.randint(0, 4), [f"Bar {k}" for k in range(rng.choice((1, 3, 30)))]
        data.append((i, f"http://h{host}.org/{rng.choice('abc')}/{i:03d}", site(bar, [f"Text {kind} {k}" for k in range(rng.choice((4, 12)))] + [f"Page {i % 40}"], []), "", 0))
    rows = {}
    for d in data:
        host, path = d[1].split("/")[2], "/" + d[1].split("/", 3)[3]
        lines = tuple(x.text for x in page_lines(d[2]))
        rows[host, lines] = min(path, rows.get((host, lines), path))
    kept = {}

    def copies(a, b):
        return sum((Counter(a) & Counter(b)).values()) >= 0.9 * max(len(a), len(b))

    def alike(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for host in {h for h, _ in rows}:
        order = sorted((path, lines) for (h, lines), path in rows.items() if h == host)
        runs = [0]
        for a, b in zip(order, order[1:]):
            runs.append(runs[-1] + (not copies(a[1], b[1])))
        for i, (path, lines) in enumerate(order):
            outside = [max((j for j in range(len(order)) if runs[j] < runs[i]), default=None), min((j for j in range(len(order)) if runs[j] > runs[i]), default=None)]
            outside = [order[j] for j in outside if j is not None]
            near = [o for o in outside if not copies(lines, o[1])] if outside else [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order)]
            other = max(near, key=lambda o: alike(path, o[0]), default=None)
            number = {x: k for k, x in enumerate({*lines, *(other[1] if other else ())})}
            gone = common_lines(np.array([number[x] for x in lines]), np.array([number[x] for x in other[1]])) if other else np.zeros(len(lines), bool)
            kept[host, lines] = "\n\n".join(x for x, g in zip(lines, gone) if not g)
    want = {d[0]: kept[d[1].split("/")[2], tuple(x.text for x in page_lines(d[2]))] for d in data}
    assert len({t for t in want.values()}) > 20
    for n in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {r.page_id: r.text for r in extract(spark.createDataFrame(data, SHAPE), markup=False).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_pages_are_parsed_once(spark, tmp_path):
    data = [(k, f"http://once.org/{k}", site(["Site"], [f"Own {k} {j}" for j in range(3)], []), "", 0) for k in range(6)] + [(7, None, None, "", 0)]
    spark.createDataFrame(data, SHAPE).write.parquet(str(tmp_path / "pages"))
    for markup in (True, False):
        found = extract(spark.read.parquet(str(tmp_path / "pages")), markup=markup)
        assert not [f for f in found.inputFiles() if "/pages/" in f]  # the last step reads lines, not html
        got = {r.page_id: r.text for r in found.collect()}
        assert got == {**{k: "\n\n".join(f"Own {k} {j}" for j in range(3)) for k in range(6)}, 7: ""}
