import html as entities
import re
import time

from sitelens.llm import wrappers

BODY = "<p>First <b>bold</b>&nbsp;text &amp; more.</p><p>Second<br>line<p>Third unclosed"


def article(k, n=3):
    return "".join(f"<p>Paragraph {k}-{j} has its own rather long sentence number {k * j}.</p>" for j in range(n))


def want(k, n=3):
    return " ".join(f"Paragraph {k}-{j} has its own rather long sentence number {k * j}." for j in range(n))


def page(k, inner):
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style></head><body class='has-sidebar'><header><h1>Site</h1></header>"
        f"<nav><ul>{'<li><a href=x>Menu</a></li>' * 5}</ul></nav><div class='cookie-notice'><p>We use cookies, a long and tiresome notice text.</p></div>"
        f"{inner}<aside><p>Sidebar words {k}</p></aside><form><p>Sign up</p><input></form><section id='comments'><p>Reader comment {k} that is much longer than the article itself, really.</p></section>"
        f"<div class='ad'>Buy {k}</div><footer>&copy; Site</footer><script>var t='</p>';</script></body></html>"
    )


def test_broken_markup_and_references():
    assert wrappers.main_text(f"<html><nav>x</nav><article><h1>Head</h1>{BODY}</article><footer>f</footer>") == "Head First bold text & more. Second line Third unclosed"
    for odd in (None, "", "   ", "<", "<<<>>", "<p", "</p></div>", "<script>never closed <p>x</p>", "<!-- open", "<a href='x>y"):
        assert isinstance(wrappers.main_text(odd), str)
    assert wrappers.main_text("just text") == "just text" and wrappers.main_text("<p>one</p><p>two</p>") == "one two"


def wrapper_of(pages):
    return wrappers.weigh(wrappers.Node.unpack(wrappers.json.loads(wrappers.merge_wrappers([wrappers.packed(wrappers.template(wrappers.parse(p))) for p in pages]))))


def test_marked_and_unmarked_articles():
    for before, after in (("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div class='post-content'>", "</div>"), ("<div><div>", "</div></div>")):
        pages = [page(k, before + article(k) + after) for k in range(8)]
        wrapper = wrapper_of(pages)
        for k, p in enumerate(pages):
            assert wrappers.main_text(p, wrapper) == want(k), before


def test_alignment_makes_slots_optional_and_repeated_groups():
    pages = ["<div><h2>A</h2><p>x</p><h2>B</h2><p>y</p></div>", "<div><h2>A</h2><p>z</p></div><ul><li>1<li>2</ul>"]
    div, ul = wrapper_of(pages).kids
    assert [k.key for k in div.kids] == ["h2", "p"] and all(k.repeated for k in div.kids) and div.kids[1].text == 0
    assert ul.optional and ul.kids[0].repeated and not div.optional


def nameless(k, inner, menu="Welcome to this place, have a look around, it is a fine and long text that greets you"):
    """A page of plain divs: greeting and terms are fixed, a teaser and a link list vary."""
    links = "".join(f"<div><a href=x>Story {k} of {j} that you may like to read as well</a></div>" for j in range(k % 5 + 4))
    return f"<html><body><div><p>{menu}</p></div><div>Teaser {k}</div>{inner}<div>{links}</div><div><p>Terms and conditions of this place, which never change at all.</p></div></body></html>"


def test_the_wrapper_decides_on_pages_without_names():
    pages = [nameless(k, f"<div>{article(k, k % 4 + 1)}</div>") for k in range(20)]
    wrapper = wrapper_of(pages)
    alone = [wrappers.main_text(p) for p in pages]
    assert [wrappers.main_text(p, wrapper) for p in pages] == [want(k, k % 4 + 1) for k in range(20)]
    assert sum(t != want(k, k % 4 + 1) for k, t in enumerate(alone)) > 10  # without the host's wrapper it can't be told


def test_depth_and_number_of_places_change_nothing():
    texts = [want(k, k % 4 + 1) for k in range(20)]
    plain = [f"<div>{article(k, k % 4 + 1)}</div>" for k in range(20)]
    deep = [nameless(k, x).replace("<body>", "<body>" + "<div>" * 300).replace("</body>", "</div>" * 300 + "</body>") for k, x in enumerate(plain)]
    wrapper = wrapper_of(deep)
    assert [wrappers.main_text(p, wrapper) for p in deep] == texts
    inner = [nameless(k, "<div>" * 300 + x + "</div>" * 300) for k, x in enumerate(plain)]
    wrapper = wrapper_of(inner)
    assert [wrappers.main_text(p, wrapper) for p in inner] == texts
    blocks = "".join(f"<div class=b{chr(97 + j // 676)}{chr(97 + j // 26 % 26)}{chr(97 + j % 26)}>x</div>" for j in range(1_600))
    wide = [nameless(k, x).replace("<body>", "<body>" + blocks) for k, x in enumerate(plain)]
    wrapper = wrapper_of(wide)
    assert [wrappers.main_text(p, wrapper) for p in wide] == texts


def test_flat_wrappers_come_back():
    page = "<body>" + "<div><p>a</p><ul><li>b</li></ul><section>" * 900 + "c"
    node = wrappers.template(wrappers.parse(page))
    assert wrappers.Node.unpack(node.pack()).pack() == node.pack() and len(node.pack()) > 900
    both = wrappers.merge_wrappers([wrappers.packed(node), wrappers.packed(wrappers.template(wrappers.parse(page[:-1] + "d")))])
    assert len(wrappers.json.loads(both)) == len(node.pack())


def test_furniture_of_unknown_names():
    inner = "<div class=qz><p>Share this with everyone you know, it only takes one click.</p></div>"
    pages = [f"<html><body><div class=xx>Words of welcome</div><article>{article(k)}{inner}<p>Last line {k}.</p></article><div class=yy>Trailing {k}</div></body></html>" for k in range(9)]
    wrapper = wrapper_of(pages)
    assert [wrappers.main_text(p, wrapper) for p in pages] == [f"{want(k)} Last line {k}." for k in range(9)]
    assert wrappers.main_text(pages[0]) != wrappers.main_text(pages[0], wrapper)
    # A furniture word gives way where the varying text is.
    pages = [f"<html><body><div class=menu><p>Fixed words of welcome</p></div><div class='sidebar content'>{article(k)}</div></body></html>" for k in range(9)]
    wrapper = wrapper_of(pages)
    assert [wrappers.main_text(p, wrapper) for p in pages] == [want(k) for k in range(9)]


def test_near_copies_keep_their_blocks():
    for n in (4, 5, 50):
        for before, after in (("<article>", "</article>"), ("<div class=text>", "</div>")):
            body = f"{article(3)}<div class=box><ul><li>A list that only this article has</li></ul><div>And a remark</div></div><p>Printed on day {{}}.</p>"
            pages = [f"<html><body>{before}{body.format(k)}{after}</body></html>" for k in range(n)]
            others = [f"<html><body>{before}{article(k + 9)}{after}</body></html>" for k in range(6)]
            wrapper = wrapper_of(pages + others)
            for k, p in enumerate(pages):
                assert wrappers.main_text(p, wrapper) == f"{want(3)} A list that only this article has And a remark Printed on day {k}.", (n, before)


def test_deep_wide_and_hostile_pages_take_linear_time():
    began = time.time()
    wide = "".join(f"<div class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}>x</div>" for k in range(20_000))
    for odd in ("<div>" * 100_000 + "x", "<span>" * 100_000 + "x", "<a '" * 100_000, "<a '" * 100_000 + ">", "<" * 100_000, "<li>x" * 50_000, "<!--" * 50_000, wide):
        both = wrappers.merge_wrappers([wrappers.packed(wrappers.template(wrappers.parse(p))) for p in (odd, f"<div class=other>y</div>{odd[1:]}")])
        assert isinstance(wrappers.main_text(odd, wrappers.weigh(wrappers.Node.unpack(wrappers.json.loads(both)))), str)
        assert len(both.encode()) < wrappers.MOST_PLACES * (wrappers.LONGEST_KEY * 4 + 500)
    assert wrappers.main_text("<div>" * 100_000 + "x") == "x" and time.time() - began < 60


def test_query_against_the_marked_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = wrappers.op6_main_text(spark, small).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|ul|li|div)[^>]*>", inner))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_rounds_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    rows = [(k, f"https://A.example.com/{k}", page(k, "<div><div>" + article(k) + "</div></div>"), "h", "w") for k in range(20)]
    rows += [(None, None, None, None, None), (50, "no address", "", None, None), (51, "https://b.example.com", "<p>x</p>", None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _wrapper string").repartition(8)
    out = wrappers.with_main_text(pages)
    assert out.columns == [*pages.columns, "text"]
    got = sorted((str(r.page_id), r.text) for r in out.collect())
    assert got == sorted([(str(k), want(k)) for k in range(20)] + [("None", ""), ("50", ""), ("51", "x")] * 2)
    assert wrappers.infer_wrappers(pages).count() == 3 and wrappers.with_main_text(pages.limit(0)).count() == 0
    monkeypatch.setattr(wrappers, "MOST_BROADCAST", 0)
    assert sorted((str(r.page_id), r.text) for r in wrappers.with_main_text(pages).collect()) == got


def test_texts_are_the_same_for_any_partitions_and_batches(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = []
    for parts, batch in ((1, 10_000), (4, 10_000), (16, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found.append({r.page_id: r.text for r in wrappers.with_main_text(pages.repartition(parts)).select("page_id", "text").collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and len(found[0]) == pages.count()
