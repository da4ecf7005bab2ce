import re
import time
from collections import defaultdict

import numpy as np

from sitelens.llm import langid

EN = "the quick brown fox jumps over the lazy dog and the men went with them to the water when they were there"
FR = "le renard brun saute par dessus le chien paresseux et les hommes sont allés avec eux vers les eaux du fleuve"


def docs(spark):
    rows = [(f"{t} {k}", lang) for k in range(20) for t, lang in ((EN, "en"), (FR, "FR"))] + [(None, "de"), ("x", None)]
    return spark.createDataFrame(rows, "text string, lang string")


def test_evidence_is_fused(spark):
    model = langid.train(docs(spark))
    assert model[0] == ["en", "fr"] and np.allclose(np.exp(model[1]).sum(1), 1, atol=1e-3)
    page = "<html lang='{}'><body><p>{}</p></body></html>".format
    rows = [(k, f"https://a.example.fr/{k}", page("fr", FR), None) for k in range(30)]
    rows += [(100 + k, f"https://b.example.com/en/{k}", page("en", EN), None) for k in range(30)]
    rows += [(200, "https://a.example.fr/x", "", "z"), (201, "https://b.example.com/en/x", None, "z"), (202, None, page("fr-CA", ""), "z"), (203, "https://a.example.fr/y", page("fr", EN), "z"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, language string")
    out = langid.with_language(pages, model)
    assert out.columns == ["page_id", "url", "declared", "address", "text_language", "language", "probability"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    assert all(got[k].language == "fr" and got[100 + k].language == "en" for k in range(30))
    assert got[200].language == "fr" and got[201].language == "en" and got[202].language == "fr"
    assert got[203].text_language == "en" and got[202].declared == "fr" and got[201].address == "com/en"
    assert all(0.5 <= r.probability <= 1 for r in got.values())
    assert langid.with_language(pages.limit(0), model).count() == 0


def test_columns_of_any_names_stay(spark):
    model = langid.train(docs(spark))
    names = ["_host", "host_mass", "_declared_log", "_p", "logp", "p", "own", "domain", "at", "x", "raised", "a.b", "declared"]
    rows = [(k, f"http://a{k % 2}.org/", f"<p>{EN}</p>", *[f"mine {n}" for n in names]) for k in range(4)]
    pages = spark.createDataFrame(rows, ["page_id", "url", "html", *names])
    out = langid.with_language(pages, model)
    assert out.columns == ["page_id", "url", *names[:-1], "declared", "address", "text_language", "language", "probability"]
    assert all(list(r)[2 : 2 + len(names) - 1] == [f"mine {n}" for n in names[:-1]] and r.language == "en" for r in out.collect())


def test_many_languages_take_no_larger_plan(spark):
    pages = spark.createDataFrame([(k, f"http://a{k}.org/", f"<p>{EN if k % 2 else FR}</p>") for k in range(6)], "page_id long, url string, html string")

    def plan(n):
        model = [f"l{k:03}" for k in range(n)], np.log(np.random.default_rng(1).dirichlet(np.ones(512), n)).astype(np.float32)
        began = time.time()
        found = langid.with_language(pages, model)
        assert len({r.language for r in found.collect()}) >= 1
        return len(re.findall(r"\bProject\b|\bJoin\b|\bAggregate\b", found._jdf.queryExecution().optimizedPlan().toString())), time.time() - began

    plan(2)
    (few, first), (many, second) = plan(4), plan(200)
    assert few == many and second < 2 * first + 5


def test_no_training_texts(spark):
    model = langid.train(docs(spark).limit(0))
    pages = spark.createDataFrame([(1, "http://x.org", "<p>a</p>")], "page_id long, url string, html string")
    assert [r.language for r in langid.with_language(pages, model).collect()] == ["und"]


def test_query(spark, small):
    rows = langid.op8_language(spark, small).collect()
    path = [r for r in rows if f"/{r.declared}/" in r.url]
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert sum(r.language == r.declared for r in path) >= 0.97 * len(path) > 100


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def test_training_counts_against_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = {(r.lang, r.text) for r in table.select("lang", "text").collect() if r.text is not None}
    names, logs = langid.train(table)
    assert names == sorted({n for n, _ in rows})
    for k, name in enumerate(names):
        counts = np.full(langid.BUCKETS, 0.1)
        for n, t in rows:
            if n == name:
                counts += np.bincount(langid.trigrams(t), minlength=langid.BUCKETS)
        assert np.allclose(logs[k], np.log(counts / counts.sum()), atol=1e-5)
    many = spark.createDataFrame([(f"{EN} {k}", f"{a}{b}") for k, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")] + [("no tag", "notalanguage"), (EN, "xx-YY"), (EN, "XX")], "text string, lang string")
    names, logs = langid.train(many, buckets=1 << 11)
    assert len(names) == 101 and "xx" in names and logs.shape == (101, 1 << 11)
    assert langid.train(many)[1].shape == (101, langid.BUCKETS)


def test_fusion_against_brute_force(spark, small):
    """Every page's posterior, from all pages in plain Python."""
    names, logs = model = langid.train(spark.read.parquet(f"{small}/documents.parquet"))
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()
    n, evidence, p = len(names), {}, {}
    hosts, domains, given = defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n)), [defaultdict(lambda: np.zeros(n)) for _ in range(2)]
    world, place = np.ones(n), {}
    for r in pages:
        at = langid.trigrams(langid.main_text(r.html))
        x = logs[:, at].sum(1, dtype=float) * min(1.0, langid.EVIDENCE / max(1, len(at)))
        evidence[r.page_id], p[r.page_id] = x - x.max(), softmax(x)
        host = re.match(r"[a-z]+://([^/:?#]+)", r.url)[1].lower()
        tail = re.match(r"[a-z]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", r.url)
        address = "/".join([host.split(".")[-1], tail[1].lower() if tail else ""])
        declared = re.search(r"<html[^>]*\slang=\"([a-z]{2,3})", r.html)
        place[r.page_id] = host, ".".join(host.split(".")[-2:]), declared[1] if declared else "", address
        for box, key in ((hosts, host), (domains, place[r.page_id][1]), (given[0], place[r.page_id][2]), (given[1], address)):
            box[key] += p[r.page_id]
        world += p[r.page_id]
    rows = langid.with_language(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html"), model).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, domain, declared, address = place[r.page_id]
        own = p[r.page_id]
        rest = max(domains[domain].sum() - 1, 0)
        prior = (np.maximum(domains[domain] - own, 0) + langid.DOMAIN_PRIOR * world / world.sum()) / (rest + langid.DOMAIN_PRIOR)
        prior = (np.maximum(hosts[host] - own, 0) + langid.HOST_PRIOR * prior) / (max(hosts[host].sum() - 1, 0) + langid.HOST_PRIOR)
        logp = evidence[r.page_id] + np.log(prior + 1e-9)
        for box, key in zip(given, (declared, address)):
            logp = logp + np.log((box[key] + langid.EVIDENCE_PRIOR) / (world + langid.EVIDENCE_PRIOR * (len(box) + 1)))
        assert (r.declared, r.address) == (declared, address)
        assert abs(r.probability - softmax(logp).max()) < 1e-6 and r.language == names[int(softmax(logp).argmax())]
