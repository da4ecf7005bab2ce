import re
from collections import defaultdict

from pyspark.sql import functions as F

from sitelens.llm import pii

from .helpers import odd_documents

#: Plain versions of the patterns whose samples occur in the test tables.
FORMS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[\w-]+",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w)",
    "card": r"(?<![^\W_])\d{13,19}(?![^\W_])",
    "secret": r"(?<![^\W_])[0-9a-f]{32,}(?![^\W_])",
}
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMS.items()))


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10


def plain(text):
    """Matches that are entities: bare digits need a card's first digit and check sum."""
    return [m for m in ANY.finditer(text) if m.lastgroup != "card" or m[0][0] in "23456" and luhn(m[0]) == 0]


def blanked(text):
    for m in reversed(plain(text)):
        text = f"{text[: m.start()]}#{text[m.end() :]}"
    return text


def test_query_against_plain_patterns(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = pii.op3_surrogates(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    maps, originals = defaultdict(set), set()
    for r in rows:
        old, new = plain(texts[r.doc_id]), plain(r.text)
        assert blanked(texts[r.doc_id]) == blanked(r.text)
        assert [m.lastgroup for m in old] == [m.lastgroup for m in new]
        assert r.n_entities == len({m[0] for m in old}) and r.kinds == ",".join(sorted({m.lastgroup for m in old}))
        for a, b in zip(old, new):
            maps[a[0]].add(b[0])
            originals.add(a[0])
            if a.lastgroup != "ip":
                assert re.sub(r"\w", "x", a[0].split("@")[0]) == re.sub(r"\w", "x", b[0].split("@")[0])
    assert len(originals) > 50 and all(len(x) == 1 for x in maps.values())
    made = {next(iter(x)) for x in maps.values()}
    assert len(made) == len(maps) and not made & originals


def names(spark, texts, **options):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    return [r.text for r in pii.with_surrogates(docs, **options).orderBy("doc_id").collect()]


def test_names_keep_gender_script_case_and_coreference(spark):
    a, b, c, d = names(spark, ["Mrs. Anna Smith met Dr. Smith. Anna and SMITH left; Smithson stayed.", "Mr Smith", "Господин Иванов и Госпожа Анна Иванова. Анна", "Clean Anna Smith text of 12 words."])
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Dr\. (\w+)\. (\w+) and SMITH left; Smithson stayed\.", a)
    assert m and m[2] == m[3] and m[1] == m[4] and m[1] in pii.NAMES["given_f", "latin"].split() and m[2] != "Smith"
    assert b == f"Mr {m[2]}" and d == "Clean Anna Smith text of 12 words."
    assert re.fullmatch(r"Господин [А-Яа-я]+ и Госпожа ([А-Яа-я]+) [А-Яа-я]+\. \1", c) and "Иванов" not in c and "Анна" not in c


def test_many_names_stay_distinct(spark):
    words = [f"{a}{b}" for a in "Bo Ca Da Fe Gi Ho Ju Ka Lo Mi Na Pe".split() for b in "ran len tis mor vik dal sun".split()]
    got = names(spark, [f"Mr. {w}" for w in words])
    assert len(set(got)) == len(words) and not {g[4:] for g in got} & set(words)


def weak(value, kind, draw, key):
    """Few surrogates, and real values among them, so that many draws collide."""
    return F.concat(F.lit("v"), (F.pmod(F.xxhash64(value, draw), F.lit(40))).cast("string"), F.lit("@x.org"))


def test_collisions_are_redrawn(spark):
    values = [f"v{k}@x.org" for k in range(12)]
    docs = spark.createDataFrame([(f"{v} and {v}",) for v in values], "text string")
    moved = pii.redraws(docs, "k", draw=weak)
    first = {r.value: r.s for r in spark.createDataFrame([(v,) for v in values], "value string").select("value", weak(F.col("value"), None, F.lit(0), "").alias("s")).collect()}
    final = first | {r.value: r.surrogate for r in moved.collect()}
    assert len(set(final.values())) == len(values) and not set(final.values()) & set(values)


def test_redrawn_values_are_used_on_both_paths(spark, monkeypatch):
    texts = ["write a@b.com now", "a@b.com or c@d.com", None, "", "none"] * 2
    again = spark.createDataFrame([("a@b.com", "email", "redrawn@example.com")], "value string, kind string, surrogate string")
    monkeypatch.setattr(pii, "redraws", lambda *a, **k: again)
    out = {}
    for most in (0, 100):
        monkeypatch.setattr(pii, "MOST_LITERALS", most)
        out[most] = names(spark, texts)
    assert out[0] == out[100] and out[0][0] == "write redrawn@example.com now" and out[0][1].startswith("redrawn@example.com or ") and out[0][2:5] == [None, "", "none"]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = pii.with_surrogates(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert pii.with_surrogates(docs.limit(0)).count() == 0


#: Values that are replaced whole, by type, none of which has a further digit, @ or title beside it.
WHOLE = {
    "phone": ["+33 1 23 45 67 89", "+14155550123", "+4915112345678", "555.123.4567", "555 123 4567", "(555) 123 4567", "5551234567", "(555) 123-4567", "+1 (555) 123-4567", "+44 20 7946 0958", "555-123-4567"],
    "card": ["3782 822463 10005", "3782-822463-10005", "4111 1111 1111 1111", "4111111111111111"],
    "ip": ["10.1.2.3", "2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1", "::1", "dead:beef::", "abcd:ef:ab:cd:ef:ab:cd:ef", "FE80::ABCD", "::ffff:192.168.0.1"],
    "secret": ["sk-abcdefghijklmnopqrstuvwxyz", "ghp_" + "aBcDeFgHiJ" * 3 + "aBcDeF", "AKIA" + "ABCDEFGHIJKLMNOP", "abcdefabcdefabcdefabcdefabcdefab"],
    "iban": ["DE89 3704 0044 0532 0130 00"],
    "ssn": ["078-05-1120"],
    "email": ["a.b@c-d.org"],
}


def test_forms_are_replaced_whole(spark):
    forms = [(k, v) for k, vs in WHOLE.items() for v in vs]
    docs = spark.createDataFrame([(k, f"key {v} end, then ({v}).") for k, (_, v) in enumerate(forms)], "doc_id int, text string")
    rows = pii.with_surrogates(docs, entities="found").orderBy("doc_id").collect()
    for (kind, value), r in zip(forms, rows):
        m = re.fullmatch(r"key (.+) end, then \((.+)\)\.", r.text)
        assert {e.kind for e in r.found} == {kind} and m and m[1] == m[2] != value, (kind, value, r)
        assert [e.value for e in r.found] == [value]
    kept = ["at 12:34:56 sharp", "std::vector and a:b, :5:3", "from 1 to 20,000 words", "sk-short AKIA"]
    assert names(spark, kept) == kept


def test_detectors_find_nothing_more(spark):
    """All that findings.DETECTORS takes for a phone, a card or an address is replaced, but for times of day."""
    from itertools import product

    from sitelens.operators import findings

    phones = ["".join(x) for x in product(["", "+1 ", "+12"], ["555", "(555)"], ["", "-", ".", " "], ["123"], ["", "-", ".", " "], ["4567"])]
    cards = ["1234" + a + "5678" + b + "9012" + c + "3456" for a, b, c in product(" -", repeat=3)]
    addresses = ["1.2.3.4", "999.10.20.30", "1.2.3.4.5"] + [":".join(["aB1"] * n) for n in range(3, 9)]
    values = phones + cards + addresses
    docs = spark.createDataFrame([(k, f"x {v} y") for k, v in enumerate(values)], "file_id int, content string")
    detectors = [d for d in findings.DETECTORS if d.category in ("Phone Number", "Credit Card", "IPv4 Address", "IPv6 Address")]
    found = findings.matches(docs, detectors).select("file_id", "value")
    left = pii.with_surrogates(docs, text="content").join(found, "file_id").filter("contains(content, value)").select("content", "value").collect()
    assert found.count() > 60 and not left


def mod97(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_check_sums_and_ordinary_words(spark):
    same = ["at 1700000000123 ms", "code 9807915762804490 or 1234567890123", "DE88 3704 0044 0532 0130 00 is none", "no 4111111111111112"]
    assert names(spark, same) == same
    (a, b) = names(spark, ["pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "card 4111111111111111"])
    first, second = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d) or (GB\d\d[A-Z]{4}\d{14})", a).groups()
    assert mod97(first) == mod97(second) == 1 and "3704 0044" not in a and "WEST" not in a
    assert luhn(b[5:]) == 0 and b != "card 4111111111111111"
    (c,) = names(spark, ["Dr May came in May and Mr Will said he Will go, but Mr Zorn came and Zorn left"])
    m = re.fullmatch(r"Dr (\w+) came in May and Mr (\w+) said he Will go, but Mr (\w+) came and (\w+) left", c)
    assert m and m[1] != "May" and m[2] != "Will" and m[3] == m[4] != "Zorn"


def test_full_formats_are_permuted(spark):
    """Half of all short phone numbers, and all two-digit ends of another format."""
    values = [f"+49 {k // 100:02d} {k % 100:02d}" for k in range(0, 10_000, 2)] + [f"+33 10 {k // 100:02d} {k % 100:02d}" for k in range(40)]
    docs = spark.createDataFrame([(k, f"call {v} now") for k, v in enumerate(values)], "doc_id int, text string")
    got = [r.text for r in pii.with_surrogates(docs).orderBy("doc_id").collect()]
    made = [re.fullmatch(r"call (\+(?:49|33 \d\d) \d\d \d\d) now", t)[1] for t in got]
    assert len(set(made)) == len(values) and not any(a == b for a, b in zip(values, made))
    assert not set(made[5000:]) & set(values)
    every = spark.createDataFrame([(f"+49 {k // 100:02d} {k % 100:02d}", "phone", "+49| 00 00") for k in range(10_000)], "value string, kind string, format string")
    rows = pii.permuted(every, "key").collect()
    assert len({r.surrogate for r in rows}) == 10_000 and {r.surrogate for r in rows} == {r.value for r in rows} and all(r.surrogate != r.value for r in rows)
    octets = spark.createDataFrame([(f"{k % 256}.0.{k}.7", "ip", "octets") for k in range(256)], "value string, kind string, format string")
    rows = pii.permuted(octets, "key").collect()
    assert len({r.surrogate for r in rows}) == 256 and all(re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", r.surrogate) for r in rows)


def test_other_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "write a@b.com", 2, 3, None)], "doc_id int, text string, _spans int, _own int, _drawn string")
    (row,) = pii.with_surrogates(docs).collect()
    assert row._spans == 2 and row._own == 3 and row._drawn is None and "a@b.com" not in row.text


def replaced(spark, texts, **options):
    new = names(spark, texts, **options)
    assert len(set(new)) == len(set(texts)) and not any(a == b for a, b in zip(texts, new))
    return new


def test_fictional_numbers_that_fill_their_format(spark):
    texts = [f"+1-555-{k:04}" for k in range(10_000)]
    for most in (10_000, 5_000, 2_400):
        new = replaced(spark, texts[:most])
        assert all(re.fullmatch(r"\+1-555-\d{4}", t) for t in new)
    new = replaced(spark, [f"{k % 1000:03}-555-{k:04}" for k in range(3_000)])
    assert all(re.fullmatch(r"\d{3}-555-\d{4}", t) for t in new)


def test_draws_that_settle_nothing_end_in_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(pii, "DENSE", 2.0)  # so that drawing goes on until nothing is free
    monkeypatch.setattr(pii, "IDLE_DRAWS", 2)
    new = replaced(spark, [f"+1-555-{k:04}" for k in range(10_000)] + [f"+49-555-{k:04}" for k in range(50)] + ["x@y.org"])
    assert new[-1].endswith("@example.org") and all(re.fullmatch(r"\+\d{1,2}-555-\d{4}", t) for t in new[:-1])


def test_one_person_under_two_titles(spark):
    new = names(spark, ["Dr Maria Silva and Mrs Maria Silva", "Prof Maria Stone", "Dr Kim Lee", "Mr Kim Lee", "Mrs Kim Lee", "Dr Ana Silva"])
    given = re.fullmatch(r"Dr (\w+) (\w+) and Mrs (\w+) (\w+)", new[0]).groups()
    assert given[:2] == given[2:] and new[1].split()[1] == given[0] and new[5].split()[2] == given[1]
    assert len({t.split()[1] for t in new[2:5]}) == 3  # two genders: the title without one keeps a name of its own
