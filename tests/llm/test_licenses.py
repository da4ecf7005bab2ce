import random

from sitelens.llm import licenses

from .helpers import odd_documents, words

PHRASES = {k: tuple(p.encode().split()) for k, p in licenses.BASE_PHRASES.items()}


def brute_base(text):
    mine = words(text)
    return [(k, label) for k in range(len(mine)) for label, p in sorted(PHRASES.items()) if tuple(mine[k : k + len(p)]) == p]


def check(row, text):
    places = brute_base(text)
    starts = [k for k, _ in places]
    assert row.n_words == len(words(text)) and row.n_base == len(places)
    assert (row.first_word, row.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
    assert row.base_labels == ",".join(sorted({label for _, label in places}))
    assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_query_against_brute_force(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = licenses.op4_licenses(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        check(r, texts[r.doc_id])
        for sign, label in (("Released under the MIT License.", "mit"), ("Apache License, Version 2.0", "apache-2.0"), ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("General Public License, version 3", "gpl-3.0")):
            assert (label in r.labels.split(",")) == (sign in texts[r.doc_id]), (r, sign)


def test_odd_rows(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = licenses.op4_licenses(spark, str(tmp_path)).collect()
    assert len(rows) == odd_documents(spark).count() and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in rows)
    assert licenses.with_licenses(odd_documents(spark).limit(0)).count() == 0


def common(text, template, least):
    """All (start, end, end in the template) of equal runs that neither side lengthens."""
    out = set()
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and (i == 0 or j == 0 or text[i - 1] != template[j - 1]):
                n = 1
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, i + n, j + n))
    return out


def test_matching_statistics_and_pieces_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        whole = rng.choices("abc", k=rng.randrange(4, 14))
        at = rng.randrange(len(whole) - 2)
        templates = {f"t{k}": (" ".join(rng.choices("abc", k=rng.randrange(1, 14))),) for k in range(3)} | {"outer": (" ".join(whole),), "inner": (" ".join(whole[at : at + 4]),)}
        scanner = licenses.Scanner({"x": "a b", "y": "b", "z": "c a b"}, templates)
        sequences = [w for _, w in scanner.base + scanner.templates]
        text = rng.choices([b"a", b"b", b"c", b"d"], k=60)
        for end, length, state in scanner.statistics(text):
            want = max((n for n in range(end + 1) for s in sequences if n == 0 or any(s[k : k + n] == text[end - n : end] for k in range(len(s) - n + 1))))
            tail = text[end - want : end]
            ends = [(n, k + want) for n, s in enumerate(sequences) for k in range(len(s) - want + 1) if s[k : k + want] == tail]
            assert length == want and sorted(scanner.automaton.ends(state)) == ends
        places, pieces = scanner.pieces(text)
        assert sorted(places) == sorted((k, n) for n, (_, p) in enumerate(scanner.base) for k in range(60) if text[k : k + len(p)] == p)
        for n, (_, words_) in enumerate(scanner.templates):
            found = pieces.get(n, [])
            assert len(found) == len(set(found)) and set(found) == common(text, words_, min(licenses.LEAST_MATCH, len(words_)))


def test_nested_short_and_repeated_templates():
    scanner = licenses.Scanner({"one": "word"}, {"outer": ("a b c d e f g",), "inner": ("b c d e f",), "short": ("x y",)})
    found = scanner.scan("a b c d e f g and word x y")
    assert found["spans"] == [(0, 7, "outer", 1.0), (1, 6, "inner", 1.0), (9, 11, "short", 1.0)] and found["base"] == [(8, "one")]
    twice = scanner.scan("a b c d e f g " + "z " * 20 + "a b c d e f g")["spans"]
    assert [s[:3] for s in twice if s[2] == "outer"] == [(0, 7, "outer"), (27, 34, "outer")]
    # The chain that covers most, not the latest one: the second "c d e" must not cut the first chain off.
    assert ("outer", 1.0) in {s[2:] for s in scanner.scan("a b c d c d e f g")["spans"]}


def test_whole_licenses_and_long_texts():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)
    for label, texts in licenses.TEMPLATES.items():
        for text in texts:
            got = scanner.scan(f"some code here {text} and more")
            assert label in {s[2] for s in got["spans"]} and got["base"] == brute_base(f"some code here {text} and more")
    assert len(scanner.automaton.places) == sum(len(w) for _, w in scanner.base + scanner.templates)
    many = " ".join([licenses.TEMPLATES["mit"][-1]] * 200)
    assert sum(s[2] == "mit" for s in scanner.scan(many)["spans"]) >= 200


def test_base_places_overlap_and_templates_survive_edits():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)
    text = "CC BY cc by general public License all all rights reserved"
    assert scanner.scan(text)["base"] == brute_base(text)
    notice = licenses.NOTICES["mit"][1].split()
    edited = " ".join([*notice[:9], "whatsoever", *notice[9:18], "and", "so", *notice[18:]])
    spans = scanner.scan("foo bar " + edited + " baz")["spans"]
    assert {s[2] for s in spans} == {"mit"} and spans[0][:2] == (2, 2 + len(notice) + 3)
    assert scanner.scan(" ".join(notice[:12]))["spans"] == []
