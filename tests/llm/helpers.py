import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Null, empty, white space, ties, repeats, other scripts and one very long text.
ODD_TEXTS = [None, "", "  \n", "one", "one", "Two words", "A\tb\x0bc d", "É Ü ñ ß 😀 한국어 中文", "x" * 5000, "long text. " * 20000, "<|endoftext|> 's DON'T ½²³ İı k"]


def words(text):
    return WORD.findall((text or "").encode().lower())


def odd_documents(spark, schema="doc_id long, text string, lang string, source string, n_chars long, fp int, key string, words int"):
    rows = [(i if i % 4 else None, t, None, None, None, 1, "k", 2) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, "again", "en", "s", 5, None, None, None)] * 2
    return spark.createDataFrame(rows, schema)
