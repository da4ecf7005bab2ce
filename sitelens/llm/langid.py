"""Language of pages by fusing evidence as Bayes has it.

log P(lang | page) = tempered text likelihood + log P(declared | lang)
                     + log P(address | lang) + log P(lang | host) + const

Text likelihoods are hashed letter trigrams learnt from a bounded sample of texts with
a known language. The others are counted over all pages, weighted by what the text alone
says: how often a declared markup language and an address suffix go with each language,
and each host's mix of languages, smoothed towards its domain's, which is smoothed
towards the mix of all pages. A page's own share is taken out of its host's and its
domain's counts first, so no page votes for itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fits, hash_sample, table
from .wrappers import host_of, main_text

#: Hash buckets of trigrams, the same for any number of languages; a language takes four bytes a bucket.
BUCKETS = 1 << 15
#: The bound of the training sample: different texts of each language, by hash order.
MAX_PER_LANGUAGE = 1_500
SAMPLE_PARTS = 12
#: Up to so many sampled hashes are broadcast (a few dozen bytes each).
MOST_CHOSEN = 500_000
#: A text counts as at most so many independent trigrams.
EVIDENCE = 40.0
#: Pseudo-counts of the parent level, and of each kind of evidence.
HOST_PRIOR, DOMAIN_PRIOR, EVIDENCE_PRIOR = 5.0, 20.0, 1.0

_OTHER = re.compile(r"[\W\d_]+")


def trigrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed letter trigrams of a whole text, words padded by one space."""
    line = " " + _OTHER.sub(" ", (text or "").lower()).strip() + " "
    if len(line) < 3:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(buckets)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)); without labelled texts there is one language, ``und``.

    A language is the primary subtag, two or three letters, of what the lang column says;
    other values name none, so there are at most 26^2 + 26^3. Null texts and labels take no
    part. Copies of a text count once; of texts that share a hash, the least one counts.
    ``buckets`` bounds the model: with many languages, fewer of them keep it small.
    """
    tag = F.regexp_extract(F.lower(F.col(lang)), r"^([a-z]{2,3})(?:[-_].*)?\z", 1)
    named = docs.select(F.col(text).alias("text"), tag.alias("lang")).filter("lang != '' and text is not null").withColumn("h", F.xxhash64("text"))
    chosen = durable(hash_sample(named.select("lang", "h").distinct(), "lang", "h", MAX_PER_LANGUAGE))
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not languages:
        return ["und"], np.zeros((1, buckets), dtype=np.float32)
    counts = np.full((len(languages), buckets), 0.1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for rows in batches:
            for one, t in zip(rows["lang"], rows["text"]):
                found[one] = found.get(one, 0) + np.bincount(trigrams(t, buckets), minlength=buckets)
        yield pd.DataFrame({"lang": list(found), "n": [x.astype("<i8").tobytes() for x in found.values()]}, columns=["lang", "n"])

    texts = named.join(F.broadcast(chosen) if fits(chosen, MOST_CHOSEN) else chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    for row in texts.select("lang", "text").repartition(SAMPLE_PARTS).mapInPandas(count, "lang string, n binary").toLocalIterator():
        counts[languages.index(row.lang)] += np.frombuffer(row.n, dtype="<i8")
    return languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def with_text_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], html: str = "html") -> DataFrame:
    """Add logp, the tempered log likelihood of each language for the page's main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model[1])

    @F.pandas_udf("array<double>")
    def likelihood(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table_ = shared.value
        for values in parts:
            out = []
            for page in values:
                at = trigrams(main_text(page), table_.shape[1])
                total = table_[:, at].sum(1, dtype=np.float64) if len(at) else np.zeros(len(table_))
                total *= min(1.0, EVIDENCE / max(1, len(at)))
                out.append(total - total.max())
            yield pd.Series(out, dtype="object")

    return pages.withColumn("logp", likelihood(F.col(html)))


def declared_language(html: Column) -> Column:
    """Primary subtag of the root element's lang attribute; empty if there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    return F.lower(found)


def address_suffix(url: Column) -> Column:
    """Last label of the host, and a leading path segment of two letters, which often names a language."""
    tail = F.regexp_extract(host_of(url), r"([^.]+)\z", 1)
    segment = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:[/?#]|\z)", 1))
    return F.concat_ws("/", tail, segment)


def domain_of(host: Column) -> Column:
    """The host's last two labels."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)\z", 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _shares(raised: Column) -> Column:
    return F.transform(raised, lambda x: x / _total(raised))


def _numbers(values: np.ndarray) -> Column:
    """An array of numbers as one literal, however many there are."""
    return F.from_json(F.lit(json.dumps([float(x) for x in values])), "array<double>")


def _mass(rows: DataFrame, key: str, shares: str) -> DataFrame:
    """(key, mass): the element-wise sums of arrays, by key.

    Elements are summed by key and place, so that the plan is the same for any number of
    languages and a key with most of the rows is reduced before it is shuffled.
    """
    each = rows.select(key, F.posexplode(shares).alias("at", "x")).groupBy(key, "at").agg(F.sum("x").alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("at", "x")))
    return each.groupBy(key).agg(F.transform(listed, lambda e: e["x"]).alias("mass"))


def with_language(pages: DataFrame, model: tuple[list[str], np.ndarray], html: str = "html", url: str = "url") -> DataFrame:
    """Add declared, address, text_language, language and probability, in place of columns
    that have these names; the html column is left out, all other columns and rows stay,
    whatever their names.

    Null and empty pages have no text evidence and go by the other kinds; null addresses
    share one empty host. Ties go to the first language by name.
    """
    languages, _ = model
    made = ("declared", "address", "text_language", "language", "probability")
    keep = [c for c in pages.columns if c != html and c not in made]
    # The page's own columns travel as one, so that no name can meet another.
    own = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    base = pages.select(own.alias("own"), F.col(html).alias("html"), F.col(url).alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "declared": declared_language(F.col("html")), "address": address_suffix(F.col("url"))})
    # Only these few columns are counted and joined, pages themselves don't move for it.
    seen = with_text_evidence(base, model).drop("html", "url")
    seen = seen.withColumn("raised", F.transform("logp", lambda x: F.exp(x - F.array_max("logp"))))
    seen = durable(seen.withColumn("p", _shares(F.col("raised"))).drop("raised"))
    hosts = durable(_mass(seen, "host", "p").withColumn("domain", domain_of(F.col("host"))))
    domains = _mass(hosts, "domain", "mass").withColumnRenamed("mass", "domain_mass")
    total = np.ones(len(languages))
    for r in hosts.select(F.posexplode("mass").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[r.at] += r.x
    world = _numbers(total / total.sum())

    def given(column: str) -> DataFrame:
        """log P(value | language), smoothed over the values."""
        counts = durable(_mass(seen, column, "p"))
        below = _numbers(total + EVIDENCE_PRIOR * (counts.count() + 1))
        log = F.zip_with("mass", below, lambda x, b: F.log((x + EVIDENCE_PRIOR) / b))
        return counts.select(F.col(column).alias(f"{column}_key"), log.alias(f"{column}_log"))

    rest = lambda mass: F.greatest(_total(F.col(mass)) - 1, F.lit(0.0))
    priors = hosts.join(domains, "domain").select(F.col("host").alias("host_key"), F.col("mass").alias("host_mass"), "domain_mass")
    priors = priors.withColumns({"host_rest": rest("host_mass"), "domain_rest": rest("domain_mass")})
    out = seen.join(priors, F.col("host") == F.col("host_key"))
    for c in ("declared", "address"):
        out = out.join(given(c), F.col(c) == F.col(f"{c}_key"))
    without = lambda mass: F.zip_with(F.col(mass), F.col("p"), lambda m, x: F.greatest(m - x, F.lit(0.0)))
    mixed = lambda counts, parent, prior, n: F.zip_with(counts, parent, lambda m, q: (m + prior * q) / (n + prior))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = out.withColumn("domain_mix", mixed(without("domain_mass"), world, DOMAIN_PRIOR, F.col("domain_rest")))
    out = out.withColumn("host_mix", mixed(without("host_mass"), F.col("domain_mix"), HOST_PRIOR, F.col("host_rest")))
    known = plus(plus(F.col("logp"), F.col("declared_log")), F.col("address_log"))
    out = out.withColumn("logs", plus(known, F.transform("host_mix", lambda x: F.log(x + 1e-9))))
    out = out.withColumn("raised", F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))).withColumn("post", _shares(F.col("raised")))
    best = lambda p: F.element_at(F.from_json(F.lit(json.dumps(languages)), "array<string>"), F.array_position(p, F.array_max(p)).cast("int"))
    return out.select(
        *([F.col("own")[c].alias(c) for c in keep]),
        "declared",
        "address",
        best(F.col("p")).alias("text_language"),
        best(F.col("post")).alias("language"),
        F.array_max("post").alias("probability"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and the evidence, language and probability of every page; see with_language."""
    model = train(table(spark, sf_dir, "documents"))
    return with_language(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
