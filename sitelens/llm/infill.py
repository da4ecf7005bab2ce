"""Fill-in-the-middle rows by escaped marker injection, in DataFrame operations only.

A delimiter that the text may hold is escaped first; one regexp_replace then appends it
to every unit (a run of letters or any other single character), so that the number of
delimiters is the number of units and substring_index cuts after the unit of any rank.
The parts lose their delimiters, are unescaped, and are put together with the markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DELIMITER, ESCAPE = "\x01", "\x02"
#: What follows the escape mark in the place of each of the two.
DELIMITER_CODE, ESCAPE_CODE = "1", "0"
#: Units of an escaped text: a run of letters, an escaped character, any other character.
UNITS = f"[A-Za-z]++|{ESCAPE}[{ESCAPE_CODE}{DELIMITER_CODE}]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut, and of a hundred cut ones so many go suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20


def escaped(text: Column) -> Column:
    """A text without the delimiter; the escape mark is followed by a code wherever it stands."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_CODE))
    return F.replace(text, F.lit(DELIMITER), F.lit(ESCAPE + DELIMITER_CODE))


def unescaped(marked: Column) -> Column:
    """The text of a stretch of units: delimiters go, then codes are put back."""
    text = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    text = F.replace(text, F.lit(ESCAPE + DELIMITER_CODE), F.lit(DELIMITER))
    return F.replace(text, F.lit(ESCAPE + ESCAPE_CODE), F.lit(ESCAPE))


def _draw(digest: Column, k: int) -> Column:
    """The k-th group (from 0) of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _before(marked: Column, rank: Column) -> Column:
    """What stands before the delimiter of that rank: the first units, but for the last one's delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), rank.cast("int"))


def infilled(docs: DataFrame, seed: str = "1", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output for every row of docs.

    ``n`` counts units. ``form`` is plain (output is the text), psm or spm; the cuts and the
    form are drawn from the digest of seed, a colon and the id, so rows with equal ids and
    texts have equal results. Null texts are empty ones, and a null id draws as an empty
    one; empty texts and texts that hold a marker are plain. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("safe", escaped(F.col("text")))
    rows = rows.withColumn("marked", F.regexp_replace("safe", UNITS, f"$0{DELIMITER}"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("n", (F.length("marked") - F.length("safe")).cast("long")).drop("safe")
    rows = rows.withColumn("draws", F.sha2(name, 256))
    one, other = (F.pmod(_draw(F.col("draws"), k), F.col("n") + 1) for k in (0, 1))
    reserved = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    whole = (F.col("n") == 0) | reserved | (_draw(F.col("draws"), 2) % 100 >= CUT_SHARE)
    suffix_first = _draw(F.col("draws"), 3) % 100 < SUFFIX_FIRST_SHARE
    form = F.when(whole, "plain").when(suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(one, other).alias("from"), F.greatest(one, other).alias("to"))
    cut = F.col("form") != "plain"
    rows = rows.withColumn("first", F.when(cut, _before(F.col("marked"), F.col("from"))))
    rows = rows.withColumn("until", F.when(cut, _before(F.col("marked"), F.col("to"))))
    rest = lambda whole, part: F.substring(whole, F.length(part) + 1, F.length(whole))
    rows = rows.select(
        "doc_id", "text", "n", "form", unescaped(F.col("first")).alias("prefix"),
        unescaped(rest(F.col("until"), F.col("first"))).alias("middle"), unescaped(rest(F.col("marked"), F.col("until"))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    chars = lambda part: F.length(part).cast("long").alias(f"{part}_chars")
    return rows.select("doc_id", "text", "n", "form", chars("prefix"), chars("middle"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No part holds a marker, and none can begin in one part and end in another's marker, so
    each marker is where it is found first.
    """
    body = F.substring(output, len(PREFIX) + 1, F.length(output))
    first, rest = F.substring_index(body, SUFFIX, 1), F.substring_index(body, SUFFIX, -1)
    psm = F.concat(first, F.substring_index(rest, MIDDLE, -1), F.substring_index(rest, MIDDLE, 1))
    first, rest = F.substring_index(body, PREFIX, 1), F.substring_index(body, PREFIX, -1)
    spm = F.concat(F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1), first)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; the text is rebuilt from output and form alone."""
    found = infilled(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The contract over lists of units; that the text comes back whole is told by its own digest.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
   WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
 p AS (SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(u[1:lo], '') END AS a,
  CASE WHEN form <> 'plain' THEN array_to_string(u[lo + 1:hi], '') END AS b, CASE WHEN form <> 'plain' THEN array_to_string(u[hi + 1:n], '') END AS z FROM c)
SELECT doc_id, n, form, length(a) AS prefix_chars, length(b) AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE text END) AS output_sha256,
 sha256(text) AS restored_sha256
FROM p
"""
