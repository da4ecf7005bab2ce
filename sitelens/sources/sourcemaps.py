"""Source maps: decoded mappings, bytes by source, position lookups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.ranges import as_of, merge_adjacent

_DIGITS = {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
#: Rows of a batch of decoded mappings, and characters of mappings that are decoded at once, about.
BATCH_ROWS, BATCH_CHARACTERS = 50_000, 1 << 20
_COMMA, _LINE, _MAP, _NONE, _LONGEST = 64, 65, 66, 255, 12
_CODES = np.full(256, _NONE, np.uint8)
for _c, _k in (*_DIGITS.items(), (",", _COMMA), (";", _LINE), ("|", _MAP)):
    _CODES[ord(_c)] = _k
_LETTERS = np.frombuffer("".join(_DIGITS).encode(), np.uint8)
#: Bytes of maps' texts that are written at once, at most, unless one map has more.
MOST_TEXT = 1 << 26
MAPPINGS = "map_id string, gen_line long, gen_column long, source string, orig_line long, orig_column long, name string"


def vlq(segment: str) -> list[int]:
    """The signed numbers of one mapping segment."""
    out, value, shift = [], 0, 0
    for c in segment:
        digit = _DIGITS[c]
        value |= (digit & 31) << shift
        if digit & 32:
            shift += 5
        else:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return out


def _rows(map_id: str, one: dict, line0: int = 0, column0: int = 0) -> Iterator[tuple]:
    for section in one.get("sections") or []:
        at = section.get("offset", {})
        yield from _rows(map_id, section.get("map", {}), line0 + at.get("line", 0), at.get("column", 0) + (column0 if not at.get("line") else 0))
    sources, names, root = one.get("sources") or [], one.get("names") or [], one.get("sourceRoot") or ""
    source = line = column = name = 0
    for k, text in enumerate((one.get("mappings") or "").split(";")):
        gen = column0 if k == 0 else 0
        for segment in filter(None, text.split(",")):
            n = vlq(segment)
            gen += n[0]
            if len(n) < 4:
                yield map_id, line0 + k + 1, gen, None, None, None, None
                continue
            source, line, column = source + n[1], line + n[2], column + n[3]
            name += n[4] if len(n) > 4 else 0
            where = f"{root.rstrip('/')}/{sources[source]}" if root else sources[source]
            yield map_id, line0 + k + 1, gen, where, line + 1, column, names[name] if len(n) > 4 and name < len(names) else None


def _plain_map(text: str) -> tuple[str, list[str], list[str]] | None:
    """(mappings, sources, names) of a map without sections whose lists hold strings; else null."""
    one = json.loads(text)
    sources, names, root, coded = one.get("sources") or [], one.get("names") or [], one.get("sourceRoot") or "", one.get("mappings") or ""
    if one.get("sections") or not (isinstance(coded, str) and coded.isascii() and "|" not in coded and isinstance(root, str) and isinstance(sources, list) and isinstance(names, list)):
        return None
    if any(not isinstance(x, str) for x in (*sources, *names)):
        return None
    return coded, [f"{root.rstrip('/')}/{x}" for x in sources] if root else sources, names


def _since(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each place of ``first``, of which 0 is one."""
    total = np.cumsum(values)
    before = total[first] - values[first]
    return total - np.repeat(before, np.diff(np.append(first, len(values))))


def _decoded(keys: list, maps: list[tuple[str, list[str], list[str]]]) -> tuple[pa.RecordBatch | None, list[int]]:
    """The mappings of plain maps, decoded together, and which of the maps are odd: these have to be read one by one and have no rows here."""
    code = _CODES[np.frombuffer("".join(f"{m[0]}|" for m in maps).encode(), np.uint8)]
    digit = code < _COMMA
    which = np.cumsum(code == _MAP) - (code == _MAP)
    more = digit & (code & 32 > 0)
    odd = set(np.unique(which[(code == _NONE) | (more & ~np.append(digit[1:], False))]).tolist())  # no digit, or a number that isn't closed
    if not odd:
        at = np.flatnonzero(digit)
        if not len(at):
            return None, []
        d = code[at]
        first = np.flatnonzero(np.append(True, d[:-1] < 32))  # where numbers begin among the digits
        lengths = np.diff(np.append(first, len(d)))
        odd = set(np.unique(which[at[first[lengths > _LONGEST]]]).tolist())
    if not odd:
        value = np.add.reduceat((d & 31).astype(np.int64) << (5 * (np.arange(len(d)) - np.repeat(first, lengths))), first)
        value = np.where(value & 1, -(value >> 1), value >> 1)
        place = at[first]
        part = np.cumsum(~digit)[place]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))  # where segments begin among the numbers
        count, place = np.diff(np.append(begin, len(part))), place[begin]
        field = lambda k, least: np.where(count >= least, value[np.minimum(begin + k, len(value) - 1)], 0)
        which, lines = which[place], np.cumsum(code == _LINE)
        ends = np.append(0, lines[code == _MAP])  # line ends up to each map
        line = lines[place] - ends[which]
        by_map = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        by_line = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (line[1:] != line[:-1])))
        column, source = _since(value[begin], by_line), _since(field(1, 4), by_map)
        row, across, name = _since(field(2, 4), by_map) + 1, _since(field(3, 4), by_map), _since(field(4, 5), by_map)
        known, named = count >= 4, count >= 5
        listed = lambda k: np.array([len(m[k]) for m in maps])
        n_sources, n_names = listed(1), listed(2)
        odd = set(np.unique(which[known & ((source < 0) | (source >= n_sources[which])) | named & (name < 0)]).tolist())
    if odd:
        rest = [k for k in range(len(maps)) if k not in odd]
        batch, others = _decoded([keys[k] for k in rest], [maps[k] for k in rest]) if rest else (None, [])
        return batch, sorted([*odd, *(rest[k] for k in others)])
    named &= name < n_names[which]
    texts = lambda k, n, at, there: pa.array([x for m in maps for x in m[k]], pa.string()).take(pa.array((np.cumsum(n) - n)[which] + at, pa.int64(), mask=~there))
    numbers = lambda values, there: pa.array(values, pa.int64(), mask=~there)
    columns = [pa.array(keys, pa.string()).take(pa.array(which)), pa.array(line + 1), pa.array(column), texts(1, n_sources, source, known), numbers(row, known), numbers(across, known), texts(2, n_names, name, named)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MAPPINGS.split(", ")]), []


def mappings(maps: DataFrame, map_id: str = "map_id", content: str = "content") -> DataFrame:
    """All mappings of a table of map texts: lines from 1, columns from 0. Broken maps give no rows.

    The mappings of many maps are decoded together, as arrays; maps with sections, and odd ones, one by one.
    """
    kinds = {n: pa.string() if t == "string" else pa.int64() for n, t in (c.split() for c in MAPPINGS.split(", "))}

    def pieces(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows if batch else 0, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)

    def single(key: str, text: str) -> Iterator[pa.RecordBatch]:
        try:
            found = list(_rows(key, json.loads(text)))  # whole, since a broken map has no rows
            found = found and pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds.values())], names=list(kinds))
        except (TypeError, ValueError, KeyError, IndexError, AttributeError, OverflowError):
            return
        if found:
            yield from pieces(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, texts, size = [], [], [], 0

        def given() -> Iterator[pa.RecordBatch]:
            batch, odd = _decoded(keys, held) if held else (None, [])
            yield from pieces(batch)
            for k in odd:
                yield from single(keys[k], texts[k])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    plain = _plain_map(text)
                except (TypeError, ValueError, AttributeError):
                    continue
                if plain is None:
                    yield from single(key, text)
                    continue
                keys.append(key)
                held.append(plain)
                texts.append(text)
                size += len(plain[0])
                if size >= BATCH_CHARACTERS:
                    yield from given()
                    keys, held, texts, size = [], [], [], 0
        yield from given()

    return maps.select(F.col(map_id).cast("string").alias("map_id"), F.col(content).alias("content")).mapInArrow(run, MAPPINGS)


def original_files(maps: DataFrame, map_id: str = "map_id", content: str = "content") -> DataFrame:
    """(map_id, source, text, size, missing_content) of each source a map lists."""
    parsed = maps.select(F.col(map_id).cast("string").alias("map_id"), F.from_json(content, "sources array<string>, sourcesContent array<string>").alias("m"))
    each = parsed.select("map_id", F.posexplode("m.sources").alias("at", "source"), F.col("m.sourcesContent").alias("texts"))
    text = F.get("texts", F.col("at"))
    return each.select("map_id", "source", text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), text.isNull().alias("missing_content"))


def spans(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Mappings with the end of their column span: the next mapping's start, or the line's length.

    lines: (map_id, gen_line, line_length).
    """
    order = Window.partitionBy("map_id", "gen_line").orderBy("gen_column")
    # A map's rows are many times its text, so no side of these joins is to be broadcast by the text's size.
    joined = found.join(lines.hint("merge"), ["map_id", "gen_line"])
    return joined.withColumn("gen_end", F.coalesce(F.lead("gen_column").over(order), F.col("line_length")) - 1).filter("gen_end >= gen_column")


def bundle_lines(bundles: DataFrame, map_id: str = "map_id", code: str = "code") -> DataFrame:
    """(map_id, gen_line, line, line_length) of generated files."""
    each = bundles.select(F.col(map_id).cast("string").alias("map_id"), F.posexplode(F.split(code, r"\r?\n", -1)).alias("at", "line"))
    return each.select("map_id", (F.col("at") + 1).cast("long").alias("gen_line"), "line", F.length("line").cast("long").alias("line_length"))


def bytes_by_source(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(map_id, source, bytes): UTF-8 bytes of each bundle by original source; null: no source."""
    merged = merge_adjacent(spans(found, lines.drop("line")), ["map_id", "gen_line", "source"], "gen_column", "gen_end")
    text = F.expr("substring(line, cast(gen_column as int) + 1, cast(gen_end - gen_column as int) + 1)")
    joined = merged.join(lines.select("map_id", "gen_line", "line").hint("merge"), ["map_id", "gen_line"])
    return joined.groupBy("map_id", "source").agg(F.sum(F.octet_length(text)).alias("bytes"))


def bundle_breakdown(found: DataFrame, bundles: DataFrame, map_id: str = "map_id", code: str = "code") -> DataFrame:
    """Bytes of each source and, as ``kind``, what is no source's: line ends and the unmapped rest."""
    lines = bundle_lines(bundles, map_id, code)
    by_source = bytes_by_source(found, lines).select("map_id", F.lit("source").alias("kind"), F.coalesce("source", F.lit("[no source]")).alias("path"), "bytes")
    total = bundles.select(F.col(map_id).cast("string").alias("map_id"), F.octet_length(code).alias("total"), (F.octet_length(code) - F.octet_length(F.regexp_replace(code, "[\r\n]", ""))).alias("eol"))
    mapped = by_source.groupBy("map_id").agg(F.sum("bytes").alias("mapped"))
    rest = total.join(mapped.hint("merge"), "map_id", "left").withColumn("rest", F.greatest(F.col("total") - F.coalesce("mapped", F.lit(0)) - F.col("eol"), F.lit(0)))
    ends = rest.select("map_id", F.lit("eol").alias("kind"), F.lit("[EOL]").alias("path"), F.col("eol").cast("long").alias("bytes"))
    open_ = rest.select("map_id", F.lit("unmapped").alias("kind"), F.lit("[unmapped]").alias("path"), F.col("rest").cast("long").alias("bytes"))
    return by_source.unionByName(ends).unionByName(open_).filter("bytes > 0")


def lookup_generated(found: DataFrame, asks: DataFrame) -> DataFrame:
    """The original position of each generated one: the last mapping at or before it on its line.

    asks: (ask_id, map_id, gen_line, gen_column). Without a mapping there is found = false.
    """
    right = found.select("map_id", "gen_line", "gen_column", "source", "orig_line", "orig_column", "name")
    out = as_of(asks, right, ["map_id", "gen_line"], "gen_column", ["source", "orig_line", "orig_column", "name"])
    return out.withColumn("found", F.col("source").isNotNull())


def lookup_original(found: DataFrame, asks: DataFrame) -> DataFrame:
    """All generated positions of each original one: (ask_id, matches), sorted, empty if there is none.

    asks: (ask_id, map_id, source, orig_line, orig_column).
    """
    keys = ["map_id", "source", "orig_line", "orig_column"]
    places = found.select(*keys, F.struct("gen_line", "gen_column").alias("place"))
    met = asks.join(places.hint("merge"), keys, "left")  # a map's rows are many times its text, so they aren't to be broadcast
    return met.groupBy("ask_id").agg(F.array_sort(F.collect_set("place")).alias("matches"))


def name_counts(maps: DataFrame, map_id: str = "map_id", content: str = "content") -> DataFrame:
    """(map_id, names): how many names a map lists, its sections' included."""
    shape = "names array<string>, sections array<struct<map: struct<names: array<string>>>>"
    parsed = maps.select(F.col(map_id).cast("string").alias("map_id"), F.from_json(content, shape).alias("m"))
    inner = F.aggregate(F.coalesce("m.sections", F.array().cast("array<struct<map: struct<names: array<string>>>>")), F.lit(0), lambda a, s: a + F.coalesce(F.size(s["map"]["names"]), F.lit(0)))
    return parsed.select("map_id", (F.greatest(F.coalesce(F.size("m.names"), F.lit(0)), F.lit(0)) + inner).cast("long").alias("names"))


def encoded_vlq(number: Column) -> Column:
    """A signed number as the digits of a mapping segment, the lowest five bits first."""
    value = F.when(number < 0, -2 * number + 1).otherwise(2 * number).cast("long")
    count = F.ceil(F.length(F.bin(value)) / 5).cast("int")

    def digit(k: Column) -> Column:
        bits = F.call_function("shiftright", value, 5 * k).bitwiseAND(F.lit(31)) + F.when(k < count - 1, 32).otherwise(0)
        return F.substring(F.lit("".join(_DIGITS)), bits.cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), digit), "")


def _numbered(values: pa.Array, maps: int, which: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The number of each row's value among the distinct ones of its map, from 0 by first place and value (none: -1), and the values of each map."""
    coded = values.dictionary_encode()
    words, by_rank = coded.dictionary, pc.sort_indices(coded.dictionary).to_numpy()
    at = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
    rank = np.argsort(by_rank)[coded.indices.drop_null().to_numpy()]
    at, rank = (x[np.lexsort((rank, *(p[at] for p in reversed(place)), which[at]))] for x in (at, rank))
    pairs, first, inverse = np.unique(which[at] * max(1, len(words)) + rank, return_index=True, return_inverse=True)
    order = np.argsort(first)
    of, rank = np.divmod(pairs[order], max(1, len(words)))
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=maps)))
    number, out = np.empty(len(pairs), np.int64), np.full(len(values), -1)
    number[order] = np.arange(len(pairs)) - ends[of]
    out[at] = number[inverse]
    return out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(by_rank[rank])))


def _changes(values: np.ndarray, there: np.ndarray, groups: np.ndarray, first: int) -> np.ndarray:
    """What is added to the value before it in its group, or to ``first``, where there is a value; else 0."""
    at = np.flatnonzero(there)
    value, out = values[at], np.zeros(len(values), np.int64)
    before = np.where(np.diff(groups[at], prepend=-1) != 0, first, np.append(first, value)[:-1])
    if (np.abs(value.astype(float) - before) >= 2.0**62).any():
        raise OverflowError("mappings lie too far apart for a map's text")
    out[at] = value - before
    return out


def _written(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(map_id, sources, names, mappings) of mappings of whole maps, which lie together, written at once."""
    ids = rows.column(0).dictionary_encode(null_encoding="encode")
    which, maps = ids.indices.to_numpy().astype(np.int64), len(ids.dictionary)
    number = lambda k, none=0: pc.fill_null(rows.column(k), none).to_numpy()
    there = lambda k: rows.column(k).is_valid().to_numpy(zero_copy_only=False)
    line, column, sourced = number(1), number(2), there(3)
    (source, sources), (name, names) = (_numbered(rows.column(k), maps, which, line, column) for k in (3, 6))
    name = np.where(sourced, name, -1)
    least = np.iinfo(np.int64).min  # nulls come first
    order = np.lexsort((name, number(5, least), number(4, least), source, column, line, which))
    given = np.column_stack((np.full(len(order), True), sourced, sourced & there(4), sourced & there(5), name >= 0))[order]
    which, line = which[order], line[order]
    fresh, lower = np.diff(which, prepend=-1) != 0, np.diff(line, prepend=0)
    same = ~fresh & (lower == 0)
    groups = (np.cumsum(~same), which, which, which, which)
    changes = [_changes(v[order], given[:, k], groups[k], int(k == 2)) for k, v in enumerate((column, source, number(4), number(5), name))]
    value = np.column_stack([np.where(c < 0, 1 - 2 * c, 2 * c) for c in changes])
    digits, rest = given.astype(np.int64), value >> 5
    while rest.any():
        digits += rest > 0
        rest >>= 5
    marks = np.where(same, 1, np.maximum(np.where(fresh, line - 1, lower), 0))
    widths = np.column_stack((marks, digits))
    ends = np.cumsum(widths).reshape(widths.shape)
    if ends[-1, -1] > MOST_TEXT and maps > 1:
        half = int(np.searchsorted(which, maps // 2))
        for part in (rows.slice(0, half), rows.slice(half)):
            yield from _written(part)
        return
    text, begin = np.full(ends[-1, -1], ord(";"), np.uint8), ends - widths
    text[begin[same, 0]] = ord(",")
    at, left, value = begin[:, 1:][given], digits[given], value[given]
    while len(at):
        more = left > 1
        text[at] = _LETTERS[(value & 31) + 32 * more]
        at, left, value = at[more] + 1, left[more] - 1, value[more] >> 5
    bounds = np.append(0, ends[np.append(fresh[1:], True), -1]).astype(np.int32)
    mapped = pa.StringArray.from_buffers(maps, pa.py_buffer(bounds), pa.py_buffer(text))
    yield pa.RecordBatch.from_arrays([ids.dictionary, sources, names, mapped], names=["map_id", "sources", "names", "mappings"])


def encoded_maps(found: DataFrame, dealt: bool = False) -> DataFrame:
    """(map_id, content): map texts that hold the given mappings, the inverse of ``mappings``.

    Deltas go over a map's mappings in order of line and column. Mappings without a source
    are bare columns, those without a line or column aren't any; sources and names are listed
    by first place; lines without mappings are empty ones. A map without rows has no text; a
    null map_id is one. The maps are dealt to tasks by one shuffle, unless ``dealt`` says
    that each map's rows are in one partition, and many are written together, as arrays; a map
    is held whole, as its text is.
    """
    columns = [c.split() for c in MAPPINGS.split(", ")]
    rows = found.select(*[F.col(n).cast(t).alias(n) for n, t in columns]).filter("gen_line is not null and gen_column is not null")

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in held]) for k in range(len(columns))], names=[n for n, _ in columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # the last map of what is held may go on
        for batch in filter(len, batches):
            ids = batch.column(0)
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            last = int(np.searchsorted(codes, codes[-1]))  # where the batch's last map begins
            goes_on = last == 0 and held and held[-1].column(0)[-1].as_py() == ids[0].as_py()
            if size + last >= BATCH_ROWS and not goes_on:
                yield from whole([*held, batch.slice(0, last)])
                held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += len(batch)
        if held:
            yield from whole(held)

    rows = (rows if dealt else rows.repartition("map_id")).sortWithinPartitions("map_id")
    texts = rows.mapInArrow(run, "map_id string, sources array<string>, names array<string>, mappings string")
    content = F.struct(F.lit(3).alias("version"), "sources", "names", "mappings")
    return texts.select(F.col("map_id").cast(found.schema["map_id"].dataType).alias("map_id"), F.to_json(content).alias("content"))


def line_mappings(files: DataFrame) -> DataFrame:
    """MAPPINGS of transformed files, line to line: files has map_id, path, original and transformed.

    An original of one line is where all lines come from; else each line comes from the
    original's line of its number, and those beyond its end from nowhere. Null texts are empty.
    """
    count = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1))
    lines = files.select(F.col("map_id").cast("string").alias("map_id"), F.col("path").alias("source"), count("original").alias("of"), F.explode(F.sequence(F.lit(1), count("transformed"))).alias("gen_line"))
    kept = lines.filter((F.col("of") == 1) | (F.col("gen_line") <= F.col("of")))
    line = F.when(F.col("of") == 1, 1).otherwise(F.col("gen_line"))
    return kept.select("map_id", F.col("gen_line").cast("long").alias("gen_line"), F.lit(0).cast("long").alias("gen_column"), "source", line.cast("long").alias("orig_line"), F.lit(0).cast("long").alias("orig_column"), F.lit(None).cast("string").alias("name"))
