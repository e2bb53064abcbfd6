"""Text search: byte trigrams, postings, verified substring search, line grep, extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose trigrams are sorted at once.
RUN_BYTES = 2 << 20
#: Grams of a pattern that candidates are found with (the rarest).
PATTERN_GRAMS = 16


def folded(text: Column) -> Column:
    """A-Z as a-z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def grams(text: Column, ignore_case: bool = False) -> Column:
    """Distinct runs of three bytes in hex, in order of appearance; none for less than three bytes."""
    raw = F.encode(folded(text) if ignore_case else text, "UTF-8")

    def cut(b: Column) -> Column:
        # a lambda's variable is computed once; substring of bytes doesn't walk from the start
        return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b) - 2, F.lit(1))), lambda i: F.hex(F.substring(b, i, F.lit(3))))

    each = F.flatten(F.transform(F.array(raw), cut))
    return F.when(F.octet_length(text) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _gram_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distinct trigrams of a run of texts, as 24-bit numbers."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    wide = data.astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = (row[2:] << 24) | (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    code = np.unique(code[row[2:] == row[:-2]])
    return code >> 24, (code & 0xFFFFFF).astype(np.int32)


def postings(docs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """doc_id, gram: each document's distinct trigrams as 24-bit numbers; nothing is shuffled until they are grouped."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, where, raw = texts.buffers()
            offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            data = _LOWER[data] if ignore_case else data
            first = 0
            while first < len(texts):
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
                row, gram = _gram_numbers(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(gram)], ["doc_id", "gram"])
                first = end

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, gram int")


def gram_hex(gram: Column) -> Column:
    return F.lpad(F.hex(gram), 6, "0")


def frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("gram").agg(F.count("*").alias("documents"))


def pattern_grams(pattern: str, ignore_case: bool = False) -> list[str]:
    raw = "".join(c.lower() if ignore_case and c in _UPPER else c for c in pattern).encode()
    return list(dict.fromkeys(raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)))


def candidates(posted: DataFrame, docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """doc_id of documents that have all (up to the 16 rarest) trigrams of the pattern; all for a shorter pattern."""
    wanted = pattern_grams(pattern, ignore_case)
    if not wanted:
        return docs.select("doc_id")
    wanted = [int(g, 16) for g in wanted]
    mine = posted.where(F.col("gram").isin(wanted))
    if len(wanted) > PATTERN_GRAMS:
        counts = {r["gram"]: r["documents"] for r in frequencies(mine).collect()}  # a row for each gram of the pattern
        wanted = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:PATTERN_GRAMS]
        mine = mine.where(F.col("gram").isin(wanted))
    return mine.groupBy("doc_id").agg(F.count("*").alias("hits")).where(F.col("hits") == len(wanted)).select("doc_id")


def contains(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    if not pattern:
        return F.lit(False)
    return F.contains(folded(text), folded(F.lit(pattern))) if ignore_case else F.contains(text, F.lit(pattern))


def search(docs: DataFrame, pattern: str, ignore_case: bool = False, posted: DataFrame | None = None) -> DataFrame:
    """Documents that really contain the pattern; with an index, only its candidates are read closely."""
    if posted is not None:
        docs = docs.join(candidates(posted, docs, pattern, ignore_case), "doc_id", "left_semi")
    return docs.where(contains(F.col("text"), pattern, ignore_case))


def page(found: DataFrame, after: int | None, n: int) -> DataFrame:
    """The next n documents by doc_id after a place."""
    return (found if after is None else found.where(F.col("doc_id") > after)).orderBy("doc_id").limit(n)


def posting_lists(posted: DataFrame) -> DataFrame:
    """gram, doc_ids in order. Lists as long as the corpus belong in `postings`, one row each; this is for visiting."""
    return posted.groupBy("gram").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def index_stats(posted: DataFrame) -> DataFrame:
    by = frequencies(posted)
    return by.agg(F.count("*").alias("unique_grams"), F.sum("documents").alias("postings"), F.max("documents").alias("longest"))


def grep(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """doc_id, line_number (from 1), line of every line that has the pattern; a final CR is no part of a line."""
    lines = docs.where(contains(F.col("text"), pattern, ignore_case)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    clean = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_number"), F.regexp_replace("line", "\r$", "").alias("line"))
    return clean.where(contains(F.col("line"), pattern, ignore_case))


def grep_counts(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    return grep(docs, pattern, ignore_case).groupBy("doc_id").agg(F.count("*").alias("matches"))


def urls(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Addresses of 9 to 254 characters, in lower case, with their place among the row's."""
    found = F.regexp_extract_all(F.col(column), F.lit("(?i)(http[A-Za-z0-9./:_?-]*)"), F.lit(1))
    each = docs.select(key, F.posexplode(found).alias("place", "url"))
    return each.select(key, F.col("place").cast("long").alias("place"), F.lower("url").alias("url")).where(F.length("url").between(9, 254))


#: The signs of addresses, and how long artifacts and the parts of a context may be.
_MAIL, _WEB, _SECRET = rb"[A-Za-z0-9._+-]", rb"[A-Za-z0-9./:_?-]", rb"[\x21-\x7b\x7d\x7e]"
ARTIFACT_BYTES, CONTEXT_BYTES = 127, 255
_START, _RUN, _URL, _PASSWORD = re.compile(rb"@|http", re.I), re.compile(_MAIL + b"+"), re.compile(_WEB + b"+"), re.compile(b"[:|;](" + _SECRET.replace(b"\\x21-", b"\\x21-:<-") + b"+)")


def artifacts_of(raw: bytes) -> list[tuple[str, int, str]]:
    """Kind, byte offset and value of mail addresses, passwords that follow them after one of `:|;`, and web addresses, left to right."""
    out, at = [], 0
    while found := _START.search(raw, at):
        i = at = found.start()
        if raw[i] == 0x40:
            start = i
            while start and _RUN.match(raw, start - 1, start):
                start -= 1
            host = _RUN.match(raw, i + 1)
            if start < i and host and b"." in host[0] and 5 < host.end() - start < 255:
                out.append(("email", start, raw[start : host.end()].decode("ascii").lower()))
                at, secret = host.end(), _PASSWORD.match(raw, host.end())
                if secret and len(secret[1]) < 255:
                    out.append(("password", secret.start(1), secret[1].decode("ascii")))
                    at = secret.end()
                continue
        else:
            url = _URL.match(raw, i)
            if 8 < len(url[0]) < 255:
                out.append(("url", i, url[0].decode("ascii").lower()))
                at = url.end()
                continue
        at += 1
    return out


def artifacts(docs: DataFrame) -> DataFrame:
    """doc_id, kind, byte_offset, value of all artifacts of the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *a) for i, t in enumerate(batch.column(1).to_pylist()) if t for a in artifacts_of(t)]
            own = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "kind", "byte_offset", "value"])

    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, f"doc_id {kind}, kind string, byte_offset long, value string")


def model_context(raw: Column, at: Column, length: Column) -> Column:
    """struct(artifact, pre, post, is_truncated): an artifact of the bytes (from place 0) and what stands before and after it, printable ASCII; null if it isn't inside."""
    size = F.octet_length(raw)

    def clean(part: Column) -> Column:
        return F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", " ")

    before = F.least(at, F.lit(CONTEXT_BYTES))
    after = F.when(length > size - at, F.lit(0)).otherwise(F.least(size - at - length, F.lit(CONTEXT_BYTES)))
    return F.when(
        at < size,
        F.struct(
            clean(F.substring(raw, at + 1, F.least(length, F.lit(ARTIFACT_BYTES)))).alias("artifact"),
            clean(F.substring(raw, at - before + 1, before)).alias("pre"),
            clean(F.substring(raw, at + length + 1, after)).alias("post"),
            ((at <= CONTEXT_BYTES) | (after < CONTEXT_BYTES)).alias("is_truncated"),
        ),
    )


def context(text: Column, at: Column, back: int = 100, ahead: int = 200) -> Column:
    """What stands around a place (from 1), within its line, other than printable ASCII blanked."""
    start = F.greatest(at - back, F.lit(1))
    before = F.element_at(F.split(F.substring(text, start, at - start), "\n"), -1)
    after = F.element_at(F.split(F.substring(text, at, F.lit(ahead)), "\n"), 1)
    return F.regexp_replace(F.concat(before, after), r"[^\x20-\x7e]", " ")


def searchable(resource: Column, kind: Column, *parts: Column) -> Column:
    """One searchable text of a record's parts; missing ones are left out."""
    return F.concat_ws(" ", resource, kind, *parts)


def artifact_id(given: Column, path: Column) -> Column:
    """The id, or the last part of the path."""
    return F.coalesce(given, F.element_at(F.split(path, "/"), -1))


def authorised(projection: DataFrame, query: str, predicate: Column, generation: int, tombstones: bool = False) -> DataFrame:
    """Rows that may be seen and have the query literally (ASCII case ignored), marked stale below the generation."""
    rows = projection.where(predicate & contains(F.col("searchable_text"), query, True))
    rows = rows if tombstones else rows.where(~F.col("tombstone"))
    return rows.withColumn("is_stale", F.col("generation") < generation)
