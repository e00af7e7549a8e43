"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of the last two lines picks chunk ends: a line
ends a chunk where the hash is divisible by DIVISOR, so equal passages are cut
alike wherever they stand. Chunks of two lines or more that occur before, in
any document or earlier in their own, are removed once their bytes have been
compared with those of the first occurrence; order is by doc_id, then by text
and place. Where a digest is shared by other bytes, both stay.

Only digests and places are gathered for the whole corpus. Texts are moved for
the final join on the document, and for the byte comparison those of repeated
chunks. Counts are combined before the shuffle, so a passage that all documents
share is one row of each task.

Chunks leave parts of a repeated passage behind: chunks of one line, and what
stands before its first or after its last cut. `passage_dedup` has no such
rest. It compares the windows of LEAST_LINES lines that start at every line, by
the same digests, order and byte comparison, and removes all lines that lie in
a window which occurred before; so a passage goes whole wherever it starts.

Cases: a null text stays null with no lines; an empty text has one empty line;
rows with equal id and text count as one document and are treated alike; null
ids come first in order; an empty table gives no rows. The stage passes other
columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import documents, key_back, key_of, table, written

#: A line ends a chunk if its rolling hash is divisible by this; so chunks have about as many lines.
DIVISOR = 3
LEAST_LINES = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _with_chunks(docs: DataFrame) -> DataFrame:
    """Adds lines, and chunks: array of (first line from 0, number of lines)."""
    lines = F.split("text", "\n")
    docs = docs.withColumn("lines", lines).withColumn("hashes", F.transform("lines", _line_hash))

    def cuts(i: Column) -> Column:
        """Whether a chunk ends with line i, from 1."""
        before = F.when(i > 1, F.element_at("hashes", F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0))
        return (F.element_at("hashes", i) * 31 + before) % DIVISOR == 0

    n = F.size("lines")
    inner = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & cuts(i))
    ends = F.concat(inner, F.array(n))
    starts = F.concat(F.array(F.lit(0)), inner)
    return docs.withColumn("chunks", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("first"), (e - s).alias("n"))))


def _with_windows(docs: DataFrame) -> DataFrame:
    """Adds lines, and chunks: all windows of LEAST_LINES lines, as (first line from 0, number of lines)."""
    last = F.size("lines") - LEAST_LINES
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("first"), F.lit(LEAST_LINES).alias("n")))
    return docs.withColumn("lines", F.split("text", "\n")).withColumn("chunks", F.filter(windows, lambda c: c["first"] <= last))


def _chunk_text(chunk: Column) -> Column:
    return F.array_join(F.slice("lines", chunk["first"] + 1, chunk["n"]), "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", key_of(F.col("doc_id").cast("long")).alias("__id"), F.xxhash64("text").alias("__hash"))


def repeated(docs: DataFrame, chunked: Callable[[DataFrame], DataFrame] = _with_chunks) -> DataFrame:
    """Chunks (or windows) to remove: __id, __hash of the document, and array `__ranges` of (first, n)."""
    keyed = _keyed(documents(docs)).where("text is not null").select("__id", "__hash", "text")
    multi = F.filter("chunks", lambda c: c["n"] >= LEAST_LINES)
    places = chunked(keyed).select("__id", "__hash", F.explode(F.transform(multi, lambda c: F.struct(F.unhex(F.md5(_chunk_text(c))).alias("digest"), c["first"].alias("first"), c["n"].alias("n")))).alias("c"))
    places = written(places.select("__id", "__hash", "c.*"), "chunks").distinct()
    at = F.struct("__id", "__hash", "first")
    again = places.groupBy("digest").agg(F.min(at).alias("origin"), F.count("*").alias("times")).where("times > 1").drop("times")
    seen = places.join(again, "digest").groupBy("__id", "__hash").agg(F.collect_list(F.struct("digest", "first", "n", (at == F.col("origin")).alias("origin"))).alias("c"))
    texts = keyed.join(seen.hint("shuffle_hash"), ["__id", "__hash"]).withColumn("lines", F.split("text", "\n"))
    texts = texts.select("__id", "__hash", F.explode(F.transform("c", lambda c: F.struct(c["digest"].alias("digest"), c["first"].alias("first"), c["n"].alias("n"), c["origin"].alias("origin"), _chunk_text(c).alias("own")))).alias("c"))
    texts = written(texts.select("__id", "__hash", "c.*"), "chunk-texts")
    origins = texts.where("origin").groupBy("digest").agg(F.min("own").alias("model"))
    gone = texts.where("not origin").join(origins, "digest").where("own = model")
    return gone.groupBy("__id", "__hash").agg(F.collect_set(F.struct("first", "n")).alias("__ranges"))


def _cleaned(docs: DataFrame, chunked: Callable[[DataFrame], DataFrame] = _with_chunks) -> DataFrame:
    """The documents with the columns __gone (lines removed), __chunks, __lines and __kept (text that is left)."""
    joined = _keyed(docs).join(repeated(docs, chunked).hint("shuffle_hash"), ["__id", "__hash"], "left")
    lines = F.split("text", "\n")
    gone = F.array_distinct(F.flatten(F.transform("__ranges", lambda c: F.sequence(c["first"] + 1, c["first"] + c["n"]))))
    kept = F.array_except(F.sequence(F.lit(1), F.size("__all")), F.col("__out"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at("__all", i)), "\n")
    return joined.withColumn("__all", lines).withColumn("__out", gone).select(
        "*",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__all")).cast("long").alias("__lines"),
        F.when(F.col("__ranges").isNull(), F.lit(0)).otherwise(F.size("__out")).cast("long").alias("__gone"),
        F.when(F.col("__ranges").isNull(), F.lit(0)).otherwise(F.size("__ranges")).cast("long").alias("__chunks"),
        F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(text).alias("__kept"),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks, and text with what is left."""
    out = _cleaned(documents(docs))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed_lines"), F.col("__chunks").alias("n_removed_chunks"), F.col("__kept").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_passages (runs of removed lines), and text with what is left."""
    out = _cleaned(documents(docs), _with_windows)
    starts = F.size(F.array_except("__out", F.transform("__out", lambda i: i + 1)))
    runs = F.when(F.col("__ranges").isNull(), F.lit(0)).otherwise(starts).cast("long")
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed_lines"), runs.alias("n_removed_passages"), F.col("__kept").alias("text"))


def passage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with the text that is left and its n_chars; those of which no line is left go.

    All other columns travel in one struct, so they may be named like the columns of this module.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`") for c in other)) if other else F.lit(None)
    out = _cleaned(docs.select("doc_id", "text", rest.alias("rest"))).where("__gone < __lines or __lines = 0")
    new = {"doc_id": F.col("doc_id"), "text": F.col("__kept")} | {c: F.col("rest").getField(c) for c in other}
    if "n_chars" in other:
        new["n_chars"] = F.when(F.col("__gone") > 0, F.char_length("__kept")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) for c in docs.columns))


def _oracle(source: str) -> str:
    """Common table expressions that end in `cleaned` (doc_id, n_lines, n_removed_lines, n_removed_chunks, text)."""
    return f"""
lines AS (
    SELECT doc_id, text, pos, line, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h
    FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source} WHERE text IS NOT NULL)),
marked AS (
    SELECT *, coalesce((h * 31 + coalesce(lag(h) OVER w, 0)) % {DIVISOR} = 0, false) AS ends FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (
    SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM marked),
chunks AS (
    SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM numbered GROUP BY doc_id, chunk),
ranked AS (
    SELECT *, n >= {LEAST_LINES} AND row_number() OVER (PARTITION BY body, n >= {LEAST_LINES} ORDER BY doc_id, chunk) > 1 AS gone FROM chunks),
cleaned AS (
    SELECT d.doc_id, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(r.n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed_lines,
        count(*) FILTER (WHERE gone) AS n_removed_chunks,
        CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') END AS text
    FROM {source} d LEFT JOIN ranked r USING (doc_id) GROUP BY d.doc_id)"""


ORACLE = "WITH " + _oracle("documents").strip() + "\nSELECT * FROM cleaned"

PASSAGE_ORACLE = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
windows AS (
    SELECT doc_id, pos, string_agg(line, chr(10)) OVER w AS body, count(*) OVER w AS n FROM lines
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LEAST_LINES - 1} FOLLOWING)),
again AS (
    SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM windows WHERE n = {LEAST_LINES}) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {LEAST_LINES})) AS pos FROM again),
marked AS (SELECT l.*, g.pos IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (doc_id, pos)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked)
SELECT d.doc_id, count(r.pos) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed_lines, count(*) FILTER (WHERE starts) AS n_removed_passages,
    CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text
FROM documents d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id
"""
