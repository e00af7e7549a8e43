import hashlib

import duckdb

from ledgerloom.llm import linededup
from tests.llm.common import awkward, documents


def chunks(text):
    """(first line, lines) of each chunk."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        cut = (h[i] * 31 + (h[i - 1] if i else 0)) % linededup.DIVISOR == 0
        if cut or i == len(lines) - 1:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def brute(rows):
    """Text left of each (id, text); equal rows are one document."""
    seen, left = set(), {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        if text is None:
            left[doc, text] = None
            continue
        kept = []
        for _, lines in chunks(text):
            body = "\n".join(lines)
            if len(lines) >= linededup.LEAST_LINES and body in seen:
                continue
            if len(lines) >= linededup.LEAST_LINES:
                seen.add(body)
            kept.append(body)
        left[doc, text] = "\n".join(kept)
    return sorted((str(d), str(left[d, t])) for d, t in rows)


def pairs(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_awkward(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] != 3]
    passage = "\n".join(f"shared line {i}" for i in range(40))
    rows += [(20 + i, f"own start {i}\n{passage}\nown end {i}") for i in range(30)] + [(60, "\n\n\n\n"), (61, "\n\n\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(linededup.line_dedup(docs)) == brute(rows)
    longest = max(len(t or "") for _, t in brute([r for r in rows if r[0] and 21 <= r[0] < 50])[1:])
    assert longest <= len(passage) + 40


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = linededup.line_dedup(docs)
    assert pairs(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.n_removed_lines for r in got.collect()) > 0


def test_stage(spark):
    docs = documents(spark, [(1, "a\nb\nc\nd", "en", "s", 9), (2, "a\nb\nc\nd", "en", "s", 9), (3, "", "en", "s", 0), (4, None, None, None, None), (5, "own", "x", "y", 77)]).withColumnRenamed("lang", "gone")
    out = linededup.without_repeats(spark, docs, "")
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "a\nb\nc\nd" and got[3].text == "" and got[4].text is None and got[5].n_chars == 77
    assert 2 not in got or len(got[2].text) == got[2].n_chars < 7


def test_empty(spark):
    assert linededup.line_dedup(documents(spark, [])).count() == 0


def plain_passages(rows):
    """Text left of each (id, text) once all windows of LEAST_LINES lines that stood before are gone; equal rows are one document."""
    size, seen, left = linededup.LEAST_LINES, set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(lines) - size + 1):
            window = tuple(lines[i : i + size])
            if window in seen:
                gone |= set(range(i, i + size))
            seen.add(window)
        left[doc, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return sorted((str(d), str(left[d, t])) for d, t in rows)


def test_passages_awkward(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] != 3]
    passage = "\n".join(f"shared line {i}" for i in range(40))
    rows += [(20 + i, f"own start {i}\n{passage}\nown end {i}") for i in range(30)] + [(60, "\n\n\n\n"), (61, "a\nb\na\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.passage_dedup(docs)
    assert pairs(got) == plain_passages(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[20 + i].text == f"own start {i}\nown end {i}" and by[20 + i].n_removed_passages == 1 for i in range(1, 30))
    assert by[61].text == "a\nb\nc" and by[61].n_removed_lines == 2


def test_passages_leave_nothing_of_a_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = linededup.passage_dedup(docs)
    assert pairs(got) == plain_passages(rows)
    left, seen, copies = {r.doc_id: r for r in got.collect()}, set(), []
    for d, t in sorted(rows):
        if t and "\n" in t:
            copies += [d] * (t in seen)
            seen.add(t)
    assert copies and all(left[d].text == "" and left[d].n_lines == left[d].n_removed_lines for d in copies)


def test_passages_in_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(linededup.PASSAGE_ORACLE).fetchall()
    got = linededup.passage_query(spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert linededup.passage_dedup(documents(spark, [])).count() == 0


def test_stage_with_clashing_columns(spark):
    text = "\n".join(f"line number {i} of a passage" for i in range(30))
    names = ["doc_id", "__id", "__hash", "text", "__gone", "__lines", "rest", "lines", "n_chars", "a.b"]
    rows = [(1, 10, "h", text, 3, 4, "r", "l", len(text), 7), (2, 11, None, text, None, 5, "s", "m", len(text), 8), (3, 12, "i", None, 1, 1, None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, __id long, __hash string, text string, __gone int, __lines int, rest string, lines string, n_chars long, `a.b` int")
    out = linededup.without_repeats(spark, docs, "")
    assert out.schema == docs.schema and out.columns == names
    got = {r[0]: r for r in out.collect()}
    assert tuple(got[1]) == rows[0] and tuple(got[3]) == rows[2]
    want = dict(brute([(r[0], r[3]) for r in rows]))
    left = next((t for d, t in want.items() if int(d) == 2), "")
    assert 2 not in got if not left else (got[2][3], got[2][8], got[2][9]) == (left, len(left), 8)
    only = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in linededup.without_repeats(spark, only, "").collect()] == [(1, text)]
