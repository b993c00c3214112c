"""Removal of recurring lines by a log-template tree.

Lines are cut at line feeds and into words; words with a digit become ``<*>``.  The tree has fixed depth:
a line goes by its number of words, then by its first ``LEADING`` words, to a leaf.  Leaves that fewer than
``MIN_DOCS`` documents reach cannot recur and drop out, which is most of prose.  In a leaf, a word
that stands at its place in at least ``MIN_DOCS`` line-documents is fixed and any other is variable.  The leading
words are fixed by the tree itself, so they tell nothing: a line has a template if at least ``FIXED`` percent of
its other words, masked ones aside, are fixed, and some word of it is.  The template is its fixed words with
``<*>`` between; templates that recur in ``MIN_DOCS`` line-documents or more are dropped from all of them.

One pass hashes every line; what follows works on these hashes, and the text of one line for each
distinct line of a live leaf is fetched to find its words.

A line-document is a distinct line in a distinct document.  Blank lines stay and count for nothing.  Null
counts as empty; texts and lines may be of any length.  Rows that repeat an id count as one document if the
text repeats too, else as several.  There are no ties: a template recurs or not.  Extra columns are
ignored, whatever their names; an empty table gives no rows.  Counting is by partial aggregates over
distinct lines, so a line that a third of all documents hold is one row from each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.repeats import keyed
from glossweave.llm.scratch import discard, materialise, table

MIN_DOCS = 20
LEADING = 3
FIXED = 60
WILD = "<*>"
_BLANKS = str.maketrans("\t\x0b\x0c\r", "    ")
_DIGIT = re.compile("[0-9]")
_NUMBERED = re.compile("[^ ]*[0-9][^ ]*")


def masked(line: str) -> str:
    """The words of a line, joined by one blank, those with digits masked; empty for a blank line."""
    plain = " ".join(filter(None, line.translate(_BLANKS).split(" ")))
    return _NUMBERED.sub(WILD, plain) if _DIGIT.search(plain) else plain


def lines(docs: DataFrame) -> DataFrame:
    """d, h, i, leaf, m of every line that is not blank (of ``keyed`` documents); m names the masked line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            row, at, leaf, m = [], [], [], []
            for r, text in enumerate(batch.column(2)):
                for i, line in enumerate(text.as_py().split("\n")):
                    if x := masked(line):
                        b = x.encode()
                        row.append(r)
                        at.append(i)
                        m.append(digest(b))
                        leaf.append(digest(b" ".join(b.split(b" ", LEADING)[:LEADING]), b.count(b" ")))
            k = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(k), batch.column(1).take(k), pa.array(at, pa.int32()), *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in (leaf, m)]],
                names=["d", "h", "i", "leaf", "m"],
            )

    return docs.select("d", "h", "text").mapInArrow(run, "d long, h long, i int, leaf long, m long")


def _said(docs: DataFrame, held: DataFrame) -> DataFrame:
    """leaf, m, n, masked: the words of the lines in ``held`` (leaf, m, n, rep), each read from one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                parts = text.as_py().split("\n")
                for w in wanted.as_py():
                    for c, v in zip(out, (w["leaf"], w["m"], w["n"], masked(parts[w["i"]])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], names=["leaf", "m", "n", "masked"])

    need = held.groupBy(F.col("rep.d").alias("d"), F.col("rep.h").alias("h")).agg(F.collect_list(F.struct("rep.i", "leaf", "m", "n")).alias("wanted"))
    rows = docs.select("d", "h", "text").join(need.hint("merge"), ["d", "h"]).select("text", "wanted")
    return rows.mapInArrow(run, "leaf long, m long, n long, masked string").dropDuplicates(["leaf", "m"])  # a repeated row tells twice


def live_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """d, h, i, leaf, m of the lines in leaves with ``min_docs`` lines or more."""
    every = materialise(lines(docs), "lines")
    often = materialise(every.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_docs).select("leaf"), "often")
    live = materialise(every.join(often.hint("merge"), "leaf"), "live-lines")
    discard(every, often)
    return live


def templates(docs: DataFrame, live: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """leaf, m, masked, template, docs of the masked lines that are dropped."""
    pairs = materialise(live.groupBy("leaf", "m", "d", "h").agg(F.min("i").alias("i")), "line-docs")
    leaves = pairs.select("leaf", "d", "h").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_docs)
    leaves = materialise(leaves.select("leaf"), "leaves")
    held = pairs.join(leaves.hint("merge"), "leaf").groupBy("leaf", "m").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "h", "i")).alias("rep"))
    said = materialise(_said(docs, materialise(held, "held")), "leaf-lines")
    discard(pairs)
    words = said.select("leaf", "m", "n", F.posexplode(F.split("masked", " ")).alias("j", "word"))
    fixed = words.where(F.col("word") != WILD).groupBy("leaf", "j", "word").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
    fixed = materialise(fixed.select("leaf", "j", "word", F.lit(True).alias("fixed")), "fixed-words")
    told = words.join(fixed.hint("merge"), ["leaf", "j", "word"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    later = F.col("j") >= LEADING
    shaped = told.groupBy("leaf", "m", "n").agg(
        F.array_sort(F.collect_list(F.struct("j", F.when(F.col("fixed"), F.col("word")).otherwise(WILD).alias("word")))).alias("x"),
        F.count_if("fixed").alias("k"),
        F.count_if(F.col("fixed") & later).alias("k_later"),
        F.count_if((F.col("word") != WILD) & later).alias("n_later"),
    )
    shaped = shaped.where((100 * F.col("k_later") >= FIXED * F.col("n_later")) & (F.col("k") > 0)).select("leaf", "m", "n", F.array_join(F.col("x.word"), " ").alias("template"))
    shaped = materialise(shaped, "templates")
    often = shaped.groupBy("leaf", "template").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    return shaped.join(materialise(often, "recurring"), ["leaf", "template"]).join(said.select("leaf", "m", "masked"), ["leaf", "m"]).select("leaf", "m", "masked", "template", "docs")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the remaining lines joined by a line feed)."""
    rows = keyed(docs, id_col, text_col)
    live = live_lines(rows, min_docs)
    drop = materialise(templates(rows, live, min_docs).select("leaf", "m"), "dropped-lines")
    hit = materialise(live.join(drop.hint("merge"), ["leaf", "m"]).groupBy("d", "h").agg(F.collect_set("i").alias("gone")), "dropped")
    discard(live)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, held in zip(batch.column(1), batch.column(2), strict=True):
                t = text.as_py()
                if held.is_valid:
                    parts, out = t.split("\n"), set(held.values.to_pylist())
                    total.append(len(parts))
                    gone.append(len(out))
                    kept.append("\n".join(x for i, x in enumerate(parts) if i not in out))
                else:
                    total.append(t.count("\n") + 1)
                    gone.append(0)
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    out = rows.join(hit.hint("merge"), ["d", "h"], "left").select("doc_id", "text", "gone")
    return out.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
mark AS (
  SELECT doc_id, i, line, regexp_replace(trim(regexp_replace(line, '[ \x09\x0B-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{WILD}', 'g') AS masked FROM line),
leafed AS (
  SELECT *, len(string_split(masked, ' ')) || ' ' || array_to_string(string_split(masked, ' ')[1:{LEADING}], ' ') AS leaf FROM mark WHERE masked <> ''),
pairs AS (SELECT DISTINCT leaf, masked, doc_id FROM leafed),
leaves AS (SELECT leaf FROM pairs GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
said AS (SELECT leaf, masked, count(*) AS n FROM pairs JOIN leaves USING (leaf) GROUP BY ALL),
words AS (SELECT leaf, masked, n, unnest(string_split(masked, ' ')) AS word, unnest(range(len(string_split(masked, ' ')))) AS j FROM said),
fixed AS (SELECT leaf, j, word, true AS fixed FROM words WHERE word <> '{WILD}' GROUP BY ALL HAVING sum(n) >= {MIN_DOCS}),
shaped AS (
  SELECT w.leaf, masked, n, string_agg(CASE WHEN fixed THEN w.word ELSE '{WILD}' END, ' ' ORDER BY w.j) AS template
  FROM words w LEFT JOIN fixed f ON f.leaf = w.leaf AND f.j = w.j AND f.word = w.word
  GROUP BY w.leaf, masked, n
  HAVING count(fixed) > 0 AND 100 * count(fixed) FILTER (w.j >= {LEADING}) >= {FIXED} * count(*) FILTER (w.j >= {LEADING} AND w.word <> '{WILD}')),
often AS (SELECT leaf, template FROM shaped GROUP BY ALL HAVING sum(n) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT masked FROM shaped JOIN often USING (leaf, template))
SELECT m.doc_id, count(*) AS n_lines, count(g.masked) AS n_dropped,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (g.masked IS NULL), '')) AS kept_sha256
FROM mark m LEFT JOIN gone g ON g.masked = m.masked AND m.masked <> ''
GROUP BY m.doc_id
"""
