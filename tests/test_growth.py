"""Queries whose work must grow with their tables, and rules that must not hang on the order of rows."""

import datetime
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossweave.functions import guards, sieve
from glossweave.operators import terms, wrapping
from glossweave.plans import pages, pagetext, reports

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deleted_times_meet_by_equality(spark, tmp_path):
    assert "NestedLoop" not in _plan(reports.QUERIES["history_after_delete"](spark, DIR))
    at = lambda m: None if m is None else datetime.datetime(2024, 1, 1, 0, m)
    rows = [(50, at(1), 1, "a", 1.0, "{}"), (51, at(1), 1, "a", 1.0, "{}"), (52, at(2), 1, "a", 1.0, "{}"), (53, None, 1, "a", 1.0, "{}"), (100, None, 1, "a", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(reports.QUERIES["history_after_delete"](spark, str(tmp_path)).first()) == (3, 2, 100)


def test_terms_of_all_lengths(spark):
    """Terms up to several windows long, from two places of a plane above the first; no text and no candidate list goes through a shuffle."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab 𠮷い") for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "?" + "𠮷" * 40]
    own = [t for t in texts if t]
    found = {rng.choice(own)[(a := rng.randint(0, 30)) : a + rng.randint(4, 70)].strip() for _ in range(200)} | {"?ab ", "𠮷𠮷𠮷𠮷", "?𠮷𠮷𠮷", "a" * 40}
    rows = [(i, s, "") for i, s in enumerate(sorted(s for s in found if len(re.sub(r"\s", "", s)) >= 4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n, r.truncated) for r in terms.matched(docs, spark.createDataFrame(rows, "idx long, source string, target string"), 5).collect()}
    bare = lambda x: re.sub(r"\s", "", x or "").lower()
    want = {i: n for i, t in enumerate(texts) if (n := sum(bare(s) in bare(t) for _, s, _ in rows))}
    assert got == {i: (n, n > 5) for i, n in want.items()}
    assert max(len(bare(s)) for _, s, _ in rows) > 48


def test_terms_hold_no_candidate_lists(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    plan = terms.matched(docs, spark.createDataFrame([(0, "text", "")], "idx long, source string, target string"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_terms_read_each_text_once(spark):
    """One pass over a text, and no row for each of its places."""
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    plan = terms.matched(docs, spark.createDataFrame([(0, "text", "")], "idx long, source string, target string"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(text") == 1 and "regexp_extract_all" not in plan


def test_sieve_finds_all_across_pieces(monkeypatch):
    """Texts and strings far longer than a piece, slices of arrays, and strings that share their beginnings."""
    rng = random.Random(8)
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(sieve, "PIECE", piece)
        monkeypatch.setattr(sieve, "ROWS", piece)
        texts = ["".join(rng.choice("ab 0円_-/é") for _ in range(rng.choice([0, 1, 30, 300]))) for _ in range(40)]
        bare, words = [re.sub(r"[\s_/\\-]", "", t) for t in texts], [re.findall("[a-z0-9]+", t) for t in texts]
        own = lambda xs: {x[(i := rng.randrange(len(x))) : i + rng.randint(1, 90)] for x in (rng.choice([y for y in xs if y]) for _ in range(60))}
        sought = {sieve.BARE: {x for x in own(bare) if len(x) >= 4} | {"abababab", "b" * 70}, sieve.PART: {x for x in own(texts) if not re.fullmatch("[a-z0-9]+", x) and len(re.sub(r"[\s_/\\-]", "", x)) < 4} | {"円", "-"}, sieve.WORD: {"a", "ab", "0b0", "bab"}}
        keys, kinds = zip(*[(x.encode(), k) for k, xs in sought.items() for x in sorted(xs)], strict=True)
        bits, lengths = np.zeros(1 << (sieve.LOG2_SLOTS - 3), np.uint8), {k: sorted({len(x.encode()) for x in xs}) for k, xs in sought.items()}
        for s in sieve.slots(pa.array([b"??", *keys], pa.binary()).slice(1), np.array(kinds)):
            np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype(np.uint8))
        got = [(i, x) for rows, found in sieve.found(pa.array(["", "ab", *texts]).slice(2), lengths, bits) for i, x in zip(rows.to_pylist(), found.to_pylist(), strict=True)]
        want = {(i, x.encode()) for i in range(len(texts)) for k, xs in sought.items() for x in xs if x in (words[i] if k == sieve.WORD else bare[i] if k == sieve.BARE else texts[i])}
        assert {(i, x) for i, x in got if x in keys} == want and len(want) > 40
        assert piece < 1 << 20 or len(got) == len(set(got))


def test_equal_edges_share_a_grid_line(spark):
    """Boxes that start where the first of a new cluster does, in any order."""
    assert "ROWS" not in pages.STATEMENTS["grid_lines"]
    rows = [(p, b, x, 0.0, x + 4, 3.0) for p in range(50) for b, x in enumerate([0.0] + [30.0] * 20)]
    random.Random(6).shuffle(rows)
    b = spark.createDataFrame(rows, "page long, box long, x0 double, y0 double, x1 double, y1 double").repartition(7)
    got = spark.sql(re.sub(r"\b(FROM|JOIN) b\b", r"\1 {b}", pages.STATEMENTS["grid_lines"]), b=b).where("axis = 'x'")
    assert {(r.i, r.line) for r in got.collect()} == {(0, 2.0), (1, 32.0)}


def test_cells_of_equal_edges(spark):
    """The structure of a table hangs on the same lines."""
    assert "ROWS" not in pages.STATEMENTS["table_structure"]
    rows = [(1, b, x, y, x + 4, y + 3) for b, (x, y) in enumerate((x, y) for x in (0.0, 30.0, 30.0) for y in (0.0, 40.0))]
    b = spark.createDataFrame(rows, "page long, box long, x0 double, y0 double, x1 double, y1 double").repartition(5)
    got = spark.sql(re.sub(r"\b(FROM|JOIN) b\b", r"\1 {b}", pages.STATEMENTS["table_structure"]), b=b)
    assert {(r.box, r.row_idx, r.col_idx, r.row_span, r.col_span) for r in got.collect()} == {(b, b % 2 // 2, b // 2 // 3, 1, 1) for b in range(6)}


def test_wrapping_meets_no_other_row(spark):
    boxes = spark.createDataFrame([(1, "ab cd\n" * 3, 15.0, 10.0)], "id long, text string, box double, size double")
    df = wrapping.wrapped(boxes, "CASE WHEN ch = 'a' THEN 2 * size ELSE size / 2 END")
    assert "Window" not in _plan(df) and "Exchange" not in _plan(df)
    assert [r.text for r in df.orderBy("line").collect()] == ["a", "b", "cd"] * 3


def test_characters_of_a_page_stay_in_its_task(spark):
    for name in ("page_boundaries", "page_formulas", "page_blocks"):
        plan = _plan(pagetext.QUERIES[name](spark, DIR))
        assert "Exchange" not in plan[plan.index("Window") : plan.index("Generate posexplode")], name


def test_plain_english_asks_for_no_compatibility_forms(monkeypatch):
    asked = []
    monkeypatch.setattr(guards.unicodedata, "normalize", lambda form, x: asked.append(x) or unicodedata.ucd_3_2_0.normalize(form, x))
    assert guards.english_form(" 1,200 yen \x1f\n") == "1,200 yen" and guards.english_form(None) == "" and not guards.is_not_english(" plain ") and not guards.is_not_english(None)
    assert not asked and guards.is_not_english("売上") and guards.english_form("２兆円") == "20,000 oku yen" and asked


def test_english_forms_of_all_blanks(spark):
    texts = [None, "", " \x0b\x1c a b\x1f \n", "\n\n", "plain", " ３億円 ", "\u3000a\u3000", "é\n"] + [chr(i) + "x" + chr(i) for i in range(1, 128)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("form", guards.english_forms(F.col("text")))
    assert [r.form for r in df.orderBy("id").collect()] == [guards.english_form(t) for t in texts]
    # Plain texts do not go to Python.
    plan = _plan(df)
    assert "octet_length" in plan[plan.index("ArrowEvalPython") :]


def test_equally_near_lines(spark):
    """An edge at 16 is 19/3 from the lines at 29/3 and 67/3: the first one counts, though the difference of the means to it rounds to more."""
    rows = [(1, b, x0, 0.0, x1, 50.0) for b, (x0, x1) in enumerate([(9.0, 20.0), (10.0, 21.0), (10.0, 21.0), (16.0, 100.0), (22.0, 22.0), (25.0, 60.0), (27.0, 27.0)])]
    b = spark.createDataFrame(rows, "page long, box long, x0 double, y0 double, x1 double, y1 double")
    got = spark.sql(re.sub(r"\b(FROM|JOIN) b\b", r"\1 {b}", pages.STATEMENTS["table_structure"]), b=b).where("box = 3")
    assert [(r.col_idx, r.col_span) for r in got.collect()] == [(0, 2)]


def test_geometry_is_compiled_in_parts(spark):
    """One method for all columns is too long for the JVM to optimise; the rows and types stay those of the plain statement."""
    from glossweave.plans import catalog

    got, plain = catalog.queries()["geometry_rules"](spark, DIR), catalog.spark_query("geometry_rules")(spark, DIR)
    outside = lambda df: any(line.lstrip("+- :").startswith("Project [") and "progress" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert outside(got) and not outside(plain)
    assert got.dtypes == plain.dtypes and got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
