import pytest
from pyspark.sql import functions as F

from glossweave.functions import lines, pagetext
from glossweave.operators import page_text

SCHEMA = "page long, seq long, x0 double, y0 double, x1 double, y1 double, ch string, font string, size double, cls long, cell_top long, cell_base long"


def placed(*runs, page=1):
    """Characters of runs (text, x, y, options): each 6 wide with half a point between, size 10."""
    out = []
    for text, x, y, *more in runs:
        o = {"size": 10.0, "cls": 2, "font": "Times", "step": 6.5, "cell": None, **(more[0] if more else {})}
        for i, ch in enumerate(text):
            x0 = float(x + i * o["step"])
            out.append((page, len(out), x0, float(y), x0 + 6, y + o["size"], ch, o["font"], o["size"], o["cls"], o["cell"], o["cell"]))
    return out


def texts(spark, *runs, layout=True):
    df = spark.createDataFrame(placed(*runs), SCHEMA)
    found = page_text.paragraphs(page_text.fragments(page_text.marked(df, layout)))
    return [r.text for r in found.orderBy("paragraph").collect()]


BOUNDARIES = [
    # cls, pcls, y0, py0, x0, px0, px1, with regions, without
    (2, 2, 100, 100, 50, 40, 46, "none", "none"),
    (2, 2, 100, 104, 50, 40, 46, "break", "break"),
    (2, 2, 100, 103, 50, 40, 46, "none", "none"),
    (2, 2, 100, 120, 50, 40, 46, "break", "break"),
    (2, 2, 100, 121, 50, 40, 46, "new", "new"),
    (2, 2, 100, 100, 62, 40, 46, "strong", "none"),
    (2, 2, 100, 110, 50, 300, 306, "new", "new"),
    (2, 2, 120, 110, 250, 40, 46, "strong", "strong"),
    (2, 2, 100, 110, 250, 40, 46, "strong", "break"),
    (2, 3, 100, 100, 50, 40, 46, "new", "none"),
    (2, 1000, 100, 100, 50, 40, 46, "strong", "none"),
    (1000, 1001, 100, 100, 50, 40, 46, "new", "none"),
    (1, 2, 100, 100, 50, 40, 46, "none", "none"),
    (1, 1000, 100, 110, 50, 40, 46, "break", "break"),
    (2, 1, 100, 130, 50, 40, 46, "new", "new"),
    (1000, 1000, 100, 106, 50, 40, 46, "strong", "break"),
    (1000, 1000, 100, 104, 50, 40, 46, "break", "break"),
    (1000, 1000, 100, 104, 40, 200, 206, "strong", "new"),
    (-1, 2, 100, 100, 50, 40, 46, "strong", "none"),
]


def test_boundaries(spark):
    names = "cls long, pcls long, y0 double, py0 double, x0 double, px0 double, px1 double"
    df = spark.createDataFrame([tuple(map(float, b[2:7])) for b in BOUNDARIES], "y0 double, py0 double, x0 double, px0 double, px1 double")
    rows = [(b[0], b[1], *map(float, b[2:7])) for b in BOUNDARIES]
    df = spark.createDataFrame(rows, names).coalesce(1)
    got = df.selectExpr("*", *[f"{e} AS {n}" for n, e in pagetext.distances().items()]).selectExpr(f"{pagetext.boundary(True)} AS a", f"{pagetext.boundary(False)} AS b").collect()
    assert [tuple(r) for r in got] == [b[-2:] for b in BOUNDARIES]


CASES = {
    "latin lines join with a blank": ([("Net sales rose", 50, 700), ("in the year.", 50, 688)], ["Net sales rose in the year."]),
    "a hyphen goes before a small letter": ([("inter-", 50, 700), ("national", 50, 688)], ["international"]),
    "a hyphen stays before a capital": ([("anti-", 50, 700), ("Trust", 50, 688)], ["anti- Trust"]),
    "weak gap after a full stop parts": ([("It ended.", 50, 700), ("Next part", 50, 670)], ["It ended.", "Next part"]),
    "weak gap without one does not": ([("It did not", 50, 700), ("end here", 50, 670)], ["It did not end here"]),
    "latin before japanese parts": ([("www.example", 50, 700), ("会社名", 50, 670)], ["www.example", "会社名"]),
    "a particle goes on": ([("その達成を", 50, 700), ("目指す", 50, 670)], ["その達成を目指す"]),
    "a unit ends": ([("合計百億円", 50, 700), ("次の項", 50, 670)], ["合計百億円", "次の項"]),
    "a wide gap is strong": ([("Name", 50, 700), ("Value", 120, 700)], ["Name", " Value"]),
    "a small gap is a blank": ([("Name", 50, 700), ("Value", 80, 700)], ["Name Value"]),
    "an open bracket is never the end": ([("百万円（", 50, 700), ("税込）", 120, 700)], ["百万円（税込）"]),
    "a bracket after a gap starts anew": ([("会社名", 50, 700), ("（単位）", 75, 700)], ["会社名", "（単位）"]),
    "spaced letters join": ([("代表者", 50, 700, {"step": 30})], ["代表者"]),
    "spaced letters join up to two": ([("代表者名", 50, 700, {"step": 30})], ["代表者", "名"]),
    "stacked letters join": ([("縦", 50, 700), ("書", 50, 688)], ["縦書"]),
    "a number beside a label in a table": ([("売上", 50, 700, {"cls": 1000}), ("155", 63.5, 700, {"cls": 1000})], ["売上", "155"]),
    "a negative beside a number": ([("合計", 50, 700), ("△43", 66, 700)], ["合計", " △43"]),
    "cells part": ([("ab", 50, 700, {"cls": 1000, "cell": 1}), ("cd", 63, 700, {"cls": 1000, "cell": 2})], ["ab", "cd"]),
    "a page number stands alone": ([("text", 50, 700), ("12", 76, 700, {"cls": -1})], ["text", "12"]),
    "figures are left out": ([("text", 50, 700), ("fig", 80, 700, {"cls": 0})], ["text"]),
    "formulas are numbered": ([("let ", 50, 700), ("xy", 76, 700, {"font": "CMMI10"}), (" be ", 89, 700), ("z", 115, 700, {"font": "CMMI10"})], ["let {v0} be {v1}"]),
    "a formula first": ([("xy", 50, 700, {"font": "CMMI10"}), (" is it", 63, 700)], ["{v0} is it"]),
    "contents end with a page": ([("Overview…… 2", 50, 700), ("results", 50, 670)], ["Overview…… 2", "results"]),
}


@pytest.mark.parametrize("name", CASES)
def test_paragraphs(spark, name):
    runs, want = CASES[name]
    assert texts(spark, *runs) == want


def test_boxes_and_origin(spark):
    rows = placed(("ab", 50, 700), ("CD", 63, 700, {"size": 14.0}), ("ef", 50, 688))
    df = spark.createDataFrame(rows + [(1, 99, 0.0, 0.0, 1.0, 1.0, None, "Times", 9.0, 2, None, None)], SCHEMA).withColumn("extra", F.lit(1))
    r = page_text.paragraphs(page_text.fragments(page_text.marked(df))).first()
    assert (r.text, r.broken, r.n, r.x0, r.y0, r.x1, r.y1, r.size, r.y) == ("abCD ef", True, 6, 50.0, 688.0, 75.5, 714.0, 14.0, 696.0)


def test_blocks(spark):
    rows = placed(("Overview…… 2", 50, 700)) + placed(("12,345", 50, 700), page=2) + placed(("xy", 50, 700, {"font": "CMMI10"}), page=3) + placed(("日本語の文", 50, 700, {"cls": 1000}), ("です", 50, 696, {"cls": 1000}), page=4)
    rows += placed(("会社の頭", 50, 700, {"cls": 7}), page=5) + placed(("  ", 50, 700), page=6)
    found = page_text.paragraphs(page_text.fragments(page_text.marked(spark.createDataFrame(rows, SCHEMA))))
    got = {r.page: r for r in page_text.blocks(found, "CASE WHEN cls = 7 THEN 'header' END").collect()}
    assert set(got) == {1, 2, 4, 5}
    assert (got[1].block, got[1].leader, got[1].page_number) == ("Overview", "……", "2")
    assert got[2].skip and not got[4].skip and got[5].skip and got[5].role == "header"
    assert got[4].block == "日本語の文です" and got[4].is_cell and got[4].n_lines == 1


def test_formulas(spark):
    rows = placed(("let ", 50, 700), ("xy", 76, 700, {"font": "ABCDEF+CMMI10"}), (" be", 89, 700))
    r = page_text.formulas(page_text.marked(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(f.v, f.text, f.x0, f.x1, f.font) for f in r] == [(0, "xy", 76.0, 88.5, "ABCDEF+CMMI10")]


def test_no_characters(spark):
    df = page_text.marked(spark.createDataFrame([], SCHEMA))
    assert page_text.paragraphs(page_text.fragments(df)).count() == 0 and page_text.formulas(df).count() == 0


def test_line_helpers_agree_with_expressions(spark):
    from glossweave.functions import text
    from glossweave.functions.dialect import Spark

    d = Spark()
    values = ["", " ", "その達成を", "ありません。", "です ", "目次…… 3", "a.b 1 2", "x-", "円", "また、", "か", "しました", "Latin", "カナ", "ながら", "終わり）", "3 . 4"]
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    got = df.selectExpr(f"{text.is_continuation(d, 't')} AS c", f"{text.is_toc_line(d, 't')} AS k").collect()
    assert [(r.c, r.k) for r in got] == [(lines.continues(v), lines.is_contents_line(v)) for v in values]
