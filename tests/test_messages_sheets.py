from pyspark.sql import functions as F

from glossweave.operators import messages, sheets


def test_blank_paragraphs_keep_their_number(spark):
    long = "あ" * 2000 + "。" + "い" * 2000
    rows = [(1, "Hello", "first\n\n \n\n second \n\n\n\n" + long), (2, "", ""), (3, None, None), (4, "s", "\n\n")]
    mails = spark.createDataFrame(rows, "m long, subject string, body string")
    got = {(r.m, r.id): (r.section, r.text, r.location) for r in messages.blocks(mails, ["m"]).collect()}
    assert got == {
        (1, "msg_subject"): (0, "Hello", "件名"),
        (1, "msg_body_0"): (1, "first", "本文段落1"),
        (1, "msg_body_2"): (3, "second", "本文段落2"),
        (1, "msg_body_4_chunk_0"): (5, "あ" * 2000 + "。", "本文段落3 (分割1)"),
        (1, "msg_body_4_chunk_1"): (5, "い" * 2000, "本文段落3 (分割2)"),
        (4, "msg_subject"): (0, "s", "件名"),
    }
    said = spark.createDataFrame([(1, "msg_body_2", "zwei"), (1, "msg_body_4_chunk_1", "x"), (1, "msg_subject", "Hallo"), (9, "msg_subject", "no")], "m long, id string, text string")
    back = {r.m: (r.subject, r.body) for r in messages.rebuilt(mails, said, ["m"]).collect()}
    assert back == {1: ("Hallo", "first\n\n\n\nzwei\n\n\n\n" + "あ" * 2000 + "。x"), 2: ("", ""), 3: ("", ""), 4: ("s", "\n\n")}
    assert messages.blocks(mails, ["m"], wanted=F.col("text") == "first").count() == 1


def test_longest_sheet_name_of_the_own_workbook(spark):
    ids = ["my_A1", "my_sheet_A1", "my_sheet_AA100", "my_shape_3", "my_shape_x", "my_sheet_chart_0_title", "my_chart_1_axis_value", "my_chart_1_axis", "other_A1", "my_ABCD1", "my_A0", "my_a1", "_A1", "", None]
    blocks = spark.createDataFrame([("b", i, n) for n, i in enumerate(ids)], "book string, id string, n int")
    names = spark.createDataFrame([("b", "my"), ("b", "my_sheet"), ("c", "other")], "book string, sheet string")
    got = {r.id: (r.sheet, r.kind, r.row, r.column, r.number, r.part) for r in sheets.targets(sheets.routed(blocks, names, ["book"])).collect()}
    assert got == {
        "my_A1": ("my", "cell", 1, 1, None, None),
        "my_sheet_A1": ("my_sheet", "cell", 1, 1, None, None),
        "my_sheet_AA100": ("my_sheet", "cell", 100, 27, None, None),
        "my_shape_3": ("my", "shape", None, None, 3, None),
        "my_sheet_chart_0_title": ("my_sheet", "chart", None, None, 0, "title"),
        "my_chart_1_axis_value": ("my", "chart", None, None, 1, "value"),
    }


def test_cells_in_merged_areas(spark):
    refs = spark.createDataFrame([("s", "B2:D5"), ("s", "A1000:A1030"), ("t", "$A$1"), ("s", "bad")], "sheet string, ref string")
    areas = refs.select("*", *sheets.area_bounds(F.col("ref"))).where("r1 IS NOT NULL")
    cells = spark.createDataFrame([("s", r, c) for r, c in [(1, 1), (2, 2), (5, 4), (5, 5), (1024, 1), (1031, 1)]] + [("t", 1, 1)], "sheet string, row long, column long")
    got = {(r.sheet, r.row, r.column, r.ref) for r in sheets.in_areas(cells, areas, ["sheet"]).collect()}
    assert got == {("s", 2, 2, "B2:D5"), ("s", 5, 4, "B2:D5"), ("s", 1024, 1, "A1000:A1030"), ("t", 1, 1, "$A$1")}
