import io
import zipfile

from glossweave.sources import formats
from glossweave.streaming import deltas


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
    return _zip({"word/document.xml": f"<w:document {w}><w:body>{p('First')}{p('')}{p('Third')}<w:tbl><w:tr><w:tc>{p('Cell')}</w:tc></w:tr></w:tbl></w:body></w:document>"})


def _xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return _zip(
        {
            "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>Shared</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>In</t></is></c><c r="C1" t="s"><f>A1</f><v>0</v></c><c r="D1"><v>5</v></c></row></sheetData></worksheet>',
        }
    )


def _pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    return _zip({f"ppt/slides/slide{i}.xml": f"<p {a}><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></p>" for i in (2, 10, 1)})


def test_all_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\n\n\nTwo\nlines.")
    (tmp_path / "b.csv").write_bytes("x;y;z\r\n売上;;3\r\na;b;c\r\n".encode("cp932"))
    (tmp_path / "c.docx").write_bytes(_docx())
    (tmp_path / "d.xlsx").write_bytes(_xlsx())
    (tmp_path / "e.pptx").write_bytes(_pptx())
    (tmp_path / "f.bin").write_bytes(b"skip")
    rows = formats.read_blocks(spark, str(tmp_path)).collect()
    got = {(r.doc.rsplit("/", 1)[1], r.block): r.text for r in rows}
    assert got == {
        ("a.txt", "para_0"): "One.", ("a.txt", "para_2"): "Two\nlines.", ("b.csv", "r0_c0"): "x", ("b.csv", "r0_c1"): "y", ("b.csv", "r0_c2"): "z", ("b.csv", "r2_c0"): "a", ("b.csv", "r2_c1"): "b", ("b.csv", "r2_c2"): "c", ("b.csv", "r1_c0"): "売上", ("b.csv", "r1_c2"): "3",
        ("c.docx", "para_0"): "First", ("c.docx", "para_2"): "Third", ("c.docx", "table_0_r0_c0"): "Cell", ("d.xlsx", "One_A1"): "Shared", ("d.xlsx", "One_B2"): "In",
        ("e.pptx", "s0_p0"): "Slide 1", ("e.pptx", "s1_p0"): "Slide 2", ("e.pptx", "s2_p0"): "Slide 10",
    }
    blocks = formats.read_blocks(spark, str(tmp_path), [1])
    assert {r.section for r in blocks.collect()} == {None, 1}
    out = formats.apply_translations(blocks, spark.createDataFrame([(rows[0].doc, rows[0].block, "T")], "doc string, block string, text string"))
    assert {r.translated for r in out.collect()} >= {"One."} or out.where("translated = 'T'").count() == 1


def test_decode_and_newline():
    assert formats.decode(b"\xef\xbb\xbfa") == ("a", "utf-8-sig")
    assert formats.decode("売".encode("cp932")) == ("売", "cp932")
    assert formats.decode("売".encode()) == ("売", "utf-8")
    assert [formats.newline(x) for x in (b"a\r\nb\n", b"a\nb", b"a\rb", b"")] == ["\r\n", "\n", "\r", "\n"]


def test_coalesce_rules():
    out, state = deltas.coalesce([(0, "a"), (50, "b"), (100, "c"), (180, "d"), (190, "x" * 256)], ("", None))
    assert out == [(0, "a"), (180, "bcd"), (190, "x" * 256)] and state == ("", 190)


def test_double_copy_rules():
    start = ("", -(10**9), "", -(10**9))
    assert deltas.double_copies([(0, "a"), (10, "a")], start)[0] == []
    assert deltas.double_copies([(0, "a"), (30, "a")], start)[0] == [30]
    assert deltas.double_copies([(0, "a"), (2600, "a")], start)[0] == []
    assert deltas.double_copies([(0, "a"), (100, "a"), (300, "a"), (500, "a")], start)[0] == [100]
    assert deltas.double_copies([(0, "a"), (100, "b"), (200, "a")], start)[0] == []


def test_streams(spark, tmp_path):
    rows = [(1, 0, 0, "a"), (1, 1, 50, "b"), (1, 2, 300, "c"), (2, 0, 0, "z"), (2, 1, 100, "z")]
    df = spark.createDataFrame(rows, "stream_id long, seq long, ms long, text string").selectExpr("stream_id", "seq", "timestamp_millis(ms + 1700000000000) AS ts", "text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("gw_text", deltas.coalesced(stream)), ("gw_copies", deltas.double_copy_events(stream.withColumnRenamed("stream_id", "user_id")))):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    base = 1700000000000
    assert {(r.stream_id, r.ms - base, r.text) for r in spark.table("gw_text").collect()} >= {(1, 0, "a"), (1, 300, "bc"), (2, 0, "z")}
    assert {(r.user_id, r.ms - base) for r in spark.table("gw_copies").collect()} == {(2, 100)}


def test_double_copies_of_a_table(spark):
    from glossweave.streaming import deltas

    rows = [(1, 1, 0, "a"), (1, 2, 100, "a"), (1, 3, 200, "a"), (1, 4, 1000, "a"), (1, 5, 1300, "a"), (1, 6, 1400, "a"), (2, 7, 0, "a"), (2, 8, 2500, "a"), (2, 9, 9000, "b"), (2, 10, 11501, "b"), (3, 11, 0, "a"), (3, 12, 19, "a"), (3, 13, None, "a"), (None, 14, 5, "z"), (None, 15, 50, "z")]
    df = spark.createDataFrame(rows, "u long, e long, ms long, t string").repartition(3)
    assert sorted(r.e for r in deltas.double_copy_rows(df, "u", "e", "ms", "t").collect()) == [2, 5, 8]
