"""Framing, previews and the history table."""

from glossweave.operators import history
from glossweave.sources import formats
from glossweave.streaming import framing, guard


def test_payloads_of_any_cut():
    body = ': c\ndata: {"a": 1}\r\n\r\nevent: x\ndata:2\n\ndata: [DONE]\ndata: 3\n'
    for n in range(1, 12):
        assert list(framing.payloads(body[i : i + n] for i in range(0, len(body), n))) == ['{"a": 1}', "2"]


def test_chunks_of_a_body():
    assert framing.dechunk(b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\nrest") == b"Wikipedia"
    assert framing.dechunk(b"4\r\nWi") == b"Wi" and framing.dechunk(b"zz\r\n") == b"" and framing.dechunk(b"") == b""


def shown(rows, mismatched=None):
    state, out, ms = guard.START, [], 0
    for ms, piece in rows:
        state, text = guard.step(state, ms, piece, mismatched)
        out += [(ms, text)] if text is not None else []
    return out + ([(ms, left)] if (left := guard.rest(state)) else [])


def test_previews():
    assert shown([(0, "a"), (10, "b"), (20, "cde"), (200, "abcdef")]) == [(0, "a"), (20, "abcde"), (200, "abcdef")]
    assert shown([(0, "a"), (10, "b")]) == [(0, "a"), (10, "ab")]
    assert shown([(0, "ok "), (100, "bad"), (200, "x")], lambda t: "bad" in t) == [(0, "ok ")]
    assert shown([(0, "x" * 256), (100, "bad")], lambda t: "bad" in t) == [(0, "x" * 256), (100, "x" * 256 + "bad")]
    assert shown([]) == []


def test_history(spark):
    rows = spark.createDataFrame([("b", "{}", "2024-01-02"), ("a", "{}", "2024-01-01"), ("c", "{}", "2024-01-02")], "source_text string, result_json string, timestamp string")
    h = history.added(history.created(spark), rows)
    assert {(r.id, r.source_text) for r in h.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    h = history.added(h, rows.where("source_text = 'a'"))
    assert sorted(r.id for r in h.collect()) == [1, 2, 3, 4]
    assert {r.id for r in history.deleted(h, rows.where("source_text = 'b'")).collect()} == {1, 4}
    assert [r.id for r in history.recent(h, 2).collect()] == [3, 2] and history.pruned(h, 3).count() == 3
    assert history.cleared(h)[1] == 4 and history.cleared(h)[0].count() == 0


def test_text_and_csv_sinks(spark, tmp_path):
    blocks = spark.createDataFrame([("d", 0, 1, "B."), ("d", 0, 0, "A."), ("d", 2, 0, "C"), ("e", 0, 0, "x")], "doc string, row int, col int, translated string")
    assert {r.doc: r.value for r in formats.texts_of(blocks).collect()} == {"d": "A.B.\n\nC", "e": "x"}
    formats.write_txt(blocks, str(tmp_path / "out"))
    assert {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("doc=*/part*")} == {"doc=d": "A.B.\n\nC\n", "doc=e": "x\n"}
    cells = spark.createDataFrame([("d", 0, 0, 'a"b'), ("d", 0, 2, "c;d"), ("d", 1, 0, "e")], "doc string, row int, col int, translated string")
    assert formats.csv_of(cells, ";", "\r\n").first().value == '"a""b";;"c;d"\r\ne\r\n'
