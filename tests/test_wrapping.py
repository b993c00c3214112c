import random
import re

import pytest

from glossweave.operators import wrapping

SINGLE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯･-ﾟ]")


def plain(text, box, size):
    """Token by token, as one would by hand."""
    if not text:
        return []
    if box <= 0:
        return [text]
    size = size if size > 0 else 10.0
    width = lambda s: sum(size if SINGLE.match(c) else size / 2 for c in s)
    tokens = re.findall(f"\n|{SINGLE.pattern}|(?:(?!{SINGLE.pattern})[^ \n])* |(?:(?!{SINGLE.pattern})[^ \n])+", text)
    assert "".join(tokens) == text
    lines, now, fresh = [], "", True
    for t in tokens:
        if t == "\n":
            lines.append(now)
            now, fresh = "", True
        elif width(now) + width(t) <= box + box * 1e-9:
            now, fresh = now + t, False
        elif fresh:
            for c in t:
                if now and width(now + c) > box + box * 1e-9:
                    lines.append(now)
                    now = ""
                now, fresh = now + c, False
        else:
            lines.append(now.rstrip(" "))
            now = t.lstrip(" ")
            fresh = not now
    return [*lines, now] if not fresh else lines


CASES = [
    ("Hello world again", 40, 10, ["Hello", "world", "again"]),
    ("日本語テスト", 30, 10, ["日本語", "テスト"]),
    ("Hello 世界", 40, 10, ["Hello 世", "界"]),
    ("abcdefghij kl", 25, 10, ["abcde", "fghij", " kl"]),
    ("a abcdefghij kl", 25, 10, ["a", "abcdefghij", "kl"]),
    ("one\ntwo\n\nthree\n", 100, 10, ["one", "two", "", "three"]),
    ("", 10, 10, []),
    (None, 10, 10, []),
    ("any text", 0, 10, ["any text"]),
    ("ab cd", 15, -1, ["ab", "cd"]),
    ("ab  cd", 15, 10, ["ab", "cd"]),
    ("\n\n", 15, 10, ["", ""]),
]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, float(b), float(s)) for i, (t, b, s) in enumerate(rows)], "id long, text string, box double, size double")
    got = {}
    for r in wrapping.wrapped(df.repartition(3)).orderBy("id", "line").collect():
        got.setdefault(r.id, []).append(r.text)
    return [got.get(i, []) for i in range(len(rows))]


def test_known_lines(spark):
    assert check(spark, [c[:3] for c in CASES]) == [c[3] for c in CASES] == [plain(*c[:3]) for c in CASES]


def test_against_token_by_token(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ab  cd\n日本 語e") for _ in range(rng.randint(1, 60))), rng.choice([3, 10, 25, 40, 77.5]), rng.choice([10, 10.5, 0])) for _ in range(400)]
    rows.append((" ".join("word" * (i % 7) for i in range(4000)), 130, 10))
    got = check(spark, rows)
    for row, lines in zip(rows, got):
        assert lines == plain(*row), row


@pytest.mark.parametrize(("lang", "n", "height", "cell", "want"), [("ja", 3, 100, False, 1.1), ("ja", 10, 105, False, 1.05), ("en", 50, 20, False, 1.0), ("xx", 1, 50, True, 1.1), ("ar", 9, 1, False, 1.0), ("zh-CN", 4, 0, False, 1.4), ("ru", 4, 400, False, 1.0)])
def test_line_heights(spark, lang, n, height, cell, want):
    e = wrapping.line_height("lang", "n", "size", "width", "height", "cell")
    df = spark.createDataFrame([(lang, n, 10.0, 50.0, float(height), cell)], "lang string, n long, size double, width double, height double, cell boolean").coalesce(1)
    assert df.selectExpr(f"{e} AS h").first().h == pytest.approx(want)


def test_placing(spark):
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "id long, line long, text string")
    boxes = spark.createDataFrame([(1, 10.0, 100.0, 60.0, 200.0, 10.0, "ja", False, 14.0, 190.0), (2, 5.0, 50.0, 60.0, 90.0, 0.0, "en", True, None, None)], "id long, x0 double, y0 double, x1 double, y1 double, size double, lang string, is_cell boolean, first_x double, first_y double")
    got = sorted((r.id, r.line, r.x, round(r.y, 6)) for r in wrapping.placed(lines, boxes).collect())
    assert got == [(1, 0, 14.0, 190.0), (1, 1, 10.0, 179.0), (2, 0, 5.0, 50.0)]
