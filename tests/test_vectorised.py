import pytest

from glossweave.functions import vectorised as v


def test_folding():
    assert v.folded("ＡＢＣ\u3000Straße") == "abc strasse"
    assert v.bare(" Ａ b\n") == "ab" and v.bare(None) == ""
    assert v.looks_untranslated("ＡＢ c", "abC") and not v.looks_untranslated("", "")
    assert v.similarity("abcd", "abcx") == 0.75


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a":1,}', '{"a": 1}'), ("```json\n[1, 2,]\n```", "[1, 2]"), ("{'a': True}", '{"a": true}'), ("x {\"a\": 1} y", '{"a": 1}'), ("none", None), ("{bad", None)],
)
def test_loose_json(text, want):
    assert v.loose_json(text) == want


@pytest.mark.parametrize(("text", "want"), [('{"a": [1', True), ('{"a": "x', True), ("{}", False), ("[}", False), ("", False), ('{"a": "}"', True), ('{"a": "\\""}', False)])
def test_truncated(text, want):
    assert v.is_truncated(text) is want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("1.2.10", "1.2.9", True), ("v1.0", "1.0.0", False), ("1.0", "1.0-rc.1", True), ("1.0-rc.2", "1.0-rc.1", True), ("20240201", "20240131", True), ("1.0", "1.0", False), ("b", "a", True), ("1.0+x", "1.0+y", False)],
)
def test_versions(a, b, want):
    assert v.is_newer(a, b) is want


def test_long_pieces():
    text = "a" * 150 + "。" + "b" * 100 + "、" + "c" * 40 + " " + "d" * 500
    got = v.long_pieces(text, 200)
    assert "".join(got) == text and all(len(x) <= 200 for x in got) and got[0].endswith("。")
    assert v.long_pieces("", 100) == [] and v.long_pieces("x" * 250, 100) == ["x" * 100, "x" * 100, "x" * 50]


def test_amounts_and_formulas():
    assert v.yen_in_english("2兆5,000億円と▲300億円と12万円") == "¥2,500.0 billionと-¥30.0 billionと¥120k"
    text, held = v.protect_formulas(r"$$a$$ and $b$ and \frac{x}")
    assert text == "{v0} and {v1} and {v2}"
    assert v.restore_formulas("[v1] {v0} (v2) {v9}", held) == r"$b$ $$a$$ \frac{x} {v9}"


def test_wrap():
    assert v.wrapped("aa bb cc", 25, 10) == ["aa bb", "cc"]
    assert v.wrapped("日本語", 20, 10) == ["日本", "語"]


def test_as_udf(spark):
    df = spark.createDataFrame([("ＡＢ", "ab"), (None, "")], "a string, b string")
    got = df.select(v.udf(v.folded, "string")("a").alias("f"), v.udf(v.looks_untranslated, "boolean")("a", "b").alias("u")).collect()
    assert [tuple(r) for r in got] == [("ab", True), ("", False)]


def test_changes_recipients_and_pasting():
    from glossweave.functions import vectorised as v

    assert v.marked_changes("a b c", "a x c\n<") == 'a <span class="diff-added">x</span> c<span class="diff-added"><br>&lt;</span>'
    assert v.marked_changes("", "") == "" and v.marked_changes(None, "a") == '<span class="diff-added">a</span>'
    assert v.recipients("A B <a@x.org>; b@x.org (Bo)\nc@x.org <c@x.org>; A B <a@x.org>") == "A B <a@x.org>; Bo <b@x.org>; c@x.org"
    assert v.recipients("d@x.org, Eve e@x.org") == "d@x.org; Eve <e@x.org>" and v.recipients('"X, Y" <f@x.org>') == '"X, Y" <f@x.org>'
    assert v.recipients(None) == "" and v.recipients("nobody") == "nobody"
    assert v.pasted('a\tHe said "Hi"\nb') == 'a\t"He said ""Hi"""\r\nb'


def test_formula_marks_in_the_text_itself():
    for text in ("$a {v0}$", "{v0} and $b$", r"$$x \frac{1}{2}$$ and \cmd{y $z$}", "{v3} $a$ [v0]"):
        out, held = v.protect_formulas(text)
        assert isinstance(v.restore_formulas(out, held), str)
    out, held = v.protect_formulas(r"\cmd{y} and $z$")
    assert v.restore_formulas(out, held) == r"\cmd{y} and $z$"
