"""Examples with known answers, evaluated by Spark."""

import pytest

from glossweave.functions import numbers as n
from glossweave.functions import replies as r
from glossweave.functions import text as t
from glossweave.functions.dialect import Spark

D = Spark()


@pytest.fixture(scope="module")
def value(spark):
    def run(make, *args):
        df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
        return df.selectExpr(f"{make(D, *[f'c{i}' for i in range(len(args))])} AS v").first()[0]

    return run


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (t.is_expected_english, "Hello world", True), (t.is_expected_english, "123,456", True), (t.is_expected_english, "こんにちは", False), (t.is_expected_english, "汉语测试", False),
        (t.is_expected_english, "한국어", False), (t.is_expected_english, "A・B", False), (t.is_expected_english, "売上高", False),
        (t.is_expected_japanese, "こんにちは", True), (t.is_expected_japanese, "売上高", True), (t.is_expected_japanese, "123,456", True), (t.is_expected_japanese, "Hello world", False),
        (t.is_expected_japanese, "汉语测试", False), (t.is_expected_japanese, "한국어 테스트", False),
        (t.detect_reason, "汉语测试", "cjk_unencodable"), (t.detect, "需要提高效率，降低成本。", "日本語"), (t.detect_reason, "", "empty"), (t.detect, "カタカナ", "日本語"), (t.detect, None, "日本語"),
        (t.is_toc_line, "経営成績等の概況…………… 2", True), (t.is_toc_line, "セグメント情報等………11", True), (t.is_toc_line, "第2四半期の売上高は", False), (t.is_toc_line, "売上高 1,234 百万円", False),
        (t.toc_title, "経営成績等の概況…………… 2", "経営成績等の概況"), (t.toc_page, "経営成績等の概況…………… 2", "2"),
        (t.is_continuation, "その達成を", True), (t.is_continuation, "情報に基づき、", True), (t.is_continuation, "ありません。", False), (t.is_continuation, "(百万円未満四捨五入)", False),
        (t.is_date_like, "2024-01-05", True), (t.is_date_like, "2024／1／5\n", True), (t.is_date_like, "2024-01-05x", False),
        (t.should_translate_cell, "2024/03/31", True), (t.should_translate_cell, "USA", False), (t.should_translate_cell, "△1,731,269", False), (t.should_translate_cell, "売上高", True),
        (t.should_translate_cell, "(cid:12)", True), (t.should_translate_cell, None, False), (t.should_translate_paragraph, "ABC-123", False), (t.should_translate_pdf, "3月", True),
        (t.is_japanese_only, "Hello こんにちは", False), (t.is_japanese_only, "売上げ", True), (t.is_japanese_only, "日本語", False), (t.should_translate_generic, "1,2 - 3.", False),
        (t.estimated_tokens, " abcd日本 ", 4), (t.estimated_tokens, "", 0), (t.slug, " a b/c! ", "a-b-c"), (t.slug, "！", "run"), (t.safe_name, 'a/b:c?', "a_b_c_"), (t.preview, "x" * 60, "x" * 50 + "..."),
        (t.without_fences, "```json\n{}\n```", "{}"), (t.clean_item, "[[ID:3]] done [a | Excel](http://x)", "done"), (t.negative_markers, "▲1,200 △", "(1,200) -"),
        (t.looks_chinese, "需要提高效率，降低成本。", True), (t.looks_chinese, "売上高", False), (t.separator_for, "日本a", ""), (t.style_name, " Concise ", "concise"), (t.style_name, "x", "minimal"),
        (t.is_japanese, "日本語ab", True), (t.is_japanese, "日" + "x" * 40 + "日" * 400, False), (t.is_japanese, "...", False),
    ],
)
def test_texts(value, make, text, want):
    assert value(make, text) == want


@pytest.mark.parametrize(
    ("make", "source", "out", "want"),
    [
        (n.needs_negative, "▲5", "-5", True), (n.needs_negative, "▲5", "(5)", False), (n.needs_negative, "5", "-5", False), (n.needs_k, "3万円", "30k yen", False), (n.needs_k, "3万円", "30,000", True),
        (n.needs_month, "1月", "Jan. 2024", False), (n.needs_month, "5月", "may", True), (n.needs_month, "5月", "in May", False), (n.needs_oku, "2兆円", "20,000 oku yen", False),
        (n.needs_oku, "2兆円", "2 trillion yen", True), (n.is_incomplete, "x" * 40, "Yes.", True), (n.is_ellipsis, "内容", "…", True), (n.fixed_negatives, "△3", "-3 and (−4)", "(3) and (4)"),
        (n.should_retry, "内容です", "内容です", True), (n.should_retry, "内容", "Content", False), (n.should_retry, "Hello", "안녕", True), (n.is_unit_term, "億円", "x", True),
        (t.join_separator, "word-", "next", ""), (t.join_separator, "日本", "語", ""), (t.join_separator, "a", "b", " "), (t.join_separator, "end.", "Next", " "),
    ],
)
def test_pairs(value, make, source, out, want):
    assert value(make, source, out) == want


def test_amounts(value):
    assert value(n.oku_amounts, "2兆5,000億円と300億円と2兆5,000億円") == [300, 25000]
    assert value(n.k_amounts, "12万円と3千台") == [3, 120]
    assert value(n.months_of, "12月と1月と13月") == [1, 12]
    assert value(lambda d, x: n.yen_words(d, f"CAST({x} AS BIGINT)"), "1234500006789") == "1兆2,345億6,789円"
    assert value(lambda d, x: n.oku_words(d, f"CAST({x} AS BIGINT)"), "25300") == "2兆5,300億円"


def test_replies(value):
    assert value(r.target, "a <target> x </target>") == "x"
    assert value(r.target, "a <target> open") == "open"
    assert value(r.without_thoughts, "<think>a</think> b") == "b"
    assert value(r.json_part, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert value(r.failure, '{"a": [1') == "truncated_json"
    assert value(r.chat_content, '{"choices": [{"message": {"content": "hi"}}]}') == "hi"
    assert value(lambda d, x: d.join(r.items_by_id(d, x, 2), "|"), '{"items": [{"id": 1, "translation": "a"}, {"id": "2", "translation": "b"}]}') == "a|b"
