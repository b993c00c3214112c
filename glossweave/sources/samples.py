"""Small built-in texts for what a corpus in European languages cannot exercise.

Queries add these rows, under negative ids, to the rows of the tables.
"""

from __future__ import annotations

TEXTS = [
    "こんにちは", "売上高", "123,456", "Hello world", "汉语测试", "需要提高效率，降低成本。", "한국어 테스트", "A・B", "2024/03/31", "31-12-2024", "2024／1／5",
    "△1,731,269", "35,555 1,731,269", "name@example.com", "https://example.com/a?b=c", "ABC-123", "12 %", "¥1,200.50", "USA", "FY26/3", "Helloこんにちは", "3月", "(cid:123)",
    "経営成績等の概況…………… 2", "セグメント情報等………11", "第2四半期の売上高は", "その達成を", "情報に基づき、", "含まれます。", "word-", "End of sentence.", "",
    "   ", "2兆5,000億円の売上と300億円の利益、12万円、3千台", "▲1,200百万円（前年比△5.3%）", "1月と12月、13月に発表", "ｱｲｳｴｵ", "第一段落です。\n\n第二段落です。これは長い文です！\n改行後。", "```json\n{\"a\": 1}\n```",
    "===INPUT_TEXT===\nbody\n===END_INPUT_TEXT===", "[[ID:3]] answer glossary.csv", "see [Sheet | Excel](http://x)", "**bold** <tag> \"q\"", "a/b:c*d?.txt", "Col1\tCol2\nv1\tv2", "１２３４", "円安が進行した場合の影響は軽微である",
]

PAIRS = [
    ("売上は1月に▲5億円", "Sales were (5) oku yen in Jan."), ("売上は1月に▲5億円", "Sales were -5 oku yen in January"), ("3万円と2千円", "30k yen and 2k yen"), ("3万円と2千円", "30,000 yen"),
    ("2兆円の投資", "20,000 oku yen"), ("2兆円の投資", "2 trillion yen"), ("5月と6月の実績", "May and Jun. results"), ("5月と6月の実績", "may results"), ("これは長い文章であり、翻訳されるべき内容が四十文字以上含まれているはずの文です。", "Yes."),
    ("内容", "..."), ("内容", "<translation>"), ("内容です", "内容です"), ("Hello", "안녕"), ("△3 と △4", "-3 and (−4)"), ("本文", ""), ("▲7", "▲7 points"),
]

REPLIES = [
    '{"items": [{"id": 1, "translation": "a"}, {"id": 2, "translation": "b"}]}', '```json\n{"translation": "hello", "explanation": ""}\n```', '{"a": [1, 2', "", "no json at all", "{}", "[1, 2]", "<target>x y</target>", "pre <target>open end",
    "<think>plan</think>\nanswer", 'text {"translation": "in the middle"} tail', '{"choices": [{"message": {"content": "hi"}}]}', "[[ID:1]] first\n[[ID:2]] second line\nmore", "   ", '{"x": {"y": "}"}}',
]


def values(rows: list[tuple[str, ...]] | list[str], dialect: object) -> str:
    """A VALUES list with ids -1, -2, ..."""
    out = []
    for i, r in enumerate(rows):
        fields = (r,) if isinstance(r, str) else r
        out.append(f"({-1 - i}, {', '.join(dialect.text(f) for f in fields)})")
    return "VALUES " + ", ".join(out)

AMOUNTS = [
    "売上高は▲10億円。22万円。3月。", "2兆2,385億円(前年同期比1,554億円減)", "4兆279億円", "8,021億円と▲50 と △1.5億円、3月と11月", "5万3千円と1,200台と2千台", "利益 >= 5% かつ x<y → 約~10", "¥450 billion and -¥1.25bn yen",
    "450 billion yen", "(450) billion yen", "▲450 billion", "450bn", "4,500 oku yen", "1.2 trllion yen and ¥3 trillion", "12.5 thousand yen, 3 million, ¥1,234.5 million", "Okinawa is different from oku.", "22,385 oku yen",
    "1兆円と1兆と10,000億", "▲3万円 △4千台 -2億 +5億円", "1.5万円と0.5千台 兆5万", "売上 5億 売上 5億", "-¥0.0000001 billion", "100,000,000 billion", "9,999,999,999,999,999 billion yen", "¥9999999999999 bn", "9月 10月 13月 0月", "a>=b, c ≧ d", "↑ ↓ → ~", "no amounts here",
]

REPAIRS = [
    ("売上は539億円", "Sales were 539 billion yen"), ("2兆2,385億円", "22,385 oku yen"), ("2兆2,385億円", "2.2385 trillion yen"), ("4兆279億円", "4.279 trillion yen and 4,279 billion yen"), ("539億", "¥53.9 billion, 1.2bn"),
    ("▲10億円", "(10) oku yen"), ("22万円と3千台", "220,000 yen, 3,000 units and 22 man yen"), ("5万", "50,000. and 50,000, x50,000"), ("1月と9月と3月", "January, Sept and march and March"), ("5月", "may be MAY"), ("12月", "Dec. and December"),
    ("1兆と2兆", "1 trillion and 2,000 billion"), ("1億", "10 bn"), ("", "5 oku"), ("3億", "3億 left"), ("文", "1,000 billion yen and (2.5) trillion, 30 oku yen, ¥7 bn"), ("4兆279億円と5兆", "5,000 billion"), ("2千", "2 sen-yen 2 sen"),
]

ECHO = "Translate the items below into English and return JSON only, one object with items, each of which has an id and a translation, in their order, nothing else."

MORE_REPLIES = [
    '{"items": [{"id": 2, "translation": "say \\"hi\\"\\nand [1]"}, {"id": "1", "translation": "a"}, {"id": 2, "translation": "last"}, {"id": 0, "translation": "x"}, {"id": 9, "translation": "y"}]}',
    '{"items": [{"id": 1, "translation": 5}, {"id": "x"}, 7,],}', '{"items": []}', '{"translation": "  "}', '{"translation": 5}', '{"translation": "t", "explanation": "why"}', "[[ID:2]] see [Sheet] [1]\n[[ID:1]] one\n[[ID:2]] again", "1. first\n2) second\n(x)\n4: fourth",
    "[[ID:1]]\n[[ID:3]] three", ECHO + "\n1. only", ECHO[:130] + " tail\n2: two", "Answer: " + ECHO + " x", "<think>open only\n\nafter the gap", "<think>never closed", "<think>a</think> <think>b</think>\n</think>text",
    "CRITICAL:\n- Do not echo input\n- translation only\nTranslate to English, translation only, do not echo input\nbody", "CRITICAL:\n- keep\nbody", "訳文: これは\n続き\n解説: 理由\n二行", "# Translation\nhello\nExplanation\nbecause", "translation:", "plain text",
    '{"options":[{"style":"concise","translation":"short","explanation":"e"},{"style":"standard","translation":"long \\"q', '{"translation": "unfinished \\', '"translation" : "x", "y": 1', "[standard]\n訳文: long\n解説: z\n[Minimal] m ---\n## [concise] c\n[minimal] again", "翻訳: text\n***", "English Translation hello",
    '{"choices":[{"delta":{"content":"a"}}]}', '{"choices":[{"delta":{"content":[{"text":"p"},"q",{"x":1},3]}}]}', '{"choices":[{"text":"t","reasoning":"r"}]}', '{"choices":[{"message":{"content":"m","reasoning_content":["u","v"]}}]}', '{"choices":[{"delta":{"reasoning":"w"}}]}', '{"choices":[]}',
    '{"a": "x}"', '{"a": [1}', '{"a": "open', '[{"a": {"b": [1, 2', "Return JSON only {\"options\"", "items_json", '{"translation"',
]

FORMS = [
    r"a\nb\tc\r\nd", r"see C:\new\table\n and \n", r"\\server\new x\n", "text glossary", "see glossary.csv.", "glossary\nbody\n glossary.csv glossary ", "glossary", "{v0} and (v1 2) and [ v9 ] and {V3}", "no {v} here", "(v1)(v1)",
    "Available devices:\n  Vulkan0: A\n  vulkan0: B\n Vulkan1 : C", "Vulkan2: x\nnoise\nVULKAN3: y", "log Vulkan5: z\navailable devices:\nVulkan7: w", "unsloth/translategemma-4b", "translategemma", "xtranslategemma", "全角とhalf", "∑x", "+5", "αβ", "ー", "\t\ttab", "°", "",
]

GLOSSARY = ["売上高,net sales", "# a comment,x", "", " AI , artificial intelligence ", '"a,b",c', "alone", "円安,", " ,x"]
#: What loading these gives.
GLOSSARY_ROWS = [(0, "売上高", "net sales"), (3, "AI", "artificial intelligence"), (4, "a,b", "c"), (5, "alone", ""), (6, "円安", "")]
