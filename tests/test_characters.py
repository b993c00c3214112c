"""Counting, joining and dropping of characters: one pass over runs, the same results as one by one."""

import unicodedata

from glossweave.functions import text as t
from glossweave.functions.dialect import BLANKS, Spark
from glossweave.plans import catalog

DIR = "/root/testdata/sf0.001"
TEXTS = [None, "", "-", "--a--B1--", " 　a_b/c\\d-e\x0b\x85f ", "漢字かなカナ㈱ abc", "𠮷野家で𠮷", "ÀéĀ x", "。、！?...,", "\n\n", "a" * 3000, "한글 汉语测试 丂丄", "Ａ１", "é-_-é", "٣\t4"]


def _values(spark, **columns):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string").selectExpr("i", *[f"{v} AS {k}" for k, v in columns.items()])
    return [r.asDict() for r in df.orderBy("i").collect()]


def test_characters_one_by_one(spark):
    d = Spark()
    got = _values(spark, slug=t.slug(d, "text"), code=t.folded_code(d, "text"), ascii=d.count("text", r"[\x{00}-\x{7F}]"), meaningful=t.meaningful(d, "text"), rare=t.rare_ideographs(d, "text"))
    for x, r in zip(TEXTS, got, strict=True):
        s = x or ""
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in s).split()
        kept = [c for c in s if c not in BLANKS]
        rare = [c for c in s if "一" <= c <= "鿿" and not _encodes(c)]
        assert r["slug"] == ("-".join(words) or "run") and r["code"] == "".join(c for c in s.lower() if c not in BLANKS + "_/\\-"), s
        assert r["ascii"] == (None if x is None else sum(c.isascii() for c in s)) and r["rare"] == len(rare), s
        assert r["meaningful"] == "".join(c for c in kept if not unicodedata.category(c).startswith("P")), s


def _encodes(c):
    try:
        return bool(c.encode("shift_jisx0213"))
    except UnicodeEncodeError:
        return False


def test_profile_in_steps_is_the_profile(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    steps, plain = catalog.queries()["character_profile"](spark, str(tmp_path)), catalog.spark_query("character_profile")(spark, str(tmp_path))
    assert steps.dtypes == plain.dtypes
    assert sorted(map(tuple, steps.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_no_list_of_single_characters(spark):
    for name in ("character_profile", "text_measures", "text_names"):
        plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "size(regexp_extract_all" not in plan, name
        # Nor is the negated class of what lies between words.
        assert "[^A-Za-z0-9]" not in plan, name


def test_rules_of_texts_without_their_marks(spark):
    """Escapes and citations are looked for only where a backslash or a label is; this changes nothing."""
    import random

    from glossweave.functions import forms as f
    from glossweave.functions.dialect import Oracle

    class Plain(Spark):
        where_found = Oracle.where_found

    rng = random.Random(4)
    bits = ["a", " ", "\n", "\\n", "\\t", "\\r\\n", "C:\\new\\t ", "Glossary", "glossary.csv", ".", ")", "\u2028", "\x85", "\x01", "\u3000", "\r", "text"]
    texts = ["", "plain \n \n", "\x01\nx", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    columns = [[f"{f.unescaped(d, 'text')} AS u", f"{f.without_citations(d, 'text', ['glossary.csv', 'glossary'])} AS c"] for d in (Spark(), Plain())]
    got, want = ([tuple(r) for r in df.selectExpr("i", *c).orderBy("i").collect()] for c in columns)
    assert got == want
    assert all(a.count("CASE WHEN regexp_like(") > b.count("CASE WHEN regexp_like(") for a, b in zip(*columns, strict=True))
