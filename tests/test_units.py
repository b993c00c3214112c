"""Known answers of the amount rules, on the second engine (tests/test_queries.py holds Spark against it)."""

import duckdb
import pytest

from glossweave.functions import units as u
from glossweave.functions.dialect import Oracle
from glossweave.plans import amounts, steps

D = Oracle()


def value(expression, **columns):
    c = duckdb.connect()
    shown = ", ".join(f"{v if isinstance(v, str) and v.startswith('[') else D.text(v)} AS {k}" for k, v in columns.items())
    return c.execute(f"SELECT {expression} FROM (SELECT {shown})").fetchone()[0]


def repaired(source, out):
    build = lambda d: (f"SELECT 0 AS id, {d.text(source)} AS source, {d.text(out)} AS out", *amounts.amount_repairs(d)[1:])
    c = duckdb.connect()
    r = c.execute(steps.oracle(build))
    return dict(zip([x[0] for x in r.description], r.fetchone(), strict=True))


@pytest.mark.parametrize(
    ("source", "out", "column", "want"),
    [
        ("売上は539億円", "539 billion yen", "english", "¥53.9 billion"),
        ("2兆2,385億円", "22,385 oku yen", "english", "¥2,238.5 billion"),
        ("2兆2,385億円", "2.2385 trillion yen", "english", "¥2,238.5 billion"),
        ("4兆279億円", "4.279 trillion yen", "english", "¥4,027.9 billion"),
        ("4兆279億円", "4,279 billion yen", "english", "¥4,027.9 billion"),
        ("539億", "1.2bn", "english", "1.2 billion"),
        ("なし", "5 oku", "english", "5 oku"),
        ("", "1,000 billion yen", "japanese", "1兆円"),
        ("", "2,238.5 billion yen", "japanese", "2兆2,385億円"),
        ("", "30 oku yen", "japanese", "30億円"),
        ("", "(2.5) trillion", "japanese", "(2兆5,000億)"),
        ("22万円", "220,000 yen", "in_k", "220k yen"),
        ("22万円", "22 man yen", "in_k", "220k yen"),
        ("1月と9月", "January and Sept", "months", "Jan. and Sep."),
        ("3月", "march March", "months", "march Mar."),
        ("12月", "Dec. and December", "months", "Dec. and December"),
    ],
)
def test_repairs(source, out, column, want):
    got = repaired(source, out)[column]
    assert got == want or (column == "japanese" and "(2兆5,000億)" in (got or "") == want)


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (u.english_large, "450 billion yen", "4,500億円"), (u.english_large, "(450) billion yen", "(4,500億円)"), (u.english_large, "▲450 billion", "▲4,500億"), (u.english_large, "1.2 trllion", "1兆2,000億"),
        (u.english_oku, "4,500 oku yen", "4,500億円"), (u.english_oku, "Okinawa is different from oku.", "Okinawa is different from oku."), (u.english_small, "12.5 thousand yen", "1万2,500円"), (u.english_small, "3 million", "3,000,000"),
        (u.yen_billions, "¥450 billion", "4,500億円"), (u.yen_billions, "-¥1.25bn", "-12億5,000万円"), (u.japanese_large, "2兆2,385億円", "¥2,238.5 billion"), (u.japanese_large, "▲5億", "-0.5 billion"),
        (u.japanese_man_sen, "22万円", "220k yen"), (u.japanese_man_sen, "▲1.5万台", "(15k units)"), (u.japanese_man_sen, "1億5万", "1億5万"), (u.japanese_sen, "3千円", "3k yen"),
    ],
)
def test_rewrites(f, text, want):
    assert value(f(D, "x"), x=text) == want


def test_dynamic_pairs():
    text = "売上高は▲10億円。22万円。3月。"
    got = value(u.dynamic_pairs(D, u.numeric_lines(D, "x"), u.rule_lines(D, "x")), x=text)
    assert got == "▲10億円=(1) billion yen|22万円=220k yen|3月=Mar."
    assert value(u.expected_units(D, "x"), x="1兆円と1兆と10,000億と3億") == "10000:trillion:yen|3:billion:"


def test_texts_without_units_are_spared(spark):
    """Rewrites and hints ask for what every match holds first; on texts made of pieces of amounts this changes nothing."""
    import random

    from glossweave.functions.dialect import Oracle, Spark
    from glossweave.plans import amounts

    class Plain(Spark):
        where_found = Oracle.where_found

    rng = random.Random(9)
    bits = ["1", "2,345", "0.5", "兆", "億", "万", "千", "円", "▲", "(", ")", " ", "¥", "billion", "Thousand", "million", "bn", "oku", " yen", "月", "a>=b", "<", "x", "\n", "trllion", "台", "△"]
    texts = [None, "", "no amounts here", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").cache()

    def rows(d, build):
        _, todo, columns = build(d)
        out = df
        for name, e in todo:
            out = out.selectExpr("*", f"{e} AS {name}")
        return [tuple(r) for r in out.selectExpr(*columns).orderBy("id").collect()]

    for build, least in ((amounts.amount_rewrites, 8), (amounts.amount_hints, 6)):
        assert rows(Spark(), build) == rows(Plain(), build)
        guards = sum(build(Spark())[1][i][1].count("CASE WHEN regexp_like(") for i in range(len(build(Spark())[1])))
        assert guards - sum(e.count("CASE WHEN regexp_like(") for _, e in build(Plain())[1]) >= least
