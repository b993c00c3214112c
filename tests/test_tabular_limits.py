import random
from functools import lru_cache

import pytest

from glossweave.operators import limits, tabular

SCHEMA = "id long, text string, columns long, rows long, lead array<long>, trail array<long>"


def searched(text, columns, rows, lead, trail):
    """The least cost over every cut into rows of the right number of tabs."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").rstrip("\n").split("\n")
    tabs = [x.count("\t") for x in lines]

    def cost(a, b, r):
        part = tabs[a : b + 1]
        first = next(i for i, t in enumerate(part) if t)
        last = next(i for i, t in enumerate(reversed(part)) if t)
        at = lambda h: h[r] if r < len(h) else 0
        return 3 * abs(first - at(lead)) + (0 if r == rows - 1 else 2 * abs(last - at(trail)))

    @lru_cache(None)
    def best(a, r):
        if r == rows:
            return 0 if a == len(lines) else None
        found = [cost(a, b, r) + rest for b in range(a, len(lines)) if sum(tabs[a : b + 1]) == columns - 1 and (rest := best(b + 1, r + 1)) is not None]
        return min(found, default=None)

    return best(0, 0)


def run(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], SCHEMA)
    out = {}
    for r in tabular.parsed(df).orderBy("id", "row").collect():
        out.setdefault(r.id, []).append((list(r.cells), r.cost))
    return [out.get(i) for i in range(len(cases))]


def test_cost_is_the_least_of_all_cuts(spark):
    rng = random.Random(6)
    cases = []
    for _ in range(300):
        columns, rows = rng.randint(2, 4), rng.randint(1, 4)
        cells = [["\n".join("x" * rng.randint(0, 2) for _ in range(rng.randint(1, 3))) for _ in range(columns)] for _ in range(rows)]
        text = "\n".join("\t".join(r) for r in cells)
        if rng.random() < 0.3:
            text = text.replace("\t", "\n", 1) if rng.random() < 0.5 else text + "\n\n"
        hint = lambda: [rng.randint(0, 3) for _ in range(rng.choice([rows, max(0, rows - 1)]))]
        cases.append((text, columns, rows + (rng.random() < 0.1), hint(), hint()))
    for case, got in zip(cases, run(spark, cases)):
        want = searched(*case)
        assert (got is None) == (want is None), case
        if got:
            assert sum(c for _, c in got) == want and all(len(cells) == case[1] for cells, _ in got), case
            assert "\n".join("\t".join(cells) for cells, _ in got) == case[0].rstrip("\n")


def test_known_tables(spark):
    cases = [("A\tB\nC\tD", None, None, None, None), ("foo\nbar\tbaz\nx\ty", 2, 2, [1, 0], [0, 0]), ("a\tHe said \"Hi\"", None, None, None, None), ("no table", None, None, None, None), ("a\tb\tc\nd\te", None, None, None, None), ("a\tb\nmore\nc\td", None, None, None, None), (None, 2, 1, [], [])]
    got = run(spark, cases)
    assert [g and [c for c, _ in g] for g in got] == [[["A", "B"], ["C", "D"]], [["foo\nbar", "baz"], ["x", "y"]], [["a", 'He said "Hi"']], None, None, [["a", "b\nmore"], ["c", "d"]], None]


def test_hints_and_paste(spark):
    source = spark.createDataFrame([(1, "foo\nbar\tbaz\r\nx\ty\nz\r\n"), (2, "A\tB\nC\tD\n"), (3, "none"), (4, None), (5, "a\tb\r\nc")], "id long, text string")
    got = {r.id: tuple(r)[1:] for r in tabular.hints(source).collect()}
    assert got == {1: (2, 2, [1, 0], [0, 1]), 2: (2, 2, [0, 0], [0, 0]), 5: (2, 2, [0, 0], [0, 0])}
    rows = tabular.parsed(source.join(tabular.hints(source), "id").select("id", "text", "columns", "rows", "lead", "trail"))
    text = {r.id: r.text for r in tabular.pasted(rows).collect()}
    assert text == {1: '"foo\nbar"\tbaz\r\nx\t"y\nz"', 2: "A\tB\r\nC\tD"}
    quoted = tabular.pasted(spark.createDataFrame([(1, 0, ["a", 'He said "Hi"'])], "id long, row long, cells array<string>")).first().text
    assert quoted == 'a\t"He said ""Hi"""'


@pytest.mark.parametrize(("context", "want", "estimated"), [(2048, 300, True), (8192, 1000, False), (3000, 500, True), (100, 300, True), (0, 1000, False)])
def test_limits(spark, context, want, estimated):
    texts = spark.createDataFrame([(1, i, "あ" * 100) for i in range(20)] + [(2, 0, " 　"), (2, 1, None)], "g long, i long, t string")
    got = {r.g: r for r in limits.context_limits(texts, "g", "i", "t", 1000, context, 1024, head="頭" * 100, joint="").collect()}
    assert (got[1].limit, got[1].estimated) == (want, estimated) and (got[2].limit, got[2].estimated) == (1000, False)


@pytest.mark.parametrize(("configured", "want"), [(1000, ([1000, 500, 300], 300)), (200, ([200], 200)), (100_000, ([100_000, 50_000, 25_000, 12_500, 6_250, 3_125], 1_562))])
def test_candidates(configured, want):
    assert limits.candidates(configured) == want


def test_sample_takes_one_text_at_least_and_fifty_at_most(spark):
    texts = spark.createDataFrame([(1, 0, "x" * 5000), (1, 1, "y")] + [(2, i, "z") for i in range(80)], "g long, i long, t string")
    got = {r.g: (r.limit, r.texts, r.tokens) for r in limits.context_limits(texts, "g", "i", "t", 1000, 10**6, 10, head="h", item="concat(i, '. ')").collect()}
    assert got == {1: (1000, 1, (1 + 3 + 5000 + 2) // 3), 2: (1000, 50, (1 + 9 * 3 + 41 * 4 + 50 + 49 + 2) // 3)}
