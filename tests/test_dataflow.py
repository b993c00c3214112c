"""The dataflow, matching and reading order against plain Python."""

import random

from pyspark.sql import functions as F

from glossweave.operators import reading, terms, translating
from glossweave.plans import dataflow, relational
from glossweave.sources import samples


def test_reading_order_of_a_page():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 12)
        boxes = [(i, float(rng.randint(0, 9))) for i in range(n)]
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 14))} - {(i, i) for i in range(n)})
        waits = {i: sum(b == i for _, b in edges) for i, _ in boxes}
        left, out = dict(boxes), []
        while True:
            free = sorted((r, i) for i, r in left.items() if waits[i] == 0)
            if not free:
                break
            i = free[0][1]
            out.append(i)
            del left[i]
            for a, b in edges:
                waits[b] -= a == i
        out += [i for _, i in sorted((r, i) for i, r in left.items())]
        assert reading.in_order(boxes, edges) == out


def test_reading_order_rows(spark):
    from glossweave.plans import pages

    got = pages.reading_order(spark, "/root/testdata/sf0.001")
    boxes = relational.boxes(spark, "/root/testdata/sf0.001")
    assert got.count() == boxes.count() and got.groupBy("page").agg(F.max("place").alias("m"), F.count("box").alias("n")).where("m <> n - 1").count() == 0


def test_lru(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice("abcdefg")) for g in range(5) for i in range(80)]
    for capacity in (0, 1, 3):
        want, held = {}, {}
        for g, i, k in rows:
            h = held.setdefault(g, [])
            want[g, i] = k in h
            held[g] = ([x for x in h if x != k] + [k])[-capacity:] if capacity else []
        got = translating.lru_hits(spark.createDataFrame(rows, "g int, i int, k string").repartition(3), "g", "i", "k", capacity)
        assert {(r.g, r.i): r.hit for r in got.collect()} == want


def test_failed_batches_are_halved(spark):
    rows = [(1, i, ("t%d " % i) * 30) for i in range(12)] + [(2, 0, "same"), (2, 1, "same"), (2, 2, "other")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    got = {(r.conv_id, r.turn): r for r in translating.translated(df, "conv_id", "turn", "text", dataflow.client, 900).collect()}
    assert len(got) == len(rows) and all(r.out == r.text[::-1] for r in got.values() if r.out)
    assert {got[1, i].depth for i in range(12)} & {1, 2} and got[2, 0].out == got[2, 1].out == "emas"


def test_terms(spark):
    glossary = spark.createDataFrame([(0, "AI", "x"), (1, "e-mail", "電子メール"), (2, "売上高", "net sales"), (3, "円", ""), (4, "AI", "later"), (5, "22万円", "220k yen"), (6, "GPU", "")], "idx long, source string, target string")
    docs = spark.createDataFrame([(1, "AIを使う"), (2, "RAIN only"), (3, "an Email"), (4, "Net  Sales"), (5, "22万円"), (6, None), (7, "gpu-ai")], "doc_id long, text string")
    got = {r.doc_id: r.terms for r in terms.matched(docs, glossary, 2).collect()}
    assert got == {1: "AI", 3: "e-mail", 4: "売上高", 5: "22万円,円", 7: "GPU,AI"}
    assert [tuple(r) for r in dataflow.glossary_load(spark, "").orderBy("idx").collect()] == samples.GLOSSARY_ROWS


def test_exact_stats_of_hard_groups(spark):
    """Single values, ties, two values, outliers that squeeze the rest into one step."""
    import statistics

    rng = random.Random(4)
    groups = {"one": [3.0], "ties": [2.0] * 50, "two": [1.0, 9.0], "far": [rng.random() for _ in range(200)] + [1e12], "many": [rng.gauss(0, 1) for _ in range(999)], "few": [1.0, 2.0, 2.0, 7.0]}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [("one", None)], "g string, v double")
    from glossweave.operators import batching

    got = {r.g: r for r in batching.exact_stats(df, "g", "v").collect()}
    for g, x in groups.items():
        p95 = statistics.quantiles(x, n=20)[-1] if len(x) >= 20 else max(x)
        assert (got[g].n, got[g].p50, got[g].p95) == (len(x), round(statistics.median(x), 6), round(p95, 6))


def test_chunks(spark):
    from glossweave.operators import batching

    df = spark.createDataFrame([(1, "One. Two! Three"), (2, "x" * 25), (3, None), (4, " \n")], "i int, t string")
    got = {r.i: r.c for r in df.select("i", batching.chunked(F.col("t"), ".!", 10).alias("c")).collect()}
    assert got == {1: ["One. Two!", "Three"], 2: ["x" * 10, "x" * 10, "x" * 5], 3: [], 4: []}


def test_reading_order_of_many_pages(spark):
    """Pages meet Python as rows of a batch, not as a group each; pages of no edge, of a cycle and of many boxes."""
    import random

    from glossweave.operators import reading

    rng, boxes, edges = random.Random(3), [], []
    for page in range(300):
        n = rng.choice([1, 2, 7, 60])
        boxes += [(page, b, float(rng.randrange(50)), float(rng.randrange(9))) for b in range(n)]
        edges += [(page, *rng.sample(range(n), 2)) for _ in range(rng.randrange(2 * n))] if n > 1 else []
    got = reading.ordered(spark.createDataFrame(boxes, "page long, box long, x0 double, y0 double").repartition(5), spark.createDataFrame(edges, "page long, box long, next long").repartition(3))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(p, b, i) for p in range(300) for i, b in enumerate(reading.in_order([(b, x + y) for q, b, x, y in boxes if q == p], [(a, c) for q, a, c in edges if q == p]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = reading.ordered(spark.createDataFrame([], "page long, box long, x0 double, y0 double"), spark.createDataFrame([], "page long, box long, next long"))
    assert none.count() == 0
