import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import exact_dedup, line_dedup, minhash_dedup, recompression, suffix_dedup

BLANK = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_exact_decisions(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    want = Counter()
    for i, t, *_ in rows:
        g = groups[BLANK.sub("", t or "")]
        keep = min(g)[1]
        want[(i, keep, len(g), i == keep, sha(BLANK.sub("", t or "")))] += 1
    got = Counter(map(tuple, exact_dedup.decisions(docs).collect()))
    assert got == want


def test_exact_rows_keep_columns(docs, rows):
    more = docs.withColumn("maybe", F.lit("x")).withColumn("h", F.lit(1))
    got = exact_dedup.drop_duplicates(more)
    assert got.columns == more.columns
    assert got.count() == len({BLANK.sub("", t or "") for _, t, *_ in rows})


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
    return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def test_minhash_components(docs, rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = Counter((i, len(sets[i]), find(i), i == find(i)) for i, *_ in rows)
    assert Counter(map(tuple, minhash_dedup.near_duplicates(docs, width=2).collect())) == want


def test_minhash_long_lists_in_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SHORT", 4)
    test_minhash_components(docs, rows)


@pytest.mark.parametrize("percent", [60, 90])
def test_minhash_other_thresholds(spark, percent):
    """Pairs at, just above and just below other thresholds, and small sets."""
    rng, rows, want = random.Random(percent), [], {}
    for k in range(60):
        w = ["w%d_%d" % (k, i) for i in range(rng.choice([3, 4, 9, 40, 300]))]
        v = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 6))):
            v[rng.randrange(len(v))] = "x%d" % rng.randrange(10**6)
        a, b = set(zip(w, w[1:])), set(zip(v, v[1:]))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if 100 * len(a & b) >= percent * len(a | b) else 2 * k + 1}
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and len(set(want.values())) not in (60, 120)
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50)


def test_minhash_repeated_rows(spark):
    """A row 40 times over, an id with a near copy and a text of its own, null ids, and clashing extra columns."""
    rng = random.Random(3)
    one, other = _text(rng, 100), _text(rng, 100)
    near = one.replace(one.split()[50], "changed", 1)
    rows = [(1, one)] * 40 + [(7, near)] * 40 + [(7, other)] + [(None, near), (None, other + " more"), (None, None)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, d long, h long, component long")
    got = Counter(map(tuple, minhash_dedup.near_duplicates(df, width=2).select("doc_id", "component_id", "kept").collect()))
    assert got == {(1, 1, True): 40, (7, 1, False): 40, (7, 7, True): 1, (None, 1, False): 1, (None, 7, False): 1, (None, None, False): 1}
    kept = minhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(1, one): 40, (7, other): 1, (None, None): 1}


def test_minhash_dense_group(spark, monkeypatch):
    """A large group of near copies of one text: one component, and joins that grow with its members."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 16)
    rng = random.Random(12)
    base = _text(rng, 120).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = "z%d" % i
        rows.append((1000 - i, " ".join(w)))
    got = {r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {701}


def test_minhash_unlike_texts_that_share_a_passage(spark, monkeypatch):
    """Many unlike texts with one passage, some with a near copy: links are found without comparing all of them with all."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 8)
    met = []
    blocks = minhash_dedup._in_blocks
    monkeypatch.setattr(minhash_dedup, "_in_blocks", lambda rows, *a: met.append(rows.count()) or blocks(rows, *a))
    rng = random.Random(21)
    values = lambda w: minhash_dedup.shingle_set(np.frombuffer(" ".join(w).encode(), np.uint8), 2)
    passage = min((_text(rng, 4).split() for _ in range(4000)), key=lambda w: int(values(w)[1]))
    rows = []
    for i in range(120):
        w = [*_text(rng, 40).split(), *passage, *_text(rng, 40).split()]
        rows.append((1000 + i, " ".join(w)))
        if i % 10 == 0:
            w[5] = "changed"
            rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {i: i - 1000 if i >= 1000 and i % 10 == 0 else i for i, _ in rows}
    assert sum(met) == 0


def test_minhash_shared_values_by_columns(monkeypatch):
    """Counts of shared values do not depend on how many columns, or pairs, are held at once."""
    monkeypatch.setattr(minhash_dedup, "COLUMNS", 8)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 3)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, k)).astype(np.uint64) for k in (1, 5, 30, 30, 40, 60, 90)]
    want = np.array([[100 * len(set(x) & set(y)) >= 50 * len(set(x) | set(y)) for y in map(np.ndarray.tolist, sets)] for x in map(np.ndarray.tolist, sets)])
    assert (minhash_dedup._reach(sets, sets, 50) == want).all()
    assert (minhash_dedup._reach(sets[:3], sets[3:], 50) == want[:3, 3:]).all()
    sk, n = minhash_dedup._padded([x.astype(np.uint32).tobytes() for x in sets]), np.array([len(x) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    assert (minhash_dedup._estimates(sk, n, i, j) == minhash_dedup.estimate(sk[i], sk[j], n[i], n[j])).all()


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghinorst") for _ in range(7)) for _ in range(n))


def test_components_of_a_chain_and_a_star(spark):
    from glossweave.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}  # a component's smallest node is not listed


@pytest.mark.parametrize("width", [400, 60])
def test_suffix_bytes(docs, rows, width):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    want = Counter()
    for (i, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[(i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))] += 1
    got = suffix_dedup.remove_repeats(docs, width).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("width", [50, 8])
def test_recompression_words(docs, rows, width):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(i, first.get(key, i))
    want = Counter()
    for (i, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode())] += 1
    got = recompression.remove_repeats(docs, width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want


def test_recompression_names_agree_inside_equal_stretches():
    import numpy as np

    from glossweave.llm.kernels import mix

    rng = np.random.default_rng(3)
    shared = mix(rng.integers(0, 9, 300).astype(np.uint64))
    a, b = (np.concatenate([mix(rng.integers(0, 9, 50).astype(np.uint64)), shared, mix(rng.integers(0, 9, 50).astype(np.uint64))]) for _ in range(2))
    kernel = recompression.Symbols(50)
    for (s, lo, hi, c, d), (s2, lo2, hi2, c2, d2) in zip(kernel.levels(a), kernel.levels(b)):
        x = {t[1:] for t in zip(c >= 50, s, lo, hi, c, d) if t[0] and t[5] <= 350 and t[4] >= 50}
        y = {t[1:] for t in zip(c2 >= 50, s2, lo2, hi2, c2, d2) if t[0] and t[5] <= 350 and t[4] >= 50}
        assert x == y and x


def test_lines(docs, rows):
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs, 20).collect()}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if re.fullmatch("Header line of the page number [0-9]+ here|All rights reserved by the owner", x)]
        r = got[i]
        assert (r.n_lines, r.n_dropped) == (len(lines), len(gone))
        assert r.kept == "\n".join(x for x in lines if x not in gone)


def test_lines_against_brute_force(spark):
    """Whole tree by hand: short lines that share leading words only, masked fields, blanks, numbers alone, repeated rows."""
    rng, least = random.Random(2), 5
    word = lambda: "".join(rng.choice("abcde") for _ in range(2))
    rows = []
    for i in range(60):
        t = ["It was the " + _text(rng, 2), "Page  %d of\t%d" % (i, 2 * i), "\t", "%d %d %d %d" % (i, i, i, i), " ".join([word() for _ in range(rng.randint(1, 5))])]
        t += ["Printed for %s in the year %d by all hands" % (word(), i)] * rng.randint(0, 2) + ["x" * 70000] * (i == 3)
        rng.shuffle(t)
        rows.append((i, "\n".join(t)))
    rows += [rows[5], (5, "Page 1 of 2"), (None, None), (None, "Page 3 of 4")]

    def mask(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in re.split("[ \t\x0b-\x0d]+", line.strip(" \t\x0b\x0c\r")) if w)

    leaf = lambda m: (len(m), m[:3])
    pairs = {(leaf(mask(x)), mask(x), r) for r in rows for x in (r[1] or "").split("\n") if mask(x)}
    reach = Counter(k for k, _ in {(k, r) for k, _, r in pairs})
    said = Counter((k, m) for k, m, _ in pairs if reach[k] >= least)
    support = Counter()
    for (k, m), n in said.items():
        for j, w in enumerate(m):
            support[k, j, w] += n * (w != "<*>")
    shape = {}
    for k, m in said:
        fixed = [support[k, j, w] >= least for j, w in enumerate(m)]
        if any(fixed) and 100 * sum(fixed[3:]) >= 60 * sum(w != "<*>" for w in m[3:]):
            shape[k, m] = tuple(w if f else "<*>" for w, f in zip(m, fixed, strict=True))
    total = Counter()
    for (k, m), t in shape.items():
        total[k, t] += said[k, m]
    gone = {m for (k, m), t in shape.items() if total[k, t] >= least}
    want = Counter()
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [x for x in parts if mask(x) not in gone]
        want[i, len(parts), len(parts) - len(keep), "\n".join(keep)] += 1
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, d int, leaf string")
    assert Counter(map(tuple, line_dedup.drop_recurring(df, least).collect())) == want
    assert not any(m[:3] == ("It", "was", "the") for m in gone) and any(m[0] == "Page" for m in gone)


def test_empty_tables(none):
    assert exact_dedup.decisions(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert recompression.remove_repeats(none).count() == 0
    assert line_dedup.drop_recurring(none).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, None), (1, "a b c d e")], "doc_id long, text string")
    assert exact_dedup.decisions(df).where("keep_id = 1").count() == 2
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {(None, 1, False), (None, None, False), (1, 1, True)}
    assert {r.doc_id for r in minhash_dedup.drop_near_duplicates(df).collect()} == {1, None}
    assert suffix_dedup.remove_repeats(df, 4).where("n_removed > 0").count() == 2
    assert recompression.remove_repeats(df, 3).where("n_removed > 0").count() == 1
    assert line_dedup.drop_recurring(df).count() == 3
