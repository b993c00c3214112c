import random
import re
from collections import Counter

import numpy as np
import pytest

from glossweave.llm import minhash_dedup, mixing, packing, quality, recompression, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def _words(rng, n):
    return ["".join(rng.choice("abcdefghinorst") for _ in range(7)) for _ in range(n)]


@pytest.mark.parametrize("ids", [(1, 5, 5), (1, 5, 6), (1, None, None)])
def test_recompression_equal_runs_in_one_id(spark, ids):
    """A passage that an earlier document holds in part recurs with equal surroundings, in one text and in two rows."""
    rng = random.Random(8)
    rows, width = [], 8
    for k in range(12):
        p, x, y = _words(rng, 30), _words(rng, 15), _words(rng, 15)
        twice = [*_words(rng, 9), *x, *p, *y, *_words(rng, 40), *x, *p, *y, *_words(rng, 9)]
        again = [*_words(rng, 11), *x, *p, *y, *_words(rng, 11)]
        texts = [" ".join([*_words(rng, 20), *p, *_words(rng, 20)]), " ".join(twice), " ".join(again)]
        rows += [(None if i is None else 10 * k + i, t) for i, t in zip(ids, texts, strict=True)]
    at = [2**63 - 1 if i is None else i for i, _ in rows]
    first = {}
    for d, (_, t) in zip(at, rows, strict=True):
        w = WORD.findall(t)
        for j in range(len(w) - width + 1):
            first[tuple(w[j : j + width])] = min(d, first.get(tuple(w[j : j + width]), d))
    want = Counter()
    for d, (i, t) in zip(at, rows, strict=True):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < d:
                gone[j : j + width] = [True] * width
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())] += 1
    got = recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want


def test_minhash_pair_that_shares_two_values_of_a_long_list(spark, monkeypatch):
    """Of their ten smallest values two near copies share but two, and many unlike texts share these as well."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 8)
    rng = random.Random(4)
    values = lambda w: minhash_dedup.shingle_set(np.frombuffer(" ".join(w).encode(), np.uint8), 2)
    while True:
        a = _words(rng, 240)
        low = values(a)[:10].tolist()
        place = {int(values(a[i : i + 2])[0]): i for i in range(239)}
        at = [place[v] for v in low]
        b = list(a)
        for i in at[:4] + at[6:]:
            b[i] = _words(rng, 1)[0]
        shared = set(low) & set(values(b)[:10].tolist())
        if shared == {low[4], low[5]} and abs(at[4] - at[5]) > 2:
            break
    x, y = sorted(at[4:6])
    unlike = [" ".join([*a[x : x + 2], *_words(rng, 2), *a[y : y + 2]]) for _ in range(30)]
    rows = [(7, " ".join(a)), (3, " ".join(b)), *((100 + i, t) for i, t in enumerate(unlike))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {i: i for i, _ in rows} | {7: 3}


@pytest.mark.parametrize("on_driver", [True, False])
@pytest.mark.parametrize("given", [True, False])
def test_mixing_rakes_every_source(spark, monkeypatch, on_driver, given):
    """1200 sources keep their own targets, on the driver and in tables."""
    if not on_driver:
        monkeypatch.setattr(mixing, "MAX_CELLS", 100)
    rng, sources = random.Random(6), 1200
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["en", "de"]), f"s{i % sources}") for i in range(2 * sources)]
    targets = {"m_source": {f"s{k}": (1 + k % 7) / sum(1 + j % 7 for j in range(sources)) for k in range(sources)}} if given else None
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mixing.with_probability(df, targets, rounds=3).select("doc.doc_id", "m_topic", "m_p").collect()}
    key = {i: (s, lang, got[i].m_topic) for i, _, lang, s in rows}
    cells, margins = Counter(), [Counter() for _ in range(3)]
    for i, t, *_ in rows:
        cells[key[i]] += len(t.split())
        for at in range(3):
            margins[at][key[i][at]] += len(t.split())
    want = [mixing.tempered(dict(m), mixing.TEMPER) for m in margins]
    if given:
        want[0] = targets["m_source"]
    cells = {k: float(x) for k, x in cells.items()}
    p = mixing.probabilities(cells, mixing.rake(cells, want, 3), mixing.KEEP)
    assert len(got) == len(rows) and all(got[i].m_p == pytest.approx(p[key[i]], rel=1e-9) for i in got)


def test_texts_longer_than_a_block(spark):
    """Texts of several blocks that share a part across the blocks' ends."""
    rng = random.Random(11)
    long = " ".join(_words(rng, 45000))
    cut = long[100_000:180_000]
    rows = [(1, long), (2, "start " + cut + " end"), (3, "small text"), (4, long[:399])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, d int, starts int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()}
    shared = len(cut) + 2 if long[99_999] == long[180_000] == " " else None
    lo, hi = 100_000 - (long[99_999] == " "), 180_000 + (long[180_000] == " ")
    assert got == {1: (len(long), hi - lo, 1), 2: (len(cut) + 10, hi - lo, 1), 3: (10, 0, 0), 4: (399, 0, 0)} and shared in (None, hi - lo)
    words = {r.doc_id: (r.n_words, r.n_removed) for r in recompression.remove_repeats(df).collect()}
    whole = set(long.split())
    assert words[1] == (45000, 0) and words[2][1] == sum(w in whole for w in rows[1][1].split()) and words[4] == (len(rows[3][1].split()), sum(w in whole for w in rows[3][1].split()))


def test_packing_nothing(none):
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


def test_quality_names_must_be_free(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, quality_score double")
    with pytest.raises(ValueError):
        quality.score(df, quality.Model(0.5))
