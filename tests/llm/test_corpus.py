import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glossweave.llm import bloom, mixing, packing, quality, sharding, simhash

MASK = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def term_hash(word, following):
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h if following is None else xxhash.xxh64_intdigest(following.encode(), h)


def fingerprint(text):
    import re

    w = re.split("[\x20\x09-\x0d]+", text.lower())
    votes, total = [0] * 64, 0
    for i, x in enumerate(w):
        weight = min(len(x), simhash.MAX_WEIGHT)
        h = term_hash(x, w[i + 1] if i + 1 < len(w) else None)
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_simhash(docs, rows):
    texts = {i: t or "" for i, t, *_ in rows}
    ids = sorted(texts)
    want = set()
    every = [fingerprint(texts[i]) for i in ids]
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        f, fe, fn = fingerprint(t), fingerprint(e), fingerprint(nxt)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        want.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{f:016x}", f"{fe:016x}", like(f, fe), like(f, fn), sum((f ^ x).bit_count() <= 3 for x in every) if i % 50 == 0 else None))
    got = [tuple(r) for r in simhash.fingerprint_edits(docs.withColumn("next_id", F.lit(0))).collect()]
    assert set(got) == want and len(got) == len(want)


def test_simhash_edges(spark, none):
    assert simhash.fingerprint_edits(none).count() == 0
    one = simhash.fingerprint_edits(spark.createDataFrame([(7, "some words here"), (None, "x")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_successors_of_sparse_ids(spark):
    rng = random.Random(1)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(200)} | set(range(1000, 3100)) | {2**40, 2**40 + 1})
    got = dict(map(tuple, simhash._successors(spark.createDataFrame([(i,) for i in ids], "x long")).collect()))
    assert got == dict(zip(ids, [*ids[1:], None]))


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (2, 4), (5, 7)])
def test_fingerprints_within_radius(spark, radius, blocks):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(8)] + base[:5]
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fingerprint long")
    q = df.where("doc_id % 5 = 0")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(fps) if i % 5 == 0 for j, b in enumerate(fps) if (a ^ b).bit_count() <= radius}
    assert {tuple(r) for r in simhash.within(q, df, radius, blocks).collect()} == want


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    cap = 64
    got = packing.pack(docs.withColumn("rank", F.lit(1)), packing.default_tokenizer(), cap).collect()
    of = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (len(ids), zlib.crc32(r.ids), r.start) == (r.length, r.ids_crc32, r.piece * cap)
        of[r.doc_id, r.piece].append(ids.tolist())
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), cap):
            want[i, p // cap].append(ids[p : p + cap])
    assert of == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= cap
    assert len(bins) <= -(-sum(r.length for r in got) // cap) * 1.03 + 1


def test_packing_gives_memory_back():
    """Between two lots of texts a worker holds little of what cutting them took."""
    anon = lambda: int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    enc = packing._Encoder(packing.default_tokenizer())
    texts = ["some words of a text that come again and again " * 200] * 800
    for _ in range(3):
        got = enc.all_ids(texts)
    held = anon()
    pa.default_memory_pool().release_unused()
    assert len(set(got)) == 1 and held - anon() < 20


def test_packing_other_blanks_and_marks(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a\x1cb\x85c d　e", "It's 'S don'T\x0bx\x0cy", "é ́a ΑΣ Σ", "<|endoftext|> a", "İstanbul ǅ ﬁ 12345 !!??", "한글 ไทย", "\x00 \x01", "e\u0301 \u1100\u1161 ΑΣΑΣ", "'s 'x !'s don't've", "a" * 5000, "_under_score 1_000", "٣٤ Ⅷ ½ x²", "\u200b\u00a0z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(df, packing.default_tokenizer()).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def best_pairs(lengths, cap):
    """Bins that large items alone need: a pair where one fits."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        a = left.pop(0)
        j = next((k for k, b in enumerate(left) if a + b <= cap), None)
        if j is not None:
            left.pop(j)
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(5))
def test_plan_matches_item_by_item_packing(seed):
    rng = random.Random(seed)
    cap = 90
    lengths = [rng.choice([rng.randint(1, cap), cap, 31, rng.randint(31, 60)]) for _ in range(300)]
    p = packing.plan(dict(Counter(lengths)), cap)
    bins, rank = defaultdict(dict), Counter()
    for n in sorted(lengths):
        rows = p[(p.length == n) & (p["first"] <= rank[n])]
        r = rows.iloc[-1]
        d = rank[n] - r["first"]
        bins[int(r.sequence + d // r.each)][int(r.offset + d % r.each * n)] = n
        rank[n] += 1
    for b in bins.values():
        at = 0
        for o in sorted(b):
            assert o == at
            at += b[o]
        assert at <= cap
    gaps = None
    large, small = [n for n in lengths if 3 * n > cap], sorted((n for n in lengths if 3 * n <= cap), reverse=True)
    left = sorted(large, reverse=True)
    gaps = []
    while left:
        a = left.pop(0)
        j = next((k for k, b in enumerate(left) if a + b <= cap), None)
        gaps.append(cap - a - (left.pop(j) if j is not None else 0))
    for s in small:
        k = min((k for k, g in enumerate(gaps) if g >= s), key=lambda k: gaps[k], default=None)
        if k is None:
            gaps.append(cap - s)
        else:
            gaps[k] -= s
    assert len(bins) == len(gaps) and sum(len(b) for b in bins.values()) == 300


def test_sharding(docs, rows, none):
    got = sharding.shard(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, total, of = defaultdict(list), Counter(), defaultdict(set)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        of[texts[r.doc_id]].add(r.shard)
    assert set(total) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    assert sharding.shard(none, 8).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 70) for _ in range(3000)), reverse=True)
    gaps, want = [], []
    for s in sizes:
        k = min((k for k, g in enumerate(gaps) if g >= s), key=lambda k: (gaps[k], k), default=None)
        if k is None:
            gaps.append(100)
            k = len(gaps) - 1
        gaps[k] -= s
        want.append(k)
    assert sharding.best_fit_decreasing(sizes, 100) == want
    bins = sharding.pack_into(sizes, 8)
    load = Counter()
    for s, b in zip(sizes, bins):
        load[b] += s
    assert max(load.values()) - sum(sizes) / 8 < 2 and len(load) == 8


def test_bloom_never_calls_a_repeat_unique(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(5000), *range(0, 5000, 50), *[7] * 3000]], "h long")
    log2 = bloom.log2_cells(keys.count())
    flagged = bloom.with_flag(keys, "h", bloom.shared_cells(keys, "h", log2), log2, "maybe")
    repeated = {*range(0, 5000, 50), 7}
    seen = {r.h for r in flagged.where("maybe").collect()}
    assert repeated <= seen and len(seen) < 1000


def test_bloom_in_ranges_and_hot_keys(spark, monkeypatch):
    """Many filters instead of a large one; a key of a third of all rows."""
    monkeypatch.setattr(bloom, "MAX_LOG2_CELLS", 12)
    monkeypatch.setattr(bloom, "MIN_LOG2_CELLS", 10)
    keys = spark.createDataFrame([(k,) for k in [*range(3000), *range(0, 3000, 50), *[7] * 1500]], "h long").repartition(3)
    flagged = bloom.flagged(keys, keys, "h", "maybe")
    assert bloom.ranges(keys.count()) > 10 and flagged.count() == keys.count()
    seen = {r.h for r in flagged.where("maybe").collect()}
    assert {*range(0, 3000, 50), 7} <= seen and len(seen) < 900


def test_mixing_targets_that_name_some_values(spark):
    present = {"a": 50.0, "b": 30.0, "c": 20.0}
    assert mixing.completed(present, {"a": 3.0, "b": 1.0}) == pytest.approx({"a": 0.6, "b": 0.2, "c": 0.2})
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for cells in (mixing.MAX_CELLS, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(mixing, "MAX_CELLS", cells)
            got = {r.m_source: r.p for r in mixing.with_probability(df, {"m_source": {"a": 1.0}}, keep=0.5, rounds=4).groupBy("m_source").agg(F.avg("m_p").alias("p")).collect()}
        assert all(p > 0.3 for p in got.values())


def test_raking_meets_all_margins():
    rng = random.Random(4)
    cells = {(a, b, c): rng.uniform(1, 50) for a in "xyz" for b in "pq" for c in "uvw"}
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.4, "q": 0.6}, {"u": 0.2, "v": 0.2, "w": 0.6}]
    fitted = mixing.rake(cells, targets)
    total = sum(cells.values())
    for at, target in enumerate(targets):
        for value, share in target.items():
            assert sum(x for k, x in fitted.items() if k[at] == value) == pytest.approx(share * total)
    p = mixing.probabilities(cells, fitted, 0.7)
    assert sum(p[k] * x for k, x in cells.items()) == pytest.approx(0.7 * total) and max(p.values()) == 1.0


def test_mixing_rows(docs, rows, none):
    more = docs.withColumn("m_source", F.lit("own"))
    got = mixing.sample(more, keep=0.5)
    assert got.columns == more.columns and 0 < got.count() < len(rows)
    assert got.where("m_source <> 'own'").count() == 0
    assert mixing.sample(none).count() == 0
    assert mixing.with_probability(docs).count() == len(rows)


def test_quality_held_out(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinorstl") for _ in range(rng.randint(2, 8)))
    out, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        w = [word() for _ in range(rng.randint(20, 200))]
        out.append((i, " ".join(x.upper() + "!!" if bad and rng.random() < 0.7 else x for x in w)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    bad = {i for i, t in out if t.count("!!") > 5}
    df = spark.createDataFrame(out, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score(df, quality.train(df, lab)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.quality_predicted == 1) == (r.doc_id not in bad) for r in held)
    assert right / len(held) > 0.95
    assert all(r.quality_predicted == 1 for r in got if r.doc_id not in bad)
    # labels of held-out rows change nothing
    flipped = lab.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.quality_score for r in quality.score(df, quality.train(df, flipped)).collect()}
    assert again == {r.doc_id: r.quality_score for r in got}


def test_quality_edges(spark, docs, rows, none):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    more = docs.withColumn("quality_score", F.lit("own"))
    assert quality.keep_good(more, lab).columns == more.columns
    assert quality.keep_good(more, lab).count() == len(rows)
    assert quality.score(none, quality.train(none, lab)).count() == 0
