import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossweave.llm import token_alignment as ta

ZERO = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def plain():
    """Whole texts through the two libraries, token by token; every pair of tokens is tried."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = ta.default_tokenizers()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte = ta.byte_of_character()

    def spans(ids, raw):
        out, at = [], 0
        for i, r in zip(ids, raw):
            out.append((i, at, at + len(r)))
            at += len(r)
        return out

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return None
        raw = (" " + text).encode()
        e = a.encode(" " + text, add_special_tokens=False)
        ra = [bytes(byte[c] for c in a.id_to_token(i)) for i in e.ids]
        ib = b.encode(text)
        rb = [piece(i) for i in ib]
        if b"".join(ra) != raw or b"".join(rb) != raw:
            return None
        sa, sb = spans(e.ids, ra), spans(ib, rb)
        cuts = sorted({y for _, _, y in sa} & {y for _, _, y in sb})
        groups, lo, links = [], 0, []
        for hi in cuts:
            ga, gb = ([t for t in s if lo <= t[1] and t[2] <= hi] for s in (sa, sb))
            groups.append(",".join(str(t[0]) for t in ga) + "|" + ",".join(str(t[0]) for t in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            lo = hi
        return len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def whole(rows):
        every = [(i, one(t)) for i, t in rows]
        held = Counter(p for _, r in every if r for p in set(r[3]))
        top = defaultdict(int)
        for (x, _), n in held.items():
            top[x] = max(top[x], n)
        return Counter((i, r[0], r[1], r[2], len(r[3]), sum(held[p] == top[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) if r else (i, *ZERO) for i, r in every)

    return whole


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b", "  two  spaces ", " lead", "trail ", "\n", "tab\there \n next\r\nline \x85 x　y \xa0z", "x\x00y", "\x1c a \x1f b", "日本語のテキスト と 漢字", "ñandú façade naïve",
    "é é ＡＢＣ ﬁ", "'s 't I'll we've  'd", "😀👍🏽 family 👨‍👩‍👧", "1234567890 3.14 1,000", "a" * 700, "=" * 300 + " " * 40 + "-" * 90, "word " * 500, "​ ﻿ x", "def f(x):\n    return x  # note\n\n\n",
]


def test_odd_texts(spark, plain):
    rows = [*enumerate(ODD), (None, "null id"), (3, "other text, same id"), (3, "other text, same id"), (90, None), (91, "")]
    got = ta.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *ta.default_tokenizers())
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_documents(docs, rows, plain, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_DOCS", 7)
    clash = docs.withColumn("block", F.lit("x")).withColumn("pair", F.lit(1)).withColumn("a.b", F.lit(1))
    got = Counter(map(tuple, ta.align(clash, *ta.default_tokenizers()).collect()))
    assert got == plain([(r[0], r[1]) for r in rows])


def test_small_caches_and_blocks(monkeypatch, plain):
    """Stretches leave the caches and come back; calls of a few stretches."""
    monkeypatch.setattr(ta, "CACHED", 3)
    monkeypatch.setattr(ta, "AT_ONCE", 2)
    monkeypatch.setattr(ta, "LONG", 6)
    aligner = ta._Aligner(*ta.default_tokenizers())
    fresh = ta._Aligner(*ta.default_tokenizers())
    for t in [t for t in ODD if t] * 2:
        assert aligner.stretches(t) == [fresh._align([p])[0] for p in (ta._CUT.split(t))]


def test_empty(none):
    out = ta.align(none, *ta.default_tokenizers())
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_very_long_text(spark, plain):
    text = " ".join(f"wörd{i % 977} of{i % 13}" for i in range(40_000)) + "x" * 3000
    got = ta.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *ta.default_tokenizers()).collect()
    r = got[0]
    assert len(got) == 1 and r.n_a > 100_000 and r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links == r.count_sum
