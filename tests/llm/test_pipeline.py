import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossweave.llm import mixing, packing, quality

BLANK, WORD = re.compile("[\x20\x09-\x0d]"), re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.coalesce(2).write.parquet(str(path / "documents.parquet"))
    labels = docs.select("doc_id", (~F.coalesce(F.col("text"), F.lit("")).contains("Header line")).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct()
    labels.where("doc_id % 2 = 1").coalesce(1).write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Rows before and after each stage."""
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in stage(spark, docs, sf_dir).collect()]
        out.append((before, rows))
        docs, before = spark.createDataFrame(rows, docs.schema) if len(out) < len(corpus_pipeline.STAGES) else None, rows
    return out


def test_quality_rejects_by_score(spark, sf_dir, steps):
    before, after = steps[0]
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    x = np.array([quality.features(np.frombuffer((r[1] or "").encode(), np.uint8)) for r in before])
    want = [r for r, s in zip(before, model.score(x), strict=True) if s >= quality.THRESHOLD]
    assert sorted(after, key=repr) == sorted(want, key=repr) and after


def test_exact_keeps_one(steps):
    before, after = steps[1]
    best = {}
    for r in before:
        key = BLANK.sub("", r[1] or "")
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    assert sorted(after, key=repr) == sorted(best.values(), key=repr) and len(after) < len(before)


def test_near_keeps_smallest_of_component(steps):
    before, after = steps[2]

    def shingles(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in before}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert {r[0] for r in after} == {i for i in sets if least[i] == i} and len(after) < len(before)


def test_mixing_follows_probabilities(spark, steps):
    import hashlib

    before, after = steps[3]
    cells = defaultdict(float)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    known = {r.i: (r.m_source, r.m_lang, r.m_topic, r.m_tokens) for r in mixing.with_probability(spark.createDataFrame(before, schema)).select("doc.doc_id", *mixing.MARGINS, "m_tokens").withColumnRenamed("doc_id", "i").collect()}
    for s, lang, t, n in known.values():
        cells[s, lang, t] += n
    want = []
    for at in range(3):
        present = defaultdict(float)
        for k, x in cells.items():
            present[k[at]] += x
        want.append(mixing.tempered(present, mixing.TEMPER))
    p = mixing.probabilities(dict(cells), mixing.rake(dict(cells), want), mixing.KEEP)
    keep = {i for i, k in known.items() if int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) / 2**32 < p[k[:3]]}
    assert {r[0] for r in after} == keep and 0 < len(after) < len(before)


def test_packing_holds_every_document(steps):
    before, after = steps[4]
    enc = packing._Encoder(packing.default_tokenizer())
    want = sorted((r[0], zlib.crc32(enc.ids(r[1] or "") + bytes(4))) for r in before if len(enc.ids(r[1] or "")) < 8192)
    whole = {r[0] for r in before}
    assert {r[0] for r in after} == whole
    single = sorted((r[0], r[4]) for r in after if sum(x[0] == r[0] for x in after) == 1)
    assert single == [w for w in want if w[0] in {s[0] for s in single}]


def test_run_equals_the_stages_one_by_one(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r[0], r[1], r[4]) for r in steps[4][1])
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_repeated_runs_are_cut_into_words_once():
    from glossweave.llm import packing

    enc, met = packing._Encoder(packing.default_tokenizer()), []
    cut = enc.cut
    enc.cut = lambda text: met.append(len(text)) or cut(text)
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    odd = [f"A{c}b's{c}{c}1{c}Été, don't" for c in [*spaces, "\x00", "​", "᠎", "﻿"]] + ["", " ", "\x1c", "漢字 かな。 x", "ΑΣ ΟΔΟΣ", "é İ <unk>"]
    texts = ["word, and word, " * 5000, *odd]
    assert enc.all_ids(texts) == [enc._whole(t) for t in texts]
    assert sum(met) < 3000
