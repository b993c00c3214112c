"""Personal data by bootstrapped contextual extraction.

Fixed forms give the seed spans, which always stay.  The words around a seed induce lexical patterns: the word before, the
two words before, the word before with the word after.  Looser forms of the same kinds (a host without a dot, spelled-out
signs, other digit groups) are candidates, which are nothing by themselves.  Patterns and the instances they surround make a graph:

* the confidence of a pattern is the share of all its occurrences in the corpus, whatever stands in it, that known instances fill,
  each by its score; a pattern counts from ``SUPPORT`` instances on;
* the score of an instance is 1 for a seed, and else what its patterns say together: one minus the product of their doubts.

A few rounds of two joins settle both.  Instances that score ``ACCEPT`` or more become spans wherever they occur, unless
they overlap a seed or a better candidate.  Contexts that ordinary words fill as well never get there, so clean documents stay clean.

Occurrences are counted over all words of all texts, with a filter of fixed size (1 MiB) in front that holds the patterns that matter; what the
filter lets through too much is dropped by the join behind it.

Null texts count as empty; a null doc_id stays.  Very long texts count whole.  Repeated rows are returned each, but
an instance counts once however many rows repeat it.  Ties between overlapping candidates go to the kind listed first, then to the
earlier start.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.kernels import byte_rows, mix, word_hashes
from glossweave.llm.scratch import materialise, table

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ROUNDS, ACCEPT, SMOOTH = 3, 3, 0.5, 1.0
FILTER_LOG2, SEGMENT_LOG2 = 23, 15
SHOWN = 40

# Fixed forms of the seeds; possessive where the plain form would try every start of a long run.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser forms of the candidates.
_HOST = re.compile(r"[A-Za-z0-9-]+")
_SPELLED = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.I)
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]+(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]+)*", re.I)
_DOTTED = re.compile(r"(?<![0-9A-Za-z.])[0-9]++(?:\.[0-9]++){3}(?![0-9A-Za-z])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_DIGITS = re.compile(r"(?<![0-9A-Za-z(+.])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_WORD = re.compile("[^\x20\x09-\x0d]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _before(text: str, at: int, low: int) -> int:
    """Start of the run of mailbox characters that ends at ``at``, not below ``low``."""
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms, by kind, then start."""
    out: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = _before(text, at, low)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for kind, form, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in form.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def candidate_spans(text: str, base: list[Span]) -> list[Span]:
    """Looser forms that overlap no span of the fixed ones."""
    found: set[Span] = set()
    at = text.find("@")
    while at >= 0:
        start = _before(text, at, 0)
        if start < at and (m := _HOST.match(text, at + 1)):
            found.add(("email", start, m.end()))
        at = text.find("@", at + 1)
    for sign in _SPELLED.finditer(text):
        start = _before(text, sign.start(), 0)
        if start < sign.start() and (m := _SPELLED_HOST.match(text, sign.end())):
            found.add(("email", start, m.end()))
    if _DIGIT.search(text):
        found |= {("ip", *m.span()) for form in (_DOTTED, _COLONS) for m in form.finditer(text)}
        for m in _DIGITS.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            found |= {(kind, *m.span()) for kind, least, most in (("card", 12, 19), ("phone", 7, 15)) if least <= n <= most}
    taken = sorted(x[1:] for x in base)
    starts = [x[0] for x in taken]
    reach = np.maximum.accumulate([0, *(x[1] for x in taken)]).tolist()
    return [(k, s, e) for k, s, e in sorted(found) if reach[bisect_right(starts, e - 1)] <= s]


def instance(kind: str, text: str) -> str:
    """One spelling of an identifier."""
    return kind + ":" + (_NOT_DIGIT.sub("", text) if kind in ("card", "phone") else _SPELLED.sub("@", text).lower())


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the three patterns around each word but the first; 0 stands for a missing word (h has two at the start, one at the end)."""
    two, one, after = h[:-3], h[1:-2], h[3:]
    u = np.uint64
    return mix(one + u(1)), mix(two * u(0x9E3779B97F4A7C15) + one + u(2)), mix(one * u(0xC2B2AE3D27D4EB4F) + after + u(3))


def _framed(h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(2, np.uint64), h, np.zeros(1, np.uint64)])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its fixed spans, their digest, and all mentions with the patterns around each."""
    mention = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("keys", pa.list_(pa.int64())), ("shown", pa.list_(pa.string()))])

    def around(text: str, spans: list[Span], n_base: int) -> list[dict]:
        words = [m.span() for m in _WORD.finditer(text)]
        starts = [s for s, _ in words]
        h = _framed(word_hashes(np.frombuffer(text.encode(), np.uint8), True))
        u = np.uint64
        out = []
        for i, (kind, first, last) in enumerate(spans):
            lo, hi = bisect_right(starts, first) - 1, bisect_right(starts, last - 1) - 1
            two, one, after = h[lo], h[lo + 1], h[hi + 3]
            keys = _keys(np.array([two, one, u(0), after], np.uint64))
            w = [text[slice(*words[j])][:SHOWN] if 0 <= j < len(words) else "" for j in (lo - 2, lo - 1, hi + 1)]
            held = [(int(_signed(k)[0]), t) for k, t, use in zip(keys, (f"{w[1]} _", f"{w[0]} {w[1]} _", f"{w[1]} _ {w[2]}"), (lo > 0, lo > 1, lo > 0 and hi + 1 < len(words)), strict=True) if use]
            name = xxhash.xxh64_intdigest(instance(kind, text[first:last]).encode())
            out.append({"kind": kind, "first": first, "last": last, "seed": i < n_base, "instance": int(_signed(np.array([name], np.uint64))[0]), "keys": [k for k, _ in held], "shown": [t for _, t in held]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, found = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                own = base_spans(text)
                loose = candidate_spans(text, own)
                base.append(own)
                found.append(around(text, own + loose, len(own)) if own or loose else [])
            n = batch.num_rows
            digests = [digest(own) for own in base]
            columns = {"uid": pa.array(np.arange(uid, uid + n)), "doc_id": batch.column(0)}
            for kind in KINDS:
                columns[f"n_{kind}"] = pa.array([sum(k == kind for k, _, _ in own) for own in base], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in digests])
            columns["base"] = pa.array(digests)
            columns["mentions"] = pa.array(found, pa.list_(mention))
            uid += n
            yield pa.record_batch(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    fields = "kind: string, first: bigint, last: bigint, seed: boolean, instance: bigint, keys: array<bigint>, shown: array<string>"
    return rows.mapInArrow(run, f"uid long, doc_id long, {counts}, base_sha256 string, base string, mentions array<struct<{fields}>>")


def occurrences(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """key, total: how often each pattern of ``keys`` occurs in all texts, whatever word stands in it."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.unique(batch.column(0).to_numpy() & ((1 << FILTER_LOG2) - 1))
            segment = cell >> SEGMENT_LOG2
            cut = np.flatnonzero(np.diff(segment, prepend=-1))
            low = (cell & ((1 << SEGMENT_LOG2) - 1)).astype(np.uint16)
            parts = np.split(low, cut[1:]) if len(cut) else []
            yield pa.record_batch({"segment": pa.array(segment[cut], pa.int32()), "cells": pa.array([x.tobytes() for x in parts], pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << SEGMENT_LOG2, bool)
        for c in rows["cells"]:
            on[np.frombuffer(c, np.uint16)] = True
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    bits = np.zeros((1 << FILTER_LOG2) // 8, np.uint8)
    width = (1 << SEGMENT_LOG2) // 8
    for r in keys.select("key").mapInArrow(cells, "segment int, cells binary").groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect():  # 1 MiB at most
        bits[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64((1 << FILTER_LOG2) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value, bitorder="little").view(bool)
        for batch in batches:
            seen: list[np.ndarray] = []
            for raw in byte_rows(batch.column(0)):
                h = word_hashes(raw, True)
                if len(h) < 2:
                    continue
                one, two, both = _keys(_framed(h))
                for k in (one[1:], two[2:], both[1:-1]):  # only where every word of the pattern is there
                    seen.append(k[on[(k & mask).astype(np.int64)]])
            key, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch({"key": pa.array(_signed(key)), "n": pa.array(n.astype(np.int64))})

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("total"))
    return counted.join(keys.select("key").distinct(), "key", "left_semi")


def _confidence(graph: DataFrame, scores: DataFrame) -> DataFrame:
    filled = graph.join(scores, ["kind", "instance"]).groupBy("kind", "key").agg(F.sum(F.col("score") * F.col("n")).alias("filled"), F.sum("score").alias("support"), F.max("total").alias("total"))
    return filled.where(F.col("support") >= SUPPORT).select("kind", "key", "support", (F.col("filled") / (F.col("total") + SMOOTH)).alias("confidence"))


def learn(docs: DataFrame, found: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances): kind, key, shown, support, confidence; and kind, instance, seed, score."""
    each = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", "m.seed", F.explode(F.arrays_zip("m.keys", "m.shown")).alias("p"))
    edges = each.groupBy("kind", F.col("p.keys").alias("key"), "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.max("p.shown").alias("shown"))
    edges = materialise(edges, "edges")
    usable = edges.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("all"), F.max("shown").alias("shown")).where(F.col("instances") >= SUPPORT)
    usable = materialise(usable, "patterns")
    totals = usable.join(occurrences(docs, usable, text_col), "key", "left").select("kind", "key", "shown", F.greatest("all", F.coalesce("total", F.lit(0))).alias("total"))
    totals = materialise(totals, "pattern-totals")
    graph = materialise(edges.drop("shown").join(totals.drop("shown"), ["kind", "key"]), "graph")
    known = found.select(F.explode("mentions").alias("m")).groupBy("m.kind", "m.instance").agg(F.max("m.seed").alias("seed"))
    scores = materialise(known.withColumn("score", F.col("seed").cast("double")), "scores")
    own = F.when(F.col("seed"), 1.0).otherwise(1.0 - F.exp(F.coalesce(F.col("doubt"), F.lit(0.0))))
    for _ in range(ROUNDS):
        confidence = materialise(_confidence(graph, scores), "confidence")
        doubt = graph.join(confidence, ["kind", "key"]).groupBy("kind", "instance").agg(F.sum(F.log1p(-F.col("confidence"))).alias("doubt"))
        scores = materialise(scores.drop("score").join(doubt, ["kind", "instance"], "left").select("kind", "instance", "seed", own.alias("score")), "scores")
    patterns = totals.join(_confidence(graph, scores), ["kind", "key"]).select("kind", "key", "shown", "support", "total", "confidence")
    return patterns, scores


def _settled(base: list[Span], added: list[tuple[str, int, int, float]]) -> list[Span]:
    """Fixed spans and, best first, what overlaps none taken before."""
    rank = {k: i for i, k in enumerate(KINDS)}
    out, taken = list(base), []
    for kind, s, e, _ in sorted(added, key=lambda x: (-x[3], rank[x[0]], x[1])):
        at = bisect_right(taken, (s, e))
        if (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            taken.insert(at, (s, e))
            out.append((kind, s, e))
    return sorted(out, key=lambda x: (rank[x[0]], x[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the fixed forms, spans of all, and n_added."""
    found = materialise(mentions(docs, id_col, text_col), "mentions")
    _, scores = learn(docs, found, text_col)
    good = scores.where(F.col("score") >= ACCEPT)
    loose = found.select("uid", F.explode("mentions").alias("m")).where("NOT m.seed").select("uid", "m.kind", "m.instance", "m.first", "m.last")
    added = loose.join(good, ["kind", "instance"]).groupBy("uid").agg(F.collect_list(F.struct("kind", "first", "last", "score")).alias("added"))
    counts = [f"n_{k}" for k in KINDS]
    has: Column = F.exists("mentions", lambda m: ~m["seed"])
    shown = ["doc_id", *counts, "base_sha256", "base"]
    touched = found.where(has).select("uid", *shown).join(added, "uid", "left").select(*shown, "added")
    names = ["doc_id", *counts, "base_sha256", "spans", "n_added"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, more = [], []
            for base, extra in zip(batch.column("base").to_pylist(), batch.column("added").to_pylist(), strict=True):
                own = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                every = _settled(own, [(x["kind"], x["first"], x["last"], x["score"]) for x in extra or []])
                spans.append(digest(every))
                more.append(len(every) - len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans), pa.array(more, pa.int64())], names=names)

    settled = touched.mapInArrow(settle, ", ".join(["doc_id long", *(f"{c} long" for c in counts), "base_sha256 string, spans string, n_added long"]))
    return found.where(~has).select(*shown[:-1], F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_added")).unionByName(settled)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
