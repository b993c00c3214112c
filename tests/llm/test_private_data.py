import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossweave.llm import private_data as pd_

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    """The forms as stated, tried from every start."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def plain_find(rows):
    """The same learning with strings in dictionaries."""
    docs, edges, total = [], defaultdict(Counter), Counter()
    instances = {}
    for i, text in rows:
        text = text or ""
        words = [m.span() for m in WORD.finditer(text)]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), text[s:e]) for s, e in words]
        for j in range(1, len(low)):
            total["1", low[j - 1]] += 1
            if j > 1:
                total["2", low[j - 2], low[j - 1]] += 1
            if j + 1 < len(low):
                total["3", low[j - 1], low[j + 1]] += 1
        base = plain_base(text)
        loose = [x for x in pd_.candidate_spans(text, base)]
        assert not any(s < e2 and s2 < e for _, s, e in loose for _, s2, e2 in base)
        docs.append((i, base, loose, text))
        for n, (k, s, e) in enumerate(base + loose):
            a = max(j for j, w in enumerate(words) if w[0] <= s)
            b = max(j for j, w in enumerate(words) if w[0] < e)
            name = k, pd_.instance(k, text[s:e])
            instances[name] = instances.get(name, False) or n < len(base)
            if a > 0:
                edges[k, "1", low[a - 1]][name] += 1
                if a > 1:
                    edges[k, "2", low[a - 2], low[a - 1]][name] += 1
                if b + 1 < len(words):
                    edges[k, "3", low[a - 1], low[b + 1]][name] += 1
    score = {n: float(seed) for n, seed in instances.items()}
    edges = {p: c for p, c in edges.items() if len(c) >= pd_.SUPPORT}
    for _ in range(pd_.ROUNDS):
        sure = {p: sum(score[n] * c for n, c in held.items()) / (max(sum(held.values()), total[p[1:]]) + pd_.SMOOTH) for p, held in edges.items() if sum(score[n] for n in held) >= pd_.SUPPORT}
        doubt = defaultdict(lambda: 1.0)
        for p, c in sure.items():
            for n in edges[p]:
                doubt[n] *= 1 - c
        score = {n: 1.0 if seed else 1 - doubt[n] for n, seed in instances.items()}
    out = Counter()
    order = {k: i for i, k in enumerate(pd_.KINDS)}
    for i, base, loose, text in docs:
        spans = list(base)
        for _, _, s, k, e in sorted((-score[k, pd_.instance(k, text[s:e])], order[k], s, k, e) for k, s, e in loose):
            if score[k, pd_.instance(k, text[s:e])] >= pd_.ACCEPT and not any(s < y and x < e for _, x, y in spans):
                spans.append((k, s, e))
        join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(x, key=lambda v: (order[v[0]], v[1])))
        out[(i, *(sum(x[0] == k for x in base) for k in pd_.KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(spans), len(spans) - len(base))] += 1
    return out


CARD = "4111 1111 1111 1111"
ODD = [
    "", " \n", "a@b.c", "a@b", "x a@b.cd@e.fg y", "a@b.c@d.e.f", "@x.y a@.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 0001.002.3.4 00000000000255.1.1.1", "999.1.2.3.4", f"card {CARD}, 4111-1111-1111-1111 4111 1111 1111 1112",
    CARD + " " + CARD, "+1 (743) 555-3824.", "++49 30 123 45 67 8-", "+1234567", "+12345678 +1234567890123456", "+1 2 3 4 5 6 7 8 9 . ( ) -", "é@ü.de müller@web.de", "日本 +81 3 1234 5678 語 １２３", "joe [at] mail (dot) example {dot} org", "12:30:45 fe80::1:2 aa:bb:cc:dd",
    "9" * 3000, "1." * 2000, "a" * 3000 + "@", ("x@y.z," * 400), "+1" * 900, "5 " * 900, "%+-._@-.-",
]


@pytest.mark.parametrize("text", ODD)
def test_fixed_forms(text):
    assert pd_.base_spans(text) == plain_base(text)


def test_fixed_forms_at_random():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("@@..++--  0123459ab()é") for _ in range(rng.randint(0, 60)))
        assert pd_.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a:" * 100_000, "(" * 200_000, "+" * 200_000, "1 " * 100_000, "[at]" * 50_000, "@" * 200_000, "+1(" * 70_000])
def test_long_runs_take_linear_time(text):
    pd_.candidate_spans(text, pd_.base_spans(text))


def corpus():
    rng = random.Random(11)
    w = lambda n: [rng.choice("alpha beta gamma delta of the and house tree river".split()) for _ in range(n)]
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows, unseen = [], []
    for i in range(40):
        rows.append((i, " ".join([*w(8), "call", "me:", "+1 " + phone(), *w(8)])))
        rows.append((100 + i, " ".join([*w(8), "Reach", "us", "at", f"{rng.choice('abcd')}{i}@mail.example.com", "or", *w(8)])))
        rows.append((200 + i, " ".join([*w(8), "host", f"10.{i}.3.{rng.randint(0, 255)}", "port", *w(8)])))
    for i in range(6):
        unseen.append((300 + i, " ".join([*w(5), "call", "Me:", phone(), *w(5)])))
        unseen.append((310 + i, " ".join([*w(5), "reach", "us", "at", f"joe{i} [at] mail [dot] org", "or", *w(3)])))
    clean = [(400 + i, " ".join([*w(6), "of", phone(), "the", *w(6), f"{rng.randint(1, 28)}-{rng.randint(10, 12)}-{rng.randint(1990, 2024)}", *w(4)])) for i in range(30)]
    odd = [(500 + i, t) for i, t in enumerate(ODD)] + [(None, "call me: 555-010-9999 now"), (600, None), (1, rows[0][1]), (1, rows[0][1])]
    return rows + unseen + clean + odd


def test_against_plain_learning(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("kind", F.lit(1)).withColumn("uid", F.lit("u")).withColumn("a.b", F.lit(2))
    got = Counter(map(tuple, pd_.find(df).collect()))
    assert got == plain_find(rows)
    by_id = {r[0]: r for r in got}
    assert all(by_id[300 + i][-1] == 1 and "phone:" in by_id[300 + i][-2] for i in range(6))
    assert all(by_id[310 + i][-1] == 1 and "email:" in by_id[310 + i][-2] for i in range(6))
    assert all(by_id[400 + i][-2] == "" for i in range(30))
    assert by_id[None][-1] == 1


def test_patterns_are_readable(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    patterns, _ = pd_.learn(docs, pd_.mentions(docs, "doc_id", "text"), "text")
    shown = {(r.kind, r.shown.lower()) for r in patterns.where("confidence > 0.8").collect()}
    assert {("phone", "call me: _"), ("ip", "host _ port"), ("email", "at _ or")} <= shown


def test_empty(none, spark):
    out = pd_.find(none)
    assert out.count() == 0 and out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    assert pd_.find(spark.createDataFrame([(1, "no such thing")], "doc_id long, text string")).first().spans == ""
