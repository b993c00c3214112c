"""Known answers of the reply rules, on the second engine (tests/test_queries.py holds Spark against it)."""

import duckdb
import pytest

from glossweave.functions import replies as r
from glossweave.functions.dialect import Oracle
from glossweave.plans import replies, steps
from glossweave.sources import samples

D = Oracle()


def read(text, build, column):
    plan = lambda d: (f"SELECT 0 AS id, {d.text(text)} AS text", *build(d)[1:])
    c = duckdb.connect().execute(steps.oracle(plan))
    return dict(zip([x[0] for x in c.description], c.fetchone(), strict=True))[column]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"items": [{"id": 2, "translation": "b"}, {"id": "1", "translation": "a [1]"}, {"id": 2, "translation": "c"}]}', "a [1]|c|"),
        ('{"items": [{"id": 1, "translation": "say \\"hi\\""},],}', 'say "hi"||'),
        ("[[ID:2]] two [1]\n[[ID:1]] one", "one|two [1]|"),
        ("1. first\n2) second", "first|second|"),
        ('{"items": [{"id": 1, "tr', "!truncated"),
        ("nothing", "!unreadable"),
        (samples.ECHO + "\n1. only", "only||"),
        ("```json\n{\"items\": [{\"id\": 3, \"translation\": 7}]}\n```", "||"),
    ],
)
def test_batches(text, want):
    assert read(text, replies.reply_batches, "batch") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"translation": "t", "explanation": "why"}', "t\nwhy"), ("<target>x</target>", "x\n"), ("訳文: これは\n続き\n解説: 理由", "これは\n続き\n理由"), ("# Translation\nhello\nExplanation\nbecause", "hello\nbecause"), ("plain", None),
    ],
)
def test_singles(text, want):
    assert read(text, replies.reply_singles, "single") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("<think>open\n\nafter", "after"), ("<think>never", ""), ("<think>a</think><think>b</think></think> c", "c"), ("CRITICAL:\n- do not echo input\n- translation only\nbody", "body"), ("CRITICAL:\n- keep\nbody", "CRITICAL:\n- keep\nbody")],
)
def test_cleaning(text, want):
    assert read(text, replies.reply_batches, "cleaned") == want


@pytest.mark.parametrize(("text", "want"), [("", False), ('{"a": 1}', False), ('{"a": [1', True), ('{"a": [1}', False), ('{"a": "open', True), ('{"a": "x}"}', False), ("none", False), ('{"a": "\\"}', True)])
def test_truncated(text, want):
    assert read(text, replies.reply_batches, "truncated") is want


def test_sections_and_streams():
    assert read("[standard]\n訳文: long\n解説: z\n[Minimal] m ---", replies.reply_sections, "styles") == "standard=long|minimal=m"
    assert read('{"options":[{"style":"concise","translation":"s","explanation":"e"},{"style":"standard","translation":"l', replies.reply_sections, "preview") == "[concise] s\n- e\n[standard] l"
    assert read('{"choices":[{"delta":{"content":[{"text":"p"},"q",{"x":1},3]}}]}', replies.stream_deltas, "content") == "pq"
    assert read('{"choices":[{"text":"t","reasoning":"r"}]}', replies.stream_deltas, "reasoning") == "r"
    empty = lambda t: duckdb.connect().execute(f"SELECT {r.is_empty_object(D, 'x')} FROM (SELECT {D.text(t)} AS x)").fetchone()[0]
    assert [empty(t) for t in ("", "{}", '{"translation": " "}', '{"translation": 5}', '{"translation": "a"}', "text", '{"a": 1}')] == [True, True, True, True, False, False, False]


CLASSES = [
    ("", "empty"), ("```json\n```", "empty"), ("plain words", "no_json"), ("{bad}", "invalid_json"), ("[1, 2]", "json_type_list"), ('{"a": "x"}', "json_schema_mismatch"), ('{"a": "x', "truncated_json"), ('{"items":[1}', "invalid_json"),
    ("{}", "empty_json_object"), ("{ }", "empty_json_object"), ('{"a": [[[[[[[[[[[[1', "truncated_json"), ('{"a": 1,}', "json_schema_mismatch"), ("text {", "truncated_json"), ("] {}", "empty_json_object"), ('{"a": "\\\\"}', "json_schema_mismatch"),
]


def test_classes_of_failure_on_both_engines(spark):
    from glossweave.functions.dialect import Spark

    names = [w for _, w in CLASSES]
    assert [duckdb.connect().execute(f"SELECT {r.failure(D, 'x')} FROM (SELECT {D.text(t)} AS x)").fetchone()[0] for t, _ in CLASSES] == names
    df = spark.createDataFrame([(t,) for t, _ in CLASSES], "x string").coalesce(1)
    assert [v[0] for v in df.selectExpr(r.failure(Spark(), "x")).collect()] == names


DEPTHS = [(f'{{"a": {"[" * n}', True) for n in (1, 6, 7, 8, 12, 40)] + [(f'{{"a": {"[" * n}1{"]" * n}}}', False) for n in (7, 12, 40)] + [('{"a": [1}', False), ('{"a": "x[', True), ('"q" [', True), ("", False), ('[{"k": "\\"]"}', True)]


def test_truncation_at_any_depth_on_both_engines(spark):
    from glossweave.functions.dialect import Spark

    want = [w for _, w in DEPTHS]
    assert [duckdb.connect().execute(f"SELECT {r.is_truncated(D, 'x')} FROM (SELECT {D.text(t)} AS x)").fetchone()[0] for t, _ in DEPTHS] == want
    df = spark.createDataFrame([(t,) for t, _ in DEPTHS], "x string").coalesce(1)
    assert [v[0] for v in df.selectExpr(r.is_truncated(Spark(), "x")).collect()] == want
