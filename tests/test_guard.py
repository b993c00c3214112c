import unicodedata

import pytest
from pyspark.sql import functions as F

from glossweave.functions import guards
from glossweave.functions.dialect import Spark
from glossweave.streaming import guard


@pytest.mark.parametrize(
    ("text", "want"),
    [("２兆5,000億円", "25,000 oku yen"), ("2兆円", "20,000 oku yen"), ("▲300億", "-300 oku"), ("3万円", "30k yen"), ("△12円", "△12 yen"), ("「a」、b・c", '"a",b·c'), (None, ""), (" Ａ ", "A"), ("1,2345円", "1,2,345 yen")],
)
def test_english_form(text, want):
    assert guards.english_form(text) == want


def test_form_is_the_compatibility_form():
    changed = [c for c in map(chr, range(0x20, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFKC", c) != c and "円" not in unicodedata.normalize("NFKC", c)]
    assert all(guards.english_form(f"x{c}y") == unicodedata.normalize("NFKC", f"x{c}y").translate(guards._TABLE) for c in changed)


LANGUAGES = [
    ("Hello world", "en", False), ("123,456", "en", False), ("こんにちは", "en", True), ("汉语测试", "en", True), ("한국어", "en", True), ("A・B", "en", False), ("売上高", "en", True), ("2兆5,000億円", "en", False), ("", "en", False),
    ("需要提高效率，降低成本。", "jp", True), ("売上高", "jp", False), ("こんにちは", "JP", False), ("Hello big world", "jp", True), ("  ", "jp", False), ("こんにちは", "fr", False),
]


def test_languages(spark):
    df = spark.createDataFrame([(t, to) for t, to, _ in LANGUAGES], "text string, lang string").coalesce(1).withColumn("form", guards.english_forms(F.col("text")))
    assert [r.m for r in df.selectExpr(guards.mismatch(Spark(), "text", "form", "lang") + " AS m").collect()] == [w for *_, w in LANGUAGES]


ROWS = [(1, 1, 0, "a"), (1, 2, 10, "b"), (1, 3, 20, "cde"), (1, 4, 200, "abcdef"), (1, 5, 210, "g"), (2, 1, 0, "ok "), (2, 2, 100, "日本"), (2, 3, 200, "x"), (3, 1, 5, None), (3, 2, 6, "z")]
SHOWN = {(1, 0, "a", "shown"), (1, 20, "abcde", "shown"), (1, 200, "abcdef", "shown"), (2, 0, "ok ", "shown"), (2, 100, "", "closed"), (3, 6, "z", "shown")}


def test_previews_of_a_table(spark):
    df = spark.createDataFrame(ROWS, "stream_id long, seq long, ms long, text string").repartition(3)
    assert {(r.stream_id, r.ms, r.preview, r.kind) for r in guard.previews(df).collect()} == SHOWN | {(1, 210, "abcdefg", "last")}
    assert guard.previews(df, expected="jp").where("kind = 'closed'").count() == 0


def test_previews_of_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    base = 1_700_000_000_000
    frame = lambda rows: spark.createDataFrame(rows, "stream_id long, seq long, ms long, text string").selectExpr("stream_id", "seq", f"timestamp_millis(ms + {base}) AS ts", "text")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def batch(rows):
            frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(frame([]).schema).parquet(str(tmp_path / "in"))
            query = guard.preview_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert not query.isActive and query.exception() is None

        batch([r for r in ROWS if r[2] < 100])
        batch([r for r in ROWS if r[2] >= 100])  # a new query goes on from the checkpoint
        batch([(9, 1, 300_000, "later")])  # time passes, and what was held back is shown
        batch([(1, 6, 20, " late"), (9, 2, 300_100, "later on")])  # a row behind the watermark counts for nothing
        got = {(r.stream_id, r.preview, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    assert got >= {(s, t, k) for s, _, t, k in SHOWN} | {(1, "abcdefg", "last"), (9, "later", "shown"), (9, "later on", "shown")}
    assert not any("late" in t for s, t, _ in got if s == 1)
