"""SimHash fingerprints of documents, in DataFrame functions only.

Terms are pairs of neighbouring lower-cased words (the last word pairs with nothing), each
occurrence weighted by the length of its first word, up to ``MAX_WEIGHT``.  A term's 64-bit hash votes on
each bit; bit i of the fingerprint is set where more weight votes for it than against.  Votes of two bits
share one long (32 bits each), so 32 sums serve all 64 bits and partial sums run before any shuffle.

``within`` finds all fingerprints at most ``radius`` bits apart by permuted block tables: 64 bits fall into
``blocks`` blocks, and if at most ``radius`` bits differ then some ``blocks - radius`` blocks agree,
so a table for each such choice, keyed by the chosen blocks, holds every pair.  The query asks it for
every id divisible by ``QUERY_EVERY``: ``n_within`` counts the rows within ``RADIUS`` bits, its own included.

Null counts as empty; texts of any length count whole, and extra columns, whatever their names, for nothing; a text without words has the fingerprint 0.  Equal texts have equal fingerprints.
Rows without an id are left out.  Of rows that repeat an id each distinct text gets a row, and one of
them stands for the id as another's neighbour.  Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm.scratch import materialise, table

MAX_WEIGHT = 16
RADIUS = 3
QUERY_EVERY = 50
_PAIR = 0x0000000100000001
_LEVELS = (10, 25, 40)


def _ones(lane: int) -> Column:
    h = F.shiftrightunsigned("h", lane) if lane else F.col("h")
    return F.sum(h.bitwiseAND(F.lit(_PAIR)) * F.col("weight"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` (which name a text) and the fingerprint as a long."""
    words = texts.select(*keys, F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[\\x20\\x09-\\x0D]+").alias("w"))
    terms = words.select(*keys, "w", F.posexplode("w").alias("i", "word")).select(
        *keys,
        F.xxhash64("word", F.get("w", F.col("i") + 1)).alias("h"),
        F.when(F.col("word") == "", 0).otherwise(F.least(F.char_length("word"), F.lit(MAX_WEIGHT))).cast("long").alias("weight"),
    )
    votes = terms.groupBy(*keys).agg(F.sum("weight").alias("total"), *[_ones(i).alias(f"v{i}") for i in range(32)])
    bits = None
    for i in range(32):
        low = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"v{i}", 32)
        for votes_for, bit in ((low, i), (high, i + 32)):
            part = F.when(2 * votes_for > F.col("total"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
            bits = part if bits is None else bits.bitwiseOR(part)
    return votes.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _near(q: DataFrame, a: DataFrame, radius: int, blocks: int) -> DataFrame:
    """qf, af, distance: all pairs of distinct fingerprints at most ``radius`` bits apart, by permuted block tables."""
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << cut[b + 1]) - (1 << cut[b]) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]

    def tables(fp: str, rows: DataFrame) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        return rows.select(fp, F.explode(keys).alias("key")).select(fp, "key.t", "key.k")

    near = tables("qf", q).join(tables("af", a), ["t", "k"]).withColumn("distance", F.bit_count(F.col("qf").bitwiseXOR(F.col("af"))))
    return near.where(F.col("distance") <= radius).select("qf", "af", "distance").distinct()


def within(queries: DataFrame, all_rows: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """query_id, doc_id, distance for all pairs at most ``radius`` bits apart.

    Both inputs: doc_id, fingerprint.  Equal fingerprints meet once, as one representative each, and are
    expanded only after verification.
    """
    q = queries.select(F.col("fingerprint").alias("qf")).distinct()
    near = _near(q, all_rows.select(F.col("fingerprint").alias("af")).distinct(), radius, blocks)
    return (
        queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("qf"))
        .join(near, "qf")
        .join(all_rows.select("doc_id", F.col("fingerprint").alias("af")), "af")
        .select("query_id", "doc_id", "distance")
    )


def count_within(queries: DataFrame, all_rows: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """fingerprint, n: how many of ``all_rows`` lie at most ``radius`` bits from each distinct fingerprint of ``queries``.

    Equal fingerprints are one row with a count, so copies cost nothing.
    """
    counted = materialise(all_rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("k")), "fingerprint-counts")
    near = _near(queries.select(F.col("fingerprint").alias("qf")).distinct(), counted.select(F.col("fingerprint").alias("af")), radius, blocks)
    return near.join(counted, near["af"] == counted["fingerprint"]).groupBy(F.col("qf").alias("fingerprint")).agg(F.sum("k").alias("n"))


def _successors(ids: DataFrame, level: int = 0) -> DataFrame:
    """x and the next larger x.  Windows cover the at most 2^15 ids that share all but their lowest bits."""
    if level == len(_LEVELS):
        return ids.select("x", F.lead("x").over(Window.orderBy("x")).alias("next"))  # at most 2^24 rows
    shift = _LEVELS[level] - (_LEVELS[level - 1] if level else 0)
    group = ids.select("x", F.shiftright("x", shift).alias("g"))
    inner = group.select("x", "g", F.lead("x").over(Window.partitionBy("g").orderBy("x")).alias("in_group"))
    firsts = group.groupBy("g").agg(F.min("x").alias("first"))
    after = _successors(firsts.select(F.col("g").alias("x")), level + 1).select(F.col("x").alias("g"), F.col("next").alias("g2"))
    opening = after.join(firsts.select(F.col("g").alias("g2"), "first"), "g2").select("g", "first")
    return inner.join(opening, "g", "left").select("x", F.coalesce("in_group", "first").alias("next"))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, next_id (after the last: the first), prev_id, n_chars of the previous one; one row per distinct id."""
    ids = materialise(
        docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).alias("n")), "ids"
    )
    first = ids.agg(F.min("doc_id")).first()[0]
    after = _successors(ids.select(F.col("doc_id").alias("x"))).select(F.col("x").alias("doc_id"), F.coalesce("next", F.lit(first).cast("long")).alias("next_id"))
    after = materialise(after.join(ids, "doc_id"), "next-ids")
    before = after.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.col("n").alias("prev_n"))
    return after.select("doc_id", "next_id").join(before, "doc_id")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The columns of op2: each text's fingerprint, that of its edited text, and how alike they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    beside = materialise(neighbours(docs), "neighbours")
    rows = docs.join(beside, "doc_id").select("doc_id", "next_id", "prev_id", "prev_n", text.alias("text"))
    lent = rows.select(F.col("prev_id").alias("doc_id"), F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("lent"))
    lent = lent.groupBy("doc_id").agg(F.min("lent").alias("lent"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = rows.join(lent, "doc_id").select(
        "doc_id",
        "next_id",
        n.cast("long").alias("n_chars"),
        F.xxhash64("text").alias("h0"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("lent", F.lit(1), cut)).alias("text"),
    )
    edited = edited.withColumn("sha", F.unhex(F.sha2("text", 256)))
    of_edited = fingerprints(edited, ["doc_id", "next_id", "n_chars", "h0", "sha"]).withColumnRenamed("fingerprint", "edited")
    own = materialise(fingerprints(docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("h0"), "text"), ["doc_id", "h0"]), "fingerprints")
    queries = own.where(F.col("doc_id") % QUERY_EVERY == 0)
    found = materialise(count_within(queries, own, RADIUS), "within")
    own = own.join(found.hint("merge"), "fingerprint", "left")
    of_next = own.groupBy("doc_id").agg(F.min_by("fingerprint", "h0").alias("next_fp")).withColumnRenamed("doc_id", "next_id")
    return (
        of_edited.join(own, ["doc_id", "h0"])
        .join(of_next, "next_id")
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("sha")).alias("edited_sha256"),
            as_text(F.col("fingerprint")).alias("fingerprint"),
            as_text(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
            F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("n")).alias("n_within"),
        )
    )


def op2_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
