"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed into cells of source, language and topic.  Raking multiplies the cells in turn so
that their totals meet the target shares of sources, of languages and of topics, ``ROUNDS`` times.
The ratio of raked to present tokens is a cell's weight; a document stays with a probability in
proportion to it, at most 1, at the scale at which ``keep`` of all tokens are expected to stay.
Whether a document stays follows from a hash of its id alone, so reruns agree.

Targets that are given are shares of the values they name; a value that a margin's targets don't name keeps its
present share, and the named ones divide the rest in proportion, so nothing is lost for lack of a target.
Targets default to the present shares raised to ``TEMPER`` and made to sum to 1: large sources give way
to small ones.  Every value of a marginal is raked as its own.  Up to ``MAX_CELLS`` cells are fitted on the
driver, and documents meet them in a broadcast join; more are fitted the same way by grouped sums over tables.
A topic, unless a column names it, is the form of the text.

Ties don't arise: equal weights get equal probabilities.  Texts of any length count whole.  Null in source, language or text counts as the empty string; a null id hashes as the empty string.  Texts
without words weigh nothing and follow their cell.  Repeated rows share one decision.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.scratch import discard, materialise, table

ROUNDS = 50
TEMPER = 0.8
KEEP = 0.8
MAX_CELLS = 20_000
MARGINS = ("m_source", "m_lang", "m_topic")


def topic_of(text: Column) -> Column:
    """The form of a text: table, notice, list or prose, by its marks a word."""
    n = F.greatest(F.char_length(text), F.lit(1))

    def share(mark: str) -> Column:
        return (F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))) / n

    return (
        F.when(share("|") > 0.01, "table")
        .when(F.regexp_count(text, F.lit("[@#$%&*]")) / n > 0.02, "marked")
        .when(share("\n") > 0.012, "lines")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words of a text: runs of characters that are not blank."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Cells scaled until each marginal has its target shares of the unchanged total."""
    total = sum(cells.values())
    fitted = dict(cells)
    for _ in range(rounds):
        for at, target in enumerate(targets):
            present: dict[str, float] = {}
            for key, x in fitted.items():
                present[key[at]] = present.get(key[at], 0.0) + x
            fitted = {key: x * target[key[at]] * total / present[key[at]] if present[key[at]] else 0.0 for key, x in fitted.items()}
    return fitted


def probabilities(cells: dict[tuple[str, ...], float], fitted: dict[tuple[str, ...], float], keep: float) -> dict[tuple[str, ...], float]:
    """min(1, scale * weight) for each cell, where the scale makes ``keep`` of the tokens stay in expectation."""
    weight = {k: fitted[k] / x if x else 0.0 for k, x in cells.items()}
    order = sorted((k for k in cells if cells[k]), key=lambda k: (-weight[k], k))
    left, rest = keep * sum(cells.values()), sum(fitted[k] for k in order)
    out = {k: 1.0 for k in cells}
    for i, k in enumerate(order):
        scale = left / rest if rest else 1.0
        if scale * weight[k] <= 1:
            out |= {x: min(1.0, scale * weight[x]) for x in order[i:]}
            break
        left, rest = left - cells[k], rest - fitted[k]
    return out


def tempered(present: dict[str, float], temper: float) -> dict[str, float]:
    total = sum(present.values()) or 1.0
    raised = {k: (x / total) ** temper if x else 0.0 for k, x in present.items()}
    return {k: x / (sum(raised.values()) or 1.0) for k, x in raised.items()}


def completed(present: dict[str, float], given: dict[str, float]) -> dict[str, float]:
    """A share for each value present: what ``given`` does not name keeps its own, the named ones divide the rest."""
    total = sum(present.values()) or 1.0
    own = {k: x / total for k, x in present.items() if k not in given}
    named = sum(given[k] for k in present if k in given)
    rest = 1.0 - sum(own.values())
    return {k: own[k] if k in own else (rest * given[k] / named if named else present[k] / total) for k in present}


def fitted_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, temper: float, rounds: int) -> DataFrame:
    """The margins and m_p of each cell (margins, t), as ``rake`` and ``probabilities`` give them, without a bound on their number."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    x = materialise(cells.withColumn("t", F.col("t").cast("double")).withColumn("x", F.col("t").cast("double")), "raked")
    want = []
    for m in MARGINS:
        present = x.groupBy(m).agg(F.sum("t").alias("t"))
        given = (targets or {}).get(m)
        if given:
            held = spark.createDataFrame(list(given.items()), f"{m} string, share double")
            both = materialise(present.join(held, m, "left").select(m, "t", "share"), "given")
            named, own = both.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("t")))).first()
            rest = 1.0 - float(own or 0) / (total or 1.0)
            given_share = F.col("share") * F.lit(rest / named) if named else F.col("t") / F.lit(total or 1.0)
            share = both.select(m, F.when(F.col("share").isNull(), F.col("t") / F.lit(total or 1.0)).otherwise(given_share).alias("share"))
        else:
            raised = materialise(present.select(m, F.when(F.col("t") > 0, F.pow(F.col("t") / (total or 1.0), F.lit(temper))).otherwise(0.0).alias("w")), "tempered")
            share = raised.select(m, (F.col("w") / F.lit(float(raised.agg(F.sum("w")).first()[0] or 1.0))).alias("share"))
        want.append(materialise(share, "shares"))
    for _ in range(rounds):
        for m, share in zip(MARGINS, want, strict=True):
            factor = x.groupBy(m).agg(F.sum("x").alias("sum")).join(share, m)
            factor = factor.select(m, F.when(F.col("sum") > 0, F.col("share") * total / F.col("sum")).otherwise(0.0).alias("factor"))
            scaled = materialise(x.join(factor, m).select(*MARGINS, "t", (F.col("x") * F.col("factor")).alias("x")), "raked")
            discard(x)
            x = scaled
    weighed = x.withColumn("weight", F.when(F.col("t") > 0, F.col("x") / F.col("t")).otherwise(0.0))
    scale, full = 0.0, -1
    while True:  # cells that reach 1 leave, and the scale of the rest grows until no more do
        least = F.col("weight") * scale <= 1
        left, rest, n = weighed.where("t > 0").agg(F.sum(F.when(~least, F.col("t"))), F.sum(F.when(least, F.col("x"))), F.count(F.when(~least, 1))).first()
        if n == full:
            break
        full = n
        scale = max(scale, (keep * total - (left or 0.0)) / rest) if rest else float("inf")
        if not rest:
            break
    p = F.when(F.col("t") == 0, 1.0).when(F.col("x") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    return weighed.select(*MARGINS, p.alias("m_p"))


def with_probability(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, topic: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc (the row as a struct), m_source, m_lang, m_topic, m_tokens, m_p, m_kept.  ``targets``: margin -> value -> share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("m_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("m_lang"),
        (topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))).alias("m_topic"),
        tokens_of(text).alias("m_tokens"),
    )
    table_of_cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("m_tokens").alias("t")), "cells")
    u = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("double") / float(2**32)
    counted = table_of_cells.limit(MAX_CELLS + 1).collect()
    if len(counted) > MAX_CELLS:
        return rows.join(fitted_cells(table_of_cells, targets, keep, temper, rounds), list(MARGINS)).withColumn("m_kept", u < F.col("m_p"))
    cells = {tuple(r[m] for m in MARGINS): float(r["t"]) for r in sorted(counted, key=lambda r: tuple(r[m] for m in MARGINS))}
    want = []
    for at, m in enumerate(MARGINS):
        present: dict[str, float] = {}
        for key, x in cells.items():
            present[key[at]] = present.get(key[at], 0.0) + x
        given = (targets or {}).get(m)
        want.append(completed(present, given) if given else tempered(present, temper))
    p = probabilities(cells, rake(cells, want, rounds), keep)
    spark = docs.sparkSession
    held = spark.createDataFrame([(*k, x) for k, x in p.items()], "m_source string, m_lang string, m_topic string, m_p double")
    return rows.join(F.broadcast(held), list(MARGINS)).withColumn("m_kept", u < F.col("m_p"))


def sample(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they are."""
    return with_probability(docs, **options).where("m_kept").select("doc.*")


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_probability(table(spark, sf_dir, "documents")).select(
        "doc.doc_id",
        F.col("m_topic").alias("topic"),
        F.col("m_tokens").alias("n_tokens"),
        F.round("m_p", 6).alias("probability"),
        F.col("m_kept").alias("kept"),
    )


def _rounds_sql() -> tuple[str, str]:
    steps, previous = [], "cells"
    for i in range(ROUNDS):
        for j, m in enumerate(MARGINS):
            name = f"r{i}_{j}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.{MARGINS[0]}, c.{MARGINS[1]}, c.{MARGINS[2]}, c.t, "
                f"c.x * g.share * (SELECT sum(t) FROM cells) / sum(c.x) OVER (PARTITION BY c.{m}) AS x "
                f"FROM {previous} c JOIN g{j} g USING ({m}))"
            )
            previous = name
    return ",\n".join(steps), previous


_STEPS, _LAST = _rounds_sql()
OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS m_source, coalesce(lang, '') AS m_lang, coalesce(text, '') AS text,
         greatest(length(coalesce(text, '')), 1) AS n FROM documents),
rows AS (
  SELECT doc_id, m_source, m_lang,
    CASE WHEN (length(text) - length(replace(text, '|', ''))) / n > 0.01 THEN 'table'
         WHEN len(regexp_extract_all(text, '[@#$%&*]')) / n > 0.02 THEN 'marked'
         WHEN (length(text) - length(replace(text, chr(10), ''))) / n > 0.012 THEN 'lines'
         ELSE 'prose' END AS m_topic,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM d),
cells AS MATERIALIZED (SELECT m_source, m_lang, m_topic, sum(n_tokens)::DOUBLE AS t, sum(n_tokens)::DOUBLE AS x FROM rows GROUP BY ALL),
{", ".join(f"p{j} AS (SELECT {m}, power(sum(t) / (SELECT sum(t) FROM cells), {TEMPER}) AS w FROM cells GROUP BY {m}), g{j} AS MATERIALIZED (SELECT {m}, w / (SELECT sum(w) FROM p{j}) AS share FROM p{j})" for j, m in enumerate(MARGINS))},
{_STEPS},
w AS (SELECT *, x / t AS w FROM {_LAST} WHERE t > 0),
s AS (SELECT *, coalesce(sum(t) OVER before, 0) AS t0, coalesce(sum(x) OVER before, 0) AS x0 FROM w
      WINDOW before AS (ORDER BY w DESC, m_source, m_lang, m_topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, ({KEEP} * (SELECT sum(t) FROM cells) - t0) / ((SELECT sum(x) FROM w) - x0) AS scale FROM s),
c AS (SELECT min(t0) AS t0 FROM q WHERE scale * w <= 1),
f AS (SELECT q.scale FROM q JOIN c USING (t0))
SELECT r.doc_id, r.m_topic AS topic, r.n_tokens, round(least(1, coalesce(w.w * (SELECT scale FROM f), 1)), 6) AS probability,
       ('0x' || substr(sha256(r.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296 < least(1, coalesce(w.w * (SELECT scale FROM f), 1)) AS kept
FROM rows r LEFT JOIN w USING (m_source, m_lang, m_topic)
"""
