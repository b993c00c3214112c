"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text's set of word shingles (``width`` words each) is hashed once; the ``SKETCH`` smallest values
   are its sketch.  Texts with the same set form one class; a hash of the set names it (its node).
2. Inverted lists: every pair among the ``indexed(percent)`` smallest retained values names a list.  Two
   sets at the threshold share at least two of those values but for a chance of ``MISS`` (for 80 percent: of
   ten values, 0.2^10 + 8 * 0.2^9 = 4e-6); smaller sets and higher similarities miss less.
3. Dense groups first.  Classes with the same smallest value are held, by their sketches, against ``LEADERS`` of
   them, and each takes the most similar one as a likely link.  The lists then shrink to one member for each
   likely component, and those beside a list's largest component are held against some members of it.  So a group of near copies that holds a third of all rows costs a few
   estimates and two links a member.  All likely links are confirmed on the full sets and closed to components.
4. Lists are long where many unlike texts share a passage.  All members of long lists are named by single further values of
   their sketches as well, without the common ones (at most ``COMMON`` values that most members hold): of the ``m`` smallest values
   a member with ``c`` common ones takes the others, where a linked pair shares more than ``c`` of ``m`` but for a chance of ``MISS``.
   So linked members meet in a list of one rare value, and only members whose sketches are common throughout (dense groups) go on,
   in lists of one value each, which are fewer than those of pairs.
5. The lists are then completed: between two members outside a list's main component a list of at
   most ``SHORT`` tries all pairs of different components; an outside member that resembles a main one
   is held against the whole component, in chunks, on the full sets.  A longer list holds all its outside
   members against a large main component and goes on without it; without one, its members that some
   other one resembles are compared on the full sets in pairs of blocks of ``SHORT`` (sketches in larger ones), each of which gives no
   more links than it has members.  A pair counts in the list of its two smallest shared values only.
   Nothing is capped or dropped.  The blocks of a long list without a large component, and the chunks of a large
   component times its outside members, grow faster than the list: k members take k * ceil(k / block) rows.

A pair is confirmed on the full sets where its union sketch estimates ``likely(percent)`` or more, 5.2 standard
deviations below the threshold: of 64 values at least 35 must agree for 80 percent, which a linked pair
fails with a chance of 3e-7.  The lists and this filter are the two probabilistic steps.

Null and empty texts have an empty set and no link.  Texts may be of any length: sets grow with them, sketches do
not.  Repeated rows share a class.  Rows that repeat an id with differing texts are documents of their own.  A
component is named by its smallest id (of ties nothing depends); a row with a null id gets its component's
and is never kept, and a component without any id is named null.  Extra columns are ignored by ``near_duplicates``
and untouched by ``drop_near_duplicates``, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.components import components
from glossweave.llm.kernels import U, byte_rows, mix, word_hashes
from glossweave.llm.scratch import discard, materialise, table

SKETCH = 64
SHORT = 128
LEADERS = 4
MAIN_LEADERS = 8
MISS = 5e-6
COMMON = 4096
CHUNK = 4096
COLUMNS = 16384
_PAD = np.uint32(0xFFFFFFFF)
_NONE = U(2**64 - 1)


def indexed(percent: int) -> int:
    """How many of the smallest values must be indexed so that a linked pair shares two but for a chance of MISS."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    q = 1 - percent / 100
    return next(k for k in range(2, SKETCH) if q**k + k * (1 - q) * q ** (k - 1) <= MISS)


def depths(percent: int) -> np.ndarray:
    """For c = 0, 1, ...: of how many of the smallest values a linked pair shares more than c but for a chance of MISS (more than SKETCH: of too many)."""
    p = percent / 100
    fewer = lambda m, c: sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(c + 1))
    return np.array([next((m for m in range(c + 1, SKETCH + 1) if fewer(m, c) <= MISS), SKETCH + 1) for c in range(SKETCH + 1)])


def likely(percent: int) -> float:
    """The least estimate of a union sketch at which a pair is confirmed."""
    p = percent / 100
    return p - 5.2 * (p * (1 - p) / SKETCH) ** 0.5


def shingle_set(b: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    w = word_hashes(b, True)
    if len(w) == 0:
        return w
    if len(w) < width:
        width = len(w)
    h = np.full(len(w) - width + 1, U(width))
    for i in range(width):
        h = mix(h * U(0xD6E8FEB86659FD93) + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def sketches(rows: DataFrame, width: int, low_values: int) -> DataFrame:
    """d, h, n, two sums that name the set, the sketch, and the smallest values for the index (of d, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sketch, low = [], [], [], [], []
            for b in byte_rows(batch.column(2)):
                s = shingle_set(b, width)
                n.append(len(s))
                s1.append(int(s.sum().view(np.int64)) if len(s) else 0)
                s2.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                sketch.append((s[:SKETCH] >> U(32)).astype(np.uint32).tobytes())
                low.append(s[:low_values].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(low, pa.binary())],
                names=["d", "h", "n", "s1", "s2", "sketch", "low"],
            )

    return rows.select("d", "h", "text").mapInArrow(run, "d long, h long, n long, s1 long, s2 long, sketch binary, low binary")


def _postings(classes: DataFrame) -> DataFrame:
    """key, node: a row for each pair of smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, low in zip(node, batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(low, np.uint64)
                i, j = np.triu_indices(len(v), 1)
                keys.append(list_name(v[i], v[j]))
                owner.append(np.full(len(i), r))
            yield pa.record_batch({"key": np.concatenate(keys), "node": np.concatenate(owner).astype(np.int64)})

    return classes.select("node", "low").mapInArrow(run, "key long, node long")


def _padded(values: list[bytes], pad: np.unsignedinteger = _PAD) -> np.ndarray:
    """The sketches as rows of SKETCH values, or with ``_NONE`` as many smallest values as one has at most."""
    m = np.full((len(values), SKETCH if pad is _PAD else max((len(v) for v in values), default=0) // 8), pad)
    for i, s in enumerate(values):
        v = np.frombuffer(s, pad.dtype)
        m[i, : len(v)] = v
    return m


def _estimates(sk: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarities of many pairs of rows, CHUNK at a time."""
    parts = [slice(s, s + CHUNK) for s in range(0, len(i), CHUNK)]
    return np.concatenate([np.zeros(0), *(estimate(sk[i[x]], sk[j[x]], n[i[x]], n[j[x]]) for x in parts)])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row-wise similarity from the union sketch; exact where both sets fit their sketches."""
    u = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = u != _PAD
    twice = np.zeros(u.shape, bool)
    twice[:, 1:] = (u[:, 1:] == u[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    whole = (na <= SKETCH) & (nb <= SKETCH)
    limit = np.where(whole, 2 * SKETCH, SKETCH)[:, None]
    total = np.minimum(rank[:, -1], limit[:, 0])
    return (twice & (rank <= limit)).sum(axis=1) / np.maximum(total, 1)


def list_name(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of the list of two retained values, the smaller one first."""
    return mix(mix(v) * U(31) + w).view(np.int64)


def _own_list(low: np.ndarray, i: np.ndarray, j: np.ndarray, key: int, values: int) -> np.ndarray:
    """Which pairs have this list as the one of their two smallest shared values (or the smallest one); each pair counts in that one."""
    shared = (low[i][:, :, None] == low[j][:, None, :]).any(axis=2) & (low[i] != _NONE)
    order = np.cumsum(shared, axis=1)
    first, second = (np.where(shared & (order == k), low[i], 0).max(axis=1) for k in (1, 2))
    return (list_name(first, second) if values == 2 else first.view(np.int64)) == key


def _shared(owner: np.ndarray, place: np.ndarray, members: int, split: int) -> np.ndarray:
    """How many values each of the first ``split`` members shares with each other one (with all, if all come first), some columns at a time.

    A row of ``owner`` and ``place`` says that a member holds a value; values of one member alone need no column.
    """
    several = np.bincount(place) > 1
    column = np.cumsum(several) - 1
    owner, place = owner[several[place]], column[place[several[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    last = split if split < members else 0
    both = np.zeros((split, members - last), np.float32)
    for s in range(0, int(several.sum()), COLUMNS):
        x, y = np.searchsorted(place, [s, s + COLUMNS])
        has = np.zeros((members, min(COLUMNS, int(several.sum()) - s)), np.float32)
        has[owner[x:y], place[x:y] - s] = 1
        both += has[:split] @ has[last:].T
    return both


def _cross_pairs(
    node: np.ndarray, n: np.ndarray, sk: np.ndarray, low: np.ndarray, c: np.ndarray, main: int, name: int, percent: int, own: int
) -> list[tuple[int, int, bool]]:
    """Of one short list: likely pairs outside its main component, and members that some main member resembles.

    ``own``: of how many values the lists are; a pair counts only in the list of its smallest shared ones, or with 0 in any.
    """
    g, least = len(node), likely(percent)
    owner, real = np.repeat(np.arange(g), SKETCH), sk.ravel() != _PAD
    _, place = np.unique(sk.ravel()[real], return_inverse=True)
    size = np.minimum(n, SKETCH)
    close = _shared(owner[real], place, g, g) >= least * np.minimum(size[:, None], size[None, :])  # follows from the estimate that is asked for below
    close &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    close &= c[:, None] != c[None, :]
    i, j = np.nonzero(np.triu(close, 1))
    ok = _estimates(sk, n, i, j) >= least
    i, j = i[ok], j[ok]
    several = (c == main).sum() > 1
    beside = several & ((c[i] == main) | (c[j] == main))
    parts = [slice(s, s + CHUNK) for s in range(0, len(i) if own else 0, CHUNK)]
    mine = beside | np.concatenate([np.zeros(0, bool), *(_own_list(low, i[x], j[x], name, own) for x in parts)]) if own else np.ones(len(i), bool)
    out = set()
    for x, y in zip(i[mine], j[mine], strict=True):
        if several and (c[x] == main or c[y] == main):
            out.add((int(node[y if c[x] == main else x]), main, True))
        else:
            out.add((max(int(node[x]), int(node[y])), min(int(node[x]), int(node[y])), False))
    return list(out)


def _by_list(rows: DataFrame, key: list[str], solve: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame | None], schema: str) -> DataFrame:
    """``solve`` for the rows of some whole keys (each a short list, or a pair of blocks) with the place of each, as they stream by in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for df in frames:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            cut = np.append(np.flatnonzero((df[key] != df[key].shift()).any(axis=1).to_numpy()), len(df))
            if len(cut) > 2 and (out := solve(df.iloc[: cut[-2]], list(zip(cut[:-2], cut[1:-1], strict=True)))) is not None:
                yield out
            rest = df.iloc[cut[-2] :]
        if rest is not None and (out := solve(rest, [(0, len(rest))])) is not None:
            yield out

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def _found(df: pd.DataFrame, places: list[tuple[int, int]], percent: int, own: int) -> Iterator[tuple[int, list[tuple[int, int, bool]]]]:
    """The name of each list and what it gives."""
    sk, low = _padded(df["sketch"].tolist()), _padded(df["low"].tolist(), _NONE)
    node, n, c, main, name = (df[x].to_numpy() for x in ("node", "n", "c", "main", "name"))
    for s, t in places:
        yield int(name[s]), _cross_pairs(node[s:t], n[s:t], sk[s:t], low[s:t], c[s:t], int(main[s]), int(name[s]), percent, own)


def _short(lists: DataFrame, percent: int, own: int) -> DataFrame:
    """a, b, whole: from lists of at most SHORT members, pairs (whole is false) or a member and a component (true)."""

    def solve(df: pd.DataFrame, places: list[tuple[int, int]]) -> pd.DataFrame | None:
        found = {p for _, pairs in _found(df, places, percent, own) for p in pairs}
        return pd.DataFrame(list(found), columns=["a", "b", "whole"]) if found else None

    return _by_list(lists.select("key", "node", "n", "sketch", "low", "c", "main", "name"), ["key"], solve, "a long, b long, whole boolean")


def _flags(blocks: DataFrame, percent: int, own: int) -> DataFrame:
    """name, node: members of long lists that some other member resembles by its sketch (so many rows as members, not pairs)."""

    def solve(df: pd.DataFrame, places: list[tuple[int, int]]) -> pd.DataFrame | None:
        found = {(name, x) for name, pairs in _found(df, places, percent, own) for a, b, _ in pairs for x in (a, b)}
        return pd.DataFrame(list(found), columns=["name", "node"]) if found else None

    return _by_list(blocks.select("key", "node", "n", "sketch", "low", "c", "main", "name"), ["key"], solve, "name long, node long").distinct()


def _in_blocks(rows: DataFrame, name: str, members: int) -> DataFrame:
    """Each member of a list once for every pair of blocks of about ``members`` that its own block is in; ``x`` and ``y`` name the pair."""
    size = materialise(rows.groupBy(name).agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("blocks")), "blocks")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = rows.join(size, name).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("mine", "other", "blocks")


def block_links(flags: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: of the flagged members of each list, the links on full sets, a pair of blocks at a time; of each tangle a spanning tree."""

    def tree(values: list[np.ndarray], nodes: list[int]) -> Iterator[tuple[int, int]]:
        root = list(range(len(nodes)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(_reach(values, values, percent), 1)), strict=True):
            x, y = top(i), top(j)
            if x != y:
                root[x] = y
                yield nodes[i], nodes[j]

    def solve(df: pd.DataFrame, places: list[tuple[int, int]]) -> pd.DataFrame | None:
        values, nodes = [np.frombuffer(s, np.uint64) for s in df["set"]], df["node"].tolist()
        out = [p for s, t in places if t - s > 1 for p in tree(values[s:t], nodes[s:t])]
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    rows = _in_blocks(flags, "name", SHORT).join(sets.withColumnRenamed("id", "node").hint("merge"), "node")
    return _by_list(rows.select("name", "x", "y", "node", "set"), ["name", "x", "y"], solve, "a long, b long")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, least: float) -> DataFrame:
    """a, b, e: the distinct pairs whose sizes allow a link and whose union sketch estimates ``least`` or more."""
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                df["e"] = estimate(_padded(df["sa"].tolist()), _padded(df["sb"].tolist()), df["na"].to_numpy(), df["nb"].to_numpy())
                yield df.loc[df["e"] >= least, ["a", "b", "e"]]

    rows = pairs.distinct().join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return rows.mapInPandas(run, "a long, b long, e double")


def first_pairs(classes: DataFrame) -> DataFrame:
    """a, b: each class with leaders among those that have the same smallest value, chosen by hashes."""
    lists = classes.select(F.xxhash64(F.substring("low", 1, 8)).alias("key"), "node")
    leaders = F.array_distinct(F.array(*[F.min_by("node", F.struct(F.xxhash64("node", F.lit(i)), "node")) for i in range(LEADERS)]))
    led = lists.groupBy("key").agg(leaders.alias("led"), F.count(F.lit(1)).alias("k")).where("k > 1")
    led = materialise(led.select("key", F.explode("led").alias("b")), "leaders")
    return lists.join(led, "key").where("node <> b").select(F.col("node").alias("a"), "b")


def labelled_lists(lists: DataFrame, label: DataFrame) -> DataFrame:
    """key, node, c: the members of each list with their component."""
    rows = lists.join(label.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    return materialise(rows, "labelled-lists")


def round_pairs(rows: DataFrame) -> DataFrame:
    """a, b: for each list and component one member, with two of the leaders of the list's largest component.

    A list has one row with at most ``MAIN_LEADERS`` leaders, and a member takes two places in it by its own hash, so
    the rows follow the components of the lists.  A hash of the node alone chooses, so that two components meet in few distinct pairs.
    """
    weight = materialise(rows.groupBy("key", "c").agg(F.min_by("node", F.xxhash64("node")).alias("node"), F.count(F.lit(1)).alias("k")), "list-components")
    main = weight.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("c"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = materialise(main.select("key", "c"), "mains")
    led = rows.join(main, ["key", "c"]).groupBy("key", F.col("c").alias("main")).agg(
        F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(MAIN_LEADERS)])).alias("led")
    )
    led = materialise(led, "leaders")
    chosen = [F.get("led", F.pmod(F.xxhash64("node", F.lit(i)), F.size("led")).cast("int")) for i in (-1, -2)]
    return weight.join(led, "key").where("c <> main").select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array(*chosen))).alias("b"))


def likely_links(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """a, b: for each class at most two likely links; sketches alone decide, and the components between are provisional."""

    def best(pairs: DataFrame, least: float) -> DataFrame:
        scored = estimated(pairs, known, percent, least)
        return materialise(scored.groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b")), "likely")

    first = best(first_pairs(known), percent / 100)
    rows = labelled_lists(lists, first.toDF("node", "component"))
    second = best(round_pairs(rows), percent / 100 - 0.025)
    discard(rows)
    return first.unionByName(second).distinct()


def common_values(members: DataFrame) -> np.ndarray:
    """Values that more than about SHORT sketches hold, at most COMMON of them.  Which they are decides about work alone, not about the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, k = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), return_counts=True)
            yield pa.record_batch({"value": values[k > 1].astype(np.int64), "k": k[k > 1].astype(np.int64)})

    k = members.select("sketch").mapInArrow(run, "value long, k long").groupBy("value").agg(F.sum("k").alias("k")).where(F.col("k") > SHORT)
    return np.array([r.value for r in k.orderBy(F.desc("k"), "value").limit(COMMON).collect()], np.uint32)


def rare_lists(members: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """key, node, n, c, sketch, low, hard: each member for the uncommon ones of its smallest values; ``hard``: links may have none of these in common.

    Of two linked members one is not hard; let m be its depth and c its common values among as many.  More than c of the m smallest
    values of the union are shared, so an uncommon one is, and it is among the m smallest of either.  Hard members take all uncommon values.
    """
    need = depths(percent)

    def taken(v: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
        known = np.isin(v, common)
        c = np.cumsum(known)
        enough = np.flatnonzero(need[c] <= np.arange(1, len(v) + 1))
        if len(enough):
            m = enough[0] + 1
            return v[:m][~known[:m]], False
        return v[~known], bool(n > SKETCH or 100 * c[-1] >= percent * n)  # a whole set in the sketch leaves nothing to chance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, hard = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, (n, sketch) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                v, h = taken(np.frombuffer(sketch, np.uint32), n)
                v = np.append(v.astype(np.int64), [-1] if h else [])  # a hard one has a row at least
                at.append(np.full(len(v), i))
                keys.append(v.astype(np.int64))
                hard.extend([h] * len(v))
            rows = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *rows.columns, pa.array(hard, pa.bool_())], names=["key", "node", "n", "c", "sketch", "low", "hard"])

    return members.select("node", "n", "c", "sketch", "low").mapInArrow(run, "key long, node long, n long, c long, sketch binary, low binary, hard boolean")


def rare_pairs(long: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Likely pairs (a, b, whole) of members of long lists that share a rare value; lists of one value each (key, node, c) of the members that may have other pairs."""
    members = materialise(long.select("node", "c").distinct().join(full, "node"), "members")
    rows = materialise(rare_lists(members, common_values(members), percent), "rare-lists")
    sizes = rows.where("key >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("size"), (F.min("c") < F.max("c")).alias("parts"))
    sizes = materialise(sizes.where("parts").select("key", "size"), "rare-sizes")
    short = rows.join(sizes.where(F.col("size") <= SHORT), "key").withColumn("main", F.lit(-(2**63))).withColumn("name", F.col("key"))
    pairs = materialise(_short(short, percent, 0), "rare")
    crowded = rows.join(sizes.where(F.col("size") > SHORT), "key").select("node")
    hard = rows.where("hard").select("node").unionByName(crowded).distinct()
    hard = members.select("node", "c", "low").join(hard.hint("merge"), "node", "left_semi")
    return pairs, materialise(_single_values(hard, int(depths(percent)[0])), "hard-lists")


def _single_values(members: DataFrame, m: int) -> DataFrame:
    """key, node, c: a row for each of the ``m`` smallest values, of which a linked pair shares one but for a chance of MISS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(low, np.int64)[:m] for low in batch.column(2).to_pylist()]
            rows = batch.take(pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values])))
            yield pa.record_batch({"key": np.concatenate([np.zeros(0, np.int64), *values]), "node": rows.column(0), "c": rows.column(1)})

    return members.mapInArrow(run, "key long, node long, c long")


def cross_pairs(rows: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Likely pairs that share a list and not yet a component, or a member and a whole component (a, b, whole); members to compare in long lists (name, node)."""
    full = known.select("node", "n", "sketch", "low").hint("merge")
    found: list[DataFrame] = []
    flags: list[DataFrame] = []
    hard: DataFrame | None = None
    own = 2
    while True:
        weight = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
        sizes = weight.groupBy("key").agg(F.sum("k").alias("size"), F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.count(F.lit(1)).alias("parts"))
        sizes = materialise(sizes.where("parts > 1").select("key", "size", "main", "most"), "sizes")
        rows = materialise(rows.join(sizes, "key"), "open-lists")
        found.append(materialise(_short(rows.where(F.col("size") <= SHORT).withColumn("name", F.col("key")).join(full, "node"), percent, own), "short"))
        long = rows.where(F.col("size") > SHORT)
        if long.isEmpty():
            break
        if hard is None:
            pairs, hard = rare_pairs(long, full, percent)
            found.append(pairs)
            rows, own = hard, 1
            continue
        big = F.col("most") >= max(2, SHORT // 4)
        rest = long.where(big & (F.col("c") != F.col("main")))  # what is outside a large component is held against all of it
        beside = materialise(rest.select(F.col("node").alias("a"), F.col("main").alias("b"), F.lit(True).alias("whole")).distinct(), "beside")
        found.append(beside)
        mixed = long.where(~big).select("key", "node", "c")
        blocks = _in_blocks(mixed, "key", 3 * SHORT).withColumn("name", F.col("key")).withColumn("key", F.xxhash64("key", "x", "y")).withColumn("main", F.lit(-(2**63)))
        flags.append(materialise(_flags(blocks.join(full, "node"), percent, own), "flags"))
        if beside.isEmpty():
            break
        rows = rest.select("key", "node", "c")
    flags.append(known.sparkSession.createDataFrame([], "name long, node long"))
    return reduce(DataFrame.unionByName, found).distinct(), reduce(DataFrame.unionByName, flags).distinct()


def _confirmed(pairs: DataFrame, beside: DataFrame, flags: DataFrame, label: DataFrame, known: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: the links among ``pairs``, between members (a) and whole components (b) of ``beside``, and among ``flags``."""
    members = label.unionByName(label.select(F.col("component").alias("node"), "component")).distinct()
    visited = members.join(beside.select(F.col("b").alias("component")).distinct(), "component", "left_semi").select(F.col("node").alias("id"))
    ids = visited.unionByName(beside.select(F.col("a").alias("id")))
    sets = full_sets(ids.unionByName(_ends(pairs)).unionByName(flags.select(F.col("node").alias("id"))).distinct(), known, texts, width)
    links = beside_components(beside, label, sets, percent).unionByName(block_links(flags, sets, percent)).unionByName(confirm(pairs, sets, percent).where("linked").select("a", "b"))
    links = materialise(links.distinct(), "checked")
    discard(sets)
    return links


def full_sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """id, set: the whole shingle sets of the classes named in ``nodes`` (id), read from one text each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            node = batch.column(0).to_numpy()
            new = np.append(node[:1] != before, node[1:] != node[:-1]) if len(node) else np.zeros(0, bool)
            before = node[-1] if len(node) else before
            batch = batch.filter(pa.array(new))  # the join leaves repeated rows side by side
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(b, width).tobytes() for b in byte_rows(batch.column(1))], pa.binary())], names=["id", "set"]
            )

    at = classes.join(nodes, classes["node"] == nodes["id"], "left_semi").select("node", F.col("at.d").alias("d"), F.col("at.h").alias("h"))
    rows = texts.join(at.hint("merge"), ["d", "h"]).select("node", "text")  # alike at every size
    return materialise(rows.mapInArrow(sets, "id long, set binary"), "sets")


def _reach(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of the two lists of sets reach the threshold, by products of parts of their incidence matrices."""
    same = a is b
    _, place = np.unique(np.concatenate(a if same else [*a, *b]), return_inverse=True)
    size = np.array([len(x) for x in (a if same else (*a, *b))])
    both = _shared(np.repeat(np.arange(len(size)), size), place, len(size), len(a)).astype(np.int64)
    if same:
        return 100 * both >= percent * (size[:, None] + size[None, :] - both)
    return 100 * both >= percent * (size[: len(a), None] + size[None, len(a) :] - both)


def beside_components(pairs: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links of members (a) with any member of a component (b names it), confirmed on the full sets.

    Components meet their visitors in chunks of at most about SHORT members, so no task holds a whole one.
    """
    roots = component.select(F.col("component").alias("node"), "component").distinct()
    chunks = component.groupBy("component").agg(F.ceil((F.count(F.lit(1)) + 1) / SHORT).cast("int").alias("chunks"))
    chunks = chunks.join(pairs.select(F.col("b").alias("component")).distinct(), "component", "left_semi")
    chunks = materialise(chunks, "chunks")
    own = component.unionByName(roots).join(chunks, "component")
    own = own.select("component", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.col("node").alias("id"), F.lit(False).alias("visits"))
    guests = pairs.select(F.col("b").alias("component"), F.col("a").alias("id")).distinct().join(chunks, "component")
    guests = guests.select("component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", F.lit(True).alias("visits"))
    rows = own.unionByName(guests).join(sets, "id").repartition("component", "chunk").sortWithinPartitions("component", "chunk", "visits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, members, waiting = None, [], []

        def solve() -> pd.DataFrame:
            out = []
            if members and waiting:
                hit = _reach([x for _, x in waiting], members, percent).any(axis=1)
                out = [(g, here[0]) for (g, _), h in zip(waiting, hit, strict=True) if h]
            return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

        for df in frames:
            for c, k, i, visits, s in zip(df["component"], df["chunk"], df["id"], df["visits"], df["set"], strict=True):
                if here != (c, k):
                    yield solve()
                    here, members, waiting = (c, k), [], []
                if not visits:
                    members.append(np.frombuffer(s, np.uint64))
                else:
                    waiting.append((i, np.frombuffer(s, np.uint64)))
                    if len(waiting) >= SHORT:
                        yield solve()
                        waiting = []
        yield solve()

    return rows.select("component", "chunk", "id", "visits", "set").mapInPandas(run, "a long, b long")


def confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: 100 * intersection >= percent * union, on the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= percent * (len(z) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return (
        pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
        .join(full.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(compare, "a long, b long, linked boolean")
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after the components at both ends of each link have become one."""
    if label is None:
        return materialise(components(links), "labels")
    to_a, to_b = (label.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("a", "ca"), ("b", "cb")))
    between = links.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    further = materialise(components(between), "further").select(F.col("node").alias("old"), F.col("component").alias("last"))
    moved = label.join(further, label["component"] == further["old"], "left").select("node", F.coalesce("last", "component").alias("component"))
    return materialise(moved.unionByName(further.select(F.col("old").alias("node"), F.col("last").alias("component"))), "labels")


def _labels(classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component of every class that is not its component's own name."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets link with none but equal ones
    known = classes.where(F.col("n") >= least)
    postings = materialise(_postings(known), "postings")
    several = postings.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    lists = materialise(postings.join(several.hint("merge"), "key"), "lists")
    discard(postings)
    pairs = materialise(likely_links(lists, known, percent), "pairs")
    sets = full_sets(_ends(pairs), known, texts, width)
    label = _merged(None, materialise(confirm(pairs, sets, percent).where("linked").select("a", "b"), "checked"))
    discard(sets)
    rows = labelled_lists(lists, label)
    discard(lists)
    more, flags = (materialise(x, "more") for x in cross_pairs(rows, known, percent))
    links = _confirmed(more.where("not whole").select("a", "b"), more.where("whole").select("a", "b"), flags, label, known, texts, width, percent)
    discard(rows, more)
    return _merged(label, links)


def labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """d, h, n, component of every distinct (id, text), and the rows (d, h, text) these come from; d is the id, null last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    signed = materialise(sketches(texts, width, indexed(percent)), "sketches")
    classes = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("d", "h")).alias("at"), F.first("sketch").alias("sketch"), F.first("low").alias("low"))
    classes = materialise(classes.withColumn("node", F.xxhash64("n", "s1", "s2")), "classes")
    named = classes.select("n", "s1", "s2", "node").join(_labels(classes, texts, width, percent).hint("merge"), "node", "left")
    named = materialise(named.select("n", "s1", "s2", F.coalesce("component", "node").alias("component")), "components")
    return signed.select("d", "h", "n", "s1", "s2").join(named.hint("merge"), ["n", "s1", "s2"], "left").select("d", "h", "n", "component"), texts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (whether it is its component's smallest id)."""
    rows, _ = labelled(docs, id_col, text_col, width, percent)
    rows = materialise(rows, "labelled")
    least = materialise(rows.where("component is not null").groupBy("component").agg(F.min("d").alias("first")), "least")
    own = F.nullif(F.col("d"), F.lit(2**63 - 1))
    first = F.nullif(F.coalesce("first", "d"), F.lit(2**63 - 1))
    return rows.join(least, "component", "left").select(
        own.alias("doc_id"), F.col("n").alias("n_shingles"), first.alias("component_id"), F.coalesce(own == first, F.lit(False)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, columns as they are, without all but one text of each component.

    The text with the smallest id stays (a null id comes last; of one id's texts, that with the smallest hash).
    Texts without words are no near copies of each other and stay.  Repeated rows stay or go together.
    """
    rows, _ = labelled(docs, id_col, text_col, width, percent)
    rows = materialise(rows.distinct(), "labelled")
    best = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("d", "h")).alias("best"))
    gone = rows.join(materialise(best, "least"), "component").where(F.struct("d", "h") != F.col("best"))
    gone = materialise(gone.select(F.col("d").alias("__gone_d"), F.col("h").alias("__gone_h")), "gone")
    d, h = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(gone, (d == gone["__gone_d"]) & (h == gone["__gone_h"]), "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS r FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
