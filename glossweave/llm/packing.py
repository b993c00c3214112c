"""Best-fit packing of token sequences by large-item matching.

Texts become token ids, ended by one separator id, and only sequences longer than the capacity are cut.
How full bins get depends on lengths alone, so the packing is planned on the histogram of piece lengths
(at most ``capacity`` entries, however many documents there are):

* Pieces above one third of the capacity, largest first, pair with the largest remaining one
  that fits; at most two such pieces share a bin.
* Smaller pieces, largest first, go where the remaining gap is tightest, and else open a bin.

All pieces of one length are alike, so a plan entry says: the next n bins take m pieces of length l
each at offset o.  Executors rank the pieces inside each (task, length), add the counts of earlier
tasks, and look their place up in the plan.  No key gathers more rows than one task wrote.

Null text counts as empty, which is the separator alone.  Very long texts are cut into as many pieces as
they need.  Repeated rows are packed one by one.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm.scratch import materialise, table

CACHED_WORDS = 300_000
# So many bytes of texts are encoded at once.
AT_ONCE = 1 << 23
# White space to the splitting of runs, but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_ENCODERS: dict = {}


class _Encoder:
    """Ids of texts as little-endian bytes.

    A tokenizer that lower-cases, drops white space and marks the end of words works on one word at a time,
    so what stands between white space has ids of its own.  Such runs are split, made distinct and put together again as
    Arrow arrays, so each distinct run of some texts is cut into words once.  ``words`` holds the ids of words seen lately,
    ``older`` those before, both bounded.  What neither has is encoded in one call and cut at the ends of words.  Any
    other tokenizer, and texts with the strings of special tokens, are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("type") == "Split" and cuts[0].get("invert") is True
        self.by_word &= spec.get("post_processor") is None and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            self.cut = regex.compile(cuts[0]["pattern"]["Regex"]).findall
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        new = []
        for w in set(parts):
            if w not in self.words:
                if w in self.older:
                    self.words[w] = self.older[w]
                else:
                    new.append(w)
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and (not len(cuts) or cuts[-1] == len(ids)):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.words.update((w, raw[x:y]) for w, x, y in zip(some, at, at[1:], strict=False))
            else:
                self.words.update((w, self._whole(w)) for w in some)

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        out, plain, at = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if not self.by_word or any(t in text for t in self.special):
                out[i] = self._whole(text)
                continue
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # lower() alone minds a final sigma
            if any(x in text for x in _SEPARATORS):
                out[i] = self._run_ids([text])[0]
            else:
                plain.append(text)
                at.append(i)
        if plain:
            lists = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
            runs = lists.flatten().dictionary_encode()
            ids = pa.array(self._run_ids(runs.dictionary.to_pylist()), pa.large_binary()).take(runs.indices)
            _, ends, data = ids.buffers()
            ends = np.frombuffer(ends, np.int64, len(ids) + 1, 8 * ids.offset)[lists.offsets.to_numpy()].tolist()
            data = memoryview(data) if data else b""
            for i, lo, hi in zip(at, ends, ends[1:], strict=False):
                out[i] = bytes(data[lo:hi])
            del lists, runs, ids, data
            pa.default_memory_pool().release_unused()  # or the worker keeps some 100 MB from one call to the next
        return out

    def _run_ids(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs."""
        cuts = list(map(self.cut, runs))
        self._learn(list(chain.from_iterable(cuts)))
        out = [b"".join(map(self.words.__getitem__, parts)) for parts in cuts]
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, the writing task and the rank inside (task, length), and the ids if wanted."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.setdefault(tokenizer_path, None) or _Encoder(tokenizer_path)
        _ENCODERS[tokenizer_path] = enc
        pa.default_memory_pool().release_unused()  # what earlier tasks of the worker left
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * keep_ids]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size, lo = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(size, AT_ONCE + (size[lo - 1] if lo else 0), "right")))
                cols: list[list] = [[] for _ in names]
                for i, ids in zip(doc_ids[lo:hi], enc.all_ids([x or "" for x in texts[lo:hi].to_pylist()]), strict=True):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part_ids = ids[at : at + 4 * capacity]
                        n = len(part_ids) // 4
                        row = (i, p, at // 4, n, zlib.crc32(part_ids), part, seen[n], part_ids)
                        seen[n] += 1
                        for c, v in zip(cols, row, strict=False):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * keep_ids
    )


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """length, first (rank), sequence, each, offset: from rank ``first`` on, bins from ``sequence`` on take ``each`` pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    gaps: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    small = capacity // 3
    for a in range(capacity, small, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b > small and not (left[b] >= 2 if b == a else left[b]):
                b -= 1
            if b <= small:
                gaps[capacity - a].append((int(left[a]), [(a, 1)]))
                left[a] = 0
            elif b == a:
                n = int(left[a] // 2)
                gaps[capacity - 2 * a].append((n, [(a, 2)]))
                left[a] -= 2 * n
            else:
                n = int(min(left[a], left[b]))
                gaps[capacity - a - b].append((n, [(a, 1), (b, 1)]))
                left[a] -= n
                left[b] -= n
    for s in range(small, 0, -1):
        n, gap = int(left[s]), s
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                gap = capacity
                gaps[gap].append((-(-n // (capacity // s)), []))
            bins, held = gaps[gap].pop()
            each = gap // s
            full = min(bins, n // each)
            if full:
                gaps[gap - each * s].append((full, [*held, (s, each)]))
            n -= full * each
            if full < bins:
                if n:
                    gaps[gap - n * s].append((1, [*held, (s, n)]))
                    n, full = 0, full + 1
                if full < bins:
                    gaps[gap].append((bins - full, held))
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for group in gaps:
        for bins, held in group:
            if not held:
                continue
            offset = 0
            for length, each in held:
                rows.append((length, used[length], sequence, each, offset))
                used[length] += bins * each
                offset += length * each
            sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (unsigned 32-bit, little-endian)."""
    cut = materialise(pieces(docs, tokenizer_path, capacity, separator, keep_ids, id_col, text_col), "pieces")
    counts = materialise(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    held = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = cut.join(starts, ["part", "length"]).select(*out, (F.col("earlier") + F.col("rank")).alias("r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        length, first, sequence, each, offset = (p[c].to_numpy(np.int64) for c in p.columns)
        key = length << 44 | first
        at = len(out)
        for batch in batches:
            size, r = batch.column(3).to_numpy(), batch.column(at).to_numpy()
            k = np.searchsorted(key, size << 44 | r, "right") - 1
            d = r - first[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(sequence[k] + d // each[k]), pa.array(offset[k] + d % each[k] * size)],
                names=[*out, "sequence_id", "offset"],
            )

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return ranked.mapInArrow(place, kinds + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), keep_ids=False)
