"""Alignment of two tokenizers over the bytes of every text.

A is a byte-level tokenizer over a space and the text, B a piece tokenizer over the text, to which it adds a space itself.
Both give cumulative ends of tokens in bytes.  Dictionaries from an end to its index are intersected by their keys; the
sorted common ends slice both lists of ids into groups, and inside a slice the tokens whose ranges overlap are linked.

A single space between two characters that are not white space begins a token in both tokenizers, so a text is cut there and
every stretch is encoded and aligned once per worker and cache (both bounded): a text is the chain of its stretches.

How many documents hold a pair of ids linked is counted in tables: a task writes blocks of documents with the distinct pairs
of each, pairs are summed over all blocks, and each block joins the counts of its own pairs back.  No task sees all
pairs, none sees all documents of one pair at once but as counts, and nothing is broadcast.

Texts that are null, empty, or that one of the tokenizers doesn't give back byte for byte have zeros and an empty digest.  Very long texts count
whole; stretches above 128 characters are encoded each time.  Repeated rows count as documents of their own.  Ties: all pairs with the
highest count of their A id are best.  A null doc_id stays.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.scratch import materialise, table

#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 150_000
LONG = 128
AT_ONCE = 4096
BLOCK_DOCS, BLOCK_ENTRIES = 256, 1 << 17
_UNEVEN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_ALIGNERS: dict = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Bytewise:
    """Tokenizer A: ids of a text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        byte = byte_of_character()
        vocab = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = t
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[bytes(map(byte.__getitem__, a + b))] for a, b in merges]
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if plain and all(x < y for x, y in zip(made, made[1:], strict=False)):
            # Ids follow the merges, so they are ranks, and a faster library gives the same ids.
            import tiktoken

            self.ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.ids = lambda text: whole.encode(text, add_special_tokens=False).ids


class _Piecewise:
    """Tokenizer B."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


#: What is known of a stretch: ids of A, ids of B, groups, links, the groups as text, the linked pairs as 64-bit numbers.
Stretch = tuple[int, int, int, int, str, bytes]


class _Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = _Bytewise(a_path), _Piecewise(b_path)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.width = len(self.b.bytes)
        self.now: dict[str, Stretch | None] = {}
        self.before: dict[str, Stretch | None] = {}

    def _align(self, parts: list[str]) -> list[Stretch | None]:
        """What is known of each part, None where the bytes are not given back; all in one call to each tokenizer."""
        text = " " + " ".join(parts)
        a, b = self.a.ids(text), self.b.ids(text[1:])
        raw = text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return [None] if len(parts) == 1 else [self._align([p])[0] for p in parts]
        ends_a, ends_b = (np.cumsum(size[ids]).tolist() for size, ids in zip(self.sizes, (a, b), strict=True))
        index_a, index_b = dict(zip(ends_a, range(1, len(a) + 1), strict=True)), dict(zip(ends_b, range(1, len(b) + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        out: list[Stretch | None] = []
        i = k = at = end = 0
        for part in parts:
            end += 1 + len(part.encode())
            i0, k0, groups, links = i, k, [], []
            while at < len(common) and common[at] <= end:
                i1, k1 = index_a[common[at]], index_b[common[at]]
                own, other = a[i:i1], b[k:k1]
                groups.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
                if len(own) == 1 or len(other) == 1:
                    links += [x * self.width + y for x in own for y in other]
                else:
                    while i < i1 and k < k1:
                        links.append(a[i] * self.width + b[k])
                        x, y = ends_a[i], ends_b[k]
                        i, k = i + (x <= y), k + (y <= x)
                i, k, at = i1, k1, at + 1
            if (ends_a[i - 1] if i else 0) != end:
                return [self._align([p])[0] for p in parts]
            out.append((i - i0, k - k0, len(groups), len(links), ";".join(groups), np.array(links, np.int64).tobytes()))
        return out

    def stretches(self, text: str) -> list[Stretch | None]:
        uneven = text[0].isspace() or text[-1].isspace() or _UNEVEN.search(text)
        parts = _CUT.split(text) if uneven else text.split(" ")
        try:
            return [*map(self.now.__getitem__, parts)]
        except KeyError:
            pass
        new, long = [], {}
        for p in set(parts):
            if p not in self.now:
                if p in self.before:
                    self.now[p] = self.before[p]
                elif len(p) <= LONG:
                    new.append(p)
                else:
                    long[p] = self._align([p])[0]
        for lo in range(0, len(new), AT_ONCE):
            some = new[lo : lo + AT_ONCE]
            self.now.update(zip(some, self._align(some), strict=True))
        out = [long[p] if p in long else self.now[p] for p in parts]
        if len(self.now) > CACHED:
            self.now, self.before = {}, self.now
        return out


def _small(x: np.ndarray) -> bytes:
    """As the narrowest unsigned integers that hold all; the reader knows how many there are."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row per block: its documents, their distinct pairs with how many of the documents hold each, and each document's places in that list."""
    kinds = {"block": pa.int64(), "docs": pa.list_(_DOC), "pairs": pa.list_(pa.int64()), "holders": pa.list_(pa.int64()), "steps": pa.binary(), "times": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _ALIGNERS.setdefault((a_path, b_path), None) or _Aligner(a_path, b_path)
        _ALIGNERS[a_path, b_path] = aligner
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []
        entries = 0

        def block() -> pa.RecordBatch:
            every = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
            distinct, at, holders = np.unique(every, return_inverse=True, return_counts=True)
            steps = np.diff(at, prepend=0)
            start = np.cumsum([0, *(d["n_pairs"] for d in held)])[:-1]
            start = start[start < len(at)]
            steps[start] = at[start]
            row = (number, held, distinct, holders, _small(steps), _small(np.concatenate(times) if times else every))
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = aligner.stretches(text) if (text := value.as_py()) else [None]
                if None in found:
                    held.append({"doc_id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "n_pairs": 0})
                else:
                    n_a, n_b, n_groups, n_links, groups, links = zip(*found, strict=True)
                    own, often = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
                    held.append({"doc_id": i, "n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "n_links": sum(n_links), "groups_sha256": digest, "n_pairs": len(own)})
                    pairs.append(own)
                    times.append(often)
                    entries += len(own)
                if len(held) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield block()
                    held, pairs, times, entries, number = [], [], [], 0, number + 1
        if held:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{f.name}: {'string' if f.type == pa.string() else 'bigint'}" for f in _DOC)
    return rows.mapInArrow(run, f"block long, docs array<struct<{fields}>>, pairs array<long>, holders array<long>, steps binary, times binary")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pair, n, best: how many documents hold each pair linked, and whether no pair of its A id is held by more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = materialise(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / width)), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    found = materialise(blocks(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = materialise(pair_counts(found, width), "pair-ranks")
    own = found.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
    own = own.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("known"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                members, pairs, steps, times, known = (batch.column(c)[r] for c in range(5))
                doc = members.values
                size = doc.field("n_pairs").to_numpy()
                entries = int(size.sum())
                cut = np.concatenate([[0], np.cumsum(size)])
                best = total = np.zeros(len(size), np.int64)
                if entries:
                    at = np.cumsum(_wide(steps.as_py(), entries))
                    first = cut[:-1][size > 0]
                    at -= np.repeat(np.concatenate([[0], at[first[1:] - 1]]), size[size > 0])
                    order = np.argsort(known.values.field("pair").to_numpy())
                    n = known.values.field("n").to_numpy()[order]
                    top = known.values.field("best").to_numpy(zero_copy_only=False)[order]
                    often = _wide(times.as_py(), entries)
                    best, total = (np.diff(np.concatenate([[0], np.cumsum(often * v[at])])[cut]) for v in (top, n))
                held = {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
                yield pa.record_batch([held.get(c) if c in held else doc.field(c) for c in columns], names=columns)

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in columns)
    return found.join(own, "block", "left").select("docs", "pairs", "steps", "times", "known").mapInArrow(finish, schema)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *default_tokenizers())
