"""Two tokenizers' tokens of each text, aligned by the bytes they cover.

1. A block of texts is encoded by both tokenizers. Where the joined bytes of either differ
   from the text with one space before it, the text has no tokens.
2. The ends of A's and of B's tokens are two sorted lists. Merge path: diagonals of the
   merge grid, PIECE steps apart, are cut by binary search, which divides the merge into
   pieces of equal work. Each piece is merged without knowledge of the others and emits its
   overlaps; an end of A and an equal end of B may fall on two sides of a diagonal, so the
   borders are stitched afterwards.
3. Every block hands on its distinct id pairs and how many of its documents hold them. Summed,
   these are the corpus-wide counts; the highest count of each id of A has at most as many
   rows as A has ids. A block gets the counts of its own pairs back and meets its documents:
   one row a block and pair, so a pair that every document holds is no hot key.

Tokenizer files are read by the driver and handed to the tasks; they hold a fixed vocabulary.
A is read from its own file: where its merges stand in the order of their ids, as in any
byte-level vocabulary that was trained as such, a rank encoder gives the same ids and is used.

Defined results: a null or empty text has zeros and an empty digest, so has a text that a
tokenizer changes; repeated rows are documents of their own; an empty table gives an empty
one; keys are not read, other columns neither; a text is encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scriptorium.session import written_once

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of text aligned at once, and in a block, and steps of the merge in a piece
SLAB_BYTES, BLOCK_BYTES, PIECE = 1 << 20, 8 << 20, 1 << 16
#: Fixed value: how a byte-level vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: a run of blanks this long is left to the vocabulary's own library
LONG_BLANKS = 10_000


class Files(NamedTuple):
    """The two vocabularies as they lie on disk."""

    a: str
    b: bytes

    @staticmethod
    def read(a: str = A_FILE, b: str = B_FILE) -> Files:
        with open(a, encoding="utf-8") as x, open(b, "rb") as y:
            return Files(x.read(), y.read())


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        self.files, self._library = files, None
        model, letters = json.loads(files.a)["model"], byte_letters()
        ranks = {bytes(letters[c] for c in word): k for word, k in model["vocab"].items() if all(c in letters for c in word)}
        special = {t["id"] for t in json.loads(files.a)["added_tokens"]}
        ranks = {word: k for word, k in ranks.items() if k not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        first = len(ranks) - len(merged)
        in_order = first == 256 and all(model["vocab"][m] == first + k for k, m in enumerate(merged))
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self.a_bytes = [b""] * (max([*model["vocab"].values(), *special]) + 1)
        for word, k in ranks.items():
            self.a_bytes[k] = word
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.b_bytes = [self._piece(k) for k in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    @property
    def library(self):
        """The vocabulary's own library, opened when a text asks for it."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.files.a)
            self._library.encode_special_tokens = True
        return self._library

    def _piece(self, k: int) -> bytes:
        if self.pieces.is_byte(k):
            return bytes([int(self.pieces.id_to_piece(k)[3:-1], 16)])
        if self.pieces.is_control(k) or self.pieces.is_unknown(k):
            return b""
        return self.pieces.id_to_piece(k).replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both; none where joined bytes differ from the spaced text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        spaced = " " + text
        if self.ranks is None or " " * LONG_BLANKS in spaced or (len(text) >= LONG_BLANKS and _blanks(text)):
            a = np.array(self.library.encode(spaced, add_special_tokens=False).ids, np.int64)
        else:
            a = self.ranks.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64)
        b = self.pieces.encode(text)
        whole = spaced.encode()
        if b"".join([self.b_bytes[k] for k in b]) != whole or b"".join([self.a_bytes[k] for k in a.tolist()]) != whole:
            return none, none
        return a, np.array(b, np.int64)


def _blanks(text: str) -> bool:
    """Whether a run of LONG_BLANKS blanks of any kind stands in a text."""
    return re.search(r"\s{%d}" % LONG_BLANKS, text) is not None


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): how far each list has come at the start of each piece of the merge, and at its end.

    Equal ends: that of `a` comes first. All diagonals are searched at once.
    """
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        x, y = a[np.minimum(mid, len(a) - 1)], b[np.clip(at - 1 - mid, 0, len(b) - 1)]
        right = open_ & (x <= y)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low, at - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (i, j) of one piece, and which of them end a group, by the piece's own ends alone."""
    place_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(a, b, "right")
    i, j = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    i[place_a], j[place_a] = np.arange(len(a)), place_a - np.arange(len(a))
    i[place_b], j[place_b] = place_b - np.arange(len(b)), np.arange(len(b))
    value = np.empty(len(a) + len(b), np.int64)
    value[place_a], value[place_b] = a, b
    # an end of b that follows an equal end of a closes the same overlap
    again = np.zeros(len(value) + 1, bool)
    again[1:-1] = value[1:] == value[:-1]
    return i[~again[:-1]], j[~again[:-1]], again[1:][~again[:-1]]


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, last): every overlap of tokens i of A and j of B, in order, and whether both end there.

    `a` and `b` are the ends of the tokens, increasing; the last ends are equal.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    at_a, at_b = diagonals(a, b, piece)
    parts = []
    for k in range(len(at_a) - 1):
        i, j, last = merge_piece(a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]])
        parts.append((i + at_a[k], j + at_b[k], last))
    for k in range(1, len(parts)):
        # stitched: the end of A on one side, its equal of B on the other
        x, y = at_a[k] - 1, at_b[k]
        if x >= 0 and y < len(b) and a[x] == b[y] and len(parts[k][0]) and len(parts[k - 1][2]):
            parts[k - 1][2][-1] = True
            parts[k] = tuple(p[1:] for p in parts[k])
    return tuple(np.concatenate(p) for p in zip(*parts))


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..n-1 in rows with room for one sign more, and how many there are."""
    width = len(str(max(n - 1, 0)))
    text = np.char.mod("%d", np.arange(n)).astype(f"S{width + 1}")
    return text.view(np.uint8).reshape(n, width + 1), np.char.str_len(text).astype(np.int64)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs: np.ndarray, n: int) -> list[str]:
    """The digest of each of n documents: ids by group, as `a1,a2|b1;a3|b2,b3`.

    Tokens of all documents in order, their groups numbered through; `docs` is the
    document of each group.
    """
    ids, total = max(int(a.max(initial=0)), int(b.max(initial=0))) + 1, len(a) + len(b)
    room = 1 << (ids - 1).bit_length()
    digits, length = _DIGITS.get(room) or _DIGITS.setdefault(room, _decimals(room))
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    order, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    order[place_a], order[place_b] = a, b
    sign[place_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
    ends = place_b[np.append(group_b[1:] != group_b[:-1], True)]
    sign[ends] = ord(";")
    rows, sizes = digits[order], length[order]
    rows[np.arange(total), sizes] = sign
    flat = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
    stops = np.cumsum(sizes + 1)[ends]  # of groups
    last = np.searchsorted(docs, np.arange(n), "right")
    out, start = [""] * n, 0
    for k, (low, high) in enumerate(zip(np.append(0, last[:-1]).tolist(), last.tolist())):
        if high > low:
            stop = int(stops[high - 1])
            out[k], start = hashlib.sha256(flat[start : stop - 1]).hexdigest(), stop
    return out


def aligned(texts: list[str | None], both: Pair) -> dict[str, np.ndarray | list]:
    """Counts, digests and links of the texts of a block."""
    n, at = len(texts), 0
    ids_a, ids_b, ends_a, ends_b, n_a, n_b = [], [], [], [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, text in enumerate(texts):
        a, b = both.encode(text or "")
        if len(a):
            own = at + np.cumsum(both.a_size[a])
            ids_a.append(a), ids_b.append(b), ends_a.append(own), ends_b.append(at + np.cumsum(both.b_size[b]))
            at, n_a[k], n_b[k] = int(own[-1]), len(a), len(b)
    a, b, ends_a, ends_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids_a, ids_b, ends_a, ends_b))
    i, j, last = align(ends_a, ends_b)
    doc_a = np.repeat(np.arange(n), n_a)
    doc = doc_a[i]
    pair = a[i] * len(both.b_bytes) + b[j]
    group = np.cumsum(last) - last  # groups before each overlap
    group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    group_a[i], group_b[j] = group, group
    order = np.lexsort((pair, doc))
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (pair[order][1:] != pair[order][:-1])
    first = np.flatnonzero(first)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(doc[last], minlength=n),
        "n_links": np.bincount(doc, minlength=n),
        "groups_sha256": digests(a, b, group_a, group_b, doc[last], n) if len(a) else [""] * n,
        "pairs": pair[order][first],
        "times": np.diff(np.append(first, len(order))),
        "ends": np.searchsorted(doc[order][first], np.arange(n), "right"),
    }


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(np.int64)))


def alignments(docs: DataFrame, key: str, text: str, files: Files) -> DataFrame:
    """A row a document with its links by id pair, and a row a block with its pairs' documents."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(files)
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = Pair(shared.value), TaskContext.get().partitionId() << 32
        parts, taken = [], 0

        def rows(ids: pa.Array, out: dict, whole: bool) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    *(pa.array(out.get(c, np.zeros(n, np.int64))) for c in counts),
                    pa.array(out.get("groups_sha256", [""] * n)),
                    pa.array(np.full(n, block)),
                    pa.array([whole] * n),
                    _lists(out["pairs"], out["ends"]),
                    _lists(out["times"], out["ends"]),
                ],
                ["doc_id", *counts, "groups_sha256", "block", "whole", "pairs", "times"],
            )

        def summed() -> dict:
            pairs, times = (np.concatenate(x) for x in zip(*parts))
            pairs, at = np.unique(pairs, return_inverse=True)
            return {"pairs": pairs, "times": np.bincount(at, times, len(pairs)).astype(np.int64), "ends": np.array([len(pairs)])}

        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + SLAB_BYTES, "right")))
                out = aligned(batch.column(1).slice(at, to - at).to_pylist(), both)
                yield rows(batch.column(0).slice(at, to - at), out, False)
                parts.append(np.unique(out["pairs"], return_counts=True))
                taken += int(sizes[to - 1] - before)
                if taken >= BLOCK_BYTES:
                    yield rows(pa.nulls(1, batch.schema.field(0).type), summed(), True)
                    parts, taken, block = [], 0, block + 1
                at = to
        if parts:
            yield rows(pa.nulls(1, batch.schema.field(0).type), summed(), True)

    schema = f"doc_id {id_type}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string, block long, whole boolean"
    return written_once(own.mapInArrow(scan, f"{schema}, pairs array<long>, times array<long>"), "alignments")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(of, pair, count, best) of every pair of every block: documents that hold it, and whether its id of A has no higher."""
    held = rows.where("whole").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    held = held.select(F.col("block").alias("of"), F.col("x.pairs").alias("pair"), F.col("x.times").alias("docs"))
    totals = written_once(held.groupBy("pair").agg(F.sum("docs").alias("count")), "alignment-counts")
    id_a = F.expr(f"pair div {n_b}")
    # as many rows as A has ids
    highest = totals.groupBy(id_a.alias("a")).agg(F.max("count").alias("highest"))
    marked = totals.withColumn("a", id_a).join(F.broadcast(highest), "a")
    marked = marked.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return held.join(marked, "pair").select("of", "pair", "count", "best")


def token_alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", files: Files | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    files = files or Files.read()
    rows = alignments(docs, key, text, files)
    answers = pair_counts(rows, len(Pair(files).b_bytes))
    counts = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    own = rows.where("not whole").select(*counts, "groups_sha256", "block", "pairs", "times")

    def counted(known: pa.Table, own: pa.Table) -> pa.Table:
        pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order].astype(np.int64)
        lists = own.column("pairs").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        times = own.column("times").combine_chunks()
        times = times.combine_chunks() if isinstance(times, pa.ChunkedArray) else times
        at, times = np.searchsorted(pair, lists.flatten().to_numpy()), times.flatten().to_numpy()
        ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))

        def summed(values: np.ndarray) -> pa.Array:
            sums = np.append(0, np.cumsum(values))
            return pa.array(np.diff(np.append(0, sums[ends])))

        n_best, total = (summed((x[at] if len(x) else np.zeros(0, np.int64)) * times) for x in (best, count))
        return own.select(counts).append_column("n_best", n_best).append_column("count_sum", total).append_column(
            "groups_sha256", own.column("groups_sha256")
        )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {', '.join(f'{c} long' for c in counts[1:])}, n_best long, count_sum long, groups_sha256 string"
    return answers.groupBy("of").cogroup(own.groupBy("block")).applyInArrow(counted, schema)
