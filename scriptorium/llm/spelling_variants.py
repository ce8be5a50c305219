"""Spelling variants of the corpus' words: one edit apart, followed to the frequent form.

1. Runs of letters are counted in the task that reads them, then summed: the vocabulary.
2. Two words one edit apart, the longer of `long` letters, agree before and behind the edit.
   A segment of the longer word holds the edit; words that agree on all around a segment are
   a group. At first a word has two segments, its halves. A group of more than GROUP words is
   replaced by the two groups of its halved segment, which both ask for more agreement; at
   one letter a group has as many words as there are letters. So every pair is in the group
   of the segment its edit lies in, whatever the vocabulary's size, and no group is large.
3. A group is a sorted list of what its words have inside the segment, with the length of
   the prefix each shares with the one before (LCP). The list is scanned by ranges of a
   common prefix: a range's row of the edit matrix, a band of three cells, is made once from
   the row of the range around it, whose prefix is one letter shorter, and serves all words
   in it; a range whose row exceeds one edit is skipped with all its words. All words of
   the longer length are compared in the one scan.
4. Each group hands on, a word: how many near words, and the most frequent; these are summed.
   Roots are found by pointer doubling over words and their forms.

Defined results: a null or empty text has no words; a null key reads as an empty string in
the checksum; repeated rows count each; a text is read whole, in pieces of MANY runs, however
long; a run may have any length; an empty table gives an empty one; other columns are not
read. Forms always have at least twice the count, so following them ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from scriptorium.session import written_once

#: least letters and occurrences of a word, and the least ratio of a form's count to its word's
LETTERS, OCCURRENCES, RATIO = 5, 3, 2
#: one run in PERTURBED, by checksum, loses a letter
PERTURBED = 97
#: most words of a group; a larger one is halved
GROUP = 4096
#: runs taken from a text at once, distinct words a task holds, rows and words compared at once
MANY, HELD, ROWS, COMPARED = 1_000_000, 400_000, 50_000, 8192
#: Fixed value: letters of a run, A-Z being lower-cased before. Latin-1 holds them all.
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS)


def runs_of(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of a text that may yet be words, some at a time."""
    lower = text.encode().lower().decode()  # bytes.lower folds A-Z only
    if len(lower) <= MANY:
        yield RUN.findall(lower)
        return
    found = RUN.finditer(lower)
    while some := [m[0] for m in islice(found, MANY)]:
        yield some


def count_into(counts: Counter, key: str, text: str) -> None:
    """Add the words of one document."""
    start = crc32(f"{key}:".encode())
    for runs in runs_of(text):
        counts.update(runs)
        for run in {*runs}:
            sum_ = crc32(run.encode(), start)
            if sum_ % PERTURBED == 0:
                times, at = runs.count(run), sum_ % len(run)
                counts[run] -= times
                if len(run) > LETTERS:
                    counts[run[:at] + run[at + 1 :]] += times


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of every word of the corpus."""
    own = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if n}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                count_into(counts, k.as_py(), t.as_py())
                if len(counts) > HELD:
                    yield out()
        yield out()

    counted = own.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written_once(counted.where(F.col("n") >= OCCURRENCES), "vocabulary")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, long, head, tail) with the group's key and what the word has inside the segment."""
    inside = F.char_length("word") - F.col("head") - F.col("tail")
    before = F.substring("word", F.lit(1), F.col("head"))
    behind = F.substring("word", F.char_length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.withColumns(
        {
            "key": F.concat_ws(".", "long", "head", before, behind),
            "inside": F.substring("word", F.col("head") + 1, inside),
            "short": F.char_length("word") < F.col("long"),
        }
    )


def groups(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, inside, short, n): every word in every group it belongs to."""
    half = F.expr("long div 2")
    rows = words.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("long"))
    cut = F.array(F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("long") - half).alias("tail")))
    rows = _placed(rows.select("word", "n", "long", F.explode(cut).alias("s")).select("word", "n", "long", "s.head", "s.tail"))
    settled = None
    while True:
        sizes = rows.where("long - head - tail > 1").groupBy("key").agg(F.count("*").alias("size"))
        hot = written_once(sizes.where(F.col("size") > group).select("key"), "hot-groups")
        if hot.isEmpty():
            break
        few = rows.join(hot, "key", "left_anti")
        settled = few if settled is None else settled.unionByName(few)
        mid = F.expr("head + (long - head - tail) div 2")
        cut = F.array(F.struct("head", (F.col("long") - mid).alias("tail")), F.struct(mid.alias("head"), "tail"))
        large = rows.join(hot, "key", "left_semi").select("word", "n", "long", F.explode(cut).alias("s"))
        rows = _placed(written_once(large.select("word", "n", "long", "s.head", "s.tail"), "halved-groups"))
    rows = rows if settled is None else settled.unionByName(rows)
    return rows.select("key", "inside", "short", "n")


def shared_prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The LCP of each word with the one before it; -1 for the first of a group."""
    lcp = np.zeros(len(size), np.int64)
    alive = np.flatnonzero(~first)
    depth = 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        alive = alive[data[start[alive] + depth] == data[start[alive - 1] + depth]]
        depth += 1
        lcp[alive] = depth
    lcp[first] = -1
    return lcp


def one_edit(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q, w): the asked words q and the words w of their group that are exactly one edit away.

    The words of a group are sorted, distinct, and no longer than those asked. `low`, `high`
    is a range of words that share `depth` letters, `band` its matrix row around the diagonal.
    """
    n = len(size)
    lcp = shared_prefixes(data, start, size, first)
    begins = np.flatnonzero(first)
    stops = np.append(begins[1:], n)
    of = np.cumsum(first) - 1
    levels = np.argsort(lcp, kind="stable")
    level_at = np.searchsorted(lcp[levels], np.arange(int(lcp.max(initial=0)) + 2))
    found = []
    letter = lambda q, at: data[np.minimum(start[q] + np.clip(at, 0, size[q] - 1), len(data) - 1)]
    for slab in range(0, len(asked), COMPARED):
        q = asked[slab : slab + COMPARED]
        low, high, depth = begins[of[q]], stops[of[q]], 0
        band = np.repeat(np.array([[2, 0, 1]], np.int8), len(q), 0)
        while len(q):
            ends = size[low] == depth
            distance = np.where(size[q] == depth, band[:, 1], np.where(size[q] == depth + 1, band[:, 2], 2))
            hit = ends & (distance == 1)
            found.append((q[hit], low[hit]))
            low = low + ends
            q, low, high, band = (x[low < high] for x in (q, low, high, band))
            if not len(q):
                break
            # the ranges inside a range begin at it and where the LCP falls to `depth`
            at = levels[level_at[depth] : level_at[depth + 1]] if depth + 1 < len(level_at) else levels[:0]
            left, right = np.searchsorted(at, low, "right"), np.searchsorted(at, high, "left")
            inner = right - left + 1
            parent = np.repeat(np.arange(len(q)), inner)
            nth = np.arange(len(parent)) - np.repeat(np.cumsum(inner) - inner, inner)
            at = np.append(at, 0)
            child_low = np.where(nth == 0, low[parent], at[np.minimum(left[parent] + nth - 1, len(at) - 1)])
            child_high = np.where(nth == inner[parent] - 1, high[parent], at[np.minimum(left[parent] + nth, len(at) - 1)])
            q, row = q[parent], band[parent]
            own = data[start[child_low] + depth]
            x = np.minimum(row[:, 0] + (letter(q, depth - 1) != own), row[:, 1] + 1)
            y = np.minimum(np.minimum(row[:, 1] + (letter(q, depth) != own), row[:, 2] + 1), x + 1)
            z = np.minimum(row[:, 2] + (letter(q, depth + 1) != own), y + 1)
            # cells beyond the asked word's end
            y, z = np.where(size[q] < depth + 1, 2, y), np.where(size[q] < depth + 2, 2, z)
            near = np.minimum(np.minimum(x, y), z) <= 1
            band = np.minimum(np.stack((x, y, z), 1), 2).astype(np.int8)[near]
            q, low, high, depth = q[near], child_low[near], child_high[near], depth + 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_words(keys: list[str], first: np.ndarray, inside: list[str], short: np.ndarray, n: np.ndarray) -> tuple[list, list, list, list]:
    """(word, n_near, form_n, form) of the words of whole groups, as far as these groups show."""
    size = np.array([len(x) for x in inside], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer("".join(inside).encode("latin-1"), np.uint8)
    q, w = one_edit(data, start, size, first, np.flatnonzero(~short))
    around = {int(g): (*keys[g].split(".")[2:],) for g in np.flatnonzero(first)[np.unique(np.cumsum(first)[q] - 1)]}
    group = np.maximum.accumulate(np.where(first, np.arange(len(size)), 0))
    keep = np.ones(len(q), bool)
    for k in np.flatnonzero(short[w]).tolist():
        # a letter lost from a run of equal letters counts at the run's end, which another segment holds
        behind = around[int(group[q[k]])][1]
        if behind and inside[q[k]][-1] == behind[0] and inside[w[k]] == inside[q[k]][:-1]:
            keep[k] = False
    q, w = q[keep], w[keep]
    both = short[w]
    q, w = np.concatenate((q, w[both])), np.concatenate((w, q[both]))
    if not len(q):
        return [], [], [], []
    named = {int(k): around[int(group[k])][0] + inside[k] + around[int(group[k])][1] for k in np.unique(np.concatenate((q, w)))}
    rank = np.zeros(len(size), np.int64)
    rank[sorted(named, key=named.__getitem__)] = np.arange(len(named))
    order = np.lexsort((rank[w], -n[w], q))
    q, w = q[order], w[order]
    at = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    return (
        [named[k] for k in q[at].tolist()],
        np.diff(np.append(at, len(q))).tolist(),
        n[w[at]].tolist(),
        [named[k] for k in w[at].tolist()],
    )


def neighbours(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, form_n, form) of words with a near word; the form is the most frequent of them."""
    schema = "word string, n_near long, form_n long, form string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            keys = rows.column("key").combine_chunks()
            first = np.ones(rows.num_rows, bool)
            first[1:] = pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            made = near_words(
                keys.to_pylist(), first, rows.column("inside").to_pylist(), rows.column("short").to_numpy(), rows.column("n").to_numpy()
            )
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], ["word", "n_near", "form_n", "form"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < ROWS:
                continue
            keys = held.column("key")
            open_ = pa.compute.equal(keys, keys[-1]).to_numpy()
            cut = int(np.flatnonzero(open_)[0])
            if cut:
                yield out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    rows = groups(words, group).repartition("key").sortWithinPartitions("key", "inside", "short")
    parts = rows.mapInArrow(scan, schema)
    best = F.min(F.struct((-F.col("form_n")).alias("order"), F.col("form").alias("form")))
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", (-F.col("best.order")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last, twice as far each round."""
    at = written_once(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("via"), F.col("root").alias("ahead"))
        joined = at.join(ahead, at["root"] == ahead["via"], "left")
        moved = written_once(joined.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = vocabulary(docs, key, text)
    judged = words.join(neighbours(words, group), "word", "left")
    fits = F.col("form_n") >= RATIO * F.col("n")
    judged = judged.select(
        "word",
        F.when(fits, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("form_n")).alias("form_n"),
    )
    judged = written_once(judged, "variants")
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
