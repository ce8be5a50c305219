"""Near duplicates by n-gram Jaccard, exact, as connected components.

Two texts link when the Jaccard of their sets of five-word shingles is at least 75 %.
Work is on classes of equal sets, so copies are never compared:

1. One pass over the texts gives each its set size, class and bitmap signature (a bit a
   shingle, as wide as the set's size band). Blocks also report shingles that many of
   their texts hold; summed, the most frequent MAX_HOT of them sort last.
2. A linked pair must share one of the first |A| - ceil(0.75 |A|) + 1 shingles of either
   set in that one order, in which the rarer of the frequent ones come first. Each class
   sends those shingles to tiles; a tile holds the classes with one shingle, by size, cut
   into bands in which sizes can still link. Frequent shingles are dealt to several tiles.
3. Links first to the center of each band: the class with the fewest shingles before the
   tile's, so the least changed of a family of near copies, which joins the family in
   linear work. Then, in tiles that still hold several components, every pair across
   components that sizes and positions allow: so no link between different components
   is missed, and no pair within one is made.
4. A pair is checked by bit counts first: differing bits bound the overlap from above.
   What is left is decided by intersecting the sorted arrays of shingles. Arrays are
   made only for texts in such pairs, found by a filter of fixed size.

Defined results: a null text, or one without words, has 0 shingles and is its own
component; below five words the whole sequence is the one shingle; a component is named
by its smallest key, keys that are null never name one, and rows without a key link as any
other (their component is null where no key is in it); repeated rows return once each;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from scriptorium.llm.columns import split_by_keys
from scriptorium.llm.word_arrays import mixed, run_hashes, word_hashes
from scriptorium.operators.components import connected_components
from scriptorium.session import written_once

SHINGLE = 5
#: two sets link when PERCENT * union <= 100 * intersection
PERCENT = 75
#: texts of a block that hold a shingle before the block reports it, and the most kept
REPORTED, MAX_HOT = 8, 1_000_000
#: rows of a frequent shingle that one tile is meant for
TILE_ROWS = 50_000
#: rows up to which a tile's own pairs are tried before it is kept
TRIED = 16
BLOCK_BYTES = 8 << 20
FILTER_BITS = 1 << 26


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    hashes, ends = word_hashes(texts)
    runs = run_hashes(hashes, SHINGLE)
    start = 0
    for end in ends.tolist():
        count = end - start
        if count >= SHINGLE:
            yield np.unique(runs[start : end - SHINGLE + 1])
        elif count:
            yield run_hashes(hashes[start:end], count) ^ np.uint64(count)
        else:
            yield np.zeros(0, np.uint64)
        start = end


def class_of(sets: np.ndarray) -> int:
    """A 64-bit name of a set, from its size and two sums of its hashes."""
    if not len(sets):
        return 0
    sums = np.array([sets.sum(dtype=np.uint64), mixed(sets).sum(dtype=np.uint64), len(sets)], np.uint64)
    return int(run_hashes(sums, 3).view(np.int64)[0])


def signature(sets: np.ndarray) -> bytes:
    """A bit a shingle, in the smallest power of two of bits that is not below the size."""
    width = max(64, 1 << int(len(sets) - 1).bit_length()) if len(sets) else 64
    bits = np.zeros(width, bool)
    bits[(mixed(sets) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap at which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pa.compute.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
        yield at, to
        at = to


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a text (doc_id, n, cls, bits), and rows (hot, n) of shingles frequent in a block."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _slices(batch, 1):
                sets = list(shingle_sets(batch.column(1).slice(at, to - at).fill_null("")))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                every.sort()
                first = np.flatnonzero(np.concatenate((every[:1] == every[:1], every[1:] != every[:-1])))
                times = np.diff(np.append(first, len(every)))
                hot, times = every[first[times >= REPORTED]], times[times >= REPORTED]
                del every, first
                rows, extra = to - at, len(hot)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(at, rows), pa.nulls(extra, batch.schema.field(0).type)]),
                        pa.array(np.concatenate(([len(s) for s in sets], times)).astype(np.int64)),
                        pa.array([class_of(s) for s in sets] + [None] * extra, pa.int64()),
                        pa.array([signature(s) for s in sets] + [None] * extra, pa.binary()),
                        pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(hot.view(np.int64))]),
                    ],
                    ["doc_id", "n", "cls", "bits", "hot"],
                )

    return written_once(own.mapInArrow(scan, f"doc_id {id_type}, n long, cls long, bits binary, hot long"), "ngram-sketch")


def frequent(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent reported shingles, by hash; at most MAX_HOT of them."""
    rows = (
        sketches.where("hot is not null")
        .groupBy("hot")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "hot")
        .limit(MAX_HOT)
        .toPandas()
    )
    hashes = rows["hot"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, text: str, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, part, cls, n, at): the shingles each class sends to tiles, once a block.

    The part is 0, or from 1 on for a shingle that is dealt to several tiles.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, counts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        parts = -(-counts // TILE_ROWS)
        for batch in batches:
            for at, to in _slices(batch, 0):
                seen, tokens, part, names, sizes, places = set(), [], [], [], [], []
                for s in shingle_sets(batch.column(0).slice(at, to - at).fill_null("")):
                    name = class_of(s)
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    where = np.searchsorted(hot, s)
                    known = hot[np.minimum(where, len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                    times = np.zeros(len(s), np.int64)
                    times[known] = counts[where[known]]
                    ordered = np.argsort(times, kind="stable")[: len(s) - -(-PERCENT * len(s) // 100) + 1]
                    tokens.append(s[ordered])
                    dealt = np.ones(len(ordered), np.int64)
                    dealt[known[ordered]] = parts[where[ordered][known[ordered]]]
                    part.append(np.where(dealt > 1, 1 + (name & 0x7FFFFFFFFFFFFFFF) % dealt, 0))
                    names.append(np.full(len(ordered), name, np.int64))
                    sizes.append(np.full(len(ordered), len(s), np.int32))
                    places.append(np.arange(len(ordered), dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.concatenate(part).astype(np.int32)),
                            pa.array(np.concatenate(names)),
                            pa.array(np.concatenate(sizes)),
                            pa.array(np.concatenate(places)),
                        ],
                        ["token", "part", "cls", "n", "at"],
                    )

    return docs.select(F.col(text).alias("text")).mapInArrow(scan, "token long, part int, cls long, n int, at int")


def _starts(token: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where a tile begins in rows by token and part."""
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
    return np.flatnonzero(new)


def _centers(token: np.ndarray, part: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows by token, part and size: the row that begins each row's size band, and the band's center.

    A band ends where sizes can no longer link to its first row. Its center has the fewest
    shingles that sort before the tile's: a text's own changes sort first, so that is the
    text of a family its near copies were made from, or the one nearest to it. Of several,
    the one nearest to the band's middle.
    """
    count = len(token)
    start = _starts(token, part)
    first = np.repeat(start, np.diff(np.append(start, count)))
    wide = 100 * n[first] < PERCENT * n
    for begin in np.unique(first[wide]).tolist():  # few tiles span more than one band
        stop = start[np.searchsorted(start, begin, "right")] if begin < start[-1] else count
        row = begin
        for i in range(begin, int(stop)):
            if 100 * n[row] < PERCENT * n[i]:
                row = i
            first[i] = row
    bands = np.flatnonzero(first == np.arange(count))
    lengths = np.diff(np.append(bands, count))
    off_middle = np.abs(np.arange(count) - np.repeat(bands + lengths // 2, lengths))
    return first, np.repeat(np.lexsort((off_middle, at, first))[bands], lengths)


def _room_allows(n: np.ndarray, at: np.ndarray, m: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can link whose first shared one is at `at` and `by`."""
    in_band = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    return in_band & (np.minimum(n - at, m - by) >= _needed(n, m))


def _may_link(token: np.ndarray, part: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that some other row of their tile may link to by sizes and positions.

    A tile of more than TRIED rows stays whole; so does a part of a frequent shingle,
    which may hold one row only and yet not be alone.
    """
    lengths = np.diff(np.append(_starts(token, part), len(token)))
    sizes = np.repeat(lengths, lengths)
    keep = (sizes > TRIED) | (part > 0)
    rows = np.flatnonzero((sizes > 1) & ~keep)
    ends = np.repeat(np.cumsum(lengths), lengths)
    for step in range(1, TRIED):
        rows = rows[rows + step < ends[rows]]
        other = rows + step
        fits = _room_allows(n[rows], at[rows], n[other], at[other])
        keep[rows[fits]] = keep[other[fits]] = True
    return keep


def tiles(rows: DataFrame) -> DataFrame:
    """Rows that may link to another of their tile, each with its band's center and the row before.

    `star` and `chain` tell whether sizes and positions let the row link to its center and
    to the row before. A linked pair is allowed in the tile of its first shared shingle, so
    rows that are allowed nowhere in a tile are not written.
    A partition is read in order, a batch at a time; the open tile is carried over, and
    of a tile longer than TILE_ROWS only the row of its last center.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(rows: np.ndarray, whole: np.ndarray) -> pa.RecordBatch | None:
            token, part, n, cls, at = rows
            rows = rows[:, whole | _may_link(token, part, n, at)]
            if not rows.shape[1]:
                return None
            token, part, n, cls, at = rows
            own = np.arange(len(cls))
            first, center = _centers(token, part, n, at)
            last = np.where(first == own, own, own - 1)
            star = (center != own) & _room_allows(n, at, n[center], at[center])
            chain = (last != own) & (last != center) & _room_allows(n, at, n[last], at[last])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(token), pa.array(part.astype(np.int32)), pa.array(cls), pa.array(n.astype(np.int32)),
                    pa.array(at.astype(np.int32)), pa.array(cls[center]), pa.array(cls[last]), pa.array(star), pa.array(chain),
                ],
                ["token", "part", "cls", "n", "at", "center", "last", "star", "chain"],
            )

        held, going = np.zeros((5, 0), np.int64), (0, -1)
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate((held, rows), axis=1)
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[[0, 1, 3], 1:] != rows[[0, 1, 3], :-1]).any(0)  # copies of a class
            rows = rows[:, fresh]
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            cut = int(np.flatnonzero(last)[0])
            # rows of a long tile may link to rows that went before or come after
            whole = (rows[0] == going[0]) & (rows[1] == going[1])
            if rows.shape[1] - cut > TILE_ROWS:
                center = _centers(*rows[[0, 1, 2, 4]])[1][-1]
                out, held = shared(rows, whole | last), rows[:, [center]]
                going = (rows[0, -1], rows[1, -1])
            else:
                out, held = (shared(rows[:, :cut], whole[:cut]) if cut else None), rows[:, cut:]
            if out is not None:
                yield out
        whole = (held[0] == going[0]) & (held[1] == going[1])
        if held.shape[1] and (out := shared(held, whole)) is not None:
            yield out

    sorted_rows = rows.select("token", "part", "n", "cls", "at").repartition("token", "part")
    # sets of one size stand in another order in each tile, so the row before differs too
    sorted_rows = sorted_rows.sortWithinPartitions("token", "part", "n", F.xxhash64("cls", "token"), "cls")
    columns = "token long, part int, cls long, n int, at int, center long, last long, star boolean, chain boolean"
    return written_once(sorted_rows.mapInArrow(scan, columns), "ngram-tiles")


def _bits_allow(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose differing bits leave room for the overlap a link needs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                if len(u) != len(v):
                    u, v = (u, v) if len(u) < len(v) else (v, u)
                    u, v = _narrowed(u, len(u)), _narrowed(v, len(u))
                differ = int(np.bitwise_count(u ^ v).sum())
                keep[i] = n_a[i] + n_b[i] - differ >= 2 * _needed(n_a[i], n_b[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    met = (
        pairs.join(signatures.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
        .join(signatures.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
        .where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
        .select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    )
    return written_once(met.mapInArrow(scan, "a long, b long"), "ngram-candidates")


def _narrowed(packed: np.ndarray, size: int) -> np.ndarray:
    """A signature at a narrower width: bit i of the narrow one is any bit i modulo its width."""
    return np.bitwise_or.reduce(packed.reshape(-1, size), axis=0)


def _filter_words(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits over the column `bit`: at most FILTER_BITS / 64 numbers."""
    rows = (
        keys.groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toPandas()
    )
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words


def _passes(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


def _arrays(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the texts in `wanted` (doc_id, cls), one text a class, and of a few more.

    The texts are read where they lie; a filter of their keys lets through those wanted
    and a few more, which meet no pair. A class that only rows without a key hold has no
    key to filter by: of such rows the set is made first, and its class is filtered.
    The arrays are shuffled once, by class, for both sides of the pairs.
    """
    by_key = wanted.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    by_class = wanted.where("doc_id is null").select(F.pmod("cls", F.lit(FILTER_BITS)).alias("bit"))
    shared = docs.sparkSession.sparkContext.broadcast((_filter_words(by_key), _filter_words(by_class)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, by_class = shared.value
        unkeyed = by_class.any()
        for batch in batches:
            bit = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array(np.where(bit < 0, unkeyed, _passes(by_key, np.maximum(bit, 0)))))
            for at, to in _slices(chosen, 2) if chosen.num_rows else ():
                sets = list(shingle_sets(chosen.column(2).slice(at, to - at).fill_null("")))
                classes = np.array([class_of(s) for s in sets], np.int64)
                keep = chosen.column(1).slice(at, to - at).is_valid().to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(keep | _passes(by_class, classes % FILTER_BITS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes[keep]), pa.array([sets[k].view(np.int64) for k in keep.tolist()], pa.list_(pa.int64()))],
                    ["cls", "shingles"],
                )

    hashed = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))).otherwise(-1)
    own = docs.select(hashed.alias("bit"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(scan, "cls long, shingles array<long>").dropDuplicates(["cls"])


def links_among(pairs: DataFrame, docs: DataFrame, key: str, text: str, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link: bit counts first, then the arrays themselves."""
    left = _bits_allow(pairs, classes)
    named = left.select(F.col("a").alias("cls")).union(left.select(F.col("b").alias("cls"))).distinct()
    wanted = written_once(classes.join(named, "cls", "left_semi").select("doc_id", "cls"), "ngram-wanted")
    arrays = _arrays(docs, key, text, wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (s.values.to_numpy().view(np.uint64) for s in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (
        left.join(arrays.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
        .join(arrays.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return written_once(both.mapInArrow(scan, "a long, b long"), "ngram-links")


def center_pairs(tiled: DataFrame) -> DataFrame:
    """Each class with its bands' centers and the classes before it, and centers of a frequent shingle with each other.

    At most two pairs a tile row, however large a tile is.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = tiled.where("star").select(*pair("cls", "center"))
    chains = tiled.where("chain").select(*pair("cls", "last"))
    many = tiled.groupBy("token").agg(F.min("center").alias("top"), F.max("part").alias("parts")).where("parts > 0")
    tops = tiled.select("token", "center").distinct().join(many, "token").where("center <> top").select(*pair("center", "top"))
    return stars.union(chains).union(tops).distinct()


def crossing_pairs(tiled: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of a tile in different components that sizes and positions allow.

    Only tiles of several components; rows of a tile's largest component meet the
    others, never each other.
    """
    named = tiled.join(members.select(F.col("node").alias("cls"), "component"), "cls", "left").select(
        "token", "cls", "n", "at", F.coalesce("component", "cls").alias("component")
    )
    # most tiles have one component after the first links, and are not counted
    ends = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = written_once(named.join(ends.where("low <> high").select("token"), "token"), "ngram-several")
    counted = several.groupBy("token", "component").agg(F.count("*").alias("rows"))
    largest = counted.groupBy("token").agg(F.max_by("component", F.struct("rows", "component")).alias("largest"))
    mixed_tiles = several.join(largest, "token")
    few = mixed_tiles.where("component <> largest").select(
        "token", F.col("cls").alias("f_cls"), F.col("n").alias("f_n"), F.col("at").alias("f_at"), F.col("component").alias("f_component")
    )
    need = F.ceil((F.col("n") + F.col("f_n")) * PERCENT / (100 + PERCENT))
    room = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("f_n") - F.col("f_at") - 1)
    return (
        few.join(mixed_tiles, "token")
        .where("component <> f_component and (component = largest or cls < f_cls)")
        .where(f"100 * least(n, f_n) >= {PERCENT} * greatest(n, f_n)")
        .where(room >= need)
        .select(F.least("cls", "f_cls").alias("a"), F.greatest("cls", "f_cls").alias("b"))
        .distinct()
    )


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, group, component_id) of every document.

    `group` is the component as a name of its classes, which also those without a key have.
    """
    sketches = sketch(docs, key, text)
    texts = sketches.where("hot is null").select("doc_id", "n", "cls")
    classes = written_once(
        sketches.where("hot is null and n > 0")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")),
        "ngram-classes",
    )
    tiled = tiles(prefixes(docs, text, *frequent(sketches)))
    stars = links_among(center_pairs(tiled), docs, key, text, classes)
    members = connected_components(stars)
    across = links_among(crossing_pairs(tiled, members), docs, key, text, classes)
    members = connected_components(stars.union(across)) if not across.isEmpty() else members
    named = classes.join(members.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "doc_id", F.coalesce("component", "cls").alias("group")
    )
    lowest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_class = written_once(named.join(lowest, "group").select(F.col("cls").alias("c_cls"), "group", "component_id"), "ngram-named")
    return texts.join(of_class, (F.col("cls") == F.col("c_cls")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "cls", "group", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return judged(docs, key, text).select("doc_id", "n_shingles", "component_id")


def _with_class(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The documents with the class of their set as one more column."""
    names, at = docs.columns, docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [
                class_of(s) for i, j in _slices(batch, at) for s in shingle_sets(batch.column(at).slice(i, j - i).fill_null(""))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.int64())], [*names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, whole and in its own columns: that of smallest key, then class.

    A row is told by its key and its text's class, not by its key alone: of rows that share a
    key, each text that no other kept one resembles stays. Rows of one key and one class are
    one document. A row without a key goes only where a row of its component stays; without
    a key and without words it always stays.
    """
    rows = written_once(judged(docs, key, text), "ngram-judged")
    named = rows.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "cls")
    keepers = named.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.cls").alias("k_cls"))
    same = (F.col("cls") == F.col("k_cls")) & F.col("doc_id").eqNullSafe(F.col("k_id"))
    stays = rows.join(keepers, same, "left").select(
        "doc_id", "cls", ((F.col("n_shingles") == 0) | F.col("k_cls").isNotNull()).alias("stays")
    )
    stays = written_once(stays, "ngram-stays")
    fates = stays.where("doc_id is not null").groupBy(F.col("doc_id").alias("f_id"))
    fates = fates.agg(F.count("*").alias("rows"), F.max("stays").alias("some"))
    # a key of one row, or of none that stays, is settled by itself
    gone = written_once(fates.where("not some").select("f_id"), "ngram-gone")
    again = written_once(fates.where("some and rows > 1").select("f_id"), "ngram-again")
    # the keys grow with the corpus: a shuffled join at every size, of the rows that may meet it
    near, far = split_by_keys(docs.where(F.col(key).isNotNull()), key, gone, "f_id")
    kept = far.union(near.join(gone.hint("merge"), near[key] == gone["f_id"], "left_anti"))
    unkeyed = docs.where(F.col(key).isNull())
    more = []
    if not again.isEmpty():
        more.append(docs.join(again, docs[key] == again["f_id"], "left_semi"))
        kept = kept.join(again, kept[key] == again["f_id"], "left_anti")
    if not stays.where("doc_id is null").isEmpty():
        more.append(unkeyed)
    if not more:
        return kept
    name = "class"
    while name in docs.columns:
        name += "_"
    told = _with_class(reduce(DataFrame.unionByName, more), text, name)
    asked = stays.where("stays").select(F.col("doc_id").alias("s_id"), F.col("cls").alias("s_cls")).distinct()
    told = told.join(asked, (F.col(name) == F.col("s_cls")) & told[key].eqNullSafe(F.col("s_id")), "left_semi")
    wordless = (F.col(name) == 0) & F.col(key).isNull()
    once = told.where(~wordless).dropDuplicates([key, name]).unionByName(told.where(wordless))
    return kept.unionByName(once.select(*(F.col(f"`{c}`") for c in docs.columns)))
