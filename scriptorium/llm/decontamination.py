"""Benchmark decontamination: windows of an item's size that repeat it, exactly or nearly.

A window's similarity to an item is the weighted Jaccard of their word shingles, each
shingle weighing as often as it occurs; at THRESHOLD or more the text holds the item.

1. Shingle hashes of every text meet those of the items in an equi-join. Sliding a window
   right to its first shared shingle loses none, so only windows that begin at a shared
   shingle (or at the last place one fits) can be best, and only those are cut.
2. Each window gets a 64-bit SimHash of its words, as does each item. The fingerprint is
   cut into RADIUS + 1 blocks; two within RADIUS bits agree on one block at least, so the
   join by item and block finds all of them, and a pair is kept at its first equal block.
3. What is within RADIUS is decided by the exact similarity.

RADIUS is wide: a window at the threshold shares about 0.86 of its words with the item,
some 9 of 64 bits differ, and 23 is five deviations beyond. DataFrame functions only.

Words are lower-cased runs between white space. Defined results: null or empty texts and
items match nothing; an item below five words is one shingle; a text shorter than an item
is one window; rows equal in key and text give one result; ties take the first place; an
empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.columns import let, split_by_keys, window_hashes, words_of
from scriptorium.session import written_once

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 23
BITS = 64


def simhash(words: Column) -> Column:
    """64-bit SimHash of an array of words, each occurrence one vote a bit.

    Votes are added two bits to a number, 32 bits apart, so 32 sums give all 64 counts.
    """
    lanes = F.lit(0x0000000100000001)

    def bits(hashes: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda k: F.aggregate(
                hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.call_function("shiftright", h, k).bitwiseAND(lanes)
            ),
        )

        def set_bits(s: Column, k: Column) -> Column:
            low = 2 * s.bitwiseAND(F.lit(0xFFFFFFFF)) > F.size(hashes)
            high = 2 * F.shiftrightunsigned(s, 32) > F.size(hashes)
            one = lambda on, at: F.when(on, F.call_function("shiftleft", F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint"))
            return one(low, k).bitwiseOR(one(high, k + 32))

        return F.aggregate(F.transform(sums, set_bits), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return let(F.transform(words, lambda w: F.xxhash64(w)), bits)


def _masks() -> list[int]:
    """The bits of each block as a signed 64-bit number."""
    out = []
    for b in range(RADIUS + 1):
        low, high = BITS * b // (RADIUS + 1), BITS * (b + 1) // (RADIUS + 1)
        mask = ((1 << (high - low)) - 1) << low
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _blocks(fingerprint: str) -> Column:
    return F.posexplode(F.array(*(F.col(fingerprint).bitwiseAND(F.lit(m)) for m in _masks()))).alias("block", "value")


def _first_equal(differ: Column) -> Column:
    """The first block in which two fingerprints agree, from their xor."""
    masks = _masks()
    out = F.when(differ.bitwiseAND(F.lit(masks[0])) == 0, F.lit(0))
    for b, mask in enumerate(masks[1:], 1):
        out = out.when(differ.bitwiseAND(F.lit(mask)) == 0, F.lit(b))
    return out


def weighted(shingles: Column) -> Column:
    """Shingle hashes with repeats as a set: each occurrence is hashed with its number."""
    return let(
        F.sort_array(shingles),
        lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x).cast("int"))),
    )


def _lowered(text: str) -> Column:
    return words_of(F.lower(F.coalesce(F.col(text), F.lit(""))))


def items_of(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, size, gram, grams, bag, item_fp): one row an item with words; written."""
    split = benchmark.select(F.col(key).alias("item_id"), _lowered(text).alias("words"))
    split = written_once(split.where("size(words) > 0"), "bench-words")
    grams = F.when(F.size("words") >= SHINGLE, window_hashes(F.col("words"), SHINGLE))
    for n in range(1, SHINGLE):
        grams = grams.when(F.size("words") == n, window_hashes(F.col("words"), n))
    sized = split.select(
        "item_id",
        F.size("words").alias("size"),
        F.least(F.size("words"), F.lit(SHINGLE)).alias("gram"),
        grams.alias("grams"),
        simhash(F.col("words")).alias("item_fp"),
    )
    return written_once(sized.withColumn("bag", weighted(F.col("grams"))), "bench-items")


def _shared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, digest, hits): per text, its places with a shingle of an item, with the item's size."""
    asked = items.select("item_id", "size", "gram", F.explode(F.array_distinct("grams")).alias("hash"))
    asked = written_once(asked, "bench-shingles")
    lengths = [r["gram"] for r in items.select("gram").distinct().collect()]  # five numbers at most
    found = None
    for n in sorted(lengths):
        places = docs.select("doc_id", "digest", F.posexplode(window_hashes(_lowered("text"), n)).alias("pos", "hash"))
        met = places.join(asked.where(F.col("gram") == n).select("hash", "item_id", "size", "gram"), "hash")
        met = met.select("doc_id", "digest", F.struct("pos", "item_id", "size", "gram").alias("hit"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return None
    # a text's hits: at most its words times the items that share them
    return found.groupBy("doc_id", "digest").agg(F.collect_list("hit").alias("hits"))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, digest, item_id, similarity, first_word, n_words): the best window of each text and item."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "digest", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    items = items_of(benchmark, item_key, item_text)
    hits = _shared(own, items)
    if hits is None:  # no item has a word
        return own.limit(0).select(
            "doc_id", "digest", F.lit(None).cast(benchmark.schema[item_key].dataType).alias("item_id"),
            F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("first_word"), F.lit(0).cast("bigint").alias("n_words"),
        )
    hits = written_once(hits, "bench-hits")
    # hits grow with the corpus: a shuffled join at every size, which splits a hot key
    h = hits.select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"), "hits").hint("merge")
    held = split_by_keys(own, "doc_id", h, "h_id")[0].join(h, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest")))
    held = held.select("doc_id", "digest", _lowered("text").alias("words"), "hits")
    # places as windows: the item's size, moved left where the text ends sooner
    spans = F.array_distinct(
        F.transform(
            "hits",
            lambda x: F.struct(
                F.greatest(F.lit(0), F.least(x["pos"], F.size("words") - x["size"])).alias("start"),
                x["item_id"].alias("item_id"),
                F.least(x["size"], F.size("words")).alias("length"),
                x["gram"].alias("gram"),
            ),
        )
    )
    cut = held.select("doc_id", "digest", "words", F.explode(spans).alias("w")).select(
        "doc_id", "digest", "w.*", F.expr("slice(words, w.start + 1, w.length)").alias("words")
    )
    marked = cut.withColumn("fp", simhash(F.col("words")))
    index = items.select(F.col("item_id").alias("i_id"), "item_fp", _blocks("item_fp"))
    near = (
        marked.select("*", _blocks("fp"))
        .join(
            index.withColumnsRenamed({"block": "i_block", "value": "i_value"}),
            F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("block") == F.col("i_block")) & (F.col("value") == F.col("i_value")),
        )
        .withColumn("differ", F.col("fp").bitwiseXOR(F.col("item_fp")))
        .where(F.bit_count("differ") <= RADIUS)
        .where(F.col("block") == _first_equal(F.col("differ")))
    )
    bags = F.when(F.col("gram") == SHINGLE, window_hashes(F.col("words"), SHINGLE))
    for n in range(1, SHINGLE):
        bags = bags.when(F.col("gram") == n, window_hashes(F.col("words"), n))
    judged = (
        near.select("doc_id", "digest", "item_id", "start", "length", weighted(bags).alias("window_bag"))
        .join(items.select(F.col("item_id").alias("b_id"), "bag"), F.col("item_id").eqNullSafe(F.col("b_id")))
        .withColumn("common", F.size(F.array_intersect("window_bag", "bag")))
        .withColumn("similarity", F.col("common") / (F.size("window_bag") + F.size("bag") - F.col("common")))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max(F.struct("similarity", F.negative("start").alias("back"), "length"))
    return judged.groupBy("doc_id", "digest", "item_id").agg(best.alias("best")).select(
        "doc_id",
        "digest",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        F.negative("best.back").cast("bigint").alias("first_word"),
        F.col("best.length").cast("bigint").alias("n_words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, whole and in their own columns."""
    found = written_once(
        matches(docs, benchmark, key, text).select(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest")).distinct(),
        "bench-found",
    )
    near, far = split_by_keys(docs, key, found, "m_id")
    digest = F.xxhash64(F.coalesce(near[text], F.lit("")))
    same = near[key].eqNullSafe(found["m_id"]) & (digest == found["m_digest"])
    return far.union(near.join(found.hint("merge"), same, "left_anti"))
