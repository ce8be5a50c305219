"""Log-probabilities of whole texts under a smoothed word-pair model of the corpus.

The model is a backoff automaton: each word seen in training is a state, each pair seen
an arc with its smoothed log-probability, and every state has a failure arc, with its
backoff weight, to the root, whose arcs are the single words:

    p(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w|h) = (c(hw) + K p(w)) / (c(h) + K)        failure weight of h: K / (c(h) + K)

A traversal from the start state reads the words and the end token once, takes an arc
where there is one and the failure arc else, and adds weights. As a state is the last
word read, all positions of a block of texts are walked at once on arrays.

The model never fits one machine, so each block of texts gets just the counts it meets.
Blocks of about BLOCK_BYTES are encoded as a word list and compressed positions, and
written. Every block asks for the counts of its distinct words and pairs (with its own
training counts in the same row); requests are dealt by hash to parts that grow in
number with the corpus, summed there, and answered in the order asked. So a frequent
word is one request a block, and nothing but N and V passes the driver.

Defined results: a null or empty text is the end token alone; a null key counts as the
empty text for the fold; rows repeat as they come; with no training rows N is 0, V is 0
and every token is unknown; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.word_arrays import mixed, word_hashes
from scriptorium.session import written_once

# The fold left out of training, and the weight of an unseen word.
FOLDS, HELD_OUT, UNSEEN = 5, 1, 0.5
#: strength of the backoff in every state
K = 4.0
BLOCK_BYTES = 8 << 20
#: characters of text for each part of the counts
PART_CHARS = 8_000_000
#: ranges of hashes that a part is summed in, one at a time
RANGE_BITS = 4

END, START = np.uint64(0xE19D_0000_0000_0E2D), np.uint64(0x57A2_7000_0000_57A2)
TWIST = np.uint64(0x9E3779B97F4A7C15)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def packed(values: np.ndarray) -> bytes:
    """Word ids as compressed byte planes; small ids are frequent words."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(count).astype(np.int32)


def _encode(ids: pa.Array, held: np.ndarray, texts: pa.Array, block: int) -> pa.RecordBatch:
    """One row: keys, folds and lengths of the texts, the distinct words, and every position."""
    hashes, ends = word_hashes(texts)
    tokens = np.insert(hashes, ends, END)  # an end after every text
    lengths = np.diff(np.concatenate(([0], ends))) + 1
    vocabulary, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            one(held, pa.bool_()),
            one(lengths.astype(np.int32), pa.int32()),
            one(vocabulary[order].view(np.int64), pa.int64()),
            pa.array([packed(place[inverse])], pa.binary()),
        ],
        ["block", "ids", "held", "lengths", "words", "positions"],
    )


def encode(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus as blocks, written to the shared folder."""
    own = docs.select(F.col(key).alias("doc_id"), (fold(F.col(key)) == HELD_OUT).alias("held"), F.col(text).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(2).fill_null("")
            sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
                held = batch.column(1).slice(at, to - at).to_numpy(zero_copy_only=False)
                ids = pa.concat_arrays([batch.column(0).slice(at, to - at)])
                yield _encode(ids, held, texts.slice(at, to - at), block)
                block, at = block + 1, to

    schema = f"block long, ids array<{id_type}>, held array<boolean>, lengths array<int>, words array<long>, positions binary"
    return written_once(own.mapInArrow(scan, schema), "lm-blocks")


class Block:
    """A block's texts as arrays, with its distinct pairs in the order they are asked for."""

    def __init__(self, row: pa.RecordBatch, parts: int):
        """`row` is one row of the block table."""
        held, lengths, words, positions = (row.column(c)[0] for c in ("held", "lengths", "words", "positions"))
        self.held = held.values
        self.lengths = lengths.values.to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.words = words.values.to_numpy().view(np.uint64)
        count = int(self.ends[-1]) if len(self.ends) else 0
        self.tokens = unpacked(positions.as_py(), count)
        self.train = np.repeat(~self.held.to_numpy(zero_copy_only=False), self.lengths)
        before = np.empty(count, np.int32)
        before[1:] = self.tokens[:-1]
        before[self.ends - self.lengths] = len(self.words)  # the start state
        self.before = before
        keys = np.append(self.words, START)[before]
        keys *= TWIST
        keys += self.words[self.tokens]
        keys = mixed(keys)
        # as np.unique with its inverse, with fewer arrays of all positions at once
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(count, bool)
        new[1:] = keys[1:] != keys[:-1]
        self.pairs = keys[new]
        del keys
        self.pair_of = np.empty(count, np.int32)
        self.pair_of[order] = np.cumsum(new, dtype=np.int32) - 1
        self.parts = parts

    def requests(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(parts, bounds, keys, own training counts): keys by part, in rising order, a part's between two bounds."""
        keys, of = (self.words, self.tokens) if gram == 1 else (self.pairs, self.pair_of)
        counts = np.bincount(of[self.train], minlength=len(keys)).astype(np.int32)
        order, bounds = self.dealt(keys)
        parts = np.flatnonzero(np.diff(bounds))
        return parts, np.append(bounds[parts], len(keys)), keys[order], counts[order]

    def dealt(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the keys by part, and where in it each part begins."""
        part = (keys % np.uint64(self.parts)).astype(np.int32)
        order = np.lexsort((keys, part))
        return order, np.searchsorted(part[order], np.arange(self.parts + 1))

    def answers(self, rows: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the block's words and pairs."""
        out = []
        for gram, keys in ((1, self.words), (2, self.pairs)):
            counts = np.zeros(len(keys))
            order, bounds = self.dealt(keys)
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                counts[order[bounds[part] : bounds[part + 1]]] = rows[gram, part]
            out.append(counts)
        return out[0], out[1]


class Automaton:
    """States, arcs and failure arcs of the words and pairs of one block."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, pair_head: np.ndarray, pair_word: np.ndarray, starts: float, n: float, v: float):
        share = (words + UNSEEN) / (n + UNSEEN * (v + 1))
        self.root = np.log10(share)
        seen = np.append(words, starts)  # how often each state was left; the start last
        self.failure = np.log10(K / (seen + K))
        self.is_arc = pairs > 0
        self.arc = np.log10((pairs + K * share[pair_word]) / (seen[pair_head] + K))

    def weights(self, block: Block) -> np.ndarray:
        """The weight each position adds: its arc, or the failure arc and the root's arc."""
        return np.where(
            self.is_arc[block.pair_of],
            self.arc[block.pair_of],
            self.failure[block.before] + self.root[block.tokens],
        )


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    id_type = docs.select(key).schema[0].dataType.simpleString()
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    blocks = encode(docs, key, text)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block(row, parts)
                for gram in (1, 2):
                    asked, bounds, keys, counts = block.requests(gram)
                    bounds = pa.array(bounds.astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.column("block")[0].as_py()] * len(asked), pa.int64()),
                            pa.array([gram] * len(asked), pa.int32()),
                            pa.array(asked.astype(np.int32)),
                            pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int64))),
                            pa.ListArray.from_arrays(bounds, pa.array(counts)),
                        ],
                        ["block", "gram", "part", "keys", "counts"],
                    )

    def add_up(table: pa.Table) -> pa.Table:
        """Corpus counts of one part: the rows asked for, and one row with its N and V."""
        sizes = pa.compute.list_value_length(table["keys"]).to_numpy()
        flat, counts = (
            np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]) for name in ("keys", "counts")
        )
        flat = flat.view(np.uint64)
        gram, part = table["gram"][0].as_py(), table["part"][0].as_py()
        blocks = table["block"].combine_chunks()
        total, n, v = np.empty(len(flat), np.int64), 0, 0
        ranges = (flat >> np.uint64(64 - RANGE_BITS)).astype(np.uint8)
        for low in range(1 << RANGE_BITS):
            at = np.flatnonzero(ranges == low)
            _, inverse = np.unique(flat[at], return_inverse=True)
            sums = np.bincount(inverse, counts[at]).astype(np.int64)
            total[at] = sums[inverse]
            n, v = n + int(sums.sum()), v + int((sums > 0).sum())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(total))
        rows = len(sizes)
        answers = pa.table(
            {
                "block": blocks,
                "gram": pa.array([gram] * rows, pa.int32()),
                "part": pa.array([part] * rows, pa.int32()),
                "totals": lists,
            }
        )
        if gram > 1:
            return answers
        whole = pa.table(
            {
                "block": pa.array([-1], pa.int64()),
                "gram": pa.array([0], pa.int32()),
                "part": pa.array([part], pa.int32()),
                "totals": pa.array([[n, v]], pa.list_(pa.int64())),
            }
        )
        return pa.concat_tables([answers, whole])

    requests = blocks.mapInArrow(ask, "block long, gram int, part int, keys array<long>, counts array<int>")
    answers = requests.groupBy("gram", "part").applyInArrow(add_up, "block long, gram int, part int, totals array<long>")
    answers = written_once(answers, "lm-counts")
    whole = answers.where("gram = 0").agg(F.sum(F.col("totals")[0]), F.sum(F.col("totals")[1])).first()
    n, v = whole[0] or 0, whole[1] or 0

    def walk(asked: pa.Table, told: pa.Table) -> pa.Table:
        frames = []
        rows = {
            (g, p): t.values.to_numpy()
            for g, p, t in zip(told["gram"].to_pylist(), told["part"].to_pylist(), told["totals"])
        }
        for row in asked.combine_chunks().to_batches(1):
            block = Block(row, parts)
            words, pairs = block.answers(rows)
            first = np.empty(len(pairs), np.int64)
            first[block.pair_of] = np.arange(len(block.pair_of))  # any place of each pair
            starts = words[np.flatnonzero(block.words == END)[0]]  # as many starts as ends
            automaton = Automaton(words, pairs, block.before[first], block.tokens[first], starts, n, v)
            begin = block.ends - block.lengths
            add = lambda x: np.add.reduceat(x, begin)  # noqa: E731, B023
            frames.append(
                pa.table(
                    {
                        "doc_id": row.column("ids").flatten(),
                        "held_out": block.held,
                        "n_tokens": pa.array(block.lengths),
                        "n_known": pa.array(add((words > 0)[block.tokens].astype(np.int64))),
                        "train_tokens": pa.array(np.full(len(begin), n, np.int64)),
                        "base_score": pa.array(add(automaton.root[block.tokens])),
                        "score": pa.array(add(automaton.weights(block))),
                    }
                )
            )
        return pa.concat_tables(frames)

    schema = (
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    met = blocks.groupBy("block").cogroup(answers.where("gram > 0").groupBy("block"))
    return met.applyInArrow(walk, schema)
