"""The n-gram join and the corpus model."""

from __future__ import annotations

import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm import brute
from scriptorium.llm import lm_scoring, ngram_join, word_arrays


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_word_hashes_do_not_depend_on_pieces(monkeypatch, piece):
    texts = [None, "", "A b\tC", "word" * 40, " x ", "é È\x0bz", "end"]
    whole, ends = word_arrays.word_hashes(pa.array(texts))
    monkeypatch.setattr(word_arrays, "PIECE", piece)
    again, ends_again = word_arrays.word_hashes(pa.array(texts))
    assert (whole == again).all() and (ends == ends_again).all()
    assert list(np.diff(np.concatenate(([0], ends)))) == [len(brute.words(t)) for t in texts]


def peak(run) -> int:
    """Bytes of arrays that `run` holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashes_of_a_block_are_held_once():
    hashes = np.arange(1_000_000, dtype=np.uint64)
    want = word_arrays.run_hashes(hashes[:200_000], 5)
    assert (word_arrays.run_hashes(hashes, 5)[: len(want)] == want).all()
    assert (word_arrays.mixed(hashes)[-5:] == word_arrays.mixed(hashes[-5:])).all()
    assert peak(lambda: word_arrays.run_hashes(hashes, 5)) < 12 * len(hashes)
    assert peak(lambda: word_arrays.mixed(hashes)) < 12 * len(hashes)


def test_a_block_of_the_model_takes_few_bytes_a_token():
    words = [f"w{i % 7919}x{i % 13}" for i in range(200_000)]
    texts = pa.array([" ".join(words[i : i + 400]) for i in range(0, len(words), 400)])
    row = lm_scoring._encode(pa.array(np.arange(len(texts))), np.zeros(len(texts), bool), texts, 0)
    assert peak(lambda: lm_scoring.Block(row, 8)) < 50 * len(words)


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    """Families of near copies, a family too close to call, a passage in a third of all texts, copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = " ".join(word() for _ in range(30))
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "a b"), (3, "A  b")]
    for family in range(6):
        base = [word() for _ in range(rng.choice((20, 60, 120)))]
        for _ in range(40 if family == 0 else 8):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                text[rng.randrange(len(text))] = word()
            cut = rng.randrange(0, len(text) // 5)
            out.append((len(out), " ".join(text[cut:] if rng.random() < 0.5 else text)))
    for _ in range(60):
        own = " ".join(word() for _ in range(rng.randrange(5, 80)))
        out.append((len(out), f"{own} {passage}" if rng.random() < 0.4 else own))
    out += [(len(out) + k, out[10][1]) for k in range(30)]
    return out


@pytest.mark.parametrize("seed,tile_rows,reported", [(1, 50_000, 8), (2, 5, 2), (3, 3, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, tile_rows, reported):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(ngram_join, "REPORTED", reported)
    texts = near_copies(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    want = brute.components(texts)
    assert got == {i: (len(brute.shingles(t)), want[i]) for i, t in texts}


def shared_rows(seed: int) -> list[tuple[int, int, int, int, int]]:
    """(token, part, cls, n, at) of short tiles, of long ones, and of shingles dealt to parts."""
    rng = random.Random(seed)
    rows = []
    for token in range(200):
        for cls in rng.sample(range(1000), rng.choice((1, 2, 2, 3, 5, 12, 30))):
            n = 20 + cls % 90
            rows.append((token, token % 9 == 0 and 1 + cls % 3, cls, n, rng.randrange(n // 4 + 1)))
    return [(t, int(p), c, n, a) for t, p, c, n, a in rows]


def may_pair(x: tuple, y: tuple) -> bool:
    """Whether sets link that share the shingle of these rows, none before it and all after it."""
    (n, at), (m, by) = x[3:], y[3:]
    common = min(n - at, m - by)
    return x != y and 100 * min(n, m) >= 75 * max(n, m) and 100 * common >= 75 * (n + m - common)


@pytest.mark.parametrize("tile_rows", [4, 50_000])
def test_tiles_hold_the_rows_that_may_link(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    rows = shared_rows(5)
    docs = spark.createDataFrame(rows, "token long, part int, cls long, n int, at int")
    got = ngram_join.tiles(docs).collect()
    held = {(r.token, r.part, r.cls, r.n, r.at) for r in got}
    tiles = collections.defaultdict(list)
    for row in rows:
        tiles[row[:2]].append(row)
    need = {r for rows in tiles.values() for r in rows if any(may_pair(r, other) for other in rows)}
    assert need <= held <= set(rows)
    if tile_rows > len(rows):
        short = {r for (_, part), rows in tiles.items() if part == 0 and len(rows) <= ngram_join.TRIED for r in rows}
        assert held & short == need & short
    of = {(r[0], r[1], r[2]): r for r in rows}
    for r in got:
        own = of[r.token, r.part, r.cls]
        assert r.star == may_pair(own, of[r.token, r.part, r.center])
        assert r.chain == (r.last != r.center and may_pair(own, of[r.token, r.part, r.last]))


def test_sets_of_shingles_are_not_written(spark, monkeypatch):
    written, once = [], ngram_join.written_once

    def watched(df, name, *more):
        written.append((name, [kind for _, kind in df.dtypes]))
        return once(df, name, *more)

    monkeypatch.setattr(ngram_join, "written_once", watched)
    docs = spark.createDataFrame(near_copies(3), "doc_id long, text string")
    assert ngram_join.ngram_join(docs).count() == docs.count()
    assert written and not [name for name, kinds in written if any(kind.startswith("array") for kind in kinds)]


def test_pairs_grow_with_the_texts_of_a_family(spark, monkeypatch):
    """Changed copies of one text, many of them just beyond a link to it or to most others."""
    copies, rng = 300, random.Random(300)
    base = [f"w{i}" for i in range(150)]
    texts = [(0, " ".join(base))]
    for k in range(1, copies):
        text = linked(base, k, 1 + k % 6)
        texts.append((k, " ".join(text[rng.randrange(6) :] if k % 5 == 0 else text)))
    counted, links_among = [], ngram_join.links_among

    def watched(pairs, *more):
        counted.append(pairs.count())
        return links_among(pairs, *more)

    monkeypatch.setattr(ngram_join, "links_among", watched)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert got == brute.components(texts)
    assert max(collections.Counter(got.values()).values()) > copies // 2
    assert sum(counted) < 8 * copies, counted


def test_join_edges(edge, none):
    rows = ngram_join.ngram_join(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 4 and by[1].n_shingles == 0 and by[2].component_id == 2 and by[6].n_shingles == 1
    assert ngram_join.ngram_join(none).isEmpty()
    kept = ngram_join.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6, 7, 8], key=str)


def test_scores_equal_plain_python(documents, edge, none):
    for docs in (documents.limit(120), edge):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
        tokens = [[*brute.words(t), "end"] for _, t in rows]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
        one, two, starts = collections.Counter(), collections.Counter(), 0
        for t, h in zip(tokens, held):
            if not h:
                one.update(t)
                two.update(zip(["start", *t], t))
                starts += 1
        n, v = sum(one.values()), len(one)
        want = []
        for (i, _), t, h in zip(rows, tokens, held):
            p = [(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
            seen = [starts, *(one[w] for w in t)]
            q = [(two[a, w] + lm_scoring.K * x) / (c + lm_scoring.K) for a, w, x, c in zip(["start", *t], t, p, seen)]
            want.append((str(i), h, len(t), sum(one[w] > 0 for w in t), n, round(sum(map(math.log10, p)), 6), round(sum(map(math.log10, q)), 6)))
        got = [
            (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
            for r in lm_scoring.lm_scores(docs).collect()
        ]
        assert sorted(got) == sorted(want)
    assert lm_scoring.lm_scores(none).isEmpty()


def test_the_model_is_a_distribution():
    words = np.array([5.0, 3.0, 2.0, 0.0])
    pairs = np.array([2.0, 1.0, 0.0])  # after word 0: words 0, 1, 3
    a = lm_scoring.Automaton(words, pairs, np.array([0, 0, 0]), np.array([0, 1, 3]), 2.0, 10.0, 3.0)
    arcs = 10 ** a.arc[:2]
    rest = 10 ** (a.failure[0] + a.root[[2, 3]])
    assert abs((10**a.root).sum() - 1) < 1e-9
    # word 0 was followed three times of five in this toy; the two others leave that share
    assert abs(arcs.sum() + rest.sum() - (3 + lm_scoring.K) / (5 + lm_scoring.K)) < 1e-9


def linked(first: list[str], seed: int, changes: int = 1) -> list[str]:
    """A copy whose set is near enough to link."""
    rng = random.Random(seed)
    out = list(first)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{seed}x{rng.randrange(10**6)}"
    return out


def test_rows_without_a_key_link(spark):
    """A text that only a keyless row holds joins its two neighbours."""
    words = [f"w{i}" for i in range(75)]
    a, b, c = words[:64], words, words[11:]
    texts = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, "alone " * 9)]
    a, b, c = (brute.shingles(t) for _, t in texts[:3])
    assert min(len(a & b) / len(a | b), len(b & c) / len(b | c)) >= 0.75 > len(a & c) / len(a | c)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = [(r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1), (2, 1), (None, None)], key=str)
    assert [r.doc_id for r in ngram_join.drop_near_copies(docs).where("text not like 'alone%'").collect()] == [1]


def keyless(seed: int) -> list[tuple[int | None, str | None]]:
    """Texts of which a third have no key and a third share a key with another text."""
    rng = random.Random(seed)
    return [(None if k % 3 == 0 else rng.randrange(20) if k % 3 == 1 else 1000 + k, t) for k, (_, t) in enumerate(near_copies(seed))]


@pytest.mark.parametrize("seed", [4, 5])
def test_null_and_repeated_keys_equal_brute_force(spark, seed):
    texts = keyless(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = brute.components(list(enumerate(t for _, t in texts)))
    lowest: dict = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            lowest[rows[k]] = min(i, lowest.get(rows[k], i))
    want = [(str(i), len(brute.shingles(t)), str(lowest.get(rows[k]) if brute.shingles(t) else i)) for k, (i, t) in enumerate(texts)]
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_join(docs).collect()]
    assert sorted(got) == sorted(want)
    # one row of each group stays, that of the smallest key
    kept = collections.Counter((r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs).collect())
    groups: dict = {}
    for k, (i, t) in enumerate(texts):
        groups.setdefault(rows[k], []).append((i, t))
    place = {t: k for k, (_, t) in enumerate(texts)}
    named = {}
    for i, t in kept:
        if brute.shingles(t):
            assert named.setdefault(rows[place[t]], i) == i and kept[i, t] == 1
    assert set(named) == {g for g, own in groups.items() if brute.shingles(own[0][1])}
    assert all(named[g] == lowest.get(g) for g in named)


def test_a_text_that_occurs_nowhere_else_stays(spark):
    words = [f"w{i}" for i in range(60)]
    unique = " ".join(f"u{i}" for i in range(30))
    rows = [(1, " ".join(words)), (7, " ".join(linked(words, 1))), (7, unique), (8, None), (8, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, rows[0][1]), (7, unique), (8, None), (None, None), (None, "")], key=str)
