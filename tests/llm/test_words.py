"""Spelling variants, token alignment and language identification."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import language_id, spelling_variants, token_alignment

# ---- spelling variants ----------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def variants(rows: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    counts: Counter = Counter()
    for key, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_size: dict[int, list[str]] = {}
    for w in known:
        by_size.setdefault(len(w), []).append(w)
    out = {}
    for w, n in known.items():
        near = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(size, ()) if one_edit(w, x)]
        best = min(near, key=lambda x: (-known[x], x), default=None)
        out[w] = (best if best and known[best] >= 2 * n else None, n, len(near))

    def root(w: str) -> str:
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, root(w), n, near, known[form] if form else None) for w, (form, n, near) in out.items()}


def told(frame) -> dict[str, tuple]:
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def crowded(seed: int) -> list[tuple[int | None, str | None]]:
    """Few letters, so that words have many near ones, runs of one letter, ties and chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randrange(4, 10))) for _ in range(120)]
    words += ["a" * k for k in range(4, 12)] + ["prefixes" + x for x in ("", "a", "b", "é", "×")] + ["x" * 3000, "x" * 3001, "x" * 2999 + "y"]
    rows = [(k % 50, " ".join(rng.choice(words) + rng.choice((" ", "-", "1", "ž")) for _ in range(60)).upper()) for k in range(100)]
    rows.append((60, "chainaaaa " * 4 + "chainaaab " * 9 + "chainaabb " * 30))
    return [*rows, (None, "Straße " * 3 + "Strafe " * 7), (7, None), (8, ""), (8, ""), (9, "12 .. ž")]


@pytest.mark.parametrize("group", [2, 7, 4096])
def test_variants_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling_variants, "ROWS", 50)
    monkeypatch.setattr(spelling_variants, "COMPARED", 7)
    rows = crowded(group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = variants(rows)
    assert told(spelling_variants.spelling_variants(docs, group=group)) == want
    assert any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=2, max_size=6), min_size=1, max_size=25), st.sampled_from([1, 3, 8192]))
def test_the_scan_of_a_sorted_list_finds_every_pair(words, compared):
    """One group of words of n or n - 1 letters, nothing around them."""
    before = spelling_variants.COMPARED
    spelling_variants.COMPARED = compared
    for n in range(3, 7):
        own = sorted(w for w in words if len(w) in (n - 1, n))
        if not own:
            continue
        size = np.array([len(w) for w in own])
        data = np.frombuffer("".join(own).encode("latin-1"), np.uint8)
        first = np.arange(len(own)) == 0
        q, w = spelling_variants.one_edit(data, np.cumsum(size) - size, size, first, np.flatnonzero(size == n))
        got = sorted((own[i], own[j]) for i, j in zip(q, w))
        assert got == sorted((x, y) for x in own if len(x) == n for y in own if x != y and one_edit(x, y))
    spelling_variants.COMPARED = before


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Alpha beta GAMMA alpha-delta " * 50
    whole, parts = Counter(), Counter()
    for key in range(40):
        spelling_variants.count_into(whole, str(key), text)
    monkeypatch.setattr(spelling_variants, "MANY", 7)
    for key in range(40):
        spelling_variants.count_into(parts, str(key), text)
    assert +whole == +parts and sum(whole.values()) > 0


def test_variants_edges(edge, none):
    got = told(spelling_variants.spelling_variants(edge))
    assert got == variants([(r.doc_id, r.text) for r in edge.collect()])
    assert spelling_variants.spelling_variants(none).isEmpty()
    assert spelling_variants.spelling_variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# ---- token alignment ------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return token_alignment.Pair(token_alignment.Files.read())


ENDS = st.sets(st.integers(1, 40), max_size=40).map(lambda s: np.array(sorted(s | {40})))


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS, st.integers(1, 9))
def test_pieces_of_the_merge_are_every_overlap(a, b, piece):
    """Whatever the pieces: as many steps in each, all overlaps, and a group where both end."""
    at_a, at_b = token_alignment.diagonals(a, b, piece)
    assert set(np.diff(at_a + at_b)[:-1]) <= {piece} and (at_a[-1], at_b[-1]) == (len(a), len(b))
    i, j, last = token_alignment.align(a, b, piece)
    from_a, from_b = [0, *a[:-1]], [0, *b[:-1]]
    want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(from_a[x], from_b[y]) < min(a[x], b[y])]
    assert list(zip(i.tolist(), j.tolist())) == want
    assert [bool(a[x] == b[y]) for x, y in want] == last.tolist()


TEXTS = [
    None, "", " ", "a", "  two  blanks ", "naïve Straße <|endoftext|> <s> </s> <0x41>", "▁ low line", "tab\tand\nline", "日本語 и 🙂",
    "\x00 nul", "word " * 3000, "x" * 20_000, " " * 30_000 + "z", "the cat", "the cat", "I'll don't 12345", "é é",
]


def test_the_rank_encoder_is_the_vocabulary(both, documents):
    assert both.ranks is not None
    texts = [t for t in TEXTS if t] + [r.text for r in documents.limit(100).collect()]
    for text in texts:
        a, b = both.encode(text)
        if len(a):
            assert a.tolist() == both.library.encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == both.pieces.encode(text)


def alignment(texts: list[str | None], both) -> list[tuple]:
    """Plain Python, a token at a time."""
    rows, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = both.library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.pieces.encode(text) if text else []
        if not text or b"".join(both.a_bytes[k] for k in a) != whole or b"".join(both.b_bytes[k] for k in b) != whole:
            rows.append(([], [], [], []))
            continue
        i = j = 0
        end_a, end_b, links, groups, own = len(both.a_bytes[a[0]]), len(both.b_bytes[b[0]]), [], [], ([], [])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                own[0].append(a[i])
                i += 1
            if step_b:
                own[1].append(b[j])
                j += 1
            if step_a and step_b:
                groups.append(own)
                own = ([], [])
            if i == len(a):
                break
            end_a += len(both.a_bytes[a[i]]) if step_a else 0
            end_b += len(both.b_bytes[b[j]]) if step_b else 0
        rows.append((a, b, groups, links))
        held.update(set(links))
    top: dict[int, int] = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for a, b, groups, links in rows:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), digest))
    return out


def aligned(frame) -> list[tuple]:
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert frame.columns == list(names)
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("slab", [1, 1 << 20])
def test_alignment_equals_plain_python(spark, both, documents, slab, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLAB_BYTES", slab)
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 3 * slab)
    monkeypatch.setattr(token_alignment, "PIECE", 50)
    texts = TEXTS + [r.text for r in documents.limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(((k, *row) for k, row in enumerate(alignment(texts, both))), key=str)
    assert aligned(token_alignment.token_alignment(docs)) == want


def test_alignment_edges(edge, none, both):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want = sorted(((k, *row) for (k, _), row in zip(rows, alignment([t for _, t in rows], both))), key=str)
    assert aligned(token_alignment.token_alignment(edge)) == want
    assert token_alignment.token_alignment(none).isEmpty()


# ---- language -------------------------------------------------------------------------


def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_long_texts_have_the_same_ngrams(monkeypatch):
    texts = ["", "a", "Zoë, l'été  12 x", "Abc défg x yz. " * 3000, "b" * 5000, " " * 9000 + "end"]

    def counted():
        out = np.zeros((len(texts), language_id.BUCKETS), np.int64)
        for buckets, of in language_id.slabs(texts):
            np.add.at(out, (of, buckets), 1)
        return out

    whole = counted()
    assert whole[1].sum() == 4  # a, blank-a, a-blank, blank-a-blank
    for slab in (3, 64, 1000):
        monkeypatch.setattr(language_id, "SLAB", slab)
        assert (counted() == whole).all()


def test_features_are_runs_of_letters_within_words():
    """The n-grams of a slab against plain Python."""
    texts = ["Le été 3x", "no", "", "...", "A b"]
    want = []
    for k, text in enumerate(texts):
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            want += [(k, w) for w in word] + [(k, padded[i : i + 2]) for i in range(len(padded) - 1)] + [(k, padded[i : i + 3]) for i in range(len(padded) - 2)]
    hashed = lambda s: int(language_id._hashed(*(np.array([ord(c)], np.uint32) for c in s))[0])
    got = [(int(k), int(b)) for buckets, of in language_id.slabs(texts) for b, k in zip(buckets, of)]
    assert sorted(got) == sorted((k, hashed(w)) for k, w in want)


def test_document_frequencies_count_each_text_once(spark, monkeypatch):
    texts = ["aa aa", "ab", "aa", "zz " * 10]
    held, n = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    bucket = lambda s: int(language_id._hashed(*(np.array([ord(c)], np.uint32) for c in s))[0])
    assert n == 4 and held[bucket("a")] == 3 and held[bucket("z")] == 1 and held[bucket(" a")] == 3


def test_ftrl_equals_the_formula():
    """One weight over a few steps, against the update as it is written down."""
    own = language_id.Ftrl((1, 1), 0.3, 0.1)
    z = n = 0.0
    for g in (0.5, -1.2, 0.7, 2.0, -0.1):
        w = 0.0 if abs(z) <= 0.3 else -(z - np.sign(z) * 0.3) / ((language_id.BETA + n**0.5) / language_id.ALPHA + 0.1)
        assert abs(own.weights(np.array([0]))[0, 0] - w) < 1e-12
        sigma = ((n + g * g) ** 0.5 - n**0.5) / language_id.ALPHA
        z, n = z + g - sigma * w, n + g * g
        own.step(np.array([0]), np.array([[g]]), np.array([[w]]))
        assert abs(own.z[0, 0] - z) < 1e-12 and abs(own.n[0, 0] - n) < 1e-12


def test_temperature_makes_the_labels_likeliest():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(3000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    truth = (p.cumsum(1) > rng.random((3000, 1))).argmax(1)
    assert abs(language_id.temperature(logits * 4, truth) - 4) < 0.6
    assert language_id.temperature(logits[:0], truth[:0]) == 1.0


def test_language_edges(spark, edge, none):
    rows = language_id.language_id(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1, 2, 3))
    assert all(by[k].lang_pred in ("en", "de") for k in (4, 5, 6, 7, 8, None)) and by[None].held_out is False
    assert language_id.language_id(none).isEmpty()
    unknown = edge.select("doc_id", "text").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in language_id.language_id(unknown).collect()} == {("und", 0.0)}
