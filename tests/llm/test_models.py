"""Personal data, mixing, the quality classifier and url filters."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm import brute
from scriptorium.llm import mixing, pii, quality_classifier, url_filters

PIECES = ["1.2.3.4", "300.1.1.1", "1.2.3.4.5", "a@b.c", "a@b@c.d.", "@x.y", "+1 (234) 555-6789", "4111111111111111", "4111-1111 1111-1111", "+", "-", " ", "\n", ".", "9", "12", "é", "@"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_hard_texts_end_soon():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "a@" * 50_000, "+1" * 50_000, "1." * 100_000):
        pii.base_spans(text)


def test_address_parts_of_thousands_of_digits():
    zeros, ones = "0" * 5000, "1" * 5000
    assert pii.base_spans(f"{zeros}1.2.3.4") == [("ip", 0, 5007)]
    assert pii.base_spans(f"{ones}.2.3.4") == [] and pii.base_spans(f"1.2.3.{zeros}") == [("ip", 0, 5006)]


LINES = [
    *(f"w{i} write to user{i}.x@mail{i}.example.org and wait" for i in range(20)),
    *(f"w{i} from 10.0.{i}.7 went out" for i in range(20)),
    *(f"call +1 (234) 555-6{i:03d} then stop" for i in range(20)),
    *(f"paid by 4111 1111 1111 1111 on day {i}" for i in range(10)),
    *(f"in {1900 + i} some {i} things and {i}.5 more" for i in range(30)),
]


@pytest.fixture(scope="module")
def field():
    return pii.train(LINES)


@pytest.mark.parametrize(
    "text,found",
    [
        ("please mail bob.smith at mail dot example dot com today", [("email", "bob.smith at mail dot example dot com")]),
        ("it is (389) 555-5010 now", [("phone", "(389) 555-5010")]),
        ("in 1999 some 12 things", []),
        ("he sat at the table and read", []),
        ("", []),
    ],
)
def test_the_field_finds_what_patterns_miss(field, text, found):
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, field)[1]] == found


SPELLINGS = [" at | dot ", " [at] | [dot] ", "(at)|.", " (at) | (dot) ", " at |.", "[at]| dot ", "(AT)|(DOT)", " At | Dot ", " (at)|."]


@pytest.mark.parametrize("spelling", SPELLINGS)
@pytest.mark.parametrize("host", ["example.com", "mail.example.org"])
def test_every_spelling_is_found_without_a_digit(field, spelling, host):
    at, dot = spelling.split("|")
    own = "jo.smith" + at + host.replace(".", dot)
    text = f"so please do write to {own} about it"
    assert [(k, text[a:b]) for k, a, b in field.spans(text)] == [("email", own)]
    assert pii.ADDRESS.fullmatch(own)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b-c", " ", "  ", "at", "At", "dot", "DOT", "(", ")", "[", "]", ".", "@", "\n", "7"]), max_size=14).map("".join))
def test_runs_hold_every_address(text):
    held = [(words[0][0], words[-1][1]) for words in pii.runs(text)]
    for m in pii.ADDRESS.finditer(text):
        assert any(a <= m.start() and m.end() <= b for a, b in held)


def test_spelled_addresses_are_not_trained_as_other():
    batch = pa.RecordBatch.from_arrays([pa.array(["room 7 then", "ask jo(at)example.com now", None])], ["text"])
    out = [x for b in pii._training_lines(iter([batch])) for x in b.column(0).to_pylist()]
    assert out == ["room 7 then"]


def test_decoding_equals_every_segmentation(field):
    """Viterbi against a recursion over all segmentations of short runs."""
    size = len(pii.LABELS)
    for text in ("a 12 b", "1 2 3", "x@y.z 10.0.0.1", "call +1 555 010 now"):
        words = pii.runs(text)[0]

        def best(at: int, before: int) -> float:
            if at == len(words):
                return 0.0
            out = -np.inf
            for n in range(1, min(pii.MAX_SEGMENT, len(words) - at) + 1):
                own = field.score(text, *pii.trimmed(text, words[at][0], words[at + n - 1][1]), n)
                for y in range(0 if n == 1 else 1, size):
                    out = max(out, field.steps[before][y] + own[y] + best(at + n, y))
            return out

        def value(spans) -> float:
            total, at, before = 0.0, 0, 0
            starts = {pii.trimmed(text, words[i][0], words[j][1]): (i, j - i + 1) for i in range(len(words)) for j in range(i, len(words))}
            for kind, a, b in [*spans, (None, None, None)]:
                i, n = starts[(a, b)] if kind else (len(words), 0)
                for k in range(at, i):
                    own = field.score(text, *pii.trimmed(text, *words[k]), 1)
                    total += field.steps[before][0] + own[0]
                    before = 0
                if kind:
                    y = pii.LABELS.index(kind)
                    total += field.steps[before][y] + field.score(text, a, b, n)[y]
                    at, before = i + n, y
            return total

        assert abs(value(field.decode(text, words)) - best(0, 0)) < 1e-9


def test_report_and_redaction(edge, none):
    texts = [(r.doc_id, r.text) for r in edge.collect()]
    rows = pii.pii_report(edge).collect()
    want = sorted(
        (str(i), *(sum(s[0] == k for s in brute.personal(t)) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t)).encode()).hexdigest())
        for i, t in texts
    )
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    out = {r.doc_id: r for r in pii.redact(edge).collect()}
    assert out[None].text.startswith("Mail <EMAIL> or <PHONE> now") and out[None].n_chars == len(out[None].text)
    assert out[1].text is None and out[2].text == "" and pii.redact(edge).columns == edge.columns
    assert pii.pii_report(none).isEmpty() and pii.redact(none).isEmpty()


def test_mix_meets_targets(documents, edge, none):
    for docs in (documents, edge):
        rows = mixing.mix(docs).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
        sizes = [(r.source, len(brute.words(r.text))) for r in docs.collect()]
        total: dict = {}
        for s, n in sizes:
            total[s] = total.get(s, 0) + n
        order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [s for s in total if s is None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        goal, free, left = {}, set(order), 1.5 * sum(total.values())
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            full = {s for s in free if share[s] > 2 * total[s]}
            if not full:
                goal |= share
                break
            for s in full:
                goal[s] = 2.0 * total[s]
                left -= goal[s]
            free -= full
        taken: dict = {}
        by_size = {(s, n) for s, n in sizes}
        for r in rows:
            s = [k for k in total if total[k] == r.source_size and abs(goal[k] - r.target) < 1e-6 * max(1, goal[k])]
            assert s and any((k, r.size) in by_size for k in s)
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            taken[s[0]] = taken.get(s[0], 0) + r.taken
        for s, words in taken.items():
            largest = max(n for k, n in sizes if k == s)
            assert abs(words - goal[s]) <= largest + 1
    assert mixing.mix(none).isEmpty()


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", 10, 4), ("a", 50, 2), ("a", 400, 1), ("b", 7, 3)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 540, 300.0), ("b", 21, 42.0)], "source string, source_size long, target double")
    out = {r["at"]: r for r in mixing.multipliers(cells, goals).collect()}
    tilt = lambda x: min(2.0, np.exp(out["a"]["multiplier"] * x / out["a"]["scale"]))
    assert abs(4 * 10 * tilt(10) + 2 * 50 * tilt(50) + 400 * tilt(400) - 300) < 1e-6
    assert out["b"]["multiplier"] == float("inf")


def test_quality_holds_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = quality_classifier.quality_classifier(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in told]) > 0.95


def test_classifier_edges(edge, none, spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (999, 0)], "doc_id long, quality int")
    rows = quality_classifier.quality_classifier(edge, labels).collect()
    assert len(rows) == edge.count() and {r.score for r in rows} == {0.5}
    assert quality_classifier.quality_classifier(none, labels).isEmpty()


def test_statistics_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["A b b | c!", None, "", "x" * 300, "é é 12 #"])
    whole = quality_classifier.statistics(texts)
    monkeypatch.setattr(quality_classifier, "SLICE", 5)
    assert np.array_equal(whole, quality_classifier.statistics(texts)) and np.isfinite(whole).all()


def test_discriminant_is_the_gaussian_formula():
    rng = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    x = [rng.normal(size=(400, d)), rng.normal(1.0, 2.0, size=(600, d))]
    model = quality_classifier.discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in enumerate(x)})
    z = (x[0][:5] - model.center) / model.spread
    logs = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        gap = z - model.means[k]
        own = -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1]
        logs.append(own + np.log(len(x[k]) / 1000))
    assert np.allclose(model.score(x[0][:5]), 1 / (1 + np.exp(logs[0] - logs[1])))


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filters.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_fixed_rules_equal_plain_python(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = [None, "", "x", "http://", "HTTP://A.Org/x?://y", "ftp://example.org/es/1", "https://sub.EXAMPLE.org/en/12#a/b", "a://com/de", "a://x.com/de/", "a://xcom/de/", "://org/"]
    pages = pages.unionByName(spark.createDataFrame([(10_000 + i // 2, u) for i, u in enumerate(odd * 2)], "page_id long, url string"))
    urls = sorted((r.page_id, *rule_of(r.url)[:3], rule_of(r.url)[3] or "-") for r in pages.collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = url_filters.url_filters(pages, labels).collect()
    assert all(r.verdict in ("allow", "block") for r in rows)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else "-") for r in rows), key=str)
    assert got == sorted(urls, key=str)
    assert url_filters.url_filters(pages.limit(0), labels).isEmpty()
    assert url_filters.url_filters(pages, labels.limit(0)).count() == pages.count()


def test_mined_rules_block_what_the_labels_blame(spark):
    pages = [(i, f"https://spam{i % 3}.bad.net/en/{i}") for i in range(60)] + [(100 + i, f"https://good{i % 3}.net/fr/{100 + i}") for i in range(60)]
    pages += [(900, "https://new.bad.net/en/x"), (901, "https://other.net/fr/y")]
    labels = [(i, 0 if i < 60 else 1, 0) for i in [*range(60), *range(100, 160)]]
    out = {
        r.page_id: r.verdict
        for r in url_filters.url_filters(
            spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        ).collect()
    }
    assert out[0] == "block" and out[900] == "block" and out[100] == "allow" and out[901] == "allow"


def mined(urls: list[tuple[str, bool]], min_count: int) -> dict[tuple, dict]:
    """Every combination of tokens that passes, by counting all of them."""
    with_, all_, n = Counter(), Counter(), Counter()
    for tokens, bad in urls:
        verdict = "block" if bad else "allow"
        n[verdict] += 1
        for size in range(1, len(tokens) + 1):
            for chosen in itertools.combinations(sorted(tokens), size):
                all_[chosen] += 1
                with_[chosen, verdict] += 1
    out = {}
    for (chosen, verdict), count in with_.items():
        confidence = count / all_[chosen]
        lift = confidence / (n[verdict] / len(urls))
        if count >= min_count and confidence >= url_filters.MIN_CONFIDENCE and lift >= url_filters.MIN_LIFT:
            out[chosen, verdict] = (round(confidence, 9), round(count / len(urls), 9))
    return out


@pytest.mark.parametrize("min_count", [2, 5])
def test_mined_rules_are_all_combinations_that_pass(spark, min_count):
    sf = "/root/testdata/sf0.01"
    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1)
    split = url_filters.parsed(pages, "page_id", "url")
    tokens = split.select("page_id", "digest", F.when(number != "", number.cast("bigint")).alias("number"), url_filters.tokens_of().alias("tokens"))
    bad = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.collect()}
    urls = [(r.tokens, bad[r.number]) for r in tokens.collect() if r.number in bad and r.tokens]
    rules = url_filters.mined_rules(tokens, labels, min_count, url_filters.MIN_CONFIDENCE, url_filters.MIN_LIFT).collect()
    got = {(tuple(sorted(r.antecedent)), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in rules}
    want = mined(urls, min_count)
    assert got == want and len(rules) == len(got)
    if min_count == 2:
        assert any(v == "block" for _, v in got)
    # the verdict of every url without a fixed rule, from the rules as counted
    full = {r.page_id: r for r in url_filters.url_filters(pages, labels, min_count=min_count).collect()}
    for r in tokens.collect():
        met = [(c, s, -len(a), " ".join(sorted(a)), v) for (a, v), (c, s) in want.items() if set(a) <= set(r.tokens)]
        if full[r.page_id].rule is None:
            assert full[r.page_id].verdict == (max(met)[-1] if met else "allow")


def test_url_edges(spark):
    """Clashing columns, a url of a million characters, rows without url or page."""
    rows = [(1, "https://a.org/" + "x/" * 500_000 + "1", "c"), (None, None, "c"), (2, "http://example.com/de/" + "y" * 1_000_000, "c"), (2, "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    for name in ("path", "rule", "verdict", "digest", "tokens", "m_id", "mined"):
        pages = pages.withColumn(name, pages["host"])
    labels = spark.createDataFrame([(1, 0, 0, "c")], "doc_id long, quality int, toxic int, bad string")
    out = sorted(((r.page_id, r.rule, r.verdict) for r in url_filters.url_filters(pages, labels).collect()), key=str)
    assert out == sorted([(1, "org/", "allow"), (None, None, "allow"), (2, "com/de/", "block"), (2, None, "allow")], key=str)
