"""Quality rules, license scans and decontamination."""

from __future__ import annotations

from llm import brute
from scriptorium.llm import decontamination, license_scan, quality_rules


def test_counts_equal_plain_python(documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in quality_rules.quality_rules(documents).collect():
        w = brute.words(texts[r.doc_id], fold=False)
        lines = [x for x in texts[r.doc_id].split("\n") if brute.words(x)]
        assert r.n_words == len(w)
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id])
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute.repeated_words(w)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_a_bad_host_loses_what_breaks_its_rule_only(spark):
    clean = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"
    noisy = clean.replace(" ", "# ")
    rows = [(i, noisy, "bad") for i in range(50)] + [(100, clean, "bad"), (101, noisy, "good")]
    rows += [(200 + i, clean, "good") for i in range(50)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(50))
    assert kept[100] and kept[101] and all(kept[200 + i] for i in range(50))


def test_edges(edge, none, spark):
    rows = quality_rules.quality_rules(edge).collect()
    assert len(rows) == edge.count() and all(r.base_failed for r in rows if r.n_words < 20)
    assert next(r for r in rows if r.doc_id == 6).n_repeat_words == 40_000
    assert quality_rules.quality_rules(none).isEmpty()
    assert quality_rules.drop_failing(edge).columns == edge.columns
    assert len(license_scan.license_scan(edge).collect()) == edge.count()
    assert license_scan.license_scan(none).isEmpty()
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "ONE two three"), (3, "one two three")], "item_id long, text string")
    found = decontamination.matches(edge, bench).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in found} == {(4, 3, 1.0), (5, 3, 1.0)}
    assert decontamination.matches(none, bench).isEmpty()
    assert decontamination.matches(edge, bench.limit(0)).isEmpty()
    assert decontamination.drop_contaminated(edge, bench).count() == edge.count() - 3


def test_wrapped_license_templates_are_found(spark):
    """Every template broken after each of its words, with and without words around; scattered words aren't one."""
    rows, want = [], {}
    for i, (label, template) in enumerate(license_scan.TEMPLATES):
        words = template.split(" ")
        for k in range(1, len(words)):
            rows.append((100 * i + k, f"some words\n * {' '.join(words[:k])}\n * {' '.join(words[k:])} and more\nlast"))
            want[100 * i + k] = label
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    rows += [(1000, bsd), (1001, bsd.replace(" ", "\n")), (1002, bsd.replace("\n", "\nx y z w\n")), (1003, bsd.replace(" ", " x\n"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.license_scan(frame).collect()}
    assert all(label in out[i].labels.split(",") for i, label in want.items())
    assert [(out[i].labels, out[i].score) for i in (1000, 1001)] == [("bsd-3", 1.0)] * 2
    assert [(out[i].labels, out[i].score) for i in (1002, 1003)] == [("", 0.0)] * 2


def test_license_of_its_own_kind(spark):
    rows = [
        (1, "Released under the MIT License."),
        (2, "licensed UNDER the Apache-License, version 2.0\nmore"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "This is the work of a public license reader."),
        (5, "CC BY\nNC and cc-by-nc"),
        (6, None),
    ]
    out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].base_labels, out[1].labels, out[1].first_word) == ("mit", "mit", 1)
    assert (out[2].base_labels, out[2].labels) == ("apache-2", "apache-2")
    assert (out[3].base_labels, out[3].labels, out[3].score) == ("", "gpl-3", 1.0)
    assert (out[4].labels, out[4].score) == ("", 0.0)
    assert (out[5].n_base, out[5].first_word, out[5].last_word) == (2, 0, 4)
    assert out[6].n_words == 0 and out[6].first_word is None


def test_near_passages_are_found_and_far_ones_are_not(spark):
    item = " ".join(f"w{i}" for i in range(60))
    near = item.replace("w30 ", "other ")  # 51 of 61 shingles
    far = item.replace("w30 ", "other ").replace("w10 ", "other ").replace("w50 ", "other ")
    noise = " ".join(f"n{i}" for i in range(100))
    rows = [(1, f"{noise} {item} {noise}"), (2, f"{noise} {near}"), (3, far), (4, noise), (5, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (round(r.similarity, 6), r.first_word) for r in decontamination.matches(docs, bench).collect()}
    assert got == {1: (1.0, 100), 2: (round(51 / 61, 6), 100), 5: (1.0, 0)}


def test_fingerprints_within_the_radius_share_a_block():
    masks = [m & (2**64 - 1) for m in decontamination._masks()]
    assert sum(masks) == 2**64 - 1 and len(masks) == decontamination.RADIUS + 1
