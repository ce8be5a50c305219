"""What grows by batches: near-duplicate clusters, windows that count late events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Window, functions as F

from scriptorium.operators import passages
from scriptorium.operators.incremental_clusters import Clusters
from scriptorium.session import scratch_path
from scriptorium.streaming.windows import CountedWindows

CHUNK = "row_key string, kind string, url string, content_hash string, fetch_date string, text string"


def chunks(seed=1):
    """Families of near-copies, equal texts on one page and on several, short texts, decks."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    rows = []
    for family in range(6):
        base = [word() for _ in range(30)]
        for copy in range(7):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(30)] = word()
            page = rng.randrange(5)
            rows.append((f"u{page}-{family}", f"h{page}", " ".join(text)))
    rows += [(f"u{k}", "h", rows[k % 5][2]) for k in range(8)] + [("u1", "h1", "one two"), ("u2", "h2", "one two"), ("u3", "h3", "")]
    # one page's two near-copies: linked only once another page holds one of them
    base = [f"z{k}" for k in range(30)]
    rows += [("same", "h", " ".join(base)), ("same", "h", " ".join(base[:-1] + ["y"])), ("other", "h", " ".join(base))]
    out = [(f"r{k:03d}", "web", url, h, f"2024-01-{k % 27 + 1:02d}", text) for k, (url, h, text) in enumerate(rows)]
    return [*out, ("s1", "slides", None, None, None, rows[0][2])]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_batches_in_any_order_equal_all_at_once(spark):
    rows = chunks()
    whole = rows_of(passages.corpus_dedup(spark.createDataFrame(rows, CHUNK)))
    assert any(r[2] > 3 for r in whole)
    cut = (0, 25, 52, len(rows))  # the page that makes two copies a pair comes last
    parts = [spark.createDataFrame(rows[a:b], CHUNK) for a, b in zip(cut, cut[1:])]
    for order in ((0, 1, 2), (2, 0, 1)):
        held = Clusters(spark, scratch_path(spark, "clusters"))
        for number, part in enumerate(order):
            held.add(parts[part], number)
        assert rows_of(held.clusters(3)) == whole
    # delivered twice, the last batch changes nothing
    held.add(parts[1], 2)
    assert rows_of(held.clusters(3)) == whole
    first = rows_of(passages.corpus_dedup(parts[2]))
    assert rows_of(held.clusters(1)) == first


START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def counted(batches):
    """Plain Python: (caller, hour) -> [kept, late], by the watermark before each batch."""
    out, last = {}, None
    for batch in batches:
        mark = None if last is None else last - timedelta(minutes=10)
        for caller, ts in batch:
            start = ts.replace(minute=0, second=0)
            late = mark is not None and start + timedelta(hours=1) <= mark
            out.setdefault((caller, start), [0, 0])[late] += 1
        last = max([*(ts for _, ts in batch), *([last] if last else [])], default=last)
    return out, last


def test_late_events_are_counted_and_nothing_is_lost(spark):
    rng = random.Random(4)
    batches = []
    for k in range(4):
        near = [(rng.randrange(3), START + timedelta(minutes=90 * k + rng.randrange(90))) for _ in range(40)]
        batches.append(near + [(rng.randrange(3), START + timedelta(minutes=rng.randrange(60))) for _ in range(5 * (k > 1))])
    held = CountedWindows(spark, scratch_path(spark, "windows"), "user", "1 hour", 4)
    frames = [spark.createDataFrame(b, "user long, ts timestamp") for b in batches]
    for k, frame in enumerate(frames):
        held.add(frame, k)
    held.add(frames[3], 3)  # delivered again
    want, last = counted(batches)
    totals = {r.user: (r.kept, r.late) for r in held.totals().collect()}
    assert totals == {u: (sum(v[0] for k, v in want.items() if k[0] == u), sum(v[1] for k, v in want.items() if k[0] == u)) for u in totals}
    assert sum(map(sum, totals.values())) == sum(map(len, batches)) and sum(v[1] for v in totals.values()) > 0
    got = {(r.user, r.at): (r.events, r.refused, r.late) for r in held.windows().withColumn("at", F.unix_timestamp("window_start")).collect()}
    assert got == {
        (u, int(s.timestamp())): (kept, max(0, kept - 4), late)
        for (u, s), (kept, late) in want.items()
        if s + timedelta(hours=1) <= last - timedelta(minutes=10)
    }


def test_counted_windows_of_an_empty_batch(spark):
    held = CountedWindows(spark, scratch_path(spark, "windows"), "user", "1 hour", 4)
    none = spark.createDataFrame([], "user long, ts timestamp")
    held.add(none, 0)
    held.add(none, 1)
    assert held.totals().isEmpty() and held.windows().isEmpty()


def test_hours_rolled_up_are_the_day_within_the_bounds(spark):
    from scriptorium.operators import sketches

    rng = random.Random(8)
    rows = [(START + timedelta(minutes=rng.randrange(3000)), rng.choice("ab"), int(rng.lognormvariate(4, 2)), f"t{rng.randrange(4000)}") for _ in range(20_000)]
    rows += [(START, None, 7, "t"), (START, "a", None, "t")]
    frame = spark.createDataFrame(rows, "ts timestamp, kind string, ms long, task string")
    fine = sketches.hourly(frame, ["kind"], "ts", "ms", "task")
    days = sketches.rolled_up(fine, ["kind"], "1 day")
    out = {(r.kind, r.window_start.day): r for r in sketches.checked(frame, days, ["kind"], "ts", "ms", "task", "1 day", [0.01, 0.5, 0.95]).collect()}
    assert all(r.within for r in out.values()) and sum(r.n for r in out.values()) == len(rows) - 1
    for (kind, day), r in out.items():
        own = [x for x in rows if x[1] == kind and x[0].day == day and x[2] is not None]
        assert (r.n, r.ids) == (len(own), len({x[3] for x in own}))
    # an estimate out of bounds is told
    wrong = days.withColumn("kll", F.first("kll").over(Window.partitionBy(F.lit(1)).orderBy("n")))
    assert not all(r.within for r in sketches.checked(frame, wrong, ["kind"], "ts", "ms", "task", "1 day", [0.5]).collect())


def test_a_batch_writes_its_texts_once_and_leaves_nothing_else(spark, tmp_path, monkeypatch):
    from scriptorium import session

    monkeypatch.setattr(session, "scratch_path", lambda spark, name: str(tmp_path / f"scratch-{name}-{len(made.append(name) or made)}"))
    made, held = [], Clusters(spark, str(tmp_path / "clusters"))
    rows = chunks()
    held.add(spark.createDataFrame(rows[:30], CHUNK), 0)
    held.add(spark.createDataFrame(rows[30:], CHUNK), 1)
    assert "cluster-met" in made and not {"cluster-features", "cluster-prefixes"} & set(made)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("scratch-cluster")]
    assert rows_of(held.clusters(2)) == rows_of(passages.corpus_dedup(spark.createDataFrame(rows, CHUNK)))


def test_only_shingles_that_the_batch_shares_are_shuffled_whole(spark, tmp_path, monkeypatch):
    from scriptorium.operators import incremental_clusters

    sent = []

    def watched(rows, key, keys):
        sent.append((rows.count(), keys.count()))
        return keep(rows, key, keys)

    keep = incremental_clusters.rows_of_keys
    monkeypatch.setattr(incremental_clusters, "rows_of_keys", watched)
    held = Clusters(spark, str(tmp_path / "clusters"))
    words = lambda a, n: " ".join(f"v{a}x{i}" for i in range(n))
    rows = [(f"r{k}", "web", f"u{k}", "h", "2024-01-01", words(k, 12)) for k in range(8)]
    held.add(spark.createDataFrame(rows, CHUNK), 0)
    held.add(spark.createDataFrame([("s", "web", "s", "h", "2024-01-02", words(3, 13))], CHUNK), 1)
    assert sent[0][1] == 0 and 0 < sent[1][1] < sent[1][0] / 4
    assert sorted(r.copies for r in held.clusters(2).collect()) == [1] * 7 + [2]
