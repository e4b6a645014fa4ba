import random
import re
from collections import defaultdict

import numpy as np
import pytest

from stepweave.llm import components, jaccard_join, sketch, substring_dedup
from stepweave.llm.scratch import Scratch


def shingles(text, gram=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, tried = set(), set()
    for group in by.values():
        for x in group:
            for y in group:
                if x < y and (x, y) not in tried:
                    tried.add((x, y))
                    a, b = sets[x][1], sets[y][1]
                    if 100 * len(a & b) >= percent * len(a | b):
                        links.add((x, y))
                        parent[root(x)] = root(y)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)), links


@pytest.fixture(scope="module")
def rows():
    """Copies, chains of near copies, a phrase in most texts, and short texts."""
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzw"]
    out, common = [], " ".join(rnd.choice(words) for _ in range(25))
    for g in range(25):
        t = [rnd.choice(words) for _ in range(rnd.choice([2, 3, 4, 12, 60, 150]))]
        for _ in range(rnd.choice([1, 1, 2, 12])):
            out.append(" ".join(t).capitalize() + (" " + common if g % 3 else "\n"))
            if len(t) > 20 and rnd.random() < 0.8:
                t = list(t)
                for _ in range(rnd.choice([1, 1, 2, 3])):
                    t[rnd.randrange(len(t))] = rnd.choice(words)
    out += [None, "", " \t\n", "One", "one", "one two", "Two one"]
    rnd.shuffle(out)
    return [(1000 - 7 * i, t) for i, t in enumerate(out)]


def test_components_and_links_match_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, links = brute(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark, docs).collect())
    assert got == want
    join = jaccard_join.Join(spark, substring_dedup.keyed(docs, "doc_id", "text"))
    sets = {}
    for d, t in rows:
        if shingles(t):
            sets.setdefault(frozenset(shingles(t)), d)
    distinct = {frozenset((frozenset(shingles(rows[x][1])), frozenset(shingles(rows[y][1])))) for x, y in links}
    assert join.links().count() == sum(len(p) == 2 for p in distinct)


def test_other_limits_and_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark, docs, percent=60).collect())
    assert got == brute(rows[:60], 60)[0]
    text = "a b c d e f g h"
    odd = spark.createDataFrame([(3, text, "x"), (3, text, "y"), (None, text, "z"), (None, None, "z"), (5, "q", "k")], "doc_id long, text string, k string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark, odd).collect()), key=str)
    assert got == [(3, 5, 3), (3, 5, 3), (5, 1, 5), (None, 0, None), (None, 5, 3)]
    assert jaccard_join.near_duplicates(spark, odd.where("doc_id > 9")).count() == 0


def test_hubs_chains_long_sets_and_many_rounds(spark, monkeypatch):
    """Near copies of an original that is there or missing, a chain, and texts of thousands of n-grams; also where every round of hubs is used."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]

    def changed(t, places):
        t = list(t)
        for p in places:
            t[p] = rnd.choice(words) + "x"
        return t

    texts = []
    for original in (True, False):
        t = [rnd.choice(words) for _ in range(120)]
        texts += [t] * original + [changed(t, rnd.sample(range(120), rnd.choice([1, 2, 2, 3, 4]))) for _ in range(25)]
    t = [rnd.choice(words) for _ in range(100)]
    for i in range(12):  # each step is a link, longer ways are not
        t = changed(t, [8 * i % 100])
        texts.append(t)
    t = [rnd.choice(words) for _ in range(5000)]
    texts += [t, changed(t, rnd.sample(range(5000), 60)), changed(t, rnd.sample(range(5000), 400)), t[:4400], t[:4200]]
    texts += [[*texts[0], "tail"]] * 2
    rnd.shuffle(texts)
    rows = [(5 * i + 1, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "FRAGMENT_GRAMS", 300)
    for most in (28, 8):  # beyond the bound, n-grams are counted by a shuffle
        monkeypatch.setattr(jaccard_join, "MOST_BITS", most)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark, docs).collect())
        assert got == brute(rows)[0]


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, x) for x in range(300, 340)] + [(x, (x - 400 + 1) % 30 + 400) for x in range(400, 430)] + [(7, 7)]
    edges = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in edges]
    got = dict(components.components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{x: 100 for x in range(100, 181)}, **{x: 5 for x in (5, *range(300, 340))}, **{x: 400 for x in range(400, 430)}}


def test_a_task_sketches_many_ngrams_in_little_memory():
    import tracemalloc

    def rows(flush, parts):
        rnd = np.random.default_rng(4)
        for batch in sketch.partial_rows((rnd.integers(0, 1 << 63, 10_000, np.uint64) for _ in range(parts)), 24, flush):
            yield from batch.to_pylist()

    tracemalloc.start()
    assert sum(1 for _ in rows(jaccard_join.FLUSH_GRAMS, 450)) >= 2 * 2 * sketch.SHARDS
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # of each Python worker; with four million at a time it is above 200 MB

    def counts(flush):
        total = np.zeros((sketch.DEPTH, sketch.SHARDS, 1 << 20), np.int64)
        for r in rows(flush, 20):
            total[r["line"], r["shard"], sketch._ungapped(r["once"])] += 1
            total[r["line"], r["shard"], sketch._ungapped(r["more"])] += 2
        return np.minimum(total, 2)

    assert (counts(30_000) == counts(1 << 30)).all()
