import random

import numpy as np
import pytest

from stepweave.llm import rolling, substring_dedup, suffix_dedup


def brute_words(rows, length=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted(split, key=lambda x: x[0]):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def brute_bytes(rows, length=100):
    first, out = {}, []
    for d, t in sorted(rows, key=lambda x: x[0]):
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in first:
                gone[i : i + length] = True
            else:
                first[t[i : i + length]] = d
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((d, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return sorted(out)


def test_windows_of_words_match_brute_force(spark, texts):
    rows = [(100 - 3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bits in (8, 20):  # a tiny sketch takes everything for repeated and changes nothing
        got = sorted((r[0], r[1], r[2], bytes(r[3])) for r in substring_dedup.remove_repeats(spark, docs, sketch_bits=bits).collect())
        assert got == brute_words(rows)
    got = sorted((r[0], r[1], r[2], bytes(r[3])) for r in substring_dedup.remove_repeats(spark, docs, length=5).collect())
    assert got == brute_words(rows, 5)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_strings_of_bytes_match_brute_force(spark, texts, shard_bytes):
    rows = [(100 - 3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(spark, docs, shard_bytes=shard_bytes).collect())
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_near_copies_of_a_repeated_line_match_brute_force(spark, shard_bytes):
    line = "| part 0017 | torque 12 Nm | see note |\n"
    edited = lambda at, by: line * at + line.replace("0017", by) + line * (19 - at)
    rows = [(3, line * 20), (5, edited(10, "0018")), (7, edited(10, "0019")), (8, edited(11, "0018")), (9, "Head\n" + edited(9, "0020") + "\nBetween\n" + edited(9, "0021"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(spark, docs, shard_bytes=shard_bytes).collect())
    assert len(line) == 40 and got == brute_bytes(rows)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_different_strings_of_one_fingerprint_match_brute_force(spark, shard_bytes):
    rnd = random.Random(5)
    filler = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for _ in range(12):  # each string of exactly 100 bytes comes twice; the variants of one base share their least gram
        base = filler(96)
        variants = [base + f"{i:04}" for i in range(5)]
        rows += [(rnd.randrange(1 << 30), pad + x + pad[::-1]) for x in variants * 2 for pad in (filler(rnd.choice([0, 0, 40])),)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60, "doc_id")  # copies in different tasks
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(spark, docs, shard_bytes=shard_bytes).collect())
    assert len(set(dict(rows))) == len(rows) and got == brute_bytes(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, long, 0), (1, long, 0), (None, long, 1), (2, "", 1)], "doc_id long, text string, k int")
    got = sorted(substring_dedup.remove_repeats(spark, docs).collect(), key=str)
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (1, 0), (2, 0), (None, 80)]
    got = sorted(suffix_dedup.remove_repeats(spark, docs).collect(), key=str)
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (1, 0), (2, 0), (None, len(long))]
    assert substring_dedup.remove_repeats(spark, docs.where("doc_id > 5")).count() == 0
    assert suffix_dedup.remove_repeats(spark, docs.where("doc_id > 5")).count() == 0


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(3)
    for n in (1, 2, 7, 50, 400):
        for letters in (b"a", b"ab", b"abcdefgh\x00"):
            t = bytes(rnd.choice(letters) for _ in range(n))
            order = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8))
            want = sorted(range(n), key=lambda i: t[i:])
            assert list(order) == want
            lcp = [0]
            for a, b in zip(want, want[1:], strict=False):
                m = 0
                while max(a, b) + m < n and t[a + m] == t[b + m]:
                    m += 1
                lcp.append(m)
            assert list(suffix_dedup.common_prefixes(np.frombuffer(t, np.uint8), order)) == lcp


def test_rolling_hashes_depend_on_content_only():
    data = np.frombuffer(b"aa bb  aa bb\ncc aa bb", np.uint8)
    h, _, _, bounds = rolling.word_hashes(data, np.array([0, 13, 21]))
    assert list(bounds) == [0, 4, 7] and h[0] == h[2] == h[5] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 3
    for m in (1, 2, 3, 5, 6):
        f = rolling.fold(np.tile(h[:2], 6), m)
        assert len(f) == 13 - m and f[0] == f[2] and (m == 12 or f[0] != f[1])
