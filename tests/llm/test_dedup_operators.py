"""SimHash, line and byte-string deduplication against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from leaguelab.llm import line_dedup, simhash_bktree, suffix_dedup
from leaguelab.llm.components import connected_components
from leaguelab.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, t, 1, "h", [1]) for k, t in rows], "doc_id long, text string, id int, h string, sketch array<int>"
    )


# --- SimHash ---------------------------------------------------------------------------------------


def fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    values = np.array(prints, dtype=np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(values))]


def want_components(rows, width=3, radius=2):
    prints = [fingerprint(t, width) for _, t in rows]
    roots = components(prints, radius)
    low = {}
    for (k, _), r in zip(rows, roots):
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return [(k, f"{p:016x}", low.get(r)) for (k, _), p, r in zip(rows, prints, roots)]


EDGE = [(3, None), (1, ""), (2, " \t\n"), (9, "one two"), (8, "One TWO"), (8, "One TWO"), (None, "a b c d"),
        (7, "a b c d"), (6, "É b c"), (5, "é b c"), (4, "w " * 100_000)]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_simhash_edge_cases(spark, rows):
    got = [tuple(r) for r in simhash_bktree.simhash_components(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want_components(rows), key=str)


def test_simhash_query(spark):
    got = [tuple(r) for r in QUERIES["op4_simhash_bktree"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want_components(real(spark)))


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**16 - 1), min_size=1, max_size=60), st.integers(0, 4))
def test_bk_tree_finds_all_within_radius(values, radius):
    values = np.array(sorted(values), dtype=np.uint64)
    found = set()
    for at, near in simhash_bktree.BKTree(values).within(values, radius):
        found.update((at, int(x)) for x in near)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}
    assert found == want


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_band_links_lose_nothing_in_hot_shards(spark, shard_rows):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = set(base)
    for _ in range(150):  # dense balls: most shards are larger than three
        v = rng.choice(list(values))
        values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash_bktree.band_links(df, 2, shard_rows)).collect()}
    want = components(values, 2)
    pairs = defaultdict(set)
    for v, w in zip(signed, want):
        pairs[w].add(roots.get(v, v))
    assert all(len(p) == 1 for p in pairs.values())
    assert len({next(iter(p)) for p in pairs.values()}) == len(pairs)


def test_sketch_links_lose_nothing_in_hot_shards(spark):
    rng = random.Random(14)
    values = []
    for _ in range(60):  # pairs, all in one shard
        v = rng.getrandbits(64)
        values += [v, v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(32))]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v, [1, 2]) for v in signed], "fp long, sketch array<long>")
    for shard_rows in (2, 50):
        links = simhash_bktree.sketch_links(df, 2, shard_rows)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        got = [roots.get(v, v) for v in signed]
        assert all(got[n] == got[n + 1] for n in range(0, 120, 2)) and len(set(got)) == 60


@pytest.mark.parametrize("shard_rows", [4096, 6])
def test_similar_links_against_brute_force(spark, shard_rows):
    rng = random.Random(15)
    words = [f"w{n}" for n in range(3000)]
    rows = []
    for n in range(60):
        text = rng.choices(words, k=150)
        rows += [(2 * n, " ".join(text))]
        for at in rng.sample(range(0, 150, 10), rng.randint(1, 6)):  # similarities of 0.55 to 0.95
            text[at] = "changed"
        rows += [(2 * n + 1, " ".join(text))]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    want = {n for n in range(60) if len(sets[2 * n] & sets[2 * n + 1]) >= 0.8 * len(sets[2 * n] | sets[2 * n + 1])}
    assert 10 < len(want) < 50
    texts = frame(spark, rows).selectExpr("doc_id node", "text")
    prints = simhash_bktree.fingerprints(texts, 5, True, "node").withColumnRenamed("doc_id", "node")
    if shard_rows < 4096:  # all in one hot shard
        prints = prints.selectExpr("node", "fp", "array(1L) sketch")
    got = {(r.a, r.b) for r in simhash_bktree.similar_links(prints, texts, 5, 20, 0.8, shard_rows).collect()}
    assert {(min(x), max(x)) for x in got} == {(2 * n, 2 * n + 1) for n in want}


def test_components_of_a_long_chain(spark):
    edges = [(n, n + 1) for n in range(200)] + [(500, 400), (None, 3), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(n, 0) for n in range(1, 201)} | {(500, 400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_one_of_each_near_duplicate_group_stays(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    rows = list(enumerate(texts))
    for n, t in enumerate(texts[:10]):
        near = t.split(" ")
        near[100] = "changed"
        rows += [(100 + n, " ".join(near)), (200 + n, t)]
    rows += [(300, None), (301, ""), (None, texts[0])]
    got = simhash_bktree.one_of_each_group(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "id", "h", "sketch"]
    assert sorted(r.doc_id for r in got.collect()) == [*range(20), 300]
    hot = simhash_bktree.sketch_links(
        simhash_bktree.fingerprints(frame(spark, rows), 5, True).select("fp", "sketch").distinct(), 10, 2
    )
    assert hot.count() > 0
    assert simhash_bktree.near_duplicate_groups(frame(spark, rows)).count() == len(rows)


# --- lines -----------------------------------------------------------------------------------------


def without_lines(rows, min_words=8):
    lines = []
    for at, (k, t) in enumerate(sorted(rows, key=lambda r: r[0])):
        for no, line in enumerate((t or "").split("\n")):
            words = line.split()
            if words:
                lines.append((k, no, " ".join(words), len(words)))
    gone, seen = defaultdict(set), set()
    for n, (k, no, text, count) in enumerate(lines):
        near = count >= min_words and any(
            c >= min_words and line_dedup.one_edit_apart(text, x) for _, _, x, c in lines[:n]
        )
        if text in seen or near:
            gone[k].add(no)
        seen.add(text)
    return {
        k: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k])
        for k, t in rows
    }


@pytest.mark.parametrize("bits", [1 << 22, 64])
def test_lines_against_brute_force(spark, bits):
    rng = random.Random(3)
    rows = [
        (n, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 11))) for _ in range(rng.randint(0, 5))))
        for n in range(200)
    ] + [(900, None), (901, ""), (902, "\n\n"), (903, "tail  of   blanks "), (904, "tail of blanks")]
    got = line_dedup.dedup_lines(frame(spark, rows), bits=bits)
    assert got.columns == ["doc_id", "text", "id", "h", "sketch", "lines_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == without_lines(rows)
    assert all(r.h == "h" and r.id == 1 for r in got.collect())


def test_lines_defined_cases(spark):
    rows = [(2, "x y\nz"), (1, "x y"), (None, "x y\nown"), (5, "z"), (5, "z")]
    got = line_dedup.dedup_lines(frame(spark, rows).withColumnRenamed("h", "lines_removed")).collect()
    assert sorted([(r.doc_id, r.text, r.lines_removed) for r in got], key=str) == sorted(
        [(2, "z", 1), (1, "x y", 0), (None, "own", 1), (5, "", 1), (5, "", 1)], key=str
    )
    assert line_dedup.dedup_lines(frame(spark, [])).isEmpty()


def test_lines_query(spark):
    got = {r.doc_id: r.text for r in QUERIES["op10_line_dedup"](spark, FOLDER).collect()}
    assert got == without_lines(real(spark))


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_one_edit(a, b):
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(rows[j] + (x != y), rows[j + 1] + 1, now[j] + 1))
        rows = now
    if a and b:
        assert line_dedup.one_edit_apart(" ".join(a), " ".join(b)) == (rows[-1] <= 1)


# --- byte strings ----------------------------------------------------------------------------------


def without_repeats(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                gone[s : s + length] = 1
        spans = int((np.diff(np.r_[0, gone]) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=4, max_size=40), min_size=1, max_size=6), st.integers(4, 20), st.data())
def test_intervals_find_repeats(texts, length, data):
    runs = [t.encode().ljust(length, b"z") for t in texts]
    weights = np.array([data.draw(st.integers(1, 2)) for _ in runs])
    counts = Counter()
    for r, w in zip(runs, weights):
        for s in range(len(r) - length + 1):
            counts[r[s : s + length]] += w
    for r, found in zip(runs, suffix_dedup.repeated_windows(runs, weights, length)):
        got = {s for a, b in found for s in range(a, b)}
        assert got == {s for s in range(len(r) - length + 1) if counts[r[s : s + length]] > 1}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé", max_size=60), max_size=6), st.integers(4, 20))
def test_runs_of_many_texts_at_once(texts, length):
    data = [t.encode() for t in texts]
    sizes = np.array([len(b) for b in data], dtype=np.int64)
    got = [x.tolist() for x in suffix_dedup.window_runs(b"".join(data), sizes, length, 4)]
    begins, want = np.cumsum(sizes) - sizes, []
    for t, b in enumerate(data):
        low = []
        hashes = suffix_dedup.gram_hashes(b, 4).view(np.int64).tolist() if len(b) >= length else []
        for s in range(len(b) - length + 1):
            low.append(min(hashes[s : s + length - 3], key=lambda x: x % (1 << 64)))
        for key, run in itertools.groupby(enumerate(low), key=lambda x: x[1]):
            run = [s for s, _ in run]
            own = hashes[run[0] : run[-1] + length - 3].count(key) > 1
            want.append((key, t, int(begins[t]) + run[0], len(run), own))
    assert list(zip(*got)) == want


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=40), st.integers(2, 9), st.booleans())
def test_entries_sorted_within_classes(rows, slab, wide):
    classes = np.array(sorted(c for c, _ in rows), dtype=np.int32)
    after = np.array([a for _, a in rows], dtype=np.int32) << (28 if wide else 0)
    with mock.patch.object(suffix_dedup, "_SLAB", slab):
        got = suffix_dedup._sorted_within(classes, after)
    assert got.tolist() == sorted(range(len(rows)), key=lambda i: (classes[i], after[i], i))


def test_bucket_in_parts_of_whole_keys():
    rng = np.random.default_rng(3)
    rows, key_of = [], {}
    for key in range(12):
        data = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
        for c1, part in enumerate((data, data[: 100 + key], data[50:] + b"!")):
            rows.append((key, 10 * key + c1, 0, 1, part))
            key_of[part] = key
    bucket = pd.DataFrame(rows, columns=["key", "c1", "c2", "weight", "data"]).sample(frac=1, random_state=1)
    parts = []

    def seen(runs, weights, length, do=suffix_dedup.repeated_windows):
        parts.append(runs)
        return do(runs, weights, length)

    with mock.patch.object(suffix_dedup, "repeated_windows", seen):
        found = suffix_dedup._bucket_repeats(40)(bucket).set_index("c1")["found"].to_dict()
    # A part may go over its size by one key.
    assert len(parts) > 1 and all(sum(map(len, p)) < suffix_dedup._PART + 130_000 for p in parts)
    keys = [{key_of[r] for r in p} for p in parts]
    assert sum(map(len, keys)) == len(set().union(*keys)) == 12
    for key in range(12):
        assert found[10 * key] == [[0, 59_961]]
        assert found[10 * key + 1] == [[0, 61 + key]]
        assert found[10 * key + 2] == [[0, 59_911]]


def test_ended_strings_are_sorted_no_further():
    # Equal ends of strings stay one class, whatever follows them in the text.
    text = np.frombuffer(b"abcabcabc\0xbcabcabc\0yabc\0", dtype=np.uint8)
    ends = np.flatnonzero(text == 0)
    left = (ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))).astype(np.int32)
    order, first = suffix_dedup.suffix_order(text, left, 16)
    strings = [text[s : s + n].tobytes() for s, n in enumerate(left.tolist())]
    assert [strings[s] for s in order] == sorted(strings)
    assert first[text == 0].tolist() == [0, 0, 0] and len({int(first[s]) for s in (6, 16, 21)}) == 1


@pytest.mark.parametrize("key_runs", [2000, 2])
def test_repeats_against_brute_force(spark, key_runs):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    base = [letters(200) for _ in range(4)]
    rows = []
    for n in range(50):
        at = rng.randint(0, 150)
        rows.append((n, rng.choice([
            letters(rng.randint(0, 150)), "a" * rng.randint(0, 100), "ab" * rng.randint(0, 60),
            letters(20) + rng.choice(base)[at : at + rng.randint(10, 80)] + "é" + letters(20),
            rows[0][1] if rows else "",
        ])))
    rows += [(5, rows[5][1]), (None, "xyz" * 30), (None, None), (77, "xyz" * 30)]
    got = suffix_dedup.repeated_spans(
        frame(spark, rows), length=24, gram=4, cell=4, key_runs=key_runs, bucket_bytes=500
    ).collect()
    digests = [(r[0], r[1], sum(r[2][1::2]) - sum(r[2][::2]), len(r[2]) // 2, r[3]) for r in got]
    assert sorted(digests, key=str) == without_repeats(rows, 24)


def test_repeats_query(spark):
    got = sorted((tuple(r) for r in QUERIES["op6_suffix_dedup"](spark, FOLDER).collect()), key=str)
    assert got == without_repeats(real(spark), 400)
    assert suffix_dedup.repeated_spans(frame(spark, [])).isEmpty()
