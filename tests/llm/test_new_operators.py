"""Host rules, vertical scans and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaguelab.llm import bond_mining, host_rules, periodic_runs
from leaguelab.llm.queries import QUERIES, repeating_documents

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, host string, words int, runs array<int>, n_words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, h, "x", 1, [1], "y") for i, t, h in rows], DOCS)


# --- Host rules ------------------------------------------------------------------------------------


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + s for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for s in range(3)
    }
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    repeated = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def plain_verdicts(rows, max_rate):
    counts = [plain_counts(t) for _, t, _ in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    docs, bad = Counter(h for _, _, h in rows), Counter(h for (_, _, h), f in zip(rows, failed) if f)
    n, k, mean = len(rows), len(docs), sum(failed) / len(rows)
    strength, binomial = 10_000.0, mean * (1 - mean)
    room = binomial * (n - sum(x * x for x in docs.values()) / n - (k - 1))
    if room > 0:
        spread = sum(docs[h] * (bad[h] / docs[h] - mean) ** 2 for h in docs)
        shared = (spread - binomial * (k - 1)) / room
        if shared > 0:
            strength = min(max((1 - shared) / shared, 2.0), 10_000.0)
    rejected = {h: (bad[h] + mean * strength) / (docs[h] + strength) > max_rate for h in docs}
    return Counter(
        (i, *c, f, not f and not rejected[h], h, rejected[h]) for (i, _, h), c, f in zip(rows, counts, failed)
    )


def judged(df):
    found = df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "host", "host_rejected",
    )
    return Counter(map(tuple, found.collect()))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t é\x1c#|", max_size=60))
def test_counts_of_a_text(text):
    assert host_rules.text_counts(text) == plain_counts(text)


def test_counts_with_a_large_vocabulary():
    words = [str(i) for i in range((1 << 20) + 5)] + ["0", "1", "2"]
    assert host_rules.repeated_words(words) == 6


def host_rows():
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "hot") for i in range(400)] + [(i, "short", "hot") for i in range(400, 420)]
    rows += [(i, "short" if i % 10 else good, "bad") for i in range(500, 560)]
    rows += [(600, "one short text", "small"), (601, good, "small2"), (None, None, None), (None, "", None)]
    rows += [(700 + i, "a b c " * 40 + "d", None) for i in range(8)] + [(708, good, None)]
    rows += [(7, "x\n\nx\ny\n y\nx", "lines")] * 3 + [(8, "word " * 200_000, "long")]
    return rows


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_host_verdicts_equal_brute_force(spark, broadcast_bytes):
    rows = host_rows()
    found = judged(host_rules.judged_documents(docs_of(spark, rows), broadcast_bytes=broadcast_bytes))
    assert found == plain_verdicts(rows, 0.5)
    verdicts = {r[8]: r[9] for r in found}
    # A bad host takes its good documents along; one bad document alone says little about its host.
    assert verdicts["bad"] and verdicts[None] and not verdicts["hot"] and not verdicts["small"]


def test_host_rules_on_one_host_and_none(spark):
    rows = [(1, "few words", "a"), (2, " ".join(map(str, range(80))), "a")]
    assert judged(host_rules.judged_documents(docs_of(spark, rows))) == plain_verdicts(rows, 0.5)
    assert host_rules.judged_documents(docs_of(spark, [])).collect() == []


def test_op11_on_real_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()
    assert judged(QUERIES["op11_host_rules"](spark, FOLDER)) == plain_verdicts(list(map(tuple, docs)), 0.5)


# --- Vertical scans --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, id string, v int, part string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, "p") for i, v, y in rows], VECTORS)


def plain_negatives(rows, every=10, k=5):
    rows = [
        (i, y, [int(np.floor(256 * x)) for x in v]) for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    widths = Counter(len(v) for *_, v in rows)
    width = min(widths, key=lambda w: (-widths[w], w)) if rows else 0
    rows = [r for r in rows if len(r[2]) == width]
    anchors = {}
    for i, y, v in sorted(rows):
        if i % every == 0:
            anchors.setdefault(i, (y, v))
    out = []
    for a, (label, vector) in anchors.items():
        scored = sorted(
            (-sum(x * z for x, z in zip(vector, v)), i, y) for i, y, v in rows if i != a
        )
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            inside = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(a, p, n, q, -s, -t) for n, (t, q, _) in enumerate(inside[:k], 1)]
    return Counter(out)


def found_negatives(df):
    return Counter(map(tuple, df.collect()))


def random_rows(n, width, seed, levels=None):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, width)) if levels is None else rng.integers(0, levels, (n, width)) / 256
    return [(i, [float(x) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(values)]


@pytest.mark.parametrize("levels", [None, 3])
def test_negatives_equal_brute_force(spark, levels):
    rows = random_rows(700, 9, 3, levels)
    found = bond_mining.hard_negatives(vectors_of(spark, rows), "vec_id % 10 = 0", part_rows=100)
    assert found_negatives(found) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = random_rows(150, 4, 5)
    rows += [(200, None, 1), (201, [1.0, None, 1.0, 1.0], 1), (202, [float("nan")] * 4, 2),
             (203, [float("inf"), 0.0, 0.0, 0.0], 2), (204, [1.0] * 4, None), (None, [1.0] * 4, 1),
             (210, [1.0] * 3, 1), (220, [], 1)]
    rows += [(230, [0.5] * 4, 1)] * 30 + [(231, [0.45] * 4, 2)] * 7 + [(240, [0.0] * 4, 3)]
    found = bond_mining.hard_negatives(vectors_of(spark, rows), "vec_id % 10 = 0", part_rows=64)
    assert found_negatives(found) == plain_negatives(rows)


@pytest.mark.parametrize("scale", [2.0**24, 2.0**30])
def test_negatives_of_large_components_are_exact(spark, scale):
    rows = [(i, [x * scale / 256 for x in v], y) for i, v, y in random_rows(120, 5, 8, 90)]
    found = found_negatives(bond_mining.hard_negatives(vectors_of(spark, rows), "vec_id % 10 = 0"))
    clip = lambda x: min(x, 2**63 - 1)
    assert {(a, p, n, q) for a, p, n, q, *_ in found} == {(a, p, n, q) for a, p, n, q, *_ in plain_negatives(rows)}
    assert Counter(r[4:] for r in found) == Counter(tuple(map(clip, r[4:])) for r in plain_negatives(rows))


def test_negatives_beyond_the_range_of_a_long(spark):
    rows = [(0, [1e30], 1), (1, [1e30], 1), (2, [9e29], 2), (3, [-1e30], 2)]
    found = bond_mining.hard_negatives(vectors_of(spark, rows), "vec_id = 0").collect()
    assert [tuple(r)[:2] for r in found] in ([], [(0, 1)])


def test_negatives_of_nothing(spark):
    assert bond_mining.hard_negatives(vectors_of(spark, []), "vec_id % 10 = 0").collect() == []
    rows = [(0, [], 1), (1, [], 1), (2, [], 2)]
    found = found_negatives(bond_mining.hard_negatives(vectors_of(spark, rows), "true"))
    assert found == plain_negatives(rows, 1) and len(found) == 2


def test_columns_are_read_for_fewer_and_fewer_rows():
    rng = np.random.default_rng(1)
    columns = np.round(rng.normal(size=(64, 3000)) * np.geomspace(100, 0.01, 64)[:, None]).astype(np.int64)
    part = bond_mining.VerticalPart(np.arange(3000), np.zeros(3000, int), columns, int(abs(columns).max()))
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple):
                read.append(len(key[1]))
            return np.asarray(super().__getitem__(key)).view(Counted)

    part.columns = part.columns.view(Counted)
    anchor = columns[:, 7]
    scores = anchor @ columns
    top = sorted(zip(-scores, range(3000)))[:5]
    found = [(-s, i) for _, i, s in part.first_in_windows(anchor, np.arange(3000), [(-(2**62), 2**62)], 5)]
    assert found == [(int(s), i) for s, i in top]
    assert read and read[-1] < 300


def test_op12_parts_are_bounded_and_no_vector_is_copied(spark):
    rows, largest = bond_mining.quantised_rows(
        vectors_of(spark, random_rows(1000, 4, 2)), "vec_id", "embedding", F.col("label"), 256
    )
    parted, parts = bond_mining._dealt(rows, 128)
    sizes = [r["count"] for r in parted.groupBy("part").count().collect()]
    assert parts == 8 and sum(sizes) == 1000 and max(sizes) <= 256


# --- Periodic runs ---------------------------------------------------------------------------------


def plain_runs(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(exponent * q, least):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 40)), max_size=4),
    st.integers(2, 5), st.integers(2, 8), st.lists(st.integers(1, 50), min_size=1, max_size=6),
)
def test_runs_of_any_sequence_in_any_slices(pieces, exponent, least, slices):
    words = [w for piece, size in pieces for w in (piece * size)[:size]]
    catcher, at, n = periodic_runs.SquareCatcher(exponent, least), 0, 0
    while at < len(words):
        step = slices[n % len(slices)]
        catcher.append(np.array(words[at : at + step]))
        at, n = at + step, n + 1
        assert catcher.runs() == plain_runs(words[:at], exponent, least)


def test_runs_do_not_cross_texts():
    texts = [["a"] * 5, ["a"] * 7, [], ["b", "a"] * 6, ["a"] * 3]
    assert periodic_runs.word_runs(texts, 4, 6) == [plain_runs(t) for t in texts]


def test_long_periodic_texts_cost_what_other_texts_cost():
    ids = np.tile(np.arange(700), 1500)
    catcher = periodic_runs.SquareCatcher(4, 6)
    for start in range(0, len(ids), 1 << 16):
        catcher.append(ids[start : start + (1 << 16)])
    assert catcher.runs() == [(0, len(ids), 700)]
    # Only the words and the tails of open catchers are held.
    assert sum(len(t) for t in catcher.tails) <= 4 * len(ids)


def plain_text(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_row(doc_id, text):
    words = plain_text(doc_id, text)
    runs = plain_runs(words)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *found, digest(lines), digest(left))


def test_op13_on_real_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    # Brute force is quadratic in the words of a text.
    want = {d: plain_row(d, t) for d, t in docs if len(t or "") < 20_000}
    found = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    assert len(found) == len(docs) and {d: found[d] for d in want} == want
    assert any(r[1] for r in want.values())


def test_op13_on_odd_rows(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40)), "h") for i in range(300)]
    rows += [(None, None, "h"), (None, "a " * 9, None), (7, "", "h"), (8, " \n\t", "h"), (9, "a b a b a b a b", "h")]
    rows += [(-5, "x y " * 20, "h"), (10, "a\x1cb " * 8, "h")] + [(11, "c " * 100, "h")] * 3
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(map(tuple, QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()))
    assert found == Counter(plain_row(i, t) for i, t, _ in rows)
    texts = repeating_documents(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert Counter((i, " ".join(WORD.findall(t or ""))) for i, t in texts) == Counter(
        (i, " ".join(plain_text(i, t))) for i, t, _ in rows
    )


def test_periodic_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(docs_of(spark, [])).collect() == []
