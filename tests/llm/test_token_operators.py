"""Token files and packing against the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leaguelab.llm import best_fit_packing as bfp
from leaguelab.llm import token_orc
from leaguelab.llm.queries import QUERIES
from leaguelab.llm.token_codec import WordEncoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = [
    " ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "É", "é", "'s", "'", "1", "23", ".", "!?", "ß",
    "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "日本", "\x1c", "\x85", "Σ", "ing", "The", ",", "²", "Ⅷ", "J̌", "İ", "​",
]
# A memo of 200 words, so that generations change; the library as it is by default.
ENCODERS = {p: (WordEncoder(p, 40_000), Tokenizer.from_file(p)) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=5))
def test_words_give_the_ids_of_whole_texts(path, texts):
    own, library = ENCODERS[path]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("end", ["", "\n", "\n\n", " ", ", it's 42."])
def test_words_of_letters_need_the_merges_only(end):
    own, library = WordEncoder(BYTE), ENCODERS[BYTE][1]
    letters = [chr(c) for c in range(0x180) if chr(c).isalpha()]
    words = [a + b for a, b in zip(letters, reversed(letters))]
    text = "first " + " ".join(words) + "\nline of ñandú,\n\nübrig" + end
    cut, raw = [], own._raw
    own._raw = lambda some: cut.extend(some) or raw(some)
    got = np.frombuffer(own.encode([text])[0], "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
    # Only what the pattern may cut, or what stands behind a line end, goes through the whole library.
    assert {"\nline", "\nübrig"} <= set(cut) and len(cut) < 20 < len(words)


def test_lower_case_words_need_the_merges_only():
    own, library = WordEncoder(WORD), ENCODERS[WORD][1]
    letters = [chr(c) for c in range(0x180) if chr(c).isalpha() and c != 0x130]
    text = " ".join(a + b for a, b in zip(letters, reversed(letters)))
    cut, raw = [], own._raw
    own._raw = lambda some: cut.extend(some) or raw(some)
    for t in (text, text + " a\u0301 \u0130I"):  # the marks keep the capitals for the library
        got = np.frombuffer(own.encode([t])[0], "<u4").tolist()
        assert got == library.encode(t, add_special_tokens=False).ids
        if t is text:
            assert len(cut) < 40 < len(letters)


def ids_of(path, text):
    return np.array([*ENCODERS[path][1].encode(text or "", add_special_tokens=False).ids, 2], "<u4")


ROWS = [
    (5, "Hello world, hello."), (3, None), (4, ""), (None, "no id"), (5, "again"), (9, "x y z " * 3000),
    (5, "Hello world, hello."), (7, "é" * 50),
]


def docs(spark, rows):
    return spark.createDataFrame(
        [(k, t, 1, "p", 2) for k, t in rows], "doc_id long, text string, part int, ids string, row long"
    )


@pytest.mark.parametrize("rows", [ROWS, []])
def test_token_orc_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(docs(spark, rows), path, WORD, 2)
    got = [tuple(r) for r in token_orc.token_digests(spark, path).collect()]
    want, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(WORD, t)
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_orc_skips_by_id(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(docs(spark, ROWS), path, WORD, 2)
    some = token_orc.read_token_orc(spark, path, [7])
    assert [r.ids for r in some.collect()] == [ids_of(WORD, "é" * 50).tolist()]
    assert "PushedFilters: [In(doc_id, [7])" in some._jdf.queryExecution().executedPlan().toString() or (
        "EqualTo(doc_id,7)" in some._jdf.queryExecution().executedPlan().toString()
    )


def check_packing(rows, pieces, capacity):
    sequences, by_doc = {}, {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    want = {}
    for k, t in rows:
        ids = ids_of(BYTE, t)
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want.setdefault(k, []).append((n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_packed_documents(spark, rows):
    got = bfp.packed_documents(docs(spark, rows), BYTE, 2, capacity=64).collect()
    check_packing(rows, got, 64)


def test_whole_windows_of_many_partitions_stay_apart(spark):
    rows = [(n, f"w{n} " * 200) for n in range(80)]
    many = docs(spark, rows).repartition(40)
    check_packing(rows, bfp.packed_documents(many, BYTE, 2, capacity=64).collect(), 64)


@pytest.mark.parametrize("kind", ["pairs", "uniform"])
def test_exchange_between_parts_saves_windows(spark, kind):
    rng = np.random.default_rng(1)
    lengths = rng.choice([60, 40], 3000) if kind == "pairs" else rng.integers(1, 100, 3000)
    rows = [(n, n, 0, 0, int(x), 0) for n, x in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, bfp.PIECES)
    bound = bfp.dual_feasible_bound(np.bincount(lengths, minlength=101), 100)
    alone = bfp.pack_pieces(pieces, 100, part_rows=60, max_rounds=1)
    four = bfp.pack_pieces(pieces, 100, part_rows=60, max_rounds=4)
    shared = bfp.pack_pieces(pieces, 100, part_rows=60)
    counts = [x.select("sequence_id").distinct().count() for x in (alone, shared, four)]
    assert bound <= counts[1] <= counts[2] <= counts[0]
    if kind == "pairs":
        assert counts[1] < counts[0]
    assert shared.count() == 3000
    over = shared.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 100")
    assert over.isEmpty()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_never_exceeds_the_optimum(lengths):
    lengths = np.array(lengths, dtype=np.int64)

    def fits(rest, rooms):
        if not rest:
            return True
        seen = set()
        for n, room in enumerate(rooms):
            if room >= rest[0] and room not in seen:
                seen.add(room)
                if fits(rest[1:], rooms[:n] + [room - rest[0]] + rooms[n + 1 :]):
                    return True
        return False

    best = next(n for n in range(len(lengths) + 1) if fits(sorted(lengths.tolist(), reverse=True), [20] * n))
    assert bfp.dual_feasible_bound(np.bincount(lengths, minlength=21), 20) <= best
    window, place = bfp.best_fit_decreasing(lengths, 20)
    assert len(set(window.tolist())) >= best


def test_queries_on_real_rows(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(rows, QUERIES["op7_best_fit_packing"](spark, folder).collect(), 1024)
    got = sorted(tuple(r) for r in QUERIES["op3_token_orc"](spark, folder).collect())
    start, want = 0, []
    for k, t in sorted(rows):
        ids = ids_of(WORD, t)
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
