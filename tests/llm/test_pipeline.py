"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import re

import pytest
from test_dedup_operators import without_lines
from test_token_operators import check_packing

import corpus_pipeline
from leaguelab.llm.shared import written

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, FOLDER), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, after in list(stages.values())[:-1]:
        assert after.columns == COLUMNS
        kinds = [f.dataType for f in after.schema]
        assert kinds == [f.dataType for f in stages["toxicity"][0].schema]


def test_toxic_documents_go(spark, stages):
    before, after = (texts(x) for x in stages["toxicity"])
    labels = dict(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").collect())
    gone = before.keys() - after.keys()
    assert {k: after[k] for k in after} == {k: before[k] for k in after}
    assert not [k for k in gone if labels.get(k) == 0]
    named = re.compile(r"\b(idiot|moron|scum|loser|stupid|worthless)\b", re.I)
    assert sum(bool(named.search(before[k])) for k in gone) >= len(gone) / 2


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = without_lines(list(texts(before).items()))
    assert texts(after) == want
    assert {r.doc_id: r.n_chars for r in after.collect()} == {k: len(t) for k, t in want.items()}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_of_each_group(stages):
    before, after = (texts(x) for x in stages["near_dedup"])
    sets = {k: shingles(t) for k, t in before.items()}

    def similar(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    kept = sorted(after)
    assert not [(a, b) for n, a in enumerate(kept) for b in kept[n + 1 :] if similar(a, b) >= 0.9]
    for k in before.keys() - after.keys():
        assert max(similar(k, x) for x in before if x < k) >= 0.6


def test_contaminated_documents_go(spark, stages):
    before, after = (texts(x) for x in stages["decontamination"])
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for k, text in before.items():
        has = " " + " ".join(words(text)) + " "
        whole = any(" " + " ".join(i) + " " in has for i in items)
        pieces = [i[n : n + 6] for i in items for n in range(0, len(i) - 5)]
        some = any(" " + " ".join(p) + " " in has for p in pieces)
        assert not (whole and k in after)
        assert some or k in after


def test_packing(stages):
    before, after = stages["packing"]
    check_packing(list(texts(before).items()), after.collect(), 1024)


def test_run_gives_the_rows_of_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select(columns).collect())
    assert got == sorted(tuple(r) for r in stages["packing"][1].select(columns).collect())


def test_stages_on_edge_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, "x " * 50_000, None, "s", None)],
        docs.schema,
    )
    for rows in (odd, odd.limit(0)):
        left = rows
        for name, stage in corpus_pipeline.STAGES:
            left = written(stage(spark, left, FOLDER), name)
        assert left.isEmpty() == rows.isEmpty()
