"""Benchmark passages in documents, by latent semantic retrieval and word-level verification.

1. Benchmark items are cut into passages. Their words are the terms; the document frequency of
   every term is counted over all documents.
2. A randomised singular value decomposition of the TF-IDF matrix of the passages (a term counts once
   in a passage, so frequent words stay light), computed from
   partial products of the rows in each partition, gives the latent space. It has at least as
   many dimensions as there are passages, so it keeps all their angles.
3. Every window of a document is projected into it and compared with every passage: its part along
   the passage, as a share of the passage's squared length, is what the window holds of it. Other
   words of the window do not lessen it, and no term has weight 0, so a copy in any number of
   documents holds all of its passage. A window whose terms hold too little of the weight of any
   passage is not projected.
4. Candidates are verified: the longest common subsequence of words between the item, or the passage
   of it that was found, and the document around the window decides; the larger coverage counts. An
   excerpt of a long item is so found from about a passage's length on, however long the item is. From ``copied`` on it is a copy; from ``paraphrased`` on it
   is one if the answer, the words of the item's last sentence, is in the document too.

A benchmark of any size is taken in blocks of whole items, of about ``block_passages`` passages each.
Texts are split once per block; the numbers of their terms are written, for the counts and for the
searches. The searches take about ``rank`` passages of a block each, in a latent space of their own, so
what is sent to the tasks is bounded and the result does not depend on the number of items.

Defined cases: letters' case, signs and white space do not count; a null or empty text is clean; an
item without words matches nothing; repeated and null ids of documents are answered each; of
repeated items each is compared; ties go to the smallest item id; an empty benchmark leaves all
documents clean; an empty table gives an empty result; other columns are ignored, whatever their
names are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, parts_for, written

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
FOUND = "array<struct<item:long,coverage:double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def passages_of(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item_id, text, words (of one passage), answer (words of the last sentence)."""

    def cut(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for item, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                words = words_of(text)
                if not words:
                    continue
                last = [s for s in SENTENCE.split(text) if words_of(s)][-1]
                # The last passage ends with the item, so all passages of a long item have full length.
                last_at = max(0, len(words) - size)
                for at in sorted({*range(0, last_at, size // 2), last_at}):
                    for column, value in zip(
                        columns, (item, words, words[at : at + size], words_of(last))
                    ):
                        column.append(value)
            types = [pa.int64()] + [pa.list_(pa.string())] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types)],
                names=["item_id", "item_words", "words", "answer"],
            )

    schema = "item_id long, item_words array<string>, words array<string>, answer array<string>"
    return id_and_text(benchmark, id_col, text_col).mapInArrow(cut, schema)


def term_numbers(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, h, ids: the number of every word of the text among ``terms``, or -1 (packed int32)."""

    def number(batches):
        for batch in batches:
            packed = []
            for text in batch.column("text").to_pylist():
                ids = map(terms.get, words_of(text), repeat(-1))
                packed.append(np.fromiter(ids, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(packed, type=pa.binary())],
                names=["doc_id", "h", "ids"],
            )

    return docs.mapInArrow(number, "doc_id long, h long, ids binary")


def document_frequencies(numbers: DataFrame, terms: int) -> np.ndarray:
    """Number of documents that hold each term."""

    def count(batches):
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("ids"):
                ids = np.frombuffer(packed.as_buffer(), dtype=np.int32)
                total[np.unique(ids[ids >= 0])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[some])], names=["term", "n"]
        )

    out = np.zeros(terms, dtype=np.int64)
    rows = numbers.select("ids").mapInArrow(count, "term long, n long")
    for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def randomized_svd(
    rows: DataFrame, terms: dict[str, int], idf: np.ndarray, rank: int, power: int = 2, seed: int = 5
) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix whose rows are ``words``.

    Each round multiplies the present basis by A'A: every partition adds up the products of its own
    rows, the sums of equal chunks of terms are added in Spark, and the driver orthogonalises the
    result, whose size is bounded by the terms of a block.
    """
    context = rows.sparkSession.sparkContext
    rank = min(rank, len(terms))
    basis = np.random.default_rng(seed).standard_normal((len(terms), rank))
    chunk = 512
    for _ in range(power + 1):
        sent = context.broadcast(np.linalg.qr(basis)[0])

        def product(batches, sent=sent):
            q = sent.value
            total = np.zeros_like(q)
            for batch in batches:
                for words in batch.column("words").to_pylist():
                    ids = np.unique([terms[w] for w in words])
                    a = idf[ids] / (np.linalg.norm(idf[ids]) + 1e-12)
                    total[ids] += np.outer(a, a @ q[ids])
            starts = range(0, len(q), chunk)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(range(len(starts))), type=pa.int64()),
                    pa.array([total[s : s + chunk].tobytes() for s in starts], type=pa.binary()),
                ],
                names=["chunk", "data"],
            )

        def added(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in frame["data"])
            return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "data": [total.tobytes()]})

        parts = (
            rows.select("words").mapInArrow(product, "chunk long, data binary")
            .groupBy("chunk").applyInPandas(added, "chunk long, data binary").collect()
        )
        data = b"".join(r["data"] for r in sorted(parts, key=lambda r: r["chunk"]))
        basis = np.frombuffer(data).reshape(len(terms), rank)
        sent.destroy()
    left, values, _ = np.linalg.svd(basis, full_matrices=False)
    # Directions without weight would only hold rounding errors.
    return left[:, values > 1e-9 * max(values[0], 1e-300)]


@dataclass
class Index:
    idf: np.ndarray
    latent: np.ndarray  # terms x dimensions
    passages: np.ndarray  # passages x dimensions, divided by their squared length
    items: list[tuple[int | None, list[int], list[int]]]  # item id, words, answer words
    item_of: np.ndarray  # passage -> position in items
    words_of: list[list[int]]  # of each passage, empty if it is the whole item
    share: np.ndarray  # of each term: the largest part of a passage's squared length


def build_index(
    block: list, rows: DataFrame, terms: dict[str, int], frequency: np.ndarray, total: int, rank: int
) -> Index:
    idf = np.log((total + 1) / (frequency + 1)) + 0.01
    latent = randomized_svd(rows, terms, idf, rank).astype(np.float32)
    items: dict[tuple, int] = {}
    vectors, item_of, parts, share = [], [], [], np.zeros(len(terms))
    for r in block:
        numbered = [tuple(terms[w] for w in r[c]) for c in ("item_words", "answer")]
        item_of.append(items.setdefault((r["item_id"], *numbered), len(items)))
        parts.append([terms[w] for w in r["words"]] if len(r["words"]) < len(numbered[0]) else [])
        ids = np.unique([terms[w] for w in r["words"]])
        a = idf[ids]
        share[ids] = np.maximum(share[ids], a * a / (a @ a + 1e-12))
        vectors.append(a @ latent[ids] / (a @ a))
    return Index(
        idf, latent, np.array(vectors, dtype=np.float32),
        [(i, list(w), list(a)) for i, w, a in items], np.array(item_of), parts, share,
    )


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit per word of ``a``."""
    places: dict = {}
    for n, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << n
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def search_text(
    index: Index, ids: np.ndarray, window: int, stride: int, near: float,
    copied: float, paraphrased: float, answered: float,
) -> dict[int, float]:
    """Item position to coverage of the items found in a text.

    A window is some neighbouring blocks of ``stride`` words; its vector is the sum of theirs. Its
    candidates are the passages of which it holds ``near`` squared of the squared length, as every
    window of a cosine of ``near`` does.
    """
    hits = np.flatnonzero(ids >= 0)
    hits = hits[index.share[ids[hits]] > 0]
    if not len(hits):
        return {}
    terms = ids[hits]
    blocks, first = np.unique(hits // stride, return_index=True)
    wide = -(-window // stride)
    # A window begins at each block with a hit and ends before the block ``wide`` further on.
    stops = np.searchsorted(blocks, blocks + wide)

    def in_windows(of_hits: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(blocks) + 1, *of_hits.shape[1:]))
        np.cumsum(np.add.reduceat(of_hits, first, axis=0), axis=0, out=sums[1:])
        return sums[stops] - sums[:-1]

    heavy = np.flatnonzero(in_windows(index.share[terms]) >= near * near)
    if not len(heavy):
        return {}
    weights = index.idf[terms].astype(np.float32)
    vectors = in_windows(index.latent[terms] * weights[:, None])[heavy].astype(np.float32)
    held = vectors @ index.passages.T
    best: dict[int, float] = {}
    least = min(copied, paraphrased)
    for k, passage in zip(*np.nonzero(held >= near * near - 1e-3)):
        item = int(index.item_of[passage])
        _, item_words, answer = index.items[item]
        start = int(blocks[heavy[k]]) * stride
        share = None  # of the answer, in the reach of the whole item
        for words in (item_words, index.words_of[passage]):
            reach = len(words)
            around = ids[max(0, start - reach) : start + window + reach].tolist()
            present = set(around)
            if share is None:
                share = sum(w in present for w in answer) / len(answer)
            # No subsequence is longer than the words that are there at all.
            if not words or sum(map(present.__contains__, words)) < least * len(words):
                continue
            coverage = common_subsequence(words, around) / len(words)
            if coverage >= copied or coverage >= paraphrased and share >= answered:
                best[item] = max(best.get(item, 0.0), coverage)
    return best


def found_items(
    docs: DataFrame,
    benchmark: DataFrame,
    copied: float = 0.6,
    paraphrased: float = 0.45,
    answered: float = 0.7,
    window: int = 64,
    stride: int = 16,
    near: float = 0.5,
    rank: int = 256,
    block_passages: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """doc_id, h (hash of the text) and found, the items in it with their coverage, of every document."""
    docs = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    passages = written(passages_of(benchmark, item_col, text_col, window), "passages")
    blocks = parts_for(passages.count(), block_passages)
    # All passages of an item are in one block, so its words all have numbers there.
    key = F.xxhash64("item_id", F.concat_ws(" ", "item_words"))

    def searcher(index):
        def search(batches):
            at = index.value
            for batch in batches:
                found = []
                for packed in batch.column("ids"):
                    ids = np.frombuffer(packed.as_buffer(), dtype=np.int32)
                    found.append(
                        [
                            {"item": at.items[item][0], "coverage": coverage}
                            for item, coverage in search_text(
                                at, ids, window, stride, near, copied, paraphrased, answered
                            ).items()
                        ]
                    )
                shape = pa.list_(pa.struct([("item", pa.int64()), ("coverage", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), pa.array(found, type=shape)],
                    names=["doc_id", "h", "found"],
                )

        return search

    results = []
    for block in range(blocks):
        rows = passages.where(F.pmod(key, F.lit(blocks)) == block)
        held = rows.collect()
        terms = {w: n for n, w in enumerate(sorted({w for r in held for w in r["words"]}))}
        if not terms:
            continue
        numbers = written(term_numbers(docs, terms), "term-numbers")
        frequency = document_frequencies(numbers, len(terms))
        total = numbers.count()
        searches = parts_for(len(held), rank)
        of_search = F.pmod(F.xxhash64(key, F.concat_ws(" ", "words")), F.lit(searches))
        for part in range(searches):
            chosen = rows.where(of_search == part)
            sought = chosen.collect()
            if not sought:
                continue
            # A part that came out larger gets the dimensions that keep its angles.
            index = build_index(sought, chosen, terms, frequency, total, max(rank, len(sought)))
            index = docs.sparkSession.sparkContext.broadcast(index)
            results.append(numbers.mapInArrow(searcher(index), f"doc_id long, h long, found {FOUND}"))
    result = docs.select("doc_id", "h", F.array().cast(FOUND).alias("found"))
    if len(results) == 1:
        result = results[0]
    elif results:
        # Rows of equal id and text have equal results, so these two find them again.
        some = results[0]
        for more in results[1:]:
            some = some.union(more)
        some = (
            some.where(F.size("found") > 0)
            .select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "h", F.explode("found").alias("x"))
            .groupBy("id", "h").agg(F.collect_set("x").alias("more"))
        )
        result = (
            result.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
            .join(some, ["id", "h"], "left")
            .select("doc_id", "h", F.coalesce("more", "found").alias("found"))
        )
    return result.select("doc_id", "h", "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_id (the best covered item), coverage, n_items of every document."""
    best = F.array_min(
        F.transform("found", lambda x: F.struct((-x["coverage"]).alias("c"), x["item"].alias("item")))
    )
    return found_items(docs, benchmark, **options).select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        best["item"].alias("item_id"),
        (-best["c"]).alias("coverage"),
        F.size(F.array_distinct(F.transform("found", lambda x: x["item"]))).alias("n_items"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns."""
    bad = (
        found_items(docs, benchmark, id_col=id_col, text_col=text_col, **options)
        .where(F.size("found") > 0).select(F.col("doc_id").alias("_bad_id"), F.col("h").alias("_bad_h"))
    )
    bad = written(bad.distinct(), "contaminated")
    same = docs[id_col].cast("long").eqNullSafe(F.col("_bad_id")) & (
        F.xxhash64(docs[text_col].cast("string")) == F.col("_bad_h")
    )
    return docs.join(bad, same, "left_anti")
