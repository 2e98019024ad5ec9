"""Quality rules judged by host: document rules, failure rates by host, verdicts back on documents.

Every document gets counts of its words, symbols, repeated lines and repeated word windows, and fails
the base rules if it is short or mostly repetition. The failures are aggregated by host. A host of few
documents says little about itself, so its rate is shrunk towards all hosts: the rates are taken as
draws from a beta distribution that is fitted to the hosts by moments (the share of variance between
hosts beyond that of binomial draws, weighted by documents), and the posterior mean

    (failures + mean * strength) / (documents + strength)

is held against ``max_rate``. All documents of a host above it go, also those that pass by themselves.

Texts are read once and never move; what is aggregated is a few numbers a document, summed before the
shuffle, so a host of any size is one row. Only rejected hosts travel back. They are broadcast if their
measured bytes are within ``broadcast_bytes``; else the join is a shuffle in which every document has
one of ``salts`` numbers and every rejected host has all of them, so no host is one task.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows and
null ids count each; with one host only, or if no or all documents fail, nothing is known about the
spread and the strength is ``max_strength``; an empty table gives an empty result; the text may have any
length (one text must fit a task); other columns are left behind, whatever their names are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) >= 1 << 20:
        # Three numbers do not fit 64 bits: pairs are numbered first.
        _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * len(index) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    covered = np.zeros(len(words), dtype=bool)
    found = np.concatenate([order[1:][same], order[:-1][same]])
    for shift in range(3):
        covered[found + shift] = True
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def _count_rows(batches):
    for batch in sliced(batches):
        counts = [text_counts(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, type=pa.int64()) for c in zip(*counts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *columns], names=["doc_id", "host", *_COUNTS]
        )


def rule_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """doc_id, host and the five counts of every document."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(_count_rows, schema)


def base_failed(min_words: int, max_repeat_percent: int):
    """Whether the counts of a document fail by themselves."""
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )


def beta_prior(hosts: DataFrame, min_strength: float = 2.0, max_strength: float = 10_000.0) -> tuple[float, float]:
    """Mean and strength (the two parameters' sum) of the rates of ``hosts`` (host_docs, host_failures)."""
    docs, failures = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    k, n, f, n2, spread = hosts.agg(
        F.count("*"), F.sum(docs), F.sum(failures), F.sum(docs * docs), F.sum(failures * failures / docs)
    ).first()
    if not k:
        return 0.0, max_strength
    mean = f / n
    binomial = mean * (1 - mean)
    room = binomial * (n - n2 / n - (k - 1))
    if room <= 0:
        return mean, max_strength
    shared = (spread - n * mean * mean - binomial * (k - 1)) / room
    if shared <= 0:
        return mean, max_strength
    return mean, min(max((1 - shared) / shared, min_strength), max_strength)


def host_verdicts(counts: DataFrame, failed, max_rate: float) -> DataFrame:
    """host, host_docs, host_failures, host_rate (shrunk), host_rejected; one row a host."""
    hosts = written(
        counts.groupBy("host").agg(
            F.count("*").alias("host_docs"), F.sum(failed.cast("long")).alias("host_failures")
        ),
        "hosts",
    )
    mean, strength = beta_prior(hosts)
    rate = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate)


def join_rejected(
    counts: DataFrame, hosts: DataFrame, broadcast_bytes: int = 32 << 20, salts: int = 64
) -> DataFrame:
    """``counts`` with host_rejected."""
    bad = hosts.where("host_rejected").select(F.col("host").alias("_host"))
    weight = bad.agg(F.sum(F.coalesce(F.octet_length("_host"), F.lit(0)) + 16)).first()[0] or 0
    same = F.col("host").eqNullSafe(F.col("_host"))
    bad = bad.withColumn("_bad", F.lit(True))
    if weight <= broadcast_bytes:
        joined = counts.join(F.broadcast(bad), same, "left")
    else:
        salted = counts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        every = bad.withColumn("_every", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(every, same & (F.col("_salt") == F.col("_every")), "left")
    return joined.select(*counts.columns, F.col("_bad").isNotNull().alias("host_rejected"))


def judged_documents(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_rate: float = 0.5,
    broadcast_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rejected and kept of every document.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most
    ``max_rate``.
    """
    counts = written(rule_counts(docs, id_col, text_col, host_col), "rule-counts")
    failed = base_failed(min_words, max_repeat_percent)
    hosts = host_verdicts(counts, failed, max_rate)
    return (
        join_rejected(counts, hosts, broadcast_bytes)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )
