"""Removal of repeated lines, exact and within one word edit, over a whole corpus.

The order of lines is (document id, hash of the text, line number); a line goes if an earlier line
anywhere is equal to it, or is within ``max_edits`` = 1 inserted, deleted or replaced word and both
have at least ``min_words`` words. Earlier lines count whether or not they stay themselves.

Near lines are found by a deletion-neighbourhood join: every variant of a line with one word left
out is a hashed key, and lines that have a key in common meet.

* Lines that agree in variant and place of the missing word differ in that word only: all lines of
  such a key are within the bound of each other, so the earliest is enough and no pairs are listed.
* A variant that is itself a line is within the bound of all lines it is a variant of; only the
  earliest of them and the line itself are compared.

Variants are only made for lines that share three of their four quarters with another line; of two
lines within one edit, three quarters are untouched. That test loses nothing and leaves most lines
out. Every pair found by hashes is compared word by word before a line goes.

Texts move for the documents that need it only: those with such lines, and those that lose lines. A
bit map of fixed size over hashes, small enough for every task, leaves the others out before the
shuffle; a bit set by chance costs a moved text and changes no result.

Defined cases: white space between words does not count; blank lines always stay; a null text stays
null, an empty one empty; a document may be left with an empty text and stays a row; a null id sorts
last; rows repeated with equal id and text keep the same lines; an empty table gives an empty
result; other columns are kept, whatever their names are.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .shared import bit_map, with_bit, written

LINES = "k1 long, k2 long, id long, h long, line int, quarters array<long>"
_LAST = (1 << 63) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _quarters(words: list[str]) -> list[int]:
    """Keys of the line without one quarter; lines within one edit have one of them in common.

    The quarters before the missing one are counted from the left and those behind it from the
    right. The size of a quarter follows the shorter line, so both sizes are keys of the longer.
    """
    import xxhash

    n, out = len(words), set()
    for q in {n // 4, (n - 1) // 4}:
        for j in range(4):
            rest = words[: j * q] + ["\n"] + words[n - (3 - j) * q :]
            out.add(_signed(xxhash.xxh3_64_intdigest(f"{q} {j} " + " ".join(rest))))
    return list(out)


def _sliced(batches, most: int = 1_000):
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def _line_rows(min_words: int):
    import xxhash

    def rows(batches):
        for batch in _sliced(batches):
            columns: list[list] = [[] for _ in range(6)]
            k1, k2, ids, hs, nos, quarters = columns
            for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text"))):
                for no, line in enumerate((text or "").split("\n")):
                    words = line.split()
                    if not words:
                        continue
                    key = xxhash.xxh3_128_intdigest(" ".join(words))
                    k1.append(_signed(key >> 64))
                    k2.append(_signed(key & (1 << 64) - 1))
                    ids.append(doc)
                    hs.append(h)
                    nos.append(no)
                    quarters.append(_quarters(words) if len(words) >= min_words else [])
            types = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types)],
                names=["k1", "k2", "id", "h", "line", "quarters"],
            )

    return rows


def _candidate_lines(batches):
    """Words of the asked lines of each document."""
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for doc, h, text, asked in zip(
            *(batch.column(c).to_pylist() for c in ("id", "h", "text", "asked"))
        ):
            lines = text.split("\n")
            for no in set(asked):
                for column, value in zip(out, (doc, h, no, " ".join(lines[no].split()))):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(out, types)], names=["id", "h", "line", "norm"]
        )


def _variants(batches):
    """(key, place) of each line with one word left out, and of the line itself (place -1)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in _sliced(batches):
        at, keys, places = [], [], []
        for n, line in enumerate(batch.column("norm").to_pylist()):
            words = line.split(" ")
            at.extend([n] * (len(words) + 1))
            keys.append(_signed(digest(line)))
            places.extend(range(-1, len(words)))
            start = 0
            for i, word in enumerate(words):
                stop = start + len(word) + 1
                rest = line[:start] + line[stop:] if i < len(words) - 1 else line[: max(0, start - 1)]
                keys.append(_signed(digest(rest)))
                start = stop
        at = pa.array(at, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(at) for c in ("id", "h", "line")),
                pa.array(keys, type=pa.int64()),
                pa.array(places, type=pa.int32()),
            ],
            names=["id", "h", "line", "key", "place"],
        )


def one_edit_apart(a: str, b: str) -> bool:
    """Whether at most one word is inserted, deleted or replaced between two lines."""
    a, b = a.split(" "), b.split(" ")
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


@F.pandas_udf(BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit_apart(x, y) for x, y in zip(a, b)], dtype=bool)


def _rebuilt(text_at: str, gone_at: str, counts_at: str):
    def rebuild(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            left, removed = [], []
            for text, lines in zip(texts, batch.column(gone_at).to_pylist()):
                if lines:
                    out = set(lines)
                    text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in out)
                    removed.append(len(out))
                else:
                    removed.append(0)
                left.append(text)
            columns = []
            for name in batch.schema.names:
                if name == text_at:
                    columns.append(pa.array(left, type=pa.string()))
                elif name == gone_at:
                    columns.append(pa.array(removed, type=pa.int32()))
                else:
                    columns.append(batch.column(name))
            names = [counts_at if n == gone_at else n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rebuild


def near_removed(first: DataFrame, keyed: DataFrame, bits: int) -> DataFrame:
    """(id, h, line) of the distinct lines ``first`` that have an earlier line within one edit.

    ``first``: first (struct id, h, line), quarters. ``keyed``: the documents (id, h, text).
    """
    quarters = first.where(F.size("quarters") > 0).select(
        F.col("first.*"), F.explode("quarters").alias("quarter")
    )
    # A line has a key once, so two rows are two lines.
    shared = quarters.groupBy("quarter").agg(F.count("*").alias("n")).where("n > 1").select("quarter")
    shared = written(shared, "shared-quarters")
    asked = (
        with_bit(quarters, "quarter", written(bit_map(shared, "quarter", bits), "bits"), bits)
        .where("_may").drop("_may")
        .join(shared, "quarter", "left_semi")
        .groupBy("id", "h")
        .agg(F.collect_set("line").alias("asked"))
    )
    asked = written(asked, "asked-lines")
    lines = written(
        with_bit(keyed, "h", written(bit_map(asked, "h", bits), "bits"), bits)
        .where("_may").drop("_may")
        .join(asked, ["id", "h"])
        .mapInArrow(_candidate_lines, "id long, h long, line int, norm string"),
        "candidate-lines",
    )
    order = F.struct("id", "h", "line")
    variants = written(
        lines.mapInArrow(_variants, "id long, h long, line int, key long, place int"), "variants"
    ).select("key", "place", order.alias("at"))
    shorter = variants.where("place >= 0")
    # One word replaced: same variant, same place.
    same_place = shorter.groupBy("key", "place").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    replaced = (
        shorter.join(same_place.where("low <> high").select("key", "place", "low"), ["key", "place"])
        .where("at > low")
        .select("at", "low")
    )
    # One word more: a variant that is a line itself.
    itself = variants.where("place = -1").select("key", F.col("at").alias("self"))
    met = shorter.join(itself, "key").where("at <> self").select("at", "self")
    longer_late = met.where("at > self").select("at", F.col("self").alias("low"))
    self_late = (
        met.where("at < self").groupBy("self").agg(F.min("at").alias("low"))
        .select(F.col("self").alias("at"), "low")
    )
    pairs = replaced.union(longer_late).union(self_late).groupBy("at", "low").agg(F.count("*").alias("n"))
    norm = lines.select(order.alias("at"), "norm").dropDuplicates(["at"])
    return (
        pairs.join(norm, "at")
        .join(norm.select(F.col("at").alias("low"), F.col("norm").alias("other")), "low")
        .where(_verified("norm", "other"))
        .select("at.*")
        .distinct()
    )


def dedup_lines(
    docs: DataFrame,
    min_words: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str = "lines_removed",
    bits: int = 1 << 22,
) -> DataFrame:
    """All columns of ``docs``, the text without repeated lines, and ``removed_col``, their number.

    A column that is called ``removed_col`` already is replaced. ``bits``: size of the bit maps.
    """
    if removed_col in docs.columns:
        docs = docs.drop(removed_col)
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    h = F.xxhash64(F.col(text_col))
    keyed = docs.select(id_.alias("id"), h.alias("h"), F.col(text_col).cast("string").alias("text"))
    lines = written(keyed.mapInArrow(_line_rows(min_words), LINES), "lines")
    at = F.struct("id", "h", "line")
    first = written(
        lines.groupBy("k1", "k2").agg(
            F.min(at).alias("first"), F.max(at).alias("last"), F.first("quarters").alias("quarters")
        ),
        "distinct-lines",
    )
    near = near_removed(first, keyed, bits).withColumn("gone", F.lit(True))
    flagged = (
        first.select("k1", "k2", "first", F.col("first.*"), (F.col("first") != F.col("last")).alias("again"))
        .join(near, ["id", "h", "line"], "left")
        .where("again OR gone")
        .select("k1", "k2", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    )
    gone = (
        lines.select("k1", "k2", "id", "h", "line")
        .join(flagged, ["k1", "k2"])
        .where(F.col("gone") | (at != F.col("first")))
        .groupBy("id", "h")
        .agg(F.collect_set("line").alias("gone"))
    )
    gone = written(gone, "gone-lines")
    names = [f"c{n}" for n in range(len(docs.columns))]
    text_at = names[docs.columns.index(text_col)]
    id_at = names[docs.columns.index(id_col)]
    wide = with_bit(
        docs.toDF(*names).withColumns(
            {"id": F.coalesce(F.col(id_at).cast("long"), F.lit(_LAST)), "h": F.xxhash64(text_at)}
        ),
        "h", written(bit_map(gone, "h", bits), "bits"), bits,
    )
    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, docs.columns)]
    changed = (
        wide.where("_may").join(gone, ["id", "h"], "left").select(*names, "gone")
        .mapInArrow(_rebuilt(text_at, "gone", "n"), ", ".join(fields) + ", n int")
    )
    same = wide.where("NOT _may").select(*names, F.lit(0).alias("n"))
    return changed.union(same).toDF(*docs.columns, removed_col)
