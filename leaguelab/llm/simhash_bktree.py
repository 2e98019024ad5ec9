"""Near-duplicate documents: SimHash fingerprints, linked through BK-trees.

A BK-tree keys the children of a node by their Hamming distance to it. A search within radius r
that finds a node at distance d has to follow the edges d - r to d + r only.

One tree over all fingerprints has no size bound, so it is never built or sent. Fingerprints are
dealt to shards in such a way that all links lie within shards, and each shard has its own tree,
which all fingerprints of the shard search:

* ``band_links`` (small radius, exact): of radius + 1 disjoint bit bands two linked fingerprints
  agree in one, so a shard is one value of one band. A shard of more than ``shard_rows``
  fingerprints is dealt again over bands of its other bits, and these once more; a shard of the last
  level has few free bits and so a fixed greatest size.
* ``sketch_links`` (wide radius): a shard is one smallest shingle hash out of several independent
  ones. Two documents of similarity s miss all k shards with probability (1 - s)^k. A shard of more
  than ``shard_rows`` rows is cut into blocks, and every two blocks meet.
  ``similar_links`` takes these only as candidates: a link needs a Jaccard similarity of the shingle
  sets of ``least`` or more. Blocks are linked by themselves first; shards that are one component
  then are done, so only the others have their blocks meet.

Equal fingerprints are one row before any of this. A shard gives a spanning forest of its links,
never its pairs.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; repeated and null ids are documents of their own (a null id is
never the smallest of its group unless all are null); an empty table gives an empty result; other
columns are ignored, whatever their names are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import id_and_text, parts_for, written

SEED = 42
# Odd multipliers that turn one shingle hash into independent ones (fixed values).
MULTIPLIERS = [
    0x9E3779B97F4A7C15,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words; A-Z lower-cased, split at ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit set where it is set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame,
    width: int,
    sketch: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, if asked, sketch: smallest shingle hashes."""
    multipliers = np.array(MULTIPLIERS, dtype=np.uint64)

    def make(batches):
        for batch in batches:
            prints, sketches = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", width)
                value = fingerprint_of(hashes)
                prints.append(value - (1 << 64) if value >> 63 else value)
                if sketch:
                    low = [(hashes * m).min() if len(hashes) else np.uint64(0) for m in multipliers]
                    sketches.append(np.array(low, dtype=np.uint64).view(np.int64))
            columns = [batch.column("doc_id"), pa.array(prints, type=pa.int64())]
            names = ["doc_id", "fp"]
            if sketch:
                columns.append(pa.array(sketches, type=pa.list_(pa.int64())))
                names.append("sketch")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, fp long" + (", sketch array<long>" if sketch else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(make, schema)


class BKTree:
    """Built by levels from an array of distinct values; searched by many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.point: list[int] = []
        self.children: list[list[tuple[int, int]]] = []
        waiting = [(np.arange(len(values)), None, 0)] if len(values) else []
        while waiting:
            members, parent, edge = waiting.pop()
            node = len(self.point)
            self.point.append(int(members[0]))
            self.children.append([])
            if parent is not None:
                self.children[parent].append((edge, node))
            rest = members[1:]
            if len(rest):
                distance = np.bitwise_count(values[rest] ^ values[members[0]])
                order = np.argsort(distance, kind="stable")
                rest, distance = rest[order], distance[order]
                cuts = np.flatnonzero(np.diff(distance)) + 1
                for group, d in zip(np.split(rest, cuts), distance[np.r_[0, cuts]]):
                    waiting.append((group, node, int(d)))

    def within(self, queries: np.ndarray, radius: int):
        """(position of a value, positions of the queries within ``radius`` of it)."""
        waiting = [(0, np.arange(len(queries)))] if self.point else []
        while waiting:
            node, active = waiting.pop()
            distance = np.bitwise_count(queries[active] ^ self.values[self.point[node]])
            distance = distance.astype(np.int16)
            yield self.point[node], active[distance <= radius]
            for edge, child in self.children[node]:
                near = active[np.abs(distance - edge) <= radius]
                if len(near):
                    waiting.append((child, near))


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (position, position of the root) that span the links between ``values``."""
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at, near in BKTree(values).within(values, radius):
        for other in near.tolist():
            a, b = find(at), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(n, find(n)) for n in range(len(values)) if find(n) != n]


def _link_shards(rows: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """Links (a, b) of rows (shard: long, fp), by shard; many small shards share a task."""
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["shard", "fp"])
        fps, shard = frame["fp"].to_numpy(), frame["shard"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
        a, b = [], []
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop - start > 1:
                values = fps[start:stop]
                for x, y in _forest(values.view(np.uint64), radius):
                    a.append(values[x])
                    b.append(values[y])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    parts = parts_for(rows.count(), 4 * shard_rows)
    return (
        rows.withColumn("_task", F.pmod(F.xxhash64("shard"), F.lit(parts)))
        .groupBy("_task")
        .applyInPandas(link, "a long, b long")
    )


def _masks(radius: int, levels: int) -> list[list[int]]:
    """By level, the bit masks of the shard keys; key k is refined by the keys (radius + 1) k and
    the next ``radius`` ones of the next level."""
    found, frontier = [], [0]
    for _ in range(levels):
        masks = []
        for mask in frontier:
            free = [x for x in range(64) if not mask >> x & 1]
            for part in np.array_split(free, radius + 1):
                masks.append(mask | sum(1 << int(x) for x in part))
        found.append(masks)
        frontier = masks
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def band_links(fps: DataFrame, radius: int, shard_rows: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` (distinct) within ``radius`` bits."""
    levels = _masks(radius, 3)
    rows, links = fps.select("fp"), None
    key = F.lit(0)
    for level, masks in enumerate(levels):
        table = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
        fan = F.sequence(key * (radius + 1), key * (radius + 1) + radius)
        dealt = rows.select("fp", F.explode(fan).alias("key")).select(
            "fp", "key", F.col("fp").bitwiseAND(F.element_at(table, F.col("key") + 1)).alias("value")
        )
        dealt = written(dealt, "bands")
        counts = dealt.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1")
        last = level == len(levels) - 1
        small = counts if last else counts.where(F.col("n") <= shard_rows)
        shard = F.xxhash64("key", "value").alias("shard")
        found = _link_shards(
            written(dealt.join(small, ["key", "value"]).select(shard, "fp"), "shards"),
            radius, shard_rows,
        )
        links = found if links is None else links.union(found)
        if last:
            break
        large = dealt.join(counts.where(F.col("n") > shard_rows), ["key", "value"])
        rows = written(large.select("fp", "key"), "large-shards")
        if rows.isEmpty():
            break
        key = F.col("key")
    return links


def sketch_links(rows: DataFrame, radius: int, shard_rows: int = 4096) -> DataFrame:
    """Edges (a, b) between fingerprints within ``radius`` bits that share a smallest hash.

    ``rows``: fp, sketch. Hot shards are cut into blocks; every two of them meet.
    """
    sized = _blocks(_sketch_shards(rows.select("fp", F.col("fp").alias("node"), "sketch")), shard_rows)
    cells = written(_meeting(sized), "sketch-blocks")
    return _link_shards(cells.select(F.col("cell").alias("shard"), "fp"), radius, 2 * shard_rows)


def _sketch_shards(rows: DataFrame) -> DataFrame:
    """shard, node, fp of the rows (node, fp, sketch), once for each smallest hash."""
    return written(
        rows.select("node", "fp", F.posexplode("sketch").alias("n", "low"))
        .select(F.xxhash64("n", "low").alias("shard"), "node", "fp").distinct(),
        "sketch-shards",
    )


def _blocks(shards: DataFrame, shard_rows: int) -> DataFrame:
    """``shards`` of more than one row, with blocks (of about ``shard_rows``) and block."""
    counts = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / shard_rows).cast("long")
    return shards.join(counts.select("shard", blocks.alias("blocks")), "shard").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks"))
    )


def _meeting(sized: DataFrame) -> DataFrame:
    """cell, node, fp: one cell for every two blocks of a shard, or for its only block."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return (
        sized.select("shard", "node", "fp", "blocks", "block", other)
        .where("blocks = 1 OR block <> other")
        .select(F.xxhash64("shard", low, high).alias("cell"), "node", "fp")
    )


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more; empty sets are equal."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (small + large - common)


def _in_tasks(cells: DataFrame, work, schema: str, parts: int) -> DataFrame:
    """``work`` on frames of whole cells, dealt to ``parts`` groups."""
    return (
        cells.withColumn("_task", F.pmod(F.xxhash64("cell"), F.lit(parts)))
        .groupBy("_task").applyInPandas(work, schema)
    )


def _cells_of(frame: pd.DataFrame):
    frame = frame.sort_values(["cell", "node"], ignore_index=True)
    cell = frame["cell"].to_numpy()
    cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
    for start, stop in zip(cuts[:-1], cuts[1:]):
        if stop - start > 1:
            yield frame.iloc[start:stop]


def _verified(
    cells: DataFrame, texts: DataFrame, width: int, radius: int, least: float, shard_rows: int
) -> DataFrame:
    """Links (a, b) between nodes of a cell within ``radius`` bits and of similarity ``least``."""

    def candidates(frame: pd.DataFrame) -> pd.DataFrame:
        out = [frame.iloc[:0][["cell", "node", "fp"]]]
        for part in _cells_of(frame):
            values = part["fp"].to_numpy().view(np.uint64)
            some = np.zeros(len(values), dtype=bool)
            for at, near in BKTree(values).within(values, radius):
                some[at] |= len(near) > 1
            out.append(part[some][["cell", "node", "fp"]])
        return pd.concat(out)

    def shingled(batches):
        for batch in batches:
            sets = [
                np.unique(shingle_hashes(t or b"", width)).tobytes()
                for t in batch.column("text").cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, type=pa.binary())], names=["node", "shingles"]
            )

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for part in _cells_of(frame):
            nodes, values = part["node"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
            label = np.arange(len(nodes))
            for at, near in BKTree(values).within(values, radius):
                # Each pair once, and none within a component.
                near = near[(near > at) & (label[near] != label[at])]
                while len(near):
                    other, near = near[0], near[1:]
                    if _similar(sets[at], sets[other], least):
                        a.append(nodes[at])
                        b.append(nodes[other])
                        label[label == label[other]] = label[at]
                        near = near[label[near] != label[at]]
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    parts = parts_for(cells.count(), 4 * shard_rows)
    found = written(_in_tasks(cells, candidates, "cell long, node long, fp long", parts), "candidates")
    # One text of each node, before any join: copies never meet in a task.
    once = texts.groupBy("node").agg(F.first("text").alias("text"))
    wanted = once.join(found.select("node").distinct(), "node", "left_semi")
    sets = wanted.mapInArrow(shingled, "node long, shingles binary")
    parts = parts_for(found.count(), shard_rows)
    return written(_in_tasks(found.join(sets, "node"), link, "a long, b long", parts), "similar-links")


def similar_links(
    prints: DataFrame, texts: DataFrame, width: int, radius: int, least: float = 0.8,
    shard_rows: int = 4096,
) -> DataFrame:
    """Edges (a, b) between nodes of shingle similarity ``least`` that share a smallest hash.

    ``prints``: node, fp, sketch (distinct); ``texts``: node, text.
    """
    sized = written(_blocks(_sketch_shards(prints), shard_rows), "sketch-blocks")
    own = sized.select(F.xxhash64("shard", "block", "block").alias("cell"), "node", "fp")
    links = _verified(written(own, "cells"), texts, width, radius, least, shard_rows)
    hot = sized.where("blocks > 1")
    if hot.isEmpty():
        return links
    # The first blocks of the hot shards join the components of the others.
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("block")
    joined = hot.where("block <> 0").select("shard", "block", "node", "fp").union(
        hot.where("block = 0").select("shard", first, "node", "fp")
    ).select(F.xxhash64("shard", F.lit(0).cast("long"), "block").alias("cell"), "node", "fp")
    links = links.union(_verified(written(joined, "cells"), texts, width, radius, least, shard_rows))
    roots = connected_components(links)
    rooted = hot.join(roots, "node", "left").select("shard", F.coalesce("root", "node").alias("root"))
    open_shards = rooted.groupBy("shard").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    left = hot.join(open_shards.where("a <> b").select("shard"), "shard", "left_semi")
    left = written(_meeting(left.where("blocks > 2 AND block <> 0")), "cells")
    if left.isEmpty():
        return links
    return links.union(_verified(left, texts, width, radius, least, shard_rows))


def _similar_texts(texts: DataFrame, width: int, radius: int) -> DataFrame:
    """Edges between the texts (node, text), by the hash of the text."""
    prints = fingerprints(texts, width, True, "node", "text").distinct()
    prints = written(prints.withColumnRenamed("doc_id", "node"), "fingerprints")
    return similar_links(prints, texts, width, radius)


def _grouped(prints: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id, the smallest id of the component."""
    roots = connected_components(links)
    by_fp = (
        prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
        .join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    )
    by_fp = written(by_fp, "roots")
    ids = by_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(by_fp.join(ids, "root").select("fp", "component_id"), "fp")


def simhash_components(
    docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every document; exact links."""
    prints = written(fingerprints(docs, width, False, id_col, text_col), "fingerprints")
    links = band_links(prints.select("fp").distinct(), radius)
    return _grouped(prints, links).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_duplicate_groups(
    docs: DataFrame, width: int = 5, radius: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, component_id of every document; links are shingle similarities of 0.8 and more.

    A Jaccard similarity of 0.8 is an angle of 0.476 between the shingle sets, and about 9.7 differing
    bits of 64 with a deviation of under three, so 20 bits miss few such pairs; five smallest
    hashes miss one in 3,000.
    """
    texts = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("node"), "text"
    )
    links = _similar_texts(texts.select("node", "text"), width, radius)
    return _grouped(texts.select("doc_id", F.col("node").alias("fp")), links).select(
        "doc_id", "component_id"
    )


def one_of_each_group(
    docs: DataFrame, width: int = 5, radius: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of the smallest id (then
    of the smallest hash of the text) stays, with all columns."""
    columns = docs.columns
    keyed = docs.withColumns(
        {
            "_id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)),
            "_h": F.xxhash64(F.col(text_col).cast("string")),
        }
    )
    texts = keyed.select(F.col("_h").alias("node"), F.col(text_col).cast("string").alias("text"))
    roots = connected_components(_similar_texts(texts, width, radius))
    grouped = texts.select(F.col("node").alias("_h")).distinct().join(
        roots.withColumnRenamed("node", "_h"), "_h", "left"
    ).select("_h", F.coalesce("root", "_h").alias("root"))
    kept = (
        keyed.select("_id", "_h").join(grouped, "_h")
        .groupBy("root").agg(F.min(F.struct("_id", "_h")).alias("kept")).select("kept.*")
    )
    return keyed.join(written(kept, "kept"), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select(*columns)
