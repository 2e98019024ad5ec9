"""Removal of bytes inside long strings that start at two places or more, over a whole corpus.

A string of ``length`` bytes that starts in two places is found by intervals of a Burrows-Wheeler
transform. No transform holds the whole corpus: strings are first dealt so that equal ones meet.

1. Of every ``length``-byte window the smallest hash of its ``gram``-byte substrings is its key; equal
   windows have equal keys. Neighbouring windows of equal key are a run, and a run needs its
   windows' bytes only. A key with one run in the whole corpus holds no repeat, unless the smallest
   hash stands at two places of that run.
2. Equal runs are folded to one with a weight. A key with very many different runs (a passage that
   a third of all documents hold, with different surroundings) is refined: its runs are cut into
   cells of ``cell`` window places, relative to where the smallest hash stands, with the bytes
   that all windows of a cell share as the key; keys that are still too large are refined to single
   windows.
3. The folded runs of many keys are one bucket of bounded size, of which some whole keys at a time
   are one text. Its suffixes are sorted to the depth that matters or to the end of their run, which
   gives the transform. Breadth-first backward extension of its intervals then
   gives the common prefixes of neighbouring suffixes by increasing value, and stops at ``length``:
   suffixes between two boundaries found so far agree in ``length`` bytes, and are repeats if
   their runs weigh two or more.
4. The repeated windows of a run go back to all its places, and the covered bytes are removed.

Everything is judged on the input, never on what is left of it, and nothing matches across texts.

Defined cases: a null text is empty; a text shorter than ``length`` bytes loses nothing; a window that
repeats within one text or overlaps its repeat counts; repeated rows (equal id and text too) are
texts of their own and repeat each other; null ids are kept; an empty table gives an empty result;
other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_map, id_and_text, parts_for, with_bit, written

RUNS = "key long, c1 long, c2 long, id long, h long, start int, n int, anchor long, own boolean"
_TYPES = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.bool_()]
_NAMES = [c.split()[0] for c in RUNS.split(", ")]
# Odd multiplier of the rolling hash (fixed value).
_ODD = 0x9E3779B97F4A7C15
# Bytes of texts that are hashed together, and of runs that are sorted together.
_CHUNK = 1 << 16
_PART = 1 << 19
# Places of an order that are sorted together.
_SLAB = 1 << 20


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram``-byte substring (a power of two), by doubling."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    width, factor = 1, _ODD
    while width < gram:
        x = x[:-width] * np.uint64(factor) + x[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    count, known = len(x) - width + 1, 1
    while 2 * known <= width:
        x = np.minimum(x[:-known], x[known:])
        known *= 2
    return np.minimum(x[:count], x[width - known : width - known + count])


def window_runs(
    data: bytes, sizes: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts of ``sizes`` bytes that stand one behind the other in ``data``: key (as signed
    long), text, first window (in ``data``), number of windows, whether the key stands at two places.
    No window crosses texts."""
    if not len(sizes) or sizes.max() < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool)
    hashes = gram_hashes(data, gram)
    places = length - gram + 1
    low = sliding_minimum(hashes, places)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    long_enough = np.flatnonzero(sizes >= length)
    first, stop = begins[long_enough], ends[long_enough] - length + 1
    # A run begins at the first window of a text and where the smallest hash changes.
    begin = np.zeros(len(low) + 1, dtype=bool)
    begin[1:-1] = low[1:] != low[:-1]
    inside = np.zeros(len(low) + 1, dtype=np.int8)
    inside[first] += 1
    inside[stop] -= 1
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    begin[first] = True
    begin &= inside
    starts = np.flatnonzero(begin)
    text = np.searchsorted(ends, starts, side="right")
    stops = np.minimum(np.r_[starts[1:], len(low)], ends[text] - length + 1)
    keys = low[starts]
    # Only a hash that comes twice in the data can stand at two places of a run.
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    own = np.zeros(len(starts), dtype=bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        for r in np.flatnonzero(twice[at] == keys).tolist():
            own[r] = np.count_nonzero(hashes[starts[r] : stops[r] + places - 1] == keys[r]) > 1
    return keys.view(np.int64), text, starts, stops - starts, own


def refined_runs(
    data: bytes, anchor: int, start: int, n: int, length: int, gram: int, cell: int
) -> list[tuple[int, int, int]]:
    """(key, first window, number of windows) of the cells of a run."""
    import xxhash

    hashes = gram_hashes(data[start : start + n - 1 + length], gram).view(np.int64)
    anchors = np.flatnonzero(hashes == anchor) + start
    windows = np.arange(start, start + n)
    at = anchors[np.searchsorted(anchors, windows)]
    cells = (at - windows) // cell
    cuts = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(cells) != 0)) + 1, n]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        last = int(at[a] - cells[a] * cell)
        core = data[last : last - cell + 1 + length]
        key = xxhash.xxh3_64_intdigest(core + bytes([0]) + str(int(cells[a])).encode())
        out.append((key - (1 << 64) if key >> 63 else key, start + a, b - a))
    return out


def _run_rows(length: int, gram: int):
    """Rows RUNS of whole texts, of about ``_CHUNK`` bytes at a time."""
    import xxhash

    def chunk(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        keys, text, starts, n, own = window_runs(data, sizes, length, gram)
        view = memoryview(data)
        ends = (starts + n - 1 + length).tolist()
        digests = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends))
        c = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
        at = pa.array(text)
        columns = (
            keys, c[:, 0], c[:, 1], part.column("id").take(at), part.column("h").take(at),
            starts - (np.cumsum(sizes) - sizes)[text], n, keys, own,
        )
        return _batch(columns)

    def rows(batches):
        for batch in batches:
            sizes = pc.coalesce(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            # A text that reaches over the end of a chunk is its last.
            chunks = (np.cumsum(sizes, dtype=np.int64) - sizes) // _CHUNK
            cuts = np.r_[0, np.flatnonzero(np.diff(chunks)) + 1, len(chunks)].tolist()
            parts, held = [], 0
            for a, b in zip(cuts, cuts[1:]):
                parts.append(chunk(batch.slice(a, b - a)))
                held += parts[-1].num_rows
                if held > 200_000 or b == len(chunks):
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, held = [], 0

    return rows


def _cell_rows(length: int, gram: int, cell: int):
    """Rows RUNS of the cells of the asked runs."""
    import xxhash

    def rows(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            asked = batch.column("asked").to_pylist()
            keys = zip(batch.column("id").to_pylist(), batch.column("h").to_pylist())
            columns: list[list] = [[] for _ in _NAMES]
            for at, (doc, h) in enumerate(keys):
                data = texts[at].as_py() or b""
                runs = (
                    (*x, r["anchor"])
                    for r in asked[at]
                    for x in refined_runs(data, r["anchor"], r["start"], r["n"], length, gram, cell)
                )
                for key, start, n, anchor in runs:
                    c = xxhash.xxh3_128_digest(data[start : start + n - 1 + length])
                    c1 = int.from_bytes(c[:8], "little", signed=True)
                    c2 = int.from_bytes(c[8:], "little", signed=True)
                    for column, value in zip(columns, (key, c1, c2, doc, h, start, n, anchor, False)):
                        column.append(value)
                if len(columns[0]) > 200_000:
                    yield _batch(columns)
                    columns = [[] for _ in _NAMES]
            yield _batch(columns)

    return rows


def _batch(columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _sorted_within(classes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The order by (class, after) of entries that are in class order already."""
    n = len(classes)
    bits = int(after.max()).bit_length()
    slab = min(_SLAB, 1 << (64 - bits) // 2) - 1
    order = np.empty(n, dtype=np.int32)
    start = 0
    while start < n:
        stop = min(start + slab, n)
        if stop < n:
            stop = int(np.searchsorted(classes, classes[stop]))
        if stop <= start:
            # A class of more than a slab.
            stop = int(np.searchsorted(classes, classes[start], side="right"))
            order[start:stop] = np.argsort(after[start:stop], kind="stable") + start
        else:
            # Class, value and place in one number: sorting needs no second array.
            low = np.uint64((stop - start).bit_length())
            packed = (classes[start:stop] - classes[start]).astype(np.uint64) << np.uint64(bits)
            packed |= after[start:stop].astype(np.uint64)
            packed <<= low
            packed |= np.arange(stop - start, dtype=np.uint64)
            packed.sort()
            packed &= (np.uint64(1) << low) - np.uint64(1)
            order[start:stop] = packed.astype(np.int32) + start
        start = stop
    return order


def suffix_order(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of bytes by their first ``depth`` bytes, and the first 8 bytes of every suffix
    as a number. A 0 ends a string, ``left`` bytes behind a place; what follows it does not count."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    first = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    short = np.flatnonzero(left < 8)
    first[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))
    order = np.argsort(first).astype(np.int32)
    ordered = first[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    # The rank of a suffix is the place where its class begins.
    rank = np.empty(n, dtype=np.int32)
    places, suffixes = np.arange(n, dtype=np.int32), order
    rank[suffixes] = places[new][np.cumsum(new, dtype=np.int32) - 1]
    width = 8
    while width < depth:
        # Open: in a class of two or more, whose strings have not ended.
        open_entries = left[suffixes] >= width
        open_entries[:-1] &= ~(new[:-1] & new[1:])
        open_entries[-1] &= ~new[-1]
        open_entries = np.flatnonzero(open_entries)
        if not len(open_entries):
            break
        places, suffixes, new = places[open_entries], suffixes[open_entries], new[open_entries]
        step = min(width, depth - width)
        after = rank[suffixes + np.int32(step)]
        by = _sorted_within(np.cumsum(new, dtype=np.int32), after)
        # Classes keep their places, so sorting all open suffixes together sorts each class.
        suffixes, after = suffixes[by], after[by]
        new[1:] |= after[1:] != after[:-1]
        order[places] = suffixes
        rank[suffixes] = places[new][np.cumsum(new, dtype=np.int32) - 1]
        width += step
    return order, first


def repeat_boundaries(text: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and where in it the common prefix with the place before is shorter than
    ``length``. Not told: boundaries at which a string has ended, as it is no repeat; it comes before
    all that begin like it.

    Level l holds intervals of suffixes that begin with the same l bytes. Extending an interval
    to the left by each byte in its part of the transform gives intervals of the next level, whose
    right end is a boundary of value l if it is not one yet; only those are extended further.
    """
    n = len(text)
    order, first = suffix_order(text, left, length)
    place = np.zeros(n + 1, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # One step back in the text: where the suffix one byte longer stands. The first has none.
    back = place[order - 1]
    byte = text[order - 1]
    # One step forth, and the neighbours of that step that have the same byte before them.
    forth = place[order + 1]
    head_byte = text[order]
    same = head_byte[1:] == head_byte[:-1]
    following = np.full(n, n, dtype=np.int32)
    following[:-1][same] = forth[1:][same]
    preceding = np.full(n, -1, dtype=np.int32)
    preceding[1:][same] = forth[:-1][same]
    following, preceding = following[back], preceding[back]
    real = byte > 0
    real[place[0]] = False
    # Common prefixes below 8 bytes are seen in the first 8 bytes of neighbours.
    bound = np.zeros(n + 1, dtype=bool)
    bound[0] = bound[n] = True
    depth = min(8, length)
    ordered = first[order] >> np.uint64(8 * (8 - depth))
    bound[1:n] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(bound[:n]).astype(np.int32)
    stops = np.r_[starts[1:], np.int32(n)] - np.int32(1)
    whole = left[order[starts]] >= depth
    starts, stops = starts[whole], stops[whole]
    for _ in range(depth, length):
        if not len(starts):
            break
        # Bytes of the transform in each interval: their first and last places there.
        sizes = stops - starts + 1
        members = np.repeat(starts - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        members += np.arange(len(members), dtype=np.int32)
        known = real[members]
        last = members[(following[members] > np.repeat(stops, sizes)) & known]
        head = members[(preceding[members] < np.repeat(starts, sizes)) & known]
        new_stops = np.sort(back[last])
        new_starts = np.sort(back[head])
        fresh = ~bound[new_stops + 1]
        starts, stops = new_starts[fresh], new_stops[fresh]
        bound[stops + 1] = True
    return order, bound[:n]


def repeated_windows(runs: list[bytes], weights: np.ndarray, length: int) -> list[list[list[int]]]:
    """Of each run, the [from, to) ranges of windows whose bytes start in two places or more."""
    sizes = np.fromiter(map(len, runs), dtype=np.int32, count=len(runs)) + np.int32(1)
    text = np.frombuffer(b"\xff".join(runs) + b"\xff", dtype=np.uint8) + np.uint8(1)
    ends = np.cumsum(sizes, dtype=np.int32)
    left = np.repeat(ends - np.int32(1), sizes) - np.arange(len(text), dtype=np.int32)
    order, bound = repeat_boundaries(text, left, length)
    # Groups of equal windows; each weighs as much as its runs.
    entries = np.flatnonzero(left[order] >= length)
    group = np.cumsum(bound, dtype=np.int32)[entries]
    windows = order[entries]
    weight = np.bincount(group, weights=np.repeat(weights, sizes)[windows])
    repeated = np.zeros(len(text) + 2, dtype=np.int8)
    repeated[windows[weight[group] >= 2] + 1] = 1
    # The windows behind the last whole one part the runs.
    edges = np.flatnonzero(repeated[1:] != repeated[:-1]).reshape(-1, 2)
    run_of = np.searchsorted(ends, edges[:, 0], side="right")
    edges -= (ends - sizes)[run_of][:, None]
    cuts = np.searchsorted(run_of, np.arange(1, len(runs)))
    return [x.tolist() for x in np.split(edges, cuts)]


def _bucket_repeats(length: int):
    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "c1", "c2"])
        data, weights = list(frame["data"]), frame["weight"].to_numpy()
        # Keys share no windows: a transform of some whole keys at a time stays in the cache.
        keys = frame["key"].to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        part = (np.cumsum(sizes) - sizes)[first] // _PART
        cuts = [*first[np.r_[True, part[1:] != part[:-1]]].tolist(), len(data)]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            found += repeated_windows(data[a:b], weights[a:b], length)
        out = pd.DataFrame({"c1": frame["c1"].to_numpy(), "c2": frame["c2"].to_numpy(), "found": found})
        return out[[len(x) > 0 for x in found]]

    return find


def _run_bytes(length: int):
    def cut(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            texts = batch.column("text").cast(pa.binary())
            for at, asked in enumerate(batch.column("asked").to_pylist()):
                data = texts[at].as_py()
                for r in asked:
                    part = data[r["start"] : r["start"] + r["n"] - 1 + length]
                    for column, value in zip(columns, (r["key"], r["c1"], r["c2"], r["weight"], part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, type=t)
                    for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))
                ],
                names=["key", "c1", "c2", "weight", "data"],
            )

    return cut


def _digests(length: int):
    def digest(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            texts = batch.column("text").cast(pa.binary())
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("windows").to_pylist())
            for at, (doc, windows) in enumerate(keys):
                data = texts[at].as_py() or b""
                spans: list[list[int]] = []
                for a, b in sorted((w["a"], w["b"]) for w in windows or []):
                    stop = b - 1 + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([a, stop])
                kept, at_byte = hashlib.sha256(), 0
                view = memoryview(data)
                for a, b in spans:
                    kept.update(view[at_byte:a])
                    at_byte = b
                kept.update(view[at_byte:])
                values = (doc, len(data), [x for s in spans for x in s], kept.hexdigest())
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], type=pa.int64()),
                    pa.array(columns[1], type=pa.int64()),
                    pa.array(columns[2], type=pa.list_(pa.int32())),
                    pa.array(columns[3], type=pa.string()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept_sha256"],
            )

    return digest


def repeated_spans(
    docs: DataFrame,
    length: int = 400,
    gram: int = 32,
    cell: int = 16,
    key_runs: int = 2_000,
    bucket_bytes: int = 3 << 20,
    bits: int = 1 << 22,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, spans (from, to, from, to, ... of the removed bytes), kept_sha256.

    ``key_runs``: a key with more different runs is refined. ``bucket_bytes``: bytes of a bucket.
    ``bits``: size of the bit maps that leave out texts which need not move.
    """
    docs = id_and_text(docs, id_col, text_col)
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("h"), "text"
    )
    runs = written(keyed.mapInArrow(_run_rows(length, gram), RUNS), "runs")
    final = None
    place = F.struct("id", "h", "start", "n", "anchor")
    for step in (cell, 1, None):
        # Of keys with two runs or more: equal runs folded.
        often = (
            runs.groupBy("key").agg(F.count("*").alias("all"), F.max("own").alias("own"))
            .where("all > 1 OR own").select("key")
        )
        kept = written(runs.join(often, "key", "left_semi"), "kept-runs")
        folded = kept.groupBy("key", "c1", "c2").agg(
            F.count("*").alias("weight"), F.min(place).alias("place")
        )
        folded = written(folded, "folded-runs")
        if step is None:
            small, small_runs = folded, kept
        else:
            large = folded.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > key_runs)
            large = written(large.select("key"), "large-keys")
            small = folded.join(large, "key", "left_anti")
            small_runs = kept.join(large, "key", "left_anti")
        part = (small, small_runs)
        final = part if final is None else tuple(a.union(b) for a, b in zip(final, part))
        if step is None or large.isEmpty():
            break
        asked = (
            kept.join(large, "key").groupBy("id", "h")
            .agg(F.collect_list(F.struct("start", "n", "anchor")).alias("asked"))
        )
        runs = written(
            _with_text(keyed, asked, bits).mapInArrow(_cell_rows(length, gram, step), RUNS), "runs"
        )
    folded, kept = final
    folded = folded.select("key", "c1", "c2", "weight", "place.*")
    total = folded.agg(F.sum(F.col("n") + length)).first()[0] or 0
    buckets = parts_for(total, bucket_bytes)
    asked = folded.groupBy("id", "h").agg(
        F.collect_list(F.struct("start", "n", "key", "c1", "c2", F.least("weight", F.lit(2)).alias("weight")))
        .alias("asked")
    )
    found = written(
        _with_text(keyed, asked, bits)
        .mapInArrow(_run_bytes(length), "key long, c1 long, c2 long, weight long, data binary")
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        .applyInPandas(
            _bucket_repeats(length), "c1 long, c2 long, found array<array<int>>"
        ),
        "repeats",
    )
    windows = (
        kept.join(found, ["c1", "c2"])
        .select("id", "h", "start", F.explode("found").alias("w"))
        .groupBy("id", "h")
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("start") + F.col("w")[0]).alias("a"), (F.col("start") + F.col("w")[1]).alias("b")
                )
            ).alias("windows")
        )
    )
    windows = written(windows, "windows")
    every = with_bit(
        docs.select(
            "doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("h")
        ),
        "h", written(bit_map(windows, "h", bits), "bits"), bits,
    )
    changed = every.where("_may").join(windows, ["id", "h"], "left").select("doc_id", "text", "windows")
    none = F.lit(None).cast(windows.schema["windows"].dataType)
    same = every.where("NOT _may").select("doc_id", "text", none.alias("windows"))
    shape = "doc_id long, n_bytes long, spans array<int>, kept_sha256 string"
    return changed.mapInArrow(_digests(length), shape).union(same.mapInArrow(_digests(length), shape))


def _with_text(keyed: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """``asked`` with the text of its document; only texts whose bit is set are moved. Rows of equal
    id and text give it once each, which changes nothing: their runs weigh two or more as it is."""
    asked = written(asked, "asked-runs")
    may = with_bit(keyed, "h", written(bit_map(asked, "h", bits), "bits"), bits).where("_may")
    return may.drop("_may").join(asked, ["id", "h"])
