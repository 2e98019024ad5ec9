"""Packing token sequences into as few windows of a fixed length as possible.

Documents longer than a window are cut into whole windows behind a shorter first piece; the whole
windows need no packing. All other pieces are dealt by a hash over parts of bounded size, and each
part is packed by best-fit decreasing. A lower bound from dual-feasible functions certifies a part
whose number of windows it meets. The other parts keep their full windows and give the documents of
their emptiest windows to an exchange, which is dealt and packed again, until every part is
certified or an exchange saves nothing.

Only lengths travel; token ids stay where they are made. Nothing but the number of pieces of each
length and of a round's windows goes to the driver.

Defined cases: a null text is empty and has the end id only; repeated and null ids are documents of
their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, parts_for, sliced, written
from .token_codec import MEMO_BYTES, encoded

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    memo_bytes: int = MEMO_BYTES,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; ``row`` tells documents of equal id apart.

    ``row`` is the number of the document's first piece, so ``row + piece`` is one piece only: a
    partition (2^30 of them) numbers its pieces (2^33) one by one.
    """

    def pieces(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, 500):
            ids_of = batch.column("doc_id").to_pylist()
            out = [[] for _ in range(6)]
            for n, ids in encoded(batch.column("text").to_pylist(), tokenizer, end_id, memo_bytes):
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                bounds = [0, *range(first, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    values = (row, ids_of[n], piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
                    for column, value in zip(out, values):
                        column.append(value)
                row += len(bounds) - 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(out, types)],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(pieces, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and place of each piece: longest first, each into the fullest window that
    still has room for it."""
    order = np.argsort(-lengths, kind="stable")
    window = np.empty(len(lengths), dtype=np.int64)
    place = np.empty(len(lengths), dtype=np.int64)
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    made = 0
    for i in order:
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            stack = open_by_room[room]
            w = stack.pop()
            if not stack:
                del open_by_room[room]
                rooms.pop(at)
        else:
            room, w, made = capacity, made, made + 1
        window[i], place[i] = w, capacity - room
        left = room - need
        if left:
            if left in open_by_room:
                open_by_room[left].append(w)
            else:
                open_by_room[left] = [w]
                bisect.insort(rooms, left)
    return window, place


def _counts_of(lengths, capacity: int) -> np.ndarray:
    """Number of pieces of each length, from an array of lengths or a mapping of counts."""
    if isinstance(lengths, dict):
        out = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in lengths.items():
            out[length] = n
        return out
    return np.bincount(lengths, minlength=capacity + 1).astype(np.int64)


def dual_feasible_bound(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on the number of windows for ``counts[length]`` pieces of each length: the best
    of a family of dual-feasible functions.

    For each threshold t up to half a window: pieces above ``capacity - t`` count as a whole window,
    pieces below t as nothing, the others as their length. The weights of what fits in one window
    never sum to more than a window. t = 0 is the bound by total length.
    """
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    below = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    middle = total[capacity - t] - below
    best = large + -(-middle // capacity)
    # Pieces over half a window, two of which never share one.
    return int(max(best.max(), number[-1] - number[capacity // 2]))


def pack_pieces(
    pieces: DataFrame,
    capacity: int = 1024,
    part_rows: int = 50_000,
    max_rounds: int | None = None,
) -> DataFrame:
    """``pieces`` (row, piece, length and any other columns) with sequence_id and offset; ``row +
    piece`` differs between any two pieces.

    ``part_rows`` bounds the pieces that one task packs. Sequence numbers are unique, not dense. Rounds
    go on until all parts are certified, one part is left or an exchange saves nothing; each saves a
    window at least. ``max_rounds`` ends them earlier.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_key", F.xxhash64("row", "piece"))
    keys = ["row", "piece", "length", "_key"]
    shape = "row long, piece int, sequence_id long, offset long"
    whole = pieces.where(F.col("length") == capacity).select(
        "row", "piece",
        (F.col("row") + F.col("piece")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    columns = [c.split()[0] for c in shape.split(", ")]
    done = [whole.select(*columns)]
    waiting = pieces.where(F.col("length") < capacity).select(*keys)
    # Lengths and how often they come: at most ``capacity`` rows, for the bound over all parts.
    counts = {r["length"]: r["n"] for r in waiting.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bound = dual_feasible_bound(_counts_of(counts, capacity), capacity)
    count, kept_windows, before = sum(counts.values()), 0, None
    for turn in itertools.count():
        if not count:
            break
        parts = parts_for(count, part_rows)
        last_turn = turn + 1 == max_rounds or parts == 1

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True])
            lengths = frame["length"].to_numpy()
            window, place = best_fit_decreasing(lengths, capacity)
            used = np.bincount(window, weights=lengths).astype(np.int64)
            gap = len(used) - dual_feasible_bound(_counts_of(lengths, capacity), capacity)
            # A certified part with a window's worth of room is a partner for those with a gap.
            room = len(used) - -(-int(lengths.sum()) // capacity)
            given = np.zeros(len(used), dtype=bool)
            if not last_turn:
                given[np.argsort(used, kind="stable")[: max(4 * gap, 2 * room)]] = True
            return pd.DataFrame(
                {
                    "row": frame["row"].to_numpy(),
                    "piece": frame["piece"].to_numpy(),
                    "length": lengths,
                    "_key": frame["_key"].to_numpy(),
                    "part": frame["_part"].to_numpy(),
                    "window": window,
                    "offset": place,
                    "given": given[window],
                }
            )

        # Negative numbers, so that they never meet those of whole windows.
        number = -(
            F.lit(turn << 50) + F.col("part") * (1 << 24) + F.col("window") + 1
        )
        packed = written(
            waiting.withColumn("_part", F.pmod(F.xxhash64("_key", F.lit(turn)), F.lit(parts)))
            .groupBy("_part")
            .applyInPandas(
                pack,
                "row long, piece int, length long, _key long, part long, window long,"
                " offset long, given boolean",
            )
            .withColumn("sequence_id", number),
            "packed",
        )
        first = F.col("offset") == 0  # one piece of each window
        windows, given_windows, given_pieces = packed.agg(
            F.coalesce(F.sum(first.cast("long")), F.lit(0)),
            F.coalesce(F.sum((first & F.col("given")).cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.col("given").cast("long")), F.lit(0)),
        ).first()
        if before is not None and windows >= before[1]:
            # The exchange saved nothing: its documents stay where they were.
            done.append(before[0])
            break
        if not given_pieces or kept_windows + windows <= bound:
            done.append(packed.select(*columns))
            break
        done.append(packed.where(~F.col("given")).select(*columns))
        kept_windows += windows - given_windows
        before = (packed.where("given").select(*columns), given_windows)
        waiting, count = packed.where("given").select(*keys), given_pieces
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return pieces.drop("_key").join(placed, ["row", "piece"])


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    memo_bytes: int = MEMO_BYTES,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    ``memo_bytes`` bounds the looked-up words of a Python worker; fewer cost time, not results.
    """
    pieces = written(
        token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, memo_bytes), "token-pieces"
    )
    return pack_pieces(pieces, capacity).drop("row")
