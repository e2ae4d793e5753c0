"""Packing documents into few sequences of bounded length by bin completion.

Documents matter to a packing only by their length, and there are at most ``capacity`` lengths. So the plan is
made on the histogram of lengths (a bounded table) and holds patterns with multiplicities; pieces then find
their place by their rank among the pieces of equal length. Ranks are dealt over many buckets of a hash, so a
length that a third of all pieces share is spread like any other.

Bin completion: the largest length left opens a sequence, and the undominated fillings of what remains of it are
tried: first those that fill it exactly, of pieces as equal in length as can be (so that short pieces stay for
later), then all others. A filling is dominated if more fits, or a longer piece fits in the place of one or two of its
pieces. As pieces of one length are alike, a filling is used as often as it can be, and then once, so every plan can be reached. A branch ends when
its waste, or the lower bound of what is left, exceeds what a plan better than the best known could have. Best fit
decreasing gives the first plan known, and completes every ``EVERY``-th node to further ones; the search ends when a plan
meets the bound (Martello and Toth's L2), or after ``NODES`` nodes, whatever the number of pieces.

Defined cases: a null text counts as empty (one piece, the closing id alone); rows that repeat an id are packed
each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.bpe import WordBpe
from tidewell.llm.common import BROADCAST_ROWS, cut, modest_batches, model, texts_of

CAPACITY, CLOSING_ID = 2048, 0
#: Nodes of the search (steps towards further fillings count too), and between how many best fit completes a plan.
NODES, EVERY = 10_000, 256

#: A plan: (lengths with their counts, how many sequences look like that).
Plan = list[tuple[dict[int, int], int]]


def bins(plan: Plan) -> int:
    return sum(n for _, n in plan)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, for equal pieces and equal sequences at once."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)

    def put(pattern: dict[int, int], length: int, k: int, n: int) -> None:
        if n:
            new = {**pattern, length: pattern.get(length, 0) + k} if k else pattern
            open_bins[capacity - sum(a * b for a, b in new.items())].append((new, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            pattern, n = open_bins[room].pop() if room is not None else ({}, left)
            if room is not None and not open_bins[room]:
                del open_bins[room]
            k = (capacity if room is None else room) // length
            full = min(n, left // k)
            put(pattern, length, k, full)
            left -= full * k
            if full < n:
                # One more takes what is left; the others stay as they were (new ones aren't opened).
                put(pattern, length, left, 1 if left else 0)
                if room is not None:
                    put(pattern, length, 0, n - full - (1 if left else 0))
                left = 0
    return [x for group in open_bins.values() for x in group]


def fillings(counts: dict[int, int], lengths: list[int], room: int) -> Iterator[tuple[int, dict[int, int]] | None]:
    """All undominated fillings of ``room`` with what they leave; None for each step between. lengths: those with pieces left, falling."""
    chosen: dict[int, int] = {}
    taken: list[list[int]] = []
    at, left = 0, room
    while True:
        while at < len(lengths):
            length = lengths[at]
            if length <= left:
                k = min(counts[length], left // length)
                chosen[length] = k
                taken.append([at, k])
                left -= k * length
                yield None
            at += 1
        if not _dominated(counts, lengths, chosen, left):
            yield left, dict(chosen)
        if not taken:
            return
        at, k = taken[-1]
        length = lengths[at]
        left += length
        if k > 1:
            taken[-1][1] = chosen[length] = k - 1
        else:
            taken.pop()
            del chosen[length]
        at += 1
        yield None


def _dominated(counts: dict[int, int], lengths: list[int], chosen: dict[int, int], slack: int) -> bool:
    spare = [x for x in lengths if counts[x] > chosen.get(x, 0)]
    if any(x <= slack for x in spare):
        return True
    own = list(chosen)
    for i, a in enumerate(own):
        if any(a < x <= a + slack for x in spare):
            return True
        for b in own[i:]:
            if (a != b or chosen[a] > 1) and any(a + b <= x <= a + b + slack for x in spare):
                return True
    return False


def least(counts: dict[int, int], capacity: int) -> int:
    """A bound below which no plan can be: Martello and Toth's L2."""
    n = np.zeros(capacity + 2, np.int64)
    for length, k in counts.items():
        n[length] = k
    number, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half = capacity // 2
    alpha = np.arange(half + 1)
    large, middle = number[capacity] - number[half], total[capacity - alpha] - total[half]
    some = number[capacity - alpha] - number[half]
    small = total[half] - np.where(alpha > 0, total[alpha - 1], 0)
    return int((large + np.maximum(0, -(-(small - (some * capacity - middle)) // capacity))).max())


def exact(counts: dict[int, int], lengths: list[int], room: int) -> Iterator[dict[int, int]]:
    """Fillings of ``room`` without waste by one, two or three pieces, each kind from the most equal ones on. lengths: falling."""
    if counts.get(room, 0):
        yield {room: 1}
    there = np.zeros(room + 1, bool)
    fit = [x for x in lengths if x <= room]
    there[fit] = True

    def pairs(rest: int, top: int) -> np.ndarray:
        """The larger pieces, up to ``top``, of pairs that fill ``rest``; rising."""
        larger = np.arange(-(-rest // 2), min(rest - 1, top) + 1)
        return larger[there[larger] & there[rest - larger]]

    def enough(pieces: tuple[int, ...]) -> dict[int, int] | None:
        chosen = {x: pieces.count(x) for x in pieces}
        return chosen if all(counts[x] >= k for x, k in chosen.items()) else None

    for a in pairs(room, room).tolist():
        if found := enough((a, room - a)):
            yield found
    # Of three, the largest is at least a third.
    for a in reversed(fit):
        if 3 * a >= room and room - a > 1:
            for b in pairs(room - a, a).tolist():
                if found := enough((a, b, room - a - b)):
                    yield found


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """The best plan found for a histogram of lengths."""
    total = sum(a * n for a, n in counts.items())
    if not total:
        return []
    bound = least(counts, capacity)
    best = best_fit(counts, capacity)
    if bins(best) == bound:
        return best
    state = {x: n for x, n in counts.items() if n}
    path: Plan = []
    used, waste, visited = 0, 0, 0
    stack: list[Iterator] = []

    def options() -> Iterator[tuple[dict[int, int], int] | tuple[()]]:
        # What is left when the node opens, as deeper nodes use the state.
        own = {x: n for x, n in state.items() if n}
        first = max(own)
        own[first] -= 1
        lengths = sorted((x for x, n in own.items() if n), reverse=True)
        tried = set()

        def option(chosen: dict[int, int]) -> Iterator[tuple[dict[int, int], int]]:
            pattern = {**chosen, first: chosen.get(first, 0) + 1}
            often = min((own[x] + (x == first)) // k for x, k in pattern.items())
            yield pattern, often
            if often > 1:
                yield pattern, 1

        for chosen in exact(own, lengths, capacity - first):
            tried.add(frozenset(chosen.items()))
            yield from option(chosen)
        for x in fillings(own, lengths, capacity - first):
            if x is None:
                yield ()
            elif x[0] or frozenset(x[1].items()) not in tried:
                yield from option(x[1])

    stack.append(options())
    while stack and visited < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                pattern, often = path.pop()
                used -= often
                waste -= (capacity - sum(a * k for a, k in pattern.items())) * often
                for x, k in pattern.items():
                    state[x] += k * often
            continue
        visited += 1
        if not step:
            continue
        pattern, often = step
        more = (capacity - sum(a * k for a, k in pattern.items())) * often
        if waste + more > (bins(best) - 1) * capacity - total:
            continue
        path.append(step)
        used += often
        waste += more
        for x, k in pattern.items():
            state[x] -= k * often
        rest = {x: n for x, n in state.items() if n}
        if rest and used + least(rest, capacity) < bins(best):
            if visited % EVERY == 0 and used + bins(more_plan := best_fit(rest, capacity)) < bins(best):
                best = path + more_plan
                if bins(best) == bound:
                    break
            stack.append(options())
            continue
        if not rest:
            # The waste was in bounds, so this plan is better.
            best = list(path)
            if bins(best) == bound:
                break
        stack.append(iter(()))
    return best


def slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a sequence, first sequence, place in it) of each pattern's lengths."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in plan:
        place = 0
        for length, k in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * k, k, sequence, place))
            used[length] += n * k
            place += length * k
        sequence += n
    return rows


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of at most ``capacity``."""
    modest_batches(docs)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(("word", path), lambda: WordBpe(path))
        for batch in batches:
            where, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(texts_of(batch.column(1))):
                ids = np.append(bpe.encode(text), CLOSING_ID).astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at: at + capacity]
                    where.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumn("row", F.monotonically_increasing_id())


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """One row per piece: its id, ``piece``, ``start``, ``length``, ``ids_crc32``, and where it lies: ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, path, id_col, text_col, capacity))
    # At most one row for each length.
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    table = slots(complete(counts, capacity, nodes))
    where = spark.createDataFrame(table, "slot_length long, first_rank long, end_rank long, each long, first_sequence long, place long")

    # The square root balances a hot length's share of a bucket against the number of buckets that a length is summed over.
    buckets = 1 + isqrt(sum(counts.values()))
    dealt = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    sizes = dealt.groupBy("length", "bucket").count()
    before = cut(sizes.select(F.col("length").alias("of_length"), F.col("bucket").alias("of_bucket"),
                              (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before")))
    rank = F.col("rank") + F.col("before")
    numbered = ranked.join(before, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket"))).withColumn("rank", rank)
    # The table of slots grows with the number of patterns, a few thousand at a capacity of 2,048; it is counted all the same.
    placed = numbered.join(F.broadcast(where) if len(table) <= BROADCAST_ROWS else where, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    within = F.col("rank") - F.col("first_rank")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
                         (F.col("place") + within % F.col("each") * F.col("length")).alias("offset"), "row")
