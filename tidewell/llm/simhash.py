"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of binary tries.

Fingerprints. A-Z is lower-cased, words are runs without white space, shingles are ``width`` words
joined by spaces (a shorter text is one shingle, a text without words has fingerprint zero). A bit is set
if it is set in over half the shingles' XXH64 values.

Links. Only distinct fingerprints are joined. Two that differ in at most ``budget`` bits agree in at least
one of ``budget + 1`` blocks of bits, so each fingerprint enters one trie for each block, that block's bits
first: those are the partitions. A partition of more than ``CELL`` fingerprints is divided again in the
same way by its remaining bits, so no partition is large, however the fingerprints cluster; as
fingerprints are distinct this ends. In a partition the trie is joined with itself: pairs of nodes are
followed down together, differing bits accumulate, and a pair is dropped once it exceeds the budget;
small pairs of nodes are compared directly. A partition returns a spanning forest of its links rather
than all pairs, which loses no component.

Components come from the forests' union (``graph.components``). Everything is spread by key and nothing
is collected.

Defined cases: a null text has no words; a component's id is the smallest id in it (null if it has no id);
of rows that repeat an id one counts as kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import graph
from tidewell.llm.common import cut, modest_batches, release, texts_of

WIDTH, BUDGET, SEED = 4, 4, 42
#: Fingerprints that one task compares with each other at most.
CELL = 2048
#: Hashes whose bits are counted at once.
BLOCK = 65_536
#: Rows joined at once within a task, and pairs compared at once.
CHUNK, PAIRS = 100_000, 1_000_000

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int) -> bytes:
    """The shingles' hashes, eight bytes each, most significant first."""
    words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
    if not words:
        return b""
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < width:
        return digest(line, SEED)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:])])


def fingerprint(hashes: bytes) -> int:
    if not hashes:
        return 0
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = sum(np.unpackbits(rows[k: k + BLOCK], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(rows), BLOCK))
    return int.from_bytes(np.packbits(total * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, row_col: str | None = None) -> DataFrame:
    """``(id, row, fp)``: the fingerprint as a signed 64-bit number; ``row`` numbers the rows unless ``row_col`` does."""
    modest_batches(docs)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    chosen = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in texts_of(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "row", "fp"])

    return chosen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, row long, fp long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the pairs (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def trie_links(codes: np.ndarray, begins: np.ndarray, fixed: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose codes differ in at most ``budget`` bits, group by group.

    codes: unsigned, sorted within each group; begins: the groups' bounds, with the end; fixed: leading bits
    that agree within a group. A node of a group's trie is a range of positions, and all node pairs of all
    groups go down one level at a time.
    """
    low, high = begins[:-1], begins[1:]
    several = high - low > 1
    nodes = np.stack([low[several], high[several], low[several], high[several], np.zeros(several.sum(), np.int64)])
    for level in range(fixed, 65):
        a, a_end, b, b_end, differ = nodes
        size = (a_end - a) * (b_end - b)
        leaf = (size <= 64) if level < 64 else np.ones(len(size), bool)
        yield from _compare(codes, nodes[:, leaf], budget)
        nodes = nodes[:, ~leaf]
        if not nodes.shape[1]:
            return
        a, a_end, b, b_end, differ = nodes
        ones = np.concatenate(([0], np.cumsum(codes >> np.uint64(63 - level) & np.uint64(1)).astype(np.int64)))
        a_mid, b_mid = a_end - (ones[a_end] - ones[a]), b_end - (ones[b_end] - ones[b])
        same = a == b
        down = [np.stack([a, a_mid, b, b_mid, differ]), np.stack([a_mid, a_end, b_mid, b_end, differ]),
                np.stack([a, a_mid, b_mid, b_end, differ + 1]), np.stack([a_mid, a_end, b, b_mid, differ + 1])[:, ~same]]
        nodes = np.concatenate(down, axis=1)
        a, a_end, b, b_end, differ = nodes
        alone = (a == b) & (a_end - a < 2)
        nodes = nodes[:, (a < a_end) & (b < b_end) & (differ <= budget) & ~alone]


def _compare(codes: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
    bounds = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS, side="right")))
        a, _, b, b_end, _ = nodes[:, at:to]
        own = np.repeat(np.arange(to - at), sizes[at:to])
        within = np.arange(len(own)) - np.repeat(np.cumsum(sizes[at:to]) - sizes[at:to], sizes[at:to])
        across = (b_end - b)[own]
        i, j = a[own] + within // across, b[own] + within % across
        near = (np.bitwise_count(codes[i] ^ codes[j]) <= budget) & ((a != b)[own] | (i < j))
        yield i[near], j[near]
        at = to


def blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` blocks that cover ``bits`` bits."""
    widths = [bits // parts + (k < bits % parts) for k in range(parts)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _divided(rows: DataFrame, fixed: int, budget: int) -> DataFrame:
    """Each row once for each block of its bits after the first ``fixed``, with that block moved to the front of them."""
    rest = 64 - fixed
    mask = (1 << rest) - 1 if rest < 64 else -1
    cells = []
    for k, (offset, width) in enumerate(blocks(rest, budget + 1)):
        tail = F.col("code").bitwiseAND(F.lit(mask))
        turned = tail if not offset else F.shiftleft(tail, offset).bitwiseOR(F.shiftrightunsigned(tail, rest - offset)).bitwiseAND(F.lit(mask))
        code = turned if not fixed else F.col("code").bitwiseAND(F.lit(~mask)).bitwiseOR(turned)
        cells.append(F.struct((F.col("trie") * (budget + 1) + k).alias("trie"), code.alias("code"), F.lit(fixed + width).alias("fixed")))
    parts = rows.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.*")
    return parts.withColumn("prefix", F.call_function("shiftrightunsigned", F.col("code"), F.lit(64) - F.col("fixed")))


def links(distinct: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """``(u, v)`` fingerprints: within each partition a spanning forest of the links."""
    rows = _divided(distinct.select("fp", F.col("fp").alias("code"), F.lit(0).cast("long").alias("trie")), 0, budget)
    ready = []
    while True:
        large = cut(rows.groupBy("trie", "fixed", "prefix").count().where(F.col("count") > cell).drop("count"))
        if large.isEmpty():
            ready.append(rows)
            break
        keys = ["trie", "fixed", "prefix"]
        ready.append(rows.join(large, keys, "left_anti"))
        again = cut(rows.join(large, keys, "left_semi"))
        next_rows = []
        for (fixed,) in again.select("fixed").distinct().collect():
            if fixed < 64:
                next_rows.append(_divided(again.where(F.col("fixed") == fixed).select("fp", "code", "trie"), fixed, budget))
        rows = next_rows[0]
        for more in next_rows[1:]:
            rows = rows.unionByName(more)
    cells = ready[0]
    for more in ready[1:]:
        cells = cells.unionByName(more)
    cells = cells.select("trie", "fixed", "prefix", F.expr("code ^ (-9223372036854775807 - 1)").alias("code"), "fp")
    placed = cells.repartition("trie", "fixed", "prefix").sortWithinPartitions("trie", "fixed", "prefix", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            if len(held[0]) >= CHUNK:
                # The last cell may go on in the next batch.
                new = np.flatnonzero(_changes(held))
                cut_at = int(new[-1]) + 1 if len(new) else 0
                if cut_at:
                    yield _joined([x[:cut_at] for x in held], budget)
                    held = [x[cut_at:] for x in held]
        if held is not None and len(held[0]):
            yield _joined(held, budget)

    return placed.mapInArrow(run, "u long, v long")


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    return (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])


def _joined(columns: list[np.ndarray], budget: int) -> pa.RecordBatch:
    codes = columns[3].view(np.uint64) ^ np.uint64(1 << 63)
    bounds = np.concatenate(([0], np.flatnonzero(_changes(columns)) + 1, [len(codes)]))
    fixed = columns[1][bounds[:-1]]
    label = np.arange(len(codes))
    for width in np.unique(fixed):
        own = np.flatnonzero(fixed == width)
        # Groups of one width are laid side by side.
        sizes = bounds[own + 1] - bounds[own]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(bounds[own], sizes) + np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
        found = np.arange(begins[-1])
        for a, b in trie_links(codes[where], begins, int(width), budget):
            # Links are folded into the forest as they come.
            x, y = found[a], found[b]
            merged = forest(len(found), x, y)
            found = merged[found]
        label[where] = where[found]
    tied = label != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(columns[4][tied]), pa.array(columns[4][label[tied]])], names=["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET,
                    row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hexadecimal digits), component, and whether it is the one to keep."""
    rows = cut(fingerprints(docs, id_col, text_col, width, row_col))
    # A null id comes last.
    order = F.struct(F.isnull("id").alias("none"), "id", "row")
    distinct = cut(rows.groupBy("fp").agg(F.min(order).alias("top")))
    ties = graph.components(links(distinct, budget))
    member = cut(distinct.join(ties.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "top"))
    tops = cut(member.groupBy("root").agg(F.min("top").alias("top")))
    known = cut(member.select("fp", "root").join(tops, "root").select("fp", F.col("top.id").alias("component_id"), F.col("top.row").alias("kept_row")))
    return rows.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         "component_id", (F.col("row") == F.col("kept_row")).alias("kept"), "row")
