"""Near duplicates by SimHash links that are verified, completed to every pair of at least ``SIMILARITY``; for the pipeline's stage.

Two texts are linked if the sets of their ``WIDTH``-word shingles (words as in ``simhash``) have a Jaccard similarity of
at least ``SIMILARITY``. At 0.8 fingerprints of 64 bits differ in about ten bits and often in more, for which a trie can't
prune (blocks for that many agree by chance), so the trie join finds the closest pairs and an exact join finds the rest:

* One pass counts shingles in ``SLOTS`` counters a task and passes on its ``HEAVY`` fullest; the ``HEAVY`` fullest of all give every task the same
  order of shingles, rare ones first. Sets of n shingles as similar as that share k of their first n - ceil(SIMILARITY n) + k,
  whatever the order and k (here a tenth of n); by rarity, passages that many texts share are seldom among them. Each row then does without the k - 1 of these
  keys that most rows have (k for the smallest set it may be similar to): as all rows order keys alike, both rows of a pair do without the same of the keys
  they share, so one is left. Rows that still share a key are looked at further. Keys are dealt out once, as ``PART`` bytes within a range of all keys and the distance to the
  row before, compressed (about six bytes); what counts a range's keys has their rows at hand, so no table of all keys is written or joined.
* Those rows' fingerprints are joined by ``simhash.links``; the links that the texts bear out give the first components.
* Rows that share keys make up cells (connected parts). In a cell each row that isn't in the cell's largest component is compared with
  all others, in numpy, ``TILE`` shingles against ``TILE`` at a time; a tile returns a spanning forest of its links, so no
  pairs are emitted. In a cell of several tiles all rows are first compared with ``CENTRES`` of them, which
  ties the bulk of a group of copies together, so that few rows are left to compare with all.

Nothing is collected but ``HEAVY`` counters, and no link is lost. What can't be bounded is a cell of very many rows that are all just short
of similar: its rows are compared with each other, in tiles.

Defined cases: a null text has no words; a text of fewer words is one shingle; texts without words are alike; a component keeps its smallest id, then
row number (a null id comes last); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm import graph
from tidewell.llm.common import batches_of, cut, modest_batches, new_path, release, remove, small, texts_of, written
from tidewell.llm.graph import Forest
from tidewell.llm.simhash import ASCII_LOWER, BUDGET, fingerprint, links, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Counters of shingles and how many of them are passed on.
SLOTS, HEAVY = 1 << 22, 1 << 16
#: Shingles of a block of rows, and rows that all of a large cell are compared with first.
TILE, CENTRES = 1 << 16, 32
#: Parts into which the pairs of one row are dealt to be verified.
PARTS = 4096
#: Keys that may be broadcast, one number each, and rows with their shingles in an Arrow batch.
KEYS, ROWS = 1_000_000, 128
#: Shingles that a task counts at once.
COUNTED = 1 << 18
#: Keys in a part of all keys, about; keys that a task deals out at once; bytes of a key within its part, and of a row's number; rows returned at once.
PART_KEYS, DEALT, PART, NUMBER, RETURNED = 1 << 20, 1 << 20, 5, 8, 1 << 16
#: The bits of a key that tell its part: those of its hash, without its weight.
HASHED = np.uint64((1 << 56) - 1)
NO_WORDS = np.zeros(1, np.uint64)
#: The weight of each word of a shingle in its hash.
WEIGHTS = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted. They are made of the words' hashes, side by side; only equality of shingles matters here."""
    words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = hashes[: len(words) - width + 1] * WEIGHTS[0]
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * WEIGHTS[k] + hashes[k: len(words) - width + 1 + k]
    out ^= out >> np.uint64(32)
    return np.unique(out * WEIGHTS[width])


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def commonness(docs: DataFrame, text_col: str) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The slots whose shingles occur most often, sorted, and for each a number that grows with how often; and how many keys all rows have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, held, size, keys = np.zeros(SLOTS, np.uint32), [], 0, 0

        def add() -> None:
            own, n = np.unique(np.concatenate(held), return_counts=True)
            counts[own] += n.astype(np.uint32)

        for batch in batches:
            for text in texts_of(batch.column(0)):
                held.append(slot(shingles(text)))
                size += len(held[-1])
                keys += keys_of(len(held[-1]))
                if size >= COUNTED:
                    add()
                    held, size = [], 0
        if held:
            add()
        often = np.flatnonzero(counts > 1)
        often = often[np.argsort(counts[often], kind="stable")[-HEAVY:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1)), pa.array(np.append(counts[often].astype(np.int64), keys))], names=["slot", "n"])

    found = docs.select(text_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.col("slot") >= 0, F.desc("n"), "slot").limit(HEAVY + 1).toArrow()
    slots, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    keys, slots, n = int(n[slots < 0].sum()), slots[slots >= 0], n[slots >= 0]
    order = np.argsort(slots)
    return (slots[order], np.floor(4 * np.log2(n[order] + 1)).astype(np.uint8)), keys


def surplus(n: int) -> int:
    """How many keys a set of n shingles shares with one that is similar enough and has as many."""
    return 1 + n // 10


def least_shared(n: int) -> int:
    """How many it shares with any that is similar enough: that may be smaller."""
    return surplus(ceil(SIMILARITY * n - 1e-9))


def keys_of(n: int) -> int:
    """How many keys a set of n shingles has."""
    return min(n, n - ceil(SIMILARITY * n - 1e-9) + surplus(n)) if n else 1


def first_keys(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of which two sets that are similar enough share ``surplus`` (of the smaller one): the rarest shingles."""
    if not len(hashes):
        return NO_WORDS
    slots, weights = common
    order = hashes >> np.uint64(8)
    if len(slots):
        own = slot(hashes)
        place = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
        order |= np.where(slots[place] == own, weights[place], 0).astype(np.uint64) << np.uint64(56)
    n = keys_of(len(order))
    return np.partition(order, n - 1)[:n] if n < len(order) else order


def packed(keys: np.ndarray, rows: np.ndarray) -> bytes:
    """The last ``PART`` bytes of the keys and the distances of the rows, bytes of one place side by side, compressed."""
    planes = [keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PART].T, np.diff(rows, prepend=0).astype("<i8").view(np.uint8).reshape(-1, NUMBER).T]
    return pa.compress(np.concatenate(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, n * (PART + NUMBER), "zstd", asbytes=True), np.uint8).reshape(-1, n)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :PART] = planes[:PART].T
    return keys.view("<u8").ravel(), np.cumsum(np.ascontiguousarray(planes[PART:].T).view("<i8").ravel())


def dealt(held: list[tuple[int, int, np.ndarray]], parts: int) -> pa.RecordBatch:
    """``(part, n, data)``: the keys of some rows by parts; and in a part below 0 the ``least`` of each row in place of a key. held: row, least and keys."""
    numbers, least = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint64)
    keys = np.concatenate([x[2] for x in held])
    rows = np.repeat(numbers, [len(x[2]) for x in held])
    part = ((keys & HASHED) >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    keys, rows, part = keys[order], rows[order], part[order]
    begins = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    ends = np.append(begins[1:], len(part))
    out = [(int(part[a]), int(b - a), packed(keys[a:b], rows[a:b])) for a, b in zip(begins, ends)]
    out.append((-1 - int(numbers[0] % PARTS), len(numbers), packed(least, numbers)))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["part", "n", "data"])


def shared(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``(key, row, n, least)``: what several rows of a part share, with how many do; of a part below 0 the ``least`` of each row, without a key."""
    keys, rows = (np.concatenate(x) for x in zip(*held))
    if part < 0:
        none = pa.nulls(len(rows), pa.int64())
        columns = [none, pa.array(rows), none, pa.array(keys.astype(np.int32))]
    else:
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(begins, len(keys)))
        n = np.repeat(n, n)
        several = n > 1
        keys = (np.uint64(part << 8 * PART) | keys[several]).view(np.int64)
        columns = [pa.array(keys), pa.array(rows[several]), pa.array(n[several]), pa.nulls(len(keys), pa.int32())]
    found = pa.RecordBatch.from_arrays(columns, names=["key", "row", "n", "least"])
    for k in range(0, found.num_rows, RETURNED):
        yield found.slice(k, RETURNED)


def members(docs: DataFrame, row_col: str, text_col: str, part_keys: int = PART_KEYS) -> DataFrame:
    """``(key, row)`` of the keys that several rows share, of rows that share enough.

    A key is its part and ``PART`` bytes of its hash. Where these are the same by chance, a row has the key more than once
    and is counted so; as pairs then share as many as before, none is lost.
    """
    common, every = commonness(docs, text_col)
    parts = max(1, ceil(every / part_keys))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                own = shingles(text)
                held.append((row, least_shared(len(own)), first_keys(own, common)))
                size += len(held[-1][2])
                if size >= DEALT:
                    yield dealt(held, parts)
                    held, size = [], 0
        if held:
            yield dealt(held, parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, held = None, []
        for batch in batches:
            for part, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != last:
                    if held:
                        yield from shared(last, held)
                    last, held = part, []
                held.append(unpacked(data.as_py(), n))
        if held:
            yield from shared(last, held)

    placed = docs.select(F.col(row_col).cast("long"), text_col).mapInArrow(deal, "part long, n long, data binary").repartition("part").sortWithinPartitions("part")
    found = placed.mapInArrow(count, "key long, row long, n long, least int")
    own = Window.partitionBy("row")
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "key"))).withColumn("least", F.max("least").over(own))
    with batches_of(docs.sparkSession, ROWS):
        left = cut(ranked.where("key is not null and rank >= least").select("key", "row"))
    several = left.groupBy("key").count().where("count > 1").select("key")
    return cut(left.join(small(cut(several), KEYS), "key", "left_semi"))


def sets_of(docs: DataFrame, rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """``(row, n, fp, shingles)`` of some rows: number of shingles, fingerprint, and the sorted hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, data = [], [], []
            for text in texts_of(batch.column(1)):
                prints.append(fingerprint(shingle_hashes(text, WIDTH)))
                own = shingles(text)
                n.append(len(own))
                data.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(data, pa.binary())],
                                             names=["row", "n", "fp", "shingles"])

    chosen = docs.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text")).join(small(rows), "row", "left_semi")
    return chosen.mapInArrow(run, "row long, n long, fp long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``(u, v)`` of pairs of rows that are similar enough, but for those that others tie. The pairs of one ``v`` are dealt over parts."""
    part = F.pmod(F.xxhash64("u"), F.lit(PARTS)).cast("int")
    asking = pairs.select(F.col("u").alias("row"), F.col("u").alias("root"), F.col("v").alias("cell"), part.alias("i"), F.lit(0).alias("j"), F.lit(ASKS).alias("role"))
    others = asking.select(F.col("cell").alias("row"), F.col("cell").alias("root"), "cell", "i", "j", F.lit(ANSWERS).alias("role")).distinct()
    return compared(asking.unionByName(others), sets)


def close_pairs(sets: DataFrame, budget: int) -> DataFrame:
    """``(u, v)`` rows whose fingerprints the trie join links, and rows of equal fingerprints with one of them."""
    distinct = cut(sets.groupBy("fp").agg(F.min("row").alias("first")))
    tied = links(distinct.select("fp"), budget)
    ends = distinct.select(F.col("fp").alias("u"), F.col("first").alias("row_u")), distinct.select(F.col("fp").alias("v"), F.col("first").alias("row_v"))
    across = tied.join(ends[0], "u").join(ends[1], "v").select(F.col("row_u").alias("u"), F.col("row_v").alias("v"))
    equal = sets.select("row", "fp").join(distinct, "fp").where("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    return across.unionByName(equal)


def tile_links(asks: list[np.ndarray], asking: list[int], sets: list[np.ndarray], roots: list[int]) -> list[tuple[int, int]]:
    """Links between the roots of the rows that ask and those of the others, each new to the forest of those before.

    asks, asking: the sets and roots of the rows that ask; sets, roots: those of the rows they are compared with.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    forest, found = Forest(), []
    for own, root in zip(asks, asking):
        low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        lengths = high - low
        places = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[places], minlength=len(sets))
        for k in np.flatnonzero(both >= SIMILARITY * (sizes + len(own) - both)).tolist():
            if forest.tie(root, roots[k]):
                found.append((root, roots[k]))
    return found


#: What a row does in a tile.
ASKS, ANSWERS, BOTH = 1, 2, 3


def compared(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)`` links found in tiles. tiles: ``(row, root, cell, i, j, role)``; the rows of a tile that ask are compared with those that answer."""
    # Where rows are few, the sets are dealt out only once.
    placed = sets.select("row", "shingles").join(small(cut(tiles)), "row").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").select("cell", "i", "j", "role", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, held = None, None

        def result() -> pa.RecordBatch:
            found = tile_links(*held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for (*tile, role, root), data in zip(keys, batch.column(5)):
                if tile != last:
                    if held:
                        yield result()
                    last, held = tile, ([], [], [], [])
                # A copy, as the batch goes.
                own = np.frombuffer(data.as_py(), np.uint64)
                if role & ASKS:
                    held[0].append(own)
                    held[1].append(root)
                if role & ANSWERS:
                    held[2].append(own)
                    held[3].append(root)
        if held:
            yield result()

    return placed.mapInArrow(run, "u long, v long")


def _named(rows: DataFrame, ties: DataFrame | None) -> DataFrame:
    """``rows`` with ``root``: the component that each row belongs to so far."""
    if ties is None:
        return rows.withColumn("root", F.col("row"))
    return rows.join(small(ties.select(F.col("u").alias("row"), F.col("v").alias("tied"))), "row", "left").withColumn("root", F.coalesce("tied", "row")).drop("tied")


def _cells(held: DataFrame, ties: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(row, cell, n)`` of the rows that share a key with a row of another component; cell: what hangs together by such keys."""
    named = cut(_named(held, ties))
    open_keys = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", "least")
    # Components are what hangs together, so cells are made of roots, and each key ties its roots to the least. Rows without such a key are similar to none outside.
    rows = cut(named.join(small(cut(open_keys), KEYS), "key").select("row", "root", "least").distinct())
    tied = graph.components(rows.select(F.col("root").alias("u"), F.col("least").alias("v")).distinct()).select(F.col("u").alias("root"), F.col("v").alias("top"))
    return cut(rows.select("row", "root").distinct().join(small(tied), "root", "left").select("row", F.coalesce("top", "root").alias("cell")).join(sizes, "row"))


def near_duplicates(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """``(row)`` of the rows that aren't kept. row_col: a number of each row that is the same whenever ``docs`` is read."""
    spark = docs.sparkSession
    modest_batches(docs)
    held = members(docs, row_col, text_col)
    if held.isEmpty():
        return held.select("row")
    path = new_path(spark)
    sets = written(sets_of(docs, cut(held.select("row").distinct()), row_col, text_col), path)
    # Rows with their shingles are wide.
    with batches_of(spark, ROWS):
        found = cut(verified(close_pairs(sets, budget), sets))
    ties = graph.components(found)

    cells = _cells(held, ties, sets.select("row", "n"))
    large = cut(cells.groupBy("cell").agg(F.ceil(F.sum(F.col("n") + 1) / TILE).cast("int").alias("blocks")).where("blocks > 1"))
    if not large.isEmpty():
        # Every row of a large cell against a few of them.
        own = _named(cells.join(small(large), "cell"), ties)
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("row"), "row"))
        centres = own.withColumn("rank", rank).where(F.col("rank") <= CENTRES)
        asking = centres.select("row", "root", "cell", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(ASKS).alias("role"))
        others = own.select("row", "root", "cell", F.lit(0).alias("i"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("j"), F.lit(ANSWERS).alias("role"))
        with batches_of(spark, ROWS):
            found = cut(found.unionByName(compared(asking.unionByName(others), sets)))
        ties = graph.components(found)

    # The rows outside of each cell's largest component ask all others; every pair of components has one that does.
    cells = cut(_named(cells, ties))
    parts = cells.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") + 1).alias("n"))
    order = F.struct("rows", "root")
    plan = parts.groupBy("cell").agg(F.max_by("root", order).alias("largest"), F.sum("n").alias("all"), F.max_by("n", order).alias("quiet"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    plan = plan.select("cell", "largest", F.ceil(F.col("all") / TILE).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("quiet")) / TILE)).cast("int").alias("turns"))
    own = cells.join(small(cut(plan)), "cell")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    alone = F.col("blocks") == 1
    single = own.where(alone).select("row", "root", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("root") == F.col("largest"), ANSWERS).otherwise(BOTH).alias("role"))
    own = own.where(~alone)
    asking = own.where("root <> largest").select("row", "root", "cell", F.pmod(F.xxhash64("row", F.lit(1)), F.col("turns")).cast("int").alias("i"),
                                                 F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(ASKS).alias("role"))
    others = own.select("row", "root", "cell", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("i"), block.alias("j"), F.lit(ANSWERS).alias("role"))
    with batches_of(spark, ROWS):
        found = cut(found.unionByName(compared(single.unionByName(asking).unionByName(others), sets)))
    ties = graph.components(found)
    remove(spark, path)

    linked = cut(ties.select(F.col("u").alias("row"), F.col("v").alias("root")).unionByName(ties.select(F.col("v").alias("row"), F.col("v").alias("root")).distinct()))
    order = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id")).join(small(linked), "row")
    order = cut(order.select("row", "root", F.struct(F.isnull("id").alias("none"), "id", "row").alias("place")))
    tops = order.groupBy("root").agg(F.min("place").alias("top")).select("root", F.col("top.row").alias("kept_row"))
    return order.join(tops, "root").where("row <> kept_row").select("row")
