"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text is turned into a suffix automaton, which accepts
exactly the substrings of the sample. A text is parsed greedily: each phrase is the longest match that
begins where the last one ended (a character that occurs nowhere in the sample is a phrase of its own).
The number of phrases times log2(length of the sample), per character, estimates the cross entropy; the
language with the least wins.

The automata are kept as one dense transition table, each language with an alphabet of its own, in which a missing
transition is replaced by the start of the next phrase, marked by the lowest bit. The table is a file without a name that
the worker maps, so its pages are the system's to drop. Texts are cut into blocks of ``BLOCK`` bytes that are
parsed side by side in numpy, so the cost is a few array operations per byte and language whatever the
text's length. Each block but the first is then entered again in the state that the block before ended in, until both parses
meet, which takes about a phrase; where they don't meet within a block, the next one is entered again too. So the
phrases are those of the whole text, whatever the blocks. Longer texts are parsed ``BATCH_BYTES`` at a time, the state carried on.

Bounds of the fit: for each language whole labelled rows, chosen by a hash of the id, of at most ``LONGEST`` bytes each (the shortest row, if all are longer),
at most ``ROWS`` of them and ``SAMPLE`` bytes (or a language's share of ``SAMPLES``, if that is less), but at least one row. Every labelled language
is learned. Predictions read whole texts.

Defined cases: a null text or one without a letter gives ``und`` with score 0, as does every text if
nothing is labelled; ties go to the language with more labelled rows, then by name; an empty table
gives an empty result; further columns are passed through untouched.
"""

from __future__ import annotations

import re
import tempfile
from collections import namedtuple
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.llm.common import model, modest_batches, small, texts_of

ROWS, LONGEST, SAMPLE, SAMPLES = 96, 4_096, 40_960, 1 << 20
BLOCK = 2048
#: Bytes of text parsed side by side.
BATCH_BYTES = 2 << 20
UNDETERMINED = "und"
#: A text is foreign to all languages if even the best needs a phrase for fewer than two bytes, beyond a few phrases.
FOREIGN, FEW_PHRASES = 0.5, 8

#: names: languages by falling number of labelled rows; samples: their normalised texts.
Model = namedtuple("Model", "names samples")


def held_out(id_col: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("size", F.octet_length("text"))
    # One row a language.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("size") <= LONGEST).alias("short"), F.min("size").alias("least")).orderBy(
        F.desc("count"), "lang").collect()
    if not counts:
        return Model((), ())
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    # The hash leaves a few times ROWS rows of each language; only those are ranked.
    reach = docs.sparkSession.createDataFrame([(r["lang"], int(min(1, 4 * ROWS / max(1, r["short"])) * (1 << 30)), max(LONGEST, r["least"]), r["short"]) for r in counts],
                                              "lang string, reach long, longest int, short long")
    near = rows.withColumn("place", place).join(small(reach), "lang").where("size <= longest AND place < reach")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    chosen = near.withColumn("rank", rank).where((F.col("rank") == 1) | (F.col("rank") <= ROWS) & (F.col("short") > 0)).select("lang", "rank", "size", "text").collect()
    share = min(SAMPLE, SAMPLES // len(counts))
    samples: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    held = dict.fromkeys(samples, 0)
    for r in sorted(chosen, key=lambda r: r["rank"]):
        if not samples[r["lang"]] or held[r["lang"]] + r["size"] <= share:
            samples[r["lang"]].append(r["text"])
            held[r["lang"]] += r["size"]
    known = [(k, re.sub(b" +", b" ", normal(" ".join(v)))) for k, v in samples.items()]
    return Model(tuple(k for k, _ in known), tuple(v for _, v in known))


#: ASCII bytes that aren't letters become spaces.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(TO_SPACE)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = new
    return moves


class Parser:
    """Counts phrases of many texts at once against every language of a model."""

    def __init__(self, model: Model):
        self.names = model.names
        #: For each language and byte its place in a row of the language's cells; 0 if the sample lacks it.
        self.code = np.zeros((len(model.names), 256), np.int64)
        # A state has at most two for each byte of the sample, so the table's size is known to be within a number's reach.
        most = sum((2 * len(s) + 2) * (len(set(s)) + 1) for s in model.samples)
        kind = np.int32 if most < 1 << 30 else np.int64
        roots, base = [], 0
        with tempfile.TemporaryFile() as file:
            for own_code, sample in zip(self.code, model.samples):
                used = sorted(set(sample))
                own_code[used] = np.arange(1, len(used) + 1)
                width = len(used) + 1
                moves = suffix_automaton(sample)
                # The last state has no phrase open: texts begin there, and bytes the sample lacks lead there.
                none = len(moves)
                own = np.full((none + 1, width), -1, kind)
                by = np.fromiter(chain.from_iterable(moves), np.int64)
                own[np.repeat(np.arange(none), list(map(len, moves))), own_code[by]] = np.fromiter(chain.from_iterable(m.values() for m in moves), kind, len(by))
                del moves, by
                broken = own < 0
                np.copyto(own, np.where(broken[0], none, own[0]), where=broken)
                own *= width
                own += base
                own <<= 1
                own |= broken
                file.write(own)
                roots.append(base + none * width)
                base += own.size
            file.flush()
            self.table = np.memmap(file, kind, "r", shape=(base,)).view(np.ndarray) if base else np.zeros(0, kind)
        self.roots = np.array(roots, np.int64)
        self.weight = np.log2([len(s) + 1 for s in model.samples]) if base else np.zeros(0)

    def phrases(self, texts: list[bytes], entered: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, the length of each text, and the states in which the last one ends.

        entered: the states in which the first text is entered, if it goes on from another.
        """
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
        before = np.concatenate(([0], np.cumsum(keep)))
        first, after = before[ends - sizes - 1], before[ends - 1]
        data = raw[keep]
        sizes = after - first
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = first[owner] + within * BLOCK
        left = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
        # Long blocks first, so those still being parsed lie together.
        order = np.argsort(-left, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, left = at[order], left[order]
        active = len(at) - np.searchsorted(left[::-1], np.arange(BLOCK), side="right")
        table, code = self.table, self.code
        entry = np.repeat(self.roots[:, None], len(at), axis=1)
        if entered is not None and len(at):
            entry[:, place[0]] = entered
        state, count = entry.copy(), np.zeros(entry.shape, np.int64)
        for step in range(int(left[0]) if len(left) and len(self.roots) else 0):
            n = active[step]
            found = table.take(state[:, :n] + code[:, data[at[:n] + step]])
            count[:, :n] += found & 1
            state[:, :n] = found >> 1
        # Blocks that go on from another, by rank, and the ranks of the blocks before them.
        later = np.flatnonzero(within > 0)
        later, earlier = place[later], place[later - 1]
        here, previous = later, earlier
        while len(here):
            lang, k = np.nonzero(state[:, previous] != entry[:, here])
            block = here[k]
            a, b = entry[lang, block], state[lang, previous[k]]
            entry[lang, block] = b
            ended = self._enter_again(lang, block, a, b, data, at, left, count, state)
            # Only blocks after those whose last state is another now are entered again.
            moved = np.zeros(len(at), bool)
            moved[ended] = True
            here, previous = later[moved[earlier]], earlier[moved[earlier]]
        total = np.stack([np.bincount(owner, row[place], len(texts)) for row in count], axis=1) if len(count) else np.zeros((len(texts), 0))
        return total, sizes, state[:, place[-1]] if len(place) else self.roots

    def _enter_again(self, lang: np.ndarray, block: np.ndarray, a: np.ndarray, b: np.ndarray, data: np.ndarray, at: np.ndarray, left: np.ndarray,
                     count: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Counts blocks from states ``b`` rather than ``a``, until both parses meet; returns the blocks in which they don't."""
        ended = []
        for step in range(BLOCK):
            over = left[block] <= step
            if over.any():
                state[lang[over], block[over]] = b[over]
                ended.append(block[over])
                lang, block, a, b = (x[~over] for x in (lang, block, a, b))
            if not len(block):
                break
            move = self.code[lang, data[at[block] + step]]
            a, b = self.table.take(a + move), self.table.take(b + move)
            count[lang, block] += (b & 1) - (a & 1)
            a, b = a >> 1, b >> 1
            apart = a != b
            lang, block, a, b = (x[apart] for x in (lang, block, a, b))
        else:
            state[lang, block] = b
            ended.append(block)
        return np.concatenate(ended) if ended else np.zeros(0, np.int64)

    def long_phrases(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As ``phrases`` of one text, ``BATCH_BYTES`` at a time."""
        total, size, states = np.zeros((1, len(self.names))), 0, None
        for k in range(0, len(text), BATCH_BYTES):
            part = text[k: k + BATCH_BYTES]
            # A run of spaces counts as one, also where it is cut.
            part = part.lstrip(b" ") if k and text[k - 1] == 32 else part
            count, sizes, ended = self.phrases([part], states)
            total, size, states = total + count, size + sizes[0], ended if sizes[0] else states
        return total, np.array([size])

    def predict(self, texts: Iterable[str | None], number: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each of so many texts the language, its score, and whether the text is foreign to all languages."""
        names, scores, foreign = [UNDETERMINED] * number, np.zeros(number), np.zeros(number, bool)
        if not self.names:
            return names, scores, foreign
        batch: list[tuple[int, bytes]] = []
        held = 0
        for k, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            # Spaces at the ends would count or not, by where the text lies in a batch.
            own = normal(text).strip(b" ")
            if batch and held + len(own) > BATCH_BYTES:
                self._decide(batch, names, scores, foreign)
                batch, held = [], 0
            batch.append((k, own))
            held += len(own)
        if batch:
            self._decide(batch, names, scores, foreign)
        return names, scores, foreign

    def _decide(self, batch: list[tuple[int, bytes]], names: list[str], scores: np.ndarray, foreign: np.ndarray) -> None:
        count, sizes = self.long_phrases(batch[0][1]) if len(batch) == 1 else self.phrases([x for _, x in batch])[:2]
        entropy = count * self.weight / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1)
        ranked = np.sort(entropy, axis=1)
        # How much cheaper the best language is than the next; 1 if there's only one.
        score = 1 - ranked[:, 0] / ranked[:, 1] if ranked.shape[1] > 1 else np.ones(len(batch))
        for (k, _), b, s in zip(batch, best, score):
            names[k], scores[k] = self.names[b], min(1.0, max(0.0, float(s)))
        foreign[[k for k, _ in batch]] = count[np.arange(len(batch)), best] > FOREIGN * sizes + FEW_PHRASES


def identify(docs: DataFrame, learned: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score", foreign_as: str = "foreign") -> DataFrame:
    """``docs`` with the predicted language, its score (0 to 1), and whether the text is foreign to all languages, appended."""
    more = [T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType()), T.StructField(foreign_as, T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *more])
    place = docs.columns.index(text_col)
    modest_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model(("languages", learned), lambda: Parser(learned))
        for batch in batches:
            names, scores, foreign = parser.predict(texts_of(batch.column(place)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(foreign)], names=schema.names)

    return docs.mapInArrow(run, schema)
