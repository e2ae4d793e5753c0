"""Word-piece token counts by a linear longest-match automaton.

The vocabulary forms two tries, one of pieces that begin a word and one of those that continue it. Each node has
a failure link to where matching goes on when no child fits, and the number of pieces that are popped on the way,
so the greedy longest-match-first count of a word is found in one pass without building pieces. A word that
cannot be split is one unknown token. Words are cut at white space, and each punctuation mark is a word.

Defined cases: a null text counts as empty (no tokens); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import LONGEST_REMEMBERED, REMEMBERED, SPACE
from tidewell.llm.common import model, modest_batches, texts_of

#: Continuing pieces begin with this.
CONTINUES = "##"
# ASCII characters that count as punctuation though Unicode calls them symbols.
SYMBOLS = r"$+<=>^`|~"


class LongestMatch:
    def __init__(self, vocabulary: Iterable[str]):
        self.moves: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for piece in vocabulary:
            node, rest = (1, piece[len(CONTINUES):]) if piece.startswith(CONTINUES) and len(piece) > len(CONTINUES) else (0, piece)
            for c in rest:
                to = self.moves[node].get(c)
                if to is None:
                    to = self.moves[node][c] = len(self.moves)
                    self.moves.append({})
                    ends.append(False)
                node = to
            if node > 1:
                ends[node] = True
        #: Where matching goes on (-1: nowhere), and how many pieces that pops.
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, to in self.moves[node].items():
                queue.append(to)
                if ends[to]:
                    self.fail[to], self.pops[to] = 1, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at >= 0 and c not in self.moves[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[to], self.pops[to] = self.moves[at][c], popped

    def pieces(self, word: str) -> int:
        """How many pieces the word has; 0 if it cannot be split."""
        moves, fail, pops = self.moves, self.fail, self.pops
        node = count = 0
        for c in word:
            to = moves[node].get(c)
            while to is None:
                if fail[node] < 0:
                    return 0
                count += pops[node]
                node = fail[node]
                to = moves[node].get(c)
            node = to
        while node != 1:
            if fail[node] < 0:
                return 0
            count += pops[node]
            node = fail[node]
        return count


class Counter(dict):
    """Tokens of text, unknown ones counted besides; what was counted for a run without white space is remembered."""

    def __init__(self, vocabulary: Iterable[str]):
        super().__init__()
        self.automaton = LongestMatch(vocabulary)
        self.words = regex.compile(rf"[^{SPACE}\p{{P}}{re.escape(SYMBOLS)}]+|[\p{{P}}{re.escape(SYMBOLS)}]")
        self.odd_space, self.space = re.compile("[\x1c-\x1f]"), re.compile(rf"[{SPACE}]+")

    def __missing__(self, run: str) -> int:
        tokens = unknown = 0
        for word in self.words.findall(run):
            n = self.automaton.pieces(word)
            tokens += n or 1
            unknown += not n
        if len(run) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = tokens | unknown << 40
        return tokens | unknown << 40

    def count(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        runs = self.space.split(text) if self.odd_space.search(text) else text.split()
        total = sum(map(self.__getitem__, runs))
        return total & (1 << 40) - 1, total >> 40


def vocabulary_of(path: str) -> list[str]:
    """Word pieces of a sentence-piece model: its pieces that begin a word as they are, others as continuing ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    found = dict.fromkeys(p[1:] if p.startswith("▁") else CONTINUES + p for p in map(model.id_to_piece, kept) if p != "▁")
    return [p for p in found if p != CONTINUES]


def counter(path: str) -> Counter:
    """The model's counter, built once in each Python worker."""
    return model(("pieces", path), lambda: Counter(vocabulary_of(path)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the number of tokens, and how many of them are unknown words."""
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_"))

    modest_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            found = [own.count(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                             names=[id_col, "n_tokens", "n_unknown"])

    return chosen.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_unknown long")
