"""Byte-level BPE encoding and decoding by tree concatenation.

Unsplit text of more than ``LEAF`` characters is cut into a balanced tree of leaves, wherever the cuts fall, and the leaves
are encoded independently of each other by compiled code (in parallel, if there are ``PARALLEL`` of them). At each join of two halves a
window around the boundary is encoded anew, doubling, until it holds on both sides a place where both encodings must agree:
where a word ends and white space begins, which no token crosses. What lies between replaces the halves' own tokens there; so each node of
the tree holds exactly the encoding of its text.

Runs of more than ``LONG`` characters without such a place (white space, or a word) stand for themselves. Their pieces
are encoded as trees of bytes in the same way: a window of tokens around each join is decoded and encoded anew, doubling,
until its first token is the left side's and its last token the right side's. That is exact: a sequence is
the BPE encoding of its bytes if each pair of neighbours is that of theirs, and every pair then stands
in one of the three encodings. All of it takes time in proportion to the text (times its logarithm).

Decoding joins the bytes of the ids; incomplete UTF-8 becomes U+FFFD.

Defined cases: a null text counts as empty (no tokens); an added token's string in a text is that token, as
in the tokenizers library; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import model, modest_batches, texts_of

#: Characters of unsplit text that are encoded as a whole, and leaves from which they are encoded in parallel, by so many threads.
LEAF, PARALLEL, THREADS = 1536, 8, 4
#: A run of more characters, of white space or without, is encoded by itself.
LONG = 256
#: Bytes of a single piece that are merged directly.
PIECE_LEAF = 256
#: Characters of a word that compiled code merges with its ending.
WORD_LEAF = 64
#: Pieces remembered in a worker, about 250 bytes each; beyond it the memory starts anew.
REMEMBERED = 250_000
#: A piece longer than this isn't remembered.
LONGEST_REMEMBERED = 256

# White space in Unicode, and the pattern that cuts text before merging.
WIDE_SPACE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"\t-\r {WIDE_SPACE}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = {b: LETTERS[b] for b in range(256)}
NEVER = 1 << 62


class Merges:
    """The merges of a byte-level BPE file, applied to bytes; ``suffix`` marks a word's last symbol, if the file has one."""

    def __init__(self, model: dict):
        ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.inner = [ids[c] for c in LETTERS]
        self.last = [ids[c + self.suffix] for c in LETTERS]
        self.rank = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[(a[: len(a) - len(self.suffix)] if self.suffix and a.endswith(self.suffix) else a) + b])
        #: Compiled code that merges a piece as a whole, where there is one.
        self.compiled: Callable[[bytes], list[int]] | None = None
        back = {c: b for b, c in enumerate(LETTERS)}
        self.bytes = {}
        for token, k in ids.items():
            bare = token.removesuffix(self.suffix) if self.suffix else token
            self.bytes[k] = bytes(back[c] for c in bare)

    def direct(self, piece: bytes, ends: bool = True) -> list[int]:
        """The ids of a piece, merged as a whole; ``ends``: it ends a word."""
        if self.compiled is not None:
            return self.compiled(piece)
        ids = [self.inner[b] for b in piece]
        if ends and self.suffix:
            ids[-1] = self.last[piece[-1]]
        if len(ids) > 2 * WORD_LEAF:
            return self._by_heap(ids)
        rank = self.rank.get
        found = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NEVER:
                break
            at, new = found.index(best), best & 0xFFFFF
            ids[at: at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = rank(ids[at - 1] << 20 | new, NEVER)
            if at < len(found):
                found[at] = rank(new << 20 | ids[at + 1], NEVER)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """Merges a long list of symbols in n log n steps."""
        rank, n = self.rank.get, len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), -1
        heap = [(r >> 20, at, r & 0xFFFFF, a, b) for at, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << 20 | b)) is not None]
        heapify(heap)

        def add(at: int) -> None:
            if at >= 0 and after[at] < n and (r := rank(ids[at] << 20 | ids[after[at]])) is not None:
                heappush(heap, (r >> 20, at, r & 0xFFFFF, ids[at], ids[after[at]]))

        while heap:
            _, at, new, a, b = heappop(heap)
            to = after[at]
            if ids[at] != a or to >= n or ids[to] != b:
                continue
            ids[at], ids[to] = new, gone
            after[at] = after[to]
            if after[at] < n:
                before[after[at]] = at
            add(at)
            add(before[at])
        return [k for k in ids if k != gone]

    def encode(self, piece: bytes, ends: bool = True, pool=None) -> list[int]:
        """The ids of a piece of any length, by tree concatenation."""
        size = len(piece)
        if size <= PIECE_LEAF:
            return self.direct(piece, ends) if size else []
        count = -(-size // PIECE_LEAF)
        cuts = [k * size // count for k in range(count + 1)]
        leaves = [(piece[a:b], ends and b == size) for a, b in zip(cuts, cuts[1:])]
        parts = list(pool.map(lambda x: self.direct(*x), leaves) if pool else (self.direct(*x) for x in leaves))
        while len(parts) > 1:
            pairs = [(parts[k], parts[k + 1], ends and k + 2 >= len(parts)) for k in range(0, len(parts) - 1, 2)]
            odd = parts[len(pairs) * 2:]
            # The last join's right side may be the odd one, so only the last part can end the word.
            pairs = [(a, b, last and not odd) for a, b, last in pairs]
            parts = list(pool.map(lambda x: self.join(*x), pairs) if pool else (self.join(*x) for x in pairs)) + odd
        return parts[0]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of what two encodings stand for, side by side."""
        width = 1
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            data = b"".join(self.bytes[k] for k in left[len(left) - a:] + right[:b])
            # Only a window that reaches the end of the word has the ending's symbol.
            window = self.direct(data, ends and b == len(right))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            width *= 2


class Remembered(dict):
    """Ids of words as little-endian 16-bit numbers; ``lead`` is put before each word."""

    def __init__(self, make, lead: str):
        super().__init__()
        self.make, self.lead = make, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.make(self.lead + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def compiled(model: dict, merges: Merges, pattern: str) -> tiktoken.Encoding | None:
    """Compiled code that merges pieces by the rank of what they make; None if the file's merges aren't in that order."""
    ids = model["vocab"]
    made = [ids[a + b] for a, b in model["merges"]]
    if made != sorted(made) or not made or made[0] < 256:
        return None
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks={v: k for k, v in merges.bytes.items()}, special_tokens={})


class ByteBpe:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file (no special tokens added)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.merges = Merges(file["model"])
        self.fast = compiled(file["model"], self.merges, PATTERN)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.pieces = regex.compile(PATTERN)
        self.long_run = re.compile(rf"[{SPACE}]{{{LONG + 1},}}|[^{SPACE}]{{{LONG + 1},}}")
        self.word, self.word_end = re.compile(rf"[^{SPACE}]*"), re.compile(rf"[^{SPACE}][{SPACE}]")
        self.white = re.compile(rf"[{SPACE}]")
        self.pool: ThreadPoolExecutor | None = None
        names = self.merges.bytes | {k: t.encode() for t, k in self.added.items()}
        self.token_bytes = [names[k] for k in range(max(names) + 1)]
        self.decimal = [str(k) for k in range(len(self.token_bytes))]
        self.sizes = list(map(len, self.token_bytes))
        self.leaf = self.by_pieces if self.fast is None else self.fast.encode_ordinary
        if self.fast is not None:
            self.merges.compiled = self.fast._encode_single_piece

    def threads(self) -> ThreadPoolExecutor:
        self.pool = self.pool or ThreadPoolExecutor(THREADS)
        return self.pool

    def by_pieces(self, text: str) -> list[int]:
        """Each piece by itself, long ones by tree concatenation, their leaves in parallel if there are many."""
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            data = piece.encode()
            ids += self.merges.encode(data, pool=self.threads() if len(data) >= PARALLEL * LEAF else None)
        return ids

    def stretches(self, text: str) -> Iterator[tuple[bool, int, int]]:
        """(whether it is a long run, start, end): text cut where words end and white space begins, so that long runs stand alone."""
        # A long run would fill one of these parts with white space, or without any.
        parts = (text[k: k + LONG // 2] for k in range(0, len(text) - LONG // 2 + 1, LONG // 2))
        if not any(" " not in part or part.isspace() for part in parts):
            yield False, 0, len(text)
            return
        at = 0
        for m in self.long_run.finditer(text):
            start, end = m.span()
            if start < at:
                continue
            if self.white.match(text, start):
                # The word after the white space may take its last character.
                end = self.word.match(text, end).end()
            else:
                while start > at and self.white.match(text, start - 1):
                    start -= 1
            if start > at:
                yield False, at, start
            yield True, start, end
            at = end
        if at < len(text):
            yield False, at, len(text)

    def plain(self, text: str) -> list[int]:
        """The ids of text without added tokens."""
        ids: list[int] = []
        for long, start, end in self.stretches(text):
            ids += self.by_pieces(text[start:end]) if long else self.tree(text, start, end)
        return ids

    def tree(self, text: str, start: int, end: int) -> list[int]:
        """The ids of a stretch without long runs, by tree concatenation."""
        count = -(-(end - start) // LEAF)
        if count <= 1:
            return self.leaf(text[start:end])
        cuts = [start + k * (end - start) // count for k in range(count + 1)]
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        nodes = list(self.threads().map(self.leaf, leaves) if count >= PARALLEL else map(self.leaf, leaves))
        while len(nodes) > 1:
            joined = [self.join(text, *cuts[k: k + 3], *nodes[k: k + 2]) for k in range(0, len(nodes) - 1, 2)]
            nodes = joined + nodes[len(joined) * 2:]
            cuts = [*cuts[:-1:2], cuts[-1]]
        return nodes[0]

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of ``text[start:end]``, of those of its halves."""
        # Nearly always the nearest blanks will do.
        width, begin, stop = 16, text.rfind(" ", start, middle), text.find(" ", middle, end)
        begin = begin if begin > start and not text[begin - 1].isspace() else None
        stop = stop if stop > middle and not text[stop - 1].isspace() else None
        while begin is None or stop is None:
            a, b = max(start, middle - width), min(end, middle + width)
            if begin is None:
                # The last place before the boundary; the half's own start if it has none.
                places = [m.start() + 1 for m in self.word_end.finditer(text, a, middle)]
                begin = places[-1] if places else start if a == start else None
            if stop is None:
                place = self.word_end.search(text, middle, b)
                stop = place.start() + 1 if place else end if b == end else None
            width *= 2
        # The tokens of both sides that the window stands in for.
        sizes, kept, gone = self.sizes, len(left), 0
        size = len(text[begin:middle].encode())
        while size > 0:
            kept -= 1
            size -= sizes[left[kept]]
        size = len(text[middle:stop].encode())
        while size > 0:
            size -= sizes[right[gone]]
            gone += 1
        return left[:kept] + self.leaf(text[begin:stop]) + right[gone:]

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(t in text for t in self.added):
            return self.plain(text)
        ids: list[int] = []
        for part in self.split_added.split(text):
            ids += [self.added[part]] if part in self.added else self.plain(part)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.ids(text), "<u4")

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


# How the lower-case vocabulary's file cuts words.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


#: Stands for the end of a word where compiled code merges words; text that holds it takes the plain way.
END = "\x00"


class WordBpe:
    """Encodes as the tokenizers library does with a lower-case word BPE file (white space dropped, no special tokens added)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.merges = Merges(file["model"])
        self.leaf, self.ids = self._leaf(file["model"])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.pieces = regex.compile(WORD_PATTERN)
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.space = re.compile(rf"[{SPACE}]+")
        self.words = Remembered(self.word, "")

    def _leaf(self, model: dict):
        """Compiled code for pieces that end with ``END``, and the file's id for each of its ranks.

        The symbols that end a word are made first, of their byte and ``END``; then the merges follow in their order.
        """
        ids, suffix = model["vocab"], self.merges.suffix
        names = [bytes([b]) for b in range(256)] + [bytes([b]) + END.encode() for b in range(256)]
        numbers = [*self.merges.inner, *self.merges.last]
        for a, b in model["merges"]:
            k = ids[(a.removesuffix(suffix) if suffix else a) + b]
            names.append(self.merges.bytes[k] + END.encode() * b.endswith(suffix))
            numbers.append(k)
        ranks = {name: rank for rank, name in enumerate(names)}
        if len(ranks) != len(names):
            return None, None
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, numbers

    def piece(self, text: str) -> bytes:
        if self.leaf and len(text) <= WORD_LEAF and END not in text:
            return array("H", map(self.ids.__getitem__, self.leaf(text + END))).tobytes()
        return array("H", self.merges.encode(text.encode())).tobytes()

    def word(self, text: str) -> bytes:
        if text.isalpha():
            return self.piece(text)
        if len(text) > 1 and text[-1] in ".," and text[:-1].isalpha():
            # A mark after a word is a piece of its own; the word itself is often known.
            return self.words[text[:-1]] + self.words[text[-1]]
        return b"".join(map(self.piece, self.pieces.findall(text)))

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            # The library lower-cases each character by itself, without the final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        return b"".join(map(self.words.__getitem__, self.space.split(text) if self.odd_space.search(text) else text.split()))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u2")
        if not any(t in text for t in self.added):
            return np.frombuffer(self.plain(text), "<u2")
        return np.frombuffer(b"".join(array("H", [self.added[t]]).tobytes() if t in self.added else self.plain(t)
                                      for t in self.split_added.split(text) if t), "<u2")


def byte_bpe(path: str) -> ByteBpe:
    """The file's encoder, built once in each Python worker."""
    return model(("bytes", path), lambda: ByteBpe(path))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the token ids (32-bit little-endian), and the text they decode to."""
    def row(bpe: ByteBpe, text: str | None) -> tuple:
        ids = bpe.ids(text)
        return np.array(ids, "<u4").tobytes(), bpe.decode(ids)

    return _mapped(docs, path, id_col, text_col, row, [("ids", "binary", pa.binary()), ("decoded", "string", pa.string())])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, number of tokens, and SHA-256 of the decimal ids and of the decoded text."""
    def row(bpe: ByteBpe, text: str | None) -> tuple:
        ids = bpe.ids(text)
        return (len(ids), hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(bpe.decode(ids).encode()).hexdigest())

    return _mapped(docs, path, id_col, text_col, row,
                   [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, row, columns: list[tuple]) -> DataFrame:
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_"))
    names = [id_col, *(n for n, _, _ in columns)]

    modest_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = zip(*(row(bpe, t) for t in texts_of(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, kind) for v, (_, _, kind) in zip(values, columns))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"`{n}` {t}" for n, t, _ in columns)]))
