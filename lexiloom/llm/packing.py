"""Bounded-space online packing of token sequences.

Every partition tokenises its documents and keeps a fixed number of open windows. A document (or what is left of
it after whole windows are cut off) goes to the open window that it fits best. Where it fits none, the fullest
window is topped up with the head of the document, unless the gap is shorter than ``min_piece``, and emitted.
Windows still open at the end of a partition are merged in rounds: a group of at most ``fan_in`` partitions is
packed by the same rule, so no task ever holds more than ``fan_in * open_windows`` windows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, whole_text

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: Emitted pieces that a task holds before it hands them on.
MOST_HELD = 1000
#: Python's str.split() takes these for white space, the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: How the tokenizer file cuts a lower-cased text, and the bytes that its alphabet writes as themselves.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Texts on which a file that cuts or writes otherwise shows itself.
PROBES = ["Don't we'll I'm you've he'd they're It's", "A1b22 c-d e_f ...!? x,y; (z)", "".join(map(chr, PLAIN_BYTES)), "naïve Straße ÉTÉ ÿ£¥", " two  spaces\n\tand lines ", "wonderfully uncharacteristically"]


class WordTokens:
    """Token ids of texts, by a tokenizer that drops white space and never joins across it.

    Words free of white space are kept with their ids, up to ``most`` of them, and their parts, up to three times as
    many; then that memory is emptied. Printable words of ASCII and Latin-1 are cut here and given to the tokenizer's model; any
    others go through the whole tokenizer. A file that doesn't work like that is refused: the ids of PROBES show it.
    """

    def __init__(self, path: str, most: int = 300_000, longest: int = 64):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.words, self.parts, self.cut = {}, {}, regex.compile(CUTS).findall
        self.model = self.tokenizer.model
        other = [b for b in range(256) if b not in set(PLAIN_BYTES)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(other)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        for text in PROBES:
            if array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() != self.encode(text):
                raise ValueError(f"{path} cuts texts in another way than words of lower case without white space")

    def _part(self, part: str) -> bytes:
        written = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        found = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        if len(part) <= self.longest:
            if len(self.parts) > 3 * self.most:
                self.parts.clear()
            self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        if max(word) >= "\u0100" or not word.isprintable() or ("<|" in word and any(s in word for s in self.special)):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        known = self.parts.get(word)
        if known is not None:
            return known
        core = word.rstrip(".,!?;:*%$&#")
        parts = [core, word[len(core) :]] if core.isalpha() else self.cut(word)
        return b"".join([self.parts.get(p) or self._part(p) for p in parts if p])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w] if any(c in text for c in SEPARATORS) else text.split()
        found = list(map(self.words.get, words))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    word = words[at]
                    found[at] = ids = self.words.get(word) or self._word(word)
                    if len(word) <= self.longest:
                        self.words[word] = ids
            if len(self.words) > self.most:
                self.words.clear()
        return b"".join(found)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


class Packer:
    """Windows of ``size`` tokens, ``open_windows`` of them open. ids: bytes, 4 for a token."""

    def __init__(self, first_id: int, size: int, open_windows: int, min_piece: int):
        self.next_id, self.size, self.most, self.min_piece = first_id, size, open_windows, min_piece
        self.gaps: list[int] = []
        self.windows: list[list[tuple]] = []
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.done.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.next_id, at, ids))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        width = 4 * self.size
        while len(ids) >= width:
            self._emit([(doc_id, start, ids[:width], doc_tokens)])
            start, ids = start + self.size, ids[width:]
        while ids:
            n = len(ids) // 4
            fit = min((g for g in self.gaps if g >= n), default=None)
            if fit is None and len(self.gaps) < self.most:
                self.gaps.append(fit := self.size)
                self.windows.append([])
            if fit is not None:
                at = self.gaps.index(fit)
                self.windows[at].append((doc_id, start, ids, doc_tokens))
                self.gaps[at] -= n
                if not self.gaps[at]:
                    self._emit(self.windows.pop(at))
                    self.gaps.pop(at)
                return
            at = self.gaps.index(gap := min(self.gaps))
            pieces = self.windows.pop(at)
            self.gaps.pop(at)
            if gap >= self.min_piece:
                pieces.append((doc_id, start, ids[: 4 * gap], doc_tokens))
                start, ids = start + gap, ids[4 * gap :]
            self._emit(pieces)

    def close(self) -> None:
        """Lay the open windows end to end and cut at whole windows: one sequence at most is not full."""
        row, room, windows = [], self.size, self.windows
        self.gaps, self.windows = [], []
        for doc_id, start, ids, doc_tokens in (p for w in windows for p in w):
            while ids:
                head, ids = ids[: 4 * room], ids[4 * room :]
                row.append((doc_id, start, head, doc_tokens))
                start, room = start + len(head) // 4, room - len(head) // 4
                if not room:
                    self._emit(row)
                    row, room = [], self.size
        if row:
            self._emit(row)

    def take(self, keep_ids: bool) -> pd.DataFrame:
        """What was emitted since the last call."""
        done, self.done = self.done, []
        return _frame(done if keep_ids else [(*x[:7], None) for x in done], None)

    def left(self) -> pd.DataFrame:
        """The pieces of the open windows. group: 0 at first."""
        rows = [(d, s, len(i) // 4, 0, n, w, k, i) for w, pieces in enumerate(self.windows) for k, (d, s, i, n) in enumerate(pieces)]
        return _frame(rows, 0)


def _frame(rows: list[tuple], group: int | None) -> pd.DataFrame:
    rows = [(*x[:7], None if x[7] is None else np.frombuffer(x[7], dtype="<i4")) for x in rows]
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    return out.astype({"doc_id": "Int64"}).assign(part=pd.array([group] * len(out), dtype="Int64"))


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, size: int = 2048, open_windows: int = 16, min_piece: int = 16, fan_in: int = 64, keep_ids: bool = False) -> DataFrame:
    """Pack the whole texts of ``docs`` (``doc_id``, ``text``) into sequences of at most ``size`` tokens.

    A document is its token ids and then ``end_id``. A row for each piece: doc_id, start (the document's ids before
    it), length, ids_crc32, doc_tokens, sequence_id, offset; with ``keep_ids`` also ids (array of int). Other columns
    of ``docs`` are not read. A null or empty text is ``end_id`` alone; a null doc_id stays null; repeated rows are
    documents of their own; an empty table gives no rows. All sequences but one of the last round hold ``size``
    tokens, less a gap shorter than ``min_piece``.
    """
    settings = (size, open_windows, min_piece)
    tail = np.array([end_id], dtype="<u4").tobytes()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode, packer = word_tokens(tokenizer).encode, Packer(part << 32, *settings)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                ids = encode(text) + tail
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(packer.done) >= MOST_HELD:
                    yield packer.take(keep_ids)
        yield packer.take(keep_ids)
        yield packer.left().assign(part=part)

    schema = f"{PIECES}, part long"
    source = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = materialise(source.mapInPandas(first, schema), "packed")
    done, left = [rows.filter("part is null")], rows.filter("part is not null")
    parts = left.agg(F.max("part")).first()[0]
    level = 0
    while parts is not None:
        last, level = parts < fan_in, level + 1
        merge = _merging(level, last, settings, fan_in, keep_ids)
        rows = materialise(left.groupBy((F.col("part") / fan_in).cast("long")).applyInPandas(merge, schema), "packed")
        done.append(rows.filter("part is null"))
        left = rows.filter("part is not null")
        parts = None if last else parts // fan_in
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part") if keep_ids else out.drop("part", "ids")


def _merging(level: int, last: bool, settings: tuple, fan_in: int, keep_ids: bool):
    """The open windows of up to ``fan_in`` packers go through one packer more."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "sequence_id", "offset"])
        to = int(group["part"].iloc[0]) // fan_in
        packer = Packer(level << 58 | to << 32, *settings)
        for doc_id, start, ids, doc_tokens in zip(group["doc_id"].astype("Int64").array, group["start"], group["ids"], group["doc_tokens"], strict=True):
            packer.add(doc_id, int(start), np.asarray(ids, dtype="<i4").tobytes(), int(doc_tokens))
        if last:
            packer.close()
        done = packer.take(keep_ids)
        return done if last else pd.concat([done, packer.left().assign(part=to)])

    return merge
