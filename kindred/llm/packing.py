"""Packing of token sequences into fixed windows: sum-of-squares placement over a level array."""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import forgets, id_type, map_texts

#: Encoded chunks of text that a Python worker remembers in each of two generations, and bytes of the longest that it does.
MEMO_CHUNKS, LONGEST = 100_000, 64

#: Windows that a packer keeps open; beyond it the pieces of the fuller half are joined into full windows, which bounds its memory.
MOST_OPEN = 2048

_encoders: dict[tuple[str, int, int], Encoder] = {}
forgets(_encoders.clear)


#: Characters that the tokenizer never joins with a letter or digit before them.
_MARKS = b".,!%&*$#|?;:"

#: Words of small letters of Latin-1 alone, as UTF-8: lower case, composed, and of letters only.
_PLAIN = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

#: Byte-level models read bytes as characters: printable ones as they are, the others from 256 on.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173))}


# The normaliser and split of the tokenizer whose texts may be encoded chunk by chunk.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_chunks(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits words as ``Chunks`` takes for granted."""
    found = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, *rest = found[1]
    return (
        found[0] == _NORMALIZERS and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [x.get("type") for x in rest] == ["ByteLevel"] and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex")
        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        and all(not any(t.get(k) for k in ("normalized", "single_word", "lstrip", "rstrip")) for t in spec["added_tokens"])
    )


class Chunks(dict):
    """Ids of lower-cased chunks between white space, as little-endian 32-bit bytes; what the generation before knew is kept.

    A chunk that ends in marks after an ASCII letter or digit is encoded as the part before them and the marks; one of small
    Latin-1 letters, which the tokenizer leaves as one word, by its model at once; any other by the whole tokenizer."""

    def __init__(self, tokenizer, old: Chunks | None = None) -> None:
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, old or {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            stem = chunk.rstrip(_MARKS)
            if len(stem) < len(chunk) and stem[-1:].isalnum():
                found = self[stem] + self[chunk[len(stem) :]]
            else:
                if chunk.isalpha():
                    ids = [t.id for t in self.model.tokenize(chunk.decode())]
                elif _PLAIN.fullmatch(chunk):
                    ids = [t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(_BYTE_CHARS))]
                else:
                    ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found


class Encoder:
    """Token ids, as little-endian 32-bit bytes, of whole texts.

    If no token of the tokenizer spans white space and its normaliser changes nothing across it (``by_chunks``), a text is
    encoded as the sequence of its chunks between ``[\x20\x09-\x0D]``.  Texts that hold a special string in any case, and all
    texts of other tokenizers, are given to the library as they are.
    """

    def __init__(self, path: str, end: int, memo: int = MEMO_CHUNKS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_chunks = by_chunks(json.load(f))
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end], "<u4").tobytes()
        self.memo, self.chunks = memo, Chunks(self.tokenizer)

    def _library(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts in UTF-8."""
        for text in texts:
            if len(self.chunks) > self.memo:
                self.chunks.old = {}
                self.chunks = Chunks(self.tokenizer, self.chunks)
            low = text.lower()
            if not self.by_chunks or any(s in low for s in self.special):
                yield self._library(text) + self.end
            else:
                yield b"".join(map(self.chunks.__getitem__, low.split())) + self.end


def encoder(path: str, end: int, memo: int) -> Encoder:
    if (path, end, memo) not in _encoders:
        _encoders[path, end, memo] = Encoder(path, end, memo)
    return _encoders[path, end, memo]


class SumOfSquares:
    """Online packing of pieces into windows of ``size``.

    ``level[h]`` counts the open windows that are filled to h.  A piece of length r goes to the level (or to a new window)
    for which the sum of squares of the counts afterwards is least; at a tie to the fullest.  Documents longer than a
    window are first cut into full windows.  ``close`` joins the pieces of the windows that are still open, in order of
    their fill, into full windows; what is left at the end, less than one window, is cut into windows whose lengths are
    powers of two.  Every piece is given as (document, start, length, window, offset).
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple[int, int, int, bytes]]]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, length: int) -> int:
        """The fill level to put a piece of this length on; 0 is a new window."""
        top = self.size - length
        after = self.level[length : self.size + 1]
        before = self.level[: top + 1]
        change = 2 * (after - before) + 2  # one count leaves h, one joins h + length
        change[top] = 1 - 2 * before[top]  # a full window is no longer counted
        usable = before > 0
        change = np.where(usable, change, np.iinfo(np.int64).max)
        change[0] = 2 * after[0] + 1 if length < self.size else 0
        return top - int(np.argmin(change[::-1]))

    def add(self, doc: int, ids: bytes) -> list[tuple[int, int, int, int, int, int]]:
        out, start, total = [], 0, len(ids) // 4
        while total - start >= self.size:
            out.append((doc, start, self.size, zlib.crc32(ids[4 * start : 4 * (start + self.size)]), self.window(), 0))
            start += self.size
        rest = total - start
        if rest:
            h = self.place(rest)
            held = self.open[h].pop() if h else []
            self.level[h] -= 1 if h else 0
            held.append((doc, start, rest, ids[4 * start :]))
            if h + rest == self.size:
                out += self._emit(held)
            else:
                self.open[h + rest].append(held)
                self.level[h + rest] += 1
                if self.level.sum() > MOST_OPEN:
                    out += self._join(MOST_OPEN // 2)
        return out

    def _emit(self, held: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int, int, int]]:
        window, at, out = self.window(), 0, []
        for doc, start, length, ids in held:
            out.append((doc, start, length, zlib.crc32(ids), window, at))
            at += length
        return out

    def _join(self, leave: int = 0) -> list[tuple[int, int, int, int, int, int]]:
        """Join the pieces of open windows, fullest first, into full windows, until ``leave`` windows are left as they are.

        The rest, less than a window, is one open window if others are left, else it is cut into windows of powers of two."""
        pieces, still, last = [], int(self.level.sum()), not leave
        for fill in range(self.size, 0, -1):
            while self.open[fill] and still > leave:
                pieces += self.open[fill].pop()
                self.level[fill] -= 1
                still -= 1
        left = sum(p[2] for p in pieces)
        out, held, room = [], [], 0
        for doc, start, length, ids in pieces:
            at = 0
            while at < length:
                if not room:
                    room = self.size if left >= self.size or not last else 1 << (left.bit_length() - 1)
                n = min(room, length - at)
                held.append((doc, start + at, n, ids[4 * at : 4 * (at + n)]))
                at, room, left = at + n, room - n, left - n
                if not room:
                    out += self._emit(held)
                    held = []
        if held:
            fill = sum(p[2] for p in held)
            self.open[fill].append(held)
            self.level[fill] += 1
        return out

    def close(self) -> list[tuple[int, int, int, int, int, int]]:
        return self._join()


def _pack(encode: Callable[[], Encoder], size: int):
    def run(docs) -> Iterator[dict]:
        gc.disable()  # the words of a step are many objects and no cycles; looking for some takes a third of the time
        try:
            yield from packed(docs)
        finally:
            gc.enable()

    def packed(docs) -> Iterator[dict]:
        packer, tokens = SumOfSquares(size), encode()
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36
        types = None

        def rows(ids: pa.Array, pieces: list[tuple[int, int, int, int, int, int]], totals: list[int]) -> dict:
            columns = list(zip(*pieces, strict=True)) or [()] * 6
            doc = np.array(columns[0], np.int64)
            return {
                "id": ids.take(pa.array(doc)), "start": list(columns[1]), "length": list(columns[2]), "ids_crc32": list(columns[3]),
                "doc_tokens": [totals[i] for i in columns[0]], "sequence_id": [first + w for w in columns[4]], "offset": list(columns[5]),
            }

        # Ids and lengths of the documents that have pieces in open windows.
        waiting: dict[int, tuple[object, int]] = {}
        count = 0
        for ids, texts, _ in docs:
            types, own = ids.type, ids.to_pylist()
            pieces = []
            for key, data in zip(own, tokens.encode(texts), strict=True):
                waiting[count] = (key, len(data) // 4)
                pieces += packer.add(count, data)
                count += 1
            known = {p[0] for p in pieces}
            place = {d: i for i, d in enumerate(known)}
            yield rows(
                pa.array([waiting[d][0] for d in known], types), [(place[p[0]], *p[1:]) for p in pieces], [waiting[d][1] for d in known]
            )
            if len(waiting) > 4 * size:
                still = {p[0] for fill in packer.open for held in fill for p in held}
                waiting = {d: x for d, x in waiting.items() if d in still}
        if types is not None:
            pieces = packer.close()
            known = sorted({p[0] for p in pieces})
            place = {d: i for i, d in enumerate(known)}
            yield rows(
                pa.array([waiting[d][0] for d in known], types), [(place[p[0]], *p[1:]) for p in pieces], [waiting[d][1] for d in known]
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO_CHUNKS
) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text by the tokenizer file, without added special tokens, then ``end``; a null or
    empty text is ``end`` alone.  Each partition packs its documents online as they come (``SumOfSquares``) and holds the
    open windows only, of which there are at most ``MOST_OPEN``.  Sequences are ``size`` long or a power
    of two, so none needs padding.  Rows that repeat an id, or have none, are documents of their own.  An empty table gives an
    empty result; only the id and the text are read, so no name can clash.  ``memo`` bounds what a worker remembers: more of
    it costs memory and saves time.  A lost task packs its partition again with the same result.
    """
    schema = (
        f"id {id_type(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )

    def encode() -> Encoder:
        return encoder(tokenizer, end, memo)

    return map_texts(docs, _pack(encode, size), schema, id_col, text_col, encoded=True).withColumnRenamed("id", "doc_id")
