"""Token counts by compiled finite-state machines of a byte-level BPE tokenizer.

Two deterministic transducers stand for the tokenizer.  ``SEGMENT`` reads character classes and marks where the words of
the tokenizer's pattern start; texts are cut into chunks, every chunk is run from every state at once, and the chunks'
state maps are composed by a parallel prefix scan.  ``WordMachine`` reads the bytes of a word; its transitions carry the
number of tokens that the byte adds.  It is determinised as it is needed.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgets, id_type, map_texts

#: Characters of a chunk.
CHUNK = 256

#: Transitions, words and pairs of tokens that a Python worker remembers.
MEMO_STEPS, MEMO_WORDS, MEMO_PAIRS = 400_000, 300_000, 200_000

# --- segmentation ----------------------------------------------------------------------------------------------------

#: Character classes: letters by the part they play in contractions, numbers, space, other white space, apostrophe,
#: others, and the end of a text.
LETTER, STMD, R, V, E_, L_, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)

#: States: at a start; in letters, numbers, others; after one space or other white character; after several, the last
#: being a space or not; after an apostrophe that may begin a contraction, also with r, v or l behind it.
START, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, MARK, MARK_R, MARK_V, MARK_L = range(12)

#: What a transition emits: a word starts at this character, or at the one before.
HERE, BEFORE = 1, 2

_IS_LETTER = {LETTER, STMD, R, V, E_, L_}


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and emissions of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|white+(?!other than white)|white+``."""

    def fresh(c: int) -> int:
        if c in _IS_LETTER:
            return LETTERS
        return {NUMBER: NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: MARK, OTHER: OTHERS, END: START}[c]

    def run_state(c: int) -> int:  # a word that goes on after an attached space
        return OTHERS if c == QUOTE else fresh(c)

    def step(state: int, c: int) -> tuple[int, int]:
        if c == END:
            return START, HERE | (BEFORE if state in (MARK_R, MARK_V, MARK_L) else 0)
        if state == START:
            return fresh(c), HERE
        if state == LETTERS:
            return (LETTERS, 0) if c in _IS_LETTER else (fresh(c), HERE)
        if state == NUMBERS:
            return (NUMBERS, 0) if c == NUMBER else (fresh(c), HERE)
        if state == OTHERS:
            return (OTHERS, 0) if c in (OTHER, QUOTE) else (fresh(c), HERE)
        if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
            if c in (SPACE, WHITE):
                return (MORE_SPACE if c == SPACE else MORE_WHITE), 0
            last = BEFORE if state in (MORE_SPACE, MORE_WHITE) else 0  # the last white character leaves the run
            return (run_state(c), last) if state in (ONE_SPACE, MORE_SPACE) else (fresh(c), last | HERE)
        if state == MARK:
            if c == STMD:
                return START, 0
            if c in (R, V, L_):
                return {R: MARK_R, V: MARK_V, L_: MARK_L}[c], 0
            return (OTHERS, 0) if c in (OTHER, QUOTE) else (fresh(c), HERE)
        if (state, c) in ((MARK_R, E_), (MARK_V, E_), (MARK_L, L_)):
            return START, 0
        after, emitted = step(LETTERS, c)
        return after, emitted | BEFORE

    table = [[step(s, c) for c in range(12)] for s in range(12)]
    return np.array([[x[0] for x in row] for row in table], np.uint8), np.array([[x[1] for x in row] for row in table], np.uint8)


NEXT, EMIT = _compile()

#: A code point that was not met so far.
UNKNOWN = 255


class Classes:
    """The class of every code point, as the tokenizer's own split has it, found when it is first met."""

    def __init__(self, split) -> None:
        self.split = split
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.learn(range(128))
        for text, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("e", E_), ("l", L_)):
            self.table[[ord(x) for x in text]] = c

    def learn(self, points) -> None:
        """A letter goes on a word of letters, a number one of numbers, others one of others; white space none of them."""
        for point in points:
            self.table[point] = next((c for head, c in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(self.split(head + chr(point))) == 1), WHITE)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        if (kinds == UNKNOWN).any():
            self.learn(np.unique(points[kinds == UNKNOWN]).tolist())
            kinds = self.table[points]
        return kinds


def compose(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of state maps (chunk x state): row i leads from a state before chunk 0 to the one after i."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), 1)
        reach *= 2
    return maps


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which words start in a sequence of classes that begins at START."""
    n = -(-len(kinds) // CHUNK)
    padded = np.full(n * CHUNK, END, np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T).astype(np.int64)
    flat = NEXT.ravel()
    maps = np.tile(np.arange(12, dtype=np.int64), (n, 1))
    for column in columns:
        maps = flat[maps * 12 + column[:, None]].astype(np.int64)
    states = np.concatenate(([START], compose(maps)[:-1, START])).astype(np.int64)
    emitted = np.empty((CHUNK, n), np.uint8)
    out = EMIT.ravel()
    for i, column in enumerate(columns):
        at = states * 12 + column
        emitted[i] = out[at]
        states = flat[at].astype(np.int64)
    marks = emitted.T.ravel()[: len(kinds)]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts)


# --- words -----------------------------------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counts(dict):
    """Tokens of words; what the generation before knew is kept."""

    def __init__(self, machine: WordMachine, old: dict[str, int]) -> None:
        super().__init__()
        self.machine, self.old = machine, old

    def __missing__(self, word: str) -> int:
        found = self.old.get(word)
        if found is None:
            found = self.machine.count(word.encode("utf-8", "surrogatepass"))
        self[word] = found
        return found


class WordMachine:
    """Deterministic transducer from the bytes of a word to its number of tokens.

    The tokens of a word are the only sequence of its bytes whose neighbours are compatible: no merge of theirs would
    have crossed the border between them.  So the last token of every prefix is found from the last tokens of shorter
    prefixes, and a state needs to hold only those prefixes from which a token may still grow: the longest suffix that
    starts some token and, at each of its places from which the rest starts a token, the last token before it and the
    relative count.  Transitions are made when they are first taken, and forgotten beyond MEMO_STEPS.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        raw = {t: bytes(byte[c] for c in t) for t in spec["model"]["vocab"] if all(c in byte for c in t)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {b: i for i, b in enumerate(raw.values())}
        number = {t: self.tokens[b] for t, b in raw.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((number[a], number[b]), rank)
            self.made.setdefault(number[a + b], (rank, number[a], number[b]))
        self.heads = {b[:i] for b in self.tokens for i in range(len(b))}
        from tokenizers import Tokenizer

        self.classes = Classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._reset()
        self.counts = Counts(self, {})

    def _reset(self) -> None:
        first = (b"", (-1,), (0,))
        self.ids, self.states, self.steps = {first: 0}, [first], {}
        self.moves: dict[tuple[bytes, int], tuple[bytes, list[tuple[int, int]], list[int]]] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def _places(self, suffix: bytes) -> list[int]:
        """Where in a suffix a token may still begin; always at its end."""
        return [p for p in range(len(suffix) + 1) if suffix[p:] in self.heads]

    def _move(self, suffix: bytes, byte: int) -> tuple[bytes, list[tuple[int, int]], list[int]]:
        """What a byte does to a suffix: (the next one, (place, token) that end here, longest first, places that stay open)."""
        text, places = suffix + bytes((byte,)), self._places(suffix)
        ends = [(i, self.tokens[text[p:]]) for i, p in enumerate(places) if text[p:] in self.tokens]
        cut = next(c for c in range(len(text) + 1) if text[c:] in self.heads)
        return text[cut:], ends, [i for i, p in enumerate(places) if p >= cut and text[p:] in self.heads]

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that lie at a token's right (or left) edge while it is made, with the rank that ends each."""
        if (token, right) not in self.spines:
            out, end = [], float("inf")
            at = token
            while True:
                out.append((at, end))
                if at not in self.made:
                    break
                rank, a, b = self.made[at]
                at, end = (b if right else a), rank
            self.spines[token, right] = out
        return self.spines[token, right]

    def compatible(self, left: int, right: int) -> bool:
        """No merge crosses the border: each possible one comes after its left side is used up, or (equal ranks go from
        left to right) not before its right side is."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            found = self.known[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        for x, x_end in self._spine(left, True):
            for y, y_end in self._spine(right, False):
                rank = self.pairs.get((x, y))
                if rank is not None and rank < x_end and rank <= y_end:
                    return False
        return True

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        move = self.moves.get((suffix, byte))
        if move is None:
            move = self.moves[suffix, byte] = self._move(suffix, byte)
        suffix, ends, stay = move
        for at, token in ends:
            if last[at] == -1 or self.compatible(last[at], token):
                break
        added = counts[at] + 1
        key = (suffix, (*[last[i] for i in stay], token), (*[counts[i] - added for i in stay], 0))
        found = self.ids.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
        self.steps[state << 8 | byte] = found, added
        return found, added

    def count(self, word: bytes) -> int:
        if len(self.steps) > MEMO_STEPS:
            self._reset()
        state = total = 0
        steps = self.steps
        for byte in word:
            found = steps.get(state << 8 | byte)
            state, added = found if found is not None else self._step(state, byte)
            total += added
        return total

    def segments(self, text: str) -> list[str]:
        """A text between its special strings, which are one token each."""
        out = [text]
        for special in self.special:
            out = [part for piece in out for part in piece.split(special)]
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.counts) > MEMO_WORDS:
            self.counts.old = {}
            self.counts = Counts(self, self.counts)
        totals = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            own = self.segments(text) if any(s in text for s in self.special) else [text]
            totals[i] += len(own) - 1
            parts += own
            owner += [i] * len(own)
        big = "\0".join(parts) + "\0"
        points = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes.of(points)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        starts = word_starts(kinds)
        real = kinds[starts] != END
        stops = np.append(starts[1:], len(points))[real].tolist()
        starts = starts[real]
        words = (big[a:b] for a, b in zip(starts.tolist(), stops, strict=True))
        each = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(starts))
        np.add.at(totals, np.array(owner)[np.searchsorted(ends, starts)], each)
        return totals


_machines: dict[str, WordMachine] = {}
forgets(_machines.clear)


def machine(path: str) -> WordMachine:
    if path not in _machines:
        _machines[path] = WordMachine(path)
    return _machines[path]


def _count(path: str):
    def run(docs) -> Iterator[dict]:
        gc.disable()  # transitions are many objects and no cycles
        try:
            for ids, texts, _ in docs:
                yield {"id": ids, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": machine(path).texts(texts)}
        finally:
            gc.enable()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the byte-level BPE tokenizer file (with the usual split pattern) for the whole text, its special
    strings being one token each; null and empty texts have none.  Rows are counted where they lie, in bounded steps; rows
    that repeat an id, or have none, are counted each.  An empty table gives an empty result; only the id and the text are
    read, so no name can clash.
    """
    out = map_texts(docs, _count(tokenizer), f"id {id_type(docs, id_col)}, n_bytes long, n_tokens long", id_col, text_col)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
