"""Alignment of two tokenizers' tokens by the bytes they cover, and how often their tokens are linked in a corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import bucketed_table, scratch, shared_table
from .common import forgets, id_type, map_texts, shuffle_partitions

#: Links of documents that are counted together in a task: the pairs they repeat leave it once.
BLOCK_LINKS = 1 << 21

#: Pairs of ids in one row that leaves a task.
PIECE = 4096

#: Parts that each pair's counts are first added up in.
SALTS = 8

_loaded: dict[tuple[str, str], Aligner] = {}
forgets(_loaded.clear)


def byte_level(char_of: dict[str, int], token: str) -> bytes:
    """Bytes of a token that is written in the characters that stand for bytes."""
    return bytes(char_of[c] for c in token)


def byte_characters() -> dict[str, int]:
    """Byte-level models write printable bytes as themselves, the others as characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokens:
    """Tokens of several texts, one after the other: ids and byte ends of both sides, and the byte end of each text."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    ends: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes where tokens of both sides end, the group of each token of a, and of b)."""
        cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        return cuts, np.searchsorted(cuts, self.ends_a), np.searchsorted(cuts, self.ends_b)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (in a, in b) of all pairs of tokens whose bytes overlap.  Those of an a are next to each other."""
        starts_a, starts_b = (np.concatenate(([0], e[:-1])) if len(e) else e for e in (self.ends_a, self.ends_b))
        first = np.searchsorted(self.ends_b, starts_a, "right")
        count = np.searchsorted(starts_b, self.ends_a, "left") - first
        before = np.cumsum(count) - count
        return np.repeat(np.arange(len(count)), count), np.arange(int(count.sum())) + np.repeat(first - before, count)

    def upto(self, ends: np.ndarray) -> np.ndarray:
        """Number of entries of rising byte ends in each text and those before it."""
        return np.searchsorted(ends, self.ends, "right")


# Fixed value: how the byte-level pre-tokenizer splits texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_ranks(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE whose merges come in the order of their ids, so that ids are ranks."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    vocab, chars = model["vocab"], byte_characters()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    last = max(vocab.get(c, 1 << 40) for c in chars)
    return merged == sorted(set(merged)) and (not merged or merged[0] > last) and len(merged) + 256 == sum(all(c in chars for c in t) for t in vocab if t not in {x["content"] for x in spec.get("added_tokens", ())})


class Aligner:
    """Both tokenizers, and the bytes of their tokens by id.

    The first is run by the library that its file is for, or, where ids are ranks (``by_ranks``), by one that gives the same ids sooner."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(path_a)
        self.left.encode_special_tokens = True
        self.left.no_truncation()
        self.left.no_padding()
        self.right = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in chars for c in token):
                self.bytes_a[i] = byte_level(chars, token)
        self.bytes_b = [self._piece(i) for i in range(self.right.vocab_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.kind_a, self.kind_b = (np.min_scalar_type(len(t)).newbyteorder("<") for t in (self.bytes_a, self.bytes_b))
        self._written: np.ndarray | None = None
        self._ranked = None
        if by_ranks(spec):
            import tiktoken

            added = {x["content"] for x in spec.get("added_tokens", ())}
            ranks = {self.bytes_a[i]: i for t, i in vocab.items() if self.bytes_a[i] and t not in added}
            self._ranked = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        if self.right.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @property
    def written(self) -> np.ndarray:
        """Ids of a, then those of b, in decimal; each followed by a comma, a bar, a semicolon or nothing."""
        if self._written is None:
            names = [b"%d" % i for n in (len(self.bytes_a), len(self.bytes_b)) for i in range(n)]
            self._written = np.array([n + end for n in names for end in (b",", b"|", b";", b"")], object)
        return self._written

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where a side doesn't give back a space and the text."""
        full = [i for i, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], []) for _ in texts]
        some = [texts[i] for i in full]
        if self._ranked:
            left = [self._ranked.encode_ordinary(" " + t) for t in some]
        else:
            left = [x.ids for x in self.left.encode_batch_fast([" " + t for t in some], add_special_tokens=False)]
        for i, text, a, b in zip(full, some, left, self.right.encode(some, num_threads=1), strict=True):
            want = b" " + text.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want:
                out[i] = a, b
        return out

    def tokens(self, a: np.ndarray, b: np.ndarray, counts_a: np.ndarray) -> Tokens:
        """Tokens of texts from their ids; ``counts_a`` tells how many ids of a each text has."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        return Tokens(a, b, ends_a, ends_b, np.concatenate(([0], ends_a))[np.cumsum(counts_a)])

    def pairs(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the linked ids, number of links up to the end of each text)."""
        la, lb = t.links()
        upto = np.searchsorted(la, t.upto(t.ends_a), "left")
        return t.a[la].astype(np.int64) * len(self.bytes_b) + t.b[lb], upto

    def digests(self, t: Tokens, label_a: np.ndarray, label_b: np.ndarray) -> list[str]:
        """Hash of each text's groups, written as ``a1,a2|b1;a3|b2,b3``; a text without tokens has none."""
        key = np.concatenate((2 * label_a, 2 * label_b + 1))
        order = np.argsort(key, kind="stable")
        key, upto = key[order], t.upto(t.ends_a) + t.upto(t.ends_b)
        end = np.zeros(len(key), np.int64)
        end[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[:-1] & 1, 2, 1))
        end[upto[upto > 0] - 1] = 3
        parts = self.written[np.concatenate((t.a, t.b + len(self.bytes_a)))[order] * 4 + end].tolist()
        begins = np.concatenate(([0], upto[:-1]))
        return [hashlib.sha256(b"".join(parts[s:e])).hexdigest() if e > s else "" for s, e in zip(begins.tolist(), upto.tolist(), strict=True)]


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter((i for own in ids for i in own), np.int64, sum(map(len, ids)))


def _each(upto: np.ndarray) -> np.ndarray:
    return np.diff(upto, prepend=0)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, a_ids, b_ids, a_groups, b_groups``, the groups counted from 0 in each document.

    A byte where a token of each side ends closes a group.  Texts that have no tokens (``alignment``) have empty arrays."""

    def run(texts_in) -> Iterator[dict]:
        tools = aligner(path_a, path_b)
        for ids, texts, _ in texts_in:
            found = tools.encode(texts)
            t = tools.tokens(_flat([a for a, _ in found]), _flat([b for _, b in found]), np.array([len(a) for a, _ in found]))
            cuts, label_a, label_b = t.groups()
            first = np.concatenate(([0], t.upto(cuts)[:-1]))
            out = {"id": ids, "a_ids": [a for a, _ in found], "b_ids": [b for _, b in found]}
            for name, label, ends in (("a_groups", label_a, t.ends_a), ("b_groups", label_b, t.ends_b)):
                upto = t.upto(ends)
                own = (label - np.repeat(first, _each(upto))).astype(np.int32)
                out[name] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)).astype(np.int32)), pa.array(own))
            yield out

    schema = f"id {id_type(docs, id_col)}, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>"
    return map_texts(docs, run, schema, id_col, text_col).withColumnRenamed("id", "doc_id")


def _blocks(path_a: str, path_b: str):
    """Rows of documents with their tokens, and, for each block of them, rows with the pairs of ids that their links hold."""

    def run(texts_in) -> Iterator[dict]:
        tools, task = aligner(path_a, path_b), TaskContext.get()
        block, codes, held, kind = (task.partitionId() if task else 0) << 36, [], 0, None

        def pairs() -> Iterator[dict]:
            found, times = np.unique(np.concatenate(codes), return_counts=True)
            for at in range(0, len(found), PIECE):
                own, n = found[at : at + PIECE], times[at : at + PIECE]
                none = [None]
                yield {
                    "block": [block], "id": pa.nulls(1, kind), "n_a": none, "n_b": none, "n_groups": none, "n_links": none, "groups_sha256": none, "a": none, "b": none,
                    "pairs": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own)),
                    "times": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n.astype(np.int64))),
                }

        for ids, texts, _ in texts_in:
            kind = ids.type
            found = tools.encode(texts)
            counts = np.array([len(a) for a, _ in found])
            t = tools.tokens(_flat([a for a, _ in found]), _flat([b for _, b in found]), counts)
            cuts, label_a, label_b = t.groups()
            code, links = tools.pairs(t)
            nothing = [None] * len(ids)
            yield {
                "block": [block] * len(ids), "id": ids, "n_a": counts, "n_b": _each(t.upto(t.ends_b)), "n_groups": _each(t.upto(cuts)), "n_links": _each(links),
                "groups_sha256": tools.digests(t, label_a, label_b),
                "a": [np.array(a, tools.kind_a).tobytes() for a, _ in found], "b": [np.array(b, tools.kind_b).tobytes() for _, b in found],
                "pairs": nothing, "times": nothing,
            }
            codes.append(code)
            held += len(code)
            if held >= BLOCK_LINKS:
                yield from pairs()
                block, codes, held = block + 1, [], 0
        if held:
            yield from pairs()

    return run


def _summed(path_a: str, path_b: str):
    """Sums over the links of a block's documents from the counts of its pairs."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        tools = aligner(path_a, path_b)
        pair, n, best = (counts.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order].astype(np.int64)
        sizes, sums, bests = docs.column("n_a").to_numpy(), [], []
        bound = np.searchsorted(np.cumsum(sizes), np.arange(0, max(1, int(sizes.sum())), 1 << 18))
        for s, e in zip(bound, [*bound[1:], docs.num_rows], strict=True):  # some documents at a time
            part = docs.slice(s, e - s)
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), k).astype(np.int64) for c, k in (("a", tools.kind_a), ("b", tools.kind_b)))
            code, upto = tools.pairs(tools.tokens(a, b, part.column("n_a").to_numpy()))
            at = np.searchsorted(pair, code)
            for out, values in ((sums, n), (bests, best)):
                out.append(np.diff(np.concatenate(([0], np.cumsum(values[at])))[upto], prepend=0))
        columns = {c: docs.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": np.concatenate(bests), "count_sum": np.concatenate(sums), "groups_sha256": docs.column("groups_sha256")})

    return run


def _counted(blocks: DataFrame) -> DataFrame:
    """``pair, n`` over all blocks: first under a salt, then over salts."""
    rows = blocks.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS))
    parts = rows.groupBy(F.col("x.pairs").alias("pair"), salt.alias("salt")).agg(F.sum("x.times").alias("n"))
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def _vocabulary(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a_id, b_id, n, best``: how many links of the corpus hold a pair of ids, and whether no other of its B id has more."""
    with scratch() as own:
        return own.keep(_paired(_written_blocks(docs, path_a, path_b, id_col, text_col), path_b), "pair-counts").select("a_id", "b_id", "n", "best")


def _written_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    schema = (
        f"block long, id {id_type(docs, id_col)}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, "
        "pairs array<long>, times array<long>"
    )
    found = map_texts(docs, _blocks(path_a, path_b), schema, id_col, text_col)
    return bucketed_table(found, "aligned", shuffle_partitions(docs.sparkSession), "block", {"compression": "zstd"})


def _paired(blocks: DataFrame, path_b: str) -> DataFrame:
    size = _vocabulary(path_b)
    counted = shared_table(_counted(blocks).withColumn("b_id", F.pmod("pair", F.lit(size)).cast("int")), "pairs")
    # One row for each id of the vocabulary at most, however large the corpus.
    most = F.broadcast(counted.groupBy(F.col("b_id").alias("_b")).agg(F.max("n").alias("_most")))
    return counted.join(most, F.col("b_id") == F.col("_b")).select(
        "pair", ((F.col("pair") - F.col("b_id")) / size).cast("int").alias("a_id"), "b_id", "n", (F.col("n") == F.col("_most")).alias("best")
    )


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A space and the text by the tokenizer file of A, the text by the model of B, which adds the space; special strings are plain
    text.  Texts that are null or empty, or that a side doesn't give back (bytes that differ from the space and the text), have
    no tokens: zeros, and an empty string for the hash.  Bytes where tokens of both sides end cut them into groups; tokens whose
    bytes overlap are linked.  ``n_best`` counts the links whose pair of ids has the most links of its B id in the corpus, ties
    included, and ``count_sum`` adds up the links that the corpus has of each link's pair.

    Each task aligns its documents where they lie and writes their tokens once, with the pairs of each block of about two million
    links; pairs are counted under a salt and over salts, joined back to the blocks that hold them, and summed there.  A block's
    tokens don't move.  A very long text is a block of its own.  Rows that repeat an id, or have none, are documents of their own.  An
    empty table gives an empty result; only the id and the text are read, so no name can clash.
    """
    with scratch() as own:
        blocks = _written_blocks(docs, path_a, path_b, id_col, text_col)
        counts = shared_table(_paired(blocks, path_b), "counts").select("pair", "n", "best")
        asked = blocks.where("pairs is not null").select(F.col("block").alias("own"), F.explode("pairs").alias("pair"))
        answers = asked.join(counts, "pair").select("own", "pair", "n", "best")
        rows = blocks.where("pairs is null").drop("pairs", "times")
        kind = id_type(docs, id_col)
        schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        summed = rows.groupBy("block").cogroup(answers.groupBy("own")).applyInArrow(_summed(path_a, path_b), schema)
        return own.keep(summed.withColumnRenamed("id", "doc_id"), "alignment")
