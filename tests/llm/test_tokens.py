import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kindred.llm import packing
from kindred.llm.packing import Encoder, SumOfSquares, pack
from kindred.llm.token_count import NEXT, START, WordMachine, compose, count_tokens, word_starts

from .conftest import SCHEMA, make_docs

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "don't 're 'r 'rx'l 'll ''s !'s  's\n's  \n  x", "", " ", "  ", "a  b\n\nc \n d", "<|endoftext|>a<|endoftext|> b <|endoftext", "I'VE we've'",
    "x y 　 z\x85q\x1c\x1f 12 3４Ⅷ ²½", "日本語 🙂👩‍👧", "a" * 300, "-" * 200, "́á 'sé", "é. ...a. don'. é.. 5.. x́.",
    "<|ENDOFTEXT|> <|startoftext|> İ Σς K", "see <|ENDOFTEXT|> here", "<|StartOfText|>,x <|endoftexT|", "<|ENDOFTEXT|>", "a<|endoftext|>b",
]


def texts():
    rng, out = random.Random(5), list(ODD)
    out += ["".join(rng.choice("ab  'strevlmd\n\t.1é 日!-=Sß") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 150))) for _ in range(200)]
    return out


def test_counts_are_the_library_s(spark, corpus):
    rows = [*[r for r in corpus if r[0] is not None], *enumerate(texts(), 1000)]
    library = Tokenizer.from_file(BYTES)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    got = count_tokens(make_docs(spark, rows), BYTES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.over_limit) == (want[r.doc_id], want[r.doc_id] > 1024)
    assert {r.doc_id: r.n_bytes for r in got}[104] == len(dict(corpus)[104].encode())
    assert count_tokens(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


def test_classes_of_all_code_points_are_the_library_s():
    """By words of each code point between others; white space, letters, numbers and the rest all split in their own way."""
    library, own = Tokenizer.from_file(BYTES), WordMachine(BYTES)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    some = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}!{chr(c)}  " for c in points[at : at + 256]) for at in range(0, len(points), 256)]
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert own.texts(some).tolist() == want


def test_null_and_repeated_ids_are_counted_each(spark):
    rows = [(None, "a b"), (None, None), (4, "x"), (4, "x y z"), (4, "x"), (6, "long " * 200_000)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(make_docs(spark, rows), BYTES).collect())
    library = Tokenizer.from_file(BYTES)
    assert got == sorted((i or 0, len(t or ""), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_chunk_maps_compose_to_a_sequential_run():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 11, 3000).astype(np.uint8)
    state, seen = START, []
    for k in kinds:
        state = NEXT[state, k]
        seen.append(state)
    maps = np.array([[x for x in range(12)]])
    cuts = []
    for part in np.array_split(kinds, 13):
        own = np.arange(12)
        for k in part:
            own = NEXT[own, k].astype(np.int64)
        cuts.append(own)
    assert compose(np.array(cuts))[-1, START] == seen[-1] and maps.shape == (1, 12)
    assert word_starts(kinds)[0] == 0


def test_states_are_forgotten_without_harm(monkeypatch):
    from kindred.llm import token_count

    for name in ("MEMO_STEPS", "MEMO_WORDS", "MEMO_PAIRS"):
        monkeypatch.setattr(token_count, name, 50)
    library, own = Tokenizer.from_file(BYTES), WordMachine(BYTES)
    for t in texts()[:60]:
        assert own.texts([t])[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_encoder_is_the_library():
    library, own = Tokenizer.from_file(WORDS), Encoder(WORDS, 2)
    for _ in range(2):
        got = list(own.encode([t.encode() for t in texts()]))
        for t, ids in zip(texts(), got, strict=True):
            assert ids == np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_special_strings_in_any_case():
    rng, library, own = random.Random(9), Tokenizer.from_file(WORDS), Encoder(WORDS, 2)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|startOFtext|>", "<|", "|>", " ", ",", "a", "É", "\u017f", "\u212a", "endoftext", "\n", "'s"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    for t, ids in zip(some, own.encode([t.encode() for t in some]), strict=True):
        assert ids == np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_memory_of_chunks_is_forgotten_without_harm():
    library, own = Tokenizer.from_file(WORDS), Encoder(WORDS, 2, memo=20)
    assert own.by_chunks
    for t, ids in zip(texts(), own.encode([t.encode() for t in texts()]), strict=True):
        assert ids == np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_another_tokenizer_is_left_to_the_library():
    library, own = Tokenizer.from_file(BYTES), Encoder(BYTES, 2)
    assert not own.by_chunks
    for t, ids in zip(texts(), own.encode([t.encode() for t in texts()]), strict=True):
        assert ids == np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_null_and_repeated_ids_are_packed_each(spark):
    rows = [(None, "a b c"), (None, None), (5, "x y"), (5, "x y"), (5, "z")]
    got = pack(make_docs(spark, rows), WORDS, size=8).collect()
    library = Tokenizer.from_file(WORDS)
    want = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows)
    whole = [r for r in got if r.length == r.doc_tokens]
    assert sum(r.length for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert set(r.ids_crc32 for r in whole) <= set(want) and sum(r.doc_id is None for r in got) >= 2


def test_a_crowded_packer_keeps_its_levels():
    packer = SumOfSquares(64)
    rng = random.Random(4)
    import kindred.llm.packing as module
    bound, module.MOST_OPEN = module.MOST_OPEN, 6
    try:
        rows = [r for d in range(400) for r in packer.add(d, np.zeros(rng.randint(1, 63), "<u4").tobytes())]
        assert 0 < packer.level.sum() <= 6 and packer.level.sum() == sum(map(len, packer.open))
        rows += packer.close()
    finally:
        module.MOST_OPEN = bound
    fills = defaultdict(int)
    for _, _, length, _, window, _ in rows:
        fills[window] += length
    assert sum(n != 64 for n in fills.values()) <= 7


def check_packed(rows, ids_of, size):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc, own in pieces.items():
        at, ids = 0, ids_of[doc]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0
    assert set(pieces) == set(ids_of)


@pytest.mark.parametrize("most_open", [2048, 3])
def test_packing_is_an_exact_round_trip(spark, corpus, most_open, monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", most_open)
    rows = [r for r in corpus if r[0] is not None][:-1]
    library = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    check_packed(pack(make_docs(spark, rows), WORDS, size=256).collect(), ids, 256)
    assert pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_levels_are_chosen_by_least_squares():
    rng = random.Random(2)
    packer = SumOfSquares(16)
    for doc in range(300):
        n = rng.randint(1, 15)
        level = packer.level.copy()

        def after(h, n=n, level=level):
            new = level.copy()
            if h:
                new[h] -= 1
            if h + n < 16:
                new[h + n] += 1
            return int((new[1:16] ** 2).sum())

        fits = [h for h in range(0, 17 - n) if h == 0 or level[h]]
        assert after(packer.place(n)) == min(map(after, fits))
        packer.add(doc, np.zeros(n, "<u4").tobytes())
    assert packer.level.sum() == sum(map(len, packer.open))
