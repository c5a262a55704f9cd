import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from kindred.llm import align

from .conftest import SCHEMA, make_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_the_book(rows):
    """Expected row of each document, byte by byte and pair by pair."""
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = align.byte_characters()
    every = []
    for i, text in rows:
        if not text:
            every.append((i, [], []))
            continue
        a = [(t, bytes(chars[c] for c in left.id_to_token(t))) for t in left.encode(" " + text, add_special_tokens=False).ids]
        b = [(t, bytes([int(p[3:5], 16)]) if right.is_byte(t) else p.replace("▁", " ").encode()) for t, p in zip(right.encode(text), right.encode(text, out_type=str), strict=True)]
        want = (" " + text).encode()
        every.append((i, a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else (i, [], []))
    linked, count = [], Counter()
    for _, a, b in every:
        spans = []
        for side in (a, b):
            at, own = 0, []
            for t, x in side:
                own.append((t, at, at + len(x)))
                at += len(x)
            spans.append(own)
        first, own = 0, []
        for x, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            for y, p, q in spans[1][first:]:
                if p >= e:
                    break
                assert q > s
                own.append((x, y))
        count.update(own)
        linked.append((spans, own))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (i, a, b), (spans, own) in zip(every, linked, strict=True):
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, x, y = [], list(spans[0]), list(spans[1])
        for c in cuts:
            part = []
            for side in (x, y):
                n = sum(e <= c for *_, e in side[:200])
                while n < len(side) and side[n][2] <= c:
                    n += 1
                part.append(",".join(str(t) for t, *_ in side[:n]))
                del side[:n]
            groups.append("|".join(part))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), digest))
    return out, count, most


ODD = [
    (200, "<|endoftext|> <s> </s><unk> ▁ x"), (201, "▁"), (202, "a▁b"), (203, "漢字かな 🙂🙃 naïve é́"), (204, "x" * 3000), (205, "a\r\n\tb\x00c  d   e"),
    (206, " "), (207, "\n"), (208, "  leading"), (209, "trailing  "), (210, " ﻿ﬁ½"), (211, "<0x41> <0x0A>"),
]


def test_matches_brute_force(spark, corpus):
    rows = [*corpus, *ODD]
    want, _, _ = by_the_book(rows)
    got = align.alignment(make_docs(spark, rows), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(w[1] == 0 and w[0] == 201 for w in want) and any(w[0] == 204 and w[1] > 100 for w in want)


def test_small_blocks_and_pieces_change_nothing(spark, corpus, monkeypatch):
    rows = corpus[:70]
    monkeypatch.setattr(align, "BLOCK_LINKS", 300)
    monkeypatch.setattr(align, "PIECE", 7)
    got = align.alignment(make_docs(spark, rows), A, B).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_the_book(rows)[0]))


def test_pair_counts(spark, corpus):
    rows = corpus[:40]
    _, count, most = by_the_book(rows)
    got = {(r.a_id, r.b_id): (r.n, r.best) for r in align.pair_counts(make_docs(spark, rows), A, B).collect()}
    assert got == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_tokens_and_groups(spark, corpus):
    rows = [r for r in corpus if r[0] is not None][:50] + [(300, None)]
    left = Tokenizer.from_file(A)
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    for r in align.align_tokens(make_docs(spark, rows).dropDuplicates(["doc_id"]), A, B).collect():
        text = dict(rows)[r.doc_id]
        if not text:
            assert not (r.a_ids or r.b_ids or r.a_groups or r.b_groups)
            continue
        assert r.a_ids == left.encode(" " + text, add_special_tokens=False).ids and r.b_ids == right.encode(text)
        assert set(r.a_groups) == set(r.b_groups) == set(range(r.a_groups[-1] + 1)) and sorted(r.a_groups) == r.a_groups


def test_no_rows_and_no_texts(spark):
    assert align.alignment(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    got = align.alignment(make_docs(spark, [(1, None), (2, ""), (None, None)]), A, B).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, 0, 0, 0, 0, 0, 0, "")) for i in (1, 2, None))


def test_ranks_give_the_ids_of_the_library_for_every_character():
    tools = align.aligner(A, B)
    assert tools._ranked is not None
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}.{chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or c % 37 == 0)]
    texts += [" " * 70_000, " " * 70_000 + "x", "x" * 70_000, "ab" * 40_000, "'s'T'll x's 've''", "<|endoftext|>a"]
    wrong = []
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        want = [x.ids for x in tools.left.encode_batch_fast(part, add_special_tokens=False)]
        wrong += [t for t, w in zip(part, want, strict=True) if tools._ranked.encode_ordinary(t) != w]
    assert not wrong
