import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm import pitman_yor
from kindred.llm.pitman_yor import perplexity, score_texts

from .conftest import make_docs


def test_rare_contexts_keep_what_follows_them(spark, monkeypatch):
    """4,000 words of like count, each always followed by the same one: more contexts than any fixed number of frequent ones."""
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 3000)
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        own = []
        for _ in range(12):
            k = rng.randrange(4000)
            own += [f"a{k}", f"b{k}"]
        rows.append((i, " ".join(own)))
    scored = score_texts(make_docs(spark, rows)).cache()
    model = {r.held_out: r.perplexity for r in perplexity(scored).collect()}
    base = {r.held_out: r.perplexity for r in perplexity(scored, "base_score").collect()}
    assert model[True] < 0.15 * base[True]


def test_a_context_shares_out_one_among_all_words(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)]
    train = [(i, " ".join(rng.choice(vocabulary) for _ in range(9))) for i in range(200)]
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0][:32]
    scored = score_texts(make_docs(spark, train + list(zip(held, ["", *vocabulary, "new"], strict=True)))).collect()
    got = {r.doc_id: 10**r.score for r in scored if r.doc_id in held}
    # A text of one word and an end; the end's probability after a word is at most one, and after these words alike.
    assert 0 < got[held[0]] < 1 and sum(got[i] for i in held[1:]) < 1 and got[held[-1]] < min(got[i] for i in held[1:-1])


class Seating:
    """The model by the book: customers sit at tables one by one, and a sweep takes each away and seats it again."""

    def __init__(self, pairs, words, rng):
        self.rng, self.words = rng, sorted(words)
        self.rooms = defaultdict(lambda: defaultdict(list))
        self.root = defaultdict(list)
        self.customers = [p for p, n in pairs.items() for _ in range(n)]
        for u, w in self.customers:
            self.seat(u, w)

    @staticmethod
    def share(tables, w, law, back):
        d, s = law
        n, t = sum(map(sum, tables.values())), sum(map(len, tables.values()))
        own = tables.get(w, [])
        return (sum(own) - d * len(own) + (s + d * t) * back) / (s + n)

    def p_root(self, w):
        return self.share(self.root, w, pitman_yor.ROOT, 1 / (len(self.words) + 1))

    def p(self, u, w):
        return self.share(self.rooms.get(u, {}), w, pitman_yor.CONTEXT, self.p_root(w))

    def sit(self, tables, w, law, back):
        """True if the customer opens a table."""
        d, s = law
        own, t = tables[w], sum(map(len, tables.values()))
        at = self.rng.random() * (sum(own) - d * len(own) + (s + d * t) * back)
        for i, n in enumerate(own):
            at -= n - d
            if at < 0:
                own[i] += 1
                return False
        own.append(1)
        return True

    def leave(self, tables, w):
        own = tables[w]
        i = self.rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        if own[i]:
            return False
        own.pop(i)
        return True

    def seat(self, u, w):
        if self.sit(self.rooms[u], w, pitman_yor.CONTEXT, self.p_root(w)):
            self.sit(self.root, w, pitman_yor.ROOT, 1 / (len(self.words) + 1))

    def sweep(self):
        for u, w in self.customers:
            if self.leave(self.rooms[u], w):
                self.leave(self.root, w)
            self.seat(u, w)


def test_scores_match_a_sampler_that_seats_each_customer_by_itself(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words[i % 3 :], k=rng.randint(1, 9), weights=range(len(words) - i % 3, 0, -1)))) for i in range(60)]
    rows += [(1000, "w3 new w1"), (1001, ""), (1002, "new new")]
    learn = {i: zlib.crc32(str(i).encode()) % 10 > 0 for i, _ in rows}
    pairs = Counter()
    for i, t in rows:
        if learn[i]:
            own = [*t.split(), ""]
            pairs.update(zip(["", *own[:-1]], own, strict=True))
    model = Seating(pairs, {w for _, w in pairs}, rng)
    for _ in range(60):
        model.sweep()
    seen = defaultdict(list)
    asked = {i: list(zip(["", *t.split()], [*t.split(), ""], strict=True)) for i, t in rows}
    for _ in range(150):
        model.sweep()
        for pair in {p for own in asked.values() for p in own}:
            seen[pair].append(model.p(*pair))
    monkeypatch.setattr(pitman_yor, "SAMPLES", 8)
    got = {r.doc_id: r.score for r in score_texts(make_docs(spark, rows)).collect()}
    for i, own in asked.items():
        want = sum(math.log10(np.mean(seen[p])) for p in own)
        assert got[i] == pytest.approx(want, abs=0.02 * len(own) + 0.02)


def test_repeated_rows_and_ties_score_alike(spark):
    got = score_texts(make_docs(spark, [(1, "a b a b"), (1, "a b a b"), (3, "a b a b"), (3, None), (4, "x " * 5000)])).collect()
    assert len(got) == 5 and len({r.score for r in got if r.n_tokens == 5}) == 1
    assert next(r for r in got if r.doc_id == 4).n_tokens == 5001
