import math
import random
import re
from collections import Counter, defaultdict

import pytest
from newsloom.llm import suffix_tree
from pyspark.sql import functions as F

END = "\n"


def corpus(n=300, seed=1):
    """A cycle a b c d ... with noise, so the next word depends on the last ones; some texts stand twice or more."""
    rng = random.Random(seed)
    cycle = "a b a c a d e f".split()
    rows = []
    for i in range(n):
        at, words = rng.randrange(8), []
        for _ in range(rng.randint(0, 60)):
            words.append(cycle[at % 8] if rng.random() < 0.8 else f"n{rng.randrange(500)}")
            at += 1
        rows.append((i, " ".join(words) if i % 50 else None))
    return rows + [(n + i, rows[1 + i % 3][1]) for i in range(9)] + [(None, "a b\x0bC\u00a0c \u2003 d"), (None, " "), (7, "a  b\t")]


class Brute:
    """The tree as dictionaries: counts of all sequences, nodes tested one by one."""

    def __init__(self, texts, s):
        self.s, self.c = s, Counter()
        self.next = defaultdict(set)
        for t in texts:
            line = [END, *self.words(t)]
            for i in range(1, len(line)):
                self.c[(line[i],)] += 1
                for k in range(1, s.depth + 1):
                    if i - k >= 0:
                        self.c[tuple(line[i - k : i + 1])] += 1
                        self.next[tuple(line[i - k : i])].add(line[i])
        self.N, self.V = sum(c for w, c in self.c.items() if len(w) == 1), sum(len(w) == 1 for w in self.c)
        self.alpha = {}
        for k in range(1, s.depth + 1):
            for ctx in [x for x in self.next if len(x) == k and self.c[x] >= s.min_count]:
                total, kept = self.c[ctx], [w for w in self.next[ctx] if self.c[(*ctx, w)] >= s.min_count]
                mass = sum(self.c[(*ctx, w)] - s.discount for w in kept)
                covered = sum(10 ** self.p(ctx[1:], w) for w in kept)
                alpha = math.log10(max((total - mass) / total, 1e-12) / max(1 - covered, 1e-12))
                gain = sum(self.c[(*ctx, w)] * (self.own(ctx, w) - self.p(ctx[1:], w)) for w in kept)
                gain += (total - sum(self.c[(*ctx, w)] for w in kept)) * alpha
                if kept and covered < 1 - 1e-6 and math.log(10) * gain > 0.5 * len(kept) * math.log(self.N):
                    self.alpha[ctx] = alpha

    @staticmethod
    def words(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]

    def own(self, ctx, w):
        return math.log10((self.c[(*ctx, w)] - self.s.discount) / self.c[ctx])

    def p(self, ctx, w):
        if not ctx:
            return math.log10((self.c[(w,)] + 0.5) / (self.N + 0.5 * (self.V + 1)))
        if ctx not in self.alpha:
            return self.p(ctx[1:], w)
        return self.own(ctx, w) if self.c[(*ctx, w)] >= self.s.min_count else self.p(ctx[1:], w) + self.alpha[ctx]

    def score(self, t):
        line = [END, *self.words(t)]
        return sum(self.p(tuple(line[max(0, i - self.s.depth) : i]), line[i]) for i in range(1, len(line)))


def learned(rows):
    return [t for i, t in rows if i is None or i % 5 != 1]


def frame(spark, rows, parts=3):
    docs = [(i, t, "clash", -1.0) for i, t in rows]
    return spark.createDataFrame(docs, "doc_id long, text string, answers string, score double").repartition(parts)


@pytest.mark.parametrize("depth,settings", [(1, {}), (2, {"slice_chars": 500, "part_keys": 100}), (3, {"slice_chars": 2000, "part_keys": 400}), (4, {"min_count": 3})])
def test_scores_match_brute_force(spark, depth, settings):
    rows, s = corpus(), suffix_tree.Settings(depth=depth, **settings)
    out = suffix_tree.score(frame(spark, rows), F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)), settings=s)
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    brute = Brute(learned(rows), s)
    assert any(len(ctx) == depth for ctx in brute.alpha)
    want = [(i, len(brute.words(t)), sum(brute.c[(w,)] > 0 for w in brute.words(t)), brute.N, sum(brute.p((), w) for w in brute.words(t)), brute.score(t)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(map(tuple, out.collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], abs=1e-4)


def test_distributions_sum_to_one():
    brute = Brute(learned(corpus()), suffix_tree.Settings())
    unseen = 0.5 / (brute.N + 0.5 * (brute.V + 1))
    seen = [w[0] for w in brute.c if len(w) == 1]
    for ctx in [(), *random.Random(3).sample(sorted(brute.alpha), 20)]:
        tail = sum(10 ** brute.p(ctx, w) for w in seen) + 10 ** (brute.p(ctx, "never seen") - brute.p((), "never seen")) * unseen
        assert tail == pytest.approx(1, abs=1e-9)


def test_held_out_texts_gain_and_repeated_texts_stand_apart(spark):
    rng = random.Random(5)
    fresh = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    twice = [fresh() for _ in range(20)]
    rows = corpus() + [(1000 + i, fresh()) for i in range(200)] + [(2000 + i, twice[i % 20]) for i in range(40)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in suffix_tree.score(docs, F.col("doc_id") % 5 != 1).collect()}
    held = [got[i] for i, _ in rows if i is not None and i < 300 and i % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50
    gain = lambda i: (got[i].score - got[i].base_score) / got[i].n_tokens
    both = [2000 + i for i in range(20) if i % 5 != 1]  # learned in both places
    assert min(gain(i) for i in both) > max(gain(1000 + i) for i in range(200) if i % 5 != 1) + 1


def test_nothing_to_learn_from_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b"), (None, ""), (1, "a b")])
    rows = suffix_tree.score(docs, F.lit(False)).collect()
    assert len(rows) == 3 and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert suffix_tree.score(docs.limit(0)).collect() == []


def test_very_long_texts(spark):
    long = "x y z " * 400_000
    got = {r.doc_id: r for r in suffix_tree.score(frame(spark, [(1, long), (2, "x y"), (3, "q" * 300_000)])).collect()}
    assert got[1].n_tokens == 1_200_001 and got[1].score > got[1].base_score / 4 and got[3].n_tokens == 2
