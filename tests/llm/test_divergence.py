import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from tabshift.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, text string, source string, g long, term string, n long"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least, most):
    """The definition, term by term and pair by pair."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        group = (lang or "", source or "")
        count[group].update(words(text))
        docs[group[0]].update(set(words(text)))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in count}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {g: count[g] for g in count if g[0] == lang}
        total = sum(own.values(), Counter())
        size = lambda c: sum(c[t] for t in kept)
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (size(c) + 2 * len(kept)) for t in kept}
        p, q = {g: p_of(c) for g, c in own.items()}, p_of(total)
        for g in own:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in own if h != g]
            terms = [(f(p[g][t], q[t]), t) for t in kept if own[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= most]
    return sorted(out)


def held(spark, rows, least=2, most=3):
    table = spark.createDataFrame([(lang, text, source, 7, "x", 1) for lang, source, text in rows], SCHEMA)
    got = divergence.audit(table, least=least, most=most).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, most)
    return got


def random_rows(rng, n, sources=23):
    vocabulary = [rng.choice(["Été", "straße", "λόγος", "Word", "don't", "x1y"]) + chr(97 + i % 26) * (i // 26) for i in range(120)]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.randrange(5, 120)]) for _ in range(rng.randrange(0, 60)))
    return [(rng.choice(["en", "de", None, ""]), rng.choice([f"s{i}" for i in range(sources)] + ["hot"] * 12 + [None, "é"]), text()) for _ in range(n)]


def test_against_brute_force(spark):
    held(spark, random_rows(random.Random(1), 400))


def test_small_blocks_and_early_sending(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 40)
    monkeypatch.setattr(divergence, "HELD", 30)
    monkeypatch.setattr(divergence, "PAIRS_HELD", 5)
    held(spark, random_rows(random.Random(2), 200), least=3, most=2)


def test_odd_rows(spark):
    rows = [("en", "a", None), ("en", "b", ""), ("en", "c", "!!! 123 @@"), ("fr", "only", "un deux un deux"), ("fr", "only", "un deux"), (None, None, None), ("de", "x", "gleich gut"), ("de", "y", "gleich gut"), ("de", "y", "gleich gut"), ("de", "z", "lang " * 40_000)]
    got = held(spark, rows)
    assert {r.value for r in got if r.lang == "en"} == {0}  # no kept term: all alike
    assert held(spark, []) == []


def test_ties_go_by_bytes(spark):
    got = held(spark, [("l", s, "Zz aa éé \U0001f600 ﬀ" + " w" * n) for s, n in (("b", 1), ("a", 1), ("Ω", 1), ("c", 9)) for _ in range(2)], most=10)
    assert [r.item for r in sorted(got, key=lambda r: r["rank"]) if r.source == "c" and r.part == "pair"] == ["a", "b", "Ω"]


def test_every_two_teams_meet_once_and_share_the_hosting():
    met = divergence.rounds(16)
    assert sorted(tuple(sorted(x[1:])) for x in met) == list(combinations(range(16), 2))
    assert all(sorted(t for r, *two in met if r == k for t in two) == list(range(16)) for k in range(15))
    hosts = Counter(h for _, _, h in met)
    assert max(hosts.values()) - min(hosts.values()) <= 1


def test_large_counts_stay_exact():
    p, q = np.array([10**9 + 1, 1]), np.array([1, 10**9 + 1])
    assert divergence.divergence(p, q).tolist() == [10**18 // (10**9 + 2)] * 2


def test_p_of_large_counts(spark):
    total, n = 9 * 10**15 + 7, 8 * 10**15 + 3
    got = spark.createDataFrame([(n, total)], "n long, total long").select(divergence._p("n", "total")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // total
