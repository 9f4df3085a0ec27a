"""Near copies, mixing and shared spans against brute force."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import encode as E
from pagemill.llm import mix as X
from pagemill.llm import neardup as N
from pagemill.llm import spans as S

SF = "/root/testdata/sf0.001"
WORDS = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, s, share):
    w = s.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def brute_pairs(rows, similarity=0.6, least=60):
    sets = {}
    for i, t in rows:
        if t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            if len(w) >= least:
                sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    rows = []
    for _ in range(25):
        base = text(r, r.randint(58, 200))
        rows += [base, base.upper() + "!", *(edited(r, base, x) for x in (0.02, 0.06, 0.1, 0.15, 0.3))]
    rows += [text(r, 80) for _ in range(60)] + [None, "", "short text", text(r, 3000)]
    return list(enumerate(rows))


def test_near_pairs_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus + corpus[:3], "id bigint, text string")
    got = [(r.a, r.b) for r in N.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(corpus)
    assert N.near_pairs(df.where("false")).count() == 0


def test_long_lists_lose_no_pair(spark, corpus):
    """With a tiny bound every posting list is a long one, and lists of two coordinates too; the pairs stay the same."""
    df = spark.createDataFrame(corpus, "id bigint, text string")
    signed = N.signatures(df)
    members = signed.select("node", "id").distinct()
    few = {(r.a, r.b) for r in N.verified(N.candidates(signed, bound=2), members, df).collect()}
    all_ = {(r.a, r.b) for r in N.verified(N.candidates(signed), members, df).collect()}
    assert few == all_ and len(few) > 50


def test_classes_are_expanded_in_blocks(spark):
    """Large classes and links between them, in blocks of three."""
    links = spark.createDataFrame([(0, 100, 0.7), (0, 500, 0.8)], "a bigint, b bigint, similarity double")
    sets = [list(range(0, 20)), list(range(100, 111)), [500], [600, 601]]
    members = spark.createDataFrame([(s[0], i) for s in sets for i in s], "node bigint, id bigint")
    got = [(r.a, r.b, r.similarity) for r in N.expanded(links, members, bound=3).collect()]
    want = {(a, b, 1.0) for s in sets for a, b in itertools.combinations(s, 2)} | {(a, b, 0.7) for a in sets[0] for b in sets[1]} | {(a, 500, 0.8) for a in sets[0]}
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_are_components(spark, corpus):
    texts = corpus + [(9_000, corpus[0][1])]
    df = spark.createDataFrame(texts, "id bigint, text string")
    near = {}
    for a, b in brute_pairs(texts):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = N.groups(df).collect()
    assert {r.id: r.group_id for r in got} == want and len(got) == len(want) and any(r.links > 1 for r in got)
    assert N.groups(df.where("false")).count() == 0


def test_deliveries_with_other_texts(spark, corpus):
    """One of a record's texts stands for it."""
    df = spark.createDataFrame(corpus[:14] + [(0, corpus[7][1])], "id bigint, text string")
    other = {(0, 7)} | {(0, b if a == 7 else a) for a, b in brute_pairs(corpus[:14]) if 7 in (a, b)}
    rest = {p for p in brute_pairs(corpus[:14]) if 0 not in p}
    got = [(r.a, r.b) for r in N.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) in (rest | other, brute_pairs(corpus[:14]))


def test_signatures_of_long_texts_are_blockwise():
    s = np.unique(N._mix(np.arange(20_000, dtype=np.uint64)))
    odd, of = N.seeds(N.HASHES), N.layout()
    low = ((s[None, :] * odd[:, None]) ^ (s[None, :] >> np.uint64(32))).min(axis=1)
    key = np.arange(N.COORDINATES, dtype=np.uint64) * N._M
    for r in range(N.ROWS):
        key = N._mix((key + low[of[:, r]]) * N._M)
    assert (N.signature(s, of, odd) == key >> np.uint64(16)).all()
    assert of.shape == (N.COORDINATES, N.ROWS) and all(len(set(c)) == N.ROWS for c in of.tolist())


def test_pairs_at_the_limit_are_rarely_missed():
    """Of records that share 0.6 of their sequences at least two coordinates meet."""
    r = np.random.default_rng(4)
    odd, of = N.seeds(N.HASHES), N.layout()
    missed = 0
    for _ in range(1500):
        x = N._mix(r.integers(0, 2**63, 250, dtype=np.uint64))
        a, b = np.unique(x[:200]), np.unique(x[50:])  # 150 of 250
        missed += (N.signature(a, of, odd) == N.signature(b, of, odd)).sum() < N.MATCHES
    assert missed <= 6


def test_bitmap_keeps_all_that_match(spark):
    rows = spark.range(0, 5000).withColumnRenamed("id", "k")
    ids = spark.range(0, 100_000, 7).withColumnRenamed("id", "k")
    got = {r.k for r in N.may_hold(rows, "k", ids).collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 800 and N.may_hold(rows, "k", ids.where("false")).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=80), st.floats(0.01, 0.99), st.integers(0, 1000))
def test_flight_keeps_the_totals(tokens, p, seed):
    t = np.array(tokens)
    start = np.full(len(t), p)
    q = X.flight(t, start, np.random.default_rng(seed))
    assert ((q > 0) & (q < 1)).sum() <= 2 and (q >= 0).all() and (q <= 1).all()
    assert q @ t == pytest.approx(start @ t, rel=1e-5)
    z = X.land(q, np.random.default_rng(seed))
    assert set(z) <= {0.0, 1.0} and abs(z @ t - q @ t) <= sum(t[(q > 0) & (q < 1)]) + 1e-5 and abs(z.sum() - q.sum()) < 1


@settings(max_examples=30, deadline=None)
@given(st.integers(100, 1500), st.floats(0.2, 0.8), st.integers(0, 1000))
def test_flight_of_like_records_keeps_both_totals(n, p, seed):
    """Without outliers the number of records is kept, too, and what is left over is small; large blocks fly in threes."""
    t = np.random.default_rng(seed).integers(50, 400, n)
    start = np.full(n, p)
    q = X.flight(t, start, np.random.default_rng(seed))
    left = t[(q > 0) & (q < 1)]
    assert q @ t == pytest.approx(start @ t, rel=1e-5) and abs(q.sum() - start.sum()) < 3 and len(left) <= 2
    if n <= X.AT_ONCE:
        assert all(left <= np.median(t))


@pytest.mark.parametrize("heavy", [0, 6000])
def test_inclusion_probabilities(heavy):
    """Flight and landing keep every record's probability, that of a record that outweighs the others, too."""
    t = np.random.default_rng(0).integers(20, 300, 60)
    t[7] = heavy or t[7]
    hits, off = np.zeros(60), []
    for k in range(3000):
        rng = np.random.default_rng(k)
        z = X.land(X.flight(t, np.full(60, 0.3), rng), rng)
        hits += z
        off.append(z @ t - 0.3 * t.sum())
    assert abs(hits / 3000 - 0.3).max() < 4.2 * (0.21 / 3000) ** 0.5
    assert heavy or np.abs(off).max() < 150  # the tokens, but for the last two records


def test_inclusion_probabilities_through_mix(spark, monkeypatch):
    """Over many seeds each record is used as often as its source's rate says, whatever its size."""
    r = random.Random(5)
    rows = [(k, "a", " ".join(["word"] * (400 if k == 3 else r.randint(5, 60)))) for k in range(40)] + [(100, "b", " ".join(["word"] * 150))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").coalesce(1)
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    sized = X.count_tokens(docs).cache()
    monkeypatch.setattr(X, "count_tokens", lambda *a, **k: sized)
    tokens = {x.doc_id: x.n_tokens for x in sized.collect()}
    rate = X.budgets([("a", 40, sum(v for k, v in tokens.items() if k < 100)), ("b", 1, tokens[100])], [("a", 0.7, 1), ("b", 0.3, 1)])["a"][0]
    used = {k: 0 for k in range(40)}
    for seed in range(30):
        for x in X.mix(docs, targets, seed=seed).collect():
            if x.doc_id in used:
                used[x.doc_id] += x.copies
    low, high = rate - 4.5 * (rate * (1 - rate) / 30) ** 0.5, rate + 4.5 * (rate * (1 - rate) / 30) ** 0.5
    assert 0.2 < rate < 0.9 and all(low <= n / 30 <= high for n in used.values())


def test_budgets():
    stats = [("a", 10, 1000), ("b", 10, 100), ("c", 5, 50)]
    got = X.budgets(stats, [("a", 0.5, 2), ("b", 0.4, 2), ("none", 0.1, 1)])
    assert got["b"][0] == pytest.approx(2.0) and got["a"][0] == pytest.approx(200 / 0.4 * 0.5 / 1000) and "none" not in got and "c" not in got
    assert X.budgets(stats, [("none", 1.0, 3)]) == {} and X.budgets([], [("a", 1.0, 1)]) == {}
    capped = X.budgets(stats, [("a", 0.5, 2), ("b", 0.5, 2)], total_tokens=1e6)
    assert capped["a"][0] == 2.0 and capped["b"][0] == 2.0


@pytest.mark.skipif(not os.path.exists(E.TOKENIZER), reason="no tokenizer files here")
def test_mix_reaches_shares(spark):
    r = random.Random(2)
    rows = [(k, ("A ", "a", "B", None, "untargeted")[k % 5], text(r, r.randint(5, 120))) for k in range(900)] + [(5000, "a", None), (5001, "a", ""), (5002, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.2, 1), ("empty", 0.1, 4)], "source string, target_share double, max_repeats int")
    for block in (4096, 16):  # one block, and several levels of blocks
        used = X.mix(docs, targets, block=block)
        got = used.collect()
        assert len({x.doc_id for x in got}) == len(got) and {x.source for x in got} == {"a", "b"} and max(x.copies for x in got) <= 2
        share = {x.source: x for x in X.shares(spark.createDataFrame(got, used.schema), targets).collect()}
        assert share["a"].share == pytest.approx(0.7 / 0.9, abs=0.01) and share["b"].share == pytest.approx(0.2 / 0.9, abs=0.01) and share["empty"].records == 0
        assert sorted(map(tuple, X.mix(docs, targets, block=block).collect())) == sorted(map(tuple, got))
    assert X.mix(docs.where("false"), targets).count() == 0


# --- shared spans -------------------------------------------------------------------------------------------------


def brute_spans(rows, span=S.SPAN):
    seen: dict[str, set] = {}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            seen.setdefault(t[k : k + span], set()).add(i)
    out = set()
    for i, t in rows:
        last = None
        for k in range(len(t or "") - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                if last and k <= last[1]:
                    last[1] = k + span
                else:
                    if last:
                        out.add((i, *last))
                    last = [k, k + span]
        if last:
            out.add((i, *last))
    return out


def planted(seed):
    """Texts with passages of many kinds: sentences, one word without marks, CJK, control characters."""
    r = random.Random(seed)
    alphabets = ["abcdefgh    ..,", "abcdefghijklmnop", "日本語の文章です。、", "ab\n #*-1é​"]
    make = lambda n, a: "".join(r.choice(a) for _ in range(n))
    passages = [make(r.randint(150, 700), r.choice(alphabets)) for _ in range(12)]
    rows = []
    for k in range(70):
        a = r.choice(alphabets)
        parts = [make(r.randint(0, 150), a)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            x = r.randint(0, len(p) // 2)
            parts += [p[x : x + r.randint(100, 600)], make(r.randint(0, 90), a)]
        rows.append((k, "".join(parts)))
    return rows + [(900, None), (901, ""), (902, rows[0][1]), (903, rows[0][1]), (904, "z" * 500), (905, "z" * 450)]


@pytest.mark.parametrize("group", [S.GROUP, 2])
def test_spans_equal_brute_force(spark, group):
    """Both ways, that for common runs and that for very common ones."""
    rows = planted(7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cover = S.coverage(df, group=group)
    got = {(r.doc_id, r.span_start, r.span_end) for r in S.merged(cover).collect()}
    assert got == brute_spans(rows)
    amounts = {r.doc_id: r.shared_chars for r in S.amounts(df, S.merged(cover)).collect()}
    assert amounts[900] == 0 and amounts[902] == len(rows[0][1]) or len(rows[0][1]) < S.SPAN


def test_span_groups_agree():
    """Comparing pairs and counting windows give the same cover."""
    r = random.Random(1)
    base = "".join(r.choice("abcdef .") for _ in range(420))
    group = []
    for k in range(30):
        a, b = r.randint(0, 60), r.randint(300, 420)
        s = "#" * k + base[a:b] + "!" * k
        at = k + 150 - a
        group.append((k, at, s[max(0, at - 140) : at], s[at : at + 200]))
    merged = lambda rows: {(d, a, b) for d, a, b, _ in S._merge_rows([(d, a, b, False) for d, a, b, _ in rows])}
    pairs = [x for i, j in itertools.combinations(range(30), 2) for x in S.compare([group[i], group[j]])]
    assert merged(S.compare(group)) == merged(pairs)
    assert S.common_prefix("abc", "abd") == 2 and S.common_prefix("", "x") == 0 and S.common_prefix("ab", "abc") == 2


def test_first_copy_stays(spark):
    r = random.Random(4)
    passage = " ".join(f"Sentence {text(r, 8)}." for _ in range(8))
    rows = [(1, "Own start here. " + passage + " Own end."), (2, "Other start. " + passage + " Other end."), (3, None), (4, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.text, x.removed) for x in S.without_repeats(df, S.coverage(df)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2][1] == 8 and "Sentence" not in got[2][0] and "Other start." in got[2][0] and got[3] == (None, 0) and got[4] == ("alone", 0)
    assert S.merged(S.coverage(df.where("false"))).count() == 0
