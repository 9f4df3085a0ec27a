"""Splitting, repeated lines, main body, residue, spam, languages and ids."""

import datetime as dt
import json
import os
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import encode as E
from pagemill.llm import language as L
from pagemill.llm import lines as R
from pagemill.llm import mainbody as M
from pagemill.llm import residue as B
from pagemill.llm import spam as K
from pagemill.llm import split as S

T0 = dt.datetime(2025, 1, 1)
SF = "/root/testdata/sf0.001"
need_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
need_tokenizer = pytest.mark.skipif(not os.path.exists(E.TOKENIZER), reason="no tokenizer files here")


# --- 1 ----------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#é日。́", max_size=900), st.integers(8, 40), st.integers(0, 7))
def test_pieces_cover_and_overlap(text, limit, overlap):
    pieces = S.cut_points(text, limit, overlap)
    assert all(0 <= a < b <= len(text) and (b - a) // 3 <= limit for a, b in pieces)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, end), (start, nxt) in zip(pieces, pieces[1:]):
        assert start == max(0, end - 3 * overlap) and nxt > end
    assert len(pieces) == (len(text) > 0) or len(text) // 3 > limit


def test_pieces_end_at_boundaries():
    text = "\n\n".join(f"## Part {k}\n\n" + "One sentence here. Another one there. " * 12 for k in range(12))
    pieces = S.cut_points(text, 400, 50)
    assert len(pieces) > 1 and all(text[b - 1] == "\n" for _, b in pieces[:-1])
    assert [b - a for a, b in S.cut_points("x" * 5000, 400, 0)] == [1000] * 5 and S.cut_points("", 10, 1) == []
    with pytest.raises(ValueError):
        S.cut_points("x" * 99, 10, 11)


def test_split_table(spark):
    rows = [(1, "a b. " * 300, "x"), (2, "short", "x"), (3, None, None), (4, "", None), (1, "a b. " * 300, "y")]
    df = spark.createDataFrame(rows, "scrape_id bigint, content string, piece string")
    got = S.split_oversized(df, "scrape_id", "content", 100, 10)
    assert {r.scrape_id for r in got.collect()} == {1} and max(len(r.piece) for r in got.collect()) // 3 <= 100
    assert S.split_oversized(df.where("false"), "scrape_id", "content", 100, 10).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------------------

SCRAPES = "scrape_id bigint, content string, metadata struct<source_url: string>, final_url string, ingested_at timestamp_ntz"


def test_repeated_lines_equal_brute_force(spark):
    rows = []
    for k in range(400):
        site = "big.example" if k < 300 else f"www.s{k % 5}.Example:80"
        text = [f"own line {k}".translate({48 + d: 97 + d for d in range(10)}), "All rights RESERVED 2020" if k % 3 else "", f"share {k}", "rare line" if k % 60 == 0 else "", "---", "twice", "twice"]
        rows.append((k, "\n".join(text), (f"http://{site}/{k}",) if k % 7 else (None,), f"https://{site}/x", T0))
    rows += [(3, rows[3][1], rows[3][2], rows[3][3], T0 + dt.timedelta(1)), (1000, None, None, None, T0), (1001, "x", None, None, T0), (None, "share it", (None,), "http://big.example", T0)]
    got = {(r.scrape_id, r.line_no) for r in R.found_lines(spark.createDataFrame(rows, SCRAPES)).collect()}
    docs = {}
    for i, c, m, f, _ in rows:
        if c is not None:
            url = (m and m[0]) or f
            host = re.sub(r"^www\.", "", re.sub(r":\d+", "", url.split("//")[1].split("/")[0].lower())) if url else None
            docs[i] = (host, ["".join(x for x in line.lower() if x.isalpha()) for line in c.split("\n")])
    size, n = Counter(h for h, _ in docs.values()), Counter()
    for h, ls in docs.values():
        n.update((h, x) for x in set(ls) if x)
    assert got == {(i, k) for i, (h, ls) in docs.items() if h for k, x in enumerate(ls, 1) if x and n[h, x] >= 6 and n[h, x] * 50 >= size[h]}
    clean = {r.scrape_id: (r.content, r.removed) for r in R.without_repeated(spark.createDataFrame(rows, SCRAPES)).collect()}
    for i, (text, removed) in clean.items():
        if i is not None:
            source = next(r[1] for r in rows if r[0] == i)
            gone = {k for j, k in got if j == i}
            assert removed == len(gone) and text == "\n".join(x for k, x in enumerate(source.split("\n"), 1) if k not in gone)
    assert R.found_lines(spark.createDataFrame([], SCRAPES)).count() == 0


# --- 3 to 6 -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import pandas as pd

    pages = [h for h in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html if h]
    scrapes = pd.read_parquet("/root/testdata/sf0.01/scrapes.parquet").drop_duplicates("scrape_id")
    records = [(c, m and m["title"]) for c, m in zip(scrapes.content, scrapes.metadata) if c and not K.Chain().is_spam(c) and not B.is_residue(c)]
    return M.train(pages[:200], records[:1200]), pages[200:], records[1200:]


@need_data
def test_main_body_on_held_out_pages(model):
    m, held, records = model
    right, total, flipped = Counter(), Counter(), 0
    for kind, sample in (("page", [got for html in held if (got := M.labelled(html))]), ("record", M.supposed(records))):
        for text, labels in sample:
            lines = M.tree(text)
            got = m.marginals(lines)
            right[kind] += sum((p > 0.5) == y for p, y in zip(got, labels) if y != M.HIDDEN)
            total[kind] += sum(y != M.HIDDEN for y in labels)
            flipped += sum((p > 0.5) != (m.potential(x) > 0) for p, x in zip(got, lines))
    assert total["page"] > 300 and right["page"] / total["page"] > 0.97 and total["record"] > 3000 and right["record"] / total["record"] > 0.99
    assert flipped > 0  # the messages decide some lines


def test_forest_equals_pages():
    """Passes over many pages at once give each page's own marginals; edge counts add up."""
    import math

    import numpy as np

    edges = {k: v for k, v in zip(M.KINDS, ((1.4, 0.6, 0.7, 1.3), (1.1, 0.9, 0.8, 1.2), (1.5, 0.5, 0.4, 1.6), (1.2, 0.9, 0.8, 1.1)))}
    m = M.Model({"alpha": 1.0, "beta": -0.7, "gamma": 0.4}, edges, 0.1)
    trees = [M.tree(t) for t in ("alpha\n- beta\n- gamma\n\nbeta\n\n- alpha", "gamma", "beta\n\n\nalpha\ngamma\n1. beta")]
    own = np.array([m.potential(x) for t in trees for x in t])
    belief, expected = M.Forest(trees).beliefs(own, np.log(np.array([edges[k] for k in M.KINDS]).reshape(4, 2, 2)))
    assert (1 / (1 + np.exp(-belief))).tolist() == pytest.approx([p for t in trees for p in m.marginals(t)])
    assert expected.sum() == pytest.approx(sum(len(t) + t[-1].block + 1 for t in trees)) and not math.isnan(belief.sum())


def test_labels_of_samples():
    text, labels = M.labelled("<body><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><article><h1>T</h1><p>One two.</p></article><footer>F</footer></body>")
    assert text == "- [A](/a)\n- [B](/b)\n\n# T\n\nOne two." + ("\n\nF" if len(labels) > 4 else "") and labels[:4] == [1, 1, 0, 0]
    assert M.labelled("<p>x</p>") is None and M.labelled("") is None
    long = " ".join(f"word{k}" for k in range(30)).translate({48 + d: 97 + d for d in range(10)}) + "."
    rows = [(f"Home\nTitle {chr(97 + k)}\n\n{chr(97 + k)} {long}\n\n- {chr(97 + k)} one two three four five\n\nshort", f"Title {chr(97 + k)}") for k in range(6)]
    assert M.supposed(rows)[0][1] == [M.FURNITURE, M.MAIN, M.MAIN, M.MAIN, M.FURNITURE] and M.supposed([]) == []
    related = [(f"Read also\n- {chr(97 + k)} other story of today\n- {chr(97 + k)} tale is told.\n\nx", None) for k in range(6)]
    assert M.supposed(related)[0][1] == [M.FURNITURE, M.FURNITURE, M.HIDDEN, M.FURNITURE]
    assert M.fitted([]).furniture("a\n\nb") == frozenset()


def test_model_is_fitted_to_all_records(spark, tmp_path):
    """Shards of a larger table give one model; lines are counted over all of them."""
    letter = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    rows = []
    for k in range(9000):
        own = " ".join(f"word{letter(k * 31 % 997 + j)}" for j in range(26))
        rows.append((k, f"Home page\n\nThe plain river {own} of the tale {letter(k)}.", (f"title {k}",)))
    spark.createDataFrame(rows, "scrape_id bigint, content string, metadata struct<title: string>").write.parquet(str(tmp_path / "scrapes.parquet"))
    spark.createDataFrame([(1, "<nav><li><a href=/a>A</a></nav><article><p>One two.</p></article>")], "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    m = M.fit(spark, str(tmp_path))
    assert m.furniture(rows[8999][1]) == {1}
    known = {M.line_key(M.letters("Share this story")): 600}
    assert M.supposed([("Share this story\n\nx", None)], 6.0 * 50, 50.0, known)[0][1] == [M.FURNITURE, M.HIDDEN]


@need_data
def test_records_side_by_side_equal_one_by_one(model):
    """Trees, features and marginals of many records at once are those of each; so are spam verdicts."""
    import numpy as np

    m, _, records = model
    odd = ["", " \n ", "a ² 3\n日本 ab² 12。\n- [x 4](http://e.example/1) y\n1. b\n```\n\nx = 1\n```\n| a | b |\n[1, {\"a\": 2}]\n", "İ Σ ΑΣ\n> q\n\n*e*", "Home » News » x\nBy Ann Bee\n2020-01-02"]
    contents = odd + [c for c, _ in records[:150]]
    coded = M.Coded(contents)
    lines = [x for c in contents for x in M.tree(c)]
    got = defaultdict(list)
    for row, code in zip(coded.rows.tolist(), coded.codes.tolist()):
        got[row].append(int(coded.keys[code]))
    assert {x.text: sorted(got[k]) for x, k in zip(lines, coded.which.tolist())} == {x.text: sorted(map(M.feature_key, M.features(x.text))) for x in lines}
    assert [tuple(M.PLACES[k] for k in places) for places in coded.places.tolist()] == [x.place for x in lines] and coded.nos.tolist() == [x.no for x in lines]
    want = [p for c in contents for p in m.marginals(M.tree(c))]
    assert (1 / (1 + np.exp(-m.beliefs(coded)))).tolist() == pytest.approx(want)
    half = np.arange(0, len(contents), 2)
    assert m.beliefs(coded.of(half)).tolist() == pytest.approx(m.beliefs(M.Coded([contents[k] for k in half])).tolist())
    lists = ["\n".join(f"buy Foo lamp {k} https://h{k}.example/x" for k in range(n)) for n in (2, 20, 500)]
    assert K.Chain().are_spam(K.Seen(contents + lists)).tolist() == [K.Chain().is_spam(c) for c in contents + lists]


def test_shards_are_coded_once(spark, tmp_path):
    """What training has coded is what is judged: p4 has the rows of its model over the table; repeated deliveries count
    once."""
    rows = [(k, f"Home page\n\nThe plain river number {chr(97 + k % 26)}{chr(97 + k // 26)} runs " + "by the old mill and the long road " * 4 + "today.", (f"title {k}",)) for k in range(60)]
    rows += [rows[0], (100, None, None), (101, " \n ", None), (None, rows[1][1], None), (102, "Page not found", None)]
    spark.createDataFrame(rows, "scrape_id bigint, content string, metadata struct<title: string>").write.parquet(str(tmp_path / "scrapes.parquet"))
    spark.createDataFrame([(1, "<nav><li><a href=/a>A</a></nav><article><p>One two.</p></article>"), (2, None)], "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in M.p4_found(spark, str(tmp_path)).collect()]
    want = [tuple(r) for r in M.found_lines(spark.read.parquet(str(tmp_path / "scrapes.parquet")), M.fit(spark, str(tmp_path))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (0, 1) in got and (None, 1) in got and not any(i == 102 for i, _ in got)


def test_long_lines_are_no_messages():
    """A long line is filler at most; the lines beside it keep their numbers."""
    filler = "lorem ipsum dolor sit amet consectetur " * 9
    assert B.message_lines(f"{'error 404 page not found ' * 20}\nPage not found\n# {filler}\n{'-' * 300}page not found") == {2, 3, 4}


def test_messages_equal_enumeration():
    """Sum-product marginals are those of the full joint distribution."""
    import itertools
    import math

    edges = {k: v for k, v in zip(("item", "loose", "block", "page"), ((1.4, 0.6, 0.7, 1.3), (1.1, 0.9, 0.8, 1.2), (1.5, 0.5, 0.4, 1.6), (1.2, 0.9, 0.8, 1.1)))}
    m = M.Model({"alpha": 1.0, "beta": -0.7, "gamma": 0.4}, edges, 0.1)
    lines = M.tree("alpha\n- beta\n- gamma\n\nbeta\n\n- alpha")
    n, blocks = len(lines), lines[-1].block + 1
    weight = [0.0] * n
    total = 0.0
    for state in itertools.product((0, 1), repeat=1 + blocks + n):
        w = 1.0
        for b in range(blocks):
            w *= edges["page"][state[0] * 2 + state[1 + b]]
        for k, x in enumerate(lines):
            up = state[1 + blocks + x.parent] if x.parent >= 0 else state[1 + x.block]
            w *= edges[x.kind][up * 2 + state[1 + blocks + k]] * (math.exp(m.potential(x)) if state[1 + blocks + k] else 1)
        total += w
        for k in range(n):
            weight[k] += w * state[1 + blocks + k]
    assert m.marginals(lines) == pytest.approx([w / total for w in weight])
    assert m.marginals([]) == [] and m.furniture("\n \n") == frozenset()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab#-*|.\n`[]() ©1é日。", max_size=200))
def test_models_never_raise(text):
    M.Model({}, dict.fromkeys(("item", "loose", "block", "page"), (1.0, 1.0, 1.0, 1.0)), 0.0).furniture(text)
    B.is_residue(text, lambda _: frozenset())
    K.Chain().is_spam(text)
    L.text_lines(text)


PROSE = "The ferry crosses the river every morning. Nobody remembers who built the first landing. "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# 404 - Page not found", True),
        ("Home | News\n\nSeite nicht gefunden\n\n© 2020 X", True),
        ("Please enable JavaScript to continue.", True),
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", True),
        (PROSE + "Dear {{ first_name }}, welcome.", True),
        ("# %%TITLE%%\n\n" + PROSE, True),
        ("```\nHello {{ name }}\n```\n" + PROSE, False),
        ("Write `{{ name }}` in a template. " + PROSE, False),
        (PROSE * 3 + "\nPage not found", False),
        ("Older manuals asked visitors to enable JavaScript before anything of the page could be loaded at all, and yet this one starts quite early in the day without it.\n" + PROSE, False),
        (PROSE, False),
        ('{"a": "{x}"}\n' + PROSE, False),
        ("", False),
        (None, False),
    ],
)
def test_residue(text, want):
    assert B.is_residue(text, lambda _: frozenset()) is want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        *((x, True) for x in ("HTTP 500 server error", "Service unavailable", "Service down", "Image to go here", "Sorry, we can't find that page.", "La page demandée n'existe pas.", "This content isn’t available right now.")),
        *((x, True) for x in ("Der Zugriff auf diese Seite wurde gesperrt.", "Esta página ha sido eliminada.", "页面不存在", "ページが見つかりません", "Сервер временно недоступен", "Gateway timed out after 7 s", "Loading…", "# 404 - Page not found")),
        *((x, False) for x in ("The terror of the pages", "News and service", "Die Seite der Stadt", "Browse the archive", "He wrote 'page not found' on the door of the shop and left", "")),
    ],
)
def test_messages(line, want):
    assert B.is_message(line) is want


def test_words_stand_apart():
    names = lambda x: {n for n, bit in B._NAMES.items() for _, bits in B._concepts(x) if bits & bit}
    assert "error" not in names("terror") and "not" not in names("nothingness") and "error" in names("an error.") and "object" in names("该页面") and names("") == set()
    assert all(c in B._NAMES for r in B.RULES for c in r.split())


SHARE_PROMPT = "Please enable JavaScript to use the share buttons."


def test_recurrent_lines_are_subtracted_first(spark):
    """A notice below the articles of a host is no evidence anywhere on it; a message alone on its pages is."""
    rows, site = [], lambda h, k: (f"http://www.{h}.example:80/{k}",)
    for k in range(30):
        own = " ".join(f"Sentence number {w} of this article tells of the river." for w in range(k, k + 8))
        rows.append((k, own + "\n\n" + SHARE_PROMPT, site("a", k), "x", T0))
    rows.append((100, "# Note\n\nShort news item of the day here.\n\n" + SHARE_PROMPT, site("a", 100), "x", T0))
    rows.append((101, "# Note\n\nShort news item of the day here.\n\n" + SHARE_PROMPT, site("b", 1), "x", T0))  # not known on this host
    rows += [(200 + k, "Page not found", site("a", k), "x", T0) for k in range(12)]  # recurs, but never beside content
    rows.append((300, PROSE * 6 + "\nDear {{ name }},", site("a", 300), "x", T0))
    rows += [(400 + k, PROSE * 6 + "\n\n© {{ year }} Example", site("c", k), "x", T0) for k in range(8)]  # a host's footer
    rows += [(101, "old text", site("b", 1), "x", T0 - dt.timedelta(1)), (500, None, None, None, None), (501, "404 Page not found", None, None, None)]
    df = spark.createDataFrame(rows, SCRAPES)
    assert {r.scrape_id for r in B.found(df).collect()} == {101, *range(200, 212), 300, 501}
    none = {r.scrape_id for r in B.found(df, min_records=10**9, hosts=10**9).collect()}
    assert none == {100, 101, *range(200, 212), 300, *range(400, 408), 501}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\n".join(f"buy Foo lamp {k} https://h{k}.example/x" for k in range(20)), True),
        (" ".join(["best Foo lamp", "cheap Bar lamp", "sale Foo chair"] * 20), True),
        ("\n".join(f"SKU AB-{k}123 Foo lamp {k}.99" for k in range(20)), True),
        (" ".join(f"#fooTag{chr(97 + k)}bar" for k in range(26)), True),
        (PROSE * 10, False),
        ("Home\nNews\nContact\n\n" + PROSE, False),
        (PROSE * 2 + "\n\nRelated\n" + "\n".join(f"- [Some other story of the week](https://same.example/{k})" for k in range(4)), False),
        ('[{"a":1},{"b":2}]', False),
        ("```\n" + "x = 1\n" * 50 + "```", False),
        ("", False),
        (None, False),
    ],
)
def test_spam(text, want):
    assert K.Chain().is_spam(text) is want


def test_spam_judges_each_stretch_of_a_long_line():
    """A line of prose is not condemned by its worst stretch, nor a stuffed line saved by its best."""
    names = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "el", "or", "um") for c in ("is", "ta", "ro", "ve")]
    prose = lambda n, at=0: " ".join(f"The {names[k % 80]} keeps a {names[(k * 7 + k // 80) % 80]} near {names[(k * 11 + 3) % 80]}." for k in range(at, at + n))
    stuffed = lambda n: " ".join(f"The best {names[k % 4]} sells cheap {names[k * k % 5]} at {names[k % 7]}." for k in range(n))
    for text, want in ((prose(60) + " " + stuffed(18) + " " + prose(60, 60), False), (stuffed(18) + " " + prose(60), False), (prose(120), False), (stuffed(18), True), (prose(20) + " " + stuffed(120), True)):
        assert K.Chain().is_spam(text) is want


def test_lists_of_few_links_to_each_host():
    """Links to hosts that come again are weighed by the model, too; what it is not asked about stays prose or menu."""
    import itertools

    links = "\n".join(f"[Read all about the garden tools of shop {k}](https://h{k % 6}.example/{k})" for k in range(18))
    spam = K.Chain().is_spam
    assert spam(links) and spam("# Shops\n\n" + links) and not spam(links + "\n\n" + "\n".join([PROSE * 3] * 6))


def test_menus_alone_are_no_list():
    menu = "Home | News | Contact | About us\n" * 12
    assert not K.Chain().is_spam(menu) and not K.Chain().is_spam(menu + "\n" + PROSE * 4)
    assert K.Chain().is_spam(menu + "\n" + "\n".join(f"buy Foo lamp {k} https://h{k}.example/x" for k in range(20)))


def test_learning_raises_the_likelihood():
    """Each round of the learning gives the sequences a likelihood that is no lower; that of few is all paths' sum."""
    import itertools
    import math
    import random

    r = random.Random(3)
    seqs = [[r.randrange(len(K.SYMBOLS)) for _ in range(r.randint(1, 5))] for _ in range(40)] + [[]]

    def likelihood(c):
        total = 0.0
        for q in seqs:
            if q:
                total += math.log(sum(math.exp(c.start[p[0]] + sum(c.emissions[s][o] for s, o in zip(p, q)) + sum(c.transitions[a][b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(4), repeat=len(q))))
        return total

    got = [likelihood(K.learned(seqs, rounds=n, prior=1e-6)) for n in range(4)]
    assert got[0] < got[1] < got[2] < got[3]
    for c in (K.learned(seqs), K.learned([]), K.learned([[0]], prior=0.5)):
        assert all(sum(map(math.exp, row)) == pytest.approx(1) for row in (c.start, *c.transitions, *c.emissions))


def test_viterbi_equals_enumeration():
    import itertools

    seq = [0, 2, 6, 6, 1, 3, 5, 0]
    c = K.Chain()
    score = lambda p: c.start[p[0]] + sum(c.emissions[s][o] for s, o in zip(p, seq)) + sum(c.transitions[a][b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(4), repeat=len(seq)), key=score)
    assert score(c.states(seq)) == pytest.approx(score(best)) and c.states([]) == []


@need_data
def test_languages_on_held_out_passages():
    import pandas as pd

    d = pd.read_parquet(f"{SF}/lang_samples.parquet")
    first, rest = defaultdict(list), []
    for lang, g in d.groupby("lang"):
        first[lang] = list(g.text[:12])
        rest += [(lang, s) for t in g.text[12:] for s in L.sentences(t)]
    known = L.Languages({k: "\n".join(v) for k, v in first.items()})
    got = [known.classify(s)[0] == lang for lang, s in rest]
    assert len(got) > 150 and sum(got) / len(got) > 0.98
    assert known.classify("zzqx 12 %% kk ww 00 11 22")[1] < 0.2 and known.classify("")[0] is None
    de, en = " ".join(first["de"][0].split(". ")[:3]), ". ".join(first["en"][0].split(". ")[:3]) + "."
    page = L.Page.of(f"# Title\n\n{en}\n\n{first['de'][1]}\n\n```\n{de}\n```", known)
    assert page.languages() == ["de", "en"] and [s[2] for s in page.segments()] == ["en", "de"] and 0 < page.confidence("en") < 1


@need_data
def test_foreign_sentences_of_a_long_line():
    """Two foreign sentences are found wherever they stand in a line."""
    import pandas as pd

    d = pd.read_parquet(f"{SF}/lang_samples.parquet").sort_values("sample_id")
    text = {lang: list(g.text) for lang, g in d.groupby("lang")}
    known = L.Languages({k: "\n".join(v) for k, v in text.items()})
    one = {lang: [s for t in text[lang] for s in L.sentences(t) if known.classify(s)[0] == lang][:40] for lang in ("en", "de", "fr", "zh", "pl")}
    for own, foreign in (("en", "de"), ("fr", "en"), ("zh", "pl"), ("de", "fr")):
        for at in range(0, 28, 4):
            line = one[own][at : at + 12]
            for a, b in ((2, 9), (3, 4), (10, 11)):
                put = [*line]
                put[a], put[b] = one[foreign][at : at + 2]
                page = L.Page.of(" ".join(put), known)
                assert page.languages() == sorted((own, foreign)) and len(page.segments()) >= 2


@pytest.mark.parametrize(("label", "want"), [("en-US", "en"), ("deu", "de"), ("French", "fr"), (" ZH-Hans ", "zh"), ("und", ""), (None, ""), (" ", ""), ("unknown", ""), ("ko", "ko"), ("pt_BR", "pt")])
def test_labels(label, want):
    assert L.label_language(label) == want


# --- 8 ----------------------------------------------------------------------------------------------------------


@need_tokenizer
def test_ids_equal_a_public_encoder(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.TOKENIZER)
    t.encode_special_tokens = True
    texts = [None, "", " ", "<|endoftext|>", "it's  we'LL\n\n  x", "日本語のテキスト。", "é́​ ‮abc", "a" * 3000, "\t\r\n \x00\x1c", "123 45.6", "don't " * 40]
    df = spark.createDataFrame([(k, x, 7) for k, x in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in E.encode(df).collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in E.count_tokens(df.drop("ids")).collect()} == {k: len(v) for k, v in got.items()}
    assert E.encode(df.where("false")).count() == 0


@need_tokenizer
def test_ids_of_random_texts():
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.TOKENIZER)
    t.encode_special_tokens = True
    with open(E.TOKENIZER, "rb") as f:
        e = E.Encoder(f.read(), memory=50)  # a memory that is emptied again and again
    r = random.Random(5)
    texts = ["".join(r.choice(" \t\n 　ab1'sTé中²́​,.\r\x0b\x85the ") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for a in range(0, len(texts), 100):
        ids = [list(memoryview(x).cast("i")) for x in e.encode(texts[a : a + 100])]
        assert ids == [x.ids for x in t.encode_batch(texts[a : a + 100], add_special_tokens=False)]
    assert len(json.dumps(E.byte_symbols())) > 256 and len(set(E.byte_symbols())) == 256


def test_languages_know_the_boilerplate_of_hosts(spark):
    """A notice that recurs below the articles of a host does not make a short record of that host residue."""
    rows, site = [], lambda h, k: (f"http://www.{h}.example/{k}", None)
    for k in range(30):
        own = " ".join(f"Sentence number {w} of this article tells of the river." for w in range(k, k + 8))
        rows.append((k, own + "\n\n" + SHARE_PROMPT, site("a", k), "x", T0))
    short = "The ferry crosses the river every morning. Nobody remembers who built the first landing."
    rows += [(100, short + "\n\n" + SHARE_PROMPT, site("a", 100), "x", T0), (101, short + "\n\n" + SHARE_PROMPT, site("b", 1), "x", T0)]
    df = spark.createDataFrame(rows, "scrape_id bigint, content string, metadata struct<source_url: string, language: string>, final_url string, ingested_at timestamp_ntz")
    known = L.Languages({"en": PROSE * 20, "de": "Die Fähre quert den Fluss jeden Morgen. Niemand weiß noch, wer den Steg gebaut hat. " * 20})
    m = M.Model({}, {k: (1.0, 1.0, 1.0, 1.0) for k in M.KINDS}, -1.0)
    assert {r.scrape_id for r in L.found(df, known, m).collect()} & {100, 101} == {100}
    assert {r.scrape_id for r in L.segments(df, known, m).collect()} & {100, 101} == {100}
    assert {r.scrape_id for r in B.found(df).collect()} == {101}


@need_data
def test_languages_are_judged_where_records_are_coded(spark, tmp_path):
    """p3 has the rows of its model over the table, repeated and relabelled deliveries and residue included."""
    site = lambda k, lang, title=None: (f"http://www.a.example/{k}", lang, title)
    name = lambda k: "Al" + chr(97 + k % 26) + chr(97 + k // 26)
    german = lambda k: f"Die Fähre von {name(k)} quert den Fluss jeden Morgen, und im Winter fährt sie nur am Abend. Niemand in {name(k)} weiß noch, wer den alten Steg am Ufer gebaut hat, denn das ist lange her."
    english = lambda k: f"The ferry of {name(k)} crosses the river every morning, and in the winter it runs only in the evening. Nobody in {name(k)} remembers who built the old landing, since that was long ago."
    de = german(50)
    rows = [(k, f"# Tale {name(k)}\n\n" + (german if k % 3 else english)(k), site(k, ("en", "de", None, "xx")[k % 4], f"Tale {name(k)}"), "x", T0) for k in range(40)]
    rows += [rows[1], (*rows[1][:2], site(1, "en"), "x", T0), (60, "Page not found", site(60, "en"), "x", T0), (61, None, None, None, None), (62, " ", None, None, T0), (None, de, None, None, None), (63, german(63) + "\n\n" + english(63), site(63, "de"), "x", T0)]
    schema = "scrape_id bigint, content string, metadata struct<source_url: string, language: string, title: string>, final_url string, ingested_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "scrapes.parquet"))
    spark.createDataFrame([(1, "de", german(51) * 5), (2, "en", english(51) * 5)], "sample_id bigint, lang string, text string").write.parquet(str(tmp_path / "lang_samples.parquet"))
    (tmp_path / "pages.parquet").symlink_to(f"{SF}/pages.parquet")
    sf = str(tmp_path)
    got = [tuple(r) for r in L.p3_found(spark, sf).collect()]
    want = [tuple(r) for r in L.found(spark.read.parquet(f"{sf}/scrapes.parquet"), L.Languages(L.passages(spark, sf)), M.fit(spark, sf)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {(1, "de"), (4, "de"), (63, "de"), (63, "en"), (None, "de")} <= set(got) and not any(i == 60 for i, _ in got)
    assert sum(len(r.assessed) for r in M.prepare(spark, sf, judged=L.Suspects(L.Languages(L.passages(spark, sf)))).collect()) == 45  # one pass assesses all records that are not blank


def test_sentences_end_where_they_did():
    ends = re.compile(r"(?<=[.!?…])[\"'”’»)*_]*\s+|(?<=[。！？])[」』”’）]*\s*")
    for line in ("One two three. Four five six!  Seven", 'He "left it." Then (he ran.) So it goes... And on', "日本語。。テスト」です！？ x.", "a.. b? !c 。. d", ". . .", "", "x"):
        assert L.pieces(line) == ends.split(line)


# --- the operators over tables ------------------------------------------------------------------------------------


@need_data
def test_odd_tables(spark, model):
    m = model[0]
    known = L.Languages({"en": PROSE * 20, "de": "Die Fähre quert den Fluss jeden Morgen. Niemand weiß noch, wer den Steg gebaut hat. " * 20})
    schema = "scrape_id bigint, content string, metadata struct<source_url: string, language: string>, final_url string, ingested_at timestamp_ntz, lang string, line_no int"
    rows = [(1, PROSE * 2, ("http://a.example", None), "x", T0, "q", 1), (1, PROSE * 2, ("http://a.example", None), "x", T0, "q", 1), (2, None, None, None, None, None, None), (3, " \n ", None, "", T0, "", 0), (None, PROSE, None, None, None, None, None), (4, "404 - Page not found\n" * 3, ("http://a.example", "en"), "", T0, "", 0), (5, PROSE * 2000, ("http://a.example", "de"), "", T0, "", 0)]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r.scrape_id or 0, r.lang) for r in L.found(df, known, m).collect()) == [(0, "en"), (1, "en"), (5, "en")]
    assert [r.scrape_id for r in B.found(df).collect()] == [4]
    assert K.found(df).count() == 0
    assert {r.scrape_id for r in M.found_lines(df, m).collect()} <= {None, 1, 5}
    assert {r.scrape_id for r in L.segments(df, known, m).collect()} == {None, 1, 5}
    for none in (L.found(df.where("false"), known, m), B.found(df.where("false")), K.found(df.where("false")), M.found_lines(df.where("false"), m)):
        assert none.count() == 0
    assert K.fit(df).is_spam(None) is False and K.fit(df.where("false")).states([0, 0]) == K.Chain().states([0, 0])
    assert df.select(F.count("*")).first()[0] == len(rows)
