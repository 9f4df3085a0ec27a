"""What is done for a whole shard at once, against the same done piece by piece."""

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import coded, language, lines, mainbody, residue

PASSAGES = {
    "en": "The weather was fine and the children went down to the river. Nobody knew where the old man had come from. " * 3,
    "de": "Das Wetter war schön und die Kinder gingen hinunter zum Fluss. Niemand wusste, woher der alte Mann gekommen war. " * 3,
    "ru": "Погода была хорошая, и дети пошли к реке. Никто не знал, откуда пришёл старик. " * 3,
}
TEXTS = ["The children went down to the river.", "Niemand wusste, woher der alte Mann kam.", "Никто не знал, откуда он пришёл.", "Short one.", "", "这是一个句子。", "The children went down to the river.", "12345 67890 12345."]


def test_sentences_are_classified_together_as_alone():
    known = language.Languages(PASSAGES)
    assert known.classify_all(TEXTS) == [known.classify(t) for t in TEXTS]
    assert known.classify_all([]) == []
    assert {lang for lang, _ in known.classify_all(TEXTS)} >= {"en", "de", "ru"}


def test_hashes_of_lines_are_alike_where_those_of_problem_5_are(spark):
    contents = ["A line, 12.\n\n a LINE \n½ x² Ⅷ\n---", "[A](http://b.c) line\na line\nAlineⅧ", "ÄÖ ß\nİstanbul\n𝔘nicode 𝔘\näö ß!", ""]
    some = coded.Coded(contents[:2])
    got = [h for x in mainbody.letter_hashes(contents, some, mainbody.Marks(some, [None] * 2)) for h in x]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k long, c string").select("k", lines.line_hashes(F.col("c")).alias("h")).orderBy("k").collect()
    want = [h for r in rows for h in r["h"]]
    assert len(got) == len(want) and [h is None for h in got] == [h is None for h in want]
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_tokens_of_a_character_set_are_those_of_its_class():
    texts = ["Ein Wort, 12 Wörter_und ½ mehr", "中文 text 𝔘nicode 😀 x", "дом №5 · a|b", "٣ digits ①②"]
    rows, codes, keys, n, spelt = coded.features_of(texts)
    for k, text in enumerate(texts):
        assert n[k] == len(coded.words_of(text)) and list(filter(str.isalpha, spelt[k])) == list(filter(str.isalpha, coded.letters(text)))
        assert set(keys[codes[rows == k]].tolist()) == {coded.feature_key(f) for f in mainbody.features(text)}


def test_what_cannot_be_a_message_is_left_early_without_loss():
    for line in ["404 not found", "Oops, an error occurred.", "lorem ipsum dolor sit amet consectetur", "Loading...", "The page is about errors of style", "nothing here"]:
        said = 0
        for _, bits in residue._concepts(residue._bare(line).lower()):
            said |= bits
        assert residue.is_message(line, said) == residue.is_message(line)


def test_expected_edges_are_those_of_each_edge():
    c = coded.Coded(["# Title\n\nline one here\n- item\n- other\n\nmore", "- loose\n\nText."])
    forest = mainbody.Forest.of(c)
    log_edges = np.log(np.arange(1.0, 17.0).reshape(4, 2, 2))
    belief, expected = forest.beliefs(np.linspace(-1, 1, len(c.which)), log_edges)
    counts = np.bincount(np.concatenate((c.kind, np.full(len(forest.page), 3))), minlength=4)
    assert np.allclose(expected.sum(axis=(1, 2)), counts) and np.isfinite(belief).all()
