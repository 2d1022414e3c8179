"""Toxic texts: what a lexicon must not lose, and errors of every kind of term."""

from docforge.llm import toxicity


def _plain(i):
    return " ".join(f"w{(i * 7 + k) % 97}x" for k in range(12))


def test_a_shared_header_and_footer_hide_no_text():
    head, foot = "Licensed under the common terms of this one site; all rights kept. ", " End of the page, see the common terms of this one site."
    texts, y = [], []
    for i in range(300):  # a clean text with the same ends always comes first
        bad = i % 3 == 1
        texts.append(head + _plain(i) + (f" blockhead n{i} " if bad else " friend ") + _plain(i + 50) + foot)
        y.append(int(bad))
    words, stems = toxicity.lexicon(texts, y)
    assert any("blockhead".startswith(t) for t in (*words, *stems))


def test_copies_speak_once_and_changed_words_still_speak():
    base = " ".join(f"copied{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    texts = [base] * 30 + [base.upper()] * 30 + [base.replace("copiedcb", f"blockhead n{i}") for i in range(30)]
    texts += [_plain(i) + " some clean text" for i in range(300)]
    names, numbers = toxicity._own_words(texts, [1] * 90 + [0] * 300)
    own = [{names[k] for k in x} for x in numbers]
    assert len(own[0]) == 100 and not any(own[1:60]) and all(w == {"blockhead", f"n{i}"} for i, w in enumerate(own[60:90]))
    words, stems = toxicity.lexicon(texts, [1] * 90 + [0] * 300)
    assert any("blockhead".startswith(t) for t in (*words, *stems)) and not any(t.startswith("copied") for t in (*words, *stems))


def _kinds(m, text):
    return [h[0] for h in m.hits(text)]


def test_errors_in_short_words_stems_and_words_under_a_stem():
    m = toxicity.Matcher(["scum", "pathetic", "loweiguts"], ["lowei", "vequ"])
    for w in ("scun", "scm", "scuum", "csum"):
        assert _kinds(m, w) == [toxicity.SHORT], w
    for w in ("loewixyz", "lwoeixyz", "loweixyz"[1:], "loxeixyz", "lowweixyz"):
        assert _kinds(m, w) == [toxicity.NEAR], w
    assert _kinds(m, "lxweiguts") == _kinds(m, "olweiguts") == [toxicity.UNDER] and _kinds(m, "loweiguts") == [toxicity.STEM]
    assert _kinds(m, "patehtic") == _kinds(m, "apthetic") == [toxicity.FUZZY]
    assert _kinds(m, "pate htic") == _kinds(m, "ptaehtic") == _kinds(m, "s c u m") == []


def test_a_digit_or_mark_inside_a_word():
    m = toxicity.Matcher(["scum", "pathetic"], ["lowei"])
    assert m.hits("so path3tic, p@thetic pat-hetic sc*m, lo1eixyz scum.pathetic") == [
        (2, 3, 11), (2, 13, 21), (2, 22, 31), (4, 32, 36), (5, 38, 46), (1, 47, 51), (1, 52, 60),
    ]


def test_words_of_clean_texts_are_no_misspellings():
    texts = [f"n{i} " + ("you scum there" if i % 4 == 0 else "a big scam there") + f" m{i % 9}" for i in range(400)]
    model = toxicity.Model(["scum"], [], 0.25)
    y = [int(i % 4 == 0) for i in range(400)]
    import numpy as np

    model.fit(texts, np.array(y), np.ones(400))
    assert model.plain == {"scam"} and model.score("you scun") > model.score("a scam") and model.score("you scum") > 0.9


def test_terms_of_any_script():
    words = ["馬鹿野郎", "バカ野郎共です", "바보같은놈", "дурак", "𐐨𐐩𐐪𐐫", "scum"]
    m = toxicity.Matcher(words, ["ばかや"])
    assert [_kinds(m, w) for w in words] == [[toxicity.EXACT]] * 6
    assert _kinds(m, "バカ野郎供です") == [toxicity.FUZZY] and _kinds(m, "ばかやろう") == [toxicity.STEM] and _kinds(m, "дурка") == [toxicity.SHORT]
    assert _kinds(m, "漢字 ひらがな 한글 \U0010ffff") == [] and _kinds(toxicity.Matcher([], []), "漢字 a") == []
    many = [chr(0x4E00 + i) * 2 + "x" for i in range(400)]  # more letters than one byte numbers
    big = toxicity.Matcher(many, [])
    assert all(_kinds(big, w) == [toxicity.EXACT] for w in many)
    assert all(bool(toxicity._TOKEN.fullmatch(chr(c))) == bool(toxicity._LETTERS[c]) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def test_a_corpus_of_another_script(spark):
    rows = [(i, f"文章 番号{i} " + ("馬鹿野郎 " if i % 4 == 0 else "良い言葉 ") + f"終わり{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.words and model.score("馬鹿野郎") > 0.5 > model.score("良い言葉")
