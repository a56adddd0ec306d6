import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewise.llm import sentences

CASES = [
    ["Dr. Quillo measured 4.5 m of rope, i.e. about 3 steps.", "The file clip_1.mp4 ends at 7.5."],
    ["The scene starts at 7 p.m.", "The anchor rolled away...", "Well... the baker left."],
    ['"Wait! Leave it!" shouted the baker.', "He asked, “Where is it? Here?”", "The man (see p. 5!) left."],
    ["Mr. Calwe Jr. and Mrs. Isbet share it.", "J. Velm wrote v1.2.3 at St. Kessin.", "Is it here?"],
    ["Dr. Pelda kam am 3. Mai um ca. 3 Uhr an.", "„Halt! Wo ist sie?“, rief der Fischer.", "Nur im 3. Teil usw. steht es."],
    ["« Attention ! Où est-elle ? » cria le berger.", "M. Hespa l'a vu à 22 h 30.", "Le berger part."],
    ["«¡Corre! ¿No ves?», gritó él.", "La Sra. Orsa llegó a las 4 p. m. con la caja.", "¡Qué caja!"],
    ["«Стой! Где он?» — крикнул сторож.", "Г. Н. Велмов написал и т. д. без ошибок.", "См. рис. 3."],
    ["“रुको! पहिया कहाँ है?” नाविक ने पूछा।", "डॉ. वेल्म ने 4.3 मीटर रस्सी नापी।"],
    ["«قف! أين المفتاح؟» صاح البحار.", "قال د. فلم إن المشهد يدوم 9.3 ثانية.", "ما أجمل الحبل!"],
]
SMALL = [
    ["dr. pelda kam am 3. mai um ca. 3 uhr an.", "der fischer fand sie erst am turm."],
    ["at 6:26 p.m. the painter left.", "the scene starts at 7 p.m.", "see fig. 2 and clip no. 7 for the cup.", "mr. kessin jr. and mrs. orsa share it!", "is it here?"],
]
TIGHT = [
    ["“快停下！木桶在哪里？”牧羊人喊道。", "他说：“好吧……走吧。”然后离开了。", "第3.87节（见图20！）很好。"],
    ["「もういい。帰ろう。」と言って、出た。", "ええと……画家は忘れた。", "なんてきれいな箱だ！"],
]


@pytest.mark.parametrize("parts", CASES + SMALL)
def test_spaced_scripts(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


@pytest.mark.parametrize("parts", TIGHT)
def test_scripts_without_spaces(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_blocks_tags_labels_and_thai():
    text = "<think> A cup fell. It broke. </think>\r\n\r\n## Part 2\n \nA) One line\nbroken up.\n\nกล่องยังอยู่ ร่มหาย 9 นาที\n\n"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["<think> A cup fell.", "It broke. </think>", "## Part 2", "A) One line\nbroken up.", "กล่องยังอยู่", "ร่มหาย 9 นาที"]


def test_document_evidence_settles_unknown_abbreviations():
    text = "Look at qrst. 5 and qrst. seven. The qrst. 9 is old."
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["Look at qrst. 5 and qrst. seven.", "The qrst. 9 is old."]


def test_document_evidence_joins_unknown_abbreviations_and_names():
    seen = "We asked the qrst. about it, and the qrst. was late, as Velm had said."
    for last in (["Then qrst. Velm came.", "He left."], ["Then the qrst.", "He left Velm."], ["Velm saw the barn.", "Velm left."]):
        text = " ".join([seen, *last])
        assert [text[a:b] for a, b in sentences.sentences(text)] == [seen, *last]
    text = "So the qrst. and Velm met. Then qrst. Velm saw a velm."
    assert len(sentences.sentences(text)) == 3
    text = "He saw Velm. Then qrst. Velm came."
    assert len(sentences.sentences(text)) == 3 and len(sentences.sentences(text, {"qrst": "inside"})) == 2


def corpus(spark, texts):
    rows = sentences.corpus_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    return {r.word: r.kind for r in rows if not r.is_name}, {r.word for r in rows if r.is_name}


FILLER = ["The barn was red. Some went home.", "We saw the barn. It was late, as Velm had said. Velm left.", "Orsa left the barn.", "He met Orsa and Velm. Orsa ran."]
CORPUS = [f"We asked xdr. {n} at {k} xpm. the day. So {n} left at {k} xpm.\n\nIt was xnr. {k}, or xetc. and so on. He ran." for k, n in enumerate(["Velm", "Orsa", "Quillo", "Hespa"] * 30, 1)] + FILLER * 40


def test_corpus_statistics_replace_the_lists(spark):
    words, names = corpus(spark, CORPUS)
    assert {w: words.get(w) for w in ("xdr", "xpm", "xnr", "xetc", "barn", "home")} == {"xdr": "leading", "xpm": "trailing", "xnr": "leading", "xetc": "inside", "barn": None, "home": None}
    assert "orsa" in names and "it" not in names
    parts = ["Then xdr. Stav came at 7 xpm.", "The xnr. 4 was there.", "It had rope, nails xetc. and a barn.", "Tell xetc. Orsa that."]
    assert [a for a, b in zip(parts, sentences_of(" ".join(parts), words, names)) if a != b] == []
    lowered = "at 6:26 xpm. the painter left. the scene starts at 7 xpm. see xnr. 2."
    assert sentences_of(lowered, words, names) == ["at 6:26 xpm. the painter left.", "the scene starts at 7 xpm.", "see xnr. 2."]


def sentences_of(text, words=None, names=frozenset(), lists=False):
    return [text[a:b] for a, b in sentences.sentences(text, words, names, lists)]


def test_document_outweighs_corpus_and_lists():
    seen = "We saw the fig. at the wall.\n\nIt was a fig.\n\nHere is the fig. The tree is old."
    assert sentences_of(seen, {"fig": "leading"}, lists=True)[-2:] == ["Here is the fig.", "The tree is old."]
    assert sentences_of("Here is the fig. The tree is old.", {"fig": "ordinary"}, lists=True) == ["Here is the fig.", "The tree is old."]
    judge = sentences.Judge("See fig. The end. Go.", {"fig": "leading"}, set())
    sentences.spans(judge.text, judge)
    assert judge.asked == {"corpus": 1, "none": 1}


def test_lists_are_not_needed_over_the_test_corpus(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sentences.corpus_words(documents).collect()
    words, names = {r.word: r.kind for r in rows if not r.is_name}, {r.word for r in rows if r.is_name}
    texts = [r.text for r in documents.select("text").limit(1500).collect()]
    changed = sum(len(set(sentences.sentences(t, words, names)) ^ set(sentences.sentences(t, words, names, lists=False))) for t in texts)
    assert changed <= 0.01 * sum(len(sentences.sentences(t, words, names)) for t in texts)


def test_quotations_of_any_length_hold_their_sentences():
    for n in (1, 100, 3000):
        inner = "It fell. " * n
        text = f"He said, “{inner}So it was,” and left. Then (see it. {inner}) he ran. She said \"{inner}Ok\" twice. End."
        assert len(sentences.sentences(text)) == 4


def test_long_abbreviations_and_decomposed_letters():
    text = "Die abkürzungswort. und die abkürzungswort. neun. Die abkürzungswort. Velm ging, weil Velm wollte."
    assert sentences_of(text)[:2] == ["Die abkürzungswort. und die abkürzungswort. neun.", "Die abkürzungswort. Velm ging, weil Velm wollte."]
    assert sentences_of("Véase la pa\u0301g. 94 o no.", {"pág": "leading"}) == ["Véase la pa\u0301g. 94 o no."]


def test_joined_statistics_equal_broadcast_ones(spark, monkeypatch):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(CORPUS[:200] + ["Then xdr. Stav came. xetc. Orsa left.", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, sentences.document_sentences(df).collect()))
    monkeypatch.setattr(sentences, "MOST_BROADCAST", 0)
    assert sorted(map(str, sentences.document_sentences(df).collect())) == want


def test_table_forms(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "Yes. No."), (5, "x" * 50_000)], "doc_id long, text string")
    assert sorted(tuple(r) for r in sentences.document_sentences(df).collect()) == [(4, 0, 4), (4, 5, 8), (5, 0, 50_000)]
    assert sentences.document_sentences(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA.!?\n \"()“”„«»。Ж1>", max_size=60))
def test_sentences_cover_everything_but_white_space(text):
    spans = sentences.sentences(text)
    covered = set()
    for a, b in spans:
        assert a < b and not text[a].isspace() and not text[b - 1].isspace()
        assert not covered & set(range(a, b))
        covered |= set(range(a, b))
    assert all(text[k].isspace() for k in range(len(text)) if k not in covered)


def test_very_long_blocks_take_linear_time():
    import time

    text = 'He said "so" (or not. Then "stop. ' * 30_000
    began = time.process_time()
    spans = sentences.sentences(text)
    assert len(spans) > 20_000 and time.process_time() - began < 60
