import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import canonical, sentences


def test_each_kind_of_change():
    pairs = {
        "ｄｅｒ １２": "der 12",
        "Graeca⁠s b﻿c": "Graecas bc",
        "a b c　d": "a b c d",
        "Tαmen": "Tamen",
        "χρησμόv": "χρησμόν",
        "пοздний": "поздний",
        "\u03bf\u0314": "\u1f41",
        "\u212a": "K",
        "\u1f71": "\u03ac",
        "cafe\u0301": "caf\u00e9",
    }
    for a, b in pairs.items():
        assert canonical.canonical(a) == b and canonical.needs_change(a) and not canonical.needs_change(b)
    for same in ("你好！（第２".replace("２", "2"), "κ.τ.λ. L'été", "a\nb", "Ω and α", "", None, "عربي ไทย"):
        assert canonical.canonical(same) == same and not canonical.needs_change(same)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeё́̀̈̂ά άοoоΩ ｱａ　​가각ᄀ이゙か", max_size=40))
def test_spliced_segments_equal_whole_normalisation(text):
    got = canonical.canonical(text)
    assert unicodedata.is_normalized("NFC", got) and not canonical.patterns()["odd"].search(got)
    assert canonical.canonical(got) == got
    odd, _ = canonical.tables()
    if not canonical.patterns()["mixed"].search(unicodedata.normalize("NFC", text.translate(odd))):
        assert got == unicodedata.normalize("NFC", text.translate(odd))


def test_tables(spark):
    df = spark.createDataFrame([(1, "ａ", "x"), (1, "ａ", "x"), (2, None, "x"), (3, "", "x"), (4, "b", "x"), (None, "ａ", "x")], "doc_id long, text string, changed string")
    assert [tuple(r) for r in canonical.found({"documents": df}).collect()] == [("documents", 1)]
    assert sorted((r.doc_id or 0, r.text or "", r.changed) for r in canonical.canonicalize(df).collect()) == [(0, "a", True), (1, "a", True), (1, "a", True), (2, "", False), (3, "", False), (4, "b", False)]
    assert canonical.found({"documents": df.limit(0)}).count() == 0


def split(text):
    return [text[a:z] for a, z in sentences.units(text)]


def test_sentences():
    cases = {
        "He saw M. Brown, cf. vol. 3, p. 7. Then he left!": ["He saw M. Brown, cf. vol. 3, p. 7.", "Then he left!"],
        "It weighs 3.5 kg. “Go! Now,” he said. She asked: “Why? Tell me.” He did not … answer.": ["It weighs 3.5 kg.", "“Go! Now,” he said.", "She asked: “Why? Tell me.”", "He did not … answer."],
        "Er kam im 17. Jahrhundert, usw. Die Hand schreibt: „Nein! Ja.“ Dann z. B. Bl. 3.": ["Er kam im 17. Jahrhundert, usw.", "Die Hand schreibt: „Nein! Ja.“", "Dann z. B. Bl. 3."],
        "ὁ ναύτης γράφει τὸν λόγον, κ.τ.λ. ὁ ξένος (στ. 6 κ.τ.λ. ἕως 7) ζητεῖ; ἡ βουλή λέγει· ναί.": ["ὁ ναύτης γράφει τὸν λόγον, κ.τ.λ.", "ὁ ξένος (στ. 6 κ.τ.λ. ἕως 7) ζητεῖ;", "ἡ βουλή λέγει· ναί."],
        "«Ὁ ξένος γράφει!» λέγει ὁ ναύτης. Τίς;": ["«Ὁ ξένος γράφει!» λέγει ὁ ναύτης.", "Τίς;"],
        "第一章……。他说：“好！走吧。”后来“走！”他说。为什么？": ["第一章……。", "他说：“好！走吧。”", "后来“走！”他说。", "为什么？"],
        "編者は「はい。いいえ！」と言う。次（第9巻。）。": ["編者は「はい。いいえ！」と言う。", "次（第9巻。）。"],
        "ผู้อ่านกล่าวว่า “ไป มา” ผู้แปล หน้ากว้าง 29.2 เซนติเมตร (ดูเล่ม 6 หน้า 8) ต่อมา": ["ผู้อ่านกล่าวว่า “ไป มา”", "ผู้แปล", "หน้ากว้าง 29.2 เซนติเมตร (ดูเล่ม 6 หน้า 8)", "ต่อมา"],
        "متى يقرأ؟ عرض 3.5 سم. انظر ج. 6، ص. 5 هنا.": ["متى يقرأ؟", "عرض 3.5 سم.", "انظر ج. 6، ص. 5 هنا."],
        "Chapter I\n  One.\r\nTwo": ["Chapter I", "One.", "Two"],
        "Πλάτος 2,6 εκ.. Ο λόγος.": ["Πλάτος 2,6 εκ..", "Ο λόγος."],
        " \n\t": [],
        "a; b; c. d": ["a; b; c. d"],
    }
    for text, want in cases.items():
        assert split(text) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB. !?;«»“”()\n ก。1", max_size=60))
def test_units_are_ordered_and_leave_only_space(text):
    us, at = sentences.units(text), 0
    for a, z in us:
        assert a >= at and z > a and not text[at:a].strip() and text[a:z] == text[a:z].strip()
        at = z
    assert not text[at:].strip()


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "run", "A. B"), (1, "run", "A. B"), (2, "scan", "x"), (3, None, "One. Two."), (4, "run", None), (None, "run", "x"), (5, "run", "Long one. " * 20000)], "doc_id long, layout string, text string")
    got = sentences.found(df)
    assert got.where("doc_id = 5").count() == 20000
    assert {tuple(r) for r in got.where("doc_id < 5").collect()} == {(1, 0, 4), (3, 0, 4), (3, 5, 9)}
    assert sentences.found(df.limit(0)).count() == 0
