import random
from collections import Counter

import pytest

from folioframe.llm import canonical, langid, residue, scans

DOCS = "doc_id long, edition_id long, source string, lang string, layout string, text string, kind string, digest string"


def docs(spark, rows):
    """(doc_id, lang, layout, text) with clashing extra columns."""
    return spark.createDataFrame([(i, 1, "s", lang, layout, text, "clash", "clash") for i, lang, layout, text in rows], DOCS)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "envelopes", "lang_codes")}


@pytest.fixture(scope="module")
def profiles(tables):
    return langid.fit(tables["documents"], tables["lang_codes"])


def test_held_out_labels_agree(tables, profiles):
    """Labels are right for most documents; texts outside the training sample must agree with nearly all plain ones."""
    rows = tables["documents"].where("lang in ('en','la','fr','ru','ar','th','el','grc') and length(text) > 300 and doc_id % 7 = 3 and layout <> 'scan'").collect()
    told = [(r.lang, langid.plain_units(canonical.canonical(r.text), False)) for r in rows]
    told = [(lang, profiles.segments(us)) for lang, us in told]
    plain = [(lang, s[0][0]) for lang, s in told if len(s) == 1]
    assert len(plain) > 40 and sum(a == b for a, b in plain) >= 0.85 * len(plain)


def test_segments(profiles):
    us = ["The reader copies the letter to the council.", "Philosophus quidam custodit codicem lacerum.", "Deinde magister legit librum antiquum.", "X.", "Читатель описывает порванный лист."]
    assert [(a, n) for a, _, n in profiles.segments(us)] == [("en", 1), ("la", 3), ("ru", 1)]
    assert profiles.segments([]) == [] and profiles.segments(["123"]) == []


def test_short_sentences_of_another_script(profiles):
    greek = ["Ὁ γραμματεὺς ἀντιγράφει τὴν ἐπιστολήν.", "Ὁ διδάσκαλος ἀναγιγνώσκει τὸ παλαιὸν βιβλίον.", "Ὁ ποιητὴς περιγράφει τὸν λόγον."]
    cut = lambda us: [(lang == "zh", n) for lang, _, n in profiles.segments(us)]
    assert cut([greek[0], "书页宽15.7厘米。", greek[1], "谁比较了破损的书页？", greek[2]]) == [(False, 1), (True, 1), (False, 1), (True, 1), (False, 1)]
    # a lone word or letter is a name or a mark
    assert [n for _, _, n in profiles.segments([greek[0], "X.", greek[1], "Wolf.", "页。", greek[2]])] == [6]


def test_language_rows(spark, tables, profiles):
    text = "The reader copies the letter to the council. The scribe restores the old reading."
    df = docs(spark, [(1, "en", "running", text), (2, None, "running", text), (2, None, "running", text), (3, "EN", "scan", text), (4, "en", "web", text + " Le lecteur décrit la ligne manquante."), (5, None, "web", ""), (6, None, "web", None), (None, "la", "web", text), (7, None, "web", "404 Not Found")])
    got = {tuple(r) for r in langid.found(df, tables["envelopes"].limit(0), tables["lang_codes"], profiles).collect()}
    assert got == {("documents", 2, 1, "en"), ("documents", 3, 1, "en"), ("documents", 4, 1, "en"), ("documents", 4, 2, "fr")}


def test_envelope_files(tables, profiles):
    got = langid.envelope_files(tables["envelopes"], profiles).select("id", "part_no", "lang").distinct().toPandas()
    assert not got.duplicated(["id", "part_no"]).any() and set(got.lang) <= {r.lang for r in tables["lang_codes"].collect()}


def test_no_training_data(spark, tables):
    empty = docs(spark, [])
    assert langid.found(empty, tables["envelopes"].limit(0), tables["lang_codes"]).count() == 0


WORDS = {"reader": 50, "copies": 50, "the": 500, "letter": 60, "council": 60, "well-known": 9, "modern": 40, "hand": 40}
CONFUSIONS = {("e", "c"), ("m", "rn"), ("in", "m"), ("i", "!"), ("l", "1")}


def model():
    text = ["ORDUNEX SCHOLIA 12", "the reader copies the letter", "to the council.", "", "13", "the reader copies"] * 3
    return scans.LineModel.fit([scans.observe(text)] * 5)


def cases(text):
    _, states, found, _, _ = scans.analyse(text, model(), scans.Lexicon(dict(WORDS), CONFUSIONS))
    return sorted(set(found)), states


def test_line_cases():
    text = "12 ORDUNEX SCHOLIA\nthe rcader copies the let-\nter to the coun\ncil. The well-\nknown modern hand\n[13]\n\n----- Page 2 -----\n\nORDUNEX XI\nthe rnodern hand copies the 1etter to the coun¬\ncil.\nChapter II\n82)."
    got, states = cases(text)
    assert got == [(0, "header"), (1, "hyphen"), (1, "misread"), (2, "hyphen"), (5, "page_number"), (9, "header"), (10, "hyphen"), (10, "misread")]
    assert states[7] == states[12] == "break" and states[13] == "body"


def test_rebuilt_paragraphs():
    text = "12 ORDUNEX SCHOLIA\nthe rcader copies the let-\nter to the coun\n\n----- Page 2 -----\n\nORDUNEX XI\ncil of the hand.\n\nthe reader"
    assert scans.rebuild(text, model(), scans.Lexicon(dict(WORDS), CONFUSIONS)) == "the reader copies the letter to the council of the hand.\n\nthe reader"
    assert scans.rebuild("", model(), scans.Lexicon({}, set())) == ""


def test_running_titles_in_any_case_and_script():
    m = model()
    for title in ("The Letters of Orduna", "จดหมายของออร์ดูนา", "書簡集"):
        text = "\n".join(f"----- Page {i} -----\n\n{title}{f" {i}" if " " in title else ""}\nthe reader copies the letter number {'abcdefghijkl'[i]}\nto the council.\n" for i in range(11))
        lines, states = scans.read_lines(text, m)
        assert [s for x, s in zip(lines, states, strict=True) if x.startswith(title)] == ["header"] * 11, title
        assert all(s == "body" for x, s in zip(lines, states, strict=True) if x.startswith(("the reader", "to the")))
    assert scans.observe(["a", " b"], ["a", "  b"]) == ["text100", "text111"]


def test_rarer_words_change_nothing(spark, monkeypatch):
    """The lexicon is the same whether its words go to every task, are asked for, or go with the texts that ask."""
    d = "/root/testdata/sf0.001"
    docs_, envs = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/envelopes.parquet")
    want = {tuple(r) for r in scans.line_cases(docs_, envs).collect()}
    monkeypatch.setattr(scans, "LEXICON_SHARE", 2e-3)
    learned = scans.learn(docs_, envs)
    assert learned.rare is None and {tuple(r) for r in scans.line_cases(docs_, envs, learned).collect()} == want
    monkeypatch.setattr(scans, "RARE_ROWS", 0)
    learned = scans.learn(docs_, envs)
    assert learned.rare.count() > 20 and len(learned.counts) < 200
    assert {tuple(r) for r in scans.line_cases(docs_, envs, learned).collect()} == want
    assert scans.repaired(docs_, envs, learned).count() > 0


def test_scan_tables(spark, tables):
    learned = scans.learn(tables["documents"], tables["envelopes"])
    assert ("e", "c") in learned.confusions
    got = scans.line_cases(tables["documents"], tables["envelopes"], learned).toPandas()
    assert set(got.kind) == {"header", "page_number", "hyphen", "misread"} and not got.duplicated().any()
    lines = {(r.src, r.id): r.text.split("\n") for r in scans.scanned_texts(tables["documents"], tables["envelopes"]).collect()}
    assert all(no < len(lines[src, i]) for src, i, no in got[["src", "id", "line_no"]].itertuples(index=False))
    empty = tables["documents"].limit(0), tables["envelopes"].limit(0)
    assert scans.line_cases(*empty).count() == 0 and scans.repaired(*empty).count() == 0


def test_labels():
    long_field = "{{ " + "_".join(["part"] * 40) + " }}"
    yes = [f"A {long_field} b", "A {{ page_count }} b", "x ${title} y", "the %(body_text)s", "[[PUBLICATION_YEAR]]", "<CHAPTER\nGOES HERE> z", "see [your name here]", "&lt;author&gt;", "Real text. Lorem ipsum dolor sit amet elit. More.", "TBD TBD TBD.",
           "Error 404: Not Found\nThe page at /a/b could not be found.\nHome | Search | Help", "Please enable JavaScript to view this edition.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Too Many Requests (429)", "ページが見つかりません\n番号12のページは削除されました。"]
    no = ["Editor verba {et} delenda esse putat.", "Post [[litteras]] nonnulla desunt.", "{καὶ} ὁ [9] {…}", "The paper explains why the viewer asked readers to enable JavaScript, and what replaced it.", "Item 404 of the inventory is a small quire.",
          "The note reads: page not found in the second copy.", "A cursive script is required reading.", "The specimen sheet set the words lorem ipsum in four sizes.", "Der Fehler 404 im Verzeichnis betrifft die zweite Spalte.", "Error 404 in the list of corrections concerns the breath mark."]
    assert [t for t in yes if not residue.label(t)[0]] == [] and [t for t in no if residue.label(t)[0]] == []


def test_simhash_and_bands_find_what_brute_force_finds(spark):
    rng = random.Random(5)
    words = [a + b + c for a in "abcdefgh" for b in "aeiou" for c in "klmnprstvw"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    near = []
    for b in base:
        w = b.split()
        w[30] = "changed"
        near.append(" ".join(w))
    hs = residue.hashes(base + near)
    rows = [(i, len(h), bits) for i, (h, bits) in enumerate(zip(hs, residue.simhashes(hs).tolist(), strict=True))]
    df = spark.createDataFrame(rows, "digest long, n_shingles int, bits array<long>")
    a, b = residue._bands(df.where("digest < 40"), True), residue._bands(df.where("digest >= 40"), False)
    pairs = {(r[0], r[1]) for r in a.withColumnRenamed("digest", "x").join(b, "key").select("x", "digest").distinct().collect()}
    truth = {(i, j) for i in range(40) for j in range(40, 80) if (c := len(set(hs[i]) & set(hs[j]))) >= 0.8 * len(set(hs[i]) | set(hs[j]))}
    assert len(truth) == 40 and len(truth & pairs) >= 0.9 * len(truth)


def test_labels_run_through_near_duplicates(spark):
    filler = " ".join(f"reload{c} notice item" for c in "abcdefghijklmnop")
    seed = f"Error 503: Service Unavailable\n{filler} please wait"
    rows = [(1, None, "web", "404 Not Found"), (2, None, "web", "404 Not Found"), (3, None, "web", "Editor verba {title} delenda"), (4, None, "web", "x ${title} y"), (5, None, "web", "Editor verba {et} delenda"), (6, None, "web", ""), (7, None, "web", None), (8, None, "web", "Plain words of real content here."), (4, None, "web", "x ${title} y")]
    df = docs(spark, rows)
    assert {r.doc_id for r in residue.found(df).collect()} == {1, 2, 3, 4}
    assert residue.label(seed)[0] in ("", "error")
    assert sorted(r.doc_id for r in residue.clean(df).collect()) == [5, 6, 7, 8]
    assert residue.found(df.limit(0)).count() == 0


def test_carried_label(spark, monkeypatch):
    """An unlabelled text near a labelled whole page gets its label, one near a text with a field does not."""
    body, other = (" ".join(f"{w}{c}{d}" for c in "abcdefgh" for d in "abcdef") for w in ("term", "other"))
    mark = lambda t, *_: residue.Label("error", True) if "SEED" in t else residue.Label("placeholder", names=["title"]) if "FIELD" in t else residue.Label()
    df = docs(spark, [(1, None, "web", f"{body} SEED"), (2, None, "web", f"{body} end"), (3, None, "web", f"{other} FIELD"), (4, None, "web", f"{other} end"), (5, None, "web", f"{body} end more")])
    rows = []
    for r in df.collect():
        h = residue.hashes([r.text])[0]
        got = mark(r.text)
        rows.append((r.doc_id, got.kind, got.whole, got.trusted, got.names, got.doubtful, [], residue.digest(h), len(h), residue.simhashes([h]).tolist()[0]))
    got = residue.labelled(df, spark.createDataFrame(rows, residue.SEEDS)).collect()
    assert {(r.doc_id, r.kind, r.how) for r in got} == {(1, "error", "text"), (2, "error", "link"), (3, "placeholder", "text"), (5, "error", "link")}


def test_doubtful_pages_need_a_link(spark):
    """A page of messages that a book could hold as well is a case only beside a trusted page with the same message."""
    closed, moved = "The scan at /items/{}/page is closed for maintenance.", "The volume has been moved or withdrawn."
    rows = [(1, f"Error 404: Not Found\n{closed.format(12)}"), (2, f"{closed.format(7)} Please try again later."), (3, moved), (4, f"We hit a problem\n{closed.format(9)}"), (5, "The scribe restores the old reading of the letter.")]
    got = residue.labelled(docs(spark, [(i, None, "web", t) for i, t in rows])).collect()
    assert {(r.doc_id, r.how) for r in got} == {(1, "text"), (2, "link"), (4, "link")}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7)]
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in residue.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert residue.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(residue, "HOT_PROBES", 3)
    monkeypatch.setattr(residue, "SALTS", 4)
    table = spark.createDataFrame([(i, i % 2) for i in range(20)], "digest long, key long")
    probes = spark.createDataFrame([(100 + i, i % 7 // 6) for i in range(20)], '`from` long, key long')
    got = {tuple(r) for r in residue._matched(table, probes).collect()}
    assert got == {(i, 100 + j) for i in range(20) for j in range(20) if i % 2 == j % 7 // 6}


def test_simhash_counts_bits():
    import numpy as np

    text = " ".join(f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrs" for c in "tuvwxyz")
    sets = residue.hashes([text, "", "one", "a b c d e f", text[:2000], *[text[i:] for i in range(0, 2400, 30)]])
    for h, bits in zip(sets, residue.simhashes(sets).tolist(), strict=True):
        wide = np.stack([(h ^ (h >> np.uint64(31))) * o for o in residue._ODD[:4]], axis=1)
        wide ^= wide >> np.uint64(29)
        ones = np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0) if len(h) else np.zeros(256)
        assert bits == np.packbits(2 * ones > len(h)).view(np.int64).tolist()
    assert residue.simhashes([]).tolist() == []


def test_labels_at_every_length():
    trace = "Traceback (most recent call last):\n" + "\n".join(f'File "/srv/reader/view_{i}.py", line {i + 3}, in render' for i in range(60)) + "\nValueError: no such page"
    log = "\n".join(f"Error 502: Bad Gateway\nThe server sent an invalid response at {i}." for i in range(400))
    assert len(log) > 10_000 and residue.label(trace)[:2] == residue.label(log)[:2] == ("error", True)
    content = "The scribe restores the old reading of the letter and sends the copy to the council.\n" * 200
    assert residue.label("Error 502: Bad Gateway\n" + content)[0] == ""
    nav = "Home | Search | Help\n"
    assert all(words(nav + t) == words(t) for t in (content, content[:90]))


def words(text):
    return residue.tokens([text])[0].tolist()


def test_tokens():
    assert len(words("One, two_three 4a5 漢字 ab漢")) == 8 and words("") == words(" .\n") == []
    assert words("Page 12 of 9") == words("page 7 OF 12345") and words("at /vol/1/page now") == words("at /items/88.html now")
    assert words("ab c") != words("a bc") and words("ab") != words("ba")
    assert len(set(words(" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")))) == 512
    assert len(words("x" * 3_000_000)) == 1
    h, of = residue.tokens(["a b", "", "c", "b"])
    assert of.tolist() == [0, 0, 2, 3] and h[1] == h[3]


def test_no_pattern_is_gated_away():
    filler = ["TBC TBC TBC.", "TBA, TBA.", "Example text", "Your summary here", "The caption here", "Texte d'exemple", "Faux texte", "Testo di prova", "Testo di esempio", "Заполняющий текст", "Пример текста", "此处填写书名", "此处输入内容", "ここに本文を入力", "xx-xx-xx.",
              "Velit esse cillum dolore.", "Nulla vitae massa sed.", "Ut labore et dolore.", "Magna aliqua ut enim."]
    pages = ["Rate limit reached", "The server is down", "Method not allowed", "Not acceptable"]
    assert [t for t in filler if residue.label(t)[0] != "filler"] == [] and [t for t in pages if residue.label(t)[:2] != ("error", True)] == []
    assert all(way for p in residue.FILLERS + residue.ERRORS + residue.DEMANDS for way in residue.literals(p))
