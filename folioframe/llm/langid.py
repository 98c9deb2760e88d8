"""Languages of texts and of their segments by rank-order profiles.

A language's profile ranks its n-grams (one to four characters, words padded) by frequency.  A text's distance to a
language is the out-of-place sum: how far each of the text's n-grams lies, by its own rank, from its place in the profile.
N-grams as frequent as each other share a rank.  Within one sentence nearly all n-grams occur once and share the first, so
a sentence's sum is that of the profile's ranks, taken word by word and kept per word; neighbouring sentences of one
language form a run, and each run is placed again by the ranks of its own n-grams, as is a whole file.  Only the languages
written in the text's script are compared; n-grams in none of their profiles tell nothing between them and are left out.

Profiles are fitted on a bounded sample of labelled documents (`TRAIN_DOCUMENTS` per language), twice: the second time
without the sample's sentences that the first profiles place elsewhere.  N-grams are counted where the texts lie; what
reaches the driver are the `PROFILE` first of each language.

Sentences are found by the sentence operator; running titles, page numbers and headings are left out, lines of scans are
joined first.  A segment is a longest run of sentences in one language; a sentence too close between two languages to tell
joins its neighbours, and so does a short one in the script of its neighbours or of a lone word or letter (a name, a mark).
Confidence is the relative margin of the second-best language's distance.

Defined results: null and empty texts and texts without letters have no language and give no rows; ids that are null are
left out; repeated rows give their rows once; codes come from `lang_codes` only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, spread
from .canonical import canonical
from .residue import labelled, seeds
from .scans import HYPHENS, MARKER, SPACELESS, form
from .sentences import units

PROFILE = 1200
TRAIN_DOCUMENTS = 120
#: A sentence leaves its text's language only with this relative margin and, in a script of the run before it, this many letters.
MARGIN, LETTERS = 0.06, 10
#: A character of Chinese and Japanese tells as much as so many letters.
HAN_LETTERS = 3

TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W\d_](?:[^\W\d_]|[̀-ًͯ-ٰٟัิ-ฺ็-๎'’])*")
SCRIPT, LENGTH, SUMS, IDS = map(itemgetter, range(4))
#: Words whose sums a process keeps.
KEPT_WORDS = 200_000
BRACKETED = re.compile(r"\([^()\n]*\)|（[^（）\n]*）|\[[^\[\]\n]*\]")


def script_of(ch: str) -> str:
    """A coarse script class of a letter."""
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    if 0x400 <= c < 0x530:
        return "cyrillic"
    if 0x590 <= c < 0x600:
        return "hebrew"
    if 0x600 <= c < 0x780 or 0xFB50 <= c < 0xFE00 or 0xFE70 <= c < 0xFF00:
        return "arabic"
    if 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00:
        return "han"
    return f"block{c >> 7}"


def grams(word: str) -> list[str]:
    """The n-grams of a lower-case word with its edges marked; of a Han or kana character just itself."""
    if len(word) == 1 and script_of(word) == "han":
        return [word]
    w = f"_{word}_"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def plain_units(text: str, scan: bool, forms: list[str] | None = None) -> list[str]:
    """The sentence units that can show a language: no titles, page numbers, headings, markers; references dropped."""
    kept = []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        if s and (forms[i] if forms else form(s)) == "text":
            kept.append(s)
        elif not s and not scan:
            kept.append("")
    if scan:
        parts: list[str] = []
        for s in kept:
            if parts and parts[-1][-1] in HYPHENS and parts[-1][-2:-1].isalpha() and s[:1].islower():
                parts[-1] = parts[-1][:-1]
            elif parts:
                parts.append(" ")
            parts.append(s)
        flat = "".join(parts)
    else:
        flat = "\n".join(kept)
    return [BRACKETED.sub(" ", flat[a:z]) for a, z in units(flat)]


class Profiles:
    """Rank-order profiles of languages, grouped by script."""

    def __init__(self, ranks: dict[str, dict[str, int]], scripts: dict[str, list[str]]):
        self.ranks, self.scripts = ranks, scripts
        self.memo: dict[str, tuple] = {}
        self.index: dict[str, dict[str, int]] = {}  # script → n-gram → its column
        self.table: dict[str, np.ndarray] = {}  # script → ranks by language and n-gram
        for s, langs in scripts.items():
            at = {g: i for i, g in enumerate(dict.fromkeys(g for lang in langs for g in ranks.get(lang, ())))}
            table = np.full((len(langs), len(at)), PROFILE, dtype=np.int64)
            for row, lang in zip(table, langs, strict=True):
                for g, r in ranks.get(lang, {}).items():
                    row[at[g]] = min(r, PROFILE)
            self.index[s], self.table[s] = at, table

    def word(self, w: str) -> tuple[str, int, tuple[int, ...], np.ndarray]:
        """(script, letters, out-of-place sums per language of the script, columns of its n-grams), kept per word."""
        got = self.memo.get(w)
        if got is None:
            s, gs = script_of(w[0]), grams(w)
            at = self.index.get(s, {})
            ids = np.array([at[g] for g in gs if g in at], dtype=np.int32)
            sums = tuple((self.table[s][:, ids].sum(axis=1) + PROFILE * (len(gs) - len(ids))).tolist()) if at else (0,) * len(self.scripts.get(s, ()))
            got = s, len(w), sums, ids
            if len(self.memo) > KEPT_WORDS:
                self.memo.clear()
            self.memo[w] = got
        return got

    def words(self, unit: str) -> list[tuple]:
        """The words of a unit that are in the script of most of its letters."""
        memo, word = self.memo, self.word
        infos = [memo.get(w) or word(w) for w in TOKEN.findall(unit.lower())]
        if len(set(map(SCRIPT, infos))) > 1:
            letters: Counter = Counter()
            for s, n, _, _ in infos:
                letters[s] += n
            main = letters.most_common(1)[0][0]
            infos = [i for i in infos if i[0] == main]
        return infos

    def place(self, infos: list[tuple]) -> tuple[str | None, float, int]:
        """(language, relative margin, letters) of one sentence's words."""
        if not infos:
            return None, 0.0, 0
        n, langs = sum(map(LENGTH, infos)), self.scripts.get(infos[0][0], ())
        if len(langs) < 2:
            return (langs[0], 1.0, n) if langs else (None, 0.0, n)
        vec = list(map(sum, zip(*map(SUMS, infos))))  # noqa: B905
        best, second = sorted(vec)[:2]
        return langs[vec.index(best)], (second - best) / second if second else 0.0, n

    def sentence(self, unit: str) -> tuple[str | None, float, int]:
        """(language, relative margin, letters) of one sentence."""
        return self.place(self.words(unit))

    def distance(self, infos: list[tuple], script: str) -> np.ndarray:
        """Out-of-place distances of a stretch to the script's languages, by the ranks of its own n-grams."""
        table = self.table[script]
        ids = [i[3] for i in infos if i[0] == script]
        counts = np.bincount(np.concatenate(ids), minlength=table.shape[1]) if ids else np.zeros(table.shape[1], dtype=np.int64)
        have = counts.nonzero()[0]
        own = counts[have]
        ranks = len(own) - np.searchsorted(np.sort(own), own, side="right")  # n-grams that are more frequent
        return np.abs(table[:, have] - ranks).sum(axis=1)

    def stretch(self, infos: list[tuple], lang: str) -> tuple[str, float]:
        """(language, confidence) of a stretch by its own ranks, among the languages of `lang`'s script."""
        scripts = [s for s, langs in self.scripts.items() if lang in langs]
        seen = Counter(i[0] for i in infos if i[0] in scripts)
        script = seen.most_common(1)[0][0] if seen else scripts[0]
        langs = self.scripts[script]
        if len(langs) < 2:
            return langs[0], 1.0
        d = self.distance(infos, script)
        best, second = np.argsort(d, kind="stable")[:2]
        return langs[best], float((d[second] - d[best]) / d[second]) if d[second] else 0.0

    def short(self, unit: str, lang: str, n: int, beside: str) -> bool:
        """Whether a sentence of under LETTERS letters is too short to be told from the language `beside` it."""
        toks = TOKEN.findall(unit.lower())
        if sum(map(len, toks)) < 2:
            return True
        script = Counter(script_of(w[0]) for w in toks for _ in w).most_common(1)[0][0]
        if lang in self.scripts.get(script, ()) and beside not in self.scripts[script]:
            return len(toks) < 2 and not SPACELESS.match(toks[0])
        return n * (HAN_LETTERS if script == "han" else 1) < LETTERS

    def segments(self, us: list[str]) -> list[tuple[str, float, int]]:
        """(language, confidence, sentences) of the longest runs of sentences in one language."""
        heard = list(map(self.words, us))
        told = list(map(self.place, heard))
        weight: Counter = Counter()
        for lang, margin, n in told:
            if lang:
                weight[lang] += n * min(1.0, margin + 0.01)
        if not weight:
            return []
        main = weight.most_common(1)[0][0]
        runs: list[list] = []  # language, words, sentences
        for u, infos, (lang, margin, n) in zip(us, heard, told, strict=True):
            beside = runs[-1][0] if runs else main
            if lang is None or lang != main and margin < MARGIN or n < LETTERS and self.short(u, lang, n, beside):
                if runs:
                    runs[-1][2] += 1
                continue
            if runs and runs[-1][0] == lang:
                runs[-1][1] += infos
                runs[-1][2] += 1
            else:
                runs.append([lang, list(infos), 1])
        if not runs:  # nothing but short units: all of them together
            lang, margin, n = self.sentence(" ".join(us))
            return [(lang, margin, len(us))] if lang else []
        out: list[list] = []
        for lang, infos, k in runs:
            lang, sure = self.stretch(infos, lang)
            if out and out[-1][0] == lang:
                out[-1][1] += sure * k
                out[-1][2] += k
            else:
                out.append([lang, sure * k, k])
        return [(lang, min(1.0, total / k), k) for lang, total, k in out]

    def main(self, us: list[str]) -> list[tuple[str, float, int]]:
        """The language of a whole file: that of most sentences, in a close call that of the file's own ranks."""
        runs = self.segments(us)
        if not runs:
            return []
        total: Counter = Counter()
        sure: Counter = Counter()
        for lang, conf, n in runs:
            total[lang] += n
            sure[lang] += conf * n
        first = total.most_common(2)
        lang = first[0][0]
        if len(first) > 1 and first[1][1] * 2 > total[lang]:
            near, _ = self.stretch([i for u in us for i in self.words(u)], lang)
            lang = near if near in total else lang
        return [(lang, sure[lang] / total[lang], sum(total.values()))]


def _sample(documents: DataFrame, codes: DataFrame, per_language: int) -> DataFrame:
    """(lang, units) of at most `per_language` documents of each language that carry its code, drawn by a hash of the id."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    labelled_rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= 80)).join(F.broadcast(codes), "lang", "left_semi")
    counts = labelled_rows.groupBy("lang").agg(F.count("*").alias("n"))
    # about 1.3 times as many as wanted are drawn, so that only a bounded number is put in order
    drawn = labelled_rows.withColumn("d", draw).join(F.broadcast(counts), "lang").where(F.col("d") < F.ceil(1_000_000 * 1.3 * per_language / F.col("n")))
    first = Window.partitionBy("lang").orderBy("d", "doc_id")
    rows = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("lang", "text", F.coalesce(F.col("layout") == "scan", F.lit(False)).alias("scan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [plain_units(canonical(t), scan) for t, scan in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], ["lang", "units"])

    return cut(rows.mapInArrow(run, "lang string, units array<string>"))


def _profiles(sample: DataFrame, model: Profiles | None) -> Profiles:
    """Profiles of the sample's sentences, of those that `model` places in their label's language where there is one."""
    shared = sample.sparkSession.sparkContext.broadcast((model.ranks, model.scripts) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Profiles(*shared.value) if shared.value else None
        words: Counter = Counter()
        for b in batches:
            for lang, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for u in us:
                    if judge is None or judge.sentence(u)[0] == lang:
                        words.update((lang, w) for w in TOKEN.findall(u.lower()))
        out: Counter = Counter()
        for (lang, w), n in words.items():
            s = script_of(w[0])
            out[lang, s, ""] += n  # the words of a script
            for g in grams(w):
                out[lang, s, g] += n
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*zip(*out, strict=True), out.values()) if out else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "script", "gram", "n"])

    counts = cut(sample.mapInArrow(run, "lang string, script string, gram string, n long").groupBy("lang", "script", "gram").agg(F.sum("n").alias("n")))
    every = Window.partitionBy("lang")
    own = counts.where("gram = ''").withColumn("all", F.sum("n").over(every)).where("n >= 0.5 * all").select("lang", "script")
    scripts: dict[str, list[str]] = {}
    for r in sorted(own.collect()):  # at most two of each language of the table of codes
        scripts.setdefault(r["script"], []).append(r["lang"])
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.where("gram <> ''").join(F.broadcast(own), ["lang", "script"], "left_semi").withColumn("r", F.row_number().over(order) - 1).where(F.col("r") < PROFILE)
    ranks: dict[str, dict[str, int]] = {}
    for r in top.select("lang", "gram", "r").collect():  # PROFILE of each language
        ranks.setdefault(r["lang"], {})[r["gram"]] = r["r"]
    return Profiles(ranks, scripts)


def fit(documents: DataFrame, lang_codes: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> Profiles:
    """Profiles from a bounded sample of documents that carry a valid code; fitted twice, the second time on what agrees."""
    sample = _sample(documents, lang_codes.where("lang is not null").select("lang").distinct(), per_language)
    return _profiles(sample, _profiles(sample, None))


SEGMENTS = "array<struct<lang:string,confidence:double,n_sentences:int>>"
RUNS = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())]))
COLUMNS = ["src", "id", "part_no", "lang", "confidence", "n_sentences"]


def _rows(runs: list[tuple[str, float, int]]) -> list[dict]:
    return [{"lang": lang, "confidence": round(float(conf), 4), "n_sentences": n} for lang, conf, n in runs]


def document_rows(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """What the residue operator reads of each text, with its segments and its label: every text is read once."""
    shared = documents.sparkSession.sparkContext.broadcast((profiles.ranks, profiles.scripts))
    model: list[Profiles] = []

    def read(text: str, scan: bool, forms: list[str] | None) -> list[dict]:
        if not model:
            model.append(Profiles(*shared.value))
        return _rows(model[0].segments(plain_units(text, scan, forms)) or model[0].segments([text]))

    return seeds(documents, read, SEGMENTS, RUNS, ("lang",))


def _parts(rows: DataFrame) -> DataFrame:
    """The segments of `document_rows` as rows."""
    return rows.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.posexplode("more").alias("k", "s")).select("src", "id", (F.col("k") + 1).alias("part_no"), "s.*")


def document_segments(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """Segments of the documents' texts."""
    return _parts(document_rows(documents, profiles))


def envelope_files(envelopes: DataFrame, profiles: Profiles) -> DataFrame:
    """The main language of every file that carries text: the record's own for a single record, each entry's in a batch."""
    entry = lambda i, t: F.struct(i.cast("int").alias("part_no"), t.alias("text"))
    files = F.when(F.col("files").isNotNull(), F.transform("files", lambda f, i: entry(i + 1, f["text"]))).otherwise(F.array(entry(F.lit(0), F.col("text"))))
    rows = envelopes.where("env_id is not null").select(F.col("env_id").cast("long").alias("id"), F.explode(files).alias("f")).where("f.text is not null and f.text <> ''")
    shared = envelopes.sparkSession.sparkContext.broadcast((profiles.ranks, profiles.scripts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(*shared.value)
        for b in batches:
            texts = map(canonical, b.column(2).to_pylist())
            got = [_rows(model.main(plain_units(t, True)) or model.main([t])) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, RUNS)], ["id", "part_no", "more"])

    got = spread(rows.select("id", "f.part_no", "f.text")).mapInArrow(run, f"id long, part_no int, more {SEGMENTS}")
    return got.select(F.lit("envelopes").alias("src"), "id", "part_no", F.explode("more").alias("s")).select("src", "id", "part_no", "s.*")


def segments(documents: DataFrame, envelopes: DataFrame, lang_codes: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """All segments of all texts with language and confidence."""
    model = profiles or fit(documents, lang_codes)
    return document_segments(documents, model).unionByName(envelope_files(envelopes, model)).distinct()


def found(documents: DataFrame, envelopes: DataFrame, lang_codes: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Segments of the documents with a missing or wrong label or several languages, residue left out, and all files."""
    model = profiles or fit(documents, lang_codes)
    rows = cut(document_rows(documents, model))
    cases = rows.where("size(more) > 1 or lang is null or lang <> get(more, 0).lang").select("doc_id", "more")
    cases = cases.join(labelled(documents, rows).select("doc_id"), "doc_id", "left_anti")
    cols = ["src", "id", "part_no", "lang"]
    return _parts(cases).select(*cols).unionByName(envelope_files(envelopes, model).select(*cols)).distinct()
