"""Noise in text from scanned pages: line labels, broken and misrecognised words, and repaired paragraphs.

A hidden Markov model over the lines of a text labels each as running title, page number, body or break (blank, marker,
section heading).  Its observations are layout features of the line and its neighbourhood: its form, whether it stands at
the edge of a page, whether it comes again at the edges of other pages of the text (in any case and script), whether it is
indented, and whether the text before it is unfinished.  Transitions and emissions are trained by Viterbi training on a
bounded sample of texts (`TRAIN_TEXTS`), observed where they lie.  Paragraphs are reassembled from the body lines.  Broken
words are told by the mark at the line's end or, without a mark, by a lexicon; misrecognised words by a noisy channel: an
unknown word that a learned character confusion turns into a word of the lexicon.

The lexicon are all words that occur twice or more in clean text, counted over all texts with partial sums where they lie.
Words with a share of at least `LEXICON_SHARE` (hence at most 1 / LEXICON_SHARE of them) go to every task; of the rarer ones
those that a scanned text asks for (its unknown words, words joined over lines, and what the confusions make of them) are
found by a join and go along with them, or, where they are too many for that, with the text that asks.  Confusions are
learned from all words that occur only in scans, by a join with the whole lexicon on keys with one or two open places.

Defined results: null and empty texts give no rows and null or empty repaired text; repeated rows give their rows once;
texts of any length are read whole; where there is no clean text at all the lexicon is taken from the scans.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_collect, cut, spread
from .canonical import ASTRAL, canonical, ranges

LEXICON_SHARE = 2e-6
TRAIN_TEXTS = 2000
#: A confusion is learned from at least this many different words …
CONFUSION_WORDS = 3
#: … and at least this share of all words a confusion could explain, …
CONFUSION_SHARE = 0.0005
#: … and a correction must be this many times as frequent as what was read.
CORRECTION_RATIO = 5
STATES = ("header", "page_number", "body", "break")
HYPHENS = "-‐¬⸗=­"

MARKER = re.compile(r"^-{3,}\s.*\s-{3,}$")
NUMBER = re.compile(r"^[^\w)]*(?:(?:pp?|pag|page|s|seite|σ|σελ|с|стр|ص)\.?\s*)?(?=[0-9lIOoSBZ|!]*[0-9])[0-9lIOoSBZ|!]{1,5}[^\w):,;!?]*$|^[^\w)]*(?:pp?\.\s*)?[lIOo|]{2,3}[^\w.!?:,;)]*$|^\(\s*\d{1,4}\s*\)$", re.I)
ROMAN = re.compile(r"^[^\w)]*(?:pp?\.?\s*)?(?=[mdclxvi])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|x[l1]|[l1]?x{0,3})(?:ix|iv|v?[i1]{0,3})[^\w):,;!?]*$")
HEADING = re.compile(r"^(?:[^\W\d_]|[!|̀-ͯะ-๎])+\.?\s+(?:[IVXLCDM1l]{1,8}\.?|\d{1,3})$")
NUMBERISH = re.compile(r"(?:\bpp?\.\s*)?[\[(·–—\-\s]*\b(?:[0-9lIOoSBZ|!]*\d[0-9lIOoSBZ|!]*|[mdclxvi]{1,15})\b[\])·–—\-.\s]*")
WORD = re.compile(r"[^\W_]+(?:['’!|\-‐][^\W_]+)*")
SPACELESS = re.compile("[฀-๿぀-ヿ㐀-鿿]")
LETTER = re.compile(r"[^\W\d_]")
#: Capital letters, with and without those of the upper planes: the smaller class is searched faster.
CAPITALS, ALL_CAPITALS = (re.compile(f"[{ranges([c for c in range(top) if chr(c).lower() != chr(c)])}]") for top in (0x10000, 0x20000))
ENDS = re.compile(r"[.!?;·。！？؟:…][\"'»”’)\]」』）]*$")


def form(line: str) -> str:
    """The layout form of a stripped line."""
    if not line:
        return "blank"
    if MARKER.match(line):
        return "marker"
    if len(line) <= 24 and (NUMBER.match(line) or ROMAN.match(line)):
        return "number"
    if len(line) <= 70:
        if len(line) <= 40 and HEADING.match(line) and not line[0].islower() and not line.split()[0][1:2].isupper():
            return "heading"
        if len((ALL_CAPITALS if ASTRAL.search(line) else CAPITALS).sub("", line)) > len(line) - 4:  # fewer than four capitals
            return "text"
        bare = NUMBERISH.sub(" ", line, count=2)  # a title has a page number, not a row of them
        upper, lower = sum(c.isupper() for c in bare), sum(c.islower() for c in bare)
        if upper >= 4 and upper >= 0.7 * (upper + lower) and not SPACELESS.search(bare) and max(map(len, bare.split()), default=0) >= 4:
            return "capsnum" if len(bare.strip()) < len(line.strip()) - 1 else "caps"
    return "text"


#: A line that stands at so many page edges of a text is a running title's.
RECURRENCES = 3
KEY = re.compile(r"[\W\d_]+")


def observe(lines: list[str], raw: list[str] | None = None) -> list[str]:
    """The observation of each line: its form, whether it lies at a page's edge, whether the text before is unfinished, and
    whether it is indented (told from the lines as they are in `raw`)."""
    forms = [form(x) for x in lines]
    n, out, unfinished = len(lines), [], False
    edges = [i == 0 or i == n - 1 or forms[i - 1] in ("blank", "marker", "number") or forms[i + 1] in ("blank", "marker", "number") for i in range(n)]
    # titles come again at page edges, whatever stands beside them
    keys = {i: KEY.sub("", lines[i]).casefold() for i in range(n) if edges[i] and forms[i] == "text" and len(lines[i]) <= 70 and not ENDS.search(lines[i])}
    seen = Counter(keys.values())
    for i, f in enumerate(forms):
        if f == "text":
            k = keys.get(i)
            if k is not None and len(k) >= 2 and seen[k] >= RECURRENCES:
                f = "again"
        out.append(f"{f}{int(edges[i])}{int(unfinished)}{int(bool(raw) and raw[i][:2] == '  ')}")
        if f == "text":
            unfinished = not ENDS.search(lines[i])
    return out


class LineModel:
    """A discrete hidden Markov model over line observations."""

    #: Where training starts: the state each form suggests.
    FIRST = {"blank": "break", "marker": "break", "heading": "break", "number": "page_number", "caps": "header", "capsnum": "header", "again": "header", "text": "body"}

    def __init__(self, start: list[float], trans: list[list[float]], emit: dict[str, list[float]]):
        self.start, self.trans, self.emit = start, trans, emit

    @classmethod
    def fit(cls, texts: list[list[str]], rounds: int = 3) -> LineModel:
        """Viterbi training on observation sequences, from the states that the forms suggest."""
        guess = [[STATES.index(cls.FIRST[o[:-3]]) for o in obs] for obs in texts]
        model = cls.count(texts, guess)
        for _ in range(rounds):
            guess = [model.decode(obs) for obs in texts]
            model = cls.count(texts, guess)
        return model

    @classmethod
    def count(cls, texts: list[list[str]], states: list[list[int]]) -> LineModel:
        k = len(STATES)
        start, trans = [1.0] * k, [[1.0] * k for _ in range(k)]
        emit: dict[str, list[float]] = {f"{f}{a}{b}{c}": [5.0 if STATES[s] == st else 0.01 for s in range(k)] for f, st in cls.FIRST.items() for a in "01" for b in "01" for c in "01"}
        for obs, ss in zip(texts, states, strict=True):
            for i, (o, s) in enumerate(zip(obs, ss, strict=True)):
                emit[o][s] += 1
                if i:
                    trans[ss[i - 1]][s] += 1
                else:
                    start[s] += 1
        for o, e in emit.items():  # blanks, markers and headings are breaks whatever stands around them
            if o[:-3] in ("blank", "marker", "heading"):
                e[:] = [x if STATES[s] == "break" else 1e-9 for s, x in enumerate(e)]
        total = [sum(e[s] for e in emit.values()) for s in range(k)]
        return cls(
            [math.log(x / sum(start)) for x in start],
            [[math.log(x / sum(row)) for x in row] for row in trans],
            {o: [math.log(e[s] / total[s]) for s in range(k)] for o, e in emit.items()},
        )

    def decode(self, obs: list[str]) -> list[int]:
        """The most probable states."""
        if not obs:
            return []
        emit, k = self.emit, range(len(STATES))
        into = [[self.trans[p][s] for p in k] for s in k]
        score, back = [a + b for a, b in zip(self.start, emit[obs[0]], strict=True)], []
        for o in obs[1:]:
            e, new, frm = emit[o], [], []
            a, b, c, d = score
            for s in k:
                t = into[s]
                x, p = a + t[0], 0
                if b + t[1] > x:
                    x, p = b + t[1], 1
                if c + t[2] > x:
                    x, p = c + t[2], 2
                if d + t[3] > x:
                    x, p = d + t[3], 3
                new.append(x + e[s])
                frm.append(p)
            score = new
            back.append(frm)
        s = max(k, key=score.__getitem__)
        path = [s]
        for frm in reversed(back):
            s = frm[s]
            path.append(s)
        return path[::-1]


class Lexicon:
    """Known words with their counts, and the corrections that confusions (what is meant, what was read) make."""

    def __init__(self, counts: dict[str, int], confusions: set[tuple[str, str]] | None = None):
        self.counts = counts
        self.read: dict[str, list[str]] = defaultdict(list)
        for meant, read in sorted(confusions or ()):
            self.read[read].append(meant)
        self.memo: dict[str, tuple | None] = {}

    def known(self, w: str) -> int:
        """How often a word occurs, whatever the case of its first letter."""
        c = self.counts
        return c.get(w, 0) or c.get(w[:1].lower() + w[1:], 0) or c.get(w[:1].upper() + w[1:], 0)

    def candidates(self, w: str) -> Iterator[tuple[str, int, int]]:
        """(word meant, where and how long the misread part is): one character for one, two for one, one for two."""
        for v in dict.fromkeys((w, w[:1].lower() + w[1:])):
            for i in range(len(v)):
                for k in (1, 2):
                    for meant in self.read.get(v[i : i + k], ()) if i + k <= len(v) else ():
                        f = v[:i] + meant + v[i + k :]
                        if len(f) >= 3 and not SPACELESS.match(f):
                            yield f, i, k

    def correct(self, w: str, seen: int = 1) -> tuple[str, int, int] | None:
        """(the word meant, where and how long the misread part is), if a learned confusion explains the word."""
        if w in self.memo:
            return self.memo[w]
        best, most = None, CORRECTION_RATIO * seen - 1
        if len(w) >= 3 and self.read and not self.known(w):
            for f, i, k in self.candidates(w):
                n = self.counts.get(f, 0)
                if n > most:
                    best, most = (f, i, k), n
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[w] = best
        return best


def scanned_texts(documents: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(src, id, text): documents with layout scan, and the top-level text of envelopes."""
    docs = documents.where("layout = 'scan'").select(F.lit("documents").alias("src"), F.col("doc_id").cast("long").alias("id"), "text")
    return docs.unionByName(envelopes.select(F.lit("envelopes").alias("src"), F.col("env_id").cast("long").alias("id"), "text")).where("id is not null and text is not null and text <> ''")


def asked(lines: list[str]) -> set[str]:
    """The words that telling broken words may need: those at the edges of lines, joined, and with a last letter misread."""
    forms = [form(x) for x in lines]
    live = [i for i, f in enumerate(forms) if f not in ("blank", "marker", "heading")]
    out: set[str] = set()
    for n, i in enumerate(live):
        words = WORD.findall(lines[i])
        out.update(MISREAD_END.findall(lines[i]))
        out.update(words[:1] + words[-1:])
        out.update(p for w in words if "-" in w or "‐" in w for p in re.split("[-‐]", w))
        m = tail_of(lines[i])
        for j in live[n + 1 :] if m else ():
            h = HEAD.match(lines[j])
            if h and not SPACELESS.search(m.group(1)[-1]) and not SPACELESS.match(h.group(1)):
                a, b = m.group(1), h.group(1)
                out.update((a, b, a + b))
                if m.group(2) in HYPHENS and m.group(2):
                    out.update((f"{LAST.search(lines[i][: m.start()]).group()}{a}-{b}", f"{a}-{b}"))
            if forms[j] == "text":
                break
    return out


def vocabulary(documents: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(word, n_clean, n_scan, asked) over all texts; words at line edges of scans may be broken: they, and what they make
    joined, are asked for without being counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        edges: set[str] = set()

        def flush() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys() | edges)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[0][w] for w in words], pa.int64()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([w in edges for w in words], pa.bool_())], ["word", "n_clean", "n_scan", "asked"])
            counts[0].clear()
            counts[1].clear()
            edges.clear()
            return out

        for b in batches:
            for text, scan in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = canonical(text)
                if not scan:
                    counts[0].update(WORD.findall(text))
                    continue
                lines = [x.strip() for x in text.split("\n")]
                edges.update(asked(lines))
                for line in lines:
                    counts[1].update(WORD.findall(line)[1:-1])
            if len(counts[0]) + len(counts[1]) + len(edges) > 400_000:
                yield flush()
        yield flush()

    clean = documents.where("coalesce(layout, '') <> 'scan' and text is not null").select("text", F.lit(False).alias("scan"))
    both = clean.unionByName(scanned_texts(documents, envelopes).select("text", F.lit(True).alias("scan")))
    return spread(both).mapInArrow(run, "word string, n_clean long, n_scan long, asked boolean").where(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"), F.bool_or("asked").alias("asked"))


LOWER_FIRST = "concat(lower(substr(word, 1, 1)), substr(word, 2))"


def learn_confusions(vocab: DataFrame, lexicon: DataFrame) -> set[tuple[str, str]]:
    """(meant, read) of the words that occur only in scans, each told by the most frequent word it can stand for."""
    lower = F.expr(LOWER_FIRST)
    odd = vocab.where("n_clean = 0 and n_scan > 0 and length(word) >= 4").select("word", lower.alias("first")).join(lexicon.select(F.expr(LOWER_FIRST).alias("first")).distinct(), "first", "left_anti")
    odd = odd.select("word", F.explode(F.array_distinct(F.array("word", "first"))).alias("v"))
    hole = lambda c, n, open_: f"transform(sequence(1, greatest(1, length({c}) - {n - 1})), i -> named_struct('key', concat(substr({c}, 1, i - 1), '{open_}', substr({c}, i + {n})), 'i', i))"
    part = lambda c, n, k, open_: f"transform({hole(c, n, open_)}, x -> named_struct('key', x.key, 'i', x.i, 'n', {n}, 'k', {k}))"
    # a key with one open place stands for one character meant, with two for two
    asks = odd.select("word", "v", F.explode(F.expr(f"concat({part('v', 1, 1, '\\u0000')}, {part('v', 1, 2, '\\u0000\\u0000')}, {part('v', 2, 1, '\\u0000')})")).alias("x"))
    gives = lexicon.where(F.length("word") >= 3).where(~F.col("word").rlike(f"^{SPACELESS.pattern}")).select(F.col("word").alias("f"), "n", F.explode(F.expr(f"concat({part('word', 1, 1, '\\u0000')}, {part('word', 2, 2, '\\u0000\\u0000')})")).alias("y"))
    met = asks.join(gives.select("f", "n", F.col("y.key").alias("key")), asks["x.key"] == F.col("key"))
    met = met.select("word", "n", F.expr("substr(f, x.i, x.k)").alias("meant"), F.expr("substr(v, x.i, x.n)").alias("read")).where("meant <> read")
    best = met.groupBy("word").agg(F.max(F.struct("n", "meant", "read")).alias("b"))
    pairs = cut(best.groupBy("b.meant", "b.read").agg(F.count("*").alias("n")))
    explained = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    return {(r["meant"], r["read"]) for r in bounded_collect(pairs.where(F.col("n") >= max(CONFUSION_WORDS, CONFUSION_SHARE * explained)))}


class Learned(NamedTuple):
    """What reading scans needs: words for every task, rarer words that are asked for (where they don't fit), confusions, model."""

    counts: dict[str, int]
    rare: DataFrame | None
    confusions: set[tuple[str, str]]
    model: LineModel


#: Rarer words beyond this number go with the texts that ask for them.
RARE_ROWS = 300_000


def learn(documents: DataFrame, envelopes: DataFrame) -> Learned:
    """Lexicon, confusions and line model; what reaches the driver is bounded by LEXICON_SHARE, RARE_ROWS, the alphabet and TRAIN_TEXTS."""
    vocab = cut(vocabulary(documents, envelopes))
    total = vocab.agg(F.sum("n_clean").alias("c"), F.sum("n_scan").alias("s")).first()
    clean, scan = total["c"] or 0, total["s"] or 0
    n, column = (clean, "n_clean") if clean else (scan, "n_scan")
    lexicon = vocab.where(F.col(column) >= 2).select("word", F.col(column).alias("n"))
    least = max(2, math.ceil(LEXICON_SHARE * n))
    counts = {r["word"]: int(r["n"]) for r in bounded_collect(lexicon.where(F.col("n") >= least))}
    confusions = learn_confusions(vocab, lexicon)
    shared = documents.sparkSession.sparkContext.broadcast((counts, confusions))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        for b in batches:
            out: set[str] = set()
            for w in b.column(0).to_pylist():
                out.update(wanted(w, lex))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["word"])

    rarer = lexicon.where(F.col("n") < least)
    if rarer.isEmpty():
        rare = None
    else:
        unknown = vocab.where((F.col(column) < least) & ((F.col("n_scan") > 0) | F.col("asked"))).select("word")
        rare = cut(rarer.join(spread(unknown).mapInArrow(needs, "word string").distinct(), "word", "left_semi"))
        if rare.count() <= RARE_ROWS:
            counts |= {r["word"]: int(r["n"]) for r in bounded_collect(rare)}
            rare = None

    def watch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([observed(t)[1] for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["obs"])

    texts = scanned_texts(documents, envelopes)
    size = max(1, texts.count())
    drawn = texts.where(F.pmod(F.xxhash64("src", "id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, 1.5 * TRAIN_TEXTS / size))).select("text").limit(TRAIN_TEXTS)
    # a text is so many different runs of observations: equal ones are counted, not repeated
    seen = drawn.mapInArrow(watch, "obs array<string>").collect()
    return Learned(counts, rare, confusions, LineModel.fit([r["obs"] for r in seen]))


def wanted(w: str, lex: Lexicon) -> Iterator[str]:
    """The words whose counts telling a word needs beside those at hand."""
    yield from (w, w[:1].lower() + w[1:], w[:1].upper() + w[1:])
    if len(w) >= 3 and not lex.known(w):
        yield from (f for f, _, _ in lex.candidates(w) if f not in lex.counts)


def observed(text: str) -> tuple[list[str], list[str]]:
    """The canonical stripped lines of a text and their observations."""
    raw = canonical(text).split("\n")
    lines = [x.strip() for x in raw]
    return lines, observe(lines, raw)


def read_lines(text: str, model: LineModel) -> tuple[list[str], list[str]]:
    """The canonical lines of a text and the state of each."""
    lines, obs = observed(text)
    return lines, [STATES[s] for s in model.decode(obs)]


TAIL = re.compile(rf"([^\W\d_]+(?:['’!|0-9][^\W_]+)*)\s*([{re.escape(HYPHENS)}]?)\s*$")
LAST = re.compile(r"[^\s]*$")
MISREAD_END = re.compile(rf"(?:{WORD.pattern})[!|]")
HEAD = re.compile(r"^([^\W_]+(?:['’!|\-‐][^\W_]+)*)")


def tail_of(line: str) -> re.Match | None:
    """The last word of a line, with its hyphen mark."""
    return TAIL.search(line, line.rfind(" ", 0, max(0, len(line) - 2)) + 1)


def goes_on(line: str, nxt: str, lex: Lexicon) -> tuple[str, str] | None:
    """(first part, rest) of a word broken between two lines of running text, or None."""
    m, h = tail_of(line), HEAD.match(nxt)
    if not m or not h or not LETTER.match(h.group(1)):
        return None
    a, b = m.group(1), h.group(1)
    if SPACELESS.search(a[-1]) or SPACELESS.match(b):
        return None
    before = line[: m.start()]
    if m.group(2):
        if m.group(2) in "-‐":
            if b[0].isupper() and not a.isupper():
                return None
            stem = LAST.search(before).group() + a  # the word may hold an earlier hyphen
            parted = max(lex.known(f"{stem}-{b}"), lex.known(f"{a}-{b}"))
            if parted > lex.known(a + b):
                return None
        return a, b
    if m.end() < len(line.rstrip()) or b[0].isupper() or before[-1:] in "-‐":
        return None
    whole, first, rest = lex.known(a + b), lex.known(a), lex.known(b)
    if whole:
        return (a, b) if min(first, rest) * 50 < whole else None
    if first or rest:
        return None
    if lex.correct(a + b):
        return a, b
    return None if lex.correct(a) or lex.correct(b) or len(a) < 2 else (a, b)


def analyse(text: str, model: LineModel, lex: Lexicon) -> tuple[list[str], list[str], list[tuple[int, str]], dict[int, int], dict[int, list[tuple[int, int, str]]]]:
    """Lines, states, (line_no, kind) cases, broken words (line → line with the rest), and corrections by line."""
    lines, states = read_lines(text, model)
    body = [i for i, s in enumerate(states) if s == "body"]
    cases: list[tuple[int, str]] = [(i, s) for i, s in enumerate(states) if s in ("header", "page_number")]
    joined: dict[int, int] = {}
    fixes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    counts = lex.counts
    for k, i in enumerate(body):
        line, end, begin = lines[i], None, 0
        if k + 1 < len(body):
            parts = goes_on(line, lines[body[k + 1]], lex)
            if parts:
                joined[i] = body[k + 1]
                cases.append((i, "hyphen"))
                a, b = parts
                end = tail_of(line).start()
                fix = lex.correct(a + b)
                if fix:  # the case lies in the line with the misread part
                    at = i if fix[1] < len(a) else body[k + 1]
                    cases.append((at, "misread"))
                    fixes[i].append((-1, 0, fix[0]))
        if k and body[k - 1] in joined:
            begin = HEAD.match(line).end()
        for m in WORD.finditer(line, begin):
            w = m.group()
            if w in counts or (end is not None and m.start() >= end) or w.isdigit():
                continue
            if "-" in w or "‐" in w:
                if all(p.isdigit() or lex.known(p) for p in re.split("[-‐]", w)):
                    continue
            z = m.end()
            fix = lex.correct(w)
            if not fix and line[z : z + 1] in ("!", "|") and not lex.known(w):  # a misread last letter
                z += 1
                fix = lex.correct(line[m.start() : z])
            if fix:
                cases.append((i, "misread"))
                fixes[i].append((m.start(), z, fix[0]))
    return lines, states, cases, joined, fixes


def _each(documents: DataFrame, envelopes: DataFrame, learned: Learned | None, work, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:  # noqa: ANN001
    """Rows that `work(src, id, text, model, lexicon)` makes of every scanned text, with the rarer words that the text asks for."""
    got = learned or learn(documents, envelopes)
    model = got.model
    shared = documents.sparkSession.sparkContext.broadcast((got.counts, got.confusions, model.start, model.trans, model.emit))
    texts = spread(scanned_texts(documents, envelopes))
    if got.rare is not None:

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = Lexicon(*shared.value[:2])
            for b in batches:
                out: list[tuple[str, int, str]] = []
                for src, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lines = [x.strip() for x in canonical(text).split("\n")]
                    words = asked(lines).union(*map(WORD.findall, lines))
                    out += [(src, i, x) for x in {x for w in words if w not in lex.counts for x in wanted(w, lex)}]
                cols = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["src", "id", "word"])

        found = texts.mapInArrow(ask, "src string, id long, word string").join(got.rare, "word").groupBy("src", "id").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))
        texts = texts.join(found, ["src", "id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, confusions, *hmm = shared.value
        common, m = Lexicon(counts, confusions), LineModel(*hmm)
        for b in batches:
            out: list[tuple] = []
            for src, i, text, *rare in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lex = common
                if rare and rare[0]:
                    lex = Lexicon(ChainMap(dict(zip(*rare, strict=True)), counts), confusions)
                out += work(src, i, text, m, lex)
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return texts.mapInArrow(run, schema)


def line_cases(documents: DataFrame, envelopes: DataFrame, learned: Learned | None = None) -> DataFrame:
    """Distinct (src, id, line_no, kind) with kind header, page_number, hyphen or misread."""
    kinds = {"src": pa.string(), "id": pa.int64(), "line_no": pa.int32(), "kind": pa.string()}
    work = lambda src, i, text, m, lex: [(src, i, no, kind) for no, kind in set(analyse(text, m, lex)[2])]
    return _each(documents, envelopes, learned, work, kinds, "src string, id long, line_no int, kind string").distinct()


def rebuild(text: str, model: LineModel, lex: Lexicon) -> str:
    """Continuous paragraphs: running titles, page numbers and markers gone, words rejoined, misread words put right."""
    lines, states, _, joined, fixes = analyse(text, model, lex)
    raw = text.split("\n")
    paragraphs: list[str] = []
    open_, last, carry = False, None, ""
    for i, (line, state) in enumerate(zip(lines, states, strict=True)):
        if state == "break" and line and not MARKER.match(line):
            paragraphs.append(line)
            open_ = False
        if state != "body":
            continue
        fixed, skip = line, 0
        if carry:
            skip = HEAD.match(line).end()
        for a, z, w in sorted((f for f in fixes.get(i, ()) if f[0] >= 0), reverse=True):
            fixed = fixed[:a] + w + fixed[z:]
        fixed = fixed[skip:] if not carry else fixed[HEAD.match(fixed).end() :]
        indent = raw[i].startswith("  ") and not carry
        pause = last is not None and any(states[j] == "break" and not lines[j] for j in range(last + 1, i)) and not any(states[j] in ("header", "page_number") or MARKER.match(lines[j]) for j in range(last + 1, i))
        if not open_ or indent or pause:
            paragraphs.append("")
            open_ = True
        piece = carry + fixed
        carry = ""
        if i in joined:
            m = tail_of(fixed)
            a, b = m.group(1), HEAD.match(lines[joined[i]]).group(1)
            whole = next((w for x, _, w in fixes.get(i, ()) if x == -1), a + b)
            tail = tail_of(piece)
            piece, carry = piece[: tail.start()], whole
        sep = " " if paragraphs[-1] and not (SPACELESS.search(paragraphs[-1][-1]) and SPACELESS.match(piece or " ")) and piece and not paragraphs[-1].endswith(" ") else ""
        paragraphs[-1] += sep + piece.rstrip() if not carry else sep + piece
        last = i
    if carry and paragraphs:
        paragraphs[-1] += carry
    return "\n\n".join(p.strip() for p in paragraphs if p.strip())


def repaired(documents: DataFrame, envelopes: DataFrame, learned: Learned | None = None) -> DataFrame:
    """(src, id, text): every scanned text as paragraphs separated by blank lines."""
    kinds = {"src": pa.string(), "id": pa.int64(), "text": pa.string()}
    work = lambda src, i, text, m, lex: [(src, i, rebuild(text, m, lex))]
    return _each(documents, envelopes, learned, work, kinds, "src string, id long, text string").distinct()
