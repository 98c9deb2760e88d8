"""Sentence units across languages and scripts.

The Unicode sentence-break properties (terminators of all scripts, closing marks, continuing marks) find the candidate
ends; language-specific abbreviations, initials and ordinals suppress the false ones; quotations and brackets are
followed so that a sentence framing a quotation stays one unit; scripts whose sentences end in a space (Thai) are split
there.  A line break always ends a unit.

Units are half-open code-point ranges without white space at their ends.  A semicolon ends a sentence only behind Greek
text (it is the Greek question mark); an ellipsis ends nothing by itself.  Greek text written without capitals at
sentence starts is recognised per text.

Defined results: null and empty texts have no units; a text of only white space has none; texts of any length are split
whole, in time in proportion to their length; rows with a null key or delivered again give no units of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .canonical import ZERO_WIDTH, canonical

# Abbreviations after which a sentence goes on, by language, without their full stop.
ABBREVIATIONS = {
    "la": "cf vid fr ed pr sq sqq lib cap cod codd fol col n nn p pp v vv r l ll scil sc viz ibid op cit ms mss vol tom test app praef ser dom mag s st cn ti sex kal non add corr om post d m ap rec",
    "en": "mr mrs miss ms messrs dr prof rev hon st sr jr mt vol vols no nos ch chs chap sec fig figs ed eds trans cf e.g i.e viz pp p fol fols ff f n nn v vv fr art ca c approx dept univ gen col capt lt gov sen rep jan feb mar apr jun jul aug sept oct nov dec ms mss ll l esp min repr",
    "de": "frl fr hr st vgl bd bde s bl nr hrsg hg aufl z b d h u a z.b d.h u.a bzw ca evtl ggf dr prof hr fr abb abs anm art f ff jh jhd kap st str sog v sp tl vol",
    "fr": "m mm mme mlle mgr dr me pr prof p pp t vol no nos n éd ed fol ff cf c.-à-d chap art av env fig ms mss l v fr st ste min s",
    "it": "cfr es ad pag pagg p pp vol voll n nn nt cap capp fol ff ed sig sigg dott dr prof on ss s v vv fr fig tav art min st a.c d.c",
    "ru": "т тт с стр гл прим см ср напр л лл об т.е г гг в вв им проф акад ред изд фр рис табл ст св доп разд п пп",
    "el": "βλ πρβλ τόμ τομ σ σσ σελ κεφ στ στχ βιβλ ἔκδ ἐκδ εκδ έκδ ἀπ απ αρ ἀρ μτφρ λ.χ π.χ δηλ κ κος κα δρ καθ αγ ἁγ φ φφ τ τχ σημ ὑποσ",
    "ar": "ج ص ق ط س م د أ ت ر مج هـ انظر",
}
# Abbreviations that may end a sentence (and so on, units of measure, era marks).
ENDING = "etc ecc usw uswf κ.τ.λ κτλ κ.λπ κλπ κ.ά др т.д т.п пр al seqq sqq u.s.w u.dgl"
THAI = "฀-๿"
QUOTES = {"«": "»", "“": "”", "„": "“”", "‚": "‘", "「": "」", "『": "』", "《": "》", "〈": "〉", "‹": "›", "〝": "〞"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］", "〔": "〕"}
ELLIPSES = "…⋯"
GAP = " \u00a0\u2000-\u200a\u202f\u205f\u3000"
CLOSERS = frozenset("".join(QUOTES.values()) + "".join(BRACKETS.values()) + "\"")
#: What an event is: a gap behind Thai text, an opening quotation, a straight one, brackets, other closing marks, an
#: ellipsis, a semicolon, a sentence terminator, a full stop.
SPACE, OPEN, STRAIGHT, BRACKET, UNBRACKET, CLOSE, DOTS, SEMICOLON, TERMINATOR, STOP = range(10)


@lru_cache(1)
def marks() -> dict[str, object]:
    """Character classes from the sentence-break property over all planes, and the event pattern."""
    every = "".join(chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000)
    prop = lambda p: set(regex.findall(rf"\p{{Sentence_Break={p}}}", every))
    sterm, aterm = prop("STerm"), prop("ATerm")
    close = prop("Close") | {'"'}
    cont = prop("SContinue") | set(",;:،؛、，：；–—-")
    esc = lambda s: "".join(map(re.escape, sorted(s)))
    kinds = dict.fromkeys(aterm, STOP) | dict.fromkeys(sterm, TERMINATOR) | dict.fromkeys(";;", SEMICOLON) | dict.fromkeys(ELLIPSES, DOTS)
    kinds |= dict.fromkeys("".join(QUOTES.values()), CLOSE) | dict.fromkeys(BRACKETS.values(), UNBRACKET) | dict.fromkeys(BRACKETS, BRACKET) | {'"': STRAIGHT} | dict.fromkeys(QUOTES, OPEN)
    only = lambda top: re.compile(f"[{esc(k for k in kinds if ord(k) < top)}]")  # noqa: E731  # a smaller class is searched faster
    gapped = re.compile(f"[{esc(kinds)}]|(?<=[{THAI}{ZERO_WIDTH})”»\"\\]])[{GAP}]+(?=[^\\W\\d_]|[{THAI}{ZERO_WIDTH}])")
    tail = re.compile(f"[{esc(sterm | aterm)};;{ELLIPSES}]*[{esc((close | set(chr(39))) - set(BRACKETS) - (set(QUOTES) - set('“‘')))}]*")
    shut = re.compile(f"[{esc(close - set(BRACKETS) - set(QUOTES))}]*")
    return {"sterm": sterm | {";"}, "aterm": aterm, "continue": cont, "ascii": only(0x80), "bmp": only(0x10000), "event": only(0x110000), "gapped": gapped, "kinds": kinds, "tail": tail, "shut": shut}


@lru_cache(1)
def abbreviations() -> tuple[frozenset, frozenset]:
    return frozenset(w for ws in ABBREVIATIONS.values() for w in ws.split()), frozenset(ENDING.split())


LINE = re.compile(r"[^\n\r\x85  ]+")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
QUOTED = re.compile(r"«[^«»\n]*»|“[^“”\n]*”|„[^„“”\n]*[“”]")
LOWER_START = re.compile(r"(?:^|[\n;!])[ \t]*([Ͱ-Ͽἀ-῿])", re.M)
LOWER_NEXT = re.compile(r"(?<=[^\s.]{4})\.\s([Ͱ-Ͽἀ-῿])")
GERMAN = re.compile(r"\b(?:der|die|das|den|dem|des|und|ein|eine|im|am|ist|von|mit|auf|zum|zur)\b")
DIGITS = re.compile(r"\d+$")
UPPER = re.compile(r"[A-Z0-9]+(?:$|[\s.,;:)])")
BEFORE = re.compile("[(（[«“„\"'’‘\\s]")
AHEAD = re.compile(f"[\\s{ZERO_WIDTH}]*")
LEAD = re.compile("[ –—•*-]*")
THAI_LETTER = re.compile(f"[{THAI}]")
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
BLANKS = " \t\u00a0\u3000"
FIRST = re.compile(r"\s*(\S?)")
SPACELESS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿가-힣]")


def starts_low(text: str) -> bool:
    """Whether the text writes Greek sentence starts without capitals."""
    if not GREEK.search(text):
        return False
    text = QUOTED.sub("", text)  # quoted sentences keep their capitals
    seen = LOWER_START.findall(text) + LOWER_NEXT.findall(text)
    return 2 * sum(c.islower() for c in seen) >= len(seen) if seen else False


def line_units(line: str, at: int, low: bool, event: re.Pattern, out: list[tuple[int, int]]) -> None:
    """Append the units of one line that begins at position `at` of its text; every place is looked at a bounded number of times."""
    p = marks()
    kinds, sterm, aterm, cont, tail, ahead = p["kinds"], p["sterm"], p["aterm"], p["continue"], p["tail"], AHEAD.match
    abbr, ending = abbreviations()
    n = len(line)
    begin, pos, stack, depth = 0, 0, [], 0  # begin of the unit; open quotations as (closing marks, where); open brackets
    thai, german = -1, None  # the first Thai letter from `begin` on; whether the line looks German
    last: dict[str, int] = {}

    def emit(end: int) -> None:
        nonlocal begin, depth
        piece = line[begin:end]
        bare = piece.lstrip()
        left = at + begin + len(piece) - len(bare)
        bare = bare.rstrip()
        if bare:
            out.append((left, left + len(bare)))
        begin, depth = end, 0

    def comes(mark: str, i: int) -> bool:
        """Whether the mark stands somewhere behind place i."""
        if mark not in last:
            last[mark] = line.rfind(mark)
        return last[mark] > i

    def before(i: int, skip: str) -> str:
        """The unit's last character before place i that is not to be skipped."""
        i -= 1
        while i >= begin and line[i] in skip:
            i -= 1
        return line[i] if i >= begin else ""

    if line.isascii():
        event = p["ascii"]
    for m in event.finditer(line):
        i = m.start()
        if i < pos:
            continue
        ch = line[i]
        kind = kinds.get(ch, SPACE)
        if kind == SPACE:  # behind Thai text, or behind a bracket or quotation in it
            if stack or depth:
                continue
            j = m.end()
            while j < n - 1 and line[j] in ZERO_WIDTH:
                j += 1
            if line[j] == "ๆ" or UPPER.match(line, j):
                continue
            b = i - 1
            while b > begin and line[b] in ZERO_WIDTH:
                b -= 1
            if not "฀" <= line[b] <= "๿":
                if thai < begin:
                    hit = THAI_LETTER.search(line, begin)
                    thai = hit.start() if hit else n
                if thai >= i or (line[b] in "”»\"" and FIRST.match(line, begin).group(1) in QUOTES):
                    continue
            emit(i)
            continue
        if stack:
            if ch in stack[-1][0]:
                where = stack.pop()[1]
                if stack:
                    continue
                b = i - 1
                while b > where and line[b].isspace():
                    b -= 1
                mark = line[b] if b > where else ""
                j = p["shut"].match(line, i + 1).end()
                k = ahead(line, j).end()
                nxt = line[k : k + 1]
                pos = j
                if not nxt or not (mark in sterm or mark in aterm or mark in ";…") or nxt in cont or nxt in sterm or nxt in aterm:
                    continue
                if LEAD.match(line, begin).end() >= where:  # the quotation opens the sentence: what follows is its frame
                    if nxt.isupper() or nxt in QUOTES and k > j:
                        emit(j)
                    continue
                if SPACELESS.match(nxt) or k == j:
                    if before(where, BLANKS) in (":", "：") and (k > j or SPACELESS.match(nxt) or nxt in QUOTES):
                        emit(j)
                    continue
                if nxt.islower() and not (low and GREEK.match(nxt)):
                    continue
                emit(j)
            elif kind == OPEN:
                stack.append((QUOTES[ch], i))
            elif kind == STRAIGHT:
                if comes(ch, i):
                    stack.append((ch, i))
            elif kind == BRACKET:
                depth += comes(BRACKETS[ch], i)
            elif kind == UNBRACKET:
                depth = max(0, depth - 1)
            continue
        if kind == OPEN:
            stack.append((QUOTES[ch], i))
            continue
        if kind == STRAIGHT:
            if comes(ch, i):
                stack.append((ch, i))
            continue
        if kind == BRACKET:
            depth += comes(BRACKETS[ch], i)
            continue
        if kind == UNBRACKET:
            depth = max(0, depth - 1)
            continue
        if depth or kind in (CLOSE, DOTS):
            continue
        j = tail.match(line, i).end()
        k = ahead(line, j).end()
        nxt = line[k : k + 1]
        if not nxt:
            break
        pos = j
        if line.startswith("..", i, j) and (line.startswith("...", i, j) or j - i > 2 and line[i + 2] in ELLIPSES):
            continue
        if nxt in cont and nxt not in "–—-" or nxt in ")]）»”":
            continue
        spaced = k > j
        if kind == SEMICOLON:
            if spaced and GREEK.match(before(i, " »”)")):
                emit(j)
            else:
                pos = i + 1
            continue
        if kind == TERMINATOR:
            if spaced or SPACELESS.match(nxt) or nxt in QUOTES or ord(ch) > 0x2E80:
                emit(j)
            continue
        # a full stop
        if not spaced:
            if ord(ch) > 0x2E80 or (SPACELESS.match(nxt) and SPACELESS.match(line[i - 1 : i] or " ")):
                emit(j)
            else:
                pos = i + 1
            continue
        if line.startswith("..", i, j):  # an abbreviation's stop and the sentence's
            emit(j)
            continue
        lower = nxt.islower()
        if line[i - 1] in CLOSERS:  # behind a bracket or quotation no abbreviation
            if not lower or (low and GREEK.match(nxt)):
                emit(j)
            continue
        k = max(begin, line.rfind(" ", begin, i) + 1)
        raw = BEFORE.split(line[k:i])[-1]
        tok = raw.lower().lstrip(".")
        if not tok.isascii():
            tok = canonical(tok)
        greek_low = low and lower and bool(GREEK.match(nxt))
        if tok in ending:
            if nxt.isupper() or nxt in QUOTES or (greek_low and before(i - len(raw), BLANKS) in (",", "،", "")) or not (lower or nxt.isdigit()):
                emit(j)
            continue
        if tok in abbr or (len(tok) == 1 and tok.isalpha() and (line[i - 1].isupper() or tok not in "aeiouyàèéêìòóùаеиоуыэюяαεηιουω")) or ("." in tok and not tok[-1:].isdigit()):
            if not tok[-1:].isalpha() or not SPACELESS.match(tok[-1]):
                continue
        if nxt.isdigit() and len(tok) <= 5 and not tok.isdigit():
            continue
        if len(tok) <= 2 and DIGITS.fullmatch(tok):
            if german is None:
                german = bool(GERMAN.search(line))
            if lower or german:
                continue
        if lower and not greek_low:
            continue
        emit(j)
    emit(n)


def units(text: str | None) -> list[tuple[int, int]]:
    """The sentence units of a text as (start, end)."""
    out: list[tuple[int, int]] = []
    if text:
        low, event = starts_low(text), marks()["gapped" if THAI_LETTER.search(text) else "event" if ASTRAL.search(text) else "bmp"]
        for m in LINE.finditer(text):
            line_units(m.group(), m.start(), low, event, out)
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, start_pos, end_pos) of every sentence unit.

    A text's units travel as one row, so what is shuffled to drop rows delivered again is a row a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(map(units, b.column(1).to_pylist()))
            flat = [x for us in got for x in us]
            at = pa.array([0, *accumulate(map(len, got))], pa.int32())
            rows = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([z for _, z in flat], pa.int32())], ["start_pos", "end_pos"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, rows)], [key, "units"])

    texts = df.where(F.length(text) > 0).select(df[key].cast("long").alias(key), text)
    rows = spread(texts).mapInArrow(run, f"{key} long, units array<struct<start_pos:int,end_pos:int>>")
    once = rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("units"))).alias("units"))
    return once.select(key, F.explode("units").alias("u")).select(key, "u.start_pos", "u.end_pos")


def found(documents: DataFrame) -> DataFrame:
    """Every sentence unit of the documents whose layout is not scan (a missing layout counts as not scan)."""
    return split_sentences(documents.where("coalesce(layout, '') <> 'scan' and doc_id is not null"))
