"""One consistent form for text that looks alike but differs in its characters.

Quick-check properties isolate the unstable segments: `unicodedata.is_normalized` (the NFC quick check), one scan for
zero-width, full-width and space characters, and one for script changes inside words.  Only a segment that fails is
rewritten, with the stable character before it as boundary context, and spliced back into the unchanged text.

Consistent form: NFC; full-width letters and digits narrowed (full-width punctuation stays); zero-width characters
removed; every space but U+0020 and line breaks turned into U+0020; a Latin, Greek or Cyrillic letter in a word
otherwise written in another of these scripts replaced by its look-alike of that script.  A word's script is that of most of
its letters; on a tie that of most of the text's letters, then Latin, Greek, Cyrillic.  A letter without a look-alike (also
behind its marks) comes out as the letter of that script whose name begins with the same sound, so that every result is
in the consistent form.

Defined results: null gives null, empty gives empty; repeated rows give their rows again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-alike letters as Latin, Greek, Cyrillic, the closest first; a dash where a script has none.
LOOKALIKES = (
    "AΑА BΒВ CϹС EΕЕ FϜ- G-Ԍ HΗН IΙІ I-Ӏ JͿЈ KΚК MΜМ NΝ- OΟО PΡР QϘԚ S-Ѕ TΤТ V-Ѵ W-Ԝ XΧХ YΥУ YΥҮ ZΖ- -ΓГ -ΠП -ΦФ -ΛЛ -ΘѲ -ΞѮ -ΨѰ -ΩѠ "
    "aαа cϲс d-ԁ eεе fϝ- h-һ iιі jϳј kκк l-ӏ lι- nη- oοо pρр qϙԛ r-г s-ѕ tτт uυ- vνѵ w-ԝ wω- xχх yγу yγү µμ- mμм bβв bβЬ -θѳ -ξѯ -πп -φф -ψѱ -ωѡ -λл -δб cςс"
)
ZERO_WIDTH = "᠎​‌‍⁠⁡⁢⁣⁤﻿"
SPACES = "\t\x0b\x0c\x1f\x85\xa0  -   　"
NARROW = {c: c - 0xFEE0 for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1)}
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")


def ranges(points: list[int]) -> str:
    """Code points as the inside of a regular expression's character class."""
    out, start, last = [], None, None
    for p in [*sorted(points), None]:
        if start is not None and (p is None or p != last + 1):
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}")
            start = None
        if start is None:
            start = p
        last = p
    return "".join(out)


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def patterns(text: str = "") -> dict[str, object]:
    """Character classes from the Unicode database for a text; a class without the upper planes is searched faster."""
    return _patterns(0x30000 if ASTRAL.search(text) else 0x10000)


@lru_cache(2)
def _patterns(top: int) -> dict[str, object]:
    """The classes up to a code point, built once per process."""
    of: dict[str, list[int]] = {s: [] for s in SCRIPTS}
    unstable, tails = [], set()
    for cp in range(0x20, top):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d:
            tails.add(int(d.split()[1], 16))
        if unicodedata.combining(ch) or (d and not unicodedata.is_normalized("NFC", ch)):
            unstable.append(cp)
        elif unicodedata.category(ch)[0] == "L":
            script = unicodedata.name(ch, "").split(" ", 1)[0]
            if script in of:
                of[script].append(cp)
    unstable = sorted({*unstable, *tails, *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})
    cls = {s: ranges(v) for s, v in of.items()}
    other = {s: "".join(cls[x] for x in SCRIPTS if x != s) for s in SCRIPTS}
    mark = "̀-ͯ"
    return {
        "unstable": re.compile(f"[^{ranges(unstable)}]?[{ranges(unstable)}]+"),
        "odd": re.compile(f"[{ZERO_WIDTH}{SPACES}{ranges(list(NARROW))}]"),
        "mixed": re.compile("|".join(f"[{cls[s]}][{mark}]*[{other[s]}]" for s in SCRIPTS)),
        "word": re.compile(f"[{''.join(cls.values())}{mark}]+"),
        "letters": {s: re.compile(f"[{c}]") for s, c in cls.items()},
    }


@lru_cache(1)
def tables() -> tuple[dict, dict]:
    """Translation of odd characters, and look-alikes by target script."""
    odd: dict[int, object] = dict(NARROW) | {ord(c): None for c in ZERO_WIDTH}
    spaces = re.compile(f"[{SPACES}]")
    odd |= {cp: " " for cp in range(0x3001) if spaces.match(chr(cp))}
    swap: dict[str, dict[int, str]] = {s: {} for s in SCRIPTS}
    for triple in LOOKALIKES.split():
        for i, target in enumerate(SCRIPTS):
            for ch in triple:
                if ch != "-" and triple[i] not in ("-", ch):
                    swap[target].setdefault(ord(ch), triple[i])
    return odd, swap


def is_canonical(text: str) -> bool:
    """The quick check: nothing in the text needs to change."""
    if text.isascii():
        return not any(c in text for c in "\t\x0b\x0c\x1f")
    p = patterns(text)
    if not unicodedata.is_normalized("NFC", text) or p["odd"].search(text):
        return False
    return not has_mixed(text, p)


def has_mixed(text: str, p: dict) -> bool:
    """Whether a word mixes scripts; it can only where a second script occurs at all."""
    seen = 0
    for s in SCRIPTS:
        seen += bool(p["letters"][s].search(text))
        if seen == 2:
            return bool(p["mixed"].search(text))
    return False


def canonical(text: str | None) -> str | None:
    """The text in its consistent form; unstable segments are rewritten in place."""
    if not text or text.isascii() and is_canonical(text):
        return text
    p, (odd, _) = patterns(text), tables()
    if text.isascii() or p["odd"].search(text):
        text = text.translate(odd)
    if not unicodedata.is_normalized("NFC", text):
        text = p["unstable"].sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
        if not unicodedata.is_normalized("NFC", text):  # a starter that composes backwards over a longer stretch
            text = unicodedata.normalize("NFC", text)
    while has_mixed(text, p):  # ends: every round leaves fewer letters outside their words' scripts
        new = unmix(text, p)
        text = new if unicodedata.is_normalized("NFC", new) else unicodedata.normalize("NFC", new)  # marks past a word
    return text


def unmix(text: str, p: dict) -> str:
    """The text with its mixed words rewritten, all by the same totals of letters."""
    totals, out, done = [], [], 0
    for m in p["mixed"].finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and p["word"].match(text[a - 1]):
            a -= 1
        z = p["word"].match(text, a).end()
        n = [len(p["letters"][s].findall(text, a, z)) for s in SCRIPTS]
        if sorted(n)[1] == max(n) and not totals:
            totals = [len(p["letters"][s].findall(text)) for s in SCRIPTS]
        target = max(range(3), key=lambda i: (n[i], totals[i] if totals else 0, -i))
        out += [text[done:a], rewritten(text[a:z], SCRIPTS[target], p)]
        done = z
    return "".join(out) + text[done:]


def rewritten(word: str, script: str, p: dict) -> str:
    """A word with all its letters in one script."""
    _, swap = tables()
    keep = p["letters"][script]

    def one(c: str) -> str:
        if keep.match(c) or not p["word"].match(c) or unicodedata.combining(c):
            return c
        base, *marks = unicodedata.normalize("NFD", c)
        to = swap[script].get(ord(c))
        return to or (swap[script].get(ord(base)) or sounding(base, script)) + "".join(marks)

    return unicodedata.normalize("NFC", "".join(map(one, word)))


def sound(letter: str) -> str:
    """The sound that a letter's name begins with: of EF and BE the consonant."""
    name = unicodedata.name(letter, "LETTER O").partition(" LETTER ")[2].partition(" WITH ")[0] or "O"
    last = name.split()[-1]
    return last[1] if len(last) == 2 and last[0] == "E" and last[1] not in "AEIOU" else last[0]


@lru_cache(1)
def sounds() -> dict[tuple[str, str, bool], str]:
    """(script, sound, whether small) → the script's first letter of that sound."""
    out: dict[tuple[str, str, bool], str] = {}
    for script, points in zip(SCRIPTS, ((0x41, 0x5A, 0x61, 0x7A), (0x391, 0x3A9, 0x3B1, 0x3C9), (0x410, 0x42F, 0x430, 0x44F)), strict=True):
        for a, z in (points[:2], points[2:]):
            for c in map(chr, range(a, z + 1)):
                if c.isalpha():
                    out.setdefault((script, sound(c), c.islower()), c)
    return out


def sounding(letter: str, script: str) -> str:
    """The letter of a script that sounds like another one; O where none does."""
    small = not letter.isupper()
    return sounds().get((script, sound(letter), small)) or sounds()[script, "O", small]


def needs_change(text: str | None) -> bool:
    """Whether a text's own characters have to change to be in the consistent form."""
    return bool(text) and not is_canonical(text)


SOURCES = (("documents", "doc_id"), ("envelopes", "env_id"), ("positioned_elements", "element_id"))


def texts(tables_by_name: dict[str, DataFrame]) -> DataFrame:
    """The own texts of the given tables as (src, id, text)."""
    out = None
    for name, key in SOURCES:
        if name in tables_by_name:
            one = tables_by_name[name].select(F.lit(name).alias("src"), F.col(key).cast("long").alias("id"), "text")
            out = one if out is None else out.unionByName(one)
    return out


def canonicalize(df: DataFrame, text: str = "text", only_changed: bool = False) -> DataFrame:
    """The rows with `text` in the consistent form and a flag `changed`; only the changed rows on request."""
    schema = df.schema.add("changed", "boolean") if "changed" not in df.columns else df.schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column(at).to_pylist()
            flags = [needs_change(t) for t in got]
            if only_changed:
                b = b.filter(pa.array(flags, pa.bool_()))
                got, flags = [t for t, f in zip(got, flags, strict=True) if f], [True] * sum(flags)
            new = pa.array([canonical(t) if f else t for t, f in zip(got, flags, strict=True)], pa.string())
            cols = [new if i == at else c for i, c in enumerate(b.columns) if b.schema.names[i] != "changed"]
            names = [n for n in b.schema.names if n != "changed"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(flags, pa.bool_())], [*names, "changed"])

    cols = [c for c in df.columns if c != "changed"]
    return df.select(*cols).mapInArrow(run, type(schema)([f for f in schema if f.name != "changed"]).add("changed", "boolean"))


def found(tables_by_name: dict[str, DataFrame]) -> DataFrame:
    """Distinct (src, id) of the rows whose own text has to change."""
    return canonicalize(texts(tables_by_name), only_changed=True).where("id is not null").select("src", "id").distinct()
