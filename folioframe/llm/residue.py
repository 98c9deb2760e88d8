"""Template residue, filler and error pages told from real content.

Trusted labels come from the text itself: unfilled template fields, filler sentences, and pages of messages (texts all of
whose units are error messages, demands to enable scripts or site navigation) with at least one message that nothing else
says (`STRICT`).  A page whose messages could be said of a book as well ("the volume has been moved") is doubtful: it gets
its label only from trusted pages it is linked with.  Links are near-duplicates: every text gets a 256-bit SimHash of its
five-word shingles (digits, paths and navigation masked), partitioned tables of SimHash bands propose near-duplicates of
all pages of messages, Hamming distance and shingle similarity verify them, and so on from every text that is reached;
pages are also linked by a message they share, masked alike.  Labels run through the connected components of these links.
Labels for a *part* of a text (a field, a filler sentence) are not carried: a clean copy of the text is no residue.

A field name in a syntax that editors also use (`{x}`, `{{x}}`, `[[x]]`) counts only if it is all capitals, has an
underscore, or is used as a field name in a plain template syntax somewhere in the table.

Defined results: null and empty texts are no case; texts of any length are read whole; repeated rows and ids give one row;
empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from .canonical import canonical
from .scans import HYPHENS, form
from .sentences import units

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_BITS = 21, 12
#: Bits of 256 that may differ; texts of similarity 0.8 differ in about 39.
MAX_HAMMING = 64
#: So many verified pairs (narrow rows) may be broadcast; more are joined by shuffling.
BROADCAST_PAIRS = 20_000
#: Probes of one bucket beyond this number are dealt out over this many parts of the bucket's rows each.
HOT_PROBES, SALTS = 1000, 32

NAME = r"[A-Za-z][A-Za-z0-9_.\-‐¬⸗= \n]*?"
# Template syntaxes nothing else is written in; the group is the field's name.
FIELDS = [
    rf"\{{%[-\s]*(?:block|if|for|include|set|extends|end\w*)?\s*({NAME})\s*[-\s]*%\}}",
    rf"<%[=\-]?\s*({NAME})\s*%>",
    r"<\s*([A-Z][A-Z_\s\-‐¬⸗=]*?)\s+GOES\s+HERE\s*>",
    r"%%\s*([A-Z][A-Z_\s\-‐¬⸗=]*?)\s*%%",
    r"@@\s*([A-Z][A-Z_\s\-‐¬⸗=]*?)\s*@@",
    rf"%\(\s*({NAME})\s*\)[sdif]",
    rf"\$\{{\s*({NAME})\s*\}}",
    rf"#\{{\s*({NAME})\s*\}}",
    r"\[\s*INSERT\s+([^\[\]]+?)\s+HERE\s*\]",
    r"\[\s*[Yy]our\s+([^\[\]]+?)\s+here\s*\]",
    r"(?<![A-Za-z0-9_])__([A-Z][A-Z_\s\-‐¬⸗=]*?)__(?![A-Za-z0-9_])",
    r"(?<![A-Za-z])XX_([A-Z][A-Z_\s\-‐¬⸗=]*?)_XX(?![A-Za-z])",
    rf"&lt;\s*({NAME})\s*&gt;",
]
#: What a text must hold for each of these.
FIELD_MARKS = ["{%", "<%", "GOES", "%%", "@@", "%(", "${", "#{", "INSERT", "our", "__", "XX_", "&lt;"]
# Syntaxes that editors use for brackets of their own, too.
AMBIGUOUS = [rf"(?<![#$])\{{\{{?\s*({NAME})\s*\}}?\}}", rf"\[\[\s*({NAME})\s*\]\]", rf"<\s*({NAME})\s*>"]
# Words of the usual filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum tortor vitae massa nunc quisque "
    "mauris vestibulum pellentesque vivamus viverra sapien lectus pharetra vel donec integer suspendisse ultrices".split()
)
LOREM_MARKS = frozenset("lorem ipsum tempor mollit pariatur velit quisque tortor aliqua nulla labore".split())
# Sentences that stand in for content, matched from a sentence's start (case-folded).
FILLERS = [
    r"(?:x{2,}\W+){2,}x*\W*$",
    r"(?:tb[dca]\W+){2,}$",
    r"(?:asdf|jkl|qwert[yz]?|foo|bar|baz|blah?|test)(?:\W+(?:asdf|jkl|qwert[yz]?|foo|bar|baz|blah?|test)){2,}\W*$",
    r"(?:(?:this is )?(?:a |some )?(?:dummy|sample|placeholder|filler|example)\s+(?:text|line|paragraph|copy|content|sentence|title)\b.{0,80})$",
    r"(?:(?:your|the|a|some|introductory|sample|main|body)\s+)?(?:\w+\s+){0,3}?(?:text|summary|content|title|abstract|description|copy|caption|introduction)\s+(?:goes here|will appear (?:here|in this space)|to follow|to come|here)\W*$",
    r"(?:hier steht\b.{0,20}|das ist\b.{0,20}|ein\s+)?(?:blindtext|platzhalter(?:text)?|beispieltext|fülltext)\b.{0,60}$",
    r"(?:ceci est\b.{0,20})?(?:texte? de remplissage|faux[- ]texte|texte? fictif|texte? d'exemple)\b.{0,60}$",
    r"(?:questo è\b.{0,20})?(?:testo (?:segnaposto|fittizio|di riempimento|di prova|di esempio))\b.{0,60}$",
    r"(?:это\s+)?(?:текст-?\s*заполнитель|заполняющий текст|рыбный текст|пример текста|здесь будет текст)\b.{0,60}$",
    r"(?:κείμενο (?:γεμίσματος|κράτησης θέσης|δείγματος|υποκατάστασης)|δοκιμαστικό κείμενο|εδώ θα (?:μπει|εμφανιστεί)).{0,60}$",
    r"(?:此处|此處|这里|這裡)?(?:为|為|是)?(?:占位|佔位|填充|示例)文[字本].{0,20}$|(?:此处|这里)(?:填写|输入|为占位).{0,30}$",
    r"(?:ここに(?:本文|テキスト|文章|説明|タイトル).{0,12}(?:入ります|入る|入力).{0,10}|ダミー(?:テキスト|文).{0,30})$",
    r"(?:هذا\s+)?(?:نص (?:بديل|تجريبي|مؤقت|افتراضي|نائب)).{0,60}$",
    r"(?:นี่คือ)?(?:ข้อความ(?:ตัวอย่าง|จำลอง|แทน|สมมติ|ตัวยึด)).{0,60}$",
]
#: Those of short words repeated, whose literals many texts hold: they are looked for anywhere in the text first.
REPEATED = FILLERS[:3]
THING = r"(?:page|document|volume|edition|item|link|resource|text layer|text|layout result|viewer|scan|server|site|reading room|gateway|upstream|session|request(?:ed)?|service|image|url|address|file|reader|application|catalogue|collection)"
# Units of error pages, from the unit's start (case-folded).
ERRORS = [
    r"(?:http\s*)?(?:error|fehler|erreur|errore|ошибка|код ошибки|σφάλμα|κωδικός σφάλματος|错误|錯誤|エラー|خطأ|ข้อผิดพลาด|http)\s*(?:code|代码|コード)?\W{0,3}\d{3}\b(?![^.:\n]*\b(?:in|im|of|dans|nel)\b).{0,50}$",
    r"(?:[45]\d\d\W+)?(?:not found|bad gateway|bad request|forbidden|unauthori[sz]ed|request time-?out|too many requests|(?:service )?(?:temporarily )?unavailable|service temporarily unavailable|internal server error|gateway time-?out|gone|access denied|permission denied|conflict|not acceptable|method not allowed)(?:\W*[(]?\d{3}[)]?)?\W*$",
    rf"(?:the|this|your|our|sorry,? the|that)?\s*(?:\w+ ){{0,3}}?{THING}\b.{{0,60}}?\b(?:could not be|cannot be|can not be|can't be|is not|are not|was not|has been (?:moved|withdrawn|removed|deleted)|is no longer|has expired|took too long|is closed|is down|sent an invalid|is unavailable|not found|failed|was empty|has moved)\b.{{0,90}}$",
    r"(?:oops|sorry|whoops)?\W*(?:something went wrong|we hit a problem|an (?:unexpected )?error (?:has )?occurred|you do not have permission|you are not authori[sz]ed|rate limit|conversion failed|traceback \(most recent|error:|fatal error|exception in|stack trace|incident \d+).{0,120}$",
    r"file \"[^\"]+\", line \d+.{0,60}$|\w*(?:error|exception): .{0,80}$",
    r"(?:die|das|der)?\s*(?:angeforderte\w*\s+)?(?:seite|dokument|datei|dienst|server)\b.{0,50}(?:nicht (?:gefunden|verfügbar|erreichbar)|wurde (?:verschoben|gelöscht|entfernt)).{0,40}$",
    r"(?:la|le|cette|ce)?\s*(?:page|document|service|serveur|erreur interne)\b.{0,50}(?:introuvable|indisponible|n'existe (?:pas|plus)|a été (?:déplacée?|supprimée?)|du serveur).{0,40}$",
    r"(?:la|il|questa|questo)?\s*(?:pagina|documento|servizio|server|errore interno)\b.{0,50}(?:non (?:trovat|disponibil|è stat)|è stato (?:spostato|rimosso)|è stata (?:spostata|rimossa)|del server).{0,40}$",
    r"(?:страница|документ|сервер|сервис|служба)\b.{0,40}(?:не найден|недоступ|удал[её]н|перемещ|не отвечает).{0,40}$",
    r"(?:η|το|ο)?\s*(?:σελίδα|έγγραφο|σύνδεσμος|διακομιστής|υπηρεσία)\b.{0,60}(?:δεν (?:βρέθηκε|είναι|υπάρχει|ανταποκρίνεται)|έχει (?:μετακινηθεί|διαγραφεί)).{0,40}$",
    r".{0,16}(?:页面|网页|頁面|服务器|文档).{0,12}(?:找不到|不存在|未找到|无法|已删除|不可用).{0,20}$|(?:找不到|无法(?:访问|打开|找到)).{0,20}$",
    r".{0,12}(?:ページ|サーバー|文書|サービス).{0,14}(?:見つかりません|存在しません|削除されました|利用できません|表示できません).{0,12}$",
    r".{0,10}(?:الصفحة|الخادم|الخدمة|المستند).{0,30}(?:غير موجود|غير متاح|تعذر|لم يتم العثور|حذف).{0,30}$|(?:تعذر|لم يتم العثور).{0,60}$",
    r"ไม่พบ(?:หน้า|เอกสาร|ไฟล์).{0,40}$|(?:หน้า|เซิร์ฟเวอร์|เอกสาร).{0,20}(?:ไม่พร้อม|ถูกลบ|ไม่สามารถ).{0,40}$",
]
#: Messages that nothing but an error page says: a status, a trace, a session, the site's own words in other languages.
STRICT = [
    *(p for i, p in enumerate(ERRORS) if i not in (2, 3)),
    r"(?:oops|whoops|sorry)?\W*(?:something went wrong|an (?:unexpected )?error (?:has )?occurred|you do not have permission|you are not authori[sz]ed|rate limit|conversion failed|traceback \(most recent|error:|fatal error|exception in|stack trace).{0,120}$",
    r"(?:your|the) session has expired\W*$|this item is not available in your (?:region|country)\W*$|.{0,40}\bserver is down\b.{0,40}$|.{0,60}\bon this server\W*$",
]
SCRIPT = r"(?:java\s*script|scripts|scripting|script support|cookies)"
# Demands to switch scripts on, from the unit's start (case-folded).
DEMANDS = [
    rf"(?:please |you (?:need|have|must)(?: to)? |to \w+ .{{0,40}}?,? ?|for .{{0,30}}?,? ?)?(?:enable|activate|turn on|switch on|allow|permit)\b.{{0,30}}{SCRIPT}.{{0,70}}$",
    rf"(?:this|our|the|your)\s+(?:\w+\s+){{0,3}}?(?:needs?|requires?|depends? on|relies on|does not support|uses|works? (?:only )?with|(?:will not|won't|does not|doesn't|cannot|can not) (?:be )?\w+ without)\b.{{0,50}}(?:{SCRIPT}|reader application).{{0,80}}$",
    rf"{SCRIPT}\s+(?:\w+ ){{0,2}}?(?:must|has to|have to|is required|are required|is disabled|are disabled|is turned off|needs to).{{0,60}}$",
    r"noscript\b.{0,90}$|checking your browser.{0,60}$|loading\W*$",
    r"(?:bitte\s+)?(?:aktivieren sie|schalten sie|erlauben sie)\b.{0,30}(?:javascript|skripte).{0,60}$|javascript\b.{0,30}(?:aktivieren|erforderlich|benötigt).{0,40}$",
    r"(?:veuillez\s+)?(?:activer|activez|autoriser|autorisez)\b.{0,25}(?:javascript|les scripts).{0,60}$",
    r"(?:abilitare|abilita|attivare|attiva|consentire)\b.{0,20}(?:javascript|script).{0,60}$",
    r"(?:для .{0,30}|пожалуйста,? |необходимо |требуется )*(?:включите|включить|разрешите|требуется)\b.{0,20}(?:javascript|скрипты|сценарии).{0,50}$",
    r"(?:παρακαλώ |για .{0,40})*(?:ενεργοποιήστε|ενεργοποίηση|απαιτείται).{0,20}(?:javascript|σενάρια).{0,50}$",
    r"(?:请|請)?.{0,8}(?:启用|啟用|开启|打开).{0,6}(?:javascript|脚本|腳本).{0,20}$|.{0,12}(?:需要|要求).{0,6}(?:javascript|脚本).{0,12}$",
    r".{0,20}(?:javascript|スクリプト).{0,8}(?:有効|オン|必要).{0,16}$",
    r".{0,20}(?:تفعيل|تمكين|تشغيل|يتطلب).{0,20}(?:javascript|جافا ?سكربت|جافا ?سكريبت|البرامج النصية).{0,30}$",
    r".{0,16}(?:เปิดใช้(?:งาน)?|ต้องใช้|อนุญาต).{0,10}(?:javascript|จาวาสคริปต์|สคริปต์).{0,30}$",
]
# What stands around such messages on a page, from the unit's start (case-folded).
FURNITURE = [
    r"(?:please )?(?:try again|reload|refresh|retry|sign in|log in|go back|return|back to|contact|use the|use another|switch it on|turn (?:it|them) on|switch scripting|enable it|allow it|allow them|then (?:refresh|reload)|wait|check the|report|see the help|visit).{0,90}$",
    r"please (?:allow|enable|try|wait|reload|refresh|contact|check).{0,80}$",
    r"(?:zurück zur|retour à|torna (?:alla|a)|вернитесь на|вернуться|επιστροφή|返回|戻る|العودة|กลับ).{0,50}$",
    r"(?:reference|incident|request id|code|trace|ref\.?)\W*[\w\-]*\d[\w\-]*\W*$",
    r"番号\d+のページ.{0,20}$",
]
PARTS = re.compile(r"(?<=[.!?。！？])\s+")
NAV = re.compile(r"^[^.!?。]{1,40}(?:\s+[|–—·•>/]\s+[^.!?。|–—·•>]{1,30}){1,}$")
#: What every navigation line holds.
NAV_MARK = re.compile(r"\s[|–—·•>/]\s")


def literals(pattern: str) -> list[list[frozenset[str]]]:
    """What a text must hold to match a pattern: of one of the alternatives, a literal out of each set."""

    def size(words: frozenset[str]) -> int:
        return min(len(w) if w.isascii() else 2 * len(w) for w in words)

    def needs(seq: Iterable) -> list[frozenset[str]]:
        out, run = [], {""}

        def flush() -> None:
            nonlocal run
            out.append(frozenset(run))
            run = {""}

        for op, av in seq:
            chars = {chr(v) for _, v in av} if op is sre.IN and all(o is sre.LITERAL for o, _ in av) else set()
            if op is sre.LITERAL:
                run = {r + chr(av) for r in run}
            elif chars and len(chars) * len(run) <= 16:
                run = {r + ch for r in run for ch in chars}
            elif op is sre.AT:
                continue
            else:
                if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0] and len(av[2]) == 1 and av[2][0][0] is sre.LITERAL:
                    run = {r + chr(av[2][0][1]) * av[0] for r in run}
                flush()
                if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0]:
                    out.extend(needs(av[2]))
                elif op is sre.SUBPATTERN:
                    out.extend(needs(av[3]))
                elif op is sre.BRANCH:
                    ways = [max(needs(w), key=size, default=None) for w in av[1]]
                    if None not in ways:
                        out.append(frozenset().union(*ways))
        flush()
        return [words for words in out if size(words) >= 2]

    tree = parser.parse(pattern)
    ways = tree[0][1][1] if len(tree) == 1 and tree[0][0] is sre.BRANCH else [tree]
    return [needs(w) for w in ways]


@lru_cache(1)
def compiled() -> dict[str, object]:
    import ahocorasick

    # a way's rarest literals lead to it; whether the text holds the others is asked then
    ways: list[tuple[str, list[frozenset[str]]]] = [("fill", way) for p in FILLERS if p not in REPEATED for way in literals(p)] + [("fill", [frozenset(LOREM_MARKS)])]
    ways += [("page", way) for p in ERRORS + DEMANDS for way in literals(p)] + [(p, way) for p in REPEATED for way in literals(p)]
    leads: dict[str, list[int]] = {}
    for i, (_, way) in enumerate(ways):
        way.sort(key=lambda words: (-min(map(len, words)), len(words)))
        for w in way[0]:
            leads.setdefault(w, []).append(i)
    automaton = ahocorasick.Automaton()
    for w, ids in leads.items():
        automaton.add_word(w, tuple(ids))
    automaton.make_automaton()
    join = lambda ps: re.compile("(?:" + "|".join(f"(?:{p})" for p in ps) + ")", re.S)
    return {
        "triggers": automaton,
        "ways": ways,
        "repeated": {p: re.compile(p.replace("$", ""), re.S) for p in REPEATED},
        "sign": re.compile(r"[{}<%@$#&\[]|__|XX_"),
        "fields": [(marks, re.compile(p)) for marks, p in zip(FIELD_MARKS, FIELDS, strict=True)],
        "ambiguous": [re.compile(p) for p in AMBIGUOUS],
        "filler": join(FILLERS),
        "strict": join(STRICT),
        "error": join(ERRORS),
        "demand": join(DEMANDS),
        "furniture": join(FURNITURE),
        "path": re.compile(r"(?<!\S)(?:https?:/)?/[\w/.\-]+"),
    }


def gates(low: str) -> set[str]:
    """Which patterns the literals of a folded text admit: fill and page."""
    c = compiled()
    hits = {i for _, ids in c["triggers"].iter(low) for i in ids}
    out: set[str] = set()
    for i in hits:
        gate, way = c["ways"][i]
        if gate not in out and all(any(w in low for w in words) for words in way[1:]):
            out.add(gate)
    return {"fill" if g in c["repeated"] else g for g in out if g not in c["repeated"] or c["repeated"][g].search(low)}


def field_name(raw: str) -> str:
    """A field's name whatever its case, joints and line breaks."""
    return re.sub(r"[\s_\-.‐¬⸗=]+", "", raw).lower()


def fields_in(text: str) -> tuple[list[str], list[str]]:
    """Names of fields in plain template syntax, and names in ambiguous syntax that need the table's evidence."""
    c = compiled()
    if not c["sign"].search(text):
        return [], []
    sure = [field_name(m.group(1)) for mark, p in c["fields"] if mark in text for m in p.finditer(text)]
    doubtful = []
    for p in c["ambiguous"]:
        for m in p.finditer(text):
            raw = m.group(1).strip()
            compact = re.sub(r"[\s\-‐¬⸗=]+", "", raw)
            if re.fullmatch(r"[A-Z][A-Z0-9_]{2,}", compact) or re.fullmatch(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+", compact):
                sure.append(field_name(raw))
            else:
                doubtful.append(field_name(raw))
    return sure, doubtful


def is_filler(unit: str) -> bool:
    """Whether a sentence unit, or a sentence run into it, is filler in place of content."""
    parts = PARTS.split(unit)
    if len(parts) > 1:
        return any(map(is_filler, parts))
    low = unit.lower()
    words = re.findall(r"[^\W\d_]+", low)
    if len(words) >= 4 and sum(w in LOREM for w in words) >= 0.85 * len(words) and any(w in LOREM_MARKS for w in words):
        return True
    return bool(compiled()["filler"].match(low.strip("\"'“”«» ")))


def unit_kind(unit: str) -> str:
    """error, script, furniture or content."""
    c, low = compiled(), unit.lower().strip("\"'“”«» ")
    if c["demand"].match(low):
        return "script"
    if c["error"].match(low):
        return "error"
    if NAV.match(unit) or c["furniture"].match(low):
        return "furniture"
    return "content"


def is_strict(unit: str) -> bool:
    """Whether a message is said by nothing but such pages."""
    low = unit.lower().strip("\"'“”«» ")
    return bool(compiled()["strict"].match(low) or compiled()["demand"].match(low))


def may_be_page(text: str) -> bool:
    """False where a text cannot be a page of messages: a quarter of it is one line of content."""
    longest = max(text.split("\n"), key=len)
    if 4 * len(longest) < len(text) or len(longest.split()) <= 4:
        return True
    return any(unit_kind(longest[a:z]) != "content" for a, z in units(longest))


def page_kind(us: list[str]) -> tuple[str, list[str]]:
    """error or script, and its messages, where the units are messages but for a quarter of their length or for short lines."""
    left, short = 0.25 * sum(map(len, us)), True
    kinds, messages = set(), []
    for u in sorted(us, key=len, reverse=True):  # the longest first: content shows soon
        k = unit_kind(u)
        kinds.add(k)
        if k in ("error", "script"):
            messages.append(u)
        elif k == "content":
            left -= len(u)
            short = short and len(u.split()) <= 4 and not u.rstrip().endswith((".", "。", "·"))
            if left < 0 and not short:
                return "", []
    return ("script" if "script" in kinds else "error" if "error" in kinds else ""), messages


def joined(lines: Iterable[str]) -> str:
    """Lines as running text: broken words rejoined, blank lines kept."""
    parts: list[str] = []
    before = ""
    for line in lines:
        s = line.strip(" \t")
        if before and s:
            if before[-1] in HYPHENS and before[-2:-1].isalpha():
                parts[-1] = before[:-1]
            else:
                parts.append(" ")
        elif parts:
            parts.append("\n")
        parts.append(s)
        before = s
    return "".join(parts)


class Label(NamedTuple):
    """What a text alone tells: the kind of its residue, whether all of it is, whether that is certain, field names, messages."""

    kind: str = ""
    whole: bool = False
    trusted: bool = True
    names: list[str] = []
    doubtful: list[str] = []
    messages: list[str] = []


def label(text: str, scan: bool = False, forms: list[str] | None = None) -> Label:
    """The label of a text; `forms` are those of its lines, where they are known."""
    sure, doubtful = fields_in(text)
    if sure:
        return Label("placeholder", False, True, sure, doubtful)
    flat = text
    if scan:  # running titles and page numbers stand between the lines of a sentence
        lines = text.split("\n")
        forms = forms or [form(x.strip()) for x in lines]
        flat = joined(x for x, f in zip(lines, forms, strict=True) if f not in ("caps", "capsnum", "number"))
    open_ = gates(flat.lower())
    fill, page = "fill" in open_, "page" in open_ and may_be_page(flat)
    if not fill and not page:
        return Label(doubtful=doubtful)
    us = [flat[a:z] for a, z in units(flat)]
    filler = [is_filler(u) for u in us] if fill else []
    if any(filler):
        return Label("filler", all(filler), True, sure, doubtful)
    kind, messages = page_kind(us) if page else ("", [])
    return Label(kind, bool(kind), any(map(is_strict, messages)), sure, doubtful, messages)


def masked(text: str) -> str:
    """The text that shingles are taken of: navigation lines dropped, folded, paths masked."""
    kept = "\n".join(ln for ln in text.split("\n") if not NAV.match(ln.strip())) if NAV_MARK.search(text) else text
    flat = kept.lower()
    return compiled()["path"].sub(" path ", flat) if "/" in flat else flat


#: What a character is to a token: nothing, a letter, a digit, a token of its own (scripts written without spaces).
NOTHING, LETTER, DIGIT, ALONE = range(4)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


@lru_cache(1)
def characters() -> np.ndarray:
    """The kind of every character up to the last plane with letters."""
    out = np.array([DIGIT if c.isdecimal() else LETTER if c.isalnum() else NOTHING for c in map(chr, range(0x33500))], dtype=np.uint8)
    for a, z in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xE00, 0xE7F)):
        out[a : z + 1] = ALONE
    return out


@lru_cache(4)
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _ODD[1] | np.uint64(1), dtype=np.uint64))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the masked texts' words in order, and the text of each, all at once; a run of digits counts as one 0."""
    flat = list(map(masked, texts))
    cp = np.frombuffer("\n".join(flat).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = characters()[np.minimum(cp, 0x334FF)]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    inside = (kind == LETTER) | (kind == DIGIT)
    start = (kind == ALONE) | (inside & ((before == NOTHING) | (before == ALONE)))
    keep = ((kind != NOTHING) & ~((kind == DIGIT) & (before == DIGIT))).nonzero()[0]
    at = start[keep].nonzero()[0]
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(at, len(keep)))
    place = np.arange(len(keep)) - np.repeat(at, size)
    code = np.where(kind[keep] == DIGIT, np.uint32(48), cp[keep]).astype(np.uint64)
    h = np.add.reduceat(code * powers(1 << max(6, int(size.max()).bit_length()))[place], at)
    begins = np.cumsum([0, *(len(t) + 1 for t in flat[:-1])])
    return (h ^ (h >> np.uint64(29))) * _ODD[0], np.searchsorted(begins, keep[at], side="right") - 1


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of five words each."""
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        out ^= (words[i : i + n] + np.uint64(i + 1)) * _ODD[i]
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27))


def hashes(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashes of each text's five-word shingles in order; a shorter text is one shingle."""
    words, text = tokens(texts)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    every = shingles(words) if len(words) >= SHINGLE else words[:0]
    out = []
    for a, k in zip(first.tolist(), n.tolist(), strict=True):
        if 0 < k < SHINGLE:
            h = shingles(np.concatenate([words[a : a + k], np.zeros(SHINGLE - k, dtype=np.uint64)]))
        else:
            h = np.sort(every[a : a + max(0, k - SHINGLE + 1)])
            if len(h) > 1:
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        out.append(h)
    return out


@lru_cache(1)
def lanes() -> np.ndarray:
    """A byte's bits as eight bytes of a word, so that up to 255 of them are added at once."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """256 bits as four signed longs for each set of shingles; zeros for an empty one."""
    total = np.zeros((len(sets), 256), dtype=np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    # stretches of one set of at most 255 shingles, as many at once as fit a few megabytes
    cuts = [(a, k) for k, (z, n) in enumerate(zip(np.cumsum(size).tolist(), size.tolist(), strict=True)) for a in range(z - n, z, 255)]
    begins, owner = np.array([a for a, _ in cuts], dtype=np.int64), np.array([k for _, k in cuts], dtype=np.int64)
    i = 0
    while i < len(cuts):
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + 16_384)))
        part = every[begins[i] : begins[j] if j < len(cuts) else len(every)]
        wide = (part ^ (part >> np.uint64(31)))[:, None] * _ODD[None, :4]
        wide ^= wide >> np.uint64(29)
        sums = np.add.reduceat(lanes()[wide.view(np.uint8)], begins[i:j] - begins[i], axis=0)
        np.add.at(total, owner[i:j], sums.view(np.uint8))
        i = j
    return np.packbits(2 * total > size[:, None], axis=1).view(np.int64)


SEEDS = "doc_id long, kind string, whole boolean, trusted boolean, names array<string>, doubtful array<string>, messages array<long>, digest long, n_shingles int, bits array<long>"
SEED_TYPES = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64())]


def digest(shingles: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(np.bitwise_xor.reduce(shingles).view(np.int64)) if len(shingles) else 0


def seeds(documents: DataFrame, more: Callable[[str, bool, list[str] | None], object] | None = None, sql: str = "", kind: pa.DataType | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per text: what it alone tells, its field names, the digests of its messages, and its SimHash.

    Another reader of the same canonical text may take part as `more`, of type `sql`; columns in `keep` come along.
    """
    names = [c.split()[0] for c in SEEDS.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([SEEDS, *(f"`{k}` {kinds[k]}" for k in keep), *[f"more {sql}"] * bool(more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pa.compute.utf8_length(whole.column(1)).to_pylist()
            a = 0
            while a < len(size):  # texts of about a million characters at once
                z, n = a, 0
                while z < len(size) and (z == a or n + size[z] <= 1_000_000):
                    n, z = n + size[z], z + 1
                b = whole.slice(a, z - a)
                a = z
                texts = list(map(canonical, b.column(1).to_pylist()))
                forms = [[form(x.strip()) for x in t.split("\n")] if scan else None for t, scan in zip(texts, b.column(2).to_pylist(), strict=True)]
                got = [label(t, f is not None, f) for t, f in zip(texts, forms, strict=True)]
                said = [m for g in got for m in g.messages]
                sets = hashes(texts + said)
                digests = iter(map(digest, sets[len(texts) :]))
                sets = sets[: len(texts)]
                rows = [b.column(0), [g.kind for g in got], [g.whole for g in got], [g.trusted for g in got], [sorted(set(g.names)) for g in got], [sorted(set(g.doubtful)) for g in got], [sorted({next(digests) for _ in g.messages}) for g in got]]
                rows += [list(map(digest, sets)), list(map(len, sets)), simhashes(sets).tolist()]
                cols = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(rows, SEED_TYPES, strict=True)] + [b.column(3 + i) for i in range(len(keep))]
                if more:
                    cols.append(pa.array([more(t, f is not None, f) for t, f in zip(texts, forms, strict=True)], kind))
                yield pa.RecordBatch.from_arrays(cols, [*names, *keep, *["more"] * bool(more)])

    layout = F.coalesce(F.col("layout") == "scan", F.lit(False)) if "layout" in documents.columns else F.lit(False)
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", layout.alias("scan"), *keep)
    return spread(rows).mapInArrow(run, schema)


def _bands(df: DataFrame, probe: bool) -> DataFrame:
    """Rows of the partitioned tables: a key of band number, band bits and size class; probes look at the classes beside."""
    words = [f"bits[{i}]" for i in range(4)]
    bands = []
    for k in range(BANDS):
        at = k * BAND_BITS
        w, off = at // 64, at % 64
        low = f"(shiftrightunsigned({words[w]}, {off}) & {(1 << BAND_BITS) - 1})"
        if off + BAND_BITS > 64:
            low = f"(({low}) | (shiftleft({words[w + 1]}, {64 - off}) & {(1 << BAND_BITS) - 1}))"
        bands.append(f"{low} + cast({k} as bigint) * {1 << BAND_BITS}")
    keyed = df.withColumn("size_class", F.expr("cast(floor(ln(n_shingles) / ln(1.25)) as bigint)"))
    if probe:
        keyed = keyed.withColumn("size_class", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)))
    return keyed.select("digest", F.expr(f"explode(array({', '.join(bands)}))").alias("band"), "size_class").select("digest", F.expr("band * 4096 + size_class + 1").alias("key"))


def _similar(pairs: DataFrame) -> DataFrame:
    """Verify candidate pairs by the similarity of their texts' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = hashes([canonical(x), canonical(y)])
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= SIMILARITY * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["digest", "from"]).filter(pa.array(keep))

    return pairs.select("digest", "from", "text", "other").mapInArrow(run, "digest long, from long")


def _verified(cand: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs (digest, from) that Hamming distance and shingle similarity confirm."""
    a = reps.select("digest", "rep", "bits")
    b = reps.select(F.col("digest").alias("from"), F.col("rep").alias("from_rep"), F.col("bits").alias("from_bits"))
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("from_bits")[i])) for i in range(4)), F.lit(0))
    near = cut(cand.join(a, "digest").join(b, "from").where(apart <= MAX_HAMMING).select("digest", "from", "rep", "from_rep"))
    few = near.count() <= BROADCAST_PAIRS  # few pairs fetch their texts without moving the others
    near = F.broadcast(near) if few else near
    others = near.select("from_rep").distinct()
    other = texts.select(F.col("rep").alias("from_rep"), F.col("text").alias("other")).join(F.broadcast(others) if few else others, "from_rep")
    return _similar(texts.join(near, "rep").join(other, "from_rep")).distinct()


def _matched(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Candidate pairs (digest, from) of the buckets' rows and probes; the rows of a bucket with many probes are dealt out."""
    hot = probes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PROBES).select("key", F.lit(SALTS).alias("salts"))
    a = table.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("digest"), F.coalesce("salts", F.lit(1))))
    b = probes.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)))
    return a.select("digest", "key", "salt").join(b.select("from", "key", "salt"), ["key", "salt"]).select("digest", "from").distinct()


def near_links(reps: DataFrame, sure: DataFrame, doubtful: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (digest, from) from trusted and doubtful pages to their near-duplicates, from these to theirs, and so on.

    A round looks at each bucket's first probe, which reaches most of a large group of alike texts, and then matches what is
    left of the bucket with all its probes, so that no text that is near a probe is missed.  Doubtful pages are matched with
    every page.
    """
    links, settled, frontier = None, sure, sure.unionByName(doubtful)
    table = _bands(reps.join(sure, "digest", "left_anti"), probe=False)
    while not frontier.isEmpty():
        probes = cut(_bands(reps.join(frontier, "digest", "left_semi"), probe=True).select(F.col("digest").alias("from"), "key"))
        # the rows of buckets that hold a probe: the tables are read once a round
        hits = cut(table.join(probes.groupBy("key").agg(F.min("from").alias("first")), "key"))
        grown = None
        for one in (True, False):
            left = hits.join(settled, "digest", "left_anti")
            cand = left.select("digest", F.col("first").alias("from")).distinct() if one else _matched(left, probes)
            new = cut(_verified(cand.where("digest <> from"), reps, texts))
            links = new if links is None else links.unionByName(new)
            got = new.select("digest").distinct().join(doubtful, "digest", "left_anti")
            grown = got if grown is None else grown.unionByName(got)
            settled = cut(settled.unionByName(got).distinct())
        frontier = cut(grown)
    return links if links is not None else sure.select("digest", F.col("digest").alias("from")).limit(0)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (a, b): the smallest node of each, in a logarithmic number of rounds.

    Each round hooks every node to the smallest node of its neighbourhood and of theirs and replaces links by those between
    roots (pointer jumping); sums are partial before they are shuffled, so a node with very many links is no hot spot.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(edges.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        jumped = roots.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        beside = edges.join(jumped.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("beside"))
        # a node takes over its neighbours' smallest root, and so does the root it had
        new = jumped.join(beside, jumped["node"] == beside["a"]).select("node", "root", F.least("root", "beside").alias("new"))
        hooked = new.select("node", "new").unionByName(new.select(F.col("root").alias("node"), "new")).groupBy("node").agg(F.min("new").alias("root"))
        after = cut(hooked)
        if after.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty():
            return after
        roots = after


def labelled(documents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, how) of all residue texts, from the checkpointed rows of `seeds` where there are some.

    `how` is text for a text's own trusted label, name for a field name used as one elsewhere, and link for a label that came
    through a component.
    """
    rows = cut(seeds(documents)) if rows is None else rows
    known = rows.select(F.explode("names").alias("name")).distinct()
    # field names in ambiguous syntax count where the table uses them as fields
    doubtful = rows.where("kind = '' and size(doubtful) > 0").select("doc_id", F.explode("doubtful").alias("name")).join(known, "name", "left_semi").select("doc_id").distinct()
    named = doubtful.select("doc_id", F.lit("placeholder").alias("kind"), F.lit("name").alias("how"))
    direct = rows.where("kind <> '' and trusted").select("doc_id", "kind", F.lit("text").alias("how"))
    # representatives of texts alike but for digits and paths
    reps = cut(rows.where("n_shingles > 0").groupBy("digest").agg(F.max(F.when(F.col("whole"), F.col("kind"))).alias("page"), F.max(F.when(F.col("whole") & F.col("trusted"), F.col("kind"))).alias("label"), F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("bits").alias("bits")))
    pages = reps.where("page is not null").select("digest", "label")
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")
    links = near_links(reps, pages.where("label is not null").select("digest"), pages.where("label is null").select("digest"), texts).select(F.col("digest").alias("a"), F.col("from").alias("b"))
    # a message is a node of its own, told from texts by its negated digest
    said = rows.where("whole and size(messages) > 0").select(F.col("digest").alias("a"), F.explode("messages").alias("m")).select("a", F.bitwise_not("m").alias("b"))
    alone = pages.select(F.col("digest").alias("a"), F.col("digest").alias("b"))
    groups = components(links.unionByName(said).unionByName(alone)).withColumnRenamed("node", "digest")
    sure = groups.join(reps.where("label is not null").select("digest", "label"), "digest").groupBy("root").agg(F.max("label").alias("kind"))
    reached = groups.join(sure, "root").select("digest", "kind")
    # every text of a reached class; texts with a label of their own keep it
    linked = rows.where("kind = '' or not trusted").select("doc_id", "digest").join(reached, "digest").select("doc_id", "kind", F.lit("link").alias("how"))
    every = direct.unionByName(named).unionByName(linked)
    return every.groupBy("doc_id").agg(F.max("kind").alias("kind"), F.max("how").alias("how"))


def found(documents: DataFrame) -> DataFrame:
    """Distinct doc_id of the residue texts."""
    return labelled(documents).select("doc_id")


def clean(documents: DataFrame) -> DataFrame:
    """The documents without residue."""
    return documents.join(found(documents), "doc_id", "left_anti")
