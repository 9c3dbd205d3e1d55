"""Personal information inside free text, by a semi-Markov conditional random field.

Candidate segments (whole spans with a type) are proposed by shape; features of the whole span and its
surroundings score each; a dynamic program over segment ends chooses, for the whole text, the set of
non-overlapping segments with the greatest total score, so boundaries and types are decided
together. A segment that no type explains is ordinary text with score 0. The weights are the maximum of the
conditional likelihood over ``TRAINING_SENTENCES`` generated labelled sentences (``pii_sentences``), fitted on the
driver in a few seconds. The name lexicon gives features, not answers: any capitalised word may be in a name.

Segments are bounded by their proposals: an address, the longest type, spans at most three lines; a name has at most
``NAME_WORDS`` words (initials and particles apart), a phone or identity number ``DIGITS`` digits. What is longer is not
proposed whole.

Defined results: null, empty and blank texts have no segments; whole texts are searched; ``found`` is the
text as written; a repeated segment of a text gives one row; an empty lexicon leaves shape and context.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("name", "email", "phone", "identity", "address")
TRAINING_SENTENCES = 4000
#: Words of the longest name, and digits of the shortest and longest number, that are proposed.
NAME_WORDS = 5
DIGITS = (7, 18)
MAX_LEXICON = 1_000_000

# full-width letters, digits and signs, one for one, and blanks other than the plain one
_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys((0x3000, 0xA0, 0x2009, 0x202F, 0x2007), 0x20) | dict.fromkeys((0x2010, 0x2011, 0x2012), 0x2D)
# the Chinese comma, colon, brackets and full stop keep their form: they are context
for _c in (0xFF0C, 0xFF1A, 0xFF08, 0xFF09, 0xFF1B):
    _PLAIN.pop(_c, None)

_L = r"A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
_UP, _LOW = r"A-ZÀ-ÖØ-ÞŁŚŠŽ", r"a-zß-öø-ÿłśšž"
_CITY = rf"[{_UP}][{_L}'’-]+(?: [{_UP}][{_L}'’-]+(?=[,\r\n]|$))?"

# e-mail: sign, word or bracketed word for @ and the dot
_AT = r"(?:@|\s?[\[({<]\s?(?:at|AT|At)\s?[\])}>]\s?| AT )"
#: What every spelling of an e-mail holds: an @, a bracketed or upper-case word for it, or a word for the dot.
_EMAIL_SIGNS, _EMAIL_WORD = ("@", " AT ", " dot "), re.compile(r"[\[({<]\s?[aA][tT]\s?[\])}>]")
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?| DOT | dot )"
_EMAIL = re.compile(rf"(?<![{_L}0-9._%+-])[{_L}0-9][{_L}0-9._%+'-]*(?:{_AT}|(?: at (?=[A-Za-z0-9-]+ dot ))){'[A-Za-z0-9-]+'}(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])")

# numbers in groups with single separators; every one that is long enough holds the first form
_LONG = re.compile(r"\d(?:\)?[ .\-/]?\(?\d){%d}" % (DIGITS[0] - 1))
_NUMBER = re.compile(r"(?<![A-Za-z0-9_.@/+-])(?<!\d,)(?=[+(]{0,2}" + _LONG.pattern + r")[+(]{0,2}\d+(?:[)]?[ .\-/]?[(]?\d+)*(?:X(?![A-Za-z0-9]))?")
_CODE = re.compile(r"(?<![A-Za-z0-9_-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,3}\d{6,9}(?:[A-Z]\d?)?|[A-Z]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{3}-\d{8}|\d{2}[A-Z]{2}\d{5})(?![A-Za-z0-9_-])")

#: Every code holds five digits, at most single blanks between them.
_DIGITS_OF_CODE = re.compile(r"(?:\d ?){5}")

_NUM = r"\d{1,5} ?[A-Za-z]?"
_STREETS = r"(?i:Street|St\.?|Road|Lane|Avenue|Way|Boulevard|Court|Drive|Close|Square|Terrace|Place|Crescent|Gardens|(?:Rd|Ln|Ave|Blvd|Ct|Dr|Sq)(?:\.(?=, ))?)"
_POST_EN = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5})"
_NL = r"\r?\n"
_ADDRESS = [
    re.compile(rf"(?<![A-Za-z0-9_-])(?:(?i:Flat|Unit|Suite|Apt\.?) \d+[A-Z]?,? )?{_NUM} (?:[NSEW]\.? )?(?:[{_UP}][{_L}'’-]+ ){{1,2}}{_STREETS}(?![{_L}])(?:,? (?i:Apt\.?|Flat|Unit|Suite) \w+)?(?:(?:, (?:{_CITY}),? |{_NL}{_CITY}(?:{_NL}|, |,? )){_POST_EN}|, {_CITY}(?=[.,;\n\r]|$))?(?![{_L}0-9])"),
    re.compile(rf"(?<![A-Za-z0-9_-])(?:(?:Am|Im|An der|Auf der|Zum|Zur|AM|IM) )?[{_UP}][{_L}-]*(?i:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|ufer|damm) {_NUM.replace('?[A-Za-z]?', '?[a-z]?')}(?:(?:, |{_NL}|,{_NL})(?:D-)?\d{{5}} {_CITY})?(?![{_L}0-9])"),
    re.compile(rf"(?<![A-Za-z0-9_-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?i:rue|avenue|boulevard|bd|place|chemin|allée|impasse|quai|cours)(?i: (?:de la|de|du|des)| de l['’]| d['’])? ?{_CITY}(?:(?:, |{_NL}|,{_NL})\d{{5}} {_CITY})?(?![{_L}0-9])"),
    re.compile(rf"(?<![A-Za-z0-9_-])(?:Calle|CALLE|C/|Avenida|AVENIDA|Avda\.?|Plaza|PLAZA|Paseo|Camino)(?i: (?:de la|de|del))? {_CITY},? (?i:n\.?[º°] ?)?\d{{1,4}}(?:, \d+\.?[ºª°](?: [A-Z])?)?(?:(?:, |{_NL}|,{_NL})\d{{5}} {_CITY})?(?![{_L}0-9])"),
    re.compile(r"[一-鿿]{2}市(?:[一-鿿]{2}区)?[一-鿿]{1,3}(?:路|街|道|巷)\d+号(?:\d+(?:栋|幢|号楼))?(?:\d+室)?"),
]

# what a text must hold, in lower case, for a form to occur; spares most texts the search
_ADDRESS_SIGNS = [
    ("street", " st", "road", " rd", "lane", " ln", "ave", " way", "blvd", "boulevard", "court", " ct", "drive", " dr", "close", "sq", "terrace", "place", "crescent", "gardens"),
    ("straße", "strasse", "str.", "weg ", "platz ", "gasse ", "allee ", "ring ", "ufer ", "damm "),
    ("rue", "avenue", "boulevard", "bd", "place", "chemin", "allée", "impasse", "quai", "cours"),
    ("calle ", "c/ ", "avenida ", "avda", "plaza ", "paseo ", "camino "),
    ("市",),
]

_PARTICLES = {"von", "van", "de", "der", "den", "del", "della", "di", "da", "du", "la", "le", "mac", "mc", "al", "el", "bin", "ibn", "ter", "ten", "zu", "zur", "dos", "das"}
# fixed values: words that open a sentence, by language, and are in no name
_OPENERS = set("The A An In On At By For From To With Of And Or But If When Then While After Before During This That These Those There It Its We Our They Their He She His Her You Your I No Not Each Every Both All Some Any Most Next Write Call Text Send Contact Reviewed Screened Readings Reached Archived Install Between Thanks See As Is Are Was Were Be Has Have Had Der Die Das Den Dem Des Ein Eine Einer Eines Im Am Zum Zur Bei Mit Nach Von Vor Für Und Oder Wir Es Ist Sind War Le La Les Un Une Des Du De Et Ou Dans Sur Pour Par Avec Nous Il Elle Ils Elles El Los Las Una Unos Unas En Con Por Para Del Al Y O Se Lo Su Sus".split())
_TOKEN = re.compile(rf"[{_L}]+(?:['’-][{_L}]+)*\.?")
# capitalised words and particles alone: what lies between is in no name, and the gap tells it
_CAPITAL = re.compile(rf"(?<![{_L}])(?<![{_L}]['’-])(?:[{_UP}][{_L}]*|(?:{'|'.join(sorted(_PARTICLES, key=len, reverse=True))})(?![{_L}]))(?:['’-][{_L}]+)*\.?")
_HAN = re.compile("[一-鿿]{2}")
_HAN_NAME = re.compile(r"(?:(?<=[为由与和：:=|·。，、\n\r ])|(?<=感谢)|(?<=^))(?!感谢|作者|通讯|请|电话|地址|邮箱|证件|受试)[一-鿿]{2,4}(?=，|提供|。|;| ?[|·]|\s|$|\(|（)")

# words around a segment, by language; fixed values
_CUES = {
    "phone": "tel phone telephone fax mobile cell call text hotline reached ring dial telefon rückruf erreichbar mobil handy fon tél téléphone joindre appeler portable teléfono llame móvil llamar 电话 拨打 手机 t",
    "identity": "ssn passport national identity id orcid insurance tax personal ausweisnummer steuer personenkennzahl steuer-id sozialversicherungsnummer reisepass sécurité identifiant personnel passeport dni nie nif pasaporte documento 身份证 证件号码 护照 identifier",
    "code": "lot batch lote issn issn-like doi checksum accession protocol trial 批号 range interval seed state item version isbn order sku commit",
    "name": "author reader by thanks contact signed frau herr mme mlle dr prof mr mrs ms dra sra sr ansprechperson zweitprüfung durch relu par correspondant revisado por contacto 作者 评审人 感谢 wishes regards grüßen cordialement saludo",
    "address": "address lives mailed parcels place anschrift adresse wohnt proben dirección vive kits 地址 住在 envoyés visit",
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws.split()}
_AFTER_NAME = {"wrote", "re-ran", "who", "and", "for", "hat", "a", "rated", "said", "signed", "validé", "ha"}
_AFTER_NO_NAME = {"et", "und", "index", "scale", "y", "等", "site", "data", "notes", "test", "method", "score", "model", "were", "lists", "segments", "等，"}


_UNPLAIN = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_PLAIN)))) + "]")


def plain(text: str) -> str:
    """The text with one plain character for each full-width one, of the same length."""
    return text.translate(_PLAIN) if not text.isascii() and _UNPLAIN.search(text) else text


def _fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


class Lexicon:
    """What a word tells: listed, built like listed ones, or also an ordinary word."""

    def __init__(self, tokens: dict[str, str]):
        self.roles = {_fold(t): r for t, r in tokens.items()}
        heads, tails = Counter(), Counter()
        for t in self.roles:
            for i in range(2, len(t) - 1):
                heads[t[:i]] += 1
                tails[t[i:]] += 1
        # a part counts when several listed names share it
        self.heads = {h for h, n in heads.items() if n >= 3}
        self.tails = {t for t, n in tails.items() if n >= 3}
        self.han = {t for t in self.roles if len(t) == 1}
        self.seen: dict[str, str] = {}
        self.tokens: dict[str, tuple[str, int]] = {}
        self.nothing: set[str] = set()

    def built(self, w: str) -> bool:
        return any(w[:i] in self.heads and w[i:] in self.tails for i in range(2, len(w) - 1))

    def kind(self, word: str) -> str:
        """g, f: listed as given or family name; n: built like one; o: listed, but not built like the others; '' none."""
        k = self.seen.get(word)
        if k is None:
            parts = [p for p in re.split(r"['’-]", _fold(word)) if p and p not in _PARTICLES]
            kinds = set()
            for p in parts:
                role, like = self.roles.get(p), self.built(p)
                kinds.add(("g" if role == "given" else "f") if role and like else "o" if role else "n" if like else "")
            k = "" if not kinds or "" in kinds else "o" if kinds == {"o"} else min(kinds - {"o"})
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = k
        return k


    def token(self, w: str) -> tuple[str, int]:
        """Kind of a token as it stands in text, and its length without a closing dot."""
        t = self.tokens.get(w)
        if t is None:
            dotted = w[-1] == "."
            core = w.rstrip(".")
            kind = "i" if dotted and len(core) == 1 and core.isupper() else "p" if core.lower() in _PARTICLES and not dotted else self.kind(core)
            if not kind and len(core) > 1 and core[0].isupper() and not core.isupper() and core not in _OPENERS:
                kind = "u"
            if len(self.tokens) > 500_000:
                self.tokens.clear()
            t = self.tokens[w] = (kind, len(w) if kind == "i" else len(core))
        return t


@dataclass(slots=True)
class Segment:
    start: int
    end: int
    kind: str
    features: list[str]


def _around(t: str, start: int, end: int) -> tuple[list[str], list[str], str, str]:
    """Words before and after on the line (few of them), and the signs that touch the span."""
    a = max(t.rfind("\n", max(0, start - 48), start) + 1, start - 48, 0)
    b = t.find("\n", end, end + 32)
    b = min(len(t), end + 32) if b < 0 else b
    left, right = t[a:start], t[end:b]
    words = re.findall(rf"[{_L}-]+|[一-鿿]+", left.lower())[-4:]
    nxt = re.findall(rf"[{_L}-]+|[一-鿿]+|\d+", right.lower())[:2]
    return words, nxt, (t[start - 1] if start else "\n"), (t[end] if end < len(t) else "\n")


def _context(t: str, start: int, end: int, f: list[str]) -> tuple[list[str], list[str], str, str]:
    """Adds what the surroundings tell, and gives them."""
    words, nxt, before, after = around = _around(t, start, end)
    for back, w in enumerate(reversed(words)):
        k = _CUE.get(w)
        if k is None and w[0] >= "一":
            k = next((c for cue, c in _CUE.items() if cue[0] >= "一" and w.endswith(cue)), None)
        if k:
            f.append(f"cue:{k}:{'near' if back < 2 else 'far'}")
            break
    alone = before == "\n" and after in "\n\r"
    if alone:
        f.append("alone")
    f.append(f"before:{before if not before.isalnum() else 'x'}")
    f.append(f"after:{after if not after.isalnum() else 'x'}")
    return around


def _number_segments(t: str, out: list[Segment], search_all: bool = False) -> None:
    for m in _NUMBER.finditer(t) if search_all or _LONG.search(t) else ():
        s, e = m.span()
        x = m[0]
        if len(x) < DIGITS[0]:
            continue
        while x.count("(") > x.count(")") and "(" in x:
            # an opening bracket that isn't closed within is context
            if x[0] == "(":
                s, x = s + 1, x[1:]
            elif x[0] == "+" and x[1] == "(":
                break
            else:
                break
        digits = sum(c.isdigit() for c in x)
        if not DIGITS[0] <= digits <= DIGITS[1] or (e < len(t) and (t[e].isalnum() and t[e] < "一" or t[e] in "@:=%" and e + 1 < len(t) and t[e + 1].isdigit())):
            continue
        groups = "-".join(str(len(g)) for g in re.findall(r"\d+", x))
        seps = "".join(sorted(set(re.sub(r"[\dX+]", "", x))))
        lead = "+" if "+" in x[:2] else "(" if x[0] == "(" else "00" if x.startswith("00") else "0" if x[0] == "0" else "9" if x[0] == "9" else "5" if x[0] == "5" else "d"
        base = [f"groups:{groups}", f"lead:{lead}", f"lead:{lead}:{digits}", f"digits:{digits}", f"seps:{seps}", f"shape:{lead}:{groups}:{seps}"]
        if re.fullmatch(r"(?:19|20)\d\d-[01]\d-[0-3]\d(?: \d\d)?", x):
            base.append("date")
        if x[-1] == "X":
            base.append("check letter")
        _context(t, s, e, base)
        out.append(Segment(s, e, "phone", ["phone", *[f"phone|{b}" for b in base]]))
        out.append(Segment(s, e, "identity", ["identity", *[f"identity|{b}" for b in base]]))
    for m in _CODE.finditer(t) if search_all or _DIGITS_OF_CODE.search(t) else ():
        base = ["code", "shape:" + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", m[0]))[:14]]
        _context(t, *m.span(), base)
        out.append(Segment(*m.span(), "identity", ["identity", *[f"identity|{b}" for b in base]]))


# words W, initials i, particles p, one comma c
_SPELLING = re.compile(r"(?:W|i){1,%d}i{0,2}p{0,2}W|p{0,2}WcWi{0,2}" % (NAME_WORDS - 1))


_PLAIN_WORD = ("", 0)


def _name_segments(t: str, lex: Lexicon, out: list[Segment], search_all: bool = False) -> None:
    run: list[tuple[int, int, str, str]] = []

    def flush() -> None:
        n = len(run)
        if n > 1:
            for i in range(n):
                if run[i][3] == "c":
                    continue
                words = run[i][3] not in "ip"
                for j in range(i + 1, n):
                    if run[j][3] in "ipc":
                        continue
                    words += 1
                    if words > NAME_WORDS:
                        break
                    spell(i, j)
        run.clear()

    def spell(i: int, j: int) -> None:
        part = run[i : j + 1]
        kinds = [p[3] for p in part]
        commas = kinds.count("c")
        names = [k for k in kinds if k in "gfnou"]
        pattern = "".join("W" if k in "gfnou" else k for k in kinds)
        if commas > 1 or not _SPELLING.fullmatch(pattern):
            return
        s, e = part[0][0], part[-1][1]
        words = [p[2] for p, k in zip(part, kinds) if k in "gfnou"]
        case = "upper" if all(w.isupper() for w in words) else "lower" if all(w.islower() for w in words) else "title" if all(w[0].isupper() for w in words) else "mixed"
        f = [f"pattern:{pattern}", f"case:{case}", f"first:{kinds[0]}", f"last:{kinds[-1]}", "kinds:" + "".join(sorted(set(names))), f"names:{len(names)}"]
        if all(k == "o" for k in names):
            f.append("all ordinary")
        elif all(k in "ou" for k in names):
            f.append("none known")
        before, nxt, left, right = _context(t, s, e, f)
        if nxt and nxt[0] in _AFTER_NAME:
            f.append("told of")
        if nxt and (nxt[0] in _AFTER_NO_NAME):
            f.append("not told of")
        if right == " " and e + 1 < len(t):
            c = t[e + 1]
            f.append("then:" + ("digit" if c.isdigit() else "(" if c in "(（" else "sign" if c in "|·&" else "upper" if c.isupper() else "lower" if c.islower() else c))
            if c.isupper() or c.islower():
                w = _TOKEN.match(t, e + 1)
                if w and lex.kind(w[0].rstrip(".")):
                    f.append("then:name")
        if left == " " and s > 1:
            c = t[s - 2]
            f.append("prior:" + ("sign" if c in "|·" else "&" if c in "&" else "word" if c.isalnum() else c))
        if before:
            f.append("prior word:" + (before[-1] if before[-1] in {"the", "and", "und", "nach", "along", "at", "see", "la", "à", "de", "by", "is", "to", "was"} else "other"))
        w = _TOKEN.match(t, e + 1) if right in "-–—&/" and e + 1 < len(t) else None
        if right in "–—" or left in "–—@" or w and right == "-":
            f.append("bound")
        out.append(Segment(s, e, "name", ["name", *[f"name|{x}" for x in f]]))

    end = -2
    token = lex.token
    # each distinct word is classified once; most are in no name
    known = {}
    for w in set(_TOKEN.findall(t)) - lex.nothing:
        k = token(w)
        if k[0]:
            known[w] = k
        elif len(lex.nothing) < 500_000:
            lex.nothing.add(w)
    # small letters matter only where a listed name is written so
    words = _TOKEN if any(k in "gfno" and not w[0].isupper() for w, (k, _) in known.items()) else _CAPITAL
    for m in words.finditer(t) if any(k in "gfnou" for k, _ in known.values()) else ():
        w = m[0]
        kind, size = known.get(w, _PLAIN_WORD)
        if not kind:
            if run:
                flush()
                end = -2
            continue
        s = m.start()
        gap = t[end:s] if end >= 0 else ""
        if run and gap == ", ":
            run.append((end, end + 1, ",", "c"))
        elif run and gap != " ":
            flush()
        run.append((s, s + size, w[:size], kind))
        end = s + size
        if kind != "i" and size < len(w):
            flush()
            end = -2
    flush()
    for m in _HAN_NAME.finditer(t) if search_all or not t.isascii() and _HAN.search(t) else ():
        w = m[0]
        f = [f"han:{len(w)}", "family listed" if w[0] in lex.han else "family not listed"]
        _context(t, *m.span(), f)
        if t.startswith("提供", m.end()) or t.startswith(("，已", "，负责"), m.end()):
            f.append("told of")
        if re.match(r" ?[|·;]|\r?\n", t[m.end() : m.end() + 3]):
            f.append("in a list")
        out.append(Segment(*m.span(), "name", ["han name", *[f"han|{x}" for x in f]]))


def propose(text: str, lex: Lexicon, search_all: bool = False) -> list[Segment]:
    """All candidate segments of a text, over its plain form. ``search_all`` searches forms whose signs the text lacks as well, with the same result."""
    t = plain(text)
    out: list[Segment] = []
    if search_all or any(w in t for w in _EMAIL_SIGNS) or _EMAIL_WORD.search(t):
        for m in _EMAIL.finditer(t):
            f = ["email", "email|sign" if "@" in m[0] else "email|word"]
            _context(t, *m.span(), f)
            out.append(Segment(*m.span(), "email", [x if x.startswith("email") else f"email|{x}" for x in f]))
    low = t.lower()
    for n, rx in enumerate(_ADDRESS):
        for w in _ADDRESS_SIGNS[n]:
            if w in low:
                break
        else:
            if not search_all:
                continue
        for m in rx.finditer(t):
            f = ["address", f"address|form:{n}", "address|post" if re.search(r"\d{5}|\d[A-Z]{2}$", m[0]) else "address|no post"]
            g: list[str] = []
            _context(t, *m.span(), g)
            out.append(Segment(*m.span(), "address", f + [f"address|{x}" for x in g]))
    _number_segments(t, out, search_all)
    _name_segments(t, lex, out, search_all)
    return out


def decode(segments: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The non-overlapping segments of the greatest total score."""
    scored = []
    for s in segments:
        v = sum(weights.get(f, 0.0) for f in s.features)
        if v > 0:  # a segment below ordinary text is never chosen
            scored.append((s.end, s.start, v, s))
    scored.sort(key=lambda x: (x[0], x[1]))
    ends, best, chosen = [-1], [0.0], [None]
    for e, s, v, seg in scored:
        k = bisect_right(ends, s) - 1
        total = best[k] + v
        if total > best[-1]:
            ends.append(e)
            best.append(total)
            chosen.append((k, seg))
        # otherwise the best up to here stays what it was
    out, k = [], len(best) - 1
    while k > 0:
        k, seg = chosen[k]
        out.append(seg)
    return out[::-1]


def _likelihood(segments: list[Segment], gold: set[tuple[int, int, str]], weights: dict[str, float]) -> tuple[dict[str, float], float]:
    """Gradient of the log likelihood of the gold segmentation, by forward and backward sums over segment ends."""
    points = sorted({p for s in segments for p in (s.start, s.end)})
    at = {p: i for i, p in enumerate(points)}
    by_end, by_start = defaultdict(list), defaultdict(list)
    scores = []
    for n, s in enumerate(segments):
        scores.append(sum(weights.get(f, 0.0) for f in s.features))
        by_end[at[s.end]].append(n)
        by_start[at[s.start]].append(n)

    def add(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    fw = [0.0] * len(points)
    for i in range(1, len(points)):
        fw[i] = add([fw[i - 1], *[fw[at[segments[n].start]] + scores[n] for n in by_end[i]]])
    bw = [0.0] * len(points)
    for i in range(len(points) - 2, -1, -1):
        bw[i] = add([bw[i + 1], *[bw[at[segments[n].end]] + scores[n] for n in by_start[i]]])
    grad: dict[str, float] = defaultdict(float)
    for n, s in enumerate(segments):
        p = math.exp(min(0.0, fw[at[s.start]] + scores[n] + bw[at[s.end]] - fw[-1]))
        d = ((s.start, s.end, s.kind) in gold) - p
        if abs(d) > 1e-6:
            for f in s.features:
                grad[f] += d
    return grad, fw[-1]


def train(lexicon: dict[str, str], sentences: int = TRAINING_SENTENCES, seed: int = 7, rounds: int = 6, rate: float = 0.4, shrink: float = 1e-4) -> dict[str, float]:
    """Weights by stochastic gradient steps with per-feature rates."""
    from auditloom.llm.pii_sentences import generate

    lex = Lexicon(lexicon)
    data = []
    for text, gold in generate(lexicon, sentences, seed):
        segments = propose(text, lex)
        if segments:
            data.append((segments, gold))
    weights: dict[str, float] = defaultdict(float)
    square: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        for segments, gold in data:
            grad, _z = _likelihood(segments, gold, weights)
            for f, g in grad.items():
                g -= shrink * weights[f]
                square[f] += g * g
                weights[f] += rate * g / math.sqrt(square[f])
    return dict(weights)


_HELD: dict[str, tuple[Lexicon, dict[str, float]]] = {}


def _model(spec: str) -> tuple[Lexicon, dict[str, float]]:
    if spec not in _HELD:
        if len(_HELD) > 3:
            _HELD.clear()
        tokens, weights = json.loads(spec)
        _HELD[spec] = (Lexicon(tokens), weights)
    return _HELD[spec]


_TRAINED: dict[str, str] = {}


def fitted(lexicon: DataFrame) -> str:
    """Lexicon and weights, fitted once a process for a lexicon."""
    rows = lexicon.where("token is not null").select("token", "role").limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError("the name lexicon is meant to be a small table")
    tokens = {r.token.strip(): r.role or "" for r in sorted(rows, key=lambda r: (r.token, r.role or "")) if r.token.strip()}
    key = json.dumps(tokens, sort_keys=True)
    if key not in _TRAINED:
        _TRAINED[key] = json.dumps([tokens, train(tokens)])
    return _TRAINED[key]


def segments_of(text: str | None, lex: Lexicon, weights: dict[str, float]) -> list[Segment]:
    return decode(propose(text, lex), weights) if text else []


def find(documents: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, found."""
    held = documents.sparkSession.sparkContext.broadcast(fitted(lexicon))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, weights = _model(held.value)
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                # a set: a segment that a text repeats counts once
                rows += [(k, kind, found) for kind, found in sorted({(s.kind, t[s.start : s.end]) for s in segments_of(t, lex, weights)})]
            yield pd.DataFrame(rows, columns=[key, "kind", "found"])

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInPandas(each, f"`{key}` {documents.schema[key].dataType.simpleString()}, kind string, found string")


def redact(documents: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, redacted (the text with [NAME], [EMAIL] and so on in place of each segment), segments."""
    held = documents.sparkSession.sparkContext.broadcast(fitted(lexicon))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, weights = _model(held.value)
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                found = segments_of(t, lex, weights)
                if not found:
                    rows.append((k, t, 0))
                    continue
                parts, at = [], 0
                for s in found:
                    parts += [t[at : s.start], f"[{s.kind.upper()}]"]
                    at = s.end
                rows.append((k, "".join(parts) + t[at:], len(found)))
            yield pd.DataFrame(rows, columns=[key, "redacted", "segments"])

    return documents.select(key, text).mapInPandas(each, f"`{key}` {documents.schema[key].dataType.simpleString()}, redacted string, segments bigint")
