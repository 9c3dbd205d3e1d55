"""Labelled sentences for fitting: invented persons in invented sentences, with what only looks like them.

Spans between {} are filled; those of the five kinds are the labels. Nothing here is taken from
documents: names combine the lexicon's parts, numbers are random.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

# sentence frames by what they hold; the filler's name is between braces
FRAMES = [
    "The lead author is {name}.", "Questions go to {name}, who keeps the ledger.", "{name} wrote the second section.", "{name} re-ran the model on Monday.", "Reviewed by {name} and a colleague.",
    "Corresponding author: {name}.", "Screened independently by {name} and one other.", "Thanks to {name} for the figures.", "The third reader was {name}, who rated half of them.", "Next of kin is {name} (brother).",
    "Dr. {name} re-ran the test.", "Prof. {name} agreed.", "Frau {name} hat die Liste geprüft.", "Herr {name} hat zugestimmt.", "Ansprechperson: {name}.", "Zweitprüfung durch {name}.", "Mme {name} a signé la liste.", "M. {name} a validé le plan.", "Relu par {name}.",
    "Auteur correspondant : {name}.", "Revisado por {name}.", "Persona de contacto: {name}.", "Sra. {name} firmó.", "Best wishes,\n{name}\nData Unit\n{email}\n{phone}\n{address}\n", "Mit freundlichen Grüßen\n{name}\n", "Cordialement,\n{name}", "Un saludo,\n{name}\nReview Unit\n{phone}",
    "{name} | Data Unit | {email} | {phone} | {address}", "{name} · Review Unit · {email} · T: {phone} · {address}", "contact={name};mail={email};tel={phone}", "{name} | Statistics Team | {email}", "{name} · Data Unit · {email} · {address}",
    "Write to {email} for access.", "Contact <{email}> first.", "mailto:{email} was in the header.", "cc: {email}; nobody else", "(e-mail: {email})", "E-Mail: {email}", "Rückfragen an {email}.", "Écrire à {email}.", "Escriba a {email}.", "Send it to {email}.", "{email} answers fast.", "邮箱：{email}", "请发送至{email}。",
    "Call {phone} before noon.", "Text {phone} to leave.", "The hotline is {phone}, weekdays only.", "Reached the subject at {phone} twice.", "Tel. {phone}", "Tel {phone}", "T: {phone}", "fax/phone: {phone};", "Telefon: {phone}", "Erreichbar unter {phone}.", "Rückruf an {phone}, werktags.", "Tél. : {phone}", "Joindre le bureau au {phone}.", "Teléfono: {phone}", "Llame al {phone}.", "电话：{phone}。", "请拨打{phone}联系。", "\n{phone}\n",
    "SSN {identity} was visible.", "Passport: {identity}.", "(national ID {identity})", "ORCID iD {identity}", "Identity no. {identity} must stay private.", "The form shows {identity} as the personal number.", "{identity} must not be shared.", "Steuer-ID {identity} im Anhang.", "Ausweisnummer: {identity}.", "Personenkennzahl {identity} schwärzen.", "N° de sécurité sociale {identity} lisible.", "Identifiant personnel : {identity}", "DNI {identity} visible.", "Pasaporte: {identity}.", "身份证号{identity}未遮盖。", "证件号码：{identity}。",
    "The subject lives at {address}.", "Kits were mailed to {address}, not to us.", "Parcels go to {address}.", "Site address: {address}", "Visit 3 took place at {address} as agreed.", "Anschrift: {address}.", "Proben bitte an {address} senden.", "Die Person wohnt in der {address}.", "Adresse : {address}.", "Les kits vont au {address}.", "Dirección: {address}.", "La participante vive en {address}.", "地址：{address}。", "受试者住在{address}。", "\n{address}\n",
    "第一评审人为{han}，已签字。", "通讯作者：{han}。", "感谢{han}提供数据。", "{han} | Data Unit | {email} | {phone} | {hanaddress}", "contact={han};mail={email};tel={phone}", "\n{han}\nReview Unit\n{email}\n", "{han} · Data Unit · {email}", "没有变化。{han}\nStatistics Team\n",
    # what only looks like persons, numbers and places
    "Statistical Analysis Plan, Section {small}.", "Primary Outcome and Safety Report were filed by Data Monitoring.", "Author Contributions: drafting and review.", "Data Availability Statement follows Table {small}.", "Signed Informed Consent was kept.", "Main Results by Treatment Arm.", "Thanks to Open Science for hosting.", "{unknown} {unknown} Scale, version {small}.", "The {unknown} {unknown} method was used.", "Model {unknown} {unknown} et al. ({year})", "Reviewed by Quality Assurance.", "University Hospital {unknown} took part.", "{unknown} County General Hospital", "Auswertung Gruppe Placebo: {small} Fälle.", "Im Abschnitt Methoden steht Tabelle {small}.", "Geprüft durch Interne Revision.", "Analyse Principale, Tableau {small}.", "Plan de Análisis Estadístico, versión {small}.", "The rise was seen in condition {letter}. {unknown} ({small} draws) agreed.", "Pas d'effet dans la condition {letter}. Écrire à {email}.", "Sin efecto en la condición {letter}. Escriba a {email}.", "Kein Effekt in Gruppe {letter}. Auswertung folgt.", "see group {letter}. Resampling ({small}0 draws) helped.", "Review Comments", "Reading Time {small} Minutes", "Kaplan Meier Curves and Cox Regression", "Adverse Events Grade {small}", "Version Control System", "Baseline Characteristics",
    "The {family} index and the {family}–{family} scale were used ({family} et al., {year}).", "See {family} & {family} ({year}) and [@{lower}{year}; @{lower}20a].", "Der {family}-Index nach {family} und {family} ({year}) fehlt.", "L'échelle {family}–{family} ({family} et coll., {year}) manque.", "La escala {family}–{family} ({family} y cols., {year}) no sirve.", "{family}指数（{family} 等，{year}）未用。",
    "Readings at the {word} {word} site and along {word} {word} were averaged.", "{word} {word} {small} lists the lines, and {word} {word} notes follow in Appendix {small}.", "{small} Street segments and {small} Road crossings were in the Main Street set.", "Das {family} {word} Modell.", "The {word} {word} data were kept.",
    "Sample lot {lot} was thawed; batch {lot} was lost.", "Lot {lot}, voir la rue témoin.", "Lote {lot}; la calle es ficticia.", "批号{lot}，见第{small}节。", "The range {small}-{small}0 and the interval {date} 10:{small}0:00 are in UTC.", "Archived on {date} with (state {digits8}).", "doi:10.5555/{lower}.{small}.{digits6} has ISSN-like code {issn}.", "Trial TRL-{digits8} is under protocol 41.{small}.4{small}.", "Checksum {digits14} = {digits7}; accession QX_{digits8}.", "Install pkg@7.{small}.0 and rerun @{small} on branch main@{{1}}.",
    "1234567890123456789012345678901234567890 3.14159", "We compared B and D (p = 0.{digits3}; n = {small}7).", "From {small}.1 to {small}.9 in {digits4} of {digits5} rows.", "共有{digits4}名受试者，其中{small}名缺少。", "Abschnitt {small}.1, Zeile {small}: siehe Hauptstraße-Datensatz.", "在修订之后，探索性的快照没有变化。", "No phone or email is given.", "表{small}列出了各组；图{small}给出要点。",
]

_PLACES = ["ford", "vik", "mere", "holm", "ati", "stad", "ton"]
_HAN_GIVEN = "蔚珩绪砚歌岚澄舟芷屿宁远安"
_HAN_PLACE = "澹沅枢銮黛霁岫昶珩砚芷屿"


class Filler:
    def __init__(self, lexicon: dict[str, str], rnd: random.Random):
        self.r = rnd
        latin = [t for t in lexicon if len(t) > 1]
        low = [t.lower() for t in latin]
        cuts = [(t[:i], t[i:]) for t in low for i in range(2, len(t) - 1)]
        count = lambda xs: {x for x in set(xs) if xs.count(x) >= 3}
        heads, tails = count([h for h, _ in cuts]), count([t for _, t in cuts])
        like = lambda t: any(t[:i] in heads and t[i:] in tails for i in range(2, len(t) - 1))
        self.heads, self.tails = heads, tails
        self.odd = [t for t in latin if not like(t.lower())] or ["Field"]
        self.given = [t for t in latin if lexicon[t] == "given" and like(t.lower())] or ["Anna"]
        self.family_names = [t for t in latin if lexicon[t] != "given" and like(t.lower())] or ["Meyer"]
        self.han_names = [t for t in lexicon if len(t) == 1] or ["昶"]

    def _new(self, names: list[str]) -> str:
        """A name of the list, or one put together from two of them, which the list needn't hold."""
        a, b = self.r.choice(names), self.r.choice(names)
        if self.r.random() < 0.6 or a[:3] == b[:3]:
            return a
        i = self.r.choice([i for i in range(2, len(a) - 1) if a[:i].lower() in self.heads] or [3])
        j = self.r.choice([j for j in range(2, len(b) - 1) if b[j:] in self.tails] or [3])
        return a[:i] + b[j:]

    def g(self) -> str:
        return self.r.choice(self.odd) if self.r.random() < 0.25 else self._new(self.given)

    def f(self) -> str:
        return self.r.choice(self.odd) if self.r.random() < 0.25 else self._new(self.family_names)

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def unknown(self) -> str:
        """A word that no list holds: two or three random syllables."""
        r = self.r
        s = "".join(r.choice(("b", "br", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "r", "s", "sch", "st", "t", "tr", "v", "w", "z")) + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "l", "lf", "ng", "tz", "m")) for _ in range(r.randint(2, 3)))
        return s.capitalize()

    def name(self) -> str:
        r = self.r
        k = r.random()
        i = lambda: r.choice("ABCDEFGHJKLMNPRSTVWY") + "."
        new = r.random()
        if new < 0.2:
            fam = self.unknown()
            return f"{self.unknown() if new < 0.15 else self.g()} {fam}"
        if new < 0.24:
            return " ".join(self.g() if r.random() < 0.5 else self.f() for _ in range(r.choice((3, 4, 5))))
        fam = self.f()
        if r.random() < 0.15:
            fam = f"{fam}-{self.f()}"
        if r.random() < 0.12:
            fam = r.choice(("von ", "van der ", "de la ", "Mac ", "al-", "di ")) + fam
        giv = self.g()
        if r.random() < 0.12:
            giv = f"{giv}-{self.g()}"
        s = f"{giv} {fam}" if k < 0.5 else f"{giv} {i()} {fam}" if k < 0.65 else f"{i()} {fam}" if k < 0.75 else f"{i()} {i()} {fam}" if k < 0.84 else f"{fam}, {giv}"
        if r.random() < 0.07:
            s = s.upper()
        elif r.random() < 0.06 and "." not in s:
            s = s.lower()
        return s

    def email(self) -> str:
        r = self.r
        a, b = self.g().lower(), self.f().lower()
        a, b = (re.sub(r"[^a-z]", "", x) or "x" for x in (a, b))
        local = r.choice((f"{a}.{b}", f"{a}_{b}{self.d(2)}", f"{a}-{b}", f"{b}+review{self.d(1)}", f"{a[0]}{b}", f"{b}.{a[0]}.{self.d(3)}"))
        dom = r.choice((["example", "org"], ["lab", "example"], ["mail", "uni", "test"], ["stat", b, "example"], ["corp", "invalid"], ["example", "com"]))
        k = r.random()
        s = f"{local}@{'.'.join(dom)}" if k < 0.6 else f"{local}＠{'.'.join(dom)}" if k < 0.68 else f"{local} [at] {'.'.join(dom)}" if k < 0.78 else f"{local} (at) {' (dot) '.join(dom)}" if k < 0.9 else f"{local} AT {' DOT '.join(dom)}"
        return s.upper() if r.random() < 0.05 and "@" in s else s

    def phone(self) -> str:
        d, r = self.d, self.r
        e = f"01{d(1)}"
        s = r.choice((f"+1 555 {e} {d(4)}", f"+1-555-{e}-{d(4)}", f"+1 (555) {e}-{d(4)}", f"(555) {e}-{d(4)}", f"555-{e}-{d(4)}", f"555.{e}.{d(4)}", f"555{e}{d(4)}", f"001 555 {e} {d(4)}", f"+44 20 7946 {d(4)}", f"+44 (0)20 7946 {d(4)}", f"020 7946 {d(4)}", f"0049 30 23125{d(3)}", f"+49 30 23125 {d(3)}", f"(030) 23125 {d(3)}", f"030/23125-{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"(+34) 555{d(6)}", f"555 {d(3)} {d(3)}", f"+34 555 {d(2)} {d(2)} {d(2)}", f"0555-{d(7)}", f"+86 555 {d(7)}"))
        return s.translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789"}) if r.random() < 0.03 else s

    def identity(self) -> str:
        d, r = self.d, self.r
        return r.choice((f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}", f"0009-99{d(2)}-{d(4)}-{d(4)}", f"0009-99{d(2)}-{d(4)}-{d(3)}X", f"QQ {d(2)} {d(2)} {d(2)} C", f"QQ{d(6)}{r.choice('ABCD')}", f"XZ{d(7)}", f"XQ{d(7)}", f"LZ{d(6)}X{d(1)}", f"00{d(9)}", f"00 {d(3)} {d(3)} {d(3)}", f"{r.choice('12')} {d(2)} 13 99 {d(3)} {d(3)} {d(2)}", f"1{d(2)}1399{d(8)}", f"999999{r.choice(('19', '20'))}{d(10)}", f"00{d(6)}{r.choice('TRWGF')}", f"00{d(6)}-{r.choice('TRWGF')}", f"Z-00{d(5)}-P", f"00ZZ{d(5)}"))

    def city(self) -> str:
        return self._new(self.family_names) if self.r.random() < 0.5 else self.r.choice(self.family_names)[:4] + self.r.choice(_PLACES)

    def address(self) -> str:
        r, d = self.r, self.d
        n, s, c = str(r.randint(1, 399)), self.city(), self.city()
        k = r.random()
        if k < 0.5:
            street = f"{n}{r.choice(('', '', '', 'a', 'B'))} {s} {r.choice(('St.', 'Street', 'Rd', 'Road', 'Lane', 'Ave', 'Avenue', 'Way', 'Blvd', 'Court'))}"
            j = r.random()
            if r.random() < 0.06:
                street = f"{n} {r.choice('NESW')}. {s} {r.choice(('Court', 'Ave', 'Lane'))}"
            return street.upper() if j < 0.03 else street if j < 0.25 else f"{street}, {c}, QX 9{d(4)}" if j < 0.5 else f"{street}, Apt {d(1)}B, {c}, QX 9{d(4)}" if j < 0.7 else f"Flat {d(1)}, {street}, {c} QX{d(1)} {d(1)}ZZ" if j < 0.85 else f"{street}\n{c}\nQX{d(1)} {d(1)}ZZ"
        if k < 0.68:
            street = r.choice((f"{s}straße {n}", f"{s}str. {n}a", f"{s}weg {n}", f"Am {s}platz {n}"))
            return f"{street}, {r.choice(('', 'D-'))}00{d(3)} {c}" if r.random() < 0.6 else street
        if k < 0.84:
            street = r.choice((f"{n}, rue de {s}", f"{n} boulevard {s}", f"{n} bis, avenue {s}"))
            return f"{street}, 99{d(3)} {c}" if r.random() < 0.6 else street
        street = r.choice((f"Calle {s} {n}", f"Avenida de {s}, n.º {n}", f"C/ {s}, {n}, 3.º B"))
        return f"{street}, 99{d(3)} {c}" if r.random() < 0.6 else street

    def hanaddress(self) -> str:
        p = lambda n: "".join(self.r.choice(_HAN_PLACE) for _ in range(n))
        n = self.r.randint(1, 399)
        return f"{p(2)}市{p(1)}水区{p(1)}石路{n}号" if self.r.random() < 0.5 else f"{p(2)}市{p(1)}桥街{n}号{self.d(1)}栋{self.d(3)}室"

    def han(self) -> str:
        return self.r.choice(self.han_names if self.r.random() < 0.5 else _HAN_PLACE) + "".join(self.r.choice(_HAN_GIVEN) for _ in range(self.r.choice((1, 2, 2))))

    def fill(self, what: str) -> tuple[str, str]:
        """The text and its kind ('' for what is no personal information)."""
        r = self.r
        if what in ("name", "email", "phone", "identity", "address"):
            return getattr(self, what)(), what
        if what == "han":
            return self.han(), "name"
        if what == "hanaddress":
            return self.hanaddress(), "address"
        if what.startswith("digits"):
            return self.d(int(what[6:])), ""
        return {"family": self.f, "unknown": self.unknown, "lower": lambda: re.sub(r"[^a-z]", "", self.f().lower()) or "x", "word": lambda: r.choice(self.odd), "letter": lambda: r.choice("ABCDEFGH"), "small": lambda: str(r.randint(1, 29)), "year": lambda: str(r.randint(2008, 2025)), "lot": lambda: f"{r.choice(('9', '5'))}{self.d(2)}-{self.d(r.choice((1, 2)))}-{self.d(4)}", "date": lambda: f"20{self.d(2)}-0{r.randint(1, 9)}-1{self.d(1)}", "issn": lambda: f"9{self.d(3)}-{self.d(4)}"}[what](), ""


def generate(lexicon: dict[str, str], sentences: int, seed: int) -> Iterator[tuple[str, set[tuple[int, int, str]]]]:
    """Texts of one to three sentences with their labelled spans."""
    rnd = random.Random(seed)
    fill = Filler(lexicon, rnd)
    han = [f for f in FRAMES if re.search("[一-鿿]", f)]
    done = 0
    while done < sentences:
        text, gold = "", set()
        for _ in range(rnd.randint(1, 3)):
            frame = rnd.choice(han if rnd.random() < 0.15 else FRAMES)
            if text:
                text += rnd.choice((" ", " ", "\n", "" if text[-1] in "。，；" else " "))
            pos = 0
            for m in re.finditer(r"\{(\w+)\}", frame):
                if frame[m.start() - 1 : m.start()] == "{":
                    continue
                text += frame[pos : m.start()]
                what = "hanaddress" if m[1] == "address" and frame in han and rnd.random() < 0.9 else m[1]
                s, kind = fill.fill(what)
                if kind:
                    gold.add((len(text), len(text) + len(s), kind))
                text += s
                pos = m.end()
            text += frame[pos:].replace("{{", "{").replace("}}", "}")
            done += 1
        # a dot that ends both an abbreviation and the sentence is written once
        if ".." not in text:
            yield text, gold
