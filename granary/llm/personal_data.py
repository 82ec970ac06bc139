"""Personal data in free text: finding it and replacing it.

Detection is anchored on what is rare: ``@`` and its substitutes, groups of digits, street
words, family names, and given names or titles before a capitalised word. Family names of the list are
taken apart into stems and endings, so that unlisted combinations are recognised in any case too.

Replacement is keyed and consistent over the corpus: equal entities get equal surrogates,
different ones different surrogates, none that of an original (collisions are found by a join over all
entities and re-keyed), and a surrogate keeps its original's type, script, gender, case and format. A person's
given and family name are entities of their own, and initials follow a keyed permutation of the
alphabet: "A. Smith" stays the initial of what "Anna Smith" becomes. Telephone numbers are
compared in international form and keep their country code.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import materialize

KINDS = ("email", "phone", "id_number", "address", "person")

# E-mail addresses: the anchor is ``@`` or a substitute; dots have substitutes too.
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\}|\[punto\]|\(punto\)|\[punkt\]|\(punkt\))\s?)"
_EMAIL = re.compile(
    rf"(?<![\w.+-])\w[\w.+%-]*(?:(?:@|\s@\s|\s?[\[({{<](?:at|arroba)[\])}}>]\s?)[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w-])"
    r"|\sat\s[\w-]+(?:\sdot\s[\w-]+)*\sdot\s[^\W\d_]{2,}(?!\w))",
    re.I,
)
_EMAIL_ANCHORS = ("@", "(at)", "[at]", "{at}", "<at>", "arroba", " dot ")

_S = r"[ \u00a0\u202f\t\n]"
#: Digits enough for a telephone number or an identity number, with what may part them.
_DIGITS = re.compile(r"\d(?:[-/.() \u00a0\u202f\t\n]{0,3}\d){5,}")
_PHONE = re.compile(
    rf"""(?:
    (?:\(\+1\)|\+1|001)[-.]?{_S}?\(?\d{{3}}\)?[-.]?{_S}?\d{{3}}[-.]?{_S}?\d{{4}}
    |(?:\(\+44\)|\+44|0044){_S}?(?:\(0\))?{_S}?\d{{4}}{_S}?\d{{3}}{_S}?\d{{3}}
    |(?:\(\+49\)|\+49|0049){_S}?(?:\(0\))?{_S}?\d{{2}}{_S}?[-/]?{_S}?\d{{5}}[-]?{_S}?\d{{3}}
    |(?:\(\+33\)|\+33|0033)[-.]?{_S}?(?:\(0\))?{_S}?\d(?:[-.]?{_S}?\d\d){{4}}
    |(?:\(\+34\)|\+34|0034)[-.]?{_S}?\d{{3}}(?:[-.]?{_S}?\d\d){{3}}
    |(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00[1-9]\d)(?:[ \t]?\(0\))?(?:[ \t]?[-./]?[ \t]?(?:\(\d+\)|\d+)){{1,6}}
    |\(0?\d{{2,4}}\){_S}?\d{{3,8}}(?:[-{_S[1:-1]}]\d{{2,4}})?
    |1-\d{{3}}-\d{{3}}-\d{{4}}
    |\d{{3}}([-.]|{_S})\d{{3}}\1\d{{4}}
    |0[1-9]\d{{2,3}}{_S}\d{{3}}{_S}?\d{{3}}
    |0[1-9]\d{{1,3}}{_S}?/?{_S}?\d{{4,6}}(?:[-{_S[1:-1]}]\d{{2,4}})
    |0\d(?:\.\d\d){{4}}|0\d(?:{_S}\d\d){{4}}|0\d(?:-\d\d){{4}}
    |\d{{3}}(?:(?:{_S}\d\d){{3}}|(?:-\d\d){{3}})
    )(?![\w])(?![-./,]\d)""",
    re.X,
)

# Numbers of personal records. Shapes that only such records have need no label.
_ID_SHAPE = r"[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]|\d{3}-\d\d-\d{4}|\d{3}\s\d\d\s\d{4}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"
_ID_LABELLED = (
    rf"{_ID_SHAPE}|[A-Z]\d\d[A-Z]\d{{5}}|[A-Z]{{1,3}}\d{{6,9}}[A-Z]?|\d\d\s\d{{3}}\s\d{{3}}\s\d{{3}}|\d{{3}}\s\d{{3}}\s\d{{5}}|\d{{11}}|\d\d[A-Z]{{2}}\d{{5}}"
    r"|\d\s\d\d\s\d\d\s\d\w\s\d{3}\s\d{3}(?:\s\d\d)?|\d{3}[\s.-]\d{3}[\s.-]\d{3}(?:-?\d\d)?|\d{12,15}|[A-Z0-9]{9}"
)
_ID_LABEL = (
    r"passport(?:\s+(?:no\.?|number|nr\.?))?|(?:driving\s+)?licen[cs]e(?:\s+(?:no\.?|number))?|social\s+security\s+(?:number|no\.?)|national\s+insurance\s+(?:number|no\.?)"
    r"|\bID(?:\s+(?:is|card|number|no\.?))+|tax\s+(?:id|number|no\.?)|insurance\s+(?:number|no\.?)|identity\s+(?:card|number)"
    r"|personalausweis(?:nummer)?|ausweisnummer|ausweis(?:-nr\.?|\s+nr\.?)|reisepass(?:nummer)?|steuer-?\s?(?:id|nummer)|sozialversicherungsnummer|f[üu]hrerschein(?:nummer)?|versichertennummer"
    r"|pi[èe]ce\s+d['’]identit[ée]|carte\s+d['’]identit[ée]|passeport|permis\s+de\s+conduire|s[ée]curit[ée]\s+sociale|num[ée]ro\s+fiscal"
    r"|\bCNI|\bSIN|\bSSN|\bBSN|\bCPF|\bPESEL|\bDNI|\bNIE|\bNIF|documento\s+de\s+identidad|pasaporte|seguridad\s+social|permiso\s+de\s+conducir"
)
_ID_BY_LABEL = re.compile(rf"(?:{_ID_LABEL})(?:\s+(?:n\.?[°ºo]\.?|nr\.?|no\.?|num\w*|number|is|ist|est|es))?\s*[:#]?\s*((?-i:{_ID_LABELLED}))(?![\w-])", re.I)
#: In lower case, one of these is in every text that has a label.
_ID_ANCHORS = ("passp", "licen", "security", "insurance", "id is", "id card", "id n", "tax ", "identi", "nummer", "ausweis", "reisepass", "steuer", "permis", "fiscal", "sociale", "cni ", "cni:", "sin ", "sin:", "ssn ", "ssn:", "bsn ", "bsn:", "cpf ", "cpf:", "pesel", "dni ", "dni:", "nie ", "nif ", "pasaporte", "seguridad")
_ID_BY_SHAPE = re.compile(rf"(?<![\w-])(?<!\d[ .,/])(?:{_ID_SHAPE})(?![\w-])(?!\s\d)")
#: After one of these, seven to fifteen digits are a telephone number whatever their grouping.
_PHONE_BY_LABEL = re.compile(r"(?:phone|telephone|tel|mobile|cell|whatsapp|fax|telefon|handy|mobil|téléphone|teléfono|móvil|portable)(?:\s+(?:no\.?|number|nr\.?|is))?\s*[.:]*\s*([+(]{0,2}\d(?:[-/.() ]{0,2}\d){6,14})(?![\w])(?![-./,]\d)", re.I)
_PHONE_LABELS = ("phone", "tel", "mobil", "cell", "whatsapp", "fax", "handy", "téléphone", "teléfono", "móvil", "portable")
#: One record to a line, parts by semicolons: the part after the name.
_ID_IN_RECORD = re.compile(rf";\s?({_ID_LABELLED})\s?;")

_STREETS_EN = "street st road rd avenue ave lane ln court ct close terrace drive dr way row crescent square mews parade boulevard blvd place hill".split()
_STREET_EN = "|".join(f"{w.capitalize()}|{w.upper()}" for w in _STREETS_EN)
_STREET_FR = "rue|quai|avenue|av\\.|boulevard|bd\\.?|place|impasse|chemin|all[ée]e|cours|square|passage|ruelle|promenade"
_OF_FR = rf"(?:d[eu]s?{_S}(?:la{_S}|l['’])?|d['’]|l['’])?"
_CAPITAL = r"[^\W\d_a-zà-öø-ÿß][\w'’-]*"
_TOWN = rf"(?:,?{_S}Apt\.?{_S}\d+)?(?:{_S}?[,–-]?{_S}(?:D-)?\d{{5}}{_S}{_CAPITAL}|{_S}?[,–-]?{_S}{_CAPITAL},?{_S}[A-Z]{{2}}\d?{_S}\d\w{{2,4}}|,{_S}{_CAPITAL}(?=[,.;|\n\"]|$))?"
_ADDRESS_BY_NUMBER = re.compile(
    rf"\d(?<![\w.,:/-]\d)(?<!\d[ ,.]\d)\d{{0,3}}(?:{_S}?[A-Za-z]?(?:{_S}{_CAPITAL}){{1,3}}?{_S}(?:{_STREET_EN})\b(?:\.(?={_S}?[,\n–-]|{_S}Apt))?"
    rf"|(?:{_S}?(?:bis|ter|quater|[A-Da-d]))?,?{_S}(?:(?i:{_STREET_FR})){_S}{_OF_FR}{_CAPITAL}(?:[ \u00a0]{_CAPITAL})?){_TOWN}"
)
_ADDRESS_DE = re.compile(
    rf"[A-ZÄÖÜ](?<![\w-].)(?:[\wäöüß-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|chaussee|steig|pfad|ring|markt|kai|STRASSE|WEG|GASSE|PLATZ|ALLEE)"
    rf"|(?:(?<=A)m|(?<=A)n{_S}der|(?<=Z)um|(?<=Z)ur|(?<=I)m|(?<=I)n{_S}der|(?<=A)uf{_S}dem|(?<=A)lte[rs]?|(?<=N)eue[rs]?){_S}[A-ZÄÖÜ][\wäöüß-]+){_S}\d{{1,4}}(?:{_S}?[a-z]\b)?(?![.:/-]\d|\w){_TOWN}"
)
_ADDRESS_DE_ANCHORS = ("stra", "str.", "weg ", "gasse", "platz", "allee", "ufer", "damm", "chaussee", "steig", "pfad", "ring ", "markt", "kai ", "am ", "an der", "zum ", "zur ", "in der", "auf dem", "alte", "neue")
_ADDRESS_ES = re.compile(
    rf"[CcAaPpRrTtG](?<![\w/].)(?:(?<=[Cc])alle|(?<=[Cc])/|(?<=[Aa])venida|(?<=[Aa])vda?\.|(?<=[Pp])aseo|(?<=[Pp])laza|(?<=[Cc])amino|(?<=[Cc])arretera|(?<=[Rr])onda|(?<=[Tt])raves[íi]a|(?<=G)lorieta){_S}?(?:(?:del?(?:{_S}l[ao]s?)?|l[ao]s?|el){_S})?"
    rf"{_CAPITAL}(?:{_S}{_CAPITAL}){{0,2}},?(?:{_S}n\.?{_S}?[ºo°]\.?|{_S}n[úu]m\.?)?{_S}?\d{{1,4}}(?![.:/-]\d|\w){_TOWN}"
)
_ADDRESS_ES_ANCHORS = ("calle", "c/", "aven", "avda", "av.", "paseo", "plaza", "camino", "carretera", "ronda", "traves", "glorieta")
_ADDRESS_FR = re.compile(rf"(?<![\w-])(?:rue|quai|avenue|boulevard|impasse|chemin){_S}{_OF_FR}{_CAPITAL},?{_S}(?:n[°º]{_S}?)?\d{{1,4}}(?![.:/-]\d|\w)", re.I)
_ADDRESS_FR_ANCHORS = ("rue ", "quai ", "avenue ", "boulevard ", "impasse ", "chemin ")

#: Words before a family name that are no given name, in lower case.
NO_GIVEN = set(
    "the a an and or of by to from with for at on in is der die das dem den und von an bei mit für el la los las y e o de del le les l et du des par avec un una une "
    "ms mr mrs miss dr prof sir madam frau herr herrn hr fr señora señor señorita sra sr srta don doña madame monsieur mme mlle mrs "
    "kollege kollegin colleague holder besucher besucherin visitor visiteur visitante name nom nombre contact contacto kontakt from to cc taken absent forwarded "
    "hi hello hey hallo hola bonjour ask here hier ici soy regards grüßen gruß saludo saludos cordialement my mein mi mon ist est es "
    "ansprechpartner rückfragen captain kapitän capitaine capitán badge licence reporter".split()
)
#: Words before a name that make it the name of a vessel, station or product.
VESSELS = set(
    "tug hauler tender ship vessel freighter shuttle barge ferry tanker lighter cutter boat schlepper frachter fähre schiff tanker kutter barkasse leichter "
    "remorqueur navire cargo bateau vedette barge remolcador buque barco carguero nave lancha station dock ring".split()
)


class Names:
    """Known given names, and family names with the stems and endings they are made of."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.given = {n.lower() for n, kind in rows if kind == "given"}
        family = sorted({n.lower() for n, kind in rows if kind == "family"})
        heads, tails = Counter(), Counter()
        for n in family:
            for i in range(3, len(n) - 2):
                heads[n[:i]] += 1
                tails[n[i:]] += 1
        stems, ends = Counter(), Counter()
        for n in family:
            cut = max(range(3, len(n) - 2), key=lambda i: (heads[n[:i]] * tails[n[i:]], i), default=None)
            if cut and heads[n[:cut]] > 2 and tails[n[cut:]] > 2:
                stems[n[:cut]] += 1
                ends[n[cut:]] += 1
        self.stems = {s for s, k in stems.items() if k > 1}
        self.ends = {e for e, k in ends.items() if k > 1}
        self.family = set(family)
        # Search needles: stems, and the names that no stem begins.
        self.needles = sorted(self.stems | {n for n in family if not any(n.startswith(s) for s in self.stems)})

    def is_family(self, word: str) -> bool:
        word = word.lower()
        return word in self.family or any(word.startswith(s) and word[len(s) :] in self.ends for s in self.stems)


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LEFT = re.compile(r"(?:((?<!\w)[^\W\d_]+(?:-[^\W\d_]+)?)(\s+))?(?:(?<!\w)([^\W\d_])\.(\s*))?$")
_RIGHT = re.compile(r",\s+([^\W\d_]\.|[^\W\d_]+(?:-[^\W\d_]+)?)(?![\w@]|[.+_-]\w)")


def _persons(text: str, low: str, names: Names, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """``(start, end, canonical)`` of each name of a person."""
    spots = set()
    for needle in names.needles:
        at = low.find(needle)
        while at >= 0:
            spots.add(at)
            at = low.find(needle, at + 1)
    done = 0
    for at in sorted(spots):
        if at < done or at and (text[at - 1].isalnum() or text[at - 1] in "._+@-%"):
            continue
        m = _WORD.match(text, at)
        if not m or not names.is_family(m[0]):
            continue
        end = m.end()
        family_end = end
        if text[end : end + 1] == "-" and (m2 := _WORD.match(text, end + 1)) and names.is_family(m2[0]):
            end = family_end = m2.end()
        after = text[end : end + 1]
        if after and (after in "_@+" or after in ".-" and text[end + 1 : end + 2].isalnum() or after.isalnum()):
            continue
        if any(a <= at < b for a, b in taken):
            continue
        left = _LEFT.search(text[max(0, at - 60) : at]) if at and text[at - 1].isspace() else None
        base = max(0, at - 60)
        first, initial = (left[1], left[3]) if left else (None, None)
        if first and len(first) == 1:
            first = None
        right = _RIGHT.match(text, end)
        given = right[1] if right else None
        if given and not (given.lower().rstrip(".") in names.given or given[0].isupper() and given.lower() not in NO_GIVEN and not names.is_family(given)):
            given = None
        start = None
        if first and first.lower() in names.given:
            start, called = base + left.start(1), first
        elif given and (given.lower() in names.given or not initial or initial.upper() == "M"):
            start, end, called = at, right.end(1), given
        elif first and first.lower() not in NO_GIVEN and first.lower() not in VESSELS and len(first) > 1 and (first[0].isupper() or text[at].islower()) and not (initial and initial.upper() == "M" and first[0].islower()):
            start, called = base + left.start(1), first
            if initial and "\n" in left[2]:
                start, called = base + left.start(3), initial
            elif first[0].islower() and initial:
                start, called = base + left.start(3), initial
        elif initial and initial.isupper():
            start, called = base + left.start(3), initial
        if start is None:
            continue
        if any(a <= start < b for a, b in taken):
            continue
        before = re.search(r"([^\W\d_]+)\W{1,3}$", text[max(0, start - 25) : start])
        if before and before[1].lower() in VESSELS and not re.search(r"[.!?:;,\n]\W*$", text[max(0, start - 25) : start]):
            done = end
            continue
        done = end
        yield start, end, f"{_fold(called).rstrip('.')} {_fold(text[at:family_end])}"


#: Two or three words with capitals, the middle one an initial if there is one; Latin, Greek and Cyrillic.
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĀŁŚŠŻŽΑ-ΩА-ЯЁ", "a-zß-öø-ÿāąćčęěłńňřśšůźżžΆ-ώа-яё"
_PAIR = re.compile(rf"([{_UPPER}](?<![\w@.+-].)[{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)?)[ \t]+(?:[{_UPPER}]\.[ \t]*)?((?:(?:van|von|de|del|della|di|da|le|la|al|el|bin|ben)[ \t]+)?(?:[OD]['’]|M[a]?c)?[{_UPPER}][{_LOWER}]+(?:[-'’][{_UPPER}][{_LOWER}]+)*)(?![\w@]|[.+_-]\w)")
#: Titles by gender; a capitalised pair after one is a person's name.
_TITLES = {"mr": "m", "mister": "m", "sir": "m", "herr": "m", "herrn": "m", "hr": "m", "señor": "m", "sr": "m", "don": "m", "monsieur": "m",
           "ms": "f", "mrs": "f", "miss": "f", "madam": "f", "frau": "f", "fr": "f", "señora": "f", "señorita": "f", "sra": "f", "srta": "f", "doña": "f", "madame": "f", "mme": "f", "mlle": "f",
           "dr": "", "prof": ""}
_BEFORE = re.compile(r"([^\W\d_]+)\.?\s+$")


def _pairs(text: str, names: Names, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Persons outside of the list: a known given name, or any after a title, before a capitalised word."""
    at = 0
    while m := _PAIR.search(text, at):
        first, family = m[1], m[2]
        at = m.end()
        if first.lower() in _TITLES:  # the name comes behind it
            at = m.end(1)
            continue
        given, low = _fold(first), first.lower()
        known = low in names.given or given in _FEMALE or given in _MALE
        space = text[m.start() - 1 : m.start()].isspace()
        before = _BEFORE.search(text[max(0, m.start() - 25) : m.start()]) if space else None
        word = before[1].lower() if before else ""
        if not known and (len(word) < 2 or word not in _TITLES) or word in VESSELS or low in NO_GIVEN or low in VESSELS:
            continue
        if family.lower() in names.given or family.lower() in NO_GIVEN or _place(family) or names.is_family(family):
            continue
        if not any(a < m.end() and m.start() < b for a, b in taken):
            yield m.start(), m.end(), f"{given} {_fold(family)}"


def _place(word: str) -> bool:
    """Whether a word is one of those that name streets and stations."""
    return bool(re.fullmatch(rf"(?:{_STREET_EN}|{_STREET_FR}|Station|Dock|Ring|Bay|Port|Harbou?r|Pier|Clamp|Valve)", word, re.I))


def _titled(text: str, start: int) -> str:
    """The gender that a title before a name tells, if one does."""
    m = _BEFORE.search(text[max(0, start - 15) : start])
    return _TITLES.get(m[1].lower(), "") if m else ""


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


#: Country codes of one and two digits (fixed values of the public numbering plan); all others have three.
_COUNTRY = frozenset(
    """
    1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49
    51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86
    90 91 92 93 94 95 98
    """.split()
)


def phone_number(surface: str) -> str:
    """``country:number`` without trunk digit; the country of a national number follows from its grouping, if at all."""
    digits = re.sub(r"\D", "", surface)
    if surface.lstrip("( ").startswith("+") or digits.startswith("00"):
        digits = digits.removeprefix("00") if not surface.lstrip("( ").startswith("+") else digits
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _COUNTRY), digits[:3])
        return f"{code}:{digits[len(code):].removeprefix('0')}"
    if digits.startswith("0"):
        pairs = re.search(r"0\d(?:[^\d]\d\d){4}$", surface)
        code = "33" if pairs else "44" if re.search(r"0\d{4}\s\d{3}\s?\d{3}$", surface) else "49"
        return f"{code}:{digits[1:]}"
    if len(digits) == 11 and digits.startswith("1"):
        return f"1:{digits[1:]}"
    return f"{'1' if len(digits) == 10 else '34' if len(digits) == 9 else ''}:{digits}"


def mentions(text: str, names: Names) -> list[tuple[str, int, int, str, str]]:
    """``(kind, start, end, canonical, gender)`` of all personal data in a text, in order, not overlapping.

    ``canonical`` is equal for mentions of one entity: an initial stands for the given name where one person of the family
    in the text has it; ``gender`` is what a title says, for persons.
    """
    out: list[tuple[str, int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, start: int, end: int, canonical: str) -> None:
        if not any(a < end and start < b for a, b in taken):
            taken.append((start, end))
            out.append((kind, start, end, canonical, _titled(text, start) if kind == "person" else ""))

    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if any(k in low for k in _EMAIL_ANCHORS):
        for m in _EMAIL.finditer(text):
            plain = re.sub(r"\s*[\[({<](?:dot|punto|punkt)[\])}>]\s*|\sdot\s", ".", re.sub(r"\s*[\[({<](?:at|arroba)[\])}>]\s*|\sat\s|\s@\s", "@", m[0], flags=re.I), flags=re.I)
            add("email", m.start(), m.end(), plain.lower())
    for k in _ID_ANCHORS:
        at = low.find(k)
        while at >= 0:
            edge = min(len(text), at + 90)
            for m in _ID_BY_LABEL.finditer(text, max(0, at - 25), edge):
                # A number near the edge of the window may go on behind it; its own label opens another window.
                if any(c.isdigit() for c in m[1]) and (m.end() + 8 < edge or edge == len(text)):
                    add("id_number", m.start(1), m.end(1), re.sub(r"\W", "", m[1]).upper())
            at = low.find(k, at + len(k))
    if text.count(";") > 1:
        for m in _ID_IN_RECORD.finditer(text):
            add("id_number", m.start(1), m.end(1), re.sub(r"\W", "", m[1]).upper())
    for m in _DIGITS.finditer(text):
        _number(text, m.start(), m.end(), add)
    for k in _PHONE_LABELS:
        at = low.find(k)
        while at >= 0:
            if not (at and text[at - 1].isalnum()) and (m := _PHONE_BY_LABEL.match(text, at)):
                add("phone", m.start(1), m.end(1), phone_number(m[1]))
            at = low.find(k, at + len(k))
    for m in _ADDRESS_BY_NUMBER.finditer(text):
        add("address", m.start(), m.end(), " ".join(_fold(m[0]).split()))
    for pattern, anchors in _BY_STREET:
        if any(k in low for k in anchors):
            for m in pattern.finditer(text):
                add("address", m.start(), m.end(), " ".join(_fold(m[0]).split()))
    for start, end, canonical in _persons(text, low, names, taken):
        add("person", start, end, canonical)
    for start, end, canonical in _pairs(text, names, taken):
        add("person", start, end, canonical)
    return _linked(sorted(out, key=lambda x: x[1]))


def _linked(found: list[tuple[str, int, int, str, str]]) -> list[tuple[str, int, int, str, str]]:
    """Initials resolved to the one given name of the family they can stand for in this text."""
    full: dict[tuple[str, str], set[str]] = {}
    for kind, _, _, canonical, _ in found:
        if kind == "person":
            given, family = canonical.split(" ", 1)
            if len(given) > 1:
                full.setdefault((given[0], family), set()).add(given)
    if not full:
        return found
    out = []
    for x in found:
        given, _, family = x[3].partition(" ")
        if x[0] == "person" and len(given) == 1 and len(known := full.get((given, family), ())) == 1:
            x = (*x[:3], f"{next(iter(known))} {family}", x[4])
        out.append(x)
    return out


_BY_STREET = ((_ADDRESS_DE, _ADDRESS_DE_ANCHORS), (_ADDRESS_ES, _ADDRESS_ES_ANCHORS), (_ADDRESS_FR, _ADDRESS_FR_ANCHORS))


def _number(text: str, start: int, end: int, add) -> None:
    """Tell what a long group of digits is: an identity number by its shape, a telephone number, or neither."""
    before = text[start - 1] if start else " "
    if before.isalpha() and not (end < len(text) and (text[end] in "ABCD" or text[end].isspace())):
        return
    for m in _ID_BY_SHAPE.finditer(text, max(0, start - 4), min(len(text), end + 3)):
        add("id_number", m.start(), m.end(), re.sub(r"\W", "", m[0]).upper())
    if before.isalpha():
        return
    at, found = start, False
    while at < end and not found:
        s = at
        while s and text[s - 1] in "+(" and at - s < 2:
            s -= 1
        for first in range(s, at + 1):
            before = text[first - 1] if first else " "
            if before.isalnum() or before == "_" or (before in "-./,:" and first > 1 and text[first - 2].isdigit()):
                continue
            m = _PHONE.match(text, first)
            if m:
                digits = re.sub(r"\D", "", m[0])
                abroad = m[0].startswith(("+", "(+", "00"))
                least = 12 if m[0].startswith("00") else 11 if abroad else 9
                if least <= len(digits) <= (15 if abroad else 12):
                    add("phone", m.start(), m.end(), phone_number(m[0]))
                    at, found = m.end(), True
                    break
        if found:
            if end - at > 8:
                found = False
                continue
            return
        # The next group of digits may begin a number of its own.
        nxt = re.compile(r"(?<=[^\d])[+(]*\d").search(text, at + 1, end)
        if not nxt:
            return
        at = nxt.end() - 1


def _find(names_rows: list[tuple[str, str]], id_name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(names_rows)
        for b in batches:
            rows = [(i, *x) for i, t in zip(b[id_name], b["text"]) for x in mentions(t, names)]
            yield pd.DataFrame(rows, columns=[id_name, "kind", "char_start", "char_end", "canonical", "gender"])

    return run


def find(docs: DataFrame, name_list: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_names: int = 1_000_000) -> DataFrame:
    """``(doc_id, kind, char_start, char_end, canonical, gender)``: one row per mention.

    Offsets count code points. Null and empty texts have no mentions; repeated rows give
    repeated mentions; rows with a null id are searched too. ``name_list`` is a small table
    (refused above ``max_names`` rows); without it persons are found by titles and common given names only.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.where(F.length(docs[text_col]) > 0).select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    schema = f"{id_col} {kind}, kind string, char_start int, char_end int, canonical string, gender string"
    return rows.mapInPandas(_find(_listed(name_list, max_names), id_col), schema)


def _listed(name_list: DataFrame, max_names: int) -> list[tuple[str, str]]:
    listed = [(r[0], r[1]) for r in name_list.where("name is not null").select("name", "name_kind").distinct().orderBy("name").limit(max_names + 1).collect()]
    if len(listed) > max_names:
        raise ValueError(f"name_list has more than {max_names} rows")
    return listed


# Surrogates ---------------------------------------------------------------------------

#: Given names by gender. Titles tell the gender of others; without either a name gets an ending of any gender.
_FEMALE = set(
    "alba alice amina ana andrea anna anneke barbara carla carmen carol catherine celine charlotte clara claire elena elisabeth elizabeth emma eva fatima freya greta hannah helen helga ines "
    "ingrid isabel jane joan judith julia karen karin laura leila lotte lucia luz maria marie marta mary mei mercedes mireille monika nadia noor odile olga paula petra pilar rosa ruth sarah selma "
    "sofia sophie susan ursula wanjiru yasmin".split()
)
_MALE = set(
    "ahmed alejandro andres anton antonio bruno carlos daniel david diego dorian emil enrique felipe georg george goran hans henrik hiro hugo ivan jakob james javier jean john jonas jorge jose joshua juan "
    "julien karl kofi louis luca luis marco mario martin michael miguel nikita omar oskar paul pavel pedro peter philippe pierre piotr rafael robert sacha sasha simon tariq thomas uwe viktor yannick".split()
)
_SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to va we zi bro cra dre fli gro kna ple stu tra".split()
#: Alphabets, syllables and endings of given names (female, male) by script; other scripts are written in Latin.
_SCRIPTS = {
    "LATIN": ("abcdefghijklmnopqrstuvwxyz", "la le li lo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi mi ma".split(), ("ina", "ela", "ara", "isa"), ("ino", "ert", "omar", "us")),
    "CYRILLIC": ("абвгдежзиклмнопрстуфхцчшэюя", "ла ле ли ло на не ни но ра ре ри ро са се си со та те ти то ва ве ви ми ма".split(), ("ина", "ела", "ара", "иса"), ("ин", "ерт", "омар", "ус")),
    "GREEK": ("αβγδεζηθικλμνξοπρστυφχψω", "λα λε λι λο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το βα βε βι μι μα".split(), ("ινα", "ελα", "αρα", "ισα"), ("ινος", "ερτος", "ομαρ", "ης")),
}


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split(" ")[0]
    return name if name in _SCRIPTS else "LATIN"


class _Stream:
    """Keyed pseudo-random choices for one entity."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.data, self.key, self.n = f"{kind}\0{canonical}\0{attempt}".encode(), key, 0
        self.pool = b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = blake2b(self.data + self.n.to_bytes(4, "little"), key=self.key, digest_size=64).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return value % n


def _initial(letter: str, key: bytes) -> str:
    """The letter that stands for an initial: a keyed permutation of its alphabet, which moves every letter."""
    alphabet = _SCRIPTS[_script(letter)][0]
    if letter not in alphabet:
        return alphabet[blake2b(letter.encode(), key=key, digest_size=2).digest()[0] % len(alphabet)]
    ring = sorted(alphabet, key=lambda c: blake2b(c.encode(), key=key, digest_size=16).digest())
    return ring[(ring.index(letter) + 1) % len(ring)]


def entity_surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The canonical surrogate of an entity, to be given each mention's format. Kinds besides :data:`KINDS`: ``given`` and ``family`` name."""
    s = _Stream(key, kind, canonical, attempt)
    if kind == "given":
        first = _initial(canonical[0], key)
        if len(canonical) == 1:
            return first.upper()
        _, syllables, female, male = _SCRIPTS[_script(canonical)]
        gender = "f" if canonical in _FEMALE else "m" if canonical in _MALE else gender
        ends = female if gender == "f" else male if gender == "m" else female + male
        middle = "".join(syllables[s.below(len(syllables))] for _ in range(1 + attempt // 3))
        vowel = "" if first in "aeiouαεηιουωаеиоуэюя" else middle[-1]
        return (first + vowel + middle + ends[s.below(len(ends))]).capitalize()
    if kind == "family":
        syllables = _SYLLABLES if _script(canonical) == "LATIN" else _SCRIPTS[_script(canonical)][1]
        return "".join(syllables[s.below(len(syllables))] for _ in range(4 + attempt // 3)).capitalize()
    if kind == "email":
        return f"u{s.below(1 << 30):x}{s.below(1 << 16):x}@mail{s.below(1000)}.example"
    if kind == "address":
        return f"{''.join(_SYLLABLES[s.below(len(_SYLLABLES))] for _ in range(3 + attempt // 3)).capitalize()} {1 + s.below(998)}"
    if kind == "phone":  # the country stays, and no number starts with the trunk digit
        code, number = canonical.split(":")
        return f"{code}:{''.join(str(1 + s.below(9) if not i else s.below(10)) for i in range(len(number)))}"
    return "".join(
        str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) if c.isalpha() else c for c in canonical
    )


def formatted(kind: str, surface: str, surrogate: str) -> str:
    """``surrogate`` in the format of the mention ``surface``: case, order, separators."""
    if kind == "person":
        given, family = surrogate.split(" ")
        parts = surface.split(",")
        if len(parts) == 2:
            called = parts[1].strip()
            return f"{_cased(family, parts[0].strip())}, {given[0] + '.' if len(called.rstrip('.')) == 1 else _cased(given, called)}"
        # Given name or initial, middle initials, family name, with whatever blanks stand between.
        pieces = re.split(r"(\s+)", surface) if re.search(r"\s", surface) else re.split(r"(?<=\.)()", surface, maxsplit=1)
        first, last = pieces[0], pieces[-1]
        middle = "".join(x if not x.strip() else f"{family[1].upper()}." if len(x.rstrip(".")) == 1 else _cased(family[1:].capitalize(), x) for x in pieces[1:-1])
        return f"{given[0] + '.' if len(first.rstrip('.')) == 1 else _cased(given, first)}{middle}{_cased(family, last)}"
    if kind == "phone":  # codes and trunk digit stay: the number is what the digits end with
        number = surrogate.split(":")[1]
        skip = sum(c.isdigit() for c in surface) - len(number)
        digits = iter(number)
        seen, text = 0, ""
        for c in surface:
            seen += c.isdigit()
            text += next(digits, c) if c.isdigit() and seen > skip else c
        return text
    if kind == "email":
        local, domain = surrogate.split("@")
        at = re.search(r"\s*(?:@|[\[({<](?:at|arroba)[\])}>])\s*|\sat\s", surface, re.I)
        dot = re.search(r"\s?[\[({<](?:dot|punto|punkt)[\])}>]\s?|\sdot\s", surface, re.I)
        text = local + (at[0] if at else "@") + domain.replace(".", dot[0] if dot else ".")
        return text.upper() if surface.isupper() else text
    if kind == "address":
        return _address(surface, surrogate)
    fill = iter(surrogate)
    return "".join((next(fill, c) if c.isalnum() else c) for c in surface)


_LOCALITY = re.compile(rf"{_TOWN}$")
_POSTCODE = re.compile(r"(?<!\w)[A-Z]{2}\d?\s\d\w{2,4}$")
#: What stays of a street: its kind and the small words about it. The group is the rest.
_KIND_OF_STREET = (
    re.compile(rf"\d+(?:\s?[A-Za-z])?\s(.+?)\s(?:{_STREET_EN})\.?$", re.S),
    re.compile(rf"(?:\d+\s?(?:bis|ter|quater|[A-Da-d])?,?\s)?(?:{_STREET_FR})\s{_OF_FR}(.+)$", re.I | re.S),
    re.compile(r"(?:calle|c/|avenida|avda?\.|paseo|plaza|camino|carretera|ronda|traves[íi]a|glorieta)\s?(?:(?:del?(?:\s+l[ao]s?)?|l[ao]s?|el)\s+)?(.+)$", re.I | re.S),
    re.compile(r"([\w-]+?)(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|chaussee|steig|pfad|ring|markt|kai)\s", re.I),
    re.compile(r"(?:am|an\s+der|zum|zur|im|in\s+der|auf\s+dem|alte[rs]?|neue[rs]?)\s+(\S+)\s", re.I),
)
_PART = re.compile(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*")


def _address(surface: str, surrogate: str) -> str:
    """Every part of an address by a value of its own: street, house number and its letter, flat, postcode, town.

    The street's kind and separators stay. What ``surrogate`` doesn't hold is drawn from it, and it is keyed.
    """
    name, number = surrogate.split(" ")
    s = _Stream(b"", "address", surrogate, 0)
    names = iter([name])

    def word(like: str) -> str:
        return _cased(next(names, None) or _invented(s, 3), like)

    def mixed(text: str) -> str:
        return "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) if c.isalpha() else c for c in text)

    cut = _LOCALITY.search(surface).start()
    street, place = surface[:cut], surface[cut:]
    m = next((m for k in _KIND_OF_STREET if (m := k.match(street))), None)
    a, b = m.span(1) if m else (0, len(street))
    inner = _PART.sub(lambda w: w[0] if re.fullmatch(r"n[úu]m", w[0], re.I) else word(w[0]), street[a:b])
    street = f"{street[:a]}{inner}{street[b:]}"
    # Its letter may stand apart; the words that count instead of letters are drawn too.
    street = re.sub(
        r"\d+(?:(\s?)(?:(bis|ter|quater)|([A-Za-z]))(?![^\W_]))?",
        lambda d: number + (d[1] or "") + (("bis", "ter", "quater")[s.below(3)] if d[2] else ("abcd" if d[3].islower() else "ABCD")[s.below(4)] if d[3] else ""), street, count=1,
    )
    code = _POSTCODE.search(place)
    tail = mixed(code[0]) if code else ""
    head = place[: code.start()] if code else place
    head = re.sub(rf"\d+|{_PART.pattern}", lambda w: mixed(w[0]) if w[0].isdigit() else w[0] if w[0] == "Apt" else word(w[0]), head)
    return street + head + tail


def _invented(s: _Stream, syllables: int) -> str:
    return "".join(_SYLLABLES[s.below(len(_SYLLABLES))] for _ in range(syllables)).capitalize()


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word


def entity_table(found: DataFrame, key: str, rounds: int = 40, invent=entity_surrogate) -> DataFrame:
    """``(kind, canonical, surrogate)``: one surrogate per entity; no two entities of a kind share one, and none is an original of its kind.

    ``found``: ``kind, canonical, gender`` of mentions. Every round finds, over all entities, the surrogates that several got and
    those that are an original; of several the smallest entity keeps it, all others are keyed anew. An error is
    raised if some still collide after ``rounds``. Initials are permuted and need no check. Of an
    address the invented street must be no word of any address.
    """
    secret = key.encode()[:64]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["surrogate"] = [invent(k, c, secret, a, g) for k, c, a, g in zip(b["kind"], b["canonical"], b["attempt"], b["gender"])]
            yield b[["kind", "canonical", "attempt", "gender", "surrogate"]]

    schema = "kind string, canonical string, attempt int, gender string, surrogate string"
    votes = found.groupBy("kind", "canonical").agg(F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("")
    fresh = votes.select("kind", "canonical", F.lit(0).alias("attempt"), gender.alias("gender"))
    entities = materialize(fresh.mapInPandas(make, schema), "surrogates")
    words = entities.where("kind = 'address'").select("kind", F.explode(F.split("canonical", r"[\s,]+")).alias("original"))
    originals = entities.where("kind <> 'address'").select("kind", F.col("canonical").alias("original")).unionByName(words).distinct()
    written = F.when(F.col("kind") == "address", F.lower(F.substring_index("surrogate", " ", 1))).when(F.col("kind") == "id_number", F.col("surrogate")).otherwise(F.lower("surrogate"))
    for _ in range(rounds + 1):
        checked = entities.where("not (kind = 'given' and length(canonical) = 1)")
        keeper = checked.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("canonical").alias("keeper")).where("n > 1")
        several = checked.join(keeper, ["kind", "surrogate"]).where("canonical <> keeper").select("kind", "canonical", "attempt", "gender")
        real = checked.withColumn("original", written).join(originals, ["kind", "original"], "left_semi").select("kind", "canonical", "attempt", "gender")
        clash = several.union(real).distinct().withColumn("attempt", F.col("attempt") + 1)
        clash = materialize(clash.mapInPandas(make, schema), "surrogate-clashes")
        if clash.isEmpty():
            return entities.select("kind", "canonical", "surrogate")
        entities = materialize(entities.join(clash.select("kind", "canonical"), ["kind", "canonical"], "left_anti").unionByName(clash), "surrogates")
    raise ValueError(f"surrogates still collide after {rounds} rounds: an alphabet is too small for its entities")


def placeholder(kind: str, canonical: str, secret: bytes) -> str:
    """``[KIND_code]``, the code of 128 bits: long enough that no two entities share one."""
    return f"[{kind.upper()}_{blake2b(f'{kind}\0{canonical}'.encode(), key=secret, digest_size=16).hexdigest()}]"


def replace(docs: DataFrame, name_list: DataFrame, key: str, style: str = "placeholder", id_col: str = "doc_id", text_col: str = "text", max_names: int = 1_000_000) -> DataFrame:
    """``(doc_id, text, replaced)``: every text with its personal data replaced, all else unchanged.

    ``key``: a secret of 1 to 64 bytes; whoever has it can recompute codes. ``style="placeholder"``: ``[PERSON_5f0c21ab...]``, equal for
    equal entities, in one pass over the texts. ``style="surrogate"``: an invented value of the same type and format.
    Texts without personal data and null texts come out as they are; ``replaced`` counts
    mentions. Every row comes out once, repeated ones and those with a null id too.
    """
    if not 0 < len(key.encode()) <= 64:
        raise ValueError("a key has 1 to 64 bytes")
    kind, secret = dict(docs.dtypes)[id_col], key.encode()
    schema = f"{id_col} {kind}, text string, replaced int"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
        at, parts = 0, []
        for start, end, new in spans:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at:]])

    if style == "placeholder":
        listed = _listed(name_list, max_names)

        def redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = Names(listed)
            for b in batches:
                texts, counts = [], []
                for text in b["text"]:
                    spans = [(x[1], x[2], placeholder(x[0], x[3], secret)) for x in mentions(text, names)] if text else []
                    texts.append(spliced(text, spans) if spans else text)
                    counts.append(len(spans))
                yield pd.DataFrame({id_col: b["id"], "text": texts, "replaced": counts})

        return rows.mapInPandas(redact, schema)
    # Equal texts have equal mentions, so a text is known by its hash: ids may repeat or be null.
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    found = find(rows.select("key", "text"), name_list, "key", max_names=max_names)
    given, family = F.substring_index("canonical", " ", 1), F.expr("substring(canonical, instr(canonical, ' ') + 1)")
    part = lambda k, c: F.struct(k.alias("part"), c.alias("canonical"))
    parts = F.when(F.col("kind") == "person", F.array(part(F.lit("given"), given), part(F.lit("family"), family))).otherwise(F.array(part(F.col("kind"), F.col("canonical"))))
    found = materialize(found.distinct().select("key", "kind", "char_start", "char_end", "gender", F.explode(parts).alias("p")).select("key", "kind", "char_start", "char_end", "gender", "p.part", "p.canonical"), "mentions")
    table = entity_table(found.select(F.col("part").alias("kind"), "canonical", "gender"), key)
    found = found.join(table.withColumnRenamed("kind", "part"), ["part", "canonical"])
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("char_start", "char_end", "kind", "part", "surrogate")).alias("spans"))  # the mentions of one text

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, counts = [], []
            for text, spans in zip(b["text"], b["spans"]):
                whole: dict[tuple[int, int, str], dict[str, str]] = {}
                for x in spans if spans is not None else ():
                    whole.setdefault((x["char_start"], x["char_end"], x["kind"]), {})[x["part"]] = x["surrogate"]
                new = [(a, z, formatted(k, text[a:z], " ".join(v[p] for p in (("given", "family") if k == "person" else (k,))))) for (a, z, k), v in sorted(whole.items())]
                texts.append(spliced(text, new) if new else text)
                counts.append(len(new))
            yield pd.DataFrame({id_col: b["id"], "text": texts, "replaced": counts})

    return rows.join(per_text, "key", "left").select("id", "text", "spans").mapInPandas(rewrite, schema)


def _end_of(text: str, at: int, following: str, surface: str) -> int:
    """Where a replacement that begins at ``at`` ends: before ``following``, with as many blanks inside as its original if that can be; -1 if nowhere."""
    blanks = sum(c.isspace() for c in surface)
    first = end = text.find(following, at + 1) if following else -1
    while end >= 0 and sum(c.isspace() for c in text[at:end]) < blanks:
        end = text.find(following, end + 1)
    return end if end >= 0 and sum(c.isspace() for c in text[at:end]) == blanks else first


def check(docs: DataFrame, replaced: DataFrame, name_list: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(documents, kept, merged, edited)``: what a replacement of documents with unique ids breaks, 0 if nothing.

    ``documents``: rows that came out. ``kept``: mentions that read as before; ``merged``: replacements, as they are written, that two
    entities of a kind share; ``edited``: texts changed outside of their mentions.
    """
    listed = _listed(name_list, 1_000_000)
    pairs = replaced.select(F.col(id_col).alias("id"), F.col("text").alias("new")).join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("old")), "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(listed)
        for b in batches:
            rows = []
            for old, new in zip(b["old"], b["new"]):
                if not old:
                    rows += [("", "", "", False, True)] if old != new else []
                    continue
                found = mentions(old, names)
                at, edges = 0, [0, *[x for m in found for x in (m[1], m[2])], len(old)]
                segments = [old[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
                if not new.startswith(segments[0]) or not new.endswith(segments[-1]):
                    rows.append(("", "", "", False, True))
                    continue
                at = len(segments[0])
                for i, m in enumerate(found):
                    last = i + 1 == len(found)
                    nxt = len(new) - len(segments[-1]) if last else _end_of(new, at, segments[i + 1], old[m[1] : m[2]])
                    if nxt < at:
                        rows.append(("", "", "", False, True))
                        break
                    got = new[at:nxt]
                    given, _, family = m[3].partition(" ")
                    # Of a name written with an initial there is no telling which given name it stands for, before or after.
                    who = f"{given[0]} {family}" if m[0] == "person" and re.search(r"(?<!\w)\w\.", got) else m[3]
                    rows.append((m[0], who, re.sub(r"\W", "", _fold(got)), _fold(got) == _fold(old[m[1] : m[2]]), False))
                    at = nxt + len(segments[i + 1])
            yield pd.DataFrame(rows, columns=["kind", "canonical", "written", "kept", "edited"])

    rows = materialize(pairs.select("old", "new").mapInPandas(compare, "kind string, canonical string, written string, kept boolean, edited boolean"), "replacements")
    merged = rows.where("kind <> ''").groupBy("kind", "written").agg(F.count_distinct("canonical").alias("n")).where("n > 1")
    kept, edited = rows.agg(F.count_if("kept"), F.count_if("edited")).first()
    return docs.sparkSession.createDataFrame([(replaced.count(), kept, merged.count(), edited)], "documents long, kept long, merged long, edited long")


def found_mentions(docs: DataFrame, name_list: DataFrame) -> DataFrame:
    """``(doc_id, kind, char_start)`` of each mention."""
    return find(docs, name_list).select("doc_id", "kind", "char_start")
