"""Candidates for personal information in a text, with features and, where a field's own label stands before one, labels.

Fixed values: LABEL_WORDS are the usual words for such a field in five languages; the street words are of the same.
"""

from __future__ import annotations

import re

TYPES = ["email", "phone", "identity", "address", "name"]
LABEL_WORDS = {
    "email": ["email", "e-mail", "mail", "mailto", "contact", "maintainer", "correo", "courriel"],
    "phone": ["phone", "telephone", "tel", "tél", "telefon", "teléfono", "téléphone", "mobile", "cell", "fax"],
    "identity": ["ssn", "social security", "passport", "passeport", "pasaporte", "reisepass", "nif", "dni", "national id", "id card", "identity", "ausweis", "personalausweis", "health", "insurance", "tax", "steuer-id"],
    "address": ["address", "adresse", "anschrift", "dirección", "endereço", "domicilio", "wohnhaft", "lives at", "resides at", "home", "ship to", "ship_to"],
    "name": ["name", "nombre", "author", "autor", "auteur", "owner", "patient", "signed", "prepared by", "written by", "reviewed by", "reviewed-by", "rédigé par", "verfasst von", "dr", "mr", "mrs", "ms", "prof", "herr", "frau"],
}
LABEL_OF = {w: k for k, ws in LABEL_WORDS.items() for w in ws}
#: a label, its number word and its punctuation, right before a value
LABEL = re.compile(rf"(?<![^\W_])({'|'.join(sorted(map(re.escape, LABEL_OF), key=len, reverse=True))})(?:[ -](?:no|nr|number|num|id)\b)?[ .]?[ :=<|;(]{{1,3}}\Z")
LABEL_SPAN = max(map(len, LABEL_OF)) + 12  # no longer text can match LABEL

SIGN = re.compile("@")
SPELLED = re.compile(r" ?[\[(] ?at ?[\])] ?| AT | at (?=[\w-]+(?: dot [\w-]+)+)")
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
RIGHT = re.compile(rf"{_LABEL}((?:\.| ?[\[(] ?dot ?[\])] ?| DOT | dot ){_LABEL})*")

# The patterns that run over all text begin with a set of characters, which the search skips to, and look back after it.
_END = r"(?!\w|[.\-/:]\d|-\w)"
NUMBER = re.compile(
    r"[+(0-9](?<![\w.+\-/].)(?:(?<=\+)\d{1,3}[ .-]?\(?\d{1,5}\)?(?:[ .\-/]?\d{2,5}){1,5}|(?<=0)0\d\d ?\(0\) ?\d{2,4}(?:[ \-./]\d{2,4}){1,4}|(?<=\()\d{2,5}\) ?\d{3,5}[ \-]\d{3,5}"
    r"|(?<=1)[ .-]\d{2,8}(?:[ .\-/]\d{2,8}){1,4}|(?<=\d)\d{1,7}(?:[ .\-/]\d{2,8}){1,4}|(?<=\d)\d{6,11}(?:-[A-Z])?)" + _END
)
SERIAL = re.compile(r"[A-Z](?<![\w.+\-/].)[A-Z]?\d{6,9}" + _END)
UPPER = r"[A-ZÀ-ÖØ-Þ]"
_REST = r"(?:['’][A-ZÀ-ÖØ-Þ])?[^\W\d_]+"
_WORD = UPPER + _REST
_HYPHEN = rf"(?:-{_WORD})?"
#: at every word: Given Family, Given I. Family, I. Family and Family, Given; all that overlap
NAME = re.compile(rf"{UPPER}(?<![\w'’.+@-].)(?=({_REST}{_HYPHEN}(?:(?: {UPPER}\.)? {_WORD}{_HYPHEN}|, {_WORD}(?: {UPPER}\.)?)|\. (?:{UPPER}\. )?{_WORD}{_HYPHEN})(?![\w'’@]))")

_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|court|terrace|square|close|hill|way)"
STREET_WORD = rf"\b{_STREET}\b|straße|strasse|weg |gasse |platz |\brue\b|\bcalle\b|\brua\b|\bavenue\b"
_PLACE = rf"{UPPER}[\w'’-]*(?: {UPPER}[\w'’-]*)?"
#: a house number with a word after it; the forms that begin with one are tried there
HOUSE = re.compile(rf"[0-9](?<![\w.,/-].)\d{{0,3}}[a-z]?(?= {UPPER}| bis,| ter,|, ?[^\W\d_])")
FLAT = re.compile(r"(?<![\w.,/-])(?i:flat|apt|floor|unit) \d{1,4}[a-z]?,? \Z")
FLAT_SPAN = 16  # no longer text can match FLAT
NUMBER_FIRST = [
    re.compile(rf"\d{{1,4}}[a-z]? {_PLACE} (?i:{_STREET})\b(?:(?<=[Rr][Dd])\.|(?<=RD)\.)?(?:, (?i:apt|flat|floor|unit) \d{{1,4}}[a-z]?)?"),
    re.compile(rf"\d{{1,4}}[a-z]?(?: bis| ter)?, ?(?i:rue|avenue|boulevard|place|chemin|allée) (?:de la |du |des |de )?{_PLACE}"),
    re.compile(rf"\d{{1,4}}[a-z]? {UPPER}[\w'’-]+ {UPPER}[\w'’-]+"),
]
#: forms that end with the number, each with the pieces of which a text must hold one to match
NUMBER_LAST = [
    (["calle ", "rua ", "via ", "avenida ", "praça "], re.compile(rf"(?<!\w)(?i:calle|rua|via|avenida|praça) {_PLACE},? \d{{1,4}}[a-z]?(?:, \d{{1,2}}º(?: ?[A-Z]\b)?)?(?!\w)")),
    (["straße ", "strasse ", "weg ", "gasse ", "platz ", "allee "], re.compile(rf"(?<![\w-]){UPPER}[\w'’-]*(?: {UPPER}[\w'’-]*)?(?i:straße|strasse|weg|gasse|platz|allee) \d{{1,4}}[a-z]?(?!\w)")),
]


class NameParts:
    """How far a word begins and ends like the given and the family names of a list, itself left out."""

    def __init__(self, parts: list[tuple[str, str]]) -> None:
        self.begin: dict[str, dict[str, set[str]]] = {"given": {}, "family": {}}
        self.end: dict[str, dict[str, set[str]]] = {"given": {}, "family": {}}
        self.longest = 0
        self.known = {(w.casefold(), k) for w, k in parts}
        for word, kind in parts:
            w = word.casefold()
            self.longest = max(self.longest, len(w))
            for n in range(2, len(w)):
                self.begin[kind].setdefault(w[:n], set()).add(w)
                self.end[kind].setdefault(w[-n:], set()).add(w)
        self.seen: dict[str, tuple] = {}

    def like(self, word: str) -> tuple[int, int, int, int]:
        if word in self.seen:
            return self.seen[word]
        w = word.casefold()
        out = []
        for kind in ("given", "family"):
            for table, cut in ((self.begin, lambda n: w[:n]), (self.end, lambda n: w[-n:])):
                n = min(len(w) - 1, self.longest)
                while n >= 2 and not table[kind].get(cut(n), set()) - {w}:
                    n -= 1
                out.append(n if n >= 2 else 0)
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[word] = tuple(out)
        return self.seen[word]


def _local_part(text: str, end: int) -> int:
    """Where the local part of an address that ends here begins, however long it is; `end` if there is none."""
    i = end
    while i and (text[i - 1].isalnum() or text[i - 1] in "_.+%-"):
        i -= 1
    while i < end and not text[i].isalnum():
        i += 1
    return i


def spans(text: str) -> list[tuple[int, int, str]]:
    """All candidate spans of a text, overlapping ones too: generators that miss little and propose much."""
    out: list[tuple[int, int, str]] = []
    signs = [m.span() for m in SIGN.finditer(text)] if "@" in text else []
    if any(x in text for x in ("at)", "at]", "at )", "at ]", " AT ", " dot ")):  # SPELLED needs one of these
        signs += [m.span() for m in SPELLED.finditer(text)]
    for s, e in signs:
        start = _local_part(text, s)
        if start < s and (right := RIGHT.match(text, e)) and (text[s] == "@" or right[1]):
            out.append((start, right.end(), "email"))
    for m in NUMBER.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 6:
            out += [(*m.span(), "phone"), (*m.span(), "identity")]
    out += [(*m.span(), "identity") for m in SERIAL.finditer(text)]
    for m in HOUSE.finditer(text):
        for rx in NUMBER_FIRST:
            if hit := rx.match(text, m.start()):
                flat = FLAT.search(text[max(0, m.start() - FLAT_SPAN) : m.start()]) if rx is NUMBER_FIRST[0] else None
                out.append((m.start() - (flat.end() - flat.start() if flat else 0), hit.end(), "address"))
    low = text.lower()
    for pieces, rx in NUMBER_LAST:
        if any(x in low for x in pieces):
            out += [(*m.span(), "address") for m in rx.finditer(text)]
    out += [(m.start(), m.end(1), "name") for m in NAME.finditer(text)]
    return list(dict.fromkeys(out))


def _side(c: str) -> int:
    return 0 if not c or c in "\n\"" else 1 if c == " " else 2 if c in "|;=:<>" else 3 if c in ".,)" else 5 if c.isalnum() else 4


def features(text: str, s: int, e: int, kind: str, names: NameParts) -> list[float]:
    """Format of a span and the signs around it; the words before it are left out, as the labels come from them."""
    x = text[s:e]
    groups = re.findall(r"\d+", x)
    digits = sum(map(len, groups))
    letters = sum(c.isalpha() for c in x)
    low = x.lower()
    words = re.findall(r"[^\W\d_][^\W\d_'’]*(?:['’][^\W\d_]+)?", x) if kind == "name" else []
    f = [
        float(TYPES.index(kind)), len(x) if kind in ("phone", "identity") else 0, digits, len(groups), len(groups[0]) if groups else 0, len(groups[1]) if len(groups) > 1 else 0, len(groups[2]) if len(groups) > 2 else 0, len(groups[-1]) if groups else 0,
        x[0] == "+", x.startswith("00"), x[0] == "0", x.count(" "), x.count("-") if kind != "address" else 0, x.count("."), x.count("/"), x.count("("), letters if kind in ("phone", "identity") else 0, sum(c.isupper() for c in x) / max(letters, 1) if kind != "address" else x == x.upper(),
        "@" in x, bool(re.search(r"[^\W\d_]{2,}\Z", x)), low.count("dot") + low.count("."), bool(re.search(STREET_WORD, low)) if kind == "address" else False,
        len(words) if kind == "name" else 0,
    ]
    if kind == "name":
        comma = "," in x
        long = [w for w in words if len(w) > 1] or [""]
        given, family = (long[-1], long[0]) if comma else (long[0] if len(words[0]) > 1 and len(long) > 1 else "", long[-1])
        g, h = names.like(given) if given else (2, 2, 0, 0), names.like(family)
        f += [g[0], g[1], h[2], h[3], comma, not given, g[2] + g[3], h[0] + h[1]]
    else:
        f += [0.0] * 8
    return [float(v) for v in f]


def label(text: str, s: int, kind: str) -> int:
    """1 if a field label of the kind stands right before the span, else 0, which says nothing about it."""
    m = LABEL.search(text[max(0, s - LABEL_SPAN) : s].lower())
    return int(m is not None and LABEL_OF[m[1]] == kind)


def plain(text: str, s: int, e: int, kind: str, names: NameParts) -> bool:
    """Is the form alone telling? For texts in which no label can be learnt from: addresses with a domain's end, numbers with a
    country's prefix, streets by their word, names of which both parts are listed. Never for identity numbers."""
    x = text[s:e]
    if kind == "email":
        return "@" in x and re.search(r"\.[^\W\d_]{2,}\Z", x) is not None
    if kind == "phone":
        return x[0] == "+" and 8 <= sum(c.isdigit() for c in x) <= 15
    if kind == "address":
        return re.search(STREET_WORD, x.lower()) is not None
    if kind == "name":
        words = [w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", x.casefold()) if len(w) > 1]
        return len(words) == 2 and ((words[0], "given") in names.known and (words[1], "family") in names.known or "," in x and (words[1], "given") in names.known and (words[0], "family") in names.known)
    return False
