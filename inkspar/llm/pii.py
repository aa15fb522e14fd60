"""Surrogates for personal data.

Detected entities (e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card and other long account numbers, IBANs,
persons) are replaced by keyed surrogates of the same type.  A surrogate is the image of the entity under a keyed permutation of all
entities of its kind: its type, length, script, case and punctuation, for telephone numbers also the country, for addresses of
networks their scope (private, loopback, documentation, public ...), for names the gender.  Because it is a
permutation, two entities never get one surrogate and one entity always gets the same one, in all documents and without
any table that tasks would have to share; and it is built without fixed points, so nothing is replaced by itself (but a
name without any letter that has another of its class).  Where a permutation would leave its kind, it walks on along its cycle until it is
back in it, so kinds never meet.  `check` verifies both on the results, with two aggregations over the distinct
entities: `query` and `replace_texts` run it before they return anything, and raise an error if it finds a row.

The key is the setting spark.inkspar.pii.key of the session.  Where that is unset, a random key is drawn that lasts as long as the
application; there is no key in the code, and without the key nobody can undo the surrogates.

What counts as one entity: addresses and names without regard to case; numbers without regard to notation, so
`+1 (651) 555-0100`, `(651) 555-0100` and `651.555.0100` are one; `(0)` after a country code does not count.  A national number that
begins with 0 has no country and is an entity apart from its international form.

Gender: a listed given name becomes a listed one of its gender and script.  Titles stay.  In all other names the ending that
tells a gender stays (`MARKS`), so `Petrova` becomes another name in -ova; a title's gender changes no name, so that
`Dr Petrova` and `Mrs Petrova` have one surname.

Defined results: null text stays null and counts no entity; empty text stays empty; matches do not overlap, the type named
first wins; repeated rows give repeated results; an empty table gives no rows; other columns are carried unread.

A person is a title or a listed given name and up to NAMES_AFTER capitalised words or initials after it, with particles (which
stay) between them, so a capitalised word that follows a name without punctuation is taken for a part of it.  Not detected:
names with neither title nor listed given name before them, a given name alone, names in capitals or small letters only,
parts joined by "y", "und" and the like, IPv6 addresses with an IPv4 part, and telephone numbers without a plus that are written in other ways than (3) 3-4,
3-3-4, 0 and area code with a space, or 0 and pairs of digits; groups of three alone are left as they may be amounts.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stage, table

KEY_SETTING = "spark.inkspar.pii.key"
TYPES = ["email", "iban", "ipv6", "ipv4", "card", "phone", "person"]

#: Names and initials after a title or a given name, and what may stand between them.
NAMES_AFTER = 4
PARTICLES = set("von vom van de del della di da do dos das du la le los las den der ter ten zu zum zur bin ibn al el af av".split())
#: Titles tell the gender of the name after them; "" for either.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "M.": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Srta": "f", "Doña": "f", "Госпожа": "f",
    "Dr": "", "Prof": "", "Professor": "",
}
#: Common given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Maria Sophie Laura Julia Elena Clara Emma Alice Sarah Lucia Carmen Isabel Camille Juliette Manon Louise Katharina Johanna Martina Sandra Monika Petra Susan Linda Karen Emily Grace Olivia Rachel".split(),
    ("m", "latin"): "John Peter Michael Thomas David Robert James William Charles Daniel Carlos Javier Miguel Antonio Pierre Antoine Louis Nicolas Hans Stefan Wolfgang Jürgen Klaus Markus Andreas Matthias George Henry Samuel Oliver".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Владимир Борис".split(),
    ("f", "greek"): "Μαρία Ελένη Αικατερίνη Σοφία Δήμητρα Βασιλική Ιωάννα Γεωργία".split(),
    ("m", "greek"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Αντώνιος Στέφανος".split(),
}
#: Endings that tell a gender, the longest first where one ends another.
MARKS = "skaya ovna ova eva ina ska sky ski ov ev a o ская овна ова ева ина ая ий ов ев ин а я ου ος ης ας η α".split()
#: Country codes of one and of two digits; all others have three (fixed values, ITU-T E.164).
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Ranges of addresses with a meaning of their own (fixed values, RFC 6890 and others); what lies in none is public.
SCOPES_4 = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
SCOPES_6 = "::/16 2001:db8::/32 fc00::/7 fe80::/10 ff00::/8".split()
#: Letters are exchanged inside these classes, so that what comes out can be spoken and keeps its script.
CLASSES = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äöü", "âêîôû", "çñß",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
]
_DIGITS = "0123456789"
#: Letters of a text that are permuted as one number.
PIECE = 192
NAMES = {n.lower(): (gender, script) for (gender, script), names in GIVEN.items() for n in names}


_SESSION_KEYS: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's setting, or a random one of this application."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _SESSION_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (for n > 1), for any n, by Feistel rounds and cycle walking."""

    def __init__(self, key: bytes, tweak: str, rounds: int = 6):
        data = tweak.encode()
        self.seed = b"%d|%d|" % (len(key), len(data)) + key + data
        self.rounds = rounds

    def _f(self, n: int, r: int, x: int, size: int) -> int:
        width = (n.bit_length() + 7) // 8
        data = self.seed + b"%d|" % r + n.to_bytes(width, "big") + x.to_bytes(width, "big")
        return int.from_bytes(hashlib.shake_256(data).digest(width // 2 + 17), "big") % size

    def _rounds(self, n: int, x: int, a: int, back: bool) -> int:
        # x = left * a + right; both halves are below a
        left, right = divmod(x, a)
        if back:
            for r in reversed(range(self.rounds)):
                left, right = (right - self._f(n, r, left, a)) % a, left
        else:
            for r in range(self.rounds):
                left, right = right, (left + self._f(n, r, right, a)) % a
        return left * a + right

    def _walk(self, n: int, x: int, back: bool) -> int:
        a = isqrt(n - 1) + 1
        while True:
            x = self._rounds(n, x, a, back)
            if x < n:
                return x

    def __call__(self, n: int, x: int) -> int:
        """The neighbour of x's place in the permuted order: P^-1(P(x) + 1).  All places are one cycle."""
        if n < 2:
            return x
        return self._walk(n, (self._walk(n, x, False) + 1) % n, True)

    def inside(self, n: int, x: int, kind: Callable[[int], object]) -> int:
        """The same among the places of x's kind only: the next one along the cycle."""
        want, y = kind(x), self(n, x)
        while kind(y) != want:
            y = self(n, y)
        return y


@lru_cache(1)
def letter_classes() -> dict[str, str]:
    """Small or caseless letter -> the letters that it may become.

    Beyond CLASSES: letters of one script and category, vowels apart from consonants where the script has both; letters that change with
    their case in irregular ways, or are compatibility forms, are in no class.
    """
    groups: dict[tuple, list[str]] = {}
    listed = set("".join(CLASSES))
    for i in range(0xAA, 0x323B0):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] != "L" or c in listed or c.lower() != c or len(c.upper()) != 1 or c.upper().lower() != c or unicodedata.normalize("NFKC", c) != c:
            continue
        base = unicodedata.normalize("NFD", c)[0]
        vowel = base in "aeiouæœøıаеиоуыэюяαεηιουω"
        groups.setdefault((unicodedata.name(c, "?").split()[0], kind, vowel, c.upper() != c, i < 0x250, 0xAC00 <= i <= 0xD7A3), []).append(c)
    return {c: cls for cls in [*CLASSES, *("".join(g) for g in groups.values() if len(g) > 1)] for c in cls}


_COMMON = {c: cls for cls in CLASSES for c in cls}


def members_of(c: str) -> str | None:
    if c in _DIGITS:
        return _DIGITS
    low = c.lower()
    found = _COMMON.get(low)
    return found if found or low < "\x80" else letter_classes().get(low)


def shuffle_shape(text: str, permute: Permutation) -> str:
    """Exchange digits, and letters inside their classes; all else and the case of each letter stay."""
    shape, n, x = [], 1, 0
    for c in text:
        members = members_of(c)
        shape.append((c, members))
        if members:
            x = x * len(members) + members.index(c.lower())
            n *= len(members)
    x = permute(n, x)
    out = []
    for c, members in reversed(shape):
        if members:
            x, at = divmod(x, len(members))
            new = members[at]
            out.append(new.upper() if c.isupper() and len(new.upper()) == 1 else new)
        else:
            out.append(c)
    return "".join(reversed(out))


def small(text: str) -> str:
    """Letter by letter, so that a letter's small form does not depend on its neighbours."""
    return "".join(map(str.lower, text))


def mark_of(word: str) -> str:
    low = small(word)
    return next((m for m in MARKS if low.endswith(m) and len(low) >= len(m) + 2), "")


def scope(x: int, ranges: list[tuple[int, int]]) -> int:
    """The number of the range (first address, width of what is free in it) that holds x, or -1."""
    return next((k for k, (first, bits) in enumerate(ranges) if x >> bits == first >> bits), -1)


def number_4(text: str) -> int:
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    return x


_RANGES_4 = [(number_4(a), 32 - int(b)) for a, _, b in (r.partition("/") for r in SCOPES_4)]
_RANGES_6 = [(int(IPv6Address(a)), 128 - int(b)) for a, _, b in (r.partition("/") for r in SCOPES_6)]
_TRUNK = re.compile(r"\+(\d{1,3})[ .-]?\(0\)")


def phone_parts(text: str) -> tuple[str, str, str]:
    """Country code ("" for none), trunk prefix as written, and the digits that make the number."""
    digits = "".join(c for c in text if c.isdecimal())
    if text.startswith("+"):
        trunk = _TRUNK.match(text)
        if trunk:
            return trunk[1], "0", digits[len(trunk[1]) + 1 :]
        size = next((k for k in (1, 2) if digits[:k] in CODES), 3)
        return digits[:size], "", digits[size:]
    if [len(g) for g in re.findall(r"\d+", text)] == [3, 3, 4]:
        return "1", "", digits
    return "", digits[:1], digits[1:]


def refill(pattern: str, digits: str) -> str:
    """Put digits in the places of the digits of pattern."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in pattern)


def luhn_sum(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _with_case(new: str, old: str) -> str:
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new if old[:1].isupper() else new.lower()


class Surrogates:
    """Entity -> surrogate.  What was computed is remembered within a bound, for speed only."""

    BOUND = 100_000

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key
        self.known: dict[tuple[str, str], str] = {}

    def permute(self, tweak: str) -> Permutation:
        return Permutation(self.key, tweak)

    def __call__(self, kind: str, text: str) -> str:
        got = self.known.get((kind, text))
        if got is None:
            if len(self.known) >= self.BOUND:
                self.known.clear()
            got = self.known[kind, text] = getattr(self, kind)(text)
        return got

    def shape(self, text: str, tweak: str) -> str:
        """shuffle_shape in pieces of bounded size, each under a digest of what comes before it, so that the whole is a permutation too."""
        out, before = [], hashlib.sha256()
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            out.append(shuffle_shape(part, self.permute(f"{tweak}|{before.hexdigest()}" if at else tweak)))
            before.update(small(part).encode())
        return "".join(out)

    def email(self, text: str) -> str:
        # the top-level label, and reserved example domains, stay
        local, _, domain = text.rpartition("@")
        head, _, top = domain.rpartition(".")
        kept = re.search(r"(?i)(?:^|\.)example$", head)
        host = head[: kept.start()] if kept else head
        tail = f"{head[kept.start():] if kept else ''}.{top}"
        return self.shape(f"{local}@{host}", f"email|{small(tail)}") + tail

    def phone(self, text: str) -> str:
        # the country stays, and an exchange of 555, which is no number of anybody in country 1
        code, trunk, body = phone_parts(text)
        if code == "1" and len(body) == 10 and body[3:6] == "555":
            free = f"{self.permute('phone|1|555')(10**7, int(body[:3] + body[6:])):07d}"
            new = free[:3] + "555" + free[3:]
        else:
            apart = (lambda x: x // 10**4 % 1000 == 555) if code == "1" and len(body) == 10 else lambda x: 0
            new = f"{self.permute(f'phone|{code}|{len(body)}').inside(10 ** len(body), int(body), apart):0{len(body)}d}"
        return refill(text, (code if text.startswith("+") else "") + trunk + new)

    def address(self, x: int, bits: int, ranges: list[tuple[int, int]], tweak: str) -> int:
        k = scope(x, ranges)
        if k < 0:
            return self.permute(tweak).inside(1 << bits, x, lambda y: scope(y, ranges))
        first, free = ranges[k]
        return first + self.permute(f"{tweak}|{k}")(1 << free, x - first)

    def ipv4(self, text: str) -> str:
        x = self.address(number_4(text), 32, _RANGES_4, "ipv4")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def ipv6(self, text: str) -> str:
        """Written in full or with :: like the original, and in its case."""
        new = IPv6Address(self.address(int(IPv6Address(text)), 128, _RANGES_6, "ipv6"))
        made = new.compressed if "::" in text or len(text) < 39 else new.exploded
        return made.upper() if text != text.lower() else made

    def card(self, text: str) -> str:
        """The Luhn remainder stays, so valid numbers become valid ones and others stay invalid in the same way."""
        digits = "".join(c for c in text if c.isdecimal())
        rest = luhn_sum(digits)
        n = len(digits) - 1
        new = f"{self.permute(f'card|{len(digits)}|{rest}')(10**n, int(digits[:-1])):0{n}d}"
        return refill(text, new + str((rest - luhn_sum(new + "0")) % 10))

    def iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        country, body = plain[:2], plain[4:]
        body = self.shape(body, f"iban|{country}")
        number = "".join(str(int(c, 36)) for c in body + country + "00")
        made = iter(country + f"{98 - int(number) % 97:02d}" + body)
        return "".join(c if c == " " else next(made) for c in text)

    def given(self, word: str) -> str:
        """A listed name becomes another listed name of its gender and script."""
        listed = NAMES[word.lower()]
        names = GIVEN[listed]
        at = [n.lower() for n in names].index(word.lower())
        return _with_case(names[self.permute(f"given|{listed}")(len(names), at)], word)

    def letters(self, word: str, last: bool = True) -> str:
        """Another word of the same shape and mark that is no listed name, and, unless it is the last, no title and no particle: those have
        other sources, so walk on along the cycle."""
        mark = mark_of(word)
        stem, end = word[: len(word) - len(mark)], word[len(word) - len(mark) :]
        permute, new = self.permute(f"name|{mark}"), stem
        while True:
            new = shuffle_shape(new, permute)
            made = new + end
            if made == word or (mark_of(made) == mark and made.lower() not in NAMES and (last or small(made) not in RESERVED)):
                return made

    def person(self, text: str) -> str:
        at = titles_end(text)
        words = re.split(r"([\s.]+)", text[at:])
        names = [k for k, w in enumerate(words) if any(map(str.isalpha, w))]
        for k in names:
            w, last = words[k], k == names[-1]
            if w.lower() in NAMES:
                words[k] = self.given(w)
            elif last or small(w) not in RESERVED:
                words[k] = self.letters(w, last)
        return text[:at] + "".join(words)


def identity(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind == "phone":
        code, trunk, body = phone_parts(text)
        return f"+{code} {body}" if code else trunk + body
    if kind == "ipv4":
        return str(number_4(text))
    if kind == "ipv6":
        return str(int(IPv6Address(text)))
    if kind == "card":
        return "".join(c for c in text if c.isdecimal())
    return text.replace(" ", "") if kind == "iban" else small(text)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_EMAIL_DOMAIN = re.compile(r"@((?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24})(?![^\W_])")
#: Everything that begins with a digit, a plus or a bracket, tried only where a digit is.
_NUMBER = re.compile(
    rf"(?P<ipv4>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d))"
    r"|(?P<card>(?<![\w+])\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?!\w))"
    r"|(?P<phone>(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|(?<!\d )(?:\d{3} \d{3} \d{4}|0\d(?:[ .]\d{2}){4}|0\d{1,4} \d{3,8}(?: \d{2,4}){0,2}))(?!\w|\.\d))",
    re.ASCII,
)
_RUN = re.compile(r"[+(]?\d[\d ().+-]{5,}\d", re.ASCII)
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX_END, _HEX = re.compile(r"[0-9A-Fa-f:]+$"), re.compile(r"[0-9A-Fa-f:]*")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IBAN_START = re.compile(r"(?<![^\W_])[A-Z]{2}\d\d(?=[ A-Z0-9]{10})")
_NAME = r"[^\W\d_]+(?:[-'][^\W\d_]+)*"
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\.?(?= )")
#: M. is a title at the beginning and an initial after another title.
_TITLE_AGAIN = re.compile(rf" +(?:{'|'.join(sorted((re.escape(t) for t in TITLES if t != 'M.'), key=len, reverse=True))})\.?(?= )")
#: Words that stay where a name follows them.
RESERVED = PARTICLES | {t.lower() for t in TITLES if t != "M."}
_LISTED = re.compile(rf"(?<!\w)(?:{'|'.join(n for names in GIVEN.values() for n in names)})(?= )")
_NEXT = re.compile(rf" +(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) +){{0,3}}(?P<name>[^\W\d_]\.(?= )|{_NAME}(?!\w))")
_TITLE_WORDS = sorted(TITLES)
_GIVEN_WORDS = sorted(n for names in GIVEN.values() for n in names)


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def titles_end(text: str) -> int:
    """Where the titles at the beginning end, with the spaces after them."""
    m = _TITLE.match(text)
    if not m:
        return 0
    at = m.end()
    while again := _TITLE_AGAIN.match(text, at):
        at = again.end()
    return len(text) - len(text[at:].lstrip(" "))


def address_6(text: str, colons: re.Match) -> tuple[int, int] | None:
    """The span of an IPv6 address around two colons."""
    left = _HEX_END.search(text, max(0, colons.start() - 40), colons.start())
    start = left.start() if left else colons.start()
    end = _HEX.match(text, colons.start()).end()
    if end - start > 39 or (start and (text[start - 1].isalnum() or text[start - 1] in "_.")) or text[end : end + 1].isalnum() or text[end : end + 1] == "_":
        return None
    if text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit():
        return None
    if text[end - 1] == ":" and not text[start:end].endswith("::"):
        end -= 1  # a colon of the sentence
    found = text[start:end]
    try:
        IPv6Address(found)
    except (AddressValueError, ValueError):
        return None
    groups = [g for g in found.split(":") if g]
    return (start, end) if len(groups) > 2 or (len(groups) > 1 and any(map(str.isdecimal, found))) else None


def names_end(text: str, at: int) -> int:
    """Where the names that follow a title or a given name end; at, if there are none."""
    for _ in range(NAMES_AFTER):
        m = _NEXT.match(text, at)
        if not m or not m["name"][0].isupper():
            break
        at = m.end()
    return at


class Detector:
    """Spans (start, end, type) of a text, in order and without overlaps."""

    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for w in [*_TITLE_WORDS, *_GIVEN_WORDS]:
            self.words.add_word(w + " ", w)
            self.words.add_word(w + ". ", w)
        self.words.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        at = text.find("@")
        while at >= 0:
            domain = _EMAIL_DOMAIN.match(text, at)
            start = at
            while domain and start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
                start -= 1
            if start < at:
                found.append((start, domain.end(), "email"))
            at = text.find("@", at + 1)
        for run in _RUN.finditer(text):
            for m in _NUMBER.finditer(text, max(0, run.start()), run.end() + 1):
                kind = m.lastgroup if m.lastgroup != "gap" else "card"
                digits = sum(c.isdecimal() for c in m[0])
                if kind == "ipv4" or (kind == "card" and 13 <= digits <= 19) or (kind == "phone" and 8 <= digits <= 15):
                    found.append((m.start(), m.end(), kind))
        end = 0
        for colons in _COLONS.finditer(text):
            span = address_6(text, colons) if colons.start() >= end else None
            if span:
                end = span[1]
                found.append((*span, "ipv6"))
        for start in _IBAN_START.finditer(text):
            m = _IBAN.match(text, start.start())
            if m and iban_valid(m[0]):
                found.append((m.start(), m.end(), "iban"))
        for end, word in self.words.iter(text):
            start = max(0, text.rfind(word, 0, end + 1))
            for pattern in (_TITLE, _LISTED):
                m = pattern.match(text, start)
                if m and (stop := names_end(text, m.end())) > m.end():
                    found.append((m.start(), stop, "person"))
                    break
        rank = {t: k for k, t in enumerate(TYPES)}
        found.sort(key=lambda s: (rank[s[2]], s[0] - s[1], s[0]))
        taken: list[tuple[int, int, str]] = []
        if len(found) > 1:
            from bisect import bisect_left, insort

            for s in found:
                k = bisect_left(taken, s)
                if (k and taken[k - 1][1] > s[0]) or (k < len(taken) and taken[k][0] < s[1]):
                    continue
                insort(taken, s)
            return taken
        return found


def rewrite(text: str, spans: list[tuple[int, int, str]], surrogate: Callable[[str, str], str]) -> tuple[str, list[str]]:
    out, made, at = [], [], 0
    for start, end, kind in spans:
        new = surrogate(kind, text[start:end])
        out += [text[at:start], new]
        made.append(new)
        at = end
    return "".join([*out, text[at:]]), made


ENTITY = "array<struct<start:int,end:int,type:string,entity:string,surrogate:string,identity:string,made:string>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *((n, pa.string()) for n in ("type", "entity", "surrogate", "identity", "made"))]))


class Rewriter:
    """Texts -> rewritten texts and their entities."""

    def __init__(self, key: bytes):
        self.detect, self.made = Detector(), Surrogates(key)

    def __call__(self, texts: list[str | None]) -> tuple[list[str | None], list[list[dict]]]:
        out, entities = [], []
        for t in texts:
            spans = self.detect(t) if t else []
            new, names = rewrite(t, spans, self.made) if spans else (t, [])
            out.append(new)
            entities.append([
                {"start": s, "end": e, "type": k, "entity": t[s:e], "surrogate": n, "identity": identity(k, t[s:e]), "made": identity(k, n)}
                for (s, e, k), n in zip(spans, names, strict=True)
            ])
        return out, entities


def surrogates(docs: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text (rewritten), entities (where each was, its type, itself, its surrogate, and what identifies both)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Rewriter(key)
        for batch in batches:
            texts, entities = work(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(entities, _KIND)], ["doc_id", "text", "entities"])

    return map_texts(rows, run, f"doc_id long, text string, entities {ENTITY}")


class Collision(ValueError):
    pass


def collisions(result: DataFrame) -> DataFrame:
    """type, entity, surrogate wherever two entities share a surrogate or one has two: no rows, when all is right."""
    e = result.select(F.explode("entities").alias("e")).select("e.type", F.col("e.identity").alias("entity"), F.col("e.made").alias("surrogate")).distinct()
    split = e.groupBy("type", "entity").agg(F.min("surrogate").alias("surrogate"), F.count("*").alias("n")).where("n > 1")
    merged = e.groupBy("type", "surrogate").agg(F.min("entity").alias("entity"), F.count("*").alias("n")).where("n > 1")
    return split.select("type", "entity", "surrogate").union(merged.select("type", "entity", "surrogate"))


def check(result: DataFrame) -> DataFrame:
    """result, or an error if two entities share a surrogate or one has two; result must be cheap to read twice.  Entities are not told."""
    bad = collisions(result).groupBy("type").count().collect()  # at most one row a type
    if bad:
        raise Collision(", ".join(f"{r['type']}: {r['count']}" for r in bad))
    return result


def replace_texts(docs: DataFrame, key: bytes | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with their texts rewritten, and the number of characters brought up to date if there is such a column; checked."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = key or key_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Rewriter(key)
        for batch in batches:
            rows = batch.column("row")
            names = [f.name for f in rows.type]
            cols = dict(zip(names, rows.flatten(), strict=True))
            texts, entities = work(cols[text_col].to_pylist())
            cols[text_col] = pa.array(texts, pa.string())
            if size_col in cols:
                old = cols[size_col]
                cols[size_col] = pa.array([len(t) if t is not None else o for t, o in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(cols.values()), names), pa.array(entities, _KIND)], ["row", "entities"])

    both = T.StructType([whole.schema["row"], T.StructField("entities", T._parse_datatype_string(ENTITY))])
    return check(stage(map_texts(whole, run, both))).select("row.*")


def _of_type(kind: str):
    return lambda e: e["type"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of entities of each type, spans and surrogates in order, and the text as rewritten."""
    made = check(stage(surrogates(table(spark, sf_dir, "documents"), key_of(spark))))
    counts = [F.size(F.filter("entities", _of_type(t))).cast("long").alias(f"n_{t}") for t in TYPES]
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["end"].cast("string"), e["surrogate"])), "\n")
    return made.select("doc_id", *counts, listed.alias("spans"), "text")
