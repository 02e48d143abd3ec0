"""Surrogates for personal data and secrets in text."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .scratch import Scratch
from .textio import portions, record

#: Runs of characters that stand for each other: digits and letters, script by script, case by case.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_CLASS_OF = {c: (cls, i) for cls in CLASSES for i, c in enumerate(cls)}
#: In names vowels stand for vowels and consonants for consonants, so that they can be spoken.
SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äëïöü", "ñç", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"]
_SOUND_OF = {c: (cls, i) for low in SOUNDS for cls in (low, low.upper()) for i, c in enumerate(cls)}
#: Other Latin letters with marks stand for each other, by case.
for _low in (str.islower, str.isupper):
    _rest = "".join(c for c in map(chr, range(0xC0, 0x180)) if _low(c) and c not in _SOUND_OF)
    _SOUND_OF |= {c: (_rest, i) for i, c in enumerate(_rest)}
HEX = "0123456789abcdef"

#: Given names by gender and script; a surrogate keeps both. Other given names are told by a title.
NAMES = {
    ("f", "latin"): "Mary Anna Anne Julia Laura Sarah Emma Clara Helen Alice Nora Ruth Diana Marie Claire Sophie Ingrid Greta Carmen Lucia Elena Jane Susan Linda Karen Nancy Lisa Emily Katharina Ursula Sabine Monika Petra Brigitte Isabelle Camille Pilar Teresa Beatriz Dolores Angela Jessica Jennifer Patricia Elizabeth Barbara Margaret Amanda Sofía María Lucía".split(),
    ("m", "latin"): "John James Peter Paul David Mark Henry Louis Oscar Victor Simon Martin Pierre Hans Karl Stefan Carlos Pablo Diego Jorge Robert Michael William Richard Thomas George Edward Daniel Wolfgang Jürgen Klaus Dieter Jacques François Antoine Miguel Javier Alejandro Fernando Manuel Pedro Luis José Juan Joseph Charles Matthew Anthony Andrew Christopher Philippe Heinrich".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Βασιλική Δήμητρα Αικατερίνη Γεωργία Ειρήνη Ευαγγελία Ιωάννα".split(),
    ("m", "greek"): "Γιώργος Νίκος Γιάννης Δημήτρης Κώστας Αλέξης Παναγιώτης Χρήστος Βασίλης Μιχάλης Στέλιος Ανδρέας".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Николай Дмитрий Алексей Андрей Михаил Владимир Александр Юрий Павел".split(),
}
_GIVEN = {name: key for key, names in NAMES.items() for name in names}
_TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Madame": "f", "Mme": "f", "Monsieur": "m", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "κύριος": "m", "κυρία": "f", "господин": "m", "госпожа": "f", "Dr": "", "Doctor": "", "Prof": "", "Professor": "", "Mlle": "f", "Mademoiselle": "f", "Doña": "f"}
#: Calling codes of two digits; 1 and 7 have one digit and all others three.
_CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Address blocks with a meaning of their own (first address and size); a surrogate stays in its block.
_BLOCKS = ((0x00000000, 1 << 24), (0x0A000000, 1 << 24), (0x64400000, 1 << 22), (0x7F000000, 1 << 24), (0xA9FE0000, 1 << 16), (0xAC100000, 1 << 20), (0xC0A80000, 1 << 16), (0xE0000000, 1 << 29))
#: What well-known access keys begin with.
_MARKERS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")



def _any_of(words: list[str]) -> str:
    """A pattern of words in which common beginnings are tried once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    ends = by.pop("", None)
    more = "|".join(re.escape(c) + _any_of(rest) for c, rest in by.items())
    return "" if not by else f"(?:{more}){'?' if ends else ''}"


#: A word that begins with a capital; a possessive is no part of it.
_FAMILY = r"(?=[^\W\d_a-zα-ωа-яß-ÿ])[^\W\d_]+(?:(?:-|['’](?![sS]\b))[^\W\d_]+)*"
_CAPITALS = r"(?=[^\W\d_])(?:(?![a-zα-ωа-яß-ÿ])[^\W\d_])+(?:(?:-|['’](?!S\b))(?:(?![a-zα-ωа-яß-ÿ])[^\W\d_])+)*"
#: What stands before a person's name in letters and forms.
_BEFORE_NAME = r"(?i:\b(?:my name is|full name:|signed[:,]|regards,|sincerely,|patient:|employee:))"
_PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"(?i:\b(?P<said_of>api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)\b\s*[:=]\s*)(?P<q>[\"']?)(?P<secret>[A-Za-z0-9+/_\-.]{6,})(?P=q)|\b(?P<bare>(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,64}|[0-9A-F]{32,64}))\b",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])|(?<![\w.])\+\d{8,14}(?!\w)",
    "name": rf"\b(?:(?P<title>{_any_of([*_TITLES])})\.?\s(?:(?P<first>{_FAMILY})\s)?(?P<last>{_FAMILY})|(?P<given>{_any_of([*_GIVEN])})\s(?P<family>{_FAMILY})|(?P<loud>{_any_of([n.upper() for n in _GIVEN])})\s(?P<kin>{_CAPITALS}))\b|{_BEFORE_NAME}\s+(?P<said>{_FAMILY}\s{_FAMILY})\b",
}
_ANY = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in _PATTERNS.items()))
_SIGN, _PERSON, _HEX_RUN, _COLONS = re.compile(r"[@\d]").search, re.compile(_any_of([*_TITLES, *_GIVEN, *(n.upper() for n in _GIVEN)])).search, re.compile("[a-f]{32}|[A-F]{32}").search, re.compile("::|[A-Fa-f]:[A-Fa-f]").search
_SAID = ("secret", "token", "passw", "pwd", "key", "my name is", "full name:", "signed", "regards,", "sincerely,", "patient:", "employee:")


def may_hold(text: str) -> bool:
    """Whether a text has what every entity of some kind has; most texts end here."""
    if _SIGN(text) or _PERSON(text) or ":" in text and _COLONS(text) or any(m in text for m in _MARKERS) or _HEX_RUN(text):
        return True
    folded = text.casefold()
    return any(w in folded for w in _SAID)


class Entity:
    __slots__ = ("kind", "start", "end", "text", "key")

    def __init__(self, kind: str, start: int, end: int, text: str, key: str | None = None):
        self.kind, self.start, self.end, self.text = kind, start, end, text
        self.key = canonical(kind, text) if key is None else key


def canonical(kind: str, text: str) -> str:
    """What all spellings of one entity have in common, so that they get one surrogate.

    Secrets have one spelling. A phone number with its country's code and without is one.
    """
    if kind == "email":
        return text.lower()
    if kind == "iban":
        return "".join(text.split())
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        if not text.startswith("+"):
            return digits
        return digits[1 if digits[0] in "17" else 2 if digits[:2] in _CALLING else 3 :]
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).packed.hex()
    return text


def luhn(digits: str) -> int:
    """The digit that completes a card number."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def is_card(digits: str) -> bool:
    """An issuer's first digits, its length and the check digit."""
    first, two, n = digits[0], int(digits[:2]), len(digits)
    issued = n in (13, 16, 19) if first == "4" else n == 15 if two in (34, 37) else n == 16 if 51 <= two <= 55 or 22 <= two <= 27 or two == 35 else n == 14 if two in (30, 36, 38) else 16 <= n <= 19 if first == "6" else False
    return issued and luhn(digits[:-1]) == int(digits[-1])


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number."""
    value = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - value % 97:02}"


#: What is said of passwords and is none.
_NO_SECRET = frozenset("required optional protected incorrect forgotten encrypted changed expired recovery authentication disabled enabled unchanged".split())


def _is_secret(of: str, value: str) -> bool:
    """A value with a digit, long enough; of a password also a long word."""
    password = of.lower().startswith(("pass", "pwd"))
    if re.search(r"\d", value):
        return password or len(value) >= 8
    return password and len(value) >= 10 and value.strip(".").lower() not in _NO_SECRET


def _entity(m: re.Match, text: str) -> Entity | None:
    kind = m.lastgroup[2:]
    if kind == "secret":
        at = "secret" if m["secret"] is not None else "bare"
        if at == "secret" and not _is_secret(m["said_of"], m[at]):
            return None
        return Entity(kind, *m.span(at), m[at])
    if kind == "name":
        at = next(x for x in ("first", "last", "given", "loud", "said") if m[x] and (x != "last" or not m["first"]))
        whole = text[m.start(at) : m.end()]
        words = [w.title() if len(w) > 1 and w.isupper() else w for w in whole.split()]
        gender = _TITLES.get(m["title"] or "") or _GIVEN.get(words[0], ("",))[0]
        return Entity(kind, m.start(at), m.end(), whole, f"{gender}/{' '.join(words)}")  # with a title or without, in capitals or not, it is the same person
    if kind == "card" and not is_card(re.sub(r"\D", "", m[0])):
        return None
    if kind == "ipv6":
        try:
            if int(ipaddress.IPv6Address(m[0])) < 2:  # unspecified or loopback
                return None
        except ValueError:
            return None
    return Entity(kind, *m.span(), m[0])


_NEXT = {k: re.compile("|".join(f"(?P<k_{x}>{_PATTERNS[x]})" for x in list(_PATTERNS)[list(_PATTERNS).index(k) + 1 :])) for k in ("secret", "card", "ipv6")}
_RUN = re.compile(r"\w*\W?")


def find(text: str | None) -> list[Entity]:
    """Entities of a whole text, left to right, not overlapping.

    What looks like a card or an address and isn't one may be, or hold, another entity; looking goes on
    in the same place for other kinds, then behind its first run of letters and digits.
    """
    if not text or not may_hold(text):
        return []
    out, at = [], 0
    while m := _ANY.search(text, at):
        found = _entity(m, text)
        if found is None:
            again = _NEXT[m.lastgroup[2:]].match(text, m.start())
            found = again and _entity(again, text)
        if found is None:
            at = max(_RUN.match(text, m.start()).end(), m.start() + 1)
        else:
            out.append(found)
            at = found.end
    return out


class Cipher:
    """A keyed permutation of the strings of one shape: no two values can get the same surrogate."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: bytes, value: int, size: int) -> int:
        digest = hashlib.blake2b(tag + value.to_bytes(size // 8 + 1, "big"), key=self.key, digest_size=min(64, size // 8 + 9)).digest()
        while len(digest) * 8 < size:
            digest += hashlib.blake2b(digest, key=self.key).digest()
        return int.from_bytes(digest, "big") & ((1 << size) - 1)

    def number(self, tag: str, value: int, size: int) -> int:
        """Permute 0..size-1 so that no value stays what it is.

        Both a permutation and its inverse, with a step by a keyed number between them: as no number is
        itself plus that step, no value is its own image.
        """
        if size < 2:
            return value
        step = 1 + self._round(f"{tag}/{size}/step".encode(), size, size.bit_length() + 64) % (size - 1)
        if not size % 2 and not step % 2:
            step -= 1  # odd, so that for a power of two the values are one cycle
        return self._feistel(tag, (self._feistel(tag, value, size) + step) % size, size, back=True)

    def _feistel(self, tag: str, value: int, size: int, back: bool = False) -> int:
        """A Feistel network over the next even number of bits, or its inverse, walked until inside."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        tags = [f"{tag}/{size}/{r}".encode() for r in range(8)]
        while True:
            left, right = value >> half, value & low
            for t in reversed(tags) if back else tags:
                left, right = (right ^ self._round(t, left, half), left) if back else (right, left ^ self._round(t, right, half))
            value = left << half | right
            if value < size:
                return value

    def shaped(self, tag: str, text: str, classes=None) -> str:
        """Permute the letters and digits of a text within their script and case; the rest stays."""
        look = classes or _CLASS_OF
        kinds = [look.get(c) for c in text]
        value, size = 0, 1
        for kind in kinds:
            if kind:
                value, size = value * len(kind[0]) + kind[1], size * len(kind[0])
        value = self.number(f"{tag}/{''.join(k[0][0] if k else c for k, c in zip(kinds, text, strict=True))}", value, size)
        out = []
        for kind, c in zip(reversed(kinds), reversed(text), strict=True):
            if kind:
                value, i = divmod(value, len(kind[0]))
                c = kind[0][i]
            out.append(c)
        return "".join(reversed(out))


_LOW_HEX, _UP_HEX = ({c: (cls, i) for i, c in enumerate(cls)} for cls in (HEX, HEX.upper()))


def _address(cipher: Cipher, tag: str, value: int) -> int:
    """Another address of the same block, or for a public one another public one."""
    for base, size in _BLOCKS:
        if base <= value < base + size:
            return base + cipher.number(f"{tag}/{base}", value - base, size)
    while True:  # a permutation walked to the next public address is one of public addresses
        value = cipher.number(tag, value, 1 << 32)
        if not any(base <= value < base + size for base, size in _BLOCKS):
            return value


def _script(word: str) -> str:
    return "greek" if "\u0370" <= word[0] <= "\u03ff" else "cyrillic" if "\u0400" <= word[0] <= "\u04ff" else "latin"


def surrogate(cipher: Cipher, kind: str, key: str, attempt: int = 0) -> str:
    """The replacement of an entity in its canonical form: a permutation of the forms of one shape."""
    tag = f"{kind}/{attempt}"
    if kind == "email":
        local, _, domain = key.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{cipher.shaped(tag + '/local/' + domain, local)}@{cipher.shaped(tag + '/host', host)}.{top}"
    if kind == "ip":
        a, b, c, d = map(int, key.split("."))
        value = _address(cipher, tag, a << 24 | b << 16 | c << 8 | d)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":  # the first 16 bits tell what kind of address it is
        return key[:4] + f"{cipher.number(f'{tag}/{key[:4]}', int(key[4:], 16), 1 << 112):028x}"
    if kind == "card":  # the issuer's digits stay, the last one completes the number
        body = key[:2] + cipher.shaped(f"{tag}/{key[:2]}", key[2:-1])
        return f"{body}{luhn(body)}"
    if kind == "secret":
        marker = next((m for m in _MARKERS if key.startswith(m)), "")
        rest = key[len(marker) :]
        hexed = _LOW_HEX if not rest.strip(HEX) else _UP_HEX if not rest.strip(HEX.upper()) else None
        return marker + cipher.shaped(f"{tag}/{marker}", rest, hexed)
    if kind == "iban":
        country, account = key[:2], key[4:]
        if key[2:4] != iban_check(country, account):  # not an account number; all digits go
            return country + cipher.shaped(f"{tag}/{country}", key[2:])
        account = cipher.shaped(f"{tag}/{country}", account)
        return country + iban_check(country, account) + account
    if kind == "name":
        said, _, name = key.partition("/")
        *first, last = name.split()
        family = cipher.shaped(tag + "/family", last, _SOUND_OF)
        if not first:
            return family
        if first[0] not in _GIVEN:
            return f"{cipher.shaped(f'{tag}/given/{last}', first[0], _SOUND_OF)} {family}"
        own = NAMES[_GIVEN[first[0]]]
        given = own[cipher.number(f"{tag}/given/{last}", own.index(first[0]), len(own))]
        choice = NAMES.get((said, _script(first[0])), own)
        return f"{given if choice is own else choice[own.index(given) % len(choice)]} {family}"
    return cipher.shaped(tag, key)


def dressed(kind: str, text: str, new: str) -> str:
    """A canonical surrogate in the format of one spelling: its separators, its case."""
    if kind == "ipv6":
        made = ipaddress.IPv6Address(bytes.fromhex(new))
        groups = [g for g in text.split(":") if g]
        full = made.compressed if "::" in text else made.exploded if all(len(g) == 4 for g in groups) else ":".join(f"{int(g, 16):x}" for g in made.exploded.split(":"))
        return full.upper() if text.upper() == text else full
    if kind in ("card", "phone", "ssn", "iban") and len(new) != len(text):
        places = [i for i, c in enumerate(text) if c.isalnum()][-len(new) :]
        spelled = list(text)
        for i, c in zip(places, new, strict=True):
            spelled[i] = c
        return "".join(spelled)
    if kind == "email" and len(new) == len(text):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(text, new, strict=True))
    if kind == "name":  # its case, and the white space between its words
        words, gaps = new.split(" "), re.findall(r"\s+", text)
        old = text.split()
        if len(words) == len(old) == len(gaps) + 1:
            words = [n.upper() if len(o) > 1 and o.isupper() else n for n, o in zip(words, old, strict=True)]
            return "".join(x for pair in zip(words, [*gaps, ""], strict=True) for x in pair)
    return new


FOUND = pa.schema([("kind", pa.string()), ("key", pa.string())])


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct entities of all texts, by kind and canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found = {(e.kind, e.key) for t in batch.column(0).to_pylist() for e in find(t)}
            if found:
                kinds, keys = zip(*sorted(found), strict=True)
                yield record(FOUND, kind=kinds, key=keys)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, key string").distinct()


def _assign(table: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in batches:
            new = [plain(k, surrogate(cipher, k, e, a)) for k, e, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "key", "attempt", "new"])

    return table.select("kind", "key", "attempt").mapInArrow(run, "kind string, key string, attempt int, new string")


def plain(kind: str, new: str) -> str:
    return new if kind != "name" else f"/{new}"


def _shape(key: Column) -> Column:
    """What a permutation leaves of a canonical form."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(key, "[0-9]", "0"), r"\p{Ll}", "a"), r"\p{Lu}", "A")


def collisions(found: DataFrame, key: bytes, scratch: Scratch, most_rounds: int = 12) -> DataFrame:
    """Entities whose first surrogate is a real entity or another's surrogate, with a later attempt that isn't.

    Of entities that got one surrogate, the one with fewest attempts, then the first by its canonical
    form, keeps it; the others try again. Shapes so crowded that ``most_rounds`` attempts don't end it
    (address blocks, short numbers) go back to the first attempt, which is one permutation of the shape
    without fixed points: their surrogates are distinct and none is the entity itself, though one may be
    a real entity that is itself replaced. Names are not
    of one permutation, so their rounds go on.
    """
    real = found.select("kind", F.when(F.col("kind") == "name", F.concat(F.lit("/"), F.element_at(F.split("key", "/"), -1))).otherwise(F.col("key")).alias("new")).distinct()
    table = _assign(found.withColumn("attempt", F.lit(0)), key)
    for n in range(8 * most_rounds):
        table = scratch.keep(table, f"round{n}")
        claims = table.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "key")).alias("owner"))
        shared = table.join(claims.filter("n > 1"), ["kind", "new"]).filter(F.col("key") != F.col("owner.key")).select("kind", "key")
        again = table.join(real, ["kind", "new"], "left_semi").select("kind", "key").union(shared).distinct()
        if n >= most_rounds:
            again = again.filter("kind = 'name'")
        again = scratch.keep(again, f"again{n}")
        if again.isEmpty():
            return table.filter("attempt > 0").select("kind", "key", "attempt")
        if n == most_rounds - 1:  # whole shapes go back, so that one permutation serves each
            crowded = again.filter("kind <> 'name'").select("kind", _shape(F.col("key")).alias("shape")).distinct()
            shaped = table.withColumn("shape", _shape(F.col("key"))).join(crowded.withColumn("back", F.lit(1)), ["kind", "shape"], "left")
            table = _assign(shaped.select("kind", "key", F.when(F.col("back") == 1, 0).otherwise(F.col("attempt")).alias("attempt")), key)
            continue
        retry = F.col("attempt") + F.coalesce(F.col("one"), F.lit(0))
        table = _assign(table.join(again.withColumn("one", F.lit(1)), ["kind", "key"], "left").select("kind", "key", retry.alias("attempt")), key)
    raise RuntimeError(f"names still collide after {8 * most_rounds} attempts")


def session_key(spark: SparkSession, setting: str = "spark.loomgraph.surrogates.secret") -> bytes:
    """The key that a session's setting names; where none is set, a fresh one that the session keeps.

    Spark leaves settings with ``secret`` in their name out of logs and its pages.
    """
    if not spark.conf.get(setting, None):
        spark.conf.set(setting, secrets.token_hex(32))
    return hashlib.sha256(spark.conf.get(setting).encode()).digest()


def replace_entities(
    docs: DataFrame, *, key: bytes, most_broadcast: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Replace personal data and secrets of every whole text by keyed surrogates.

    Returns the columns of ``docs`` with the new text, then ``n_entities`` and ``kinds`` (both dropped
    and remade if ``docs`` has them). One entity gets one surrogate everywhere, however spelled; a
    surrogate keeps kind, format, script, case and, for names, gender. Values of one shape are permuted,
    so distinct ones stay distinct, and none stays what it is; what a permutation can't rule out is checked over the whole corpus:
    surrogates that equal a real entity, or each other, are drawn again. The attempts of those few are
    sent along while there are at most ``most_broadcast``; beyond that they are joined per document.
    Who holds ``key`` can say which entity a surrogate stands for, so callers bring their own.

    Null text: stays null, no entities. Very long texts: whole, like others. Null ids and ties: as other
    rows. Repeated rows: replaced alike. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(entities(docs, text_col), "found")
    retried = scratch.keep(collisions(found, key, scratch), "retried")
    kept = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    if retried.count() <= most_broadcast:
        attempts, extra = {(r[0], r[1]): r[2] for r in retried.collect()}, None
    else:
        attempts, extra = {}, _attempts_by_text(docs, retried, text_col)
        source = source.withColumn("__row", F.sha2(F.col(text_col), 256)).join(extra, "__row", "left").drop("__row")
    at, per_row = source.columns.index(text_col), extra is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in portions(batches, text_col):
            own = batch.column(batch.schema.get_field_index("__attempts")).to_pylist() if per_row else None
            texts, counts, kinds = [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                entities_, out, last = find(text), [], 0
                tries = {(e["kind"], e["key"]): e["attempt"] for e in own[i] or ()} if own else attempts
                for e in entities_:
                    new = surrogate(cipher, e.kind, e.key, tries.get((e.kind, e.key), 0))
                    out += [text[last : e.start], dressed(e.kind, e.text, new)]
                    last = e.end
                texts.append("".join([*out, text[last:]]) if out else text)
                counts.append(len(entities_))
                kinds.append(sorted({e.kind for e in entities_}))
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(kept))]
            names = [*batch.schema.names[: len(kept)], "n_entities", "kinds"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=names)

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    schema = schema.add("n_entities", T.LongType()).add("kinds", T.ArrayType(T.StringType()))
    return source.mapInArrow(run, schema)


def _attempts_by_text(docs: DataFrame, retried: DataFrame, text_col: str) -> DataFrame:
    """Per text (by its SHA-256) the later attempts its entities need."""
    schema = pa.schema([("__row", pa.string()), ("kind", pa.string()), ("key", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            rows = [(h, e.kind, e.key) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in find(t)]
            if rows:
                yield record(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    each = docs.select(F.sha2(F.col(text_col), 256).alias("__row"), F.col(text_col).alias("text")).mapInArrow(run, "__row string, kind string, key string").distinct()
    return each.join(retried, ["kind", "key"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "key", "attempt")).alias("__attempts"))
