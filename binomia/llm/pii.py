"""Surrogates for personal data: keyed, type-consistent, distinct, the same everywhere.

Detected entities are replaced by a keyed permutation of the texts of the same form, so
no table of replacements is needed and the same entity gets the same surrogate in every
document. Digits stay digits, letters keep case, script and vowel or consonant, separators
stay; card numbers keep their check digit's validity, addresses their network class, given
names their gender, phones their country code, mail addresses their top-level domain. A
permutation maps different entities to different surrogates, and as it is a single cycle,
none to itself; :func:`collisions` checks it on the entities found, and
:func:`distinct_key` changes the key by a fixed rule until there are none.

A name found behind a title or by a listed given name is replaced wherever the same text
mentions it again, whole, by its first or by its last word, so one person stays one: each word
of a name has one surrogate, whatever stands beside it. Names that are months or days, too,
stay where a date is meant. Other names without a title, addresses, bank accounts and phones
parted by blanks are out of reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv4Address, ip_network
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

KINDS = ("email", "phone", "ip", "card", "ssn", "name")
#: Entities whose surrogates one Python worker remembers before it starts afresh.
CACHE = 100_000

#: Given names by gender; a name keeps its list.
_FEMALE = "Alice Amelia Ana Anna Camille Carmen Charlotte Clara Elena Emily Emma Eva Hannah Helen Ines Julia Karin Laura Lea Louise Lucia Maria Marie Mary Nina Olga Paula Rosa Ruth Sofia Susan Ursula".split()
_MALE = "Adam Albert Andrew Anton Bernard Carlos Charles Daniel David Diego Felix Frank George Hans Henry Hugo James Jan John Jorge Karl Louis Lucas Martin Michael Oscar Otto Paul Peter Pierre Simon Thomas".split()

_LISTED = frozenset(_FEMALE + _MALE)
# Names of months and days that are names of people, too.
_CALENDAR = frozenset("March April May June July August Sunday Monday Friday Mai Mars Avril Juni Juli Abril Mayo Julio Agosto Domingo".split())
_ORDINAL = frozenset("April August Mai Juni Juli".split())  # behind "4."
#: What makes a date of them: a number behind, or a number or one of these words before.
_DATE_AFTER, _DATE_BEFORE = re.compile(r",? ?\d"), re.compile(r"(?:\d|\b(?:in|of|on|by|since|until|till|during|from|to|last|next|this|every|each|early|late|mid|im|am|vom|bis|seit|en|de|le|du|el|del|desde|hasta)) $", re.IGNORECASE)

#: Signs that belong to the letter before them, and joiners.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c) in ("Mn", "Mc")) + "\u200c\u200d"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IN, _CAPITAL = rf"[\w'’{_MARKS}-]", r"[^\W\d_a-zß-öø-ÿ]"
#: Titles before any word, and those that need a capital after them.
_ANY, _LEARNED = r"(?:Mrs|Mr|Ms|Miss|Mme|Herr|Frau|Señora|Señor)\b\.?", r"(?:Dr|Prof|Mx|Mlle|Sir|Dame|Fräulein|M(?=\.))\b\.?"
_TITLE, _GIVEN = rf"(?:{_ANY}|{_LEARNED})", "|".join(_FEMALE + _MALE)
_FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[^\W_][\w-]*(?:\.[\w-]+)+)"  # from the start of a run: long runs are tried once
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
    r"|(?<![\w.+-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.+-])(?:1\.)?\d{3}\.\d{3}\.\d{4}(?!\.?\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w))"
    rf"|(?P<name>\b(?:{_ANY} [^\W\d_]{_IN}*(?: {_CAPITAL}{_IN}*)?|{_LEARNED} {_CAPITAL}{_IN}*(?: {_CAPITAL}{_IN}*)?|(?:{_GIVEN}) {_CAPITAL}{_IN}+))"
)
_DIGITS, _LONG = re.compile(r"\d+"), re.compile(r"\d(?:[ -]?\d){12,18}(?!\w)")
#: A text without any of these has no entity.
_HINT = re.compile(rf"@|\d\d|\.\d|\b(?:M(?:rs|r|s|iss|me|lle|x)|Herr|Frau|Fräulein|Señora?|Dr|Prof|Sir|Dame)\b|\bM\. |(?:{_GIVEN}) ")

#: Letters that stand in for each other. Other letters and digits have those of their block, signs stay.
_CLASSES = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñćčďđģķłńňŕřśšťźżž",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ",
)
_CLASS = {c: k for k in _CLASSES for c in k}
#: Scripts of more than one block of 128 code points.
_WIDE = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xA000, 0xA490), (0xAC00, 0xD7B0), (0x20000, 0x2A6E0), (0x2A700, 0x323B0))


def _block(x: int) -> tuple[int, int]:
    return next((w for w in _WIDE if w[0] <= x < w[1]), (x & ~127, (x | 127) + 1))


def _kind(c: str) -> tuple | None:
    """What the class of a letter or digit outside :data:`_CLASSES` has in common; None for others."""
    kind = unicodedata.category(c)
    if kind[0] not in "LN" or c in _CLASS or _small(c) != c:
        return None
    return _block(ord(c)), kind, _small(c.upper()) == c != c.upper() if len(c.upper()) == 1 else False


def _small(c: str) -> str:
    """The lower case of a capital that comes back from it; other characters stay."""
    low = c.lower()
    return low if c.isupper() and len(low) == 1 and low.upper() == c else c


@lru_cache(maxsize=4096)
def _class(c: str) -> str:
    """The characters that may stand in for ``c``, which is one of them."""
    if c in _CLASS or (kind := _kind(c)) is None:
        return _CLASS.get(c, c)
    same = _members(kind)
    return same if len(same) > 1 else _lone()[kind[2]]


@lru_cache(maxsize=256)
def _members(kind: tuple) -> str:
    return "".join(d for d in map(chr, range(*kind[0])) if _kind(d) == kind)


@lru_cache(maxsize=1)
def _lone() -> dict[bool, str]:
    """Characters that are alone of their kind, by whether they have a capital."""
    seen: dict[tuple, str] = {}
    for c in map(chr, range(0x110000)):
        if (kind := _kind(c)) is not None:
            seen[kind] = c if kind not in seen else ""
    return {k: "".join(c for kind, c in seen.items() if c and kind[2] == k) for k in (False, True)}


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) that is one cycle: nothing but a lone value stays.

    Feistel rounds on two digits, repeated until inside, deal new places to the values; a
    fixed step that has no divisor in common with ``size`` leads from place to place.
    """
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a <<= 1
    b = -(-size // a)

    def part(x: int, r: int) -> int:
        return int.from_bytes(blake2b(f"{r}|{x}|{size}|{tweak}".encode(), key=key, digest_size=24).digest(), "big")

    while True:
        x, y = divmod(value, b)
        for r in range(0, 8, 2):
            x = (x + part(y, r)) % a
            y = (y + part(x, r + 1)) % b
        value = x * b + y
        if value < size:
            break
    step = 1 + part(0, 8) % (size - 1)
    while gcd(step, size) > 1:
        step -= 1
    value = (value + step) % size
    while True:
        x, y = divmod(value, b)
        for r in range(6, -2, -2):
            y = (y - part(x, r + 1)) % b
            x = (x - part(y, r)) % a
        value = x * b + y
        if value < size:
            return value


def letters(text: str, key: bytes, tweak: str) -> str:
    """Each letter and digit by another of its class, case kept; one number for all of them."""
    low = [_small(c) for c in text]
    sets = [_class(c) for c in low]
    value, size = 0, 1
    for c, s in zip(low, sets, strict=True):
        value, size = value * len(s) + s.index(c), size * len(s)
    if size == 1:
        return text
    form = "".join(s[0] for s in sets)
    value, out = permute(value, size, key, f"{tweak}|{form}"), []
    for c, l, s in zip(reversed(text), reversed(low), reversed(sets), strict=True):
        value, k = divmod(value, len(s))
        out.append(s[k] if c == l else s[k].upper())
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit's distance from a valid one."""
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in text)


def _card(text: str, key: bytes) -> str:
    digits = "".join(c for c in text if c.isdecimal())
    body = letters(digits[1:-1], key, "card")
    head = digits[0] + body
    check = next(d for d in range(10) if luhn(head + str(d)) == luhn(digits))
    return _refill(text, head + chr(ord(digits[-1]) - int(digits[-1]) + check))


#: Networks that keep their addresses to themselves.
_NETS = [ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/3", "0.0.0.0/8")]


def _net(x: int) -> int | None:
    return next((k for k, n in enumerate(_NETS) if IPv4Address(x) in n), None)


def _ip(text: str, key: bytes) -> str:
    x = int(IPv4Address(text))
    home = _net(x)
    if home is not None:
        first, size = int(_NETS[home].network_address), _NETS[home].num_addresses
        return str(IPv4Address(first + permute(x - first, size, key, f"ip{home}")))
    while True:
        x = permute(x, 1 << 32, key, "ip")
        if _net(x) is None:
            return str(IPv4Address(x))


def _phone(text: str, key: bytes) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|1(?=[-.])", text)
    at = code.end() if code else 0
    return text[:at] + letters(text[at:], key, f"phone{text[:at]}")


def _email(text: str, key: bytes) -> str:
    head, _, top = text.rpartition(".")
    return f"{letters(head, key, 'email' + top.lower())}.{top}"


def _word(word: str, key: bytes) -> str:
    """A word of a name: listed given names stand in for those of their list, others for words that aren't listed."""
    given = next((names for names in (_FEMALE, _MALE) if word in names), None)
    if given:
        return given[permute(given.index(word), len(given), key, given[0])]
    new = letters(word, key, "surname")
    while new in _LISTED:
        new = letters(new, key, "surname")
    return new


def _name(text: str, key: bytes) -> str:
    title, rest = re.match(rf"({_TITLE} )?(.*)", text, re.DOTALL).groups()
    return (title or "") + " ".join(_word(w, key) for w in rest.split(" "))


_MAKE = {"email": _email, "phone": _phone, "ip": _ip, "card": _card, "ssn": lambda t, k: letters(t, k, "ssn"), "name": _name}


class Surrogates:
    """Entities of a text and their surrogates under one key."""

    def __init__(self, key: str) -> None:
        self.key = blake2b(key.encode(), digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def of(self, kind: str, text: str) -> str:
        if (kind, text) not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[kind, text] = _MAKE[kind](text, self.key)
        return self.known[kind, text]

    def find(self, text: str | None) -> list[tuple[str, int, int, str]]:
        """(kind, start, stop, surrogate) of each entity, left to right."""
        if not text or not _HINT.search(text):
            return []
        out, at = [], 0
        while m := _FIND.search(text, at):
            kind, start, at = m.lastgroup, m.start(), m.end()
            if kind == "card" and luhn("".join(c for c in m.group() if c.isdecimal())):
                inside = _card_inside(text, start, at)
                if inside is None:  # what else may begin at a later group
                    at = next((g.start() for g in _DIGITS.finditer(text, start + 1, at) if not text[g.start() - 1].isdecimal()), at)
                    continue
                start, at = inside
            out.append((kind, start, at, self.of(kind, text[start:at])))
        return self._again(text, out)

    def _again(self, text: str, found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        """``found`` and the bare mentions of its names: whole names, and first and last words of them."""
        bare = set()
        for kind, start, stop, _ in found:
            if kind == "name":
                words = re.sub(rf"^{_TITLE} ", "", text[start:stop]).split(" ")
                bare |= {w for w in (" ".join(words), words[0], words[-1]) if len(w) > 2 and w[0].isupper()}
        if not bare:
            return found
        more = re.compile(rf"(?<!{_IN})(?:{'|'.join(map(re.escape, sorted(bare, key=lambda w: (-len(w), w))))})(?!{_IN})")
        free, out = 0, []
        for entity in [*found, (None, len(text), len(text), "")]:
            out += [("name", m.start(), m.end(), self.of("name", m.group())) for m in more.finditer(text, free, entity[1]) if not _dated(text, m)]
            free = entity[2]
            if entity[0]:
                out.append(entity)
        return out


def _dated(text: str, m: re.Match) -> bool:
    """A mention that is a month or a day of a date."""
    if m.group() not in _CALENDAR:
        return False
    before = text[max(0, m.start() - 12) : m.start()]
    ordinal = m.group() in _ORDINAL and re.search(r"\d\. $", before)
    return bool(_DATE_AFTER.match(text, m.end()) or _DATE_BEFORE.search(before) or ordinal)


def _card_inside(text: str, start: int, stop: int) -> tuple[int, int] | None:
    """The first, then longest run of whole digit groups from within a span that is a card's number."""
    for g in _DIGITS.finditer(text, start, stop):
        run = _LONG.match(text, g.start())
        if not run:
            continue
        for e in reversed(list(_DIGITS.finditer(text, g.start(), run.end()))):
            digits = "".join(c for c in text[g.start() : e.end()] if c.isdecimal())
            if len(digits) >= 13 and not luhn(digits):
                return g.start(), e.end()
    return None


def _replace(key: str):
    entity = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in sliced(batches):
            texts, entities = [], []
            for t in b.column(1).to_pylist():
                found, parts, at = made.find(t), [], 0
                for _, start, stop, new in found:
                    parts += [t[at:start], new]
                    at = stop
                texts.append("".join([*parts, t[at:]]) if found else t)
                entities.append([{"kind": k, "start": s, "stop": e} for k, s, e, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(entities, pa.list_(entity))], ["doc_id", "text", "entities"])

    return run


def _mentions(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in sliced(batches):
            rows = {(k, t[s:e], new) for t in b.column(0).to_pylist() for k, s, e, new in made.find(t)}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*sorted(rows), strict=True) if rows else [[], [], []])], ["kind", "entity", "surrogate"])

    return run


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Surrogates that two different entities of a kind share, or that equal their entity."""
    found = docs.select("text").mapInArrow(_mentions(key), "kind string, entity string, surrogate string").distinct()
    same = F.min("entity") != F.max("entity")
    return found.groupBy("kind", "surrogate").agg(F.min("entity").alias("one"), F.max("entity").alias("other"), same.alias("shared")).filter(
        F.col("shared") | (F.col("one") == F.col("surrogate"))
    )


#: Keys that :func:`distinct_key` tries.
TRIES = 8


def distinct_key(docs: DataFrame, key: str) -> str:
    """``key``, or the first of ``key#1``, ``key#2``, .. under which no surrogates of ``docs`` collide."""
    for k in range(TRIES):
        tried = key if k == 0 else f"{key}#{k}"
        if collisions(docs, tried).isEmpty():
            return tried
    raise RuntimeError(f"surrogates collide under {TRIES} keys: see collisions()")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, text, entities``; entities are replaced in the text.

    ``entities`` lists kind, start and stop (code points of the given text). Null texts
    stay null and, like empty ones, have no entities; texts of any length are searched
    whole. Where entities could overlap the leftmost wins, then the kind named first in
    ``_FIND``. Equal rows give equal rows; other columns are left out. Nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_replace(key), "doc_id long, text string, entities array<struct<kind:string,start:long,stop:long>>")
