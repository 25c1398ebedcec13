"""Surrogates for personal data: keyed, of the same type and format, distinct where the originals are, and the same throughout.

Entities are found in every whole text, in one scan. What has a format (numbers, addresses, secrets, dates) is sent through a
keyed permutation of all values of that format, which has no fixed point: digits stay digits, letters keep their case, checksums
hold, and two entities can't share a surrogate however full the pool is. Names and e-mail addresses are drawn from a keyed hash,
names by gender and script; a distributed pass over the distinct entities looks for collisions and draws again for the losers,
each time from a larger pool, until there are none.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words before or after a name and the gender they tell, parts of names in lower case, frequent surnames before a title.
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "doña": "f", "dr": "u", "prof": "u", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f"}
AFTER = {"先生": "m", "女士": "f", "小姐": "f"}
PARTICLES = "de la|de las|de los|de|del|da|das|do|dos|du|di|le|la|van der|van den|van de|van|von der|von|zu|ten|ter|bin|ibn|al|el|y".split("|")
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗"
#: Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "m"): "James John Robert Michael David Thomas Peter Paul Martin Lukas Hans Karl Pierre Jean Louis Carlos Juan Luis Miguel Andrew Simon Felix Oscar Hugo Victor Leo Adam Daniel Samuel Henry".split(),
    ("latin", "f"): "Mary Anna Susan Linda Laura Emma Julia Sophie Claire Marie Camille Greta Heidi Ursula Carmen Lucia Elena Isabel Sarah Alice Nina Clara Eva Martha Helen Nora Diana Irene Rosa Judith".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Виктор Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Вера Нина Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος Πέτρος Ανδρέας".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη Δέσποινα Χριστίνα".split(),
    ("cjk", "m"): list("伟强磊军勇杰涛明超刚平辉鹏华飞"),
    ("cjk", "f"): list("芳娜敏静丽艳秀娟霞燕玲桂莉红梅"),
}
SYLLABLES = {
    "latin": "bar bel cor dan dor fen gal har kel lan mar mor nel par ral sel tan tor val wen".split(),
    "cyrillic": "бар вел гор дан зор кел лан мар нор пал рад сел тан тор вал".split(),
    "greek": "βαρ γελ δορ καλ λαν μαρ νερ παλ ραδ σελ ταν".split(),
    "cjk": list("安博晨德恩方国海建康立宁庆荣思文晓雅永泽志"),
}
#: Kinds whose surrogates are drawn and checked for collisions; all others go through a permutation of their format.
DRAWN = ("email", "name_m", "name_f", "name_u")

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Entity patterns with a digit, tried in this order; earlier ones win where they overlap.
PATTERNS = [
    ("secret", r"(?<![0-9A-Za-z])(?:(?=[0-9a-f]*\d)[0-9a-f]{32,}|(?=[0-9A-F]*\d)[0-9A-F]{32,}|(?:AKIA|ghp_|sk-|xox[bp]-)[0-9A-Za-z_-]{12,})(?![0-9A-Za-z])"),
    ("keyed", r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<keyed>(?=[^\s\"']*\d)[0-9A-Za-z+/_.~-]{6,}(?<![.~-]))"),
    ("birth", r"(?<!\w)(?i:born(?: on)?|date of birth|birth ?date|dob|geboren am|née? le|nacid[oa] el)\W{1,3}(?P<birth>\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})(?!\d)"),
    ("passport", r"(?<!\w)(?i:passport(?: no\.?| number)?|reisepass(?:nummer)?|passeport|pasaporte)[ :#]{1,3}(?P<passport>(?=[A-Z0-9]*\d)[A-Z0-9]{6,9})(?!\w)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("mac", r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?P<sep>[:-])(?:[0-9A-Fa-f]{2}(?P=sep)){4}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:])"),
    ("ipv4", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\d-])|(?<![\d+])\+\d[\d .-]{6,14}\d(?!\d)"),
]
_find = re.compile("|".join(f"(?P<{kind}_>{pattern})" for kind, pattern in PATTERNS))
_digit = re.compile(r"\d")
_WORD_OF_NAME = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}’']+"
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_named = regex.compile(rf"(?<!\w)(?i:{_TITLE})\.? (?P<name>{_WORD_OF_NAME}(?:(?:-| (?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )*){_WORD_OF_NAME})*)(?!\w)")
_before = re.compile(rf"(?P<name>[{SURNAMES}][\u4e00-\u9fff]{{1,2}})(?={'|'.join(AFTER)})")

_goes_on = regex.compile(r"[ -]\p{Lu}")

Span = tuple[int, int, str, str, str]


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it a valid card number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def luhn_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def canonical(kind: str, raw: str) -> str | None:
    """The form in which two mentions of one entity are equal: separators don't count, case only in secrets. None: no entity."""
    if kind == "card":
        digits = re.sub(r"\D", "", raw)
        return digits if luhn_ok(digits) else None
    if kind == "iban":
        plain = raw.replace(" ", "")
        return plain if iban_check(plain[:2], plain[4:]) == plain[2:4] else None
    if kind in ("ssn", "phone"):
        return re.sub(r"\D", "", raw)
    if kind == "ipv4":
        return str(ipaddress.IPv4Address(".".join(str(int(x)) for x in raw.split("."))))
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(raw).exploded
        except ValueError:
            return None
    if kind == "mac":
        return re.sub(r"[:-]", "", raw).lower()
    if kind == "birth":
        try:
            day = datetime.date.fromisoformat(raw) if raw[4] == "-" else datetime.date(int(raw[6:]), int(raw[3:5]), int(raw[:2]))
        except ValueError:
            return None
        return day.isoformat() if BIRTHS[0] <= day.toordinal() < BIRTHS[1] else None
    return raw if kind in ("secret", "passport") else unicodedata.normalize("NFC", raw).lower()


#: Days that dates of birth are permuted among.
BIRTHS = (datetime.date(1880, 1, 1).toordinal(), datetime.date(2040, 1, 1).toordinal())


def entities(text: str | None) -> list[Span]:
    """(start, end, type, canonical entity, part) in the order of the text. Names carry gender: name_m, name_f or name_u; their part
    is the word (from 0, or -1 for the last) of the entity's name that the mention consists of, or empty for all."""
    if not text:
        return []
    found: list[Span] = []
    if "@" in text:
        found += [(*m.span(), "email", canonical("email", m.group()), "") for m in _EMAIL.finditer(text)]
    if _digit.search(text):
        for m in _find.finditer(text):
            kind = m.lastgroup[:-1]
            start, end = m.span(kind) if kind in ("keyed", "birth", "passport") else m.span()
            kind = "secret" if kind == "keyed" else kind
            entity = canonical(kind, text[start:end])
            if entity is not None and not any(a < end and start < b for a, b, *_ in found if a < end):
                found.append((start, end, kind, entity, ""))
    return sorted(found + _names(text, found))


def _names(text: str, taken: list[Span]) -> list[Span]:
    """Names with a title, and all mentions of them or of their first or last word in the same text.

    A single word that is the first or last one of exactly one longer name found here is that person; a title without gender
    takes the one told elsewhere in the text.
    """
    low, titled = text.lower(), []
    if any(f"{t} " in low or f"{t}. " in low for t in TITLES):
        for m in _named.finditer(text):
            start, end = m.span("name")
            titled.append((start, end, TITLES[text[m.start() : start].rstrip(" .").lower()]))
    if any(t in text for t in AFTER):
        titled += [(*m.span("name"), AFTER[text[m.end() : m.end() + 2]]) for m in _before.finditer(text)]
    if not titled:
        return []
    who: dict[str, str] = {}
    for start, end, gender in titled:
        name = canonical("name", text[start:end])
        if who.get(name, "u") == "u":
            who[name] = gender
    ends: dict[str, set[tuple[str, str]]] = {}
    for name in who:
        if len(words := re.split(r"[ -]", name)) > 1:
            for word, part in ((words[0], "0"), (words[-1], "-1")):
                ends.setdefault(word, set()).add((name, part))
    means = {word: next(iter(of)) for word, of in ends.items() if len(of) == 1}
    for name in [n for n in who if n in means]:  # Mr. Smith, once John Smith is known
        if who[means[name][0]] == "u":
            who[means[name][0]] = who[name]
        del who[name]
    forms = {text[a:b] for a, b, _ in titled}
    forms |= {w for f in forms for w in re.split(r"[ -]", f) if canonical("name", w) in means and len(w) > 2}
    again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(forms, key=lambda x: (-len(x), x))))})(?!\w)")
    spots = sorted({(a, b) for a, b, _ in titled} | {m.span() for m in again.finditer(text)}, key=lambda s: (s[0], -s[1]))
    out, last, taken = [], 0, sorted(taken)
    for a, b in spots:
        if a < last or any(x < b and a < y for x, y, *_ in taken):
            continue
        name = canonical("name", text[a:b])
        name, part = (name, "") if name in who else means.get(name, (name, ""))
        if part == "0" and _goes_on.match(text, b):
            continue  # John Miller is not John Smith
        if name in who:
            out.append((a, b, f"name_{who[name]}", name, part))
            last = b
    return out


def script_of(text: str) -> str:
    """The script of a text's first letter, as Unicode names it: latin, cyrillic, greek, cjk, hangul, arabic and so on."""
    letter = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(letter, "LATIN").split()[0].lower()


# --- permutations of a format


def _round(key: bytes, tweak: bytes, n: int, value: int, bits: int) -> int:
    raw = hmac.digest(key, b"%b|%d|%d" % (tweak, n, value), hashlib.sha256)
    return int.from_bytes(raw * (1 + bits // 256), "big") & ((1 << bits) - 1)


def _feistel(key: bytes, tweak: bytes, size: int, x: int, back: bool = False) -> int:
    """A keyed permutation of range(size): eight Feistel rounds over the next even number of bits, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for n in range(8):
            if back:
                left, right = right ^ _round(key, tweak, 7 - n, left, half), left
            else:
                left, right = right, left ^ _round(key, tweak, n, right, half)
        x = left << half | right
        if x < size:
            return x


def permuted(key: bytes, tweak: str, size: int, x: int) -> int:
    """A keyed permutation of range(size) without a fixed point (for size > 1): one cycle through all of it, in hidden order."""
    if size < 2:
        return x
    name = tweak.encode()
    shift = 1 + int.from_bytes(hmac.digest(key, b"shift|" + name, hashlib.sha256), "big") % (size - 1)
    return _feistel(key, name, size, (_feistel(key, name, size, x) + shift) % size, back=True)


_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def masked(key: bytes, kind: str, text: str, letters: tuple[str, str] = (_LOW, _UP)) -> str:
    """The text with its digits and letters permuted among all texts of the same mask; other characters stay."""
    sets = [_NUM if c in _NUM else next((s for s in letters if c in s), c) for c in text]
    value, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        value, size = value * len(s) + s.index(c), size * len(s)
    mask = "".join("9" if s == _NUM else "a" if s == letters[0] else "A" if s == letters[1] else c for c, s in zip(text, sets, strict=True))
    value, out = permuted(key, f"{kind}|{mask}|{len(letters[0])}", size, value), []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    return "".join(reversed(out))


def _same_class(step: Callable[[str], str], of: Callable[[str], object], x: str) -> str:
    """Walks a permutation until it is back in the class of x: a permutation of that class, again without a fixed point."""
    mine, y = of(x), step(x)
    while of(y) != mine:
        y = step(y)
    return y


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NETS = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "0.0.0.0/8", "224.0.0.0/3")]


def _ip_class(x: str) -> int:
    at = ipaddress.ip_address(x)
    return next((k for k, n in enumerate(_NETS) if at in n), -1)


def formatted(kind: str, entity: str, key: bytes) -> str:
    """The surrogate of an entity that has a format, in canonical form."""
    if kind == "secret":
        head = re.match(r"(?:AKIA|ghp_|sk-|xox[bp]-)?", entity).group()
        body = entity[len(head) :]
        if _HEX.fullmatch(body):
            return head + masked(key, f"{kind}|{head}", body, (_LOW[:6], _UP[:6]))
        return head + _same_class(lambda x: masked(key, f"{kind}|{head}", x), lambda x: bool(_HEX.fullmatch(x)), body)
    if kind == "passport":
        return masked(key, kind, entity)
    if kind == "card":
        body = entity[0] + masked(key, f"{kind}|{entity[0]}", entity[1:-1])
        return body + luhn_digit(body)
    if kind == "iban":
        rest = masked(key, f"{kind}|{entity[:2]}", entity[4:])
        return entity[:2] + iban_check(entity[:2], rest) + rest
    if kind == "ssn":
        return masked(key, kind, entity)
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        lead = lambda x: min(int(x[0]), 2)  # noqa: E731  0, 1, or a digit that numbers begin with
        return entity[:keep] + _same_class(lambda x: masked(key, f"{kind}|{entity[:keep]}", x), lead, entity[keep:])
    if kind == "ipv4":
        net = _NETS[k] if (k := _ip_class(entity)) >= 0 else None
        if net:
            base = int(net.network_address)
            return str(ipaddress.IPv4Address(base + permuted(key, f"{kind}|{net}", net.num_addresses, int(ipaddress.IPv4Address(entity)) - base)))
        return _same_class(lambda x: str(ipaddress.IPv4Address(permuted(key, kind, 1 << 32, int(ipaddress.IPv4Address(x))))), _ip_class, entity)
    if kind == "ipv6":
        number = int(ipaddress.IPv6Address(entity))
        head, rest = number >> 112, number & ((1 << 112) - 1)
        return ipaddress.IPv6Address(head << 112 | permuted(key, f"{kind}|{head}", 1 << 112, rest)).exploded
    if kind == "mac":
        return f"{permuted(key, kind, 1 << 48, int(entity, 16)):012x}"
    day = datetime.date.fromisoformat(entity).toordinal() - BIRTHS[0]
    return datetime.date.fromordinal(BIRTHS[0] + permuted(key, kind, BIRTHS[1] - BIRTHS[0], day)).isoformat()


# --- draws


class Draw:
    """A keyed stream of numbers for one entity and one attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int) -> None:
        self.seed, self.block, self.left = f"{kind}\0{entity}\0{attempt}".encode(), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.left) < 6:
            self.left += hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256)
            self.block += 1
        taken, self.left = self.left[:6], self.left[6:]
        return int.from_bytes(taken, "big") % n

    def of(self, items):
        return items[self.below(len(items))]


def _syllables(script: str, name: str) -> list[str]:
    """Syllables of a script; of one without a list, its letters near those of the name."""
    if script in SYLLABLES:
        return SYLLABLES[script]
    base = ord(next(c for c in name if c.isalpha())) // 64 * 64
    return [chr(c) for c in range(base, base + 64) if chr(c).isalpha() and chr(c) == chr(c).lower()] or [name[:1]]


def draw(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """A surrogate of a canonical name or e-mail address, in canonical form; each attempt draws from a larger pool."""
    d = Draw(key, kind, entity, attempt)
    if kind == "email":
        local = "".join(d.of(_NUM) if c.isdigit() else d.of(_LOW) if c.isalpha() else c for c in entity.partition("@")[0])
        return f"{local}{''.join(d.of(_NUM + _LOW) for _ in range(3 + attempt))}@example.{d.of(['org', 'net', 'com'])}"
    script, gender = script_of(entity), kind[-1]
    gender = gender if gender in "mf" else d.of("mf")
    several = bool(re.search(r"[ -]", entity))
    if script == "cjk" and not several:
        return d.of(SURNAMES) + "".join(d.of(GIVEN[script, gender] + SYLLABLES[script]) for _ in range(1 + attempt)) + d.of(GIVEN[script, gender])
    last = "".join(d.of(_syllables(script, entity)) for _ in range((3 if script in SYLLABLES else 6) + d.below(2) + attempt))
    given = GIVEN.get((script, gender))
    first = d.of(given) if given else "".join(d.of(_syllables(script, entity)) for _ in range(4))
    return f"{first} {last}".lower() if several else last


def dress(kind: str, raw: str, surrogate: str, part: str = "") -> str:
    """The canonical surrogate in the format of the mention: its separators, its case, its part of a name."""
    if kind in ("card", "ssn", "phone", "iban", "mac"):
        rest = iter(surrogate.upper() if kind == "mac" and raw.upper() == raw else surrogate)
        return "".join(next(rest) if c.isalnum() else c for c in raw)
    if kind == "ipv6":
        plain = str(ipaddress.IPv6Address(surrogate)) if "::" in raw else surrogate
        return plain.upper() if raw.upper() == raw else plain
    if kind == "birth":
        y, m, d = surrogate.split("-")
        return surrogate if raw[4] == "-" else f"{d}{raw[2]}{m}{raw[2]}{y}"
    if kind == "email":
        local, _, domain = surrogate.partition("@")
        return surrogate.upper() if raw.isupper() else f"{local.upper()}@{domain}" if raw.partition("@")[0].isupper() else surrogate
    if kind.startswith("name"):
        words = surrogate.split(" ")
        words = [words[int(part)]] if part else words
        sep = "-" if "-" in raw and " " not in raw else " "
        return surrogate.upper() if raw.isupper() and raw.lower() != raw and len(words) > 1 else sep.join(w.upper() if raw.isupper() and raw.lower() != raw else w.capitalize() for w in words)
    return surrogate


_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string()), ("part", pa.string())])
_SPAN_DDL = "doc_id long, th long, start int, end int, kind string, entity string, part string"


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, h, *e) for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) for e in entities(text.as_py())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SPAN, strict=True)], schema=_SPAN)


_DRAWN = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])
_DRAWN_DDL = "kind string, entity string, surrogate string"


def _made(key: bytes, attempt: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [draw(k, e, attempt, key) if k in DRAWN else formatted(k, e, key) for k, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], schema=_DRAWN)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, end, kind, entity, part) of each mention in docs; th is xxhash64 of the text. Written as a table."""
    return materialise(_keyed(docs).mapInArrow(_spans, _SPAN_DDL).distinct(), "pii-spans")


def surrogate_table(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate): every distinct entity of find() once, no two of a class with the same surrogate.

    A person met with and without a gender in different documents is one where a single gender is told. A drawn surrogate that
    some entity of the class is, or that a smaller entity drew as well, is drawn again from a larger pool; entities without a
    collision keep theirs, so only the few losers are looked at again. Permuted ones can't collide: none is its own entity, but
    in a pool that is full each of them is somebody else's.
    """
    every = found.select("kind", "entity").distinct()
    told = every.filter("kind IN ('name_m', 'name_f')").groupBy("entity").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).filter("low = high").select("entity", F.col("low").alias("told"))
    every = every.join(told, "entity", "left").select("kind", "entity", F.when(F.col("kind") == "name_u", F.coalesce("told", "kind")).otherwise(F.col("kind")).alias("as_kind"))
    every = materialise(every, "pii-entities")
    fixed = every.filter(~F.col("kind").isin(*DRAWN)).select("kind", "entity").mapInArrow(_made(key, 0), _DRAWN_DDL)
    cls = F.substring_index("kind", "_", 1)
    todo = every.filter(F.col("kind").isin(*DRAWN)).select(F.col("as_kind").alias("kind"), "entity").distinct()
    names = todo.select(cls.alias("cls"), F.col("entity").alias("surrogate")).distinct()
    settled: DataFrame | None = None
    attempt = 0
    while not todo.isEmpty():
        drawn = materialise(todo.mapInArrow(_made(key, attempt), _DRAWN_DDL).withColumn("cls", cls), "pii-drawn")
        first = drawn.groupBy("cls", "surrogate").agg(F.min(F.struct("entity", "kind")).alias("first"))
        won = drawn.join(first, ["cls", "surrogate"]).filter((F.col("first.entity") == F.col("entity")) & (F.col("first.kind") == F.col("kind")))
        won = won.join(names, ["cls", "surrogate"], "left_anti").select("cls", "kind", "entity", "surrogate")
        won = won if settled is None else won.join(settled.select("cls", "surrogate"), ["cls", "surrogate"], "left_anti")
        won = materialise(won, "pii-won")
        settled = won if settled is None else settled.unionByName(won)
        todo = materialise(todo.join(won, ["kind", "entity"], "left_anti").select("kind", "entity"), "pii-left")
        attempt += 1
    if settled is None:
        return fixed
    both = every.join(settled.select(F.col("kind").alias("as_kind"), "entity", "surrogate"), ["as_kind", "entity"]).select("kind", "entity", "surrogate")
    return fixed.unionByName(both)


_CLEAN = pa.schema([("doc_id", pa.int64()), ("n_entities", pa.int64()), ("text", pa.string())])


def _replacer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, texts = [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, out, at, spans = text.as_py(), [], 0, spans.as_py() or []
            for s in sorted(spans, key=lambda s: s["start"]):
                out += [text[at : s["start"]], dress(s["kind"], text[s["start"] : s["end"]], s["surrogate"], s["part"])]
                at = s["end"]
            counts.append(len(spans))
            texts.append("".join([*out, text[at:]]) if spans else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], schema=_CLEAN)


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_entities, text for each row of docs(doc_id, text, ...): the whole text with every entity replaced.

    Emails, secrets (also what follows password=, token: and the like), IBANs, IP and MAC addresses, card (with a valid check
    digit), social-security, passport and phone numbers, dates of birth, and names with a title are entities; of such a name also
    its other mentions in the text, in whole or by its first or last word. The same entity (up to separators and case) has the
    same surrogate in all documents, and different ones of a class never share one. Null text stays null; rows equal in doc_id
    and text are told apart only by their number; a null doc_id is fine. Other columns are not read. The same key gives the same
    surrogates; an empty key is refused; an empty table gives an empty one.
    """
    if not key:
        raise ValueError("surrogates need a key")
    found = find(docs)
    table = materialise(surrogate_table(found, key), "pii-surrogates")
    told = found.join(table, ["kind", "entity"])
    by_doc = told.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate", "part")).alias("spans"))
    k, s = _keyed(docs).alias("k"), by_doc.alias("s")
    both = k.join(s, F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("k.th") == F.col("s.th")), "left").select("k.doc_id", "k.text", "s.spans")
    return both.mapInArrow(_replacer, "doc_id long, n_entities long, text string")
