"""Personal data replaced by keyed surrogates of the same type and form."""

from __future__ import annotations

import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
DIGITS = "0123456789"
LATIN = "abcdefghijklmnopqrstuvwxyz"
LATIN_MORE = "ßøæœðþłđħŋ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# Forms of address, given names by gender, country calling codes, scripts that set no space between words.
TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Dr", "Prof", "Contact", "Name")
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "David", "Thomas", "Paul", "Peter", "Hans", "Klaus", "Pierre", "Jean", "Louis", "Carlos", "Juan", "Pedro"),
    "f": ("Mary", "Anna", "Linda", "Sarah", "Emma", "Laura", "Julia", "Karin", "Greta", "Marie", "Claire", "Sophie", "Maria", "Carmen", "Elena", "Lucia"),
}

COUNTRY = r"(?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d{2})"
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "LAO", "KHMER", "MYANMAR")

_SEP = "[ .\u00a0\u202f/-]"
_PHONES = (
    rf"(?:\+|00)1{_SEP}?(?:\(\d{{3}}\)|\d{{3}}){_SEP}?\d{{3}}{_SEP}?\d{{4}}",  # North America
    rf"{COUNTRY}(?:{_SEP}?\(\d{{1,5}}\))?(?:{_SEP}?\d){{6,12}}",  # any other country
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}",
    rf"(?:0[1-9]|[6-9]\d{{2}}(?={_SEP}\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{2}}(?!\d)))(?:{_SEP}\d{{2}}){{3,4}}",  # in pairs
    rf"(?:\(0[1-9]\d{{0,3}}\){_SEP}?|0[1-9]\d{{0,3}}{_SEP})\d{{5,8}}",  # area code and an undivided number
    r"0[1-9]\d{8,9}",
)
_MARKS = "".join(c for c in map(chr, range(0x300, 0x12000)) if unicodedata.category(c) in ("Mn", "Mc"))
_NAME = rf"[^\W\d_a-z](?:[^\W\d_]|[{_MARKS}])+"
PATTERNS: dict[str, re.Pattern] = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}"),
    "aws_key": re.compile(r"\b(?:AKIA|ASIA)[A-Z2-7]{16}\b"),
    "secret": re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_\-]{8,})"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ipv4": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "card": re.compile(r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(rf"(?<![\w.+])(?:{'|'.join(_PHONES)})(?![\d])"),
    "name": re.compile(rf"\b(?:{'|'.join(TITLES)})\b(?:\.|:)?\s+(?P<v>{_NAME}(?:\s{_NAME})?)"),
}
_DIGIT = re.compile("[0-9]")
_WORDS = ("token", "secret", "passw", "api")
_TOKEN = re.compile(rf"[\w{_MARKS}]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Keyed:
    """Replacements under a key of strings over an alphabet, keeping the length: one for each, never a string itself.

    A Feistel network permutes the strings of one length and tweak. A string's replacement is the one that the network
    maps next to it: what stands behind it in the order of the images. So all strings of a length lie on one cycle, on which each
    moves a step: different ones stay different, and none stays as it is.
    """

    def __init__(self, key: bytes):
        self.key = key

    def _number(self, tweak: str, round_: int, half: tuple[int, ...], size: int) -> int:
        mac = hmac.digest(self.key, f"{tweak}|{round_}|{','.join(map(str, half))}".encode(), "sha256")
        return int.from_bytes(mac, "big") % size

    def _network(self, values: list[int], radix: int, tweak: str, back: bool) -> list[int]:
        m = len(values) // 2
        a, b = values[:m], values[m:]
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            target, other = (a, b) if r % 2 == 0 else (b, a)
            size, x = radix ** len(target), 0
            for v in target:
                x = x * radix + v
            by = self._number(tweak, r, tuple(other), size)
            x = (x - by if back else x + by) % size
            for i in range(len(target) - 1, -1, -1):
                x, target[i] = divmod(x, radix)
        return a + b

    def permute(self, values: list[int], radix: int, tweak: str) -> list[int]:
        """The replacement of a list of numbers below radix."""
        if radix < 2 or not values:
            return values
        if len(values) == 1:
            return [(values[0] + self._number(tweak, 0, (), radix - 1) + 1) % radix]
        image = self._network(values, radix, tweak, back=False)
        for i in range(len(image) - 1, -1, -1):
            image[i] = (image[i] + 1) % radix
            if image[i]:
                break
        return self._network(image, radix, tweak, back=True)

    def letters(self, text: str, alphabet: str, tweak: str, keep: Callable[[int], bool] = lambda i: False) -> str:
        """The characters of the alphabet (in either case) replaced as one string, case and all else kept."""
        at = [i for i, c in enumerate(text) if c.lower() in alphabet and not keep(i)]
        if not at:
            return text
        form = "".join("A" if c.isupper() else "a" if c.lower() in alphabet else c for c in text)
        out = list(text)
        for i, v in zip(at, self.permute([alphabet.index(text[i].lower()) for i in at], len(alphabet), f"{tweak}|{form}")):
            out[i] = alphabet[v].upper() if text[i].isupper() else alphabet[v]
        return "".join(out)

    def opaque(self, text: str, tweak: str) -> str:
        """Small letters by a keyed hash of the text, one for each character: for texts that have nothing to replace."""
        mac = b"".join(hmac.digest(self.key, f"{tweak}|{k}|{text}".encode("utf-8", "replace"), "sha256") for k in range(len(text) // 32 + 1))
        return "".join(LATIN[b % len(LATIN)] for b in mac[: len(text)])


@lru_cache(10_000)
def script_of(c: str) -> str:
    """The first word of a letter's name, such as LATIN or CJK."""
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(1000)
def block(script: str, start: int, end: int) -> str:
    """The letters of a script in a range of code points, without upper-case ones."""
    return "".join(c for c in map(chr, range(start, end)) if c.isalpha() and c.lower() == c and script_of(c) == script)


def block_of(c: str) -> str:
    code = ord(c.lower()[0])
    for start, end in ((0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x3400, 0x4DC0), (0x20000, 0x2A6E0)):
        if start <= code < end:
            return block(script_of(c), start, end)
    return block(script_of(c), code & ~127, (code | 127) + 1)


def alphabets_of(text: str) -> list[str]:
    """The alphabets of a decomposed text: of Latin, Greek and Cyrillic letters, else of the Unicode block."""
    known = {"LATIN": LATIN, "GREEK": GREEK, "CYRILLIC": CYRILLIC}
    found = set()
    for c in text:
        if c.isalpha():
            own = known.get(script_of(c), "")
            found.add(own if c.lower() in own else LATIN_MORE if c.lower() in LATIN_MORE else block_of(c))
    return sorted(a for a in found if len(a) > 1)


def iban_check(country: str, bban: str) -> int:
    """The check digits of an IBAN."""
    return 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


class Surrogates:
    """Replacements of one key. The same entity gets the same one everywhere, different ones of a kind different ones.

    Each kind and form is replaced within itself by a keyed bijection without fixed points, so this holds in the whole corpus
    without any look at what else it holds. Only what has neither letters nor digits is replaced by a keyed hash.
    """

    def __init__(self, key: bytes):
        self.keyed = Keyed(key)
        self.pools = {}
        for g, names in GIVEN.items():
            order = sorted(names, key=lambda n: hmac.digest(key, f"{g}|{n}".encode(), "sha256"))
            self.pools |= dict(zip(order, order[1:] + order[:1]))

    def make(self, kind: str, value: str) -> str:
        new = self._made(kind, value)
        return new if new != value else self.keyed.opaque(value, kind)

    def _made(self, kind: str, value: str) -> str:
        k = self.keyed
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            new = self.scripts(k.letters(local, DIGITS, "local"), "local")
            return f"{new if new != local else k.opaque(local, 'local')}@{self.scripts(host, 'host')}.{top}"
        if kind == "ipv4":
            return ".".join(map(str, k.permute([int(o) for o in value.split(".")], 256, kind)))
        if kind == "card":
            digits = [int(c) for c in value if c.isdigit()]
            while True:  # on along the cycle of all numbers to the next that passes the check
                digits = k.permute(digits, 10, kind)
                if luhn("".join(map(str, digits))):
                    break
            rest = iter(digits)
            return "".join(str(next(rest)) if c.isdigit() else c for c in value)
        if kind == "phone":
            country = len(re.match(rf"(?:{COUNTRY}|0(?=[1-9]))?", value)[0])
            return k.letters(value, DIGITS, kind, keep=lambda i: i < country)
        if kind == "ssn":
            return k.letters(value, DIGITS, kind)
        if kind == "iban":
            return self.iban(value)
        if kind == "aws_key":
            return value[:4] + "".join(BASE32[v] for v in k.permute([BASE32.index(c) for c in value[4:]], 32, kind))
        if kind == "secret":
            for digits in (HEX, HEX.upper()):
                if all(c in digits for c in value):
                    return "".join(digits[v] for v in k.permute([digits.index(c) for c in value], 16, kind))
            return k.letters(k.letters(value, DIGITS, kind), LATIN, kind)
        return " ".join(self.given(part) for part in value.split())

    def iban(self, value: str) -> str:
        """Country and form stay. The check digits fit if they did before; else they miss by as much."""
        bare = value.replace(" ", "")
        miss = int(bare[2:4]) - iban_check(bare[:2], bare[4:])
        rest = self.keyed.letters(self.keyed.letters(bare[4:], DIGITS, "iban"), LATIN, "iban")
        check = (iban_check(bare[:2], rest) - 2 + miss) % 97 + 2
        out = iter(f"{bare[:2]}{check:02}{rest}")
        return "".join(c if c == " " else next(out) for c in value)

    def scripts(self, text: str, tweak: str) -> str:
        """Letters replaced alphabet by alphabet; accents stay where they are."""
        text = "".join(c if script_of(c) == "HANGUL" else unicodedata.normalize("NFD", c) for c in text)
        for alphabet in alphabets_of(text):
            text = self.keyed.letters(text, alphabet, tweak)
        return unicodedata.normalize("NFC", text)

    def given(self, part: str) -> str:
        """A name of the pools becomes another of its gender; any other name none of these."""
        if part in self.pools:
            return self.pools[part]
        new = self.scripts(part, "name")
        while new in self.pools:
            new = self.scripts(new, "name")
        return new if new != unicodedata.normalize("NFC", part) else self.keyed.opaque(part, "name").capitalize()


def emails(text: str) -> Iterator[re.Match]:
    """The addresses of a text, looked for around each @ only."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        m = PATTERNS["email"].match(text, start)
        if m:
            yield m
        at = text.find("@", max(at + 1, m.end() if m else 0))


def mentions(text: str, parts: set[str]) -> Iterator[tuple[int, int]]:
    """Where the parts of found names stand as words, as they are or in upper case; in scripts without spaces anywhere."""
    known = parts | {p.upper() for p in parts}
    spans = [m.span() for m in _TOKEN.finditer(text) if m[0] in known]
    unspaced = [re.escape(p) for p in sorted(parts, key=lambda p: (-len(p), p)) if script_of(p[0]) in UNSPACED]
    if unspaced:
        spans = sorted({*spans, *(m.span() for m in re.finditer("|".join(unspaced), text))}, key=lambda s: (s[0], -s[1]))
    last = 0
    for a, b in spans:
        if a >= last:
            yield a, b
            last = b


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text; where two overlap, the earlier kind of PATTERNS stays.

    Names are those after a title, and every other mention of them or of a part of them.
    """
    found: list[tuple[int, int, str]] = []
    digit = _DIGIT.search(text) is not None
    lower = text.lower()
    there = {"email": "@" in text, "secret": any(w in lower for w in _WORDS), "name": any(t in text for t in TITLES), "aws_key": "AKIA" in text or "ASIA" in text}
    for kind, pattern in PATTERNS.items():
        if not there.get(kind, digit):
            continue
        for m in emails(text) if kind == "email" else pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            if kind == "card" and not luhn(re.sub(r"\D", "", m[0])):
                continue
            found.append((a, b, kind))
    rank = {k: i for i, k in enumerate(PATTERNS)}
    taken: list[tuple[int, int, str]] = []

    def place(e: tuple[int, int, str]) -> int | None:
        i = bisect(taken, e)
        return i if (not i or taken[i - 1][1] <= e[0]) and (i == len(taken) or taken[i][0] >= e[1]) else None

    for e in sorted(found, key=lambda e: (rank[e[2]], e[0])):
        i = place(e)
        if i is not None:
            taken.insert(i, e)
    parts = {p for a, b, kind in taken if kind == "name" for p in text[a:b].split()}
    more: list[tuple[int, int, str]] = []
    for a, b in mentions(text, parts) if parts else ():
        if place((a, b, "name")) is None:
            continue
        if more and text[more[-1][1] : a].isspace() and a - more[-1][1] == 1:
            a = more.pop()[0]
        more.append((a, b, "name"))
    return sorted(taken + more) if more else taken


def scrub(text: str, surrogates: Surrogates, cached: Callable | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced in order.

    Names are replaced part by part, so that each part stays the same in every mention, in upper case too.
    """
    entities = find(text)
    if not entities:
        return text, []
    make = cached or surrogates.make
    out, last = [], 0
    for a, b, kind in entities:
        out.append(text[last:a])
        if kind == "name":
            for part in re.split(r"(\s+)", text[a:b]):
                upper = len(part) > 1 and part.isupper() and part.lower() != part
                out.append(make(kind, part.capitalize()).upper() if upper else make(kind, part) if part and not part.isspace() else part)
        else:
            out.append(make(kind, text[a:b]))
        last = b
    return "".join([*out, text[last:]]), [k for _, _, k in entities]


def pii_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text with surrogates, n_entities and kinds (distinct, sorted, comma-joined) for each row.

    Entities are those of PATTERNS. Under one key an entity has one surrogate in the whole corpus, and different ones of a
    kind have different ones, without any exchange between tasks, as each kind and form is permuted within itself; no original
    stays. Forms, scripts, the gender of given names, country codes and check digits stay. A null text stays null with no
    entities; empty texts and texts without entities stay as they are; repeated rows come out alike; of entities that tie in a
    place the kind that PATTERNS has first is taken; long texts are read whole; an empty table gives no rows; further columns aren't read.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        cached = lru_cache(100_000)(surrogates.make)
        for batch in batches:
            texts, counts, kinds = [], [], []
            for v in batch.column(1):
                text = v.as_py()
                new, found = scrub(text, surrogates, cached) if text else (text, [])
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(sorted(set(found))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [id_col, "text", "n_entities", "kinds"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
