"""Operator 7: personal data, replaced by format-preserving Feistel pseudonyms.

Each validated value is permuted, under a secret key, within the set of values of its own format:
a card number becomes another card number of the same length and a right check digit, a date
another date, and so on.  Equal values get equal pseudonyms in all documents, so they stay linked,
different values stay different, and the holder of the key can undo it.

A permutation of 0..n-1 is a Feistel network over a grid of at least n cells, walked along its
cycle until it is below n again.  Formats:

========  ====================================================  ==============================
kind      found and validated as                                permuted
========  ====================================================  ==============================
card      13 to 19 digits, Luhn check digit                     all but the check digit, renewed
iban      country, check digits, 11 to 30 letters and digits    the account part; check renewed
ssn       ddd-dd-dddd in the issued ranges; other spelling      within the issued ranges
          after ``ssn`` or ``social security number``
phone     +country and 7 to 14 digits, or (ddd) ddd-dddd;       the digits after the country
          0 and 8 to 11 digits in the usual groups              or the 0
ip        dotted quad, octets to 255, not after ``version``     the 32 bits
ipv6      all eight groups, or ``::`` and three at least        digits and letters a to f
date      yyyy-mm-dd, and d.m.yyyy, d/m/yyyy, d-m-yyyy or,      days of 1900 to 2099 that have
          where that is no day, m/d/yyyy, m-d-yyyy              the same number of digits
email     local@domain.tld, letters of any script, any length   letters and digits before the tld
key       AKIA, ASIA and 16 capitals and digits, ghp_ and 36,   what follows the prefix
          AIza and 35, sk- and 20 or more, xoxb- and the like
secret    password, token, secret or api key = value, bearer    the value; hexadecimal stays so
          and a token, a PEM private key
========  ====================================================  ==============================

Numbers that fail their check stay as they are.  With ``bare_dates`` off, dates are only taken within 40
characters after a word for birth (``BIRTH``).  Of overlapping values the earlier wins, then
the kind named first above.  Values that are left of the format's range (a date of 1850) stay.

A card may stand among other numbers (an amount, its expiry, its CVV): in a run of digit groups every
span of groups is tried whose first group has four digits and whose inner ones have three, and of
overlapping valid ones the usual groupings win; other groupings only count as the longest match.  An
IBAN ends at its country's length; for a country without a known one, at the last border that is valid.
A phone number too long gives up groups at its end.

Edge cases: a NULL text stays NULL with no findings, an empty one empty.  Every row gets one
result; repeated rows get equal ones.  Columns other than the text are not looked at.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import math
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

ROUNDS = 8
DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
RESULT = "struct<text string, spans array<struct<start int, end int, kind string>>>"


#: Characters permuted as one.
BLOCK = 64


def _text(x: int) -> str:
    return str(x) if x.bit_length() <= 4096 else hex(x)


@functools.lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The characters that ``c`` may become: ASCII digits, small or capital letters, or the letters of its kind in its
    block of 256 code points; empty for all others."""
    if c.isascii():
        return next((k for k in (DIGITS, LOWER, UPPER) if c in k), "")
    kind, block = unicodedata.category(c), ord(c) & ~0xFF
    if kind not in ("Ll", "Lu", "Lo"):
        return ""
    return "".join(x for x in map(chr, range(block, block + 256)) if not x.isascii() and unicodedata.category(x) == kind)


def _hex_alphabet(c: str) -> str:
    return next((k for k in (DIGITS, "abcdef", "ABCDEF") if c in k), "")


class Pseudonyms:
    """Keyed permutations of numbers and of strings by character class."""

    def __init__(self, key: bytes, undo: bool = False):
        if not key:
            raise ValueError("a secret key is needed")
        self.key, self.undo = hashlib.sha256(key).digest(), undo

    def _round(self, what: str, i: int, half: int, limit: int) -> int:
        """A keyed number to be taken modulo ``limit``: at least 64 bits longer, so that all of a long half is mixed."""
        said = f"{what}|{i}|{_text(half)}".encode()
        if limit.bit_length() <= 128:
            return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=24).digest(), "big")
        inner = hashlib.blake2b(said, key=self.key).digest()
        parts = range(-(-(limit.bit_length() + 64) // 512))
        return int.from_bytes(b"".join(hashlib.blake2b(inner + k.to_bytes(8, "big"), key=self.key).digest() for k in parts), "big")

    def _once(self, x: int, a: int, b: int, what: str) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if self.undo else range(ROUNDS):
            sign = -1 if self.undo else 1
            if i % 2:
                right = (right + sign * self._round(what, i, left, b)) % b
            else:
                left = (left + sign * self._round(what, i, right, a)) % a
        return left * b + right

    def number(self, x: int, n: int, what: str) -> int:
        """The place of x in a permutation of range(n); ``what`` names the permutation."""
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        what = f"{what}|{_text(n)}"
        x = self._once(x, a, b, what)
        while x >= n:
            x = self._once(x, a, b, what)
        return x

    def chars(self, s: str, what: str, alphabet: Callable[[str], str] = _alphabet) -> str:
        """Digits, small and capital letters are permuted within their class (``alphabet``); others stay.

        Longer strings are permuted in blocks of ``BLOCK``, each keyed by the pseudonyms before it too."""
        if len(s) > BLOCK:
            out, said = [], hashlib.blake2b(what.encode(), key=self.key, digest_size=16)
            for at in range(0, len(s), BLOCK):
                old = s[at : at + BLOCK]
                new = self.chars(old, f"{what}|{said.hexdigest()}", alphabet)
                said.update((old if self.undo else new).encode("utf-8", "surrogatepass"))
                out.append(new)
            return "".join(out)
        kinds = [alphabet(c) for c in s]
        x, n = 0, 1
        for c, k in zip(s, kinds):
            if k:
                x, n = x * len(k) + k.index(c), n * len(k)
        shape = "".join({DIGITS: "d", LOWER: "a", UPPER: "A", "": "."}.get(k) or f"<{k[0]}>" for k in kinds)
        x, out = self.number(x, n, f"{what}|{shape}"), []
        for c, k in zip(reversed(s), reversed(kinds)):
            if k:
                x, i = divmod(x, len(k))
                c = k[i]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, s: str, what: str) -> str:
        """The digits of s are permuted, among numbers that begin with a digit other than 0 if s does."""
        d = re.sub(r"\D", "", s)
        low = 10 ** (len(d) - 1) if d[0] != "0" else 0
        high = 10 ** len(d) if low else 10 ** (len(d) - 1)
        new = iter(str(self.number(int(d) - low, high - low, f"{what}|{low}") + low).zfill(len(d)))
        return re.sub(r"\d", lambda _: next(new), s)


def luhn(digits: str) -> int:
    """The sum that is a multiple of 10 for a right check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def _iban_rest(country: str, account: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and not luhn(digits) % 10 and len(set(digits)) > 1


def _card(p: Pseudonyms, m: re.Match) -> str | None:
    s = m.group()
    if not _is_card(s):
        return None
    body = p.digits(s[:-1], "card")
    return body + str(-luhn(re.sub(r"\D", "", body) + "0") % 10)


def _iban(p: Pseudonyms, m: re.Match) -> str | None:
    s = m.group()
    bare = s.replace(" ", "")
    if IBAN_LENGTH.get(bare[:2], len(bare)) != len(bare):
        return None
    if not 15 <= len(bare) <= 34 or _iban_rest(bare[:2], bare[4:], bare[2:4]) != 1:
        return None
    account = p.chars(s[4:], "iban|" + bare[:2])
    return f"{bare[:2]}{98 - _iban_rest(bare[:2], account.replace(' ', ''), '00'):02d}{account}"


def _ssn(p: Pseudonyms, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m.group())
    a, g, n = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    x = p.number(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, "ssn")
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    new = iter(f"{a + 1 + (a >= 665):03d}{g + 1:02d}{n + 1:04d}")
    return re.sub(r"\d", lambda _: next(new), m.group())


def _phone_head(s: str) -> str:
    country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", s)
    return country.group() if country else ""


def _phone_digits(s: str) -> int:
    return sum(c.isdigit() for c in s[len(_phone_head(s)):])


def _phone(p: Pseudonyms, m: re.Match) -> str | None:
    s, head = m.group(), _phone_head(m.group())
    if not 7 <= _phone_digits(s) <= 14:
        return None
    return head + p.digits(s[len(head):], "phone|" + head)


def _ip(p: Pseudonyms, m: re.Match) -> str | None:
    octets = [int(x) for x in m.group().split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.group().split(".")):
        return None
    x = p.number(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _ipv6(p: Pseudonyms, m: re.Match) -> str | None:
    s = m.group()
    if sum(map(bool, s.split(":"))) < 3:  # a::b is as likely a name in code
        return None
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    return p.chars(s, "ipv6", _hex_alphabet)


@functools.lru_cache(maxsize=64)
def _days(order: str, first: int, second: int) -> list[int]:
    """The days of 1900 to 2099 whose day and month (``dm``) or month and day (``md``) have that many digits; two may begin with 0.

    A day that reads as ``dm`` too is none of ``md``."""
    days = map(datetime.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    sides = ((d, *((d.day, d.month) if order == "dm" else (d.month, d.day))) for d in days)
    return [d.toordinal() for d, a, b in sides if (first == 2 or a < 10) and (second == 2 or b < 10) and (order == "dm" or b > 12)]


def _day(y: str, m: str, d: str) -> int | None:
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _date(p: Pseudonyms, m: re.Match) -> str | None:
    mark = re.search(r"[-./]", m.group()).group()
    a, b, c = m.group().split(mark)
    if len(a) == 4:
        if (day := _day(a, b, c)) is None:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + p.number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        return f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"
    order, day = "dm", _day(c, b, a)
    if day is None and mark != "." and int(b) > 12:
        order, day = "md", _day(c, a, b)
    if day is None:
        return None
    days = _days(order, len(a), len(b))
    whole = len(days) == LAST_DAY - FIRST_DAY + 1
    new = datetime.date.fromordinal(days[p.number(bisect.bisect_left(days, day), len(days), "date" if whole else f"date|{order}{len(a)}{len(b)}")])
    x, y = (new.day, new.month) if order == "dm" else (new.month, new.day)
    return f"{x:0{len(a)}d}{mark}{y:0{len(b)}d}{mark}{new.year:04d}"


def _email(p: Pseudonyms, m: re.Match) -> str | None:
    head, dot, tld = m.group().rpartition(".")
    return p.chars(head, "email") + dot + tld


def _key(p: Pseudonyms, m: re.Match) -> str | None:
    head = m.group(m.lastindex)
    return head + p.chars(m.group()[len(head):], "key|" + head)


def _national(p: Pseudonyms, m: re.Match) -> str | None:
    s = m.group()
    if not 9 <= sum(c.isdigit() for c in s) <= 12:
        return None
    at = s.index("0") + 1
    return s[:at] + p.digits(s[at:], "phone|0")


def _secret(p: Pseudonyms, m: re.Match) -> str | None:
    s, value = m.group(), m.group(1)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        n = p.number(int(value, 16), 16 ** len(value), "secret")
        new = f"{n:0{len(value)}{'X' if re.search('[A-F]', value) else 'x'}}"
    else:
        new = p.chars(value, "secret")
    at = m.start(1) - m.start()
    return s[:at] + new + s[at + len(value):]


#: Characters of an IBAN by country.
IBAN_LENGTH = {c: n for n, some in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in some.split()}
IBAN_HEAD = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?= ?[A-Z0-9])", re.A)
WORD = re.compile(r"\w", re.A)
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}", re.A)
#: A card's first digit: not within a word, a number's fraction or a sign's number, but behind an abbreviation.
CARD_START = r"(?:(?<![\w.+-])|(?<=[^\d\s]\.)|(?<=[A-Za-z]-))"
CARD = re.compile(CARD_START + r"\d(?:[ -]?\d){12,18}(?![\w-])", re.A)
CARD_RUN = re.compile(CARD_START + r"\d+(?:[ -]\d+)*(?!\w)", re.A)
#: Digits of the groups of usual cards, the likelier first.
CARD_GROUPS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1)]
PHONE = re.compile(r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", re.A)


class _Whole:
    """A part of a text as a match object."""

    def __init__(self, text: str, start: int, end: int):
        self._span, self._s = (start, end), text[start:end]

    def span(self):
        return self._span

    def group(self):
        return self._s


def _cards(text: str) -> Iterator[_Whole]:
    """Valid cards that don't overlap."""
    for run in CARD_RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [(g.start(), g.end()) for g in re.compile(r"\d+", re.A).finditer(text, *run.span())]
        sizes = [b - a for a, b in groups]
        found = []
        for i, (start, _) in enumerate(groups):
            if sizes[i] < 4:
                continue
            n = 0
            for j in range(i, len(groups)):
                n += sizes[j]
                if n > 19 or j > i + 1 and sizes[j - 1] < 3:
                    break
                if n >= 13 and _is_card(text[start : groups[j][1]]):
                    shape = tuple(sizes[i : j + 1])
                    rank = -1 if i == j else CARD_GROUPS.index(shape) if shape in CARD_GROUPS else len(CARD_GROUPS)
                    found.append((rank, -n, start, groups[j][1]))
        found += [(len(CARD_GROUPS) + 1, 0, *m.span()) for m in CARD.finditer(text, *run.span()) if _is_card(m.group())]
        taken: set[int] = set()
        for _, _, start, end in sorted(found):
            if taken.isdisjoint(places := range(start, end)):
                taken.update(places)
                yield _Whole(text, start, end)


def _ibans(text: str) -> Iterator[_Whole]:
    """Valid IBANs that don't overlap; those of a country of known length go first."""
    taken: set[int] = set()
    heads = list(IBAN_HEAD.finditer(text))
    for known in (True, False):
        for m in heads:
            if (m.group()[:2] in IBAN_LENGTH) != known or m.start() in taken or not (rest := IBAN_REST.match(text, m.end())):
                continue
            for end in range(rest.end(), m.end() + 10, -1):
                if text[end - 1] == " " or WORD.match(text, end):
                    continue
                bare = text[m.start() : end].replace(" ", "")
                if 15 <= len(bare) <= 34 and IBAN_LENGTH.get(bare[:2], len(bare)) == len(bare) and _iban_rest(bare[:2], bare[4:], bare[2:4]) == 1:
                    if taken.isdisjoint(places := range(m.start(), end)):
                        taken.update(places)
                        yield _Whole(text, m.start(), end)
                    break


def _phones(text: str) -> Iterator[re.Match | _Whole]:
    at = 0
    while m := PHONE.search(text, at):
        at = m.end()
        if _phone_digits(m.group()) > 14:  # its longest part of whole groups that is short enough
            ends = [m.start() + g.end() for g in re.finditer(r"\d\)?(?=[ .-])", m.group())]
            if end := next((e for e in reversed(ends) if 7 <= _phone_digits(text[m.start() : e]) <= 14), 0):
                at = end
                yield _Whole(text, m.start(), end)
        else:
            yield m


#: Words for a birth, before a date.
BIRTH = re.compile(r"(?<![^\W\d_])(?:born|birth|birthday|birthdate|dob|d\.o\.b|geboren|geburtsdatum|geburtstag|naissance|nacimiento|nascita)(?![^\W\d_])", re.I)
VERSION = re.compile(r"(?<![^\W_])(?:version|release|build|firmware|v)[ .:=]{0,2}$", re.A | re.I)
QUAD = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.A)
DATE = re.compile(r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<mark>[./-])\d{1,2}(?P=mark)\d{4})(?:(?![\w/-]|\.\d)|(?=[Tt]\d{2}(?!\d{3})))", re.A)
SSN_SAID = re.compile(r"(?<![^\W_])(?:ssn|social security(?: (?:number|no\.?))?)(?: is)?[ :#=]{0,3}(\d{3} ?\d{2} ?\d{4})(?![\w-])", re.A | re.I)


def _ips(text: str) -> Iterator[re.Match]:
    """Dotted quads, but for version numbers."""
    return (m for m in QUAD.finditer(text) if not VERSION.search(text, max(0, m.start() - 12), m.start()))


def _said(text: str) -> Iterator[_Whole]:
    """Social security numbers without dashes, where the text says that they are."""
    return (_Whole(text, *m.span(1)) for m in SSN_SAID.finditer(text))


def _births(text: str) -> Iterator[re.Match]:
    """Dates near a word for birth."""
    return (m for m in DATE.finditer(text) if BIRTH.search(text, max(0, m.start() - 40), m.start()))


#: In the order in which they win ties: kind, what finds it in a text, pseudonym (None: not valid).
KINDS = [
    ("card", _cards, _card),
    ("iban", _ibans, _iban),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A).finditer, _ssn),
    ("ssn", _said, _ssn),
    ("phone", _phones, _phone),
    ("phone", re.compile(r"(?<![\w.,/+-])(?<!\d )(?:(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}[ /-])(?:\d{5,8}|\d{3,4}[ -]\d{3,5})|0[1-9](?:[ .]\d{2}){4})(?!\w|[.,/-]\d| \d{3})", re.A).finditer, _national),
    ("ip", _ips, _ip),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:):[0-9A-Fa-f:]{1,34}(?<!:)(?!\w|:[0-9A-Fa-f:]|\.\d)", re.A).finditer, _ipv6),
    ("date", DATE.finditer, _date),
    ("key", re.compile(r"(?<!\w)(?:(AKIA|ASIA)[A-Z0-9]{16}|(ghp_)[A-Za-z0-9]{36})(?!\w)", re.A).finditer, _key),
    ("key", re.compile(r"(?<![\w-])(?:(AIza)[\w-]{35}|(sk-)(?=[A-Za-z_-]*\d)[\w-]{20,}|(xox[abeoprs]-)(?=[A-Za-z-]*\d)[A-Za-z0-9-]{10,})(?![\w-])", re.A).finditer, _key),
    ("secret", re.compile(r"(?<![^\W_])bearer\s{1,3}((?=[A-Za-z._~+/-]*\d)[A-Za-z0-9._~+/-]{16,}=*)", re.A | re.I).finditer, _secret),
    ("secret", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:\s++[A-Za-z0-9-]+:[^\n]*)*\s*+([A-Za-z0-9+/=\s]{16,}+)(?=-----END)", re.A).finditer, _secret),
    ("secret", re.compile(r"(?<![^\W_])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?!bearer\s)([^\s\"'<>,;]{6,})", re.A | re.I).finditer, _secret),
]
EMAIL_TAIL = re.compile(r"(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}")
#: What a value of some kind must hold: texts without it aren't searched for that kind.
HINT = re.compile(
    r"\d[\d .()/-]{4}|A[KS]IA|ghp_|AIza|sk-|xox|[A-Z]{2}\d\d|[dntyDNTY][\"']?\s{0,3}[=:]|::|:[0-9A-Fa-f]{1,4}:|PRIVATE KEY|[eE][aA][rR][eE][rR]\s", re.A)


def _emails(text: str) -> Iterator[_Whole]:
    """Addresses in letters of any script.  What stands before an @ is read back to the first character that no address has,
    however far; such stretches hold no @, so all of them together are read once."""
    at = text.find("@")
    while at >= 0:
        if tail := EMAIL_TAIL.match(text, at + 1):
            start = at
            while start and ((c := text[start - 1]).isalnum() or c in "._%+-" or unicodedata.category(c) == "Mn"):
                start -= 1
            if start < at:
                yield _Whole(text, start, tail.end())
        at = text.find("@", at + 1)


def pseudonymise(text: str | None, p: Pseudonyms, bare_dates: bool = True) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where in the old text (characters) which kind was."""
    if not text:
        return text, []
    found: list[tuple[int, int, int, str, str]] = []
    if HINT.search(text):
        for rank, (kind, find, make) in enumerate(KINDS):
            for m in (_births if kind == "date" and not bare_dates else find)(text):
                if (new := make(p, m)) is not None:
                    found.append((m.span()[0], rank, m.span()[1], kind, new))
    found += [(m.span()[0], len(KINDS), m.span()[1], "email", _email(p, m)) for m in _emails(text)]
    if not found:
        return text, []
    out, spans, at = [], [], 0
    for start, _, end, kind, new in sorted(found):
        if start >= at:
            out += [text[at:start], new]
            spans.append((start, end, kind))
            at = end
    return "".join(out) + text[at:], spans


def pseudonyms(text: Column, key: bytes, undo: bool = False, bare_dates: bool = True) -> Column:
    """Column struct(text, spans) of a text column."""

    @F.arrow_udf(RESULT)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = Pseudonyms(key, undo)
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        for texts in batches:
            new, spans = [], []
            for t in texts:
                a, b = pseudonymise(t.as_py(), p, bare_dates)
                new.append(a)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(spans, pa.list_(kind))], ["text", "spans"])

    return apply(text)


def mask(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", bare_dates: bool = True) -> DataFrame:
    """Per document its id, the new ``text`` and ``spans`` of what was replaced."""
    both = docs.select(col(id_col), pseudonyms(col(text_col), key, bare_dates=bare_dates).alias("_p"))
    return both.select(col(id_col), F.col("_p.text").alias("text"), F.col("_p.spans").alias("spans"))
