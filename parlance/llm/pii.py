"""Operator 4: format-preserving pseudonyms of personal data by a keyed Feistel permutation.

Card numbers (Luhn), IBANs (mod 97), phone numbers (North American ones of
any area code where +1, brackets or separators show the form; others in international form), social security numbers, IPv4 addresses, IPv6 addresses, calendar
dates, e-mail addresses and credentials (named ones, bearer and service tokens, passwords in URLs, private keys) are found, validated, and permuted within their own format: separators, lengths,
letter cases, leading digits that carry the format, and check digits stay valid. A value's permutation depends on the key,
its kind and its canonical form only, so equal values get equal pseudonyms in all documents (also where they are written
with other separators, or a date with other separators, order or width), different values of a format get different ones, and who has the key can turn them back.

A date keeps whether its month and day are below 10 and its day above 12, so that every way to write it fits its pseudonym.
An IPv6 address is written in its shortest form. A word of one case without digits after "secret:" is prose and stays; so
does a number of four parts after "version".

Nulls stay null, empty texts empty. A value that doesn't validate is left alone. Texts are processed whole; no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.llm.shared import append_columns, slices

ROUNDS = 8
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)

#: One alternative for each kind, tried from left to right at each place.
FOUND = re.compile(
    r"""
    (?P<login>(?<=://)[^\s:/@]+:[^\s/@]+(?=@))
  | (?P<key>(?<=KEY-----)[A-Za-z0-9+/=\s]+(?=-----END))
  | (?P<email>(?<![\w.+-])(?<![\w.+-]')[\w.+-]++(?:'[\w.+-]++)*+(?=@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}))
  | (?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d))
  | (?P<phone>(?<![\w+])(?:
        (?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)
      | \+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)
      | \+\(?[2-9](?:[ .-]?\(?\d\)?){6,14}(?!\w|\.\d)
    ))
  | (?P<iban>(?<!\w)[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<date>(?<![\w.])(?:\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\w]|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
  | (?P<ip>(?<![\w.])(?<!version[ ])(?<!Version[ ])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
  | (?P<card>(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w))
  | (?P<access>(?<!\w)AKIA[0-9A-Z]{16}(?!\w))
  | (?P<token>(?<!\w)(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-)[A-Za-z0-9_-]{16,}|(?i:(?<!\w)bearer)[ ]+[A-Za-z0-9_.~+/=-]{16,})
  | (?P<secret>(?i:password|passwd|pwd|token|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}["']?[A-Za-z0-9_\-]{8,})
    """,
    re.X,
)
#: Texts without any of these hold none of the kinds.
HINT = re.compile(r"\d{4}|\+\(?\d|@|\d\.\d|[=:]|\d-\d|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|KEY-----|(?i:bearer)")


class Feistel:
    """Keyed permutations of [0, n): alternating additions of a keyed function of the other half, walking out-of-range
    values on."""

    def __init__(self, key: bytes):
        self.key = key
        self._value = lru_cache(20_000)(self._walk)

    def _mix(self, tweak: str, n: int, round_: int, half: int, modulus: int) -> int:
        data = f"{tweak}|{n}|{round_}|{half}".encode()
        digest = hashlib.blake2b(data, key=self.key, digest_size=32).digest()
        # Long values need more than one digest, or their first characters would stay.
        for i in range(1, -(-(modulus.bit_length() + 64) // 256)):
            digest += hashlib.blake2b(data + b"|%d" % i, key=self.key, digest_size=32).digest()
        return int.from_bytes(digest, "big") % modulus

    def _walk(self, tweak: str, value: int, n: int, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if r % 2:
                    right = (right + sign * self._mix(tweak, n, r, left, b)) % b
                else:
                    left = (left + sign * self._mix(tweak, n, r, right, a)) % a
            value = left * b + right
            if value < n:
                return value

    def permute(self, tweak: str, value: int, n: int, back: bool = False) -> int:
        return self._value(tweak, value, n, back) if n > 1 else value

    def string(self, tweak: str, text: str, alphabets: list[str], back: bool = False) -> str:
        """A text whose i-th character is of the i-th alphabet, as another such text."""
        value, n = 0, 1
        for c, letters in zip(text, alphabets):
            value, n = value * len(letters) + letters.index(c), n * len(letters)
        value = self.permute(f"{tweak}|{[*map(len, alphabets)]}", value, n, back)
        out = []
        for letters in reversed(alphabets):
            value, at = divmod(value, len(letters))
            out.append(letters[at])
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit after `body`."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


@lru_cache(10_000)
def alike(letter: str) -> str:
    """The letters of the same general category in the letter's stretch of 128 code points."""
    first, kind = ord(letter) & ~127, unicodedata.category(letter)
    return "".join(c for c in map(chr, range(first, first + 128)) if unicodedata.category(c) == kind)


def classes(text: str) -> list[str]:
    """For each character its class: lower or upper case letter, digit, other letters by their script, or only itself."""
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else alike(c) if ord(c) > 127 and c.isalpha() else c for c in text]


def refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced, in order."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def _card(value: str, f: Feistel, back: bool) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + f.string("card", digits[1:-1], [DIGITS] * (len(digits) - 2), back)
    return refill(value, body + luhn_digit(body))


def _iban(value: str, f: Feistel, back: bool) -> str | None:
    # A capital word behind the number may look like its last group.
    shorter = value.rpartition(" ")
    bare = value.replace(" ", "")
    if shorter[0] and not _iban_holds(bare):
        new = _iban(shorter[0], f, back)
        return None if new is None else f"{new} {shorter[2]}"
    if not _iban_holds(bare):
        return None
    body = f.string("iban" + bare[:2], bare[4:], classes(bare[4:]), back)
    check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
    rest = iter(f"{bare[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in value)


def _iban_holds(bare: str) -> bool:
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _phone(value: str, f: Feistel, back: bool) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    if value[0] == "+" and digits[0] != "1":
        # The country stays.
        code = calling_code(digits)
        return refill(value, code + f.string("phone" + code, digits[len(code) :], [DIGITS] * (len(digits) - len(code)), back))
    head, own = digits[:-10], digits[-10:]
    return refill(value, head + f.string("phone", own, [DIGITS] * 10, back))


#: Calling codes of two digits; all others but 1 and 7 have three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def calling_code(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def _ssn(value: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))

    def valid(a: int, g: int, s: int) -> bool:
        return 0 < a < 900 and a != 666 and g > 0 and s > 0

    if not valid(area, group, serial):
        return None
    number = (area * 100 + group) * 10_000 + serial
    while True:
        number = f.permute("ssn", number, 900 * 100 * 10_000, back)
        area, group, serial = number // 1_000_000, number // 10_000 % 100, number % 10_000
        if valid(area, group, serial):
            return f"{area:03d}-{group:02d}-{serial:04d}"


def _ip(value: str, f: Feistel, back: bool) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    number = f.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _looks(day: date) -> tuple[bool, bool, bool]:
    return day.month < 10, day.day < 10, day.day > 12


def _date(value: str, f: Feistel, back: bool) -> str | None:
    sign = "-" if "-" in value else "/" if "/" in value else "."
    parts = [int(x) for x in value.split(sign)]
    # Year first; day first with dots; with slashes month first where that is a date, else day first.
    orders = {"-": [(0, 1, 2)], ".": [(2, 1, 0)], "/": [(2, 0, 1), (2, 1, 0)]}[sign]
    for y, m, d in orders:
        try:
            day = date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        number, n = (day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1
        new = None
        # The same walk however the date is written: on until a single digit may stay one, and a day over 12 is one again.
        while new is None or _looks(new) != _looks(day):
            number = f.permute("date", number, n, back)
            new = FIRST_DAY + timedelta(days=number)
        widths = [len(x) for x in value.split(sign)]
        out = [""] * 3
        out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:0{widths[m]}d}", f"{new.day:0{widths[d]}d}"
        return sign.join(out)
    return None


def _email(value: str, f: Feistel, back: bool) -> str | None:
    return f.string("email", value, classes(value), back)


def _access(value: str, f: Feistel, back: bool) -> str | None:
    return "AKIA" + f.string("access", value[4:], [DIGITS + UPPER] * 16, back)


def _secret(value: str, f: Feistel, back: bool) -> str | None:
    split = re.match(r"(?s)(.*[=: \"'])(.*)", value).end(1)
    head, own = value[:split], value[split:]
    if "=" not in head and own.isalpha() and (own.islower() or own[1:].islower()):
        return None  # "secret: happiness"
    alphabets = [HEX] * len(own) if set(own) <= set(HEX) else classes(own)
    return head + f.string("secret", own, alphabets, back)


def _token(value: str, f: Feistel, back: bool) -> str | None:
    """Prefixes that tell the service stay."""
    split = re.match(r"(?i:bearer) +|github_pat_|gh._|glpat-|xox.-|sk-", value).end()
    return value[:split] + f.string("token", value[split:], classes(value[split:]), back)


def _login(value: str, f: Feistel, back: bool) -> str | None:
    return ":".join(f.string("login", part, classes(part), back) for part in value.split(":"))


def _key(value: str, f: Feistel, back: bool) -> str | None:
    return f.string("key", value, classes(value), back)


def _ip6(value: str, f: Feistel, back: bool) -> str | None:
    try:
        address = IPv6Address(value)
    except AddressValueError:
        return None
    if sum(map(bool, value.split(":"))) < 3:
        return None  # "a::b" is as likely a name in a program
    while True:
        address = IPv6Address(f.permute("ip6", int(address), 1 << 128, back))
        if sum(map(bool, str(address).split(":"))) >= 3:
            return str(address)


KINDS: dict[str, Callable[[str, Feistel, bool], str | None]] = {
    "email": _email, "phone": _phone, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "access": _access, "secret": _secret,
    "token": _token, "login": _login, "key": _key, "ip6": _ip6,
}


def pseudonymise(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """(text with all values replaced, kinds of the replaced values in order); `back` turns pseudonyms back."""
    kinds: list[str] = []
    if not HINT.search(text) and "AKIA" not in text:
        return text, kinds

    def one(match: re.Match) -> str:
        new = KINDS[match.lastgroup](match.group(), feistel, back)
        if new is None:
            return match.group()
        kinds.append(match.lastgroup)
        return new

    return FOUND.sub(one, text), kinds


def protect(df: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """df with its texts pseudonymised, n_values long and kinds map<string, int> (replaced if present)."""
    place = df.schema.fieldNames().index(text)
    order = [f.name for f in df.schema.fields if f.name.lower() not in ("n_values", "kinds")]

    def make(batches: Iterator[pa.RecordBatch]):
        feistel = Feistel(key)
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            done = [(None, []) if t is None else pseudonymise(t, feistel, back) for t in batch.column(place).to_pylist()]
            counts = [[(k, x[1].count(k)) for k in sorted(set(x[1]))] for x in done]
            yield batch, [
                pa.array([x[0] for x in done], pa.string()),
                pa.array([len(x[1]) for x in done], pa.int64()),
                pa.array(counts, pa.map_(pa.string(), pa.int32())),
            ]

    fields = [T.StructField(text, T.StringType()), T.StructField("n_values", T.LongType()), T.StructField("kinds", T.MapType(T.StringType(), T.IntegerType()))]
    return append_columns(df, fields, make).select(*[f"`{c}`" for c in order], "n_values", "kinds")
