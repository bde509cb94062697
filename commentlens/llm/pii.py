"""Format-preserving pseudonyms for personal data.

Validated values are permuted within their format by a keyed Feistel network: a card number becomes another card number
that passes the Luhn test, an address another address, a date another date in the same spelling. The same value
gets the same pseudonym in every document, so that it stays linked, and different values get different ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "iban", "date", "ip", "phone", "ssn", "card")
ROUNDS = 8

_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099

# What is looked for. A candidate may run on into what follows; ``_value`` finds its end.
_PATTERN = re.compile(
    r"""
    (?P<email> (?<![\w.%+-]) [\w.%+-]+ @ [A-Za-z0-9-]+ (?:\.[A-Za-z0-9-]+)+ )
  | (?P<iban> (?<!\w) [A-Z]{2}[0-9]{2} (?:[ ]?[A-Z0-9]{4}){2,7} (?:[ ]?[A-Z0-9]{1,3})? (?!\w) )
  | (?P<date> (?<![\w./-]) (?: [0-9]{4}-[0-9]{2}-[0-9]{2} | [0-9]{4}/[0-9]{2}/[0-9]{2} | [0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}
      | [0-9]{1,2}/[0-9]{1,2}/[0-9]{4} ) (?![\w/-]) )
  | (?P<ip> (?<![\w.]) [0-9]{1,3}(?:\.[0-9]{1,3}){3} (?!\w|\.[0-9]) )
  | (?P<phone> (?<![\w+]) \+[0-9]{1,3} [ .-]? \(?[0-9]{2,4}\)? (?:[ .-]?[0-9]{2,4}){2,4} (?!\w) )
  | (?P<ssn> (?<![\w-]) [0-9]{3}-[0-9]{2}-[0-9]{4} (?![\w-]) )
  | (?P<card> (?<!\w) (?: [0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4} | [0-9]{4}(?P<t>[ -])[0-9]{6}(?P=t)[0-9]{5}
      | [0-9]{13,19} ) (?!\w) )
    """,
    re.VERBOSE,
)
_MAY = re.compile(r"[0-9@]")
_BORDER = re.compile(r"\w(?!\w)")

#: Length of an IBAN by country.
_IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV NI",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Digits after the calling code where all numbers, or all but a few, have as many.
_PHONE_DIGITS = {
    code: n
    for n, codes in {
        10: "1 7 30 44 52 57 58 63 90 91 92 98", 9: "27 31 33 34 40 41 48 51 56 84 93 94 212 213 233 251 254 255 256 351 380 420 421 966 971",
        8: "45 47 53 65 216 371 370 373 374 386 387 502 503 504 505 506 507 852 853 965 968 973 974",
        7: "354 960",
    }.items()
    for code in codes.split()
}


def feistel(key: bytes, tweak: str, a: int, b: int, size_a: int, size_b: int) -> tuple[int, int]:
    """A keyed permutation of pairs with a < size_a and b < size_b: each round shifts one by a digest of the other."""
    for k in range(ROUNDS):
        told, size = (b, size_a) if k % 2 == 0 else (a, size_b)
        digest = blake2b(f"{tweak}|{k}|{told}".encode(), key=key, digest_size=16 + (size.bit_length() + 7) // 8).digest()
        shift = int.from_bytes(digest, "big") % size
        a, b = ((a + shift) % size_a, b) if k % 2 == 0 else (a, (b + shift) % size_b)
    return a, b


def permute(key: bytes, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of numbers below their sizes; one number alone is shifted by a keyed amount."""
    if not values:
        return []
    half = len(values) // 2

    def fold(part: slice) -> tuple[int, int]:
        number, size = 0, 1
        for v, s in zip(values[part], sizes[part], strict=True):
            number, size = number * s + v, size * s
        return number, size

    (a, size_a), (b, size_b) = fold(slice(0, half)), fold(slice(half, None))
    a, b = feistel(key, tweak, a, b, size_a, size_b)
    out = []
    for number, part in ((b, sizes[half:]), (a, sizes[:half])):
        for s in reversed(part):
            number, v = divmod(number, s)
            out.append(v)
    return out[::-1]


def _digits(key: bytes, tweak: str, text: str) -> str:
    return "".join(map(str, permute(key, f"{tweak}{len(text)}", [int(c) for c in text], [10] * len(text))))


def _into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _luhn(digits: str) -> int:
    """What the last digit must be after ``digits``."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _email(key: bytes, text: str) -> str:
    local, at, domain = text.partition("@")
    place = [k for k, c in enumerate(local) if c.isascii() and c.isalnum()]
    start = [ord("0") if local[k].isdigit() else ord("a") if local[k].islower() else ord("A") for k in place]
    sizes = [10 if s == ord("0") else 26 for s in start]
    new = permute(key, f"email{local if not place else ''}@{domain}", [ord(local[k]) - s for k, s in zip(place, start, strict=True)], sizes)
    out = list(local)
    for k, v, s in zip(place, new, start, strict=True):
        out[k] = chr(s + v)
    return "".join(out) + at + domain


def _iban(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
    if not 15 <= len(plain) <= 34 or number(plain) % 97 != 1:
        return None
    rest = plain[4:]
    kinds = [(48, 10) if c.isdigit() else (65, 26) for c in rest]
    new = permute(key, f"iban{plain[:2]}", [ord(c) - s for c, (s, _) in zip(rest, kinds, strict=True)], [n for _, n in kinds])
    rest = "".join(chr(s + v) for v, (s, _) in zip(new, kinds, strict=True))
    check = 98 - number(plain[:2] + "00" + rest) % 97
    made = iter(f"{plain[:2]}{check:02}{rest}")
    return "".join(c if c == " " else next(made) for c in text)


def _date(key: bytes, text: str) -> str | None:
    sign = next(c for c in text if not c.isdigit())
    parts = [int(p) for p in text.split(sign)]
    orders = [(0, 1, 2)] if len(text.split(sign)[0]) == 4 else [(2, 1, 0)] if sign == "." else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = date(*(parts[k] for k in order)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        while True:  # a permutation of a slightly larger range, repeated until it ends inside
            day = sum(x * y for x, y in zip(feistel(key, "date", *divmod(day, 271), 270, 271), (271, 1), strict=True))
            if day < _DAYS:
                break
        new = date.fromordinal(day + _FIRST_DAY)
        at = dict(zip(order, (new.year, new.month, new.day), strict=True))
        return sign.join(f"{at[k]:0{len(p)}}" for k, p in enumerate(text.split(sign)))
    return None


def _ip(key: bytes, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, permute(key, "ip", parts, [256] * 4)))


def _phone(key: bytes, text: str) -> str | None:
    country = re.match(r"\+[0-9]{1,3}", text).group() if not re.match(r"\+[0-9]{4}", text) else text[:2]
    rest = text[len(country) :]
    digits = "".join(c for c in rest if c.isdigit())
    if not 7 <= len(digits) <= 12:
        return None
    return country + _into(rest, _digits(key, f"phone{country}", digits))


def _ssn(key: bytes, text: str) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    if not valid(digits):
        return None
    digits = _digits(key, "ssn", digits)
    while not valid(digits):
        digits = _digits(key, "ssn", digits)
    return _into(text, digits)


def _card(key: bytes, text: str) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if int(digits[-1]) != _luhn(digits[:-1]) or not digits.strip("0"):
        return None
    new = _digits(key, "card", digits[:-1])
    return _into(text, new + str(_luhn(new)))


def pseudonym(key: bytes, kind: str, text: str) -> str | None:
    """Another value of the kind; None if the text isn't a valid value."""
    return {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}[kind](key, text)


def _value(key: bytes, kind: str, text: str, m: re.Match) -> tuple[int, str | None]:
    """Where the value that a candidate begins with ends, and its pseudonym; None if none of its ends makes a valid value.

    Of an IBAN or a telephone number the end that the country's length asks for comes first, then the last one.
    """
    ends = [m.end()]
    if kind in ("iban", "phone"):
        ends += [b.end() for b in _BORDER.finditer(text, m.start(), m.end()) if b.end() < m.end()][::-1]
        ends = [e for e in ends if (part := _PATTERN.fullmatch(text, m.start(), e)) and part[kind] is not None]
        ends.sort(key=lambda e: _unlikely(kind, text, m.start(), e))
    for end in ends:
        if (new := pseudonym(key, kind, text[m.start() : end])) is not None:
            return end, new
    return m.end(), None


def _unlikely(kind: str, text: str, start: int, end: int) -> tuple:
    """Ends that are more likely come first: of the usual length, not inside what dots or hyphens hold together, the longest."""
    value = text[start:end]
    inside = re.match(r"[.-]\w", text[end : end + 2]) is not None
    if kind == "iban":
        usual = len(value.replace(" ", "")) == _IBAN_LENGTH.get(value[:2])
    else:
        digits = "".join(c for c in value if c.isdigit())
        code = next((digits[:k] for k in (1, 2, 3) if digits[:k] in _PHONE_DIGITS), "")
        usual = len(digits) - len(code) == _PHONE_DIGITS.get(code)
    return not usual, inside, -end


def pseudonymised(key: bytes, text: str) -> tuple[str, list[int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts = [0] * len(KINDS)
    if not _MAY.search(text):
        return text, counts

    out, done, at = [], 0, 0
    while m := _PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        end, new = _value(key, kind, text, m)
        if new is None:  # what follows the first token may be a value
            at = _BORDER.search(text, m.start()).end()
            continue
        counts[KINDS.index(kind)] += 1
        out += [text[done : m.start()], new]
        done = at = end
    return "".join([*out, text[done:]]), counts


def _replace(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [(None, [0] * len(KINDS)) if t is None else pseudonymised(key, t) for t in batch.column("text").to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["text"] = pa.array([x[0] for x in done], pa.string())
        columns |= {f"n_{k}": pa.array([x[1][i] for x in done], pa.int64()) for i, k in enumerate(KINDS)}
        yield pa.RecordBatch.from_pydict(columns)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and n_email, n_iban, n_date, n_ip, n_phone, n_ssn, n_card.

    Whole texts are searched; a candidate that fails its test (a number without a valid check digit, a day that doesn't
    exist) stays, and the search goes on after its first token. Where a value is followed by another, each is replaced. A telephone
    number of a country without a usual length takes in a short number right after it. ``key`` is secret: with it, and only with it, pseudonyms can be computed. A null text stays null. Columns
    named like the counts are replaced, all others passed on. Row by row, so repeated rows agree and no rows give no rows.
    """
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*counts)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return docs.mapInArrow(partial(_replace, key), schema)
