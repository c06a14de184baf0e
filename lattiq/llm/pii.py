"""Format-preserving pseudonyms of personal data in texts (operator 2).

A value is validated (check digits, calendar, ranges) and then permuted, under a key, within the
set of values of its format by a Feistel network, so equal values get equal pseudonyms in every
document, different ones stay different, and a valid card number stays a valid card number.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from hashlib import blake2b

from pyspark.sql import DataFrame

from . import base

ROUNDS = 10


def permute(value: int, a: int, b: int, key: bytes, tweak: str, size: int | None = None) -> int:
    """A keyed permutation of ``range(size)`` (``a * b`` if not given): an alternating Feistel
    network over ``(value // b, value % b)``, walked along its cycle until it is in range."""
    size = a * b if size is None else size
    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            if r % 2:
                left = (left + _round(key, tweak, r, right)) % a
            else:
                right = (right + _round(key, tweak, r, left)) % b
        value = left * b + right
        if value < size:
            return value


def _round(key: bytes, tweak: str, r: int, half: int) -> int:
    return int.from_bytes(blake2b(f"{tweak}|{r}|{half}".encode(), key=key, digest_size=24).digest(), "big")


def permute_digits(digits: str, key: bytes, tweak: str) -> str:
    n = len(digits)
    if n == 0:
        return ""
    half = n // 2
    return str(permute(int(digits), 10 ** (n - half), 10**half, key, f"{tweak}{n}")).zfill(n)


def refill(shape: str, digits: str) -> str:
    """``shape`` with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def card(s: str, key: bytes) -> str | None:
    """Card number by its Luhn digit: the first digit stays, the rest is permuted, the check digit is made anew."""
    d = only_digits(s)
    if not 13 <= len(d) <= 19 or not int(d) or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = d[0] + permute_digits(d[1:-1], key, "card")
    return refill(s, body + luhn_digit(body))


def iban(s: str, key: bytes) -> str | None:
    """IBAN by its remainder mod 97: country and letters stay, digits are permuted, check digits are made anew."""
    flat = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    rest = refill(flat[4:], permute_digits(only_digits(flat[4:]), key, "iban" + flat[:2]))
    check = str(98 - number(rest + flat[:2] + "00") % 97).zfill(2)
    return refill(s, check + only_digits(rest))


def social(s: str, key: bytes) -> str | None:
    """US social security number: area neither 000, 666 nor 9xx, group and serial not zero."""

    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = only_digits(s)
    if not valid(d):
        return None
    while not valid(d := permute_digits(d, key, "ssn")):
        pass
    return refill(s, d)


def phone(s: str, key: bytes) -> str | None:
    """Phone number of 7 to 15 digits with a country code or an area code in brackets; the country code stays."""
    d = only_digits(s)
    if not 7 <= len(d) <= 15:
        return None
    code = len(re.match(r"\+?(\d{0,3})", s)[1]) if s[0] == "+" and not s[1:4].isdigit() else 2 if s[0] == "+" else 0
    return refill(s, d[:code] + permute_digits(d[code:], key, "phone" + d[:code]))


def ipv4(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permute(n, 1 << 16, 1 << 16, key, "ip").to_bytes(4, "big")))


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(s: str, key: bytes) -> str | None:
    """Calendar date of 1900 to 2099 as year-month-day, or day and month before the year
    (day first unless only month first is a date); the order and the separator stay."""
    a, b, c = re.split(r"[-/.]", s)
    orders = ["ymd"] if len(a) == 4 else ["dmy", "mdy"]
    for order in orders:
        v = dict(zip(order, (a, b, c), strict=True))
        try:
            n = datetime.date(int(v["y"]), int(v["m"]), int(v["d"])).toordinal()
        except ValueError:
            continue
        if FIRST <= n <= LAST:
            size = LAST - FIRST + 1
            side = int(size**0.5) + 1
            new = datetime.date.fromordinal(FIRST + permute(n - FIRST, side, side, key, "date", size))
            text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            if order == "mdy" and new.day <= 12:  # else it would be read back day first
                return _walked(new, key, s, side, size)
            sep = re.findall(r"[-/.]", s)
            return text[order[0]] + sep[0] + text[order[1]] + sep[1] + text[order[2]]
    return None


def _walked(new: datetime.date, key: bytes, s: str, side: int, size: int) -> str:
    while new.day <= 12:
        new = datetime.date.fromordinal(FIRST + permute(new.toordinal() - FIRST, side, side, key, "date", size))
    sep = re.findall(r"[-/.]", s)
    return f"{new.month:02d}{sep[0]}{new.day:02d}{sep[1]}{new.year:04d}"


def by_class(s: str, key: bytes, tweak: str, classes: tuple[str, ...]) -> str:
    """Permute the characters of ``s`` that are in ``classes``, each within its class."""
    where = [(i, k) for i, c in enumerate(s) for k in classes if c in k]
    size, value, half = 1, 0, len(where) // 2
    parts = [1, 1]
    for n, (i, k) in enumerate(where):
        value = value * len(k) + k.index(s[i])
        parts[n >= half] *= len(k)
    size = parts[0] * parts[1]
    shape = "".join(str(classes.index(k)) for _, k in where)
    value = permute(value, parts[0], parts[1], key, tweak + shape, size)
    out = list(s)
    for i, k in reversed(where):
        value, c = divmod(value, len(k))
        out[i] = k[c]
    return "".join(out)


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def email(s: str, key: bytes) -> str | None:
    """Address with a dotted host name: letters and digits before the last dot are permuted."""
    name, _, top = s.rpartition(".")
    return f"{by_class(name, key, 'mail', (LOWER, LOWER.upper(), DIGITS))}.{top}"


def secret(s: str, key: bytes) -> str | None:
    """Hexadecimal token of 32, 40 or 64 places with digits and letters in it."""
    if len(s) not in (32, 40, 64) or s.isdigit() or s.isalpha():
        return None
    return by_class(s, key, "hex", ("0123456789abcdef" if s == s.lower() else "0123456789ABCDEF",))


#: Each pattern can only start where a run of its characters starts, so a long run (a picture as
#: text) is scanned once, not once from each of its places.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    "secret": (r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])", iban),
    "date": (r"(?<![0-9.])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|\.[0-9])", date),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ipv4),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social),
    "phone": (r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4})(?![0-9])", phone),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
}


def _pattern() -> re.Pattern[str]:
    out = []
    for i, (name, (p, _)) in enumerate(KINDS.items()):
        out.append(f"(?P<{name}>{p})")
    joined = "|".join(out)
    # back references to the separators of dates, by name of the place in the joined pattern
    first = joined.index("([-/.])")
    joined = joined[:first] + "(?P<sep>[-/.])" + joined[first + 7 :].replace("\\1", "(?P=sep)", 1)
    second = joined.index("([-/.])")
    return re.compile(joined[:second] + "(?P<sep2>[-/.])" + joined[second + 7 :].replace("\\2", "(?P=sep2)", 1))


PATTERN = _pattern()
ALONE = {name: re.compile(p) for name, (p, _) in KINDS.items()}
HINT = re.compile(r"[0-9@]")

#: Digits after the country code, where a country has one length.
NATIONAL = {"1": 10, "7": 10, "20": 10, "27": 9, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "86": 11, "90": 10, "91": 10, "351": 9, "420": 9}


def endings(kind: str, value: str) -> list[str]:
    """``value`` and its beginnings up to group boundaries that have the pattern of ``kind``, in
    the order they are tried: a phone of the length of its country and a card number without
    separators first, else the longest."""
    if kind not in ("iban", "phone", "card"):
        return [value]
    cuts = (i for i in range(len(value) - 1, 0, -1) if value[i - 1].isalnum() and not value[i].isalnum())
    out = [value, *(v for i in cuts if ALONE[kind].fullmatch(v := value[:i]))]
    if kind == "card":
        out.sort(key=lambda v: not v.isdigit())
    if kind == "phone" and value[0] == "+":
        d = only_digits(value)
        known = [n + NATIONAL[d[:n]] for n in (1, 2, 3) if d[:n] in NATIONAL]
        out.sort(key=lambda v: len(only_digits(v)) not in known)
    return out


def _replaced(text: str, m: re.Match[str], key: bytes) -> tuple[str, int] | None:
    """The pseudonym of the value at a match, and its end: a value that fails one kind may be of a
    later one; where all fail, shorter endings are tried."""
    shorter = []
    for name, (_, f) in KINDS.items():
        value = m[0] if m.lastgroup == name else k[0] if (k := ALONE[name].match(text, m.start())) else None
        if value is not None:
            first, *rest = endings(name, value)
            shorter += [(f, v) for v in rest]
            if (new := f(first, key)) is not None:
                return new, m.start() + len(first)
    for f, v in shorter:
        if (new := f(v, key)) is not None:
            return new, m.start() + len(v)
    return None


def pseudonymised(text: str, key: bytes) -> tuple[str, int]:
    """The text with each valid value replaced, and how many were."""
    if not HINT.search(text):
        return text, 0
    out, at, n = [], 0, 0
    pos = 0
    while m := PATTERN.search(text, pos):
        if (made := _replaced(text, m, key)) is None:
            pos = m.start() + 1
            while pos < len(text) and text[pos - 1].isalnum() and text[pos].isalnum():
                pos += 1
            continue
        new, end = made
        out += [text[at : m.start()], new]
        at = pos = end
        n += 1
    return "".join(out) + text[at:], n


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", length: str | None = "n_chars", count: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text`` replaced; rows, order and other columns stay.

    ``length``, if it is a column, gets the new number of code points where the text changed.
    ``count`` adds a column with the number of replaced values.  Null and empty texts stay as
    they are, repeated rows get equal pseudonyms.  No shuffle; whole texts.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, *([StructField(count, LongType())] if count else [])])
    arrow = to_arrow_schema(schema)
    names = docs.columns
    counts = length if length in names and dict(docs.dtypes)[length] in ("int", "bigint") else None

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(names, batch.columns, strict=True))
            old = columns[text].to_pylist()
            new = [pseudonymised(t, key) if t else (t, 0) for t in old]
            columns[text] = pa.array([t for t, _ in new], arrow.field(text).type)
            if counts:
                sizes = [len(t) if n else s for (t, n), s in zip(new, columns[counts].to_pylist(), strict=True)]
                columns[counts] = pa.array(sizes, arrow.field(counts).type)
            if count:
                columns[count] = pa.array([n for _, n in new], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

    return base.arrow_mapped(docs, run, schema)
