"""PII: format-preserving pseudonyms by Feistel permutations.

What is replaced, and how it is validated: payment card numbers (13 to 19 digits, Luhn), numbers
of the North American telephone layout, international telephone numbers (a plus sign, a country
code, 8 to 15 digits), social security numbers (issued areas), IBANs (their check digits), IPv4
and IPv6 addresses, dates (real days of 1900 to 2099 in ISO, slashed, dotted and hyphened forms;
month first, or day first where the month cannot be), e-mail addresses, access keys of known
prefixes, and secrets behind ``password``, ``token``, ``secret`` or ``key`` in any letter case
(hexadecimal ones of 8 digits, mixed ones of 16 characters with letters and digits).  A value is
ranked within the set of valid values of its format, a keyed Feistel network of ten rounds
permutes that set, and the new rank is written in the old layout: separators, letter case and
length stay, check digits are right again (IPv6 addresses stay valid, but their spelling, short
or full, may change, and only the address itself comes back).  The key alone decides, so equal values stay equal across documents
(whatever their separators, and e-mail names whatever their letter case), different ones stay
different, and the holder of the key can go back.  The key is hashed, so every byte of it counts.

In a longer run of digit groups a card is the longest valid number of whole groups, tried from
each group on.  There the neighbours decide with it: by chance (a check digit fits one number in
ten) a card is read together with a neighbour, or a pseudonym is so on the way back.

A map over whole texts; nothing is shuffled.

Defined results: a null text stays null; an empty one stays empty; repeated rows are treated
alike; an empty table gives an empty result; other columns are ignored; values of any length are
replaced whole.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, ship_code

#: Where the registered query finds its key, and what it takes without one: tables of invented persons only.
KEY_SETTING, DEMONSTRATION_KEY = "spark.rillmark.pseudonyms.key", b"for invented persons only"
ROUNDS = 10
#: Characters of a free value that are permuted together.
CHUNK = 128
KINDS = ("card", "phone", "ssn", "iban", "ip", "date", "email", "secret")
SCHEMA = "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS)
# Prefixes of access keys, and the two-digit country codes of the telephone network.
PREFIXED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}"
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

TRIGGER = re.compile(r"[0-9@=:_]|A[KS]IA|xox")  # every kind has one of these
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"
    r"|(?P<secret>(?ai:password|passwd|token|secret|api[_-]?key|key)\s?[=:]\s?[\"']?"
    r"(?:[0-9a-fA-F]{8,}+(?![0-9A-Za-z])|(?=[A-Za-z_/+~-]*[0-9])(?=[0-9_/+~-]*[A-Za-z])[A-Za-z0-9_/+~-]{16,}+={0,2})"
    rf"|(?<![0-9A-Za-z_])(?:{PREFIXED})(?![0-9A-Za-z]))"
    r"|(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z]))"
    r"|(?<![0-9.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Za-z:.])(?P<ipv6>(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![0-9A-Za-z:.])"
    r"|(?<![0-9])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[-/.][0-9])"
    r"|(?<![0-9-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|-[0-9])"
    r"|(?<![0-9])(?P<phone>(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"
    r"|(?<![0-9A-Za-z])(?P<abroad>\+[2-9][0-9]{0,13}(?:[ .-]?\(?[0-9]{1,12}\)?){0,6}+)(?![0-9])"
    r"|(?<![0-9])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"
)
#: Counted as another kind.
COUNTED = {"ipv6": "ip", "abroad": "phone"}
#: What a card must not cut: numbers of other kinds in the same run of digits.
UNCUT = re.compile(PATTERN.pattern[PATTERN.pattern.index(r"(?<![0-9.])(?P<ip>") : PATTERN.pattern.index(r"|(?<![0-9])(?P<card>")])
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache(maxsize=64)
def _hashed(key: bytes) -> bytes:
    return hashlib.blake2b(key).digest()


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of ``range(size)``; walks on while it is outside."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    key = _hashed(key)
    digests = -(-(a.bit_length() + 64) // 512)

    def noise(i: int, half: int, limit: int) -> int:
        message = f"{tweak}|{size}|{i}|{half:x}"
        digest = b"".join(hashlib.blake2b(f"{message}|{n}".encode() if n else message.encode(), key=key).digest() for n in range(digests))
        return int.from_bytes(digest, "big") % limit

    while True:
        left, right = divmod(value, b)  # left below a, right below b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                left = (left + sign * noise(i, right, a)) % a
            else:
                right = (right + sign * noise(i, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def refill(layout: str, symbols: str, kinds: str = "0123456789") -> str:
    """``layout`` with its characters of ``kinds`` replaced, in order, by ``symbols``."""
    it = iter(symbols)
    return "".join(next(it) if c in kinds else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = str(permute(int(digits[:-1]), 10**n, key, "card", back)).zfill(n)
    return refill(text, body + str(luhn(body)))


def _card_ends(match: re.Match) -> list[int]:
    """Where a card that begins with the match may end, behind a group of digits; the longest first."""
    ends = [match.end(), *reversed([match.start() + m.start() for m in re.finditer("[ -]", match[0])])]
    others = [m.span() for m in UNCUT.finditer(match.string, match.start(), match.end() + 24)]
    return [e for e in ends if not any(a < e < b for a, b in others)]


def _group_ends(match: re.Match) -> list[int]:
    """Ends of the match and of the groups in it, the last first: words and numbers behind a value may look like a part of it."""
    return [match.end(), *reversed([match.start() + m.start() for m in re.finditer("[ .-]", match[0])])]


def _phone(text: str, key: bytes, back: bool) -> str:
    """Area and exchange from 2 to 9, as issued, are permuted among themselves, and so are all others."""
    digits = _digits(text)
    country, area, exchange, last = digits[:-10], int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
    if area >= 200 and exchange >= 200:
        rank, last = divmod(permute(((area - 200) * 800 + exchange - 200) * 10_000 + last, 6_400_000_000, key, "phone", back), 10_000)
        area, exchange = rank // 800 + 200, rank % 800 + 200
    else:
        rank = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
        rank, last = divmod(permute(rank * 10_000 + last, 3_600_000_000, key, "phone, not issued", back), 10_000)
        area, exchange = divmod(rank, 1000) if rank < 200_000 else ((rank - 200_000) // 200 + 200, (rank - 200_000) % 200)
    return refill(text, f"{country}{area:03d}{exchange:03d}{last:04d}")


def _abroad(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    code = 1 if digits[0] == "7" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    n = len(digits) - code
    if not 8 <= len(digits) <= 15 or text.count("(") != text.count(")"):
        return None
    own = permute(int(digits[code:]), 10**n, key, f"abroad|{digits[:code]}|{n}", back)
    return refill(text, f"{digits[:code]}{own:0{n}d}")


def _iban_check(country: str, own: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in own + country + "00")) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, own = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, own) != int(check):
        return None
    own = _symbols(own, key, "iban|" + country, LETTERS[1:], back)
    new = iter(f"{country}{_iban_check(country, own):02d}{own}")
    return "".join(c if c == " " else next(new) for c in text)


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9_999 + serial - 1
    rank, serial = divmod(permute(rank, 898 * 99 * 9_999, key, "ssn", back), 9_999)
    area, group = divmod(rank, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, key: bytes, back: bool) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ipv6(text: str, key: bytes, back: bool) -> str | None:
    groups = [g for g in text.split(":") if g]
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if len(groups) < 3:  # two colons stand in code, too
        return None
    new = ipaddress.IPv6Address(permute(value, 1 << 128, key, "ipv6", back))
    out = new.exploded if len(text) == 39 else str(new)
    return out.upper() if text != text.lower() and text == text.upper() else out


def _day(text: str, form: str) -> int | None:
    try:
        return datetime.datetime.strptime(text, form).toordinal()
    except ValueError:
        return None


def _date(text: str, key: bytes, back: bool) -> str | None:
    mark = text[4] if text[4] == "-" and text[:4].isdigit() else text[2]
    forms = ["%Y-%m-%d"] if text[4] == "-" else ["%d.%m.%Y"] if mark == "." else [f"%m{mark}%d{mark}%Y", f"%d{mark}%m{mark}%Y"]
    for form in forms:
        day = _day(text, form)
        if day is None or not FIRST_DAY <= day <= LAST_DAY:
            continue
        while True:
            day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back)
            new = datetime.date.fromordinal(day).strftime(form)
            if form == forms[0] or _day(new, forms[0]) is None:  # written day first, it must not read as month first
                return new
    return None


def _symbols(text: str, key: bytes, tweak: str, alphabets: list[str], back: bool) -> str:
    """Permutes the product of the alphabets of the characters, ``CHUNK`` of them at a time; others stay."""
    out = []
    for at in range(0, len(text), CHUNK):
        place = [(c, next((a for a in alphabets if c in a), None)) for c in text[at : at + CHUNK]]
        rank, size = 0, 1
        for c, a in place:
            if a:
                rank, size = rank * len(a) + a.index(c), size * len(a)
        layout = "".join(c if a is None else str(alphabets.index(a)) for c, a in place)
        rank = permute(rank, size, key, f"{tweak}|{layout}" + (f"|{at}|{len(text)}" if len(text) > CHUNK else ""), back)
        own = []
        for c, a in reversed(place):
            if a:
                rank, i = divmod(rank, len(a))
                c = a[i]
            own.append(c)
        out += reversed(own)
    return "".join(out)


LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]


def _email(text: str, key: bytes, back: bool) -> str | None:
    """Names are read in lower case and written in the case of the old letters."""
    local, at, domain = text.partition("@")
    if not any(c.isalnum() for c in local):
        return None
    new = _symbols(local.lower(), key, "email|" + domain.lower(), LETTERS, back)
    return "".join(n.upper() if old.isupper() else n for old, n in zip(local, new, strict=True)) + at + domain


def _secret(text: str, key: bytes, back: bool) -> str | None:
    lead = re.match(r"(?ai:password|passwd|token|secret|api[_-]?key|key)\s?[=:]\s?[\"']?", text)
    start = lead.end() if lead else 0
    value = text[start:]
    if re.fullmatch(PREFIXED, value):  # the same wherever it stands
        start += re.match("[A-Za-z]{2}_[a-z]+_|[a-z]+[_-]|[A-Z]{4}", value).end()
        return text[:start] + _symbols(text[start:], key, "prefixed", LETTERS, back)
    if not re.fullmatch("[0-9a-fA-F]+", value):
        return text[:start] + _mixed(value, key, back)
    hexadecimal = ["0123456789abcdef"] if value == value.lower() else ["0123456789ABCDEF"] if value == value.upper() else LETTERS
    upper = hexadecimal[0].isupper()
    while True:
        value = _symbols(value, key, "secret", hexadecimal, back)
        if not upper or value != value.lower():  # digits alone would count as lower case on the way back
            return text[:start] + value


def _mixed(value: str, key: bytes, back: bool) -> str:
    """Letters stay letters and digits digits, so what has both has both again; walks on from what would read as hexadecimal or prefixed."""
    while True:
        value = _symbols(value, key, "mixed secret", LETTERS, back)
        if not re.fullmatch(f"[0-9a-fA-F]+|{PREFIXED}", value):
            return value


REPLACE = {"card": _card, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "iban": _iban, "ip": _ip, "ipv6": _ipv6, "date": _date, "email": _email, "secret": _secret}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms (or, with ``back``, the original of such a text), and counts by kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not TRIGGER.search(text):
        return text, counts

    out, done, at = [], 0, 0
    while match := PATTERN.search(text, at):
        kind, start = match.lastgroup, match.start()
        for end in _card_ends(match) if kind == "card" else _group_ends(match) if kind in ("iban", "abroad") else (match.end(),):
            new = REPLACE[kind](text[start:end], key, back)
            if new is not None:
                counts[COUNTED.get(kind, kind)] += 1
                out += text[done:start], new
                done = at = end
                break
        else:
            at = re.compile("[0-9]+").match(text, start).end() if kind == "card" else start + 1 if kind in ("iban", "abroad", "ipv6") else match.end()
    return "".join(out) + text[done:], counts


def pseudonyms(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_replaced`` and a count of each kind, one row per input row."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                done = [(None, dict.fromkeys(KINDS, 0)) if t is None else pseudonymise(t, key) for t in piece.column(1).to_pylist()]
                counts = [[c[k] for _, c in done] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([sum(c) for c in zip(*counts, strict=True)], pa.int64()), *[pa.array(c, pa.int64()) for c in counts]],
                    names=["doc_id", "text", "n_replaced", *[f"n_{k}" for k in KINDS]],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    return pseudonyms(documents(spark, sf_dir), key.encode() if key else DEMONSTRATION_KEY)
