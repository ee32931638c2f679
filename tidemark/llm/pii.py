"""Format-preserving pseudonyms of personal data (operator 4).

Numbers and dates that pass their kind's validation are permuted, under a key, among the valid values of the same format,
so equal values stay equal in every document, different ones stay different, and separators, lengths and check digits
stay right. The permutation of 0..N-1 is a balanced Feistel network over the next even number of bits, walked until it
falls below N.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import unicodedata
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import free_names, with_columns_from

ROUNDS = 8
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, half: int, tweak: bytes, bits: int) -> int:
        msg = bytes([i]) + half.to_bytes((bits + 7) // 8, "big") + tweak
        out, want = b"", (bits + 7) // 8
        while len(out) < want:
            out += hashlib.blake2b(msg + bytes([len(out) // 64]), key=self.key).digest()
        return int.from_bytes(out[:want], "big") & (1 << bits) - 1

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        left, right, mask = x >> bits, x & (1 << bits) - 1, (1 << bits) - 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(i, left, tweak, bits), left
            else:
                left, right = right, left ^ self._round(i, right, tweak, bits)
        return (left & mask) << bits | right & mask

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak.encode(), back)
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_ok(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Letters and digits of an IBAN by country, as registered.
IBAN_LENGTHS = {
    s[:2]: int(s[2:])
    for s in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 "
        "LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: Groups of digits that cards are printed in, besides one group.
CARD_GROUPS = ([4, 4, 4, 4], [4, 6, 5])


def card_part(value: str) -> tuple[int, int] | None:
    """Where the card number in a run of digit groups lies, if any does: printed groups first, then the longest, then the first."""
    groups, found = [m.span() for m in re.finditer(r"\d+", value)], []
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            sizes = [b - a for a, b in groups[i : j + 1]]
            plain = "".join(value[a:b] for a, b in groups[i : j + 1])
            if 13 <= len(plain) <= 19 and luhn_digit(plain[:-1]) == plain[-1]:
                found.append((len(sizes) > 1 and sizes not in CARD_GROUPS, -len(plain), groups[i][0], groups[j][1]))
    return min(found)[2:] if found else None


def iban_part(value: str) -> tuple[int, int] | None:
    """Where the IBAN that value begins with ends, if it does: at the country's length first, then the longest."""
    ends = [m.end() for m in re.finditer(r"[A-Z0-9]+", value)]
    lengths = {e: len(value[:e].replace(" ", "")) for e in ends}
    for e in sorted(ends, key=lambda e: (lengths[e] != IBAN_LENGTHS.get(value[:2]), -e)):
        if _iban_ok(value[:e].replace(" ", "")):
            return 0, e
    return None


def _refill(shape: str, chars: str) -> str:
    """Letters and digits of shape replaced, in order; all else stays."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


#: Area codes: none begins with 0 or 1 or is a service code (N11); and their numbers.
_AREAS = [f"{i:03d}" for i in range(200, 1000) if i % 100 != 11]
_AREA = {a: i for i, a in enumerate(_AREAS)}


@functools.cache
def _alphabet(c: str) -> str:
    """The letters (or digits) that c is permuted among: those of its kind in its block of 256 code points; ASCII letters in either case."""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"
    block, kind = ord(c) & ~0xFF, unicodedata.category(c)
    return "".join(x for x in map(chr, range(max(block, 0x80), block + 256)) if unicodedata.category(x) == kind)


class Pseudonyms:
    """Finds values and gives their pseudonyms; back=True gives the values again."""

    KINDS = (
        ("email", r"(?<![\w.+-])[\w.%+-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}"),
        ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
        ("ymd", r"(?<![\w.-])\d{4}([-/])\d{2}\1\d{2}(?![\w-])"),
        ("dmy", r"(?<![\w.-])\d{2}([./-])\d{2}\2\d{4}(?![\w-])"),
        ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
        ("phone", r"(?<![\w+])(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w-]|\.\d)"),
        ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
        ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w|-\d)"),
        ("secret", r"(?<!\w)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}(?!\w)"),
    )
    FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS).replace(r"([-/])", "(?P<s1>[-/])").replace(r"\1", "(?P=s1)").replace(r"([./-])", "(?P<s2>[./-])").replace(r"\2", "(?P=s2)"))
    #: What each kind has one of at least: a text with none holds no value.
    ANY = re.compile(r"[\d@]")

    #: Kinds whose matches can hold neighbours of the value, and where the value lies in one.
    PARTS = {"card": card_part, "iban": iban_part}

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.of = functools.lru_cache(maxsize=1 << 16)(self._of)

    def _digits(self, s: str, kind: str, back: bool) -> str:
        return str(self.feistel.permute(int(s), 10 ** len(s), f"{kind}{len(s)}", back)).zfill(len(s))

    def _of(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym, or None if the value isn't valid in its kind."""
        plain = "".join(c for c in value if c.isalnum())
        return getattr(self, f"_{kind}")(value, plain, back)

    def _card(self, value, plain, back):
        if luhn_digit(plain[:-1]) != plain[-1]:
            return None
        body = self._digits(plain[:-1], "card", back)
        return _refill(value, body + luhn_digit(body))

    def _phone(self, value, plain, back):
        """Ten digits whose area code can be one; an exchange that can be dialled stays one that can."""
        area, exchange, line = plain[-10:-7], plain[-7:-4], plain[-4:]
        if area not in _AREA:
            return None
        low, n = (200, 800) if exchange[0] >= "2" else (0, 200)
        x = (_AREA[area] * n + int(exchange) - low) * 10_000 + int(line)
        x, line = divmod(self.feistel.permute(x, len(_AREAS) * n * 10_000, f"phone{low}", back), 10_000)
        area, exchange = divmod(x, n)
        return _refill(value, f"{plain[:-10]}{_AREAS[area]}{exchange + low:03d}{line:04d}")

    def _ssn(self, value, plain, back):
        ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        if not ok(plain):
            return None
        plain = self._digits(plain, "ssn", back)
        while not ok(plain):
            plain = self._digits(plain, "ssn", back)
        return _refill(value, plain)

    def _ip(self, value, plain, back):
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, value, plain, back):
        if not _iban_ok(plain):
            return None
        body, n, x = plain[4:], 1, 0
        for c in body:  # digits stay digits, letters letters
            r = 10 if c.isdigit() else 26
            x, n = x * r + (int(c) if c.isdigit() else ord(c) - 65), n * r
        x = self.feistel.permute(x, n, "iban" + plain[:2] + re.sub("[A-Z]", "A", re.sub(r"\d", "9", body)), back)
        out = ""
        for c in reversed(body):
            x, d = divmod(x, 10 if c.isdigit() else 26)
            out = (str(d) if c.isdigit() else chr(65 + d)) + out
        check = 98 - int("".join(str(int(c, 36)) for c in out + plain[:2] + "00")) % 97
        return _refill(value, f"{plain[:2]}{check:02d}{out}")

    def _date(self, day: int, tweak: str, back: bool, ok=lambda d: True) -> datetime.date:
        while True:
            day = self.feistel.permute(day, _DAYS, tweak, back)
            if ok(d := datetime.date.fromordinal(_DAY0 + day)):
                return d

    def _ymd(self, value, plain, back):
        try:
            day = datetime.date(int(plain[:4]), int(plain[4:6]), int(plain[6:])).toordinal() - _DAY0
        except ValueError:
            return None
        return _refill(value, self._date(day, "ymd", back).strftime("%Y%m%d")) if 0 <= day < _DAYS else None

    def _dmy(self, value, plain, back):
        """Day first if that is a date; else month first, and then among dates that can only be read so."""
        for kind, d, m, ok in (("ymd", plain[:2], plain[2:4], lambda d: True), ("mdy", plain[2:4], plain[:2], lambda d: d.day > 12)):
            try:
                day = datetime.date(int(plain[4:]), int(m), int(d)).toordinal() - _DAY0
            except ValueError:
                continue
            if not 0 <= day < _DAYS:
                return None
            return _refill(value, self._date(day, kind, back, ok).strftime("%d%m%Y" if kind == "ymd" else "%m%d%Y"))
        return None

    def _email(self, value, plain, back):
        """The local part's letters and digits, each among those of its kind; the domain stays."""
        local, _, domain = value.partition("@")
        own = {c: _alphabet(c) for c in local if c.isalnum()}
        if not own:
            return None
        n, x, shape = 1, 0, ""
        for c in local:
            if c.isalnum():
                x, n = x * len(own[c]) + own[c].index(c.lower() if c.isascii() else c), n * len(own[c])
            shape += "9" if c in "0123456789" else "a" if c.isascii() and c.isalpha() else f"{ord(c) >> 8}{unicodedata.category(c)}" if c.isalnum() else c
        x = self.feistel.permute(x, n, f"email{shape}@{domain.lower()}", back)
        out = ""
        for c in reversed(local):
            if c.isalnum():
                x, d = divmod(x, len(own[c]))
                c = own[c][d].upper() if c.isascii() and c.isupper() else own[c][d]
            out = c + out
        return f"{out}@{domain}"

    def _secret(self, value, plain, back):
        while True:
            value = f"{self.feistel.permute(int(value, 16), 16 ** len(value), f'secret{len(value)}', back):0{len(value)}x}"
            if not value.isdigit() and not value.isalpha():
                return value

    def replace(self, text: str | None, back: bool = False) -> tuple[str | None, list[str]]:
        """The text with pseudonyms, and the kinds replaced, in order. Runs of digits that no kind accepts stay."""
        if not text or not self.ANY.search(text):
            return text, []
        kinds, out, at, done, failed = [], [], 0, 0, []
        while m := self.FIND.search(text, at):
            kind = next(k for k, _ in self.KINDS if m[k] is not None)
            part = self.PARTS.get(kind, lambda value: (0, len(value)))
            i, j = (m.start() + x for x in part(m[0]) or (0, 0))
            new = self.of(kind, text[i:j], back) if i < j else None
            if new is None:  # a run of groups that fails as a whole and in parts may overlap a value that begins later
                at = m.end()
                if kind in self.PARTS:
                    failed.append((m.start(), m.end(), part))
                    at = m.start() + re.match("[A-Z0-9]+|\\d+", m[0]).end()
                continue
            failed = [f for f in failed if f[1] > i]
            # Walked until the text is read in the same parts as before, so that values can be given back.
            while (kind in self.PARTS and part(m[0][: i - m.start()] + new + text[j : m.end()]) != (i - m.start(), j - m.start())) or any(p((text[a:i] + new + text[j : max(b, j)])[: b - a]) for a, b, p in failed):
                new = self.of(kind, new, back)
            kinds.append(kind)
            out += text[done:i], new
            at = done = j
        return "".join(out) + text[done:], kinds


def configured_key(spark: SparkSession) -> bytes:
    """The key that the deployment sets in spark.tidemark.pii.key, or else one for trials, which anybody can reverse."""
    key = spark.conf.get("spark.tidemark.pii.key", None)
    if not key:
        warnings.warn("spark.tidemark.pii.key isn't set: pseudonyms are made with a key that everybody knows", stacklevel=2)
        key = "tidemark example key"
    return key.encode()


def pseudonymised(documents: DataFrame, key: bytes, back: bool = False, kinds: str = "__kinds") -> DataFrame:
    """documents, all columns and rows kept, with `text` replaced, and in the last column the kinds of the values replaced, in order.

    That column is called `kinds`, lengthened by underscores if documents has such a column. Null and empty texts stay.
    The same key gives the same pseudonyms in every table and run.
    """
    (kinds,) = free_names(documents, kinds)

    def start():
        own = Pseudonyms(key)

        def run(texts: list[str | None]) -> list[pa.Array]:
            found = [own.replace(t, back) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([k for _, k in found], pa.list_(pa.string()))]

        return run

    return with_columns_from(documents, "text", start, ["text", kinds], f"text string, {kinds} array<string>")
