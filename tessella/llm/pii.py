"""PII: keyed format-preserving pseudonyms by Feistel networks (free style)."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import in_batches

#: The key of the queries; whoever keeps real pseudonyms passes a secret one, in the pipeline by the session's setting KEY_SETTING.
KEY, KEY_SETTING = b"pseudonyms of the example queries", "spark.tessella.pii.key"
ROUNDS = 8
# The character classes that a pseudonym keeps, place by place.
DIGITS, LOWERS, UPPERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Kinds in the order in which they are tried at a place.
KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date")
PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<secret>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:password|passwd|secret|api_key|token)\s?[=:]\s?["']?[A-Za-z0-9_+/.-]*[A-Za-z0-9]{8}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,255}|sk-[A-Za-z0-9_-]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255})(?![A-Za-z0-9])
        |-----BEGIN\ (?:[A-Z]+\ )*PRIVATE\ KEY-----[A-Za-z0-9+/=\s]+-----END\ (?:[A-Z]+\ )*PRIVATE\ KEY-----)
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
    |(?P<phone>(?<![0-9])(?:\+1[ -]?)?(?:\([0-9]{3}\)\ ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])|(?<![0-9+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9]))
    |(?P<date>(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]))""",
    re.X | re.A,
)
#: Each kind on its own, and cards written without separators or in the usual groups.
EACH = {k: re.compile(x, re.X | re.A) for k, x in zip(KINDS, re.split(r"\n\s*\|(?=\(\?P<)", PATTERN.pattern), strict=True)}
# Leading digits of cards with the lengths that they have.
ISSUERS = (
    (range(4, 5), (13, 16, 19)),
    (range(34, 35), (15,)),
    (range(36, 37), (14, 16, 19)),
    (range(37, 38), (15,)),
    (range(38, 40), (14, 16, 19)),
    (range(50, 51), range(13, 20)),
    (range(51, 56), (16,)),
    (range(56, 59), range(13, 20)),
    (range(62, 63), range(16, 20)),
    (range(65, 66), (16, 19)),
    (range(67, 68), range(13, 20)),
    (range(300, 306), (14, 16, 19)),
    (range(644, 650), (16, 19)),
    (range(2221, 2721), (16,)),
    (range(3528, 3590), range(16, 20)),
    (range(6011, 6012), (16, 19)),
)
USUAL_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", re.A)
#: Kinds that the card pattern can take in, and those of which a shorter end may be valid; the character that can't follow them.
INSIDE_CARD, OPEN_ENDED = ("phone", "ssn", "date"), {"iban": re.compile("[A-Za-z0-9]"), "card": re.compile("[0-9]")}
# Telephone codes of two digits; those that begin with 1 or 7 have one, all others three.
COUNTRIES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: A text without any of these can hold none of the kinds.
TRIGGER = re.compile(r"[0-9@=:]|AKIA|ASIA|[a-f]{32}|[A-F]{32}|gh[pousr]_|github_pat_|sk-|xox[abprs]-|-----BEGIN")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, walked until it falls within."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            message = b"%d" % r + tweak.encode() + b"\0" + right.to_bytes(width, "big")
            if width <= 64:
                digest = hashlib.blake2b(message, key=hashlib.sha256(key).digest(), digest_size=max(8, width)).digest()
            else:  # a half wider than that function's output
                digest = hashlib.shake_256(hashlib.sha256(key).digest() + message).digest(width)
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def permute_text(text: str, key: bytes, tweak: str, keep: Callable[[int, str], str | None]) -> str:
    """Permutes the strings that have the same class at each place; `keep(place, character)` gives the class, None for a fixed character."""
    classes = [keep(i, c) for i, c in enumerate(text)]
    size, value = 1, 0
    for c, cls in zip(text, classes, strict=True):
        if cls:
            size, value = size * len(cls), value * len(cls) + cls.index(c)
    value = permute(value, size, key, f"{tweak}{size}")
    out = []
    for c, cls in zip(reversed(text), reversed(classes), strict=True):
        if cls:
            value, at = divmod(value, len(cls))
            c = cls[at]
        out.append(c)
    return "".join(reversed(out))


def alphanumeric(_: int, c: str) -> str | None:
    return next((cls for cls in (DIGITS, LOWERS, UPPERS) if c in cls), None)


def digits(_: int, c: str) -> str | None:
    return DIGITS if c in DIGITS else None


def luhn(number: str) -> int:
    """The check digit that makes number + digit valid."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def email(s: str, key: bytes) -> str:
    name, _, top = s.rpartition(".")
    return f"{permute_text(name, key, 'email', alphanumeric)}.{top}"


def secret(s: str, key: bytes) -> str:
    hexadecimal = lambda x: HEX if re.fullmatch("[0-9a-f]+", x) else HEX.upper() if re.fullmatch("[0-9A-F]+", x) else None
    if found := hexadecimal(s):
        return permute_text(s, key, "hex" if found == HEX else "HEX", lambda _, c: found)
    if s.startswith("-----"):  # line by line, what frames it left as it is
        return "".join(x if x.startswith("-----") else permute_text(x, key, "pem", alphanumeric) for x in re.split(r"(-----[A-Z ]+-----|\n)", s))
    lead = re.match(r"AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|[a-z_]+\s?[=:]\s?[\"']?", s)[0]
    body = s[len(lead) :]
    if found := hexadecimal(body):
        return lead + permute_text(body, key, "hex" if found == HEX else "HEX", lambda _, c: found)
    if lead in ("AKIA", "ASIA"):
        return lead + permute_text(body, key, "key", lambda _, c: UPPERS + DIGITS)
    return lead + permute_text(body, key, "secret", alphanumeric)


def iban(s: str, key: bytes) -> str | None:
    number = lambda x: int("".join(str(int(c, 36)) for c in x.replace(" ", "")))
    if not 15 <= len(s.replace(" ", "")) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = permute_text(s[4:], key, "iban" + s[:2], alphanumeric)
    return f"{s[:2]}{98 - number(body + s[:2] + '00') % 97:02d}{body}"


def issued(number: str) -> bool:
    """Whether cards with these leading digits and this length are issued."""
    return any(len(number) in sizes and int(number[: len(str(lead[0]))]) in lead for lead, sizes in ISSUERS)


def card(s: str, key: bytes) -> str | None:
    bare = lambda x: re.sub("[ -]", "", x)
    number = bare(s)
    if luhn(number[:-1]) != int(number[-1]) or not issued(number):
        return None
    while True:  # walks among issued numbers, which stays a permutation
        s = permute_text(s[:-1], key, "card", digits)
        s += str(luhn(bare(s)))
        if issued(bare(s)):
            return s


def phone(s: str, key: bytes) -> str | None:
    """Numbers of ten digits, with +1 or without, share a stand-in in all their forms, possible ones a possible one; numbers of
    other countries (8 to 15 digits in all) keep the country's code."""
    bare = lambda x: re.sub("[^0-9]", "", x)
    if s[0] == "+" and (len(bare(s)) != 11 or s[1] != "1"):
        code = 1 if s[1] in "17" else 2 if bare(s)[:2] in COUNTRIES else 3
        lead = re.match(rf"\+(?:[^0-9]*[0-9]){{{code}}}", s)[0]
        return lead + permute_text(s[len(lead) :], key, f"phone{bare(lead)}", digits)
    lead = re.match(r"\+1[ .-]?|", s)[0]
    body = s[len(lead) :]
    possible = lambda x: re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", bare(x)) is not None
    kind = possible(body)
    while True:
        body = permute_text(body, key, "phone", digits)
        if possible(body) == kind:
            return lead + body


def ssn(s: str, key: bytes) -> str | None:
    valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    if not valid(s):
        return None
    s = permute_text(s, key, "ssn", digits)
    while not valid(s):
        s = permute_text(s, key, "ssn", digits)
    return s


def ip(s: str, key: bytes) -> str | None:
    """IPv4 addresses, and IPv6 ones of at least four groups, whose stand-in is in the usual short form."""
    if ":" in s:
        if len(re.findall("[0-9A-Fa-f]+", s)) < 4:
            return None
        try:
            value = int(ipaddress.IPv6Address(s))
        except ValueError:
            return None
        return str(ipaddress.IPv6Address(permute(value, 1 << 128, key, "ip6")))
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def date(s: str, key: bytes) -> str | None:
    """ISO dates, and month/day/year or else day/month/year, within 1900 to 2099; the order of the parts stays, and a day has one
    stand-in in all forms."""
    for form in ("%Y-%m-%d",) if "-" in s else ("%m/%d/%Y", "%d/%m/%Y"):
        try:
            day = datetime.datetime.strptime(s, form).date().toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            other = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            return other.strftime(form)
    return None


MAKERS: dict[str, Callable[[str, bytes], str | None]] = {"email": email, "secret": secret, "iban": iban, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date}


@lru_cache(10_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The stand-in of a value in its own format; None if the value isn't valid for its kind.  The same for the same key, always."""
    return MAKERS[kind](value, key)


def holds_other(text: str, start: int, end: int, key: bytes) -> bool:
    """Whether a valid value of another kind, or a card in the usual form, begins within."""
    for kind, pattern in [*((k, EACH[k]) for k in INSIDE_CARD), ("card", USUAL_CARD)]:
        if any(pseudonym(kind, m[0], key) is not None for m in pattern.finditer(text, start, min(len(text), end + 40)) if m.start() < end):
            return True
    return False


def value_at(text: str, start: int, key: bytes) -> tuple[str, int, str] | None:
    """kind, end and stand-in of the valid value that begins at `start`.

    Kinds are tried in their order, each from its longest end to shorter ones; but a phone, SSN or date comes before a card,
    and so does a card in the usual form before other groups of digits, which are one only if they hold none of these."""

    def tried(kind: str, pattern: re.Pattern) -> tuple[str, int, str] | None:
        m = pattern.match(text, start)
        out = m and pseudonym(kind, m[0], key)
        return (kind, m.end(), out) if out is not None else None

    for kind in KINDS:
        if kind not in OPEN_ENDED:
            if found := tried(kind, EACH[kind]):
                return found
            continue
        m = EACH[kind].match(text, start)
        if m and kind == "card":
            for other, pattern in [*((k, EACH[k]) for k in INSIDE_CARD), ("card", USUAL_CARD)]:
                if found := tried(other, pattern):
                    return found
        for end in range(m.end(), start, -1) if m else ():
            if OPEN_ENDED[kind].match(text, end) or not EACH[kind].fullmatch(text, start, end):
                continue
            out = pseudonym(kind, text[start:end], key)
            if out is not None and not (kind == "card" and holds_other(text, start, end, key)):
                return kind, end, out
    return None


def mask(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many there were of each kind."""
    found: dict[str, int] = {}
    parts, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        hit = value_at(text, m.start(), key)
        if hit is None:  # what isn't one may hold another
            at = m.start() + 1
            continue
        kind, at, out = hit
        parts += [text[done : m.start()], out]
        done, found[kind] = at, found.get(kind, 0) + 1
    return "".join([*parts, text[done:]]), found


def key_of(spark: SparkSession) -> bytes:
    """The session's key, KEY where none is set."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else KEY


def pseudonymise(docs: DataFrame, key: bytes = KEY, counts: bool = True) -> DataFrame:
    """docs with the values in `text` replaced; n_<kind> and n_pii are added if `counts` (they replace columns of these names).

    A null text stays null with counts of 0.  Each kind is one keyed permutation of its format, so equal values get
    equal stand-ins in all documents and different values different ones.  n_chars, if there, follows the new text.  Empty texts
    stay, rows that repeat are alike afterwards, an empty table gives an empty one; no row moves, so no group can be hot."""
    extra = [f"n_{k}" for k in KINDS] + ["n_pii"] if counts else []
    names = [c for c in docs.columns if c not in extra]
    docs = docs.select(*[docs[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                at = batch.schema.get_field_index("text")
                texts, tallies = [], []
                for t in batch.column(at).to_pylist():
                    found: dict[str, int] = {}
                    if t is not None and TRIGGER.search(t):
                        t, found = mask(t, key)
                    texts.append(t)
                    tallies.append(found)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
                for k in KINDS if counts else ():
                    batch = batch.append_column(f"n_{k}", pa.array([x.get(k, 0) for x in tallies], pa.int64()))
                if counts:
                    batch = batch.append_column("n_pii", pa.array([sum(x.values()) for x in tallies], pa.int64()))
                yield batch

    out = in_batches(docs, run, StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in extra]]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
