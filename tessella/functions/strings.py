"""Strings, numbers and small maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column, spread: str = "'s") -> Column:
    """Lower-case tokens with the separators between them kept; each character of `spread` first gets a space before it."""
    out = F.lower(text)
    for c in spread:
        out = F.replace(out, F.lit(c), F.lit(f" {c}"))
    return F.filter(F.transform(F.regexp_extract_all(out, F.lit(r"[\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+"), F.lit(0)), lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda t: t != "")


def scene_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def quoted_target(text: Column) -> Column:
    """What the first pair of double quotes holds, in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), '"(.*?)"', 1), F.lit(""))


def call_parts(text: Column) -> Column:
    """name(a, b) -> (name, [a, b])."""
    inner = F.regexp_extract(text, r"\((.*)\)", 1)
    return F.struct(F.trim(F.regexp_extract(text, r"^([^(]*)", 1)).alias("name"), F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda a: a != "").alias("args"))


def safe_name(text: Column, keep: int = 128) -> Column:
    """The last `keep` characters, with '!' for all but letters, digits, '_', '-' and '.'."""
    return F.regexp_replace(F.right(text, F.lit(keep)), "[^A-Za-z0-9_.-]", "!")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rgb(hexadecimal: Column) -> Column:
    """rrggbb -> struct(value, r, g, b)."""
    v = F.conv(hexadecimal, 16, 10).cast("int")
    return F.struct(v.alias("value"), F.shiftright(v, 16).alias("r"), F.shiftright(v, 8).bitwiseAND(255).alias("g"), v.bitwiseAND(255).alias("b"))


def short_name(handle: Column) -> Column:
    """The handle's last path part up to its first dot or colon."""
    return F.regexp_extract(handle, r"([^/]*?)(?:[.:].*)?$", 1)


# What each rule of a reply means.
GOALS = {
    1: "object_in_room",
    2: "room_only",
    3: "ambiguous_object_rooms",
    4: "ambiguous_room",
    5: "object_in_single_room",
    6: "object_repeated_in_room",
    7: "not_found",
    8: "friendly_conversation",
}


def reply_goal(reply: Column) -> Column:
    """'<rule>. <text>' -> struct(rule, kind, room, object, message, error).

    Rule 1 names 'room, object'; 2, 5 and 6 a room; 3, 4, 7 and 8 hold a message.  error tells why a reply is none: no number
    before a full stop, a number without rule, or rule 1 without comma; all else is null then."""
    number = F.trim(F.substring_index(reply, ".", 1)).try_cast("int")
    body = F.btrim(F.substring(reply, F.instr(reply, ".") + 1, F.length(reply)))
    comma = F.instr(body, ",")
    error = (
        F.when(F.coalesce(F.instr(reply, "."), F.lit(0)) == 0, "format")
        .when(number.isNull(), "format")
        .when(~number.between(1, 8), "rule")
        .when((number == 1) & (comma == 0), "room, object")
    )
    ok = lambda *rules: error.isNull() & number.isin(*rules)
    kinds = F.create_map(*[F.lit(x) for kv in GOALS.items() for x in kv])
    room = F.when(ok(1), F.btrim(F.substring(body, F.lit(1), comma - 1))).when(ok(2, 5, 6), body)
    thing = F.when(ok(1), F.btrim(F.substring(body, comma + 1, F.length(body))))
    return F.struct(F.when(error.isNull(), number).alias("rule"), F.when(error.isNull(), F.try_element_at(kinds, number)).alias("kind"), room.alias("room"), thing.alias("object"), F.when(ok(3, 4, 7, 8), body).alias("message"), error.alias("error"))


def indices_of(tokens: Column, vocabulary: Column, unknown: int) -> Column:
    """Each token's number in a map, `unknown` for others."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(vocabulary, t), F.lit(unknown)))


def bits(mask: Column, width: int = 32) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(mask, i) == 1)


def all_except(index: Column, width: int = 32) -> Column:
    """A mask of all users but one; an index below 0 leaves out none."""
    full = F.lit((1 << width) - 1)
    return F.when(index < 0, full).otherwise(full - F.pow(F.lit(2), index).cast("long"))


def cosine_decay(progress: Column) -> Column:
    """1 at progress 0 and before, 0 at 1 and after."""
    p = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
    return (1 + F.cos(p * F.pi())) / 2


def linear_decay(epoch: Column, total: Column | int) -> Column:
    """1 - epoch / total, not clamped."""
    return 1 - epoch / (F.lit(total) if isinstance(total, int) else total).cast("double")


def percent_difference(control: Column, test: Column) -> Column:
    """Null for a control of 0."""
    return F.try_divide((test - control) * 100, control)


def speed_up(control: Column, test: Column) -> Column:
    """How many times the control's value goes into the test's; null for a test of 0."""
    return F.try_divide(control, test)


def compare(a: Column, b: Column, how: str, tolerance: float = 0.0) -> Column:
    return {"greater": a > b + tolerance, "less": a < b - tolerance, "close": F.abs(a - b) <= tolerance}[how]


def partition_sizes(n: Column, bins: int) -> Column:
    """n parted into bins whose sizes differ by one at most, the larger first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (F.floor(n / bins) + F.when(i < n % bins, 1).otherwise(0)).cast("long"))


def milliseconds(seconds: Column) -> Column:
    return seconds * 1000


def sentence(ids: Column, vocabulary: Column) -> Column:
    """The words of the numbers (places in the vocabulary from 0; 0 is padding and left out), with a question mark at the end."""
    words = F.transform(F.filter(ids, lambda i: i != 0), lambda i: F.get(vocabulary, i))
    return F.concat(F.array_join(words, " "), F.lit("?"))


def base_and_ext(path: Column) -> Column:
    """struct(base, ext) of the last part of a path; the extension has its dot, '' where there is none."""
    last = F.regexp_extract(path, "[^/]*$", 0)
    part = lambda n: F.regexp_extract(last, r"^(.*?)(\.[^.]*)?$", n)
    return F.struct(part(1).alias("base"), part(2).alias("ext"))
