"""Quality rules, line first (native)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import count_in, let, narrow, windows, words

SYMBOLS = "#*$%&|<>"
# Phrases that mark a line as site furniture, in the languages of the corpus.
BOILERPLATE = (
    "accept all cookies", "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on",
    "forgot your password", "javascript is disabled", "log in to", "lorem ipsum", "powered by", "privacy policy",
    "read more", "share this", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "folgen sie uns", "hier klicken", "impressum",
    "jetzt anmelden", "mehr erfahren", "newsletter abonnieren", "nutzungsbedingungen", "passwort vergessen", "weiterlesen",
    "abonnez vous à", "accepter les cookies", "cliquez ici", "conditions d utilisation", "en savoir plus", "lire la suite",
    "mentions légales", "mot de passe oublié", "politique de confidentialité", "suivez nous", "tous droits réservés",
    "aceptar cookies", "aviso legal", "condiciones de uso", "haga clic aquí", "iniciar sesión", "leer más", "política de cookies",
    "política de privacidad", "síguenos en", "suscríbete a", "todos los derechos reservados", "términos de servicio",
)
# What parts the items of a navigation line.
SEPARATORS = "|>»›·•→/"
#: A line of more characters is prose: it can't fail by phrases.
PHRASE_CHARS = 160
#: So many separators between items of so few words each make a line navigation.
LEAST_SEPARATORS, ITEM_WORDS = 3, 3
#: Words in such windows are repeats if the window comes twice in its text.
REPEAT_WORDS = 5
#: A document that loses a larger share of its words with the failed lines is rejected.
MAX_LOST = 0.3


def gates() -> list[str]:
    """Of each phrase its longest word: a text without any of them holds no phrase."""
    words = {max(p.split(), key=len) for p in BOILERPLATE}
    return sorted(w for w in words if not any(x != w and x in w for x in words))


def phrase_fails(line: Column) -> Column:
    """Boilerplate: a short line with two phrases of site furniture, or with one that makes up half its words.

    Phrases are whole words, in any case and with any marks between them."""

    def judge(low: Column) -> Column:
        held = [low.contains(f" {p} ") for p in BOILERPLATE]
        n = sum((h.cast("int") for h in held[1:]), held[0].cast("int"))
        n_words = sum((F.when(h, len(p.split())).otherwise(0) for h, p in zip(held[1:], BOILERPLATE[1:], strict=True)), F.when(held[0], len(BOILERPLATE[0].split())).otherwise(0))
        return (n >= 2) | ((n == 1) & (2 * n_words >= F.length(low) - F.length(F.replace(low, F.lit(" "), F.lit(""))) - 1))

    plain = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.when((F.length(line) <= PHRASE_CHARS) & let(F.lower(line), lambda low: reduce(or_, [low.contains(w) for w in gates()])), let(plain, judge)).otherwise(False)


def navigation_fails(line: Column) -> Column:
    """Navigation: items of a few words each between separators that stand by themselves."""
    n = F.size(F.split(line, rf"[\x20\x09][{SEPARATORS}]+(?=[\x20\x09])")) - 1
    return F.when(let(line, lambda x: reduce(or_, [x.contains(f" {c}") for c in SEPARATORS])), (n >= LEAST_SEPARATORS) & (F.size(words(line)) - n <= ITEM_WORDS * (n + 1))).otherwise(False)


def marks_fail(line: Column) -> Column:
    """Punctuation: symbols or doubled exclamation marks at every other word."""
    without = lambda a, b: F.length(line) - F.length(F.replace(line, F.lit(a), F.lit(b)))
    spaces = without(" ", "")
    return (2 * count_in(line, SYMBOLS) > spaces + 1) | (2 * without("!!", "!") > spaces + 1)


def repeat_words(items: Column) -> Column:
    """Words covered by windows that come twice or more, the first included.

    Windows are compared by 64-bit hashes within one text."""

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda j, d, x: F.coalesce(F.get(s, j + d)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: F.when(j > 0, same(j, -1, x)).otherwise(F.lit(False)) | same(j, 1, x))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, j: F.when(j == 0, F.lit(REPEAT_WORDS)).otherwise(F.least(F.lit(REPEAT_WORDS), x - F.get(p, F.greatest(j - 1, F.lit(0))))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(ranked, places), total))

    return let(windows(items, REPEAT_WORDS), covered)


def assess(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, base_failed, kept, clean_text.

    A line goes if a rule on marks, navigation or boilerplate fails; a document that loses more than max_lost of its words with them
    isn't kept.  A null text has no words: all counts are 0, base_failed is true and clean_text is empty.  Rows that are alike
    give rows that are alike; an empty table gives an empty one.  Everything is decided within the row, without a
    shuffle, so hot sources and groups of copies don't matter."""
    out = narrow(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumn("_words", words(F.col("text"))).withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    long = lambda c: c.cast("long")
    out = out.withColumn("n_symbols", long(count_in(F.col("text"), SYMBOLS)))
    # only texts that hold any mark, separator or word of a phrase need the rules on them
    some = lambda parts, text: reduce(or_, [text.contains(x) for x in parts])
    marked = (F.col("n_symbols") > 0) | F.col("text").contains("!!")
    parted = some([f" {c}" for c in SEPARATORS], F.col("text"))
    phrased = let(F.lower("text"), lambda t: some(gates(), t))
    rest = lambda rule: F.filter("_lines", lambda x: ~rule(x))
    every = rest(lambda x: marks_fail(x) | navigation_fails(x) | phrase_fails(x))
    out = out.withColumn("_good", F.when(~marked & ~parted & ~phrased, F.col("_lines")).when(~parted & ~phrased, rest(marks_fail)).when(~phrased, rest(lambda x: marks_fail(x) | navigation_fails(x))).otherwise(every))
    clean = F.array_join("_good", "\n")
    out = out.select(
        "doc_id",
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        "n_symbols",
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(repeat_words(F.col("_words"))).alias("n_repeat_words"),
        long(F.when(F.size("_good") == F.size("_lines"), F.lit(0)).otherwise(F.size("_words") - F.size(words(clean)))).alias("lost_words"),
        clean.alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.floor(F.lit(max_lost) * F.col("n_words"))))
