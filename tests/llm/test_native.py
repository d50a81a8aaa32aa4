import re
from collections import Counter

from tessella.llm import decontam, license_scan, mixing, quality

from .data import documents, empty, prose, rows


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_quality_counts(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(documents(spark, True)).collect())

    def want(text):
        w, t = words(text), text or ""
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(runs)
        covered = {j for i, x in enumerate(runs) if often[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    assert got == Counter((r[0], *want(r[1])) for r in rows())


def test_quality_rules(spark):
    good = "The river runs past the old mill and the children walk home along its bank."
    bad = ["Home | News | Sport | Shop | Help | Contact", "Buy!! This!! Now!! Or!! Miss!! It!!", "a### b%%% c$$$ d&&& e***", "All rights reserved. Privacy policy."]
    df = spark.createDataFrame([(1, good), (2, "\n".join([good] + bad[:1])), (3, "\n".join(bad)), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert got[1].kept and not got[3].kept and not got[4].kept
    assert got[2].clean_text == good and got[2].lost_words == 11
    assert got[3].clean_text == "" and got[3].lost_words == got[3].n_words
    assert quality.assess(empty(spark)).count() == 0


def test_line_rules(spark):
    fails = ["Home > News > Sport > Travel > Jobs", "Startseite » Themen » Archiv » Kontakt", "Powered by WordPress", "We use cookies: read our cookie policy and privacy policy", "Alle Rechte vorbehalten.", "En savoir plus", "Política de privacidad", "a | b | c | d"]
    stays = ["The mill was powered by water for more than a hundred years.", "Anyone may read more of his letters in the archive of the town.", "Either a or b / c may follow, as the second part of this book tells.", "Das Impressum nennt den Verlag und seine Anschrift.", "It was said > 3 times that the long and winding road > all others is closed > for most of the year to everyone."]
    text = "\n".join(fails + stays)
    got = quality.assess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.clean_text == "\n".join(stays)


def test_license(spark):
    header = license_scan.TEMPLATES[3][1]
    df = spark.createDataFrame([(1, "x y z\nreleased  UNDER the mit licence, Released under the MIT license"), (2, f"intro\n\n{header}\n\nrest of it"), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, None), (5, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.license_id, round(r.dice, 3)) for r in license_scan.scan(df).collect())
    assert got[2, "Apache-2.0", 1.0] == 1 and got[3, "MIT", 1.0] == 2 and not any(k[0] in (4, 5) for k in got)
    assert license_scan.scan(empty(spark)).count() == 0
    assert {r.doc_id for r in license_scan.scan(documents(spark, True)).collect()} == {13}


def test_whole_licences(spark):
    """Complete texts, in one paragraph, in several, and behind the marks of a comment with blank comment lines."""
    own = license_scan
    mit = ["Copyright (c) 2020 A. Body", own._MIT_GRANT, own._MIT_NOTICE, own._MIT_DISCLAIMER]
    bsd = ["Copyright 2021, A. Body. All rights reserved.", own._BSD_GRANT, own._BSD_ONE, own._BSD_TWO, own._BSD_THREE, own._BSD_DISCLAIMER]
    gnu = [own._LGPL_2, own._GNU_WARRANTY]
    code = "\n\nint main() {\n    return 0;\n}\n"
    comment = lambda parts, mark: f"\n{mark}\n".join(f"{mark} {p}" for p in parts)
    table = [(1, " ".join(mit)), (2, "\n\n".join(mit) + code), (3, comment(mit, "#") + code), (4, comment(bsd, "//") + code), (5, " ".join(bsd)), (6, comment(gnu, " *") + code), (7, own._AGPL_3), (8, f"{own._GPL_2} {own._GNU_WARRANTY}"), (9, " ".join(bsd[:4] + bsd[5:])), (10, f"{own._ISC_GRANT}\n\n{own._ISC_DISCLAIMER}"), (11, "The license of the software is to be found elsewhere, without any warranty or other conditions.")]
    got = {}
    for r in own.scan(spark.createDataFrame(table, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license_id] = r.dice
    best = {d: max(x, key=x.get) for d, x in got.items()}
    assert best == {1: "MIT", 2: "MIT", 3: "MIT", 4: "BSD-3-Clause", 5: "BSD-3-Clause", 6: "LGPL-2.1", 7: "AGPL-3.0", 8: "GPL-2.0", 9: "BSD-2-Clause", 10: "ISC"}
    assert got[3]["MIT"] == 1.0 and got[1]["MIT"] > 0.9


def test_license_gate_loses_nothing(spark):
    known = [(n, g, len(g), *license_scan.bounds(len(g), 0.8)) for n, t in license_scan.TEMPLATES if (g := license_scan.grams(license_scan.normal(t)))]
    keys = license_scan.needed(known, 0.8, [license_scan.normal(t) for _, t in license_scan.TEMPLATES])
    for _, text in license_scan.TEMPLATES:
        tokens = license_scan.normal(text)
        g = set(license_scan.grams(tokens))
        without = [w for w in tokens if not any(k in w for k in keys)]
        shared = len(g & set(license_scan.grams(without)))
        assert 2 * shared < 0.8 * (len(g) + max(len(without) - 1, 0))


def contained(text, item, k=5):
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, i = norm(text), norm(item)
    k = min(k, len(i))
    run = lambda w: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return (len(run(d) & run(i)), len(run(i))) if k else (0, 0)


def test_decontamination(spark):
    items = [(0, prose(2, 60)), (1, prose(90, 30)), (2, "one two"), (3, None), (4, ""), (5, prose(7, 3000)[:300]), (5, prose(8, 34)), (None, prose(6, 4000)[500:900])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, text, *_ in rows():
        for item, other in items:
            n, of = contained(text, other)
            if of and n >= 0.8 * of - 1e-9:
                want.add((doc, item))
    for small in (decontam.BROADCAST_WORDS, 0):  # broadcast and shuffled
        got = {(r.doc_id, r.item_id) for r in decontam.search(documents(spark, True), bench, broadcast_words=small).collect()}
        assert got == want and len(want) >= 5
    assert decontam.search(empty(spark), bench).count() == 0
    assert decontam.search(documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0
    bad = {d for d, _ in want}
    kept = decontam.remove_contaminated(documents(spark), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows() if r[0] not in bad)


def test_mixing(spark):
    for per_range in (20_000, 1):
        got = mixing.mix(documents(spark, True), range_rows=per_range).collect()
        assert len(got) == len(rows())
        sums = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            sums.setdefault((r.source_size, r.target), []).append(r.taken)
        total = sum(len(words(r[1])) for r in rows())
        assert abs(sum(k[1] for k in sums) - total) < 1e-6
        for (size, target), taken in sums.items():
            assert sum(taken) == int(target + 1e-9) and target <= 3 * size
    first = sorted(map(str, mixing.mix(documents(spark)).collect()))
    assert first == sorted(map(str, mixing.mix(documents(spark).repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix(only).collect()} == {(0, 0.0)}


def test_range_starts(spark):
    """Level by level as in one window, whatever the digits of a level."""
    import random

    rng = random.Random(1)
    table = [(s, f"{i:04x}"[:4], rng.randint(0, 50)) for s in ("a", None) for i in rng.sample(range(1 << 16), 300)]
    df = spark.createDataFrame(table, "source string, _range string, _sum long")
    want = Counter((s, r, sum(v for t, q, v in table if t == s and q < r)) for s, r, _ in table)
    for step in (1, 3, 4):
        assert Counter((x.source, x._range, x._start) for x in mixing.range_starts(df, 4, step).collect()) == want


def test_mixing_caps_are_shared_out(spark):
    per = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 20), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(per).collect()}
    assert got["b"] == 30.0 and got["c"] == 60.0
    assert abs(got["a"] - 720.0) < 1e-9 and abs(got[None] - 720.0) < 1e-9


def test_mixing_beyond_an_int(spark):
    """The sum of all sizes fits an int, three times as much doesn't."""
    per = spark.createDataFrame([("a", 300_000_000), ("b", 300_000_000), ("c", 300_000_000)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(per).collect()} == {"a": 150_000_000.0, "b": 300_000_000.0, "c": 450_000_000.0}
