from __future__ import annotations

import itertools
import random

import pytest

from wicara.operators import affixes
from wicara.operators.affixes import Prefix
from wicara.operators.stemming import stem_texts, stem_tokens


def ending_off(word, endings):
    for e in endings:
        if word.endswith(e) and len(word) - len(e) >= 3:
            return word[: -len(e)]
    return None


def forms_off(word, kind, ending, rules, first):
    """Forms after taking one more beginning off, in the order of the rules."""
    out = []
    for rule in rules:
        n = len(rule.start)
        if rule.kind == kind or not word.startswith(rule.start) or len(word) < n + 2:
            continue
        if first and (rule.kind, ending) in affixes.FORBIDDEN:
            continue
        if rule.follow and word[n] not in rule.follow or rule.after and not word[n + 1 :].startswith(rule.after):
            continue
        out.append((rule.put + word[n:], rule.kind))
    return out


def stem(word, roots, rules=affixes.PREFIXES):
    """The rules step by step, looking into the roots after every step."""
    if word in roots or len(word) < 4:
        return word
    forms, whole = [(word, "")], word
    for endings in (affixes.PARTICLES, affixes.POSSESSIVES):
        shorter = ending_off(whole, endings)
        if shorter:
            if shorter in roots:
                return shorter
            forms.append((shorter, ""))
            whole = shorter
    derived = []
    for e in affixes.DERIVATIONS:
        shorter = ending_off(whole, (e,))
        if shorter:
            if shorter in roots:
                return shorter
            derived.append((shorter, e))
    if any(word.startswith(a) and word.endswith(b) for a, b in affixes.PREFIX_FIRST):
        tried = forms + derived
    else:
        tried = derived + forms[::-1]
    for form, ending in tried:
        at = [(form, "")]
        for level in range(3):
            at = [f for w, kind in at for f in forms_off(w, kind, ending, rules, level == 0)]
            for w, _ in at:
                if w in roots:
                    return w
    return word


KNOWN = {
    "makanan": "makan", "memakan": "makan", "dimakan": "makan", "mengatakan": "kata", "berjalan": "jalan",
    "perjalanan": "jalan", "memperbaiki": "baik", "menyapu": "sapu", "penyanyi": "nyanyi", "pelajar": "ajar",
    "belajar": "ajar", "bekerja": "kerja", "pekerjaan": "kerja", "bukunya": "buku", "bukukah": "buku", "mengecat": "cat",
    "menulis": "tulis", "penulis": "tulis", "pembaca": "baca", "membacakannya": "baca", "keadilan": "adil",
    "berlarilah": "lari", "mempermainkan": "main", "ketidakadilan": "tidakadil", "mengambil": "ambil", "pengusaha": "usaha",
    "terasa": "rasa", "keberanian": "berani", "dipertanyakan": "tanya", "memukul": "pukul", "perawatan": "rawat",
    "xyzabc": "xyzabc", "ke": "ke", "dia": "dia",
}
ROOTS = sorted({*KNOWN.values()} - {"xyzabc", "ke"})


def table(spark, words, name):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def test_known_words(spark):
    got = stem_tokens(table(spark, [*KNOWN, None], "token"), table(spark, [*ROOTS, ROOTS[0], None], "root"))
    assert {r["token"]: r["stem"] for r in got.collect()} == KNOWN
    assert {w: stem(w, set(ROOTS)) for w in KNOWN} == KNOWN


def planted(r, roots):
    for _ in range(1200):
        word = r.choice(roots)
        for rule in r.sample(affixes.PREFIXES, r.randrange(4)):
            word = rule.start + (word[len(rule.put) :] if word.startswith(rule.put) else word)
        yield word + "".join(r.choice(["", "", *e]) for e in (affixes.DERIVATIONS, affixes.POSSESSIVES, affixes.PARTICLES))


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_steps_in_any_order_of_the_rules(spark, seed):
    r = random.Random(seed)
    letters = "aiuerlmnkstbp"
    roots = ["".join(r.choice(letters) for _ in range(r.randrange(2, 6))) for _ in range(150)]
    tokens = sorted({*planted(r, roots), *("".join(r.choice(letters) for _ in range(r.randrange(9))) for _ in range(300))})
    rules = list(affixes.PREFIXES)
    if seed:
        r.shuffle(rules)
    got = {x["token"]: x["stem"] for x in stem_tokens(table(spark, tokens, "token"), table(spark, roots, "root"), rules=rules).collect()}
    want = {t: stem(t, set(roots), rules) for t in tokens}
    assert got == want
    assert sum(t != s for t, s in want.items()) > 300


def test_every_order_of_conflicting_rules(spark):
    rules = [Prefix("me", "men", "aiueo", "t"), Prefix("me", "men", "aiueo", "n"), Prefix("me", "men", "a")]
    roots = ["tari", "nari", "ari"]
    for order in itertools.permutations(rules):
        got = stem_tokens(table(spark, ["menari"], "token"), table(spark, roots, "root"), rules=order).first()["stem"]
        assert got == stem("menari", set(roots), order)


def test_stem_texts(spark):
    df = spark.createDataFrame([(1, "dia membacakannya di perjalanan"), (2, None), (3, ""), (4, "xyz")], "id int, t string")
    got = stem_texts(df, "t", "id", table(spark, ROOTS, "root")).orderBy("id").collect()
    assert [r["text_processed"] for r in got] == ["dia baca di jalan", "", "", "xyz"]
    assert stem_tokens(table(spark, [], "token"), table(spark, ROOTS, "root")).collect() == []
    assert stem_tokens(table(spark, ["makanan"], "token"), table(spark, [], "root")).first()["stem"] == "makanan"


def test_a_rule_must_fit_its_kind():
    with pytest.raises(ValueError):
        Prefix("me", "ber")


def test_each_distinct_word_is_framed_once(spark):
    """The words are made distinct before they are framed, also where nothing is written in between."""
    from wicara.catalog import stemming as catalog

    words = spark.createDataFrame([("makan",), ("makan",), ("jalan",)], "word string").repartition(2)
    plan = catalog.stem_framed(words)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(CASE WHEN (substr(md5(" not in plan  # a filter on every occurrence
    assert catalog.stem_framed(words).count() == 2
