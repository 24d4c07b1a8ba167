"""Affix rules of Indonesian and the forms of a word they lead to.

Confix stripping: endings go in the order particle, possessive, derivation; beginnings go one after
another, with the first letter of the root restored where a nasal prefix has swallowed it. Every form on
the way is a candidate for a root. The candidates of a word carry the order in which they are tried, so
that one join with the roots finds the first that is one.

The order: the word and its forms without endings; then up to three beginnings taken off, first from
the form without endings and then from those with endings restored one by one (the other way round
where ``prefix_first`` holds); fewer beginnings before more, then the order of the rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.functions.columns import bind, constant

# Letters, endings and combinations of the published stemming rules for Indonesian.
VOWELS = "aiueo"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
PARTICLES = ("lah", "kah", "tah", "pun")
POSSESSIVES = ("nya", "ku", "mu")
DERIVATIONS = ("kan", "an", "i")
# A beginning never goes together with this ending.
FORBIDDEN = (
    ("be", "i"), ("di", "an"), ("ke", "i"), ("ke", "kan"), ("me", "an"), ("se", "i"), ("se", "kan"), ("te", "an"),
)
# Words that start and end so lose the beginning first.
PREFIX_FIRST = (("be", "lah"), ("be", "an"), ("me", "i"), ("di", "i"), ("pe", "i"), ("te", "i"))
LEVELS = 3  # beginnings taken off one word
SHORTEST = 4  # letters of a word that is looked at
LEAST_LEFT = 2  # letters a beginning leaves
LEAST_STEM = 3  # letters an ending leaves


@dataclass(frozen=True)
class Prefix:
    """Take ``start`` off before one of ``follow`` (any letter if empty) and ``after``, and put ``put`` there."""

    kind: str
    start: str
    follow: str = ""
    put: str = ""
    after: str = ""

    def __post_init__(self):
        if not self.start.startswith(self.kind) or len(self.kind) != 2:
            raise ValueError("a rule starts with the two letters of its kind")


def without(letters: str) -> str:
    return "".join(c for c in CONSONANTS if c not in letters)


# Beginnings and what they do to the first letter, in the order they are tried.
PREFIXES = (
    Prefix("di", "di"),
    Prefix("ke", "ke"),
    Prefix("se", "se"),
    Prefix("be", "ber", VOWELS),
    Prefix("be", "ber", VOWELS, "r"),
    Prefix("be", "ber", without("r")),
    Prefix("be", "bel", "a"),
    Prefix("be", "be", without("rl"), after="er"),
    Prefix("te", "ter", VOWELS),
    Prefix("te", "ter", VOWELS, "r"),
    Prefix("te", "ter", without("r")),
    Prefix("te", "te", without("r"), after="er"),
    Prefix("me", "me", "lrwy"),
    Prefix("me", "mem", "bfvp"),
    Prefix("me", "mem", VOWELS + "r", "m"),
    Prefix("me", "mem", VOWELS + "r", "p"),
    Prefix("me", "men", "cdjstz"),
    Prefix("me", "men", VOWELS, "n"),
    Prefix("me", "men", VOWELS, "t"),
    Prefix("me", "meng", "ghqk"),
    Prefix("me", "meng", VOWELS),
    Prefix("me", "meng", VOWELS, "k"),
    Prefix("me", "menge", CONSONANTS),
    Prefix("me", "meny", VOWELS, "s"),
    Prefix("me", "meny", VOWELS, "ny"),
    Prefix("pe", "pe", "wy"),
    Prefix("pe", "per", VOWELS),
    Prefix("pe", "per", VOWELS, "r"),
    Prefix("pe", "per", without("r")),
    Prefix("pe", "pem", "bfv"),
    Prefix("pe", "pem", VOWELS + "r", "m"),
    Prefix("pe", "pem", VOWELS + "r", "p"),
    Prefix("pe", "pen", "cdjstz"),
    Prefix("pe", "pen", VOWELS, "n"),
    Prefix("pe", "pen", VOWELS, "t"),
    Prefix("pe", "peng", "ghqk"),
    Prefix("pe", "peng", VOWELS),
    Prefix("pe", "peng", VOWELS, "k"),
    Prefix("pe", "penge", CONSONANTS),
    Prefix("pe", "peny", VOWELS, "s"),
    Prefix("pe", "peny", VOWELS, "ny"),
    Prefix("pe", "pel", VOWELS, "l"),
    Prefix("pe", "pel", "a"),
    Prefix("pe", "pe", without("rwylmn")),
)

def _quoted(value: str) -> str:
    return "'" + value + "'"


def _shorter(word: str, endings: Sequence[str]) -> str:
    """SQL: ``word`` without the first of these endings it has, else null."""
    cases = " ".join(
        f"when endswith({word}, '{e}') and length({word}) >= {len(e) + LEAST_STEM} then left({word}, length({word}) - {len(e)})"
        for e in endings
    )
    return f"case {cases} end"


def _form(place: int, word: str, ending: str = "") -> str:
    made = f"named_struct('phase', 0, 'rank', {place}, 'level', 0, 'r1', 0, 'r2', 0, 'r3', 0, 'word', w, 'kind', '', 'ending', {_quoted(ending)})"
    return f"element_at(transform(array({word}), w -> if(w is null, null, {made})), 1)"


RULE = "struct<n:int,start:string,follow:string,put:string,after:string,never:array<string>>"


def _rules_by_kind(rules: Sequence[Prefix]) -> Column:
    """The rules of each kind as one constant map, which keeps the expressions small."""
    kinds: dict[str, list[dict]] = {}
    for number, rule in enumerate(rules, 1):
        never = [ending for kind, ending in FORBIDDEN if kind == rule.kind]
        row = {"n": number, "start": rule.start, "follow": rule.follow, "put": rule.put, "after": rule.after, "never": never}
        kinds.setdefault(rule.kind, []).append(row)
    return constant(kinds, f"map<string,array<{RULE}>>")


def _next(forms: Column, rules: Column, level: int, rank: Column) -> Column:
    """The forms that one more beginning taken off those of ``forms`` leads to."""

    def taken(c: Column) -> Column:
        word, kind = c["word"], F.left(c["word"], F.lit(2))

        def fits(r: Column) -> Column:
            size = F.length(r["start"])
            ok = F.startswith(word, r["start"]) & (F.length(word) >= size + LEAST_LEFT)
            ok &= (r["follow"] == "") | (F.instr(r["follow"], F.substring(word, size + 1, F.lit(1))) > 0)
            ok &= (r["after"] == "") | F.startswith(F.substring(word, size + 2, F.length(r["after"])), r["after"])
            return ok & ~F.array_contains(r["never"], c["ending"]) if level == 1 else ok

        def made(r: Column) -> Column:
            numbers = [(r["n"] if k == level else c[f"r{k}"]).alias(f"r{k}") for k in range(1, LEVELS + 1)]
            left = F.concat(r["put"], F.substring(word, F.length(r["start"]) + 1, F.length(word)))
            shape = (F.lit(1).alias("phase"), (rank_of(c)).alias("rank"), F.lit(level).alias("level"))
            return F.struct(*shape, *numbers, left.alias("word"), kind.alias("kind"), c["ending"].alias("ending"))

        return F.transform(F.filter(F.try_element_at(rules, F.when(c["kind"] != kind, kind)), fits), made)

    def rank_of(c: Column) -> Column:
        # where beginnings go first: forms in their order; else those without derivation, then the others restored
        restored = F.when(c["rank"] > 2, c["rank"] - 10).otherwise(-c["rank"])
        return F.when(rank, c["rank"]).otherwise(restored) if level == 1 else c["rank"]

    return F.flatten(F.filter(F.transform(forms, taken), lambda found: found.isNotNull()))


def with_candidates(tokens: DataFrame, token: str = "token", rules: Sequence[Prefix] = PREFIXES) -> DataFrame:
    """Append ``candidates``: structs (phase, rank, level, r1, r2, r3, word, kind, ending) of each word.

    Sorted by their fields they come in the order in which they are tried.
    """
    first = F.lit(False)
    for start, end in PREFIX_FIRST:
        first = first | (F.startswith(F.col(token), F.lit(start)) & F.endswith(F.col(token), F.lit(end)))
    # bound step by step: the optimizer would copy nested steps into one another and into every filter
    parts = bind(tokens, "_p", F.expr(_shorter(token, PARTICLES)))
    parts = bind(parts, "_s", F.expr(_shorter(f"coalesce(_p, {token})", POSSESSIVES)))
    forms = [_form(0, token), _form(1, "_p"), _form(2, "_s")]
    forms += [_form(3 + k, _shorter(f"coalesce(_s, _p, {token})", [e]), e) for k, e in enumerate(DERIVATIONS)]
    made = bind(parts, "_forms", F.expr(f"filter(array({', '.join(forms)}), x -> x is not null)"))
    known = _rules_by_kind(rules)
    before = F.when(F.length(token) >= SHORTEST, F.col("_forms")).otherwise(F.slice("_forms", 1, 0))
    levels = ["_forms"]
    for level in range(1, LEVELS + 1):
        made = bind(made, f"_l{level}", _next(before, known, level, first))
        before = F.col(f"_l{level}")
        levels.append(f"_l{level}")
    return made.withColumn("candidates", F.concat(*levels)).drop("_p", "_s", *levels)
