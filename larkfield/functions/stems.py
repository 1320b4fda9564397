"""English stems by the suffix rules that M. F. Porter published in 1980, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of consonant and vowel groups; y counts as a vowel after a consonant.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Stem holds at least one, or at least two, vowel-consonant groups.
SOME = f"^({_CONSONANTS})?{_VOWELS}{_CONSONANTS}"
MORE = f"{SOME}{_VOWELS}{_CONSONANTS}"
ONE = f"{SOME}({_VOWELS})?$"
HAS_VOWEL = f"^({_CONSONANTS})?[aeiouy]"
#: Consonant, vowel, consonant other than w, x and y, and nothing else.
SHORT = f"^{_CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Fixed values of the published rules: suffix, what stands in for it, and what
# the rest of the word must match. The longest suffix of a step decides.
PLURALS = (("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", ""))
DOUBLE_SUFFIXES = tuple((a, b, SOME) for a, b in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble")))
ADJECTIVES = tuple((a, b, SOME) for a, b in (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
ENDINGS = tuple((a, "", MORE) for a in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous",
    "ive", "ize")) + (("ion", "", f"{SOME}{_VOWELS}([^aeiou].*)?[st]$"),)


def longest_first(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[0]))


def _bound(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that is computed once, however often the step names it."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def _cut(word: Column, letters: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - letters)


def _replace(rules: Sequence[tuple[str, str, str]]) -> Callable[[Column], Column]:
    def step(word: Column) -> Column:
        out = F
        for suffix, other, needed in longest_first(rules):
            rest = _cut(word, len(suffix))
            new = F.concat(rest, F.lit(other))
            if needed:
                new = F.when(rest.rlike(needed), new).otherwise(word)
            out = out.when(F.endswith(word, F.lit(suffix)), new)
        return out.otherwise(word)
    return step


def _past(word: Column) -> Column:
    """-eed, -ed and -ing; what is left gets its e or single consonant back."""
    def mend(rest: Column) -> Column:
        return (F.when(rest.rlike("(at|bl|iz)$") | rest.rlike(SHORT), F.concat(rest, F.lit("e")))
                .when(rest.rlike(DOUBLED), _cut(rest, 1)).otherwise(rest))

    ed, ing = _cut(word, 2), _cut(word, 3)
    return (F.when(F.endswith(word, F.lit("eed")), F.when(ing.rlike(SOME), _cut(word, 1)).otherwise(word))
            .when(F.endswith(word, F.lit("ed")) & ed.rlike(HAS_VOWEL), _bound(ed, mend))
            .when(F.endswith(word, F.lit("ing")) & ing.rlike(HAS_VOWEL), _bound(ing, mend)).otherwise(word))


def _final_y(word: Column) -> Column:
    rest = _cut(word, 1)
    return F.when(F.endswith(word, F.lit("y")) & rest.rlike(HAS_VOWEL), F.concat(rest, F.lit("i"))).otherwise(word)


def _final_e(word: Column) -> Column:
    rest = _cut(word, 1)
    return F.when(F.endswith(word, F.lit("e")) & (rest.rlike(MORE) | (rest.rlike(ONE) & ~rest.rlike(SHORT))), rest).otherwise(word)


def _final_l(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit("ll")) & _cut(word, 1).rlike(MORE), _cut(word, 1)).otherwise(word)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words with other characters than a to z, or of under three letters, stay."""
    def steps(w: Column) -> Column:
        out = w
        for step in (_replace(PLURALS), _past, _final_y, _replace(DOUBLE_SUFFIXES), _replace(ADJECTIVES), _replace(ENDINGS), _final_e, _final_l):
            out = _bound(out, step)
        return F.when(w.rlike("^[a-z]{3,}$"), out).otherwise(w)

    return _bound(word, steps)
