"""Forms of an English headword, by rules that rewrite its ending, and a check of IPA transcriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of one syllable that doubles its last letter, and one of several that may.
_DOUBLES = "^[^aeiou]*[aeiou][bdfgklmnprtvz]$"
_MAY_DOUBLE = "[^aeiou][aeiou][bdfgklmnprstvz]$"
#: What a headword's ending is, what of it goes, and what may stand instead. All rules that fit apply.
RULES = [
    (r".", "", ("", "'s")),
    (r"(?:[sxz]|ch|sh)$", "", ("es", "'")),
    (r"(?:[^sxzyh]|[aeiou]y|(?<![cs])h)$", "", ("s", "s'")),
    (r"[^aeiou]o$", "", ("es",)),
    (r"[^aeiou]y$", "y", ("ies", "ied", "ier", "iest", "ily", "iness")),
    (r"[aeiou]y$", "", ("ed", "er", "est")),
    (rf"^(?!{_DOUBLES[1:]}).*[^ec]$", "", ("ing",)),
    (rf"^(?!{_DOUBLES[1:]}).*[^eyc]$", "", ("ed", "er", "est", "en")),
    (r"(?:[^eyc]|[aeiou]y|[^i]c)$", "", ("ly", "ness")),
    (r"e$", "", ("d", "r", "st", "ness", "n")),
    (r"(?<![^aeiou]l)e$", "", ("ly",)),
    (r"[^eoyi]e$", "e", ("ing",)),
    (r"(?:ee|oe|ye)$", "", ("ing",)),
    (r"ie$", "ie", ("ying",)),
    (r"[^aeiou]le$", "e", ("y",)),
    (r"ic$", "", ("ally", "ked", "king")),
    (r"[^f]f$", "f", ("ves",)),
    (r"fe$", "fe", ("ves",)),
    (r"man$", "man", ("men",)),
    (r"sis$", "is", ("es",)),
    (r"us$", "us", ("i",)),
    (r"um$", "um", ("a",)),
]
#: What follows a doubled letter.
AFTER_DOUBLED = ("ed", "ing", "er", "est", "en")


def _of_one_word(word: Column) -> Column:
    """The forms of a word without blanks: one expression, compiled once, in which each rule is a branch."""
    none = F.array().cast("array<string>")
    made = []
    for ending, gone, others in RULES:
        stem = word.substr(F.lit(1), F.length(word) - len(gone)) if gone else word
        made.append(F.when(word.rlike(ending), F.array(*(F.concat(stem, F.lit(o)) for o in others))).otherwise(none))
    twice = F.concat(word, F.substring(word, -1, 1))
    made.append(F.when(word.rlike(_DOUBLES) | word.rlike(_MAY_DOUBLE), F.array(*(F.concat(twice, F.lit(o)) for o in AFTER_DOUBLED))).otherwise(none))
    return F.array_distinct(F.flatten(F.array(*made)))


def forms(word: Column, listed: Column | None = None) -> Column:
    """The headword's forms in lower case. Of several words the first or the last one changes, the others stay.

    ``listed``: an array of forms that no rule makes, such as *ran*; they stand for the whole headword.
    """
    head = F.lower(F.trim(word))
    first, rest = F.substring_index(head, " ", 1), F.regexp_replace(head, r"^\S+", "")
    last, before = F.substring_index(head, " ", -1), F.regexp_replace(head, r"\S+$", "")
    both = F.concat(F.transform(_of_one_word(first), lambda f: F.concat(f, rest)), F.transform(_of_one_word(last), lambda f: F.concat(before, f)))
    extra = F.transform(F.coalesce(listed, F.array().cast("array<string>")), F.lower) if listed is not None else F.array().cast("array<string>")
    return F.array_distinct(F.concat(both, extra))


#: Sounds of English in IPA, as classes: consonants, vowels, what may follow a sound, and what parts syllables. Fixed values.
_CONSONANT = "(?:[td]\\u0361?[\\u0283\\u0292]|[pbtdk\\u0261gfv\\u03B8\\u00F0sz\\u0283\\u0292hmn\\u014Bl\\u026Br\\u0279\\u027E\\u0294wj\\u028Dx\\u02A7\\u02A4\\u0263])"
_VOWEL = "[i\\u026Ae\\u025B\\u00E6a\\u0251\\u0252\\u0254o\\u028Au\\u028C\\u0259\\u025A\\u025C\\u025D\\u0250\\u0268\\u0289y\\u00F8\\u0153]"
_AFTER = "[\\u02D0\\u02D1\\u02B0\\u02B2\\u02B7\\u02DE\\u0303\\u0325\\u032A\\u032C\\u031A\\u0318\\u0319]"
_SYLLABIC = "\\u0329"
_GLIDE = "\\u032F"
_STRESS = "[\\u02C8\\u02CC]"
_SEGMENT = f"\\(?{_CONSONANT}{_AFTER}*\\)?"
_PEAK = f"(?:\\(?{_VOWEL}{_AFTER}*\\)?(?:{_VOWEL}{_GLIDE}?{_AFTER}*){{0,2}}|{_CONSONANT}{_SYLLABIC}{_AFTER}*)"
_SYLLABLE = f"(?:{_SEGMENT}){{0,4}}{_PEAK}(?:{_SEGMENT}){{0,5}}"
_WORD = f"{_STRESS}?{_SYLLABLE}(?:(?:\\.?{_STRESS}|\\.)?{_SYLLABLE})*"
_WORDS = f"{_WORD}(?:[ \\u203F]{_WORD})*"
IPA = f"^(?:/{_WORDS}/|\\[{_WORDS}\\]|{_WORDS})(?:(?:, | or )(?:/{_WORDS}/|\\[{_WORDS}\\]|{_WORDS}))*$"
#: Signs of a respelling: letters doubled, and pairs that spell one sound.
_SPELLED = "([a-z])\\1|[aeiousctgkwp]h|ck|qu|a[wy]|[eo]w|[eo]y|o[aou]|e[aeu]|[a-z]e$"


def ipa(pronunciation: Column) -> Column:
    """Whether the text is a transcription in the IPA, of one pronunciation or of several after commas.

    An automaton runs over sounds with their diacritics, in syllables that each have a peak, with stress marks before
    syllables. Plain letters alone pass if they look like no respelling; that can't tell all of them apart.
    """
    text = F.coalesce(F.trim(pronunciation), F.lit(""))
    plain = ~text.rlike("[^\\x00-\\x7F]")
    return text.rlike(IPA) & ~(plain & F.regexp_replace(text, "[/\\[\\]]", "").rlike(_SPELLED))
