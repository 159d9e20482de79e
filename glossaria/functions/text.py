"""Column functions of a card's front: sentences, keys and choices."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript's trim takes off, as a Java character class. A zero-width space isn't in it.
_BLANK = r"[\s\p{Z}\x{FEFF}]"
KEY_PREFIX = "vocab-sentence-"


def sentence_list(sentences: Column) -> Column:
    """Split at pipes, trimmed, without the empty ones; null for null."""
    trimmed = F.transform(F.split(sentences, "[|]"), lambda s: F.regexp_replace(s, f"^{_BLANK}+|{_BLANK}+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def plain_text(value: Column) -> Column:
    """Without markup: everything between angle brackets goes."""
    return F.regexp_replace(value, "<[^>]*>", "")


def state_key(word: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), plain_text(word))


def seeded_pick(items: Column, key: Column) -> Column:
    """The element that the md5 of ``key`` chooses; null for an empty list."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.get(items, F.try_mod(number, F.size(items).cast("long")).cast("int"))


def random_pick(items: Column) -> Column:
    """Any element with the same probability, another in every run; null for an empty list."""
    return F.get(items, F.floor(F.rand() * F.size(items)).cast("int"))


def needs_choice(stored: Column, items: Column) -> Column:
    """Whether nothing is stored or what is stored isn't among the sentences any more."""
    return stored.isNull() | (stored == "") | ~F.coalesce(F.array_contains(items, stored), F.lit(False))
