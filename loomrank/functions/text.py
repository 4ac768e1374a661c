"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WRAP = "18446744073709551616"  # 2**64
#: The words whose stem is that of "category", by the suffixes that the steps of stem() take off; such a word after "["
#: opens a category name. A word before -ed may not end in e, as -eed stays; one that ends in s takes -es, and a doubled y is halved.
CATEGORY = "categor(?:(?:ie|ie?ative)(?:ing)?s?|(?:y|i|ie?ful)(?:ing|ed)?s?|yy(?:ing|ed)s?|ie?ness(?:(?:ing|ed)s?|es)?)(?![a-z])"


def is_category(word: Column) -> Column:
    return word.startswith("categor") & word.rlike(f"^{CATEGORY}")


def ascii_lower(s: Column) -> Column:
    """A-Z in lower case, every other character as it is. The built-in does it for ASCII texts, at a fraction of the cost."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def letter_runs(s: Column, most: int) -> Column:
    """The maximal runs of ASCII letters of a lower-case text, each cut to `most` letters."""
    return F.transform(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), lambda w: F.substring(w, 1, most))


# -- stemming: suffix steps 1a, 1b, 1c, 3 and 5 of the Porter algorithm, and 2 and 4 on demand


def shape(word: Column) -> Column:
    """C and V for each letter: a, e, i, o, u are vowels, and y is one after a consonant."""

    def add(a: Column, c: Column) -> Column:
        vowel = c.isin("a", "e", "i", "o", "u") | ((c == "y") & (F.right(a, F.lit(1)) == "C"))
        return F.concat(a, F.when(c == "", "").when(vowel, "V").otherwise("C"))

    return F.aggregate(F.split(word, ""), F.lit(""), add)


def measure(of_shape: Column) -> Column:
    """The number of vowel-consonant sequences."""
    return F.regexp_count(of_shape, F.lit("V+C"))


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _closed(word: Column, of_shape: Column) -> Column:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return of_shape.endswith("CVC") & ~F.right(word, F.lit(1)).isin("w", "x", "y")


def _double(word: Column, of_shape: Column) -> Column:
    return (F.length(word) > 1) & of_shape.endswith("C") & (F.right(word, F.lit(1)) == F.substring(word, F.length(word) - 1, F.lit(1)))


def _step_plural(w: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ies"), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)
    )


def _step_past(w: Column, s: Column) -> Column:
    """s: the shape of w."""
    end = F.when(w.endswith("ed"), 2).when(w.endswith("ing"), 3)
    stem, own = F.substring(w, F.lit(1), F.length(w) - end), F.substring(s, F.lit(1), F.length(s) - end)
    tidy = (
        F.when(stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz"), F.concat(stem, F.lit("e")))
        .when(_double(stem, own), F.when(F.right(stem, F.lit(1)).isin("l", "s", "z"), stem).otherwise(_cut(stem, 1)))
        .when((measure(own) == 1) & _closed(stem, own), F.concat(stem, F.lit("e"))).otherwise(stem)
    )
    kept = F.when(measure(_cut(s, 3)) > 0, _cut(w, 1)).otherwise(w)
    return F.when(w.endswith("eed"), kept).when(end.isNotNull() & own.contains("V"), tidy).otherwise(w)


def _step_y(w: Column, s: Column) -> Column:
    return F.when(w.endswith("y") & _cut(s, 1).contains("V"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


# The suffixes of steps 2, 3 and 4. In steps 2 and 3, what replaces the suffix where the rest has a measure
# above 0; in step 4 it goes where that is above 1. Of several suffixes that fit, the first here is tried and no other.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replacing(suffixes: dict[str, str]):
    """A step that looks for suffixes in their order and replaces the first that fits, if the rest has a measure above 0."""

    def step(w: Column, s: Column) -> Column:
        out = w
        for suffix, new in reversed(suffixes.items()):
            n = len(suffix)
            out = F.when(w.endswith(suffix), F.when(measure(_cut(s, n)) > 0, F.concat(_cut(w, n), F.lit(new))).otherwise(w)).otherwise(out)
        return out

    return step


_step_second, _step_third = _replacing(SECOND), _replacing(THIRD)


def _step_fourth(w: Column, s: Column) -> Column:
    """Of -sion and -tion only -ion goes."""
    out = w
    for suffix in reversed(FOURTH):
        n = 3 if suffix in ("sion", "tion") else len(suffix)
        out = F.when(w.endswith(suffix), F.when(measure(_cut(s, n)) > 1, _cut(w, n)).otherwise(w)).otherwise(out)
    return out


def _step_last(w: Column, s: Column) -> Column:
    m = measure(s)
    short = _cut(w, 1)
    no_e = F.when(w.endswith("e") & ((m > 1) | ((m == 1) & ~_closed(short, _cut(s, 1)))), short).otherwise(w)
    return F.when(no_e.endswith("ll") & (m > 1), _cut(no_e, 1)).otherwise(no_e)


def stem(word: Column, full: bool = False) -> Column:
    """The stem of a lower-case ASCII word; words of one or two letters stay as they are. full: with steps 2 and 4.

    Steps 1, 3 and 5 only cut letters off, or put an e or i at the end, both vowels wherever they stand. So the shape is
    computed once, and cut and mended along; step 2 puts other letters there, and the shape is computed again. One-element
    arrays keep each step's result from being computed again.
    """
    mended = lambda w, s: F.when(F.right(w, F.lit(1)).isin("e", "i"), F.concat(_cut(F.left(s, F.length(w)), 1), F.lit("V"))).otherwise(F.left(s, F.length(w)))
    pair = lambda w, s: F.struct(w.alias("w"), s.alias("s"))
    x = F.array(pair(_step_plural(word), shape(word)))
    mend = lambda p: pair(p["w"], mended(p["w"], p["s"]))
    x = F.transform(x, mend)
    for step in (_step_past, _step_y, *((_step_second,) if full else ()), _step_third, *((_step_fourth,) if full else ())):
        x = F.transform(x, (lambda f: lambda p: pair(f(p["w"], p["s"]), F.concat(p["s"], F.lit("V"))))(step))
        x = F.transform(x, mend if step not in (_step_second, _step_third) or not full else lambda p: pair(p["w"], shape(p["w"])))
    x = F.transform(x, lambda p: _step_last(p["w"], p["s"]))
    return F.when(F.length(word) <= 2, word).otherwise(F.element_at(x, 1))


# -- numbers of words and titles


def _fold(digits: Column, base: int) -> Column:
    """Digits as a number of that base, modulo 2**64, DECIMAL(20, 0)."""
    zero = F.lit(0).cast("decimal(20,0)")
    return F.aggregate(digits, zero, lambda a, d: F.pmod(a * F.lit(base).cast("decimal(3,0)") + d.cast("decimal(5,0)"), F.lit(WRAP).cast("decimal(20,0)")).cast("decimal(20,0)"))


def word_number(word: Column) -> Column:
    """The base-27 value of a lower-case ASCII word, a = 1, modulo 2**64; distinct for words up to 13 letters."""
    return _fold(F.transform(F.split(word, ""), lambda c: F.ascii(c) - 96), 27)


def word_of_number(number: Column) -> Column:
    """The word of a base-27 value below 27**13 without digits 0."""
    n, places = number.cast("decimal(20,0)"), F.sequence(F.lit(0), F.lit(12))
    power = lambda i: F.element_at(F.array(*[F.lit(str(27**k)).cast("decimal(20,0)") for k in range(13)]), i + 1)
    letter = lambda i: F.pmod((n - n % power(i)) / power(i), F.lit(27)).cast("int")
    return F.reverse(F.array_join(F.transform(F.filter(places, lambda i: n >= power(i)), lambda i: F.substring(F.lit(LOWER), letter(i), F.lit(1))), ""))


def title_number(title: Column) -> Column:
    """The base-38 value of a title's bytes modulo 2**64: letters 1 to 26, 0 to 8 as 27 to 35, the stop 37, all else by remainder."""
    code = F.hex(F.encode(ascii_lower(title), "utf-8"))
    byte = lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")

    def digit(i: Column) -> Column:
        b = byte(i)
        signed = F.when(b > 127, b - 256).otherwise(b)
        return F.when(b.between(97, 122), b - 96).when(b.between(48, 56), b - 21).when(b == 46, 37).otherwise(signed % 36)

    bytes_ = (F.length(code) / 2).cast("int")
    at = F.filter(F.sequence(F.lit(0), bytes_), lambda i: i < bytes_)
    return _fold(F.transform(at, digit), 38)


def deltas(ids: Column) -> Column:
    """Ascending numbers as differences to the one before."""
    return F.transform(ids, lambda x, i: x - F.coalesce(F.get(ids, i - 1), F.lit(0)))


def _sums(gaps: Column, first: Column) -> Column:
    start = F.struct(first.cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("all"))
    add = lambda a, g: F.struct((a["last"] + g).alias("last"), F.array_append(a["all"], a["last"] + g).alias("all"))
    return F.aggregate(gaps, start, add, lambda a: a["all"])


def undeltas(gaps: Column, length: int = 256) -> Column:
    """The numbers of which deltas() gives the differences.

    Appending copies the list so far; pieces of `length` numbers keep that short.
    """
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(gaps), F.lit(1)), F.lit(length)), lambda k: F.slice(gaps, k, length))
    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, g: a + g))
    before = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), _sums(totals, F.lit(0))), F.lit(1), F.size(totals))
    return F.flatten(F.zip_with(pieces, before, _sums))
