"""Text functions as native column expressions."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it, as a Java character class.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
HANGUL = "가-힣"

# Particle pairs that agree with a final consonant (with, without).
PARTICLES = [("은", "는"), ("이", "가"), ("을", "를"), ("과", "와"), ("으로", "로"), ("이라", "라"), ("이며", "며"), ("이나", "나"), ("이랑", "랑"), ("이든", "든"), ("이여", "여"), ("아", "야")]


def fold_digits(c: Column) -> Column:
    """Full-width digits as ASCII ones, position by position."""
    return F.translate(c, "０１２３４５６７８９", "0123456789")


#: White space that Java's \\s doesn't know; scan() turns it into a vertical tab, which \\s knows and [ \\t] doesn't.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def scan(c: Column) -> Column:
    """What patterns run over: ASCII digits and white space of one kind, position by position."""
    wide, odd = "０１２３４５６７８９", ODD_SPACE
    changed = F.translate(c, wide + odd, "0123456789" + "\x0b" * len(odd))
    # Most texts that are plain ASCII need no look at each character.
    return F.when(F.regexp_like(c, F.lit(r"[^\x00-\x1b\x20-\x7f]")), changed).otherwise(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, WS, "")


def digits(c: Column) -> Column:
    return F.regexp_replace(fold_digits(c), "[^0-9]", "")


def has_final(c: Column) -> Column:
    """Whether the last syllable ends in a consonant; false for anything but Hangul."""
    code = F.ascii(F.right(c, F.lit(1)))
    return code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0)


def agree(particle: Column, word: Column) -> Column:
    """The form of a particle that follows a word; others stay."""
    out = particle
    for closed, opened in PARTICLES:
        out = F.when(particle.isin(closed, opened), F.when(has_final(word), closed).otherwise(opened)).otherwise(out)
    return out


def peek(c: Column) -> Column:
    """At most two leading characters, circles for the rest, and the last one."""
    n = F.length(c)
    head = F.when(n > 3, 2).otherwise(F.when(n > 1, 1).otherwise(0))
    return F.concat(F.left(c, head), F.lit("…"), F.repeat(F.lit("○"), F.greatest(n - head - 1, F.lit(0))), F.right(c, F.lit(1)))


def code(ordinal: Column) -> Column:
    """Bijective base 26: 0 is A, 25 Z, 26 AA; 14 letters take every long."""
    left = F.struct(ordinal.cast("long").alias("n"), F.lit("").alias("text"))

    def letter(acc: Column, _: Column) -> Column:
        more = F.struct((F.call_function("div", acc["n"], F.lit(26)) - 1).alias("n"), F.concat(F.char(F.lit(65) + acc["n"] % 26), acc["text"]).alias("text"))
        return F.when(acc["n"] < 0, acc).otherwise(more)

    return F.when(ordinal >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), left, letter)["text"])


def ordinal_of(letters: Column) -> Column:
    """What code() made the letters from; null for anything but A to Z."""
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when(letters.rlike(r"^[A-Z]{1,13}\z"), value - 1)


def quoted(c: Column) -> Column:
    """A string as a Java pattern that matches just it, character by character."""
    return F.array_join(F.transform(F.split(c, ""), _hex), "")


def _hex(ch: Column) -> Column:
    return F.when(ch == "", "").otherwise(F.concat(F.lit("\\x{"), F.hex(F.ascii(ch)), F.lit("}")))


def flexible(c: Column) -> Column:
    """As quoted(), with blanks allowed between characters; white space within the value matches any."""
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.array_join(F.transform(chars, lambda ch: F.when(ch.rlike(rf"^{WS}\z"), F.lit(f"{WS}*")).otherwise(_hex(ch))), r"[ \t]*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


SPANS = "array<struct<start:int,stop:int,match:string,value:string>>"


def cuts(text: Column, pattern: Column | str, group: int = 0, needs: str | None = None, gate: Column | None = None) -> Column:
    """What spans_of() needs: gaps between matches, matches and values; null without a match. gate: a condition to look at first; needs: a cheap pattern to look for then."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole = F.regexp_extract_all(text, p, F.lit(0)).alias("w")
    made = F.struct(F.split(text, p, -1).alias("g"), whole, *([F.regexp_extract_all(text, p, F.lit(group)).alias("v")] if group else []))
    first = [gate] if gate is not None else []
    first += [F.regexp_like(text, F.lit(needs))] if needs else []
    return F.when(reduce(operator.and_, [*first, F.regexp_like(text, p)]), made)


def spans_of(cut: Column, group: int = 0) -> Column:
    """All matches from left to right, as structs of start, stop (of the whole match, from 0), match and value (of the group)."""
    sizes = F.zip_with(F.slice(cut["g"], 1, F.size(cut["w"])), cut["w"], lambda g, m: F.length(g) + F.length(m))
    zipped = F.arrays_zip(running(sizes).alias("stop"), cut["w"].alias("match"), cut["v" if group else "w"].alias("value"))
    found = F.transform(zipped, lambda x: F.struct((x["stop"] - F.length(x["match"])).alias("start"), x["stop"].alias("stop"), x["match"].alias("match"), x["value"].alias("value")))
    return F.when(cut.isNull(), F.array().cast(SPANS)).otherwise(found)


def running(sizes: Column, block: int = 256) -> Column:
    """Running sums of a non-empty array of ints, block by block: a fold that grows an array copies it at each step, so it only runs over blocks and then over their sums."""

    def fold(values: Column) -> Column:
        grown = lambda acc, v: F.concat(acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + v).cast("int")))
        return F.aggregate(values, F.array().cast("array<int>"), grown)

    def whole(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, ends, lambda b, e: F.transform(b, lambda v: v + e - F.element_at(b, -1))))

    starts = F.sequence(F.lit(1), F.size(sizes), F.lit(block))
    return let(F.transform(starts, lambda s: fold(F.slice(sizes, s, block))), whole)


def spans(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """spans_of() in one expression, for a single pattern."""
    return let(cuts(text, pattern, group), lambda c: spans_of(c, group))


def one_of(c: Column, words: Sequence[str]) -> Column:
    """Whether a text without line breaks is one of many words: one search in one literal, where a list would be as many literals."""
    return F.contains(F.lit("\n" + "\n".join(words) + "\n"), F.concat(F.lit("\n"), c, F.lit("\n")))


def window(text: Column, start: Column, stop: Column, reach: int) -> Column:
    """Text around a span, up to `reach` characters on each side."""
    first = F.greatest(start - reach, F.lit(0))
    return F.substr(text, first + 1, stop + reach - first)


def first_of(entries: Column, field: str = "value") -> Column:
    """Of structs, the first of each value of a field, in order: sorted by value and place, then by place again."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e[field].alias("v"), i.alias("i"), e.alias("e"))))
    new = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["v"] != x["v"]))
    back = F.array_sort(F.transform(let(placed, new), lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e"))))
    return F.transform(back, lambda x: x["e"])
