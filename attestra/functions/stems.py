"""Lexemes: words as they are, or without their Russian endings, as ordered rules on columns."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The vowels and the endings of the published Russian suffix-stripping algorithm, by its steps. A pattern
# finds its longest ending, as it is the one that begins first; those in `after` stand behind а or я, which stays.
VOWELS = "аеиоуыэюя"
_ENDINGS = {
    "gerund": ("вшись|вши|в", "ившись|ивши|ив|ывшись|ывши|ыв"),
    "reflexive": ("", "ся|сь"),
    "adjective": ("", "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"),
    "participle": ("ем|нн|вш|ющ|щ", "ивш|ывш|ующ"),
    "verb": ("ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно", "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю"),
    "noun": ("", "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"),
}


def _pattern(name: str) -> str:
    after, free = _ENDINGS[name]
    return rf"(?:([ая])(?:{after})|(?:{free}))$" if after else rf"(?:{free})$"


#: The patterns, with what stays of a match as its first group. They have no look-around, so that any engine takes them.
GERUND, REFLEXIVE, VERB, NOUN = (_pattern(n) for n in ("gerund", "reflexive", "verb", "noun"))
ADJECTIVAL = rf"(?:(?:([ая])(?:{_ENDINGS['participle'][0]})|(?:{_ENDINGS['participle'][1]})))?(?:{_ENDINGS['adjective'][1]})$"
TO_FIRST_VOWEL = rf"^[^{VOWELS}]*[{VOWELS}]"
TO_SECOND_REGION = rf"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}]"
CYRILLIC = "[а-яё]"


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def russian_stem(word: Column) -> Column:
    """The stem of a lower-case word; words without Cyrillic letters, and those without a vowel, stay as they are."""

    def without(x: Column, pattern: str, otherwise) -> Column:
        return _let(F.regexp_replace(x, pattern, "$1" if "([ая])" in pattern else ""), lambda y: F.when(y != x, y).otherwise(otherwise(x)))

    def of(w: Column) -> Column:
        head = F.regexp_extract(w, TO_FIRST_VOWEL, 0)
        second = F.char_length(F.regexp_extract(w, TO_SECOND_REGION, 0))  # 0: there is none

        def endings(rest: Column) -> Column:
            name = lambda x: without(x, VERB, lambda y: F.regexp_replace(y, NOUN, ""))
            return without(rest, GERUND, lambda x: _let(F.regexp_replace(x, REFLEXIVE, ""), lambda y: without(y, ADJECTIVAL, name)))

        def derived(x: Column) -> Column:
            here = F.char_length(F.concat(head, F.regexp_replace(x, "ость?$", "")))
            return F.when(x.rlike("ость?$") & (second > 0) & (here >= second), F.regexp_replace(x, "ость?$", "")).otherwise(x)

        def tidied(x: Column) -> Column:
            most = F.regexp_replace(F.regexp_replace(x, "ейше?$", ""), "нн$", "н")
            return F.when(x.rlike("ейше?$|нн$"), most).otherwise(F.regexp_replace(x, "ь$", ""))

        rest = F.substr(w, F.char_length(head) + 1)
        stem = _let(_let(F.regexp_replace(_let(rest, endings), "и$", ""), derived), tidied)
        return F.when(head == "", w).otherwise(F.concat(head, stem))

    return F.when(word.rlike(CYRILLIC), _let(F.translate(word, "ё", "е"), of)).otherwise(word)


def russian_stems(words: pa.Array) -> pa.Array:
    """`russian_stem` of a column of lower-case words inside a task, such as the distinct words of a batch."""
    cut = lambda x, pattern, to="": pc.replace_substring_regex(x, pattern, r"\1" if "([ая])" in pattern else to)
    found = lambda x, pattern: pc.match_substring_regex(x, pattern)
    cyrillic = pc.indices_nonzero(pc.fill_null(found(words, CYRILLIC), False))
    if not len(cyrillic):
        return words
    w = pc.replace_substring(words.take(cyrillic), "ё", "е")
    first = lambda pattern: pc.fill_null(pc.struct_field(pc.extract_regex(w, f"(?P<x>{pattern})"), "x"), "")
    head, second = first(TO_FIRST_VOWEL), pc.utf8_length(first(TO_SECOND_REGION))
    rest = cut(w, TO_FIRST_VOWEL)
    g, f = cut(rest, GERUND), cut(rest, REFLEXIVE)
    a, v = cut(f, ADJECTIVAL), cut(f, VERB)
    name = pc.if_else(pc.not_equal(v, f), v, cut(f, NOUN))
    x = cut(pc.if_else(pc.not_equal(g, rest), g, pc.if_else(pc.not_equal(a, f), a, name)), "и$")
    short = cut(x, "ость?$")
    here = pc.add(pc.utf8_length(head), pc.utf8_length(short))
    y = pc.if_else(pc.and_(found(x, "ость?$"), pc.and_(pc.greater(second, 0), pc.greater_equal(here, second))), short, x)
    tidied = pc.if_else(found(y, "ейше?$|нн$"), cut(cut(y, "ейше?$"), "нн$", "н"), cut(y, "ь$"))
    stems = pc.if_else(pc.equal(head, ""), w, pc.binary_join_element_wise(head, tidied, ""))
    return pc.replace_with_mask(words, pc.fill_null(found(words, CYRILLIC), False), stems)
