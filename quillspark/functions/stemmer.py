"""The Snowball stemmer for Russian as column expressions: endings are cut by class within the regions that the vowels of a word mark.

RV is what follows the first vowel; R2 is what follows a consonant after a vowel, twice over. Endings of a class are tried longest first
by their pattern; those of the first group of a class count only behind а or я, which stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of the language by class; fixed values. The first pattern of a class needs а or я before it.
VOWELS = "аеиоуыэюя"
GERUND = ("вшись|вши|в", "ившись|ывшись|ивши|ывши|ив|ыв")
REFLEXIVE = "ся|сь"
ADJECTIVE = "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE = ("ем|нн|вш|ющ|щ", "ивш|ывш|ующ")
VERB = ("ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н", "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю")
NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"
SUPERLATIVE, DERIVATIONAL = "ейше|ейш", "ость|ост"


def _cut(rv: Column, plain: str, after: str | None = None) -> Column:
    """rv without the longest ending of a class."""
    p = rf"(?:{plain})$"
    if after is None:
        return F.regexp_replace(rv, p, "")
    grouped = F.regexp_replace(rv, rf"([ая])(?:{after})$", "$1")
    other = F.regexp_replace(rv, p, "")
    return F.when(F.length(other) <= F.length(grouped), other).otherwise(grouped)


def _bound(c: Column, then) -> Column:
    """then(c), with c worked out once."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def russian_stem(word: Column) -> Column:
    """The stem of a lower-cased word; a word without a Cyrillic vowel is its own stem."""
    w = F.replace(word, F.lit("ё"), F.lit("е"))
    head = F.regexp_extract(w, rf"^([^{VOWELS}]*[{VOWELS}])", 1)
    rv = F.substr(w, F.length(head) + 1)

    def first(x: Column) -> Column:
        gerund = _cut(x, GERUND[1], GERUND[0])

        def inflected(y: Column) -> Column:
            adjective = _cut(y, ADJECTIVE)
            adjectival = _bound(adjective, lambda a: F.when(a == y, a).otherwise(_cut(a, PARTICIPLE[1], PARTICIPLE[0])))
            verb, noun = _cut(y, VERB[1], VERB[0]), _cut(y, NOUN)
            return _bound(adjectival, lambda a: F.when(a != y, a).otherwise(_bound(verb, lambda v: F.when(v != y, v).otherwise(noun))))

        return _bound(gerund, lambda g: F.when(g != x, g).otherwise(_bound(_cut(x, REFLEXIVE), inflected)))

    two = _bound(first(rv), lambda x: F.regexp_replace(x, "и$", ""))

    def third(x: Column) -> Column:
        r1 = F.regexp_extract(F.concat(head, x), rf"^.*?[{VOWELS}][^{VOWELS}](.*)$", 1)
        r2 = F.regexp_extract(r1, rf"^.*?[{VOWELS}][^{VOWELS}](.*)$", 1)
        return F.when(r2.rlike(f"(?:{DERIVATIONAL})$"), _cut(x, DERIVATIONAL)).otherwise(x)

    def last(x: Column) -> Column:
        best = _cut(x, SUPERLATIVE)
        undoubled = lambda y: F.when(y.endswith("нн"), F.regexp_replace(y, "н$", ""))
        return F.coalesce(undoubled(x), F.when(best != x, F.coalesce(undoubled(best), best)), F.regexp_replace(x, "ь$", ""))

    return F.when(head == "", word).otherwise(F.concat(head, _bound(_bound(two, third), last)))
