"""Numbers written in words, English and Russian: read by a small grammar folded over tokens, and written out again.

A word adds to the group that is open (units, tens, hundreds), ``hundred`` multiplies it, and a magnitude closes it. All of it is column
expressions over an array of lower-cased words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the languages; fixed values.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
RU_FORMS = {
    0: "ноль нуля", 1: "один одного одной одну одна одно", 2: "два двух две двум", 3: "три трех трёх трем трём", 4: "четыре четырех четырёх четырем четырём", 5: "пять пяти", 6: "шесть шести", 7: "семь семи",
    8: "восемь восьми", 9: "девять девяти", 10: "десять десяти", 11: "одиннадцать одиннадцати", 12: "двенадцать двенадцати", 13: "тринадцать тринадцати", 14: "четырнадцать четырнадцати",
    15: "пятнадцать пятнадцати", 16: "шестнадцать шестнадцати", 17: "семнадцать семнадцати", 18: "восемнадцать восемнадцати", 19: "девятнадцать девятнадцати", 20: "двадцать двадцати",
    30: "тридцать тридцати", 40: "сорок сорока", 50: "пятьдесят пятидесяти", 60: "шестьдесят шестидесяти", 70: "семьдесят семидесяти", 80: "восемьдесят восьмидесяти", 90: "девяносто девяноста",
    100: "сто ста", 200: "двести двухсот", 300: "триста трехсот трёхсот", 400: "четыреста четырехсот четырёхсот", 500: "пятьсот пятисот", 600: "шестьсот шестисот", 700: "семьсот семисот", 800: "восемьсот восьмисот", 900: "девятьсот девятисот",
}
VALUES = {"en": dict(zip(ONES, range(20), strict=True)) | dict(zip(TENS, range(20, 100, 10), strict=True)), "ru": {w: n for n, ws in RU_FORMS.items() for w in ws.split()}}
HUNDRED = {"en": ["hundred"], "ru": []}
MAGNITUDES = {
    "en": {"thousand": 1e3, "million": 1e6, "billion": 1e9},
    "ru": {w: m for m, ws in {1e3: "тысяча тысячи тысяч тысячу тыс", 1e6: "миллион миллиона миллионов млн", 1e9: "миллиард миллиарда миллиардов млрд"}.items() for w in ws.split()},
}
#: Words that go between the parts of a number, and words that make it a share.
BETWEEN, PERCENT = {"en": ["and"], "ru": []}, {"en": "percent|%", "ru": "процент|%"}


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def number_of(words: Column, pack: str = "en") -> Column:
    """The number that an array of words says, as double; null if a word is not part of a number, or there is none."""
    value, magnitude, digits = _map(VALUES[pack]), _map(MAGNITUDES[pack]), r"^[0-9]+(\.[0-9]+)?$"

    def read(w: Column) -> Column:  # a word is looked up once
        v = F.coalesce(F.try_element_at(value, w), F.when(w.rlike(digits), w.try_cast("double")))
        return F.struct(v.alias("v"), F.try_element_at(magnitude, w).alias("m"), (w.isin(HUNDRED[pack]) if HUNDRED[pack] else F.lit(False)).alias("hundred"))

    def step(s: Column, x: Column) -> Column:
        v, m, hundred = x["v"], x["m"], x["hundred"]
        group = F.when(hundred, F.greatest(s["open"], F.lit(1.0)) * 100).when(v.isNotNull(), s["open"] + v).when(m.isNotNull(), F.lit(0.0)).otherwise(s["open"])
        closed = F.when(m.isNotNull(), s["closed"] + F.when(s["seen"], s["open"]).otherwise(F.lit(1.0)) * m).otherwise(s["closed"])
        return F.struct(group.alias("open"), closed.alias("closed"), (hundred | v.isNotNull()).alias("seen"), (s["good"] & (hundred | v.isNotNull() | m.isNotNull())).alias("good"), F.lit(True).alias("any"))

    start = F.struct(F.lit(0.0).alias("open"), F.lit(0.0).alias("closed"), F.lit(False).alias("seen"), F.lit(True).alias("good"), F.lit(False).alias("any"))
    own = F.transform(F.filter(words, lambda w: ~w.isin(BETWEEN[pack])), read)
    return F.aggregate(own, start, step, lambda s: F.when(s["good"] & s["any"], s["open"] + s["closed"]))


def amount(text: Column, pack: str = "en") -> Column:
    """(value, share) of the first number in a text, in digits or words, with its magnitude; share: whether a percent word follows."""
    low = F.regexp_replace(F.lower(text), r"(?<=[0-9])[  ](?=[0-9]{3}(?![0-9]))", "")
    low = F.regexp_replace(low, r"(?<=[0-9]),(?=[0-9])", ".")
    known = "|".join(sorted([*VALUES[pack], *HUNDRED[pack], *BETWEEN[pack], *MAGNITUDES[pack]], key=len, reverse=True))
    word = rf"(?:[0-9]+(?:\.[0-9]+)?|(?<!\p{{L}})(?:{known})(?!\p{{L}}))"
    whole = F.regexp_extract(low, rf"{word}(?:[\s.-]*{word})*\s*(?:{PERCENT[pack]})?", 0)  # searched for once; no word of a number ends like a share

    def read(found: Column) -> Column:
        run = F.regexp_replace(found, rf"\s*(?:{PERCENT[pack]})$", "")
        words = F.regexp_extract_all(run, F.lit(r"([0-9]+(?:\.[0-9]+)?|\p{L}+)"), 1)
        return F.struct(number_of(words, pack).alias("value"), found.rlike(rf"(?:{PERCENT[pack]})$").alias("share"))

    return F.get(F.transform(F.array(whole), read), F.lit(0))


def spelled(n: Column) -> Column:
    """A number from 0 to 10**12 - 1 in English words, as an array."""
    one = lambda k: F.element_at(F.array(*map(F.lit, ONES)), (k + 1).cast("int"))
    ten = lambda k: F.element_at(F.array(*map(F.lit, TENS)), (k - 1).cast("int"))
    none = F.array().cast("array<string>")

    def group(g: Column, name: str | None) -> Column:
        h, r = F.floor(g / 100), g % 100
        hundreds = F.when(h > 0, F.array(one(h), F.lit("hundred"))).otherwise(none)
        low = F.when(r == 0, none).when(r < 20, F.array(one(r))).when(r % 10 == 0, F.array(ten(F.floor(r / 10)))).otherwise(F.array(ten(F.greatest(F.floor(r / 10), F.lit(2))), one(r % 10)))
        words = F.concat(hundreds, low)
        return F.when(g > 0, F.concat(words, F.array(F.lit(name))) if name else words).otherwise(none)

    parts = [group(F.floor(n / 10**e) % 1000, name) for e, name in ((9, "billion"), (6, "million"), (3, "thousand"), (0, None))]
    return F.when(n == 0, F.array(F.lit("zero"))).otherwise(F.concat(*parts))
