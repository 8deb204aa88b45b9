"""Russian number words: canonical forms with their values, and the forms that stand for them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_UNITS = ("ноль нуль нолик ноликов нолика нолем ноля нолю", "один одно одна раз единица единицу единицы единицей", "два две двойка двойку двойки", "три тройка тройку тройки", *(f"{w} {n}ка {n}ку {n}ки" for w, n in zip("четыре пять шесть семь восемь девять".split(), "четвер пятер шестер семер восьмер девят".split())))
DIGITS = {form: value for value, forms in enumerate(_UNITS) for form in forms.split()}
_TEEN_ROOTS = "один две три четыр пят шест сем восем девят".split()
TEENS = {"десять": 10} | {f"{root}надцать": 11 + i for i, root in enumerate(_TEEN_ROOTS)}
TENS = dict(zip("двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(), range(20, 100, 10)))
HUNDREDS = dict(zip("сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split(), range(100, 1000, 100)))
SCALES = {word: 1000**power for power, word in enumerate("тысяча миллион миллиард триллион".split(), 1)}
VALUES = DIGITS | TEENS | TENS | HUNDREDS | SCALES

_CASES = {
    "один": "одного одному одним одной одном одною одну", "два": "двух двум двумя", "три": "трех тремя трем", "четыре": "четырех четырем четырьмя", "пять": "пяти пятью", "шесть": "шести шестью",
    "семь": "семи семью", "восемь": "восьми восемью", "девять": "девяти девятью", "двадцать": "двадцати двадцатью", "тридцать": "тридцати тридцатью", "сорок": "сорока", "девяносто": "девяноста", "сто": "ста",
    "двести": "двухсот двумстам двумястами двухстах", "триста": "трехсот тремстам тремястами трехстах", "четыреста": "четырехсот четыремстам четырьмястами четырехстах",
}
#: How each of 5 to 9 begins in its cases: with -и and with -ью.
_SOFT = {"пять": ("пяти", "пятью"), "шесть": ("шести", "шестью"), "семь": ("семи", "семью"), "восемь": ("восьми", "восемью"), "девять": ("девяти", "девятью")}

_ASR = """ноль: нол нолик; один: адин оден; два: двой; три: трии; четыре: четыр; пять: пят; шесть: шес; семь: сем; восемь: восимь восем; девять: дивять девят; одиннадцать: одинадцать; двенадцать: двинадцать двенадцат;
тринадцать: тринадцат; пятнадцать: пятнадцат; шестнадцать: шеснадцать шестнадцат; семнадцать: семнадцат; восемнадцать: восемнадцат; девятнадцать: девятнадцат; двадцать: двадцат; тридцать: тридцат; сорок: сорокк;
пятьдесят: педесят пятьдесет; шестьдесят: шездесят шестьдесет; семьдесят: семдесят семисят; восемьдесят: восемдесят; девяносто: дивяносто; двести: двесте; триста: тристаа; пятьсот: пятсот пицот; шестьсот: шесот шиссот;
семьсот: семсот; восемьсот: восемсот; девятьсот: девятсот; тысяча: тысича тыща; миллион: милион милен"""

_STEMS_Y = {
    "один": "перв", "четыре": "четверт", "пять": "пят", "девять": "девят", "десять": "десят", "пятьдесят": "пятидесят", "шестьдесят": "шестидесят", "семьдесят": "семидесят", "восемьдесят": "восьмидесят", "девяносто": "девяност",
    "сто": "сот", "двести": "двухсот", "триста": "трехсот", "четыреста": "четырехсот", "пятьсот": "пятисот", "шестьсот": "шестисот", "семьсот": "семисот", "восемьсот": "восьмисот", "девятьсот": "девятисот",
    "тысяча": "тысячн", "миллион": "миллионн", "миллиард": "миллиардн", "триллион": "триллионн",
}
_STEMS_OY = {"ноль": "нулев", "два": "втор", "шесть": "шест", "семь": "седьм", "восемь": "восьм", "сорок": "сороков"}
_ENDINGS = "ая ое ые ого ой ую ому ым ом ыми ых".split()


@lru_cache(maxsize=1)
def asr_aliases() -> dict[str, str]:
    return {form: word.strip() for entry in _ASR.split(";") for word, _, forms in [entry.partition(":")] for form in forms.split()}


@lru_cache(maxsize=1)
def aliases() -> dict[str, str]:
    """form -> canonical word: cases first, then ordinals, then recogniser errors, the last of which wins."""
    out: dict[str, str] = {}
    for word, forms in _CASES.items():
        out |= dict.fromkeys(forms.split(), word)
    for word in TEENS:
        out |= dict.fromkeys((word[:-1] + "и", word + "ю"), word)
    for unit, (i_form, yu_form) in _SOFT.items():
        if unit != "девять":
            out |= dict.fromkeys((f"{i_form}десяти", f"{yu_form}десятью"), unit + "десят")
        out |= dict.fromkeys((f"{i_form}сот", f"{i_form}стам", f"{yu_form}стами", f"{i_form}стах"), unit + "сот")
    out |= dict.fromkeys([f"тысяч{e}" for e in ("и", "", "ей", "е", "у", "ам", "ами", "ах")], "тысяча")
    for word in ("миллион", "миллиард", "триллион"):
        out |= dict.fromkeys([word + e for e in "а ов у ом е ам ами ах".split() + ["ы"] * (word == "миллиард")], word)
    stems = _STEMS_Y | {w: w[:-1] for w in (*list(TEENS)[1:], "двадцать", "тридцать")}
    for word, stem in stems.items():
        out |= dict.fromkeys([stem + e for e in ("ый", *_ENDINGS)], word)
    for word, stem in _STEMS_OY.items():
        out |= dict.fromkeys([stem + e for e in _ENDINGS], word)
    out |= dict.fromkeys([f"трет{e}" for e in "ий ья ье ьи ьего ьей ью ьему ьим ьем ьими ьих".split()], "три")
    return out | asr_aliases()


MINUS = frozenset({"минус"})
FRACTIONS = frozenset("целая целых целое точка запятая пол половина половиной половину".split()) | {stem + e for stem in ("десят", "сот", "тысячн") for e in ("ая", "ых")}
FRACTION_LINKS = frozenset("си")
FILLERS = frozenset("код номер значение число".split())
MAGPIE = frozenset({"сорока"})
BEFORE_MAGPIE = FILLERS | frozenset("у со с при после по перед от около об о над на между к из для до вокруг возраст вижу в более без".split())


@lru_cache(maxsize=1)
def vocabulary() -> tuple[str, ...]:
    """What misheard words are compared with, in order."""
    return tuple(sorted(set(VALUES) | MINUS | FRACTIONS))


def lexicon(spark: SparkSession) -> DataFrame:
    """(form, canonical, class, value, is_asr): every known form once."""
    kinds = {w: k for k, words in (("digit", DIGITS), ("teen", TEENS), ("ten", TENS), ("hundred", HUNDREDS), ("scale", SCALES)) for w in words}
    known = {w: w for w in VALUES} | aliases()
    asr = asr_aliases()
    return spark.createDataFrame([(f, c, kinds[c], VALUES[c], f in asr) for f, c in sorted(known.items())], "form string, canonical string, class string, value long, is_asr boolean")
