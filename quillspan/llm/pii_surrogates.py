"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is drawn from a keyed hash of (type, canonical form, attempt), so equal entities get equal surrogates in
whatever document and format they stand. Collisions are checked over the whole corpus: of distinct entities that draw one
surrogate the least keeps it, an entity whose surrogate is itself an entity of the corpus draws again, and so on. What
still has none after ``MOST_DRAWS`` rounds, as in a space of values that the corpus nearly fills, gets the free values of its space in
keyed order: first those that are no entity, then any that no other has taken. So rounds end and surrogates stay distinct;
where entities fill more than half of a space some surrogates must be values that other entities have. Domains of e-mails are
entities too and are settled before the addresses. Only the few entities that drew again travel back to the documents; all
others are replaced where they are found, without a join.

Types: e-mail (domains map alike, the last label stays), phone (country code stays; a bare number of ten digits is the one with
+1), IPv4 (private ranges stay private), payment card (first digit and checksum validity stay), US social security number,
IBAN (country stays, check digits are right), secrets (letters, digits and hex digits stay such), given names (gender and
script stay) and family names (script stays; Cyrillic endings keep their gender). A name is known by a title, a label or a
given name before it, or, in Han script, by a label before or a title after it. It has any number of words,
initials and particles, and is then replaced wherever its document has it.

Edges: a null text stays null, an empty one empty, both with 0 entities; repeated rows are replaced alike; an empty table
gives an empty result; no id is needed and rows of null id are treated like others; further columns pass as
they are, whatever their names, but a column named ``n_entities`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from secrets import token_bytes

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, dropped, fresh, saved, table

#: Rounds of draws before free values are dealt out.
MOST_DRAWS = 12
#: Session setting with the key of the registered query; where it is unset, each run draws a key.
KEY_SETTING = "quillspan.surrogates.key"

_DIGITS = re.compile(
    r"[+(\d](?:"
    r"(?<=\d)(?<!\d\d)(?:"
    r"(?P<card>\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)|(?<=3)[47]\d\d[ -]?\d{6}[ -]?\d{5}(?!\d))"
    r"|(?P<ipv4>\d{0,2}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<ssn>\d\d-\d\d-\d{4}(?![\d-]))"
    r"|(?P<phone>\d\d[.-]\d{3}[.-]\d{4}(?!\d))"
    r")"
    r"|(?<=\+)(?P<intl>\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d))"
    r"|(?<=\()(?P<local>\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d))"
    r")"
)
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_PREFIXED = re.compile(r"(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[bap]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
_VALUE = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{8,})")
_SECRET_NAME = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth)[\"']?\s{0,3}\Z", re.I)

_TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Г-н": "m", "Г-жа": "f", "г-н": "m", "г-жа": "f", "Господин": "m", "Госпожа": "f", "господин": "m", "госпожа": "f",
}
_ABBREVIATED = {"Mr", "Mrs", "Ms", "Dr", "Prof", "Mme", "Mlle", "Sr", "Sra"}
_TITLE = re.compile("(?:" + "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True)) + r")(?!\w)")
_LABEL = re.compile(r"(?:Full name|full name|Contact|contact|Name|name|Имя|имя|ФИО|Nom|Nombre|Όνομα|Ονοματεπώνυμο|姓名|氏名|名前)\s{0,2}[:：]\s{0,2}")
#: A word of a name: a letter and more, or an initial with or without its stop. It must begin with a capital, which is asked later.
_NAME = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?\.?")
_PARTICLES = frozenset("von van der den de del della di da dos das do du le la y e i ter ten zu zum zur af av al el bin ibn ben".split())
_HAN = re.compile(r"[\u4e00-\u9fff]{2,4}")
_HAN_FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN_TITLED = re.compile(rf"[{_HAN_FAMILIES}][\u4e00-\u9fff]{{0,2}}?(?=先生|女士|小姐|教授|博士|老师)")
_HAN_FEMALE = ("女士", "小姐")
#: Given names that tell a name without a title before it.
_GIVEN = dict.fromkeys("John James Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Hans Klaus Jürgen Wolfgang Stefan Pierre Jacques Michel François José Carlos Juan Luis Miguel Pedro Иван Александр Сергей Дмитрий Алексей Николай Михаил Андрей".split(), "m") | dict.fromkeys("Mary Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily Emma Anna Maria Julia Laura Ursula Sabine Monika Petra Marie Isabelle Nathalie Carmen Lucía Sofía Elena Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(), "f")
_GIVEN_THEN = re.compile("(?:" + "|".join(sorted(_GIVEN, key=len, reverse=True)) + r")(?= [A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-])")
_ENDINGS = re.compile(r"(ский|ская|цкий|цкая|ова|ева|ёва|ина|ына|ов|ев|ёв|ин|ын)\Z")
_MASCULINE = {"ская": "ский", "цкая": "цкий", "ова": "ов", "ева": "ев", "ёва": "ёв", "ина": "ин", "ына": "ын"}
_FEMININE = {v: k for k, v in _MASCULINE.items()}


def _script(word: str) -> str:
    """latin, cyrillic, greek or han."""
    c = word[0].lower()
    if "\u0400" <= c <= "\u052f":
        return "cyrillic"
    if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
        return "greek"
    return "han" if "\u4e00" <= c <= "\u9fff" else "latin"


def _cyrillic(word: str) -> bool:
    return _script(word) == "cyrillic"


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_number(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))


def _family(word: str) -> tuple[str, bool]:
    """(masculine form in lower case, whether the word is feminine)."""
    low = word.lower()
    if _cyrillic(word) and (m := _ENDINGS.search(low)) and m[1] in _MASCULINE:
        return low[: m.start()] + _MASCULINE[m[1]], True
    return low, False


def _name_parts(words: list[tuple[int, int, str]], gender: str, titled: bool) -> list[tuple[int, int, str, str]]:
    """Given names first, the last word and all after a particle are family names; a single word after a title is a family name. Particles stay."""
    out, family = [], False
    for k, (a, b, w) in enumerate(words):
        if w in _PARTICLES:
            family = True
        elif family or (k == len(words) - 1 and (titled or k)):
            out.append((a, b, "family", _family(w)[0]))
        else:
            sex = _GIVEN.get(w) or gender or ("f" if w.rstrip(".")[-1] in "aeаяiиηα" else "m")
            out.append((a, b, "given", f"{w.lower()}|{sex}"))
    return out


def _words_of_name(text: str, at: int) -> list[tuple[int, int, str]]:
    """Words of one script that begin with a capital, initials among them, and particles between them, as far as they go."""
    words: list[tuple[int, int, str]] = []
    while m := _NAME.match(text, at):
        word, end = m[0], m.end()
        if word[-1] == "." and len(word) > 2:  # only an initial has a stop of its own
            word, end = word[:-1], end - 1
        if word in _PARTICLES:
            if text[end : end + 1] != " ":
                break
        elif not word[0].isupper() or word in _TITLES or (words and _script(word) != _script(words[0][2])):
            break
        words.append((m.start(), end, word))
        if text[end : end + 1] != " ":
            break
        at = end + 1
    while words and words[-1][2] in _PARTICLES:
        words.pop()
    while words and words[0][2] in _PARTICLES and not any(w[0].isupper() for _, _, w in words):
        words.pop(0)
    return words


def _han_name(a: int, name: str, gender: str) -> list[tuple[int, int, str, str]]:
    """The first sign is the family name, the rest the given name."""
    out = [(a, a + 1, "family", name[0])]
    return out + [(a + 1, a + len(name), "given", f"{name[1:]}|{gender or 'm'}")] if len(name) > 1 else out


def _names(text: str) -> list[tuple[int, int, str, str]]:
    seeds: list[tuple[int, str, bool]] = []
    for m in _TITLE.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        to = m.end() + (text[m.end() : m.end() + 1] == "." and m[0] in _ABBREVIATED)
        if text[to : to + 1] == " ":
            seeds.append((to + 1, _TITLES[m[0]], True))
    for m in _LABEL.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()) or m[0][0] > "\u4e00":
            seeds.append((m.end(), "", False))
    for m in _GIVEN_THEN.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()):
            seeds.append((m.start(), _GIVEN[m[0]], False))
    found: dict[str, tuple[str, str]] = {}
    out: list[tuple[int, int, str, str]] = []
    han = [(m.start(), m[0], "f" if text.startswith(_HAN_FEMALE, m.end()) else "m") for m in _HAN_TITLED.finditer(text)] if "\u4e00" <= max(text) else []
    known = 0  # seeds within a name that is already read begin no other one
    for at, gender, titled in sorted(seeds):
        if han_name := _HAN.match(text, at):
            han.append((at, han_name[0], gender))
            continue
        if at < known:
            continue
        words = _words_of_name(text, at)
        if not words or (len(words) == 1 and not titled):
            continue
        known = words[-1][1]
        for part in _name_parts(words, gender, titled):
            out.append(part)
            if part[1] - part[0] > 1 and text[part[1] - 1] != ".":
                found.setdefault(text[part[0] : part[1]], part[2:])
    for at, name, gender in han:
        out += _han_name(at, name, gender)
        m, start = len(name), text.find(name)
        while m > 1 and start >= 0:  # the whole name elsewhere; there are no gaps around words to tell its parts by
            out += _han_name(start, name, gender)
            start = text.find(name, start + m)
    if found:  # the same words elsewhere in the document
        again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, found), key=len, reverse=True)) + r")(?!\w)")
        out += [(m.start(), m.end(), *found[m[0]]) for m in again.finditer(text)]
    return out


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _HEX.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum() and not m[0].isdigit() and any(c.isdigit() for c in m[0]):
            yield m.span()
    for m in _PREFIXED.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()):
            yield m.span()
    for m in _VALUE.finditer(text):
        if any(c.isdigit() for c in m[1]) and _SECRET_NAME.search(text, max(0, m.start() - 24), m.start()):
            yield m.start(1), m.end(1) - (m[1].endswith(".") and not m[1][:-1].endswith("."))


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form), in order and without overlap; of two that overlap the earlier type below stays."""
    out: list[tuple[int, int, str, str]] = []
    at, before = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > before and ((c := text[begin - 1]).isalnum() or c in "_.+%-"):
            begin -= 1
        if begin < at and (right := _DOMAIN.match(text, at + 1)):
            begin = at - len(text[begin:at].lstrip(".-%"))
            end = right.start() + len(right[0].rstrip("-_"))
            if begin < at and "." in text[at + 1 : end]:
                out.append((begin, end, "email", text[begin:end].lower()))
        at, before = text.find("@", at + 1), at + 1
    out += [(a, b, "secret", text[a:b]) for a, b in _secrets(text)]
    for m in _IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if not (m.start() and text[m.start() - 1].isalnum()) and 15 <= len(bare) <= 34 and _iban_number(bare) % 97 == 1:
            out.append((*m.span(), "iban", bare))
    for m in _DIGITS.finditer(text):
        kind, a, b = m.lastgroup, m.start(), m.end()
        before = text[a - 1] if a else " "
        if before.isalnum() or before == "_" or text[b : b + 1].isalpha():
            continue
        digits = re.sub(r"\D", "", m[0])
        if kind == "ipv4":
            parts = m[0].split(".")
            if before != "." and all(int(p) < 256 for p in parts):
                out.append((a, b, kind, ".".join(str(int(p)) for p in parts)))
        elif kind == "card":
            out.append((a, b, kind, digits))
        elif kind == "ssn":
            if before != "-":
                out.append((a, b, kind, digits))
        elif kind == "intl":
            if 8 <= len(digits) <= 15:
                out.append((a, b, "phone", "+" + digits))
        else:
            out.append((a, b, "phone", "+1" + digits))
    out += _names(text)
    taken: list[tuple[int, int, str, str]] = []
    if len(out) > 1:
        order = sorted(range(len(out)), key=lambda i: (out[i][0], i))
        for i in order:  # overlaps are few: the earlier type wins, else the first
            while taken and taken[-1][1] > out[i][0]:
                if _RANK[out[i][2]] < _RANK[taken[-1][2]]:
                    taken.pop()
                else:
                    break
            else:
                taken.append(out[i])
        return taken
    return out


_RANK = {k: i for i, k in enumerate(("email", "secret", "iban", "card", "ipv4", "ssn", "phone", "given", "family"))}


class _Stream:
    """Keyed pseudo-random numbers."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.n, self.pool = key if len(key) <= 64 else blake2b(key).digest(), "\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 32:
            self.pool = int.from_bytes(blake2b(self.what + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest(), "big")
            self.n, self.left = self.n + 1, 512
        x = self.pool & 0xFFFFFFFF
        self.pool >>= 32
        self.left -= 32
        return x % n


def _like(text: str, s: _Stream) -> str:
    """Digits become digits, letters letters of their case, other signs stay."""
    out = []
    for c in text:
        if c.isdigit():
            out.append("0123456789"[s.below(10)])
        elif c.isalpha():
            low = _abc_of(c)[s.below(len(_abc_of(c)))]
            out.append(low.upper() if c.isupper() else low)
        else:
            out.append(c)
    return "".join(out)


_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": _HAN_FAMILIES}


def _abc_of(c: str) -> str:
    return _ALPHABETS[_script(c)]


def _digits(n: int, s: _Stream, first_not_zero: bool = True) -> str:
    return "".join("0123456789"[s.below(10) if i or not first_not_zero else 1 + s.below(9)] for i in range(n))


_SYLLABLES = {
    "latin": ("b br d dr f g gr h k kl l m n p r s st t tr v w".split(), "a e i o u ei au".split(), "l n r s t m nd rt".split()),
    "cyrillic": ("б бр в г гр д др ж з к кл л м н п пр р с ст т тр ф х".split(), "а е и о у я".split(), "л н р с т м к д".split()),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο ου η".split(), "ς ν".split()),
}
_HAN_GIVEN = {"m": "伟强磊军勇杰涛明超刚平辉鹏飞鑫波斌宇浩凯健俊帆帅旭宁龙林欢阳建华亮成志峰", "f": "芳娜敏静丽艳娟霞秀燕玲桂英慧巧美雪琳晶妍茜秋珊莎锦黛青倩婷姣婉娴瑾颖露瑶怡婵雁蓓"}


def _word(script: str, syllables: int, s: _Stream, end: str) -> str:
    onset, vowel, coda = _SYLLABLES[script]
    pick = lambda xs: xs[s.below(len(xs))]
    return "".join(pick(onset) + pick(vowel) for _ in range(syllables - 1)) + pick(onset) + pick(vowel) + pick(coda) + end


def _domain(canon: str, attempt: int, key: bytes) -> str:
    *labels, last = canon.split(".")
    s = _Stream(key, "domain", canon, attempt)
    return f"{_like('.'.join(labels), s)}{_like('a' * max(0, attempt - 2), s)}.{last}"


def surrogate(kind: str, canon: str, attempt: int, key: bytes, domain: str | None = None) -> str:
    """The canonical form of the attempt-th surrogate; ``domain`` is an e-mail's, where it isn't the one drawn first."""
    s = _Stream(key, kind, canon, attempt)
    if kind == "domain":
        return _domain(canon, attempt, key)
    if kind == "email":
        local, _, own = canon.rpartition("@")
        return f"{_like(local, s)}{_like('a' * max(0, attempt - 2), s)}@{domain or _domain(own, 0, key)}"
    if kind == "phone":
        plus = canon.startswith("+")
        number = canon.lstrip("+")
        keep = (1 if number[0] in "17" else 2) if plus else 0
        rest = number[keep:]
        return "+" * plus + number[:keep] + _digits(len(rest), s, rest[:1] != "0")
    if kind == "ipv4":
        a, b, *_ = octets = canon.split(".")
        keep = 1 if a in ("10", "127") else 2 if (a, b) == ("192", "168") or (a == "172" and 16 <= int(b) < 32) else 0
        if keep:
            return ".".join(octets[:keep] + [str(s.below(256)) for _ in range(4 - keep)])
        return ".".join(map(str, [_PUBLIC[s.below(len(_PUBLIC))], s.below(256), s.below(256), 1 + s.below(254)]))
    if kind == "card":
        out = canon[0] + _digits(len(canon) - 1, s, False)
        if luhn_valid(canon):
            out = next(out[:-1] + c for c in "0123456789" if luhn_valid(out[:-1] + c))
        return out
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "iban":
        rest = canon[:2] + "00" + _like(canon[4:], s)
        return rest[:2] + f"{98 - _iban_number(rest) % 97:02d}" + rest[4:]
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
            out = "".join("0123456789abcdef"[s.below(16)] for _ in canon)
            return out.upper() if canon.isupper() else out
        keep = next((p for p in ("AKIA", "ghp_", "sk-", "xoxb-", "xoxa-", "xoxp-") if canon.startswith(p)), "")
        return keep + _like(canon[len(keep) :], s) + _like("a" * max(0, attempt - 2), s)
    script, longer = _script(canon), 2 + attempt // 3
    if kind == "given":
        name, _, sex = canon.rpartition("|")
        if script == "han":
            signs = _HAN_GIVEN[sex]
            return "".join(signs[s.below(len(signs))] for _ in range(max(len(name), 1) + attempt // 3)) + f"|{sex}"
        if name.endswith(".") or len(name) == 1:
            initial = _like(name, s) if attempt < 3 else _word(script, 1 + attempt // 3, s, "")
            return f"{initial}|{sex}"
        return f"{_word(script, longer, s, {'latin': 'a', 'cyrillic': 'а', 'greek': 'α'}[script] if sex == 'f' else '')}|{sex}"
    if script == "han":
        return "".join(_HAN_FAMILIES[s.below(len(_HAN_FAMILIES))] for _ in range(1 + attempt // 3))
    m = _ENDINGS.search(canon) if script == "cyrillic" else None
    return _word(script, longer, s, m[1] if m else "")


_PUBLIC = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]


def space_of(kind: str, canon: str) -> str:
    """The values that can stand for the entity, as a pattern: # is a digit, ? a letter, * an octet; empty where draws grow longer and always end."""
    if kind == "phone":
        number = canon.lstrip("+")
        keep = 1 if number[0] in "17" else 2
        return "+" + number[:keep] + "#" * (len(number) - keep)
    if kind == "ipv4":
        a, b, *_ = octets = canon.split(".")
        keep = 1 if a in ("10", "127") else 2 if (a, b) == ("192", "168") or (a == "172" and 16 <= int(b) < 32) else 0
        return ".".join(octets[:keep] + ["*"] * (4 - keep))
    if kind == "card":
        return canon[0] + "#" * (len(canon) - 1)
    if kind == "ssn":
        return "#" * len(canon)
    return ""


def space_size(space: str) -> int:
    return 10 ** space.count("#") * 256 ** space.count("*")


def value_at(space: str, i: int) -> str:
    """The i-th value of a space."""
    out = []
    for c in reversed(space):
        if c == "#":
            i, x = divmod(i, 10)
            out.append(str(x))
        elif c == "*":
            i, x = divmod(i, 256)
            out.append(str(x)[::-1])
        else:
            out.append(c)
    return "".join(out)[::-1]


def written(kind: str, canon: str, original: str) -> str:
    """A canonical surrogate in the format of the original."""
    if kind in ("email", "secret"):
        if original.isupper():
            return canon.upper()
        return "".join(c.upper() if i < len(original) and original[i].isupper() else c for i, c in enumerate(canon)) if kind == "email" else canon
    if kind in ("phone", "card", "ssn", "iban"):
        signs = canon.lstrip("+")
        signs = iter(signs[max(0, len(signs) - sum(map(str.isalnum, original))) :])  # a number written without its country code stays so
        return "".join(next(signs, "") if c.isalnum() else c for c in original)
    if kind == "ipv4":
        return canon
    word = canon.rpartition("|")[0] if kind == "given" else canon
    if kind == "family" and _family(original)[1] and (m := _ENDINGS.search(word)):
        word = word[: m.start()] + _FEMININE.get(m[1], m[1])
    return word.upper() if original.isupper() and len(original) > 1 else word[0].upper() + word[1:]


def replaced(text: str | None, drawn: dict[str, str] | None, key: bytes, chosen) -> tuple[str | None, int]:
    """The text with surrogates, and how many; ``drawn`` has the surrogates of entities that didn't keep their first draw."""
    if not text:
        return text, 0
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canon in found:
        out.append(text[at:a])
        out.append(written(kind, (drawn or {}).get(f"{kind}:{canon}") or chosen(kind, canon, 0, key), text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out), len(found)


def mentions(docs: DataFrame, text_col: str) -> DataFrame:
    """(h1, h2, entity): distinct entities of distinct texts, the text named by 128 bits of hash."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted({f"{k}:{c}" for _, _, k, c in entities(t)}) if t else [] for t in texts])

    h1, h2 = _names_of(text_col)
    return docs.select(h1.alias("h1"), h2.alias("h2"), F.explode(found(col(text_col))).alias("entity")).distinct()


def _names_of(text_col: str):
    return F.xxhash64(col(text_col)), F.xxhash64(F.lit(29), col(text_col))


def assigned(names: DataFrame, key: bytes) -> DataFrame:
    """(entity, first, surrogate) for distinct entities "type:canonical form": the surrogate, and whether it is the one drawn first.

    No two surrogates are alike, and none is an entity of the corpus unless its space is more than half full of them.
    """
    real = saved(names.select("entity").distinct(), "entities")
    domains = _settled(real.where("startswith(entity, 'email:')").select(F.concat(F.lit("domain:"), F.substring_index("entity", "@", -1)).alias("entity"), F.lit(None).cast("string").alias("domain")).distinct(), key)
    moved = saved(domains.where("NOT first").select(F.expr("substring(entity, 8)").alias("own"), F.expr("substring(surrogate, 8)").alias("domain")), "domains")
    own = F.when(F.col("entity").startswith("email:"), F.substring_index("entity", "@", -1))
    return _settled(real.withColumn("own", own).join(moved, "own", "left").select("entity", "domain"), key).select("entity", (F.col("first") & F.col("domain").isNull()).alias("first"), "surrogate")


def _settled(real: DataFrame, key: bytes) -> DataFrame:
    """(entity, domain, first, surrogate), saved, from distinct (entity, domain)."""

    @F.udf("string", useArrow=True)
    def drawn(entity: str, attempt: int, domain: str | None) -> str:
        kind, _, canon = entity.partition(":")
        return f"{kind}:{surrogate(kind, canon, attempt, key, domain)}"

    real = saved(real, "real")
    todo, taken = real, None
    for attempt in range(1_000_000):
        tried = saved(todo.withColumn("surrogate", drawn("entity", F.lit(attempt), "domain")), "drawn")
        fit = tried.join(real.select(F.col("entity").alias("surrogate")), "surrogate", "left_anti")
        if taken is not None:
            fit = fit.join(taken.select("surrogate"), "surrogate", "left_anti")
        won = saved(fit.groupBy("surrogate").agg(F.min(F.struct("entity", "domain")).alias("w")).select("w.entity", "w.domain", F.lit(attempt == 0).alias("first"), "surrogate"), "won")
        taken = won if taken is None else taken.unionAll(won)
        todo = saved(tried.join(won.select("entity"), "entity", "left_anti").select("entity", "domain"), "todo")
        dropped(tried)
        if todo.isEmpty():
            break
        if attempt + 1 == MOST_DRAWS:
            dealt = _dealt(todo, real, taken, key)
            taken = taken.unionAll(dealt)
            todo = saved(todo.join(dealt.select("entity"), "entity", "left_anti"), "todo")
            if todo.isEmpty():
                break
    return taken


def _dealt(todo: DataFrame, real: DataFrame, taken: DataFrame, key: bytes) -> DataFrame:
    """Free values of crowded spaces for the entities of ``todo`` that belong to one, saved.

    A space comes here only when entities fill a good part of it, so listing its values is work in proportion to the corpus.
    Values are ranked within partitions of the space and those counts added up, so no task orders a whole space.
    """

    @F.udf("string", useArrow=True)
    def space(entity: str) -> str | None:
        kind, _, canon = entity.partition(":")
        found = space_of(kind, canon)
        return f"{kind}:{found}" if found else None

    @F.udf("string", useArrow=True)
    def value(space: str, i: int) -> str:
        kind, _, pattern = space.partition(":")
        return f"{kind}:{value_at(pattern, i)}"

    @F.udf("long", useArrow=True)
    def size(space: str) -> int:
        return space_size(space.partition(":")[2])

    waiting = saved(todo.withColumn("space", space("entity")).where("space IS NOT NULL"), "waiting")
    spaces = waiting.select("space").distinct().withColumn("size", size("space"))
    parts = spaces.select("space", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / 65536))).alias("p")).repartition("space", "p")
    listed = parts.select("space", F.explode(F.sequence(F.col("p") * 65536, F.least(F.col("size"), (F.col("p") + 1) * 65536) - 1)).alias("i")).select("space", value("space", "i").alias("surrogate"))
    free = listed.join(taken.select("surrogate"), "surrogate", "left_anti").join(real.select(F.col("entity").alias("surrogate"), F.lit(1).alias("is_real")), "surrogate", "left").select("space", "surrogate", F.coalesce("is_real", F.lit(0)).alias("is_real"))
    salt = int.from_bytes(blake2b(b"deal", key=key if len(key) <= 64 else blake2b(key).digest(), digest_size=7).digest(), "big")
    free, asking = _ranked(free, "surrogate", ["is_real"], salt), _ranked(waiting, "entity", [], salt)
    return saved(asking.join(free.select("space", "rank", "surrogate"), ["space", "rank"]).select("entity", "domain", F.lit(False).alias("first"), "surrogate"), "dealt")


def _ranked(rows: DataFrame, by: str, first: list[str], salt: int) -> DataFrame:
    """rows with a ``rank`` from 0 on by space: by the columns ``first``, then keyed hash. Ranks are taken within 256 ranges of the hash."""
    rows = rows.withColumn("h", F.xxhash64(by, F.lit(salt))).withColumn("bin", F.shiftrightunsigned("h", 56))
    keys = ["space", *first, "bin"]
    rows = saved(rows.withColumn("within", F.row_number().over(Window.partitionBy(keys).orderBy("h", by)) - 1), "ranks")
    counts = rows.groupBy(keys).count()
    before = counts.select(*keys, (F.sum("count").over(Window.partitionBy("space").orderBy(*first, "bin")) - F.col("count")).alias("before"))  # at most 512 rows a space
    return rows.join(before, keys).withColumn("rank", F.col("within") + F.col("before")).drop("h", "bin", "within", "before")


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with ``text_col`` replaced and the number of replacements in ``n_entities``. Who has the key can tell which surrogate belongs to a known entity.

    The corpus' texts are read twice and don't move, unless the entities that drew again are too many to broadcast.
    """
    if not key:
        raise ValueError("a key is needed")
    found = saved(mentions(docs, text_col), "mentions")
    again = saved(assigned(found, key).where("NOT first").select("entity", F.expr("substring(surrogate, instr(surrogate, ':') + 1)").alias("surrogate")), "again")
    drawn, done, t1, t2 = fresh(docs, "drawn", "done", "t1", "t2")
    rows = docs
    if again.isEmpty():
        rows = rows.withColumn(drawn, F.lit(None).cast("map<string,string>"))
    else:
        by_text = saved(found.join(again, "entity").groupBy(F.col("h1").alias(t1), F.col("h2").alias(t2)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(drawn)), "by_text")
        h1, h2 = _names_of(text_col)
        rows = rows.join(by_text, (h1 == F.col(t1)) & (h2 == F.col(t2)), "left").drop(t1, t2)

    @F.pandas_udf("text string, n int")
    def replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        chosen = lru_cache(maxsize=200_000)(surrogate)
        for texts, others in batches:
            yield pd.DataFrame([replaced(t, dict(d) if d is not None else None, key, chosen) for t, d in zip(texts, others)], columns=["text", "n"])

    out = rows.withColumn(done, replace(col(text_col), F.col(drawn)))
    return out.withColumns({text_col: F.col(done)["text"], "n_entities": F.col(done)["n"]}).drop(done, drawn)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key of ``KEY_SETTING``, or a new one."""
    key = spark.conf.get(KEY_SETTING, None)
    return with_surrogates(table(spark, sf_dir, "documents"), key.encode() if key else token_bytes(32))
