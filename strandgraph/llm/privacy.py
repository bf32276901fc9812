"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detected entities are e-mail addresses (of any script), IP addresses (of either version, shortened
or not), phone numbers, payment-card numbers, bank account numbers (IBAN), social security numbers,
secrets and key fingerprints, bearer and web tokens, private keys in PEM form, and names of people
after titles or a known given name (KNOWN_GIVEN, a parameter of the corpus's languages), also in
capitals, or before a Chinese title. Not looked for: names without either, street addresses, dates of
birth, user names, licence plates. Each gets a surrogate of its own type from a keyed hash of its normal form: digits
become digits in the same layout (cards keep a valid check digit if they had one), hexadecimal stays
hexadecimal in the same case, a key keeps its public prefix.

A given name and a surname are entities of their own, so "Mrs. Berg", "Dr. Berg" and "Anna Berg" keep
one surname. Both keep their script. A given name keeps its gender: that of its spelling, or of its
titles in the corpus where these all say otherwise; in Cyrillic and Greek a surname keeps the gender
of its ending. A secret is the same entity with or without a word such as "token =" before it. The
same entity has the same surrogate in every document.

Surrogates must not collide: with each other, nor with an entity that occurs in the corpus. The
first attempt is computed in place from key and entity. Distinct entities are then collected as a
table (never on the driver), those whose surrogate is taken try again under the next attempt
number, until none collides; where a form is nearly used up, later attempts widen it (a phone or
social security number gets a digit more every 16 attempts, a name a syllable every 8, an IPv4 address
becomes an IPv6 one after 24). Only entities that needed another attempt, or whose titles change their
gender, form a table of overrides, which is broadcast while it is small (rows and bytes) and joined
by document beyond that.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import column, cut, fresh, table

#: The key of surrogates: whoever has it can compute them, so it is a secret of the release.
KEY_CONF = "spark.strandgraph.surrogates.key"
#: Overrides of at most this many entities and bytes of them are broadcast.
BROADCAST_OVERRIDES, BROADCAST_BYTES = 50_000, 4_000_000

#: Given names and name parts by (script, gender): surrogates are drawn from these (fixed values).
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Ingrid Irene Julia Laura Lucia Maria Marta Nora Paula Sofia Teresa Vera".split(),
    ("latin", "m"): "Adrian Bruno Carl David Emil Felix Hugo Jonas Leon Lukas Marco Martin Oscar Pablo Simon Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Нина Ольга София Татьяна".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Денис Иван Игорь Максим Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξης Γιάννης Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
}
SURNAME_HEADS = {
    "latin": "Al Bar Bel Cor Dal Fal Gar Hol Kel Lan Mar Nor Per Ros Sal Tor Val Wel".split(),
    "cyrillic": "Бел Вол Гор Дуб Зим Кол Лес Мор Нов Пол Роз Сол".split(),
    "greek": "Αλεξ Βασ Γεωρ Δημ Καλ Λαμπ Μαν Νικ Παπ Σταμ".split(),
}
SURNAME_MIDDLES = {"latin": "a e i o ber den fel gan len man mer ner ri so ta ven".split(), "cyrillic": "а е и о ан ар ев ен ин ов ор ук".split(), "greek": "α ε ι ο αν ερ ιν ολ οπ ιδ".split()}
SURNAME_TAILS = {
    ("latin", "f"): "berg dale feld ford gren holm land lund mann nert rick sen ski son stad well".split(),
    ("latin", "m"): "berg dale feld ford gren holm land lund mann nert rick sen ski son stad well".split(),
    ("cyrillic", "f"): "ова ева ина ская".split(),
    ("cyrillic", "m"): "ов ев ин ский".split(),
    ("greek", "f"): "ίδου άκη ούλη".split(),
    ("greek", "m"): "ίδης άκης ούλης".split(),
}
#: Letters from which names in scripts without capitals are drawn (fixed values).
LETTERS = {
    "han": "明华国建文志伟海平春秋云山林玉兰英梅雪静丽安康宁德永新光东南北成宏",
    "arabic": "بتجحدرزسشطعفقكلمنهوي",
    "hebrew": "אבגדהוזחטילמנסעפצקרשת",
    "devanagari": "कगचजतदनपबमयरलवशसह",
}
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
#: Endings that tell a feminine name by its spelling (fixed values).
FEMININE = {"latin": ("a", "ie", "elle", "ette"), "cyrillic": ("а", "я"), "greek": ("α", "η", "ά", "ή", "ώ"), "arabic": ("ة",), "hebrew": ("ה",), "devanagari": ("ा", "ी")}
#: Titles that stand before a name, by the gender they tell; "" tells none (fixed values).
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Srta Signora Госпожа Κυρία السيدة גברת श्रीमती".split(),
    "m": "Mr Mister Herr Monsieur Señor Sr Signor Господин Κύριος السيد מר श्री".split(),
    "": "Dr Prof Professor Доктор الدكتور דוקטור डॉ".split(),
}
#: Titles that stand after a Chinese name (fixed values).
AFTER = {"女士": "f", "小姐": "f", "先生": "m", "博士": "", "教授": ""}
#: Given names that show a name without a title, besides those of GIVEN: by gender (fixed values).
KNOWN_GIVEN = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Hannah Sophie Camille Élise Ruth Esther Judith Miriam Astrid Agnes Doris Iris Carol Helen Ellen Karin Birgit Fatoumata Aminata Amina Ngozi Carmen Isabel Giulia Aisha Fatima Layla Priya Ananya Mei Yuki Akiko Olga Svetlana".split(),
    "m": "John James Robert Michael William Richard Joseph Thomas Charles Daniel Peter Paul George Pierre Jean Carlos José Luis Giovanni Mohammed Ahmed Ali Omar Hassan Raj Amit Wei Hiroshi Kenji Ivan Sergei Dmitri".split(),
}
#: A letter, and marks of scripts whose vowels are marks.
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0963\u0980-\u09e3])"
_WORD = rf"[^\W\d_]{_LETTER}*(?:[-'’]{_LETTER}+)*"
_GIVEN_GENDER = {n: g for (_, g), ns in GIVEN.items() for n in ns} | {n: g for g, ns in KNOWN_GIVEN.items() for n in ns}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: Names and titles in capitals; short ones are too often something else.
_GIVEN_GENDER |= {n.upper(): g for n, g in _GIVEN_GENDER.items() if len(n) > 3 and n.upper() != n}
_TITLE_GENDER |= {t.upper(): g for t, g in _TITLE_GENDER.items() if len(t) > 3 and t.upper() != t} | {"MRS": "f"}
_longest = lambda names: "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
_TITLE, _KNOWN = _longest(_TITLE_GENDER), _longest(_GIVEN_GENDER)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Type and pattern, the first that matches at a place wins. None takes time beyond linear: a run of
#: characters that an e-mail address or a number could begin with is tried at its first one only.
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]+@[^\W_](?:(?:[^\W_]|-)*[^\W_])?(?:\.[^\W_](?:(?:[^\W_]|-)*[^\W_])?)+"),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*"),
    ("secret", r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?[\w+/=.-]{8,}|(?<!\w)(?i:bearer)\s+(?=[A-Za-z_.~+/=-]*\d)[\w.~+/=-]{16,}"),
    ("hex", r"(?<!\w)(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)"),
    ("secret_word", r"(?<!\w)(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?)(?!\w)"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ip", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)"),
    ("ip6", r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"),
    ("ip6_short", r"(?<![\w:])(?=[0-9a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?(?![\w:])"),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w.])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+-])0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}(?![\w-])|(?<![\w.+-])0\d(?:[ .]\d{2}){4}(?![\w-])"),
    ("name", rf"(?<!\w)(?:(?:(?:{_TITLE})\.? )+{_WORD}(?: {_WORD})?|(?:{_KNOWN}) {_WORD})(?!\w)"),
    ("han", rf"[{HAN_SURNAMES}][\u4e00-\u9fff]{{1,2}}?(?=\s?(?:{'|'.join(AFTER)}))"),
)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_DIGIT, _KEYS = re.compile(r"\d"), re.compile(r"gh[pousr]_|AKIA|sk-|xox[abprs]-|eyJ")
#: What names begin with, and the runs of letters that can be one of these whatever stands before.
_HEADS = {*_TITLE_GENDER, *_GIVEN_GENDER}
_HEAD = re.compile(f"[{''.join(sorted({h[0] for h in _HEADS}))}]{_LETTER}+")


def _maybe(text: str) -> bool:
    """Cheap tests that a text must pass before the patterns are tried: all with a match pass."""
    if "@" in text or _DIGIT.search(text) or not _HEADS.isdisjoint(_HEAD.findall(text)) or text.count(":") >= 7:
        return True
    low = text.casefold()
    return any(x in low for x in ("token", "secret", "passw", "key")) or bool(_KEYS.search(text)) or any(x in text for x in AFTER)


_SECRET_HEAD = re.compile(r"(?i)bearer\s+|[a-z_-]+[\"']?\s*[:=]\s*[\"']?")
_PEM_HEAD = re.compile(r"-----BEGIN [A-Z ]+-----\s*")


@lru_cache(10_000)
def _script(text: str) -> str:
    """The script of a name: that of its first letter that tells one; '' for scripts without a table."""
    for char in text:
        if char.isalpha():
            name = unicodedata.name(char, "").split(" ")[0].lower()
            return {"cjk": "han"}.get(name, name if name in {*SURNAME_HEADS, *LETTERS} else "")
    return ""


def _names(words: list[str]) -> bool:
    """Whether all words begin with a capital, or with a letter of a script that has none."""
    return all(not w[0].islower() for w in words)


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, stop, type, mention): what is replaced, as it stands. Given names have the gender of
    their title in their type (given_f, given_m, or given).

    A name's capitals tell it from common words, where its script has any: its words begin with one.
    """
    if not _maybe(text):
        return
    for m in _FIND.finditer(text):
        kind, start, raw = m.lastgroup, m.start(), m[0]
        if kind == "name":
            words, at, genders, titled = raw.split(" "), start, "", False
            while words and words[0].rstrip(".") in _TITLE_GENDER:  # any number of titles
                genders += _TITLE_GENDER[words[0].rstrip(".")]
                at, titled = at + len(words.pop(0)) + 1, True
            while len(words) > 1 and not _names(words[-1:]):
                words.pop()
            if len(words) < 2 - titled or not _names(words):
                continue
            if not titled and words[0].isupper() and len(words[0]) > 1 and not words[-1].isupper() and _script(words[0]) in SURNAME_HEADS:
                continue  # a given name in capitals has a surname in capitals
            gender = genders[:1]
            if len(words) == 2:
                yield at, at + len(words[0]), f"given_{gender}".rstrip("_"), words[0]
                at += len(words[0]) + 1
            yield at, at + len(words[-1]), "surname", words[-1]
            continue
        if kind == "ip6_short" and not 2 <= sum(map(bool, raw.split(":"))) <= 7:
            continue
        if kind in ("secret", "pem"):
            head = (_SECRET_HEAD if kind == "secret" else _PEM_HEAD).match(raw).end()
            start, raw = start + head, raw[head:].rstrip(".-" if kind == "secret" else None)
        if raw:
            yield start, start + len(raw), {"hex": "secret", "secret_word": "secret", "pem": "secret", "ip6_short": "ip6", "han": "surname"}.get(kind, kind), raw


def normal(kind: str, raw: str) -> tuple[str, str]:
    """Type and entity: what makes two mentions the same."""
    if kind == "email":
        return kind, raw.lower()
    if kind in ("card", "phone", "ssn"):
        return kind, re.sub(r"\D", "", raw)
    if kind == "iban":
        return kind, raw.replace(" ", "")
    if kind == "ip6":
        return kind, _address(raw)
    kind = kind.split("_")[0]
    return kind, raw.title() if kind in ("given", "surname") and _shouted(raw) else raw


def _address(raw: str) -> str:
    try:
        return ipaddress.ip_address(raw).compressed
    except ValueError:
        return raw.lower()


def _shouted(raw: str) -> bool:
    return len(raw) > 1 and raw.isupper()


@lru_cache(10_000)
def spelt_gender(name: str) -> str:
    """The gender that a given name's or surname's spelling tells."""
    return _GIVEN_GENDER.get(name) or ("f" if name.lower().endswith(FEMININE.get(_script(name), ())) and FEMININE.get(_script(name)) else "m")


def _contradicts(kind: str, raw: str) -> int | None:
    """1 if a given name's title says another gender than its spelling, 0 if the same, None without one."""
    return int(spelt_gender(raw) != kind[-1]) if kind in ("given_f", "given_m") else None


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.text, self.n = key, "\x1f".join(map(str, parts)), 0
        self.left: list[int] = []

    def below(self, n: int) -> int:
        if not self.left:
            raw = hmac.new(self.key, f"{self.text}\x1f{self.n}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
            self.left = [int.from_bytes(raw[i : i + 4], "big") for i in range(0, 32, 4)]
            self.n += 1
        return self.left.pop() % n

    def pick(self, items: list[str] | str) -> str:
        return items[self.below(len(items))]


def _luhn(digits: str) -> int:
    odd = [int(x) for x in digits[-1::-2]]
    even = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10


def _same_layout(raw: str, chars: str) -> str:
    """raw with its digits and letters replaced in order by chars."""
    left = iter(chars)
    return "".join([*(next(left) if c.isalnum() else c for c in raw), *left])


def _like(stream: _Stream, raw: str) -> str:
    """Each character replaced by one of its class."""
    pools = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return "".join(next((stream.pick(p) for p in pools if c in p), c) for c in raw)


def _made_name(s: _Stream, kind: str, entity: str, attempt: int, gender: str) -> str:
    script = _script(entity)
    if script in SURNAME_HEADS:
        if kind == "given" and not attempt:
            return s.pick(GIVEN[script, gender])
        middles = [s.pick(SURNAME_MIDDLES[script]) for _ in range((1 if kind == "given" else 2) + attempt // 8)]
        if kind == "surname":
            return s.pick(SURNAME_HEADS[script]) + "".join(middles) + s.pick(SURNAME_TAILS[script, gender])
        ends = {("latin", "f"): ("ina", "elia", "ora"), ("latin", "m"): ("ard", "ian", "olf"), ("cyrillic", "f"): ("ина", "ия"), ("cyrillic", "m"): ("ир", "ан"), ("greek", "f"): ("ία", "ίνα"), ("greek", "m"): ("ος", "ης")}
        return s.pick(SURNAME_HEADS[script]) + "".join(middles) + s.pick(ends[script, gender])
    out = []
    for i, c in enumerate(entity):
        if script == "han" and kind == "surname" and not i:
            out.append(s.pick(HAN_SURNAMES))
        elif not c.isalpha():
            out.append(c)
        elif script in LETTERS:
            out.append(s.pick(LETTERS[script]))
        else:  # a letter of the same kind among its neighbours
            near = [x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if unicodedata.category(x) == unicodedata.category(c)]
            out.append(s.pick(near))
    if kind == "given" and gender == "f" and FEMININE.get(script) and out[-1] not in FEMININE[script]:
        out[-1:] = [out[-1], FEMININE[script][0]] if len(out) == 1 else [FEMININE[script][0]]
    return "".join(out) + "".join(s.pick(LETTERS.get(script) or out) for _ in range(attempt // 8))


def surrogate(kind: str, entity: str, attempt: int, key: bytes, swapped: bool = False) -> str:
    """The surrogate of an entity in normal form, itself in normal form. swapped gives a name the
    gender that its spelling doesn't tell."""
    s = _Stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        shaped = _like(s, re.sub(r"[^\x00-\x7f]", "x", local))
        tail = "".join(s.pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6))
        return f"{shaped}.{tail}@mail.example.org" if "." in local else f"{shaped}{tail}@mail.example.org"
    if kind == "ip":
        # a private range of 2^24 addresses, the reserved range of 2^28 where that fills up, then IPv6
        if attempt >= 24:
            return "2001:db8:" + ":".join(f"{s.below(65536):x}" for _ in range(6))
        first = 10 if attempt < 4 else 240 + s.below(16)
        return f"{first}.{s.below(256)}.{s.below(256)}.{s.below(256)}"
    if kind == "ip6":
        return "2001:db8:" + ":".join(f"{s.below(65536):x}" for _ in range(6))
    if kind == "card":
        body = "9" + "".join(str(s.below(10)) for _ in range(len(entity) - 2))  # no issuer begins with 9
        last = (10 - _luhn(body + "0")) % 10
        return body + str(last if _luhn(entity) == 0 else (last + 1 + s.below(9)) % 10)
    if kind == "ssn":
        more = "".join(str(s.below(10)) for _ in range(attempt // 16))
        return f"9{s.below(100):02}{s.below(100):02}{s.below(10_000):04}{more}"  # no number begins with 9
    if kind == "phone":
        return (entity[:1] if attempt < 8 else str(1 + s.below(9))) + "".join(str(s.below(10)) for _ in range(len(entity) - 1 + attempt // 16))
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", entity):
            pool = "0123456789ABCDEF" if entity.upper() == entity else "0123456789abcdef"
            return "".join(s.pick(pool) for _ in entity)
        head = m[0] if (m := _KEYS.match(entity)) else ""
        return head + _like(s, entity[len(head) :])
    if kind == "iban":
        return "ZZ" + _like(s, entity[2:])
    gender = spelt_gender(entity)
    return _made_name(s, kind, entity, attempt, {"f": "m", "m": "f"}[gender] if swapped else gender)


def dressed(kind: str, raw: str, new: str) -> str:
    """The surrogate in the layout of this mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        return _same_layout(raw, new)
    return new.upper() if kind.startswith(("given", "surname")) and _shouted(raw) else new


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, entity, swapped): the distinct entities of all texts. swapped is set for given names
    whose titles, all that tell a gender, contradict their spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(*normal(kind, raw), _contradicts(kind, raw)) for t in batch.column(0) for _, _, kind, raw in find(t.as_py() or "")}
            rows = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.string(), pa.int32()))], ["kind", "entity", "other"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, entity string, other int")
    return found.groupBy("kind", "entity").agg(F.coalesce(F.min("other") == 1, F.lit(False)).alias("swapped"))


def _attempted(rows: DataFrame, key: bytes) -> DataFrame:
    @F.pandas_udf("string")
    def made(kind: pd.Series, entity: pd.Series, attempt: pd.Series, swapped: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, a, key, w) for k, e, a, w in zip(kind, entity, attempt, swapped)], dtype="object")

    return rows.withColumn("surrogate", made("kind", "entity", "attempt", "swapped"))


def assignments(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, swapped, attempt, surrogate) without collisions, for distinct (kind, entity) rows.

    Among entities with one surrogate the least by (kind, entity) keeps it and all others try again;
    so does one whose surrogate is an entity of the corpus. Settled ones never change, so each round
    works on the collided rows alone.
    """
    found = cut(found)
    taken = found.select(F.col("entity").alias("surrogate")).distinct()
    settled = None
    open_ = _attempted(found.withColumn("attempt", F.lit(0)), key)
    while True:
        free = open_.join(taken, "surrogate", "left_anti")
        if settled is not None:
            free = free.join(settled.select("surrogate").distinct(), "surrogate", "left_anti")
        first = free.groupBy("surrogate").agg(F.min(F.struct("kind", "entity", "swapped", "attempt")).alias("x")).select("x.*", "surrogate")
        won = cut(first)
        settled = won if settled is None else settled.unionByName(won)
        rest = cut(open_.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", "swapped", (F.col("attempt") + 1).alias("attempt")))
        if rest.isEmpty():
            return settled
        open_ = _attempted(rest, key)


def _replaced(text: str | None, overrides: dict[tuple[str, str], tuple[int, bool]], key: bytes) -> tuple[str | None, int]:
    if text is None:
        return None, 0
    out, at, n = [], 0, 0
    for start, stop, kind, raw in find(text):
        entity = normal(kind, raw)
        new = _surrogate(*entity, *overrides.get(entity, (0, False)), key)
        out += [text[at:start], dressed(kind, raw, new)]
        at, n = stop, n + 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


@lru_cache(50_000)
def _surrogate(kind: str, entity: str, attempt: int, swapped: bool, key: bytes) -> str:
    return surrogate(kind, entity, attempt, key, swapped)


def release_key(spark: SparkSession) -> bytes:
    """The key that the application's setting KEY_CONF names; without one, a random key of this
    application, so that its surrogates can't be computed by others (nor repeated by another run)."""
    found = spark.conf.get(KEY_CONF, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, found)
    return found.encode()


def replace(docs: DataFrame, key: bytes, count_col: str | None = None) -> DataFrame:
    """docs with every entity in text replaced; columns unchanged (count_col, if named, is added).

    A null text stays null, an empty one empty; time is linear in a text's length. Repeated rows get
    the same text each; null ids are no matter. Of entities that want one surrogate the least keeps
    it. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    again = cut(assignments(entities(docs), key).where("attempt > 0 or swapped").select("kind", "entity", "attempt", "swapped"))
    n, size = again.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("entity")), F.lit(0))).first()
    result, wanted = fresh(docs, "replaced"), fresh(docs, "overrides")
    if n <= BROADCAST_OVERRIDES and size <= BROADCAST_BYTES:
        small = {(r["kind"], r["entity"]): (r["attempt"], r["swapped"]) for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(small)

        @F.pandas_udf("text string, n long")
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_replaced(t, shared.value, key) for t in texts], columns=["text", "n"])

        done = docs.withColumn(result, run("text"))
    else:
        done = _joined(docs, again, result, wanted, key)
    columns = [F.col(f"{result}.text").alias(c) if c == "text" else column(c) for c in docs.columns]
    return done.select(*columns, *([F.col(f"{result}.n").alias(count_col)] if count_col else []))


def _joined(docs: DataFrame, again: DataFrame, result: str, wanted: str, key: bytes) -> DataFrame:
    """As `replace` with too many overrides to broadcast: they are joined to their texts by hash.

    Mentions of one hot entity meet its override in salted groups: the overrides are repeated by salt.
    """
    h = fresh(docs, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, *e) for x, t in zip(batch.column(0).to_pylist(), batch.column(1)) for e in sorted({normal(k, raw) for _, _, k, raw in find(t.as_py() or "")})]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.string(), pa.string()))], ["h", "kind", "entity"])

    @F.pandas_udf("text string, n long")
    def mapped(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_replaced(t, {(x["kind"], x["entity"]): (x["attempt"], x["swapped"]) for x in (() if o is None else o)}, key) for t, o in zip(texts, lists)], columns=["text", "n"])

    salts = 16
    keyed = docs.withColumn(h, F.xxhash64("text"))
    mentions = keyed.select(h, "text").mapInArrow(run, "h long, kind string, entity string").distinct().withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    spread = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = mentions.join(spread, ["kind", "entity", "salt"]).groupBy("h").agg(F.collect_list(F.struct("kind", "entity", "attempt", "swapped")).alias(wanted)).withColumnRenamed("h", h)
    return keyed.join(lists, h, "left").withColumn(result, mapped("text", wanted))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), release_key(spark), "n_entities")


QUERIES = {"op2_surrogates": _query}
