"""Personal data replaced by keyed surrogates of the same type and form."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, saved, unused

_EMAIL = re.compile(r"(?<![\w.+-])([^\W_](?:[\w.%+-]{0,62}[^\W_])?)@((?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24})(?![\w-])")
#: What may be an IPv6 address; ``_ipv6`` decides.
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", re.ASCII)
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.ASCII)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w]|[.-]\d)", re.ASCII)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_PHONE = re.compile(
    r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)",
    re.ASCII,
)
# National forms of the corpus's languages, with the least and the largest number of digits.
_NATIONAL = (
    (10, 10, re.compile(r"0[1-9](?:([ .-]?)\d{2})(?:\1\d{2}){3}", re.ASCII)),  # fr: 06 12 34 56 78
    (11, 11, re.compile(r"0[1-9]\d{9}", re.ASCII)),  # de, en: 01711234567
    (9, 12, re.compile(r"0[1-9]\d{0,3}(?:[ /-]|/ ?| [/-] )\d{3,8}", re.ASCII)),  # de, en: 030 1234567, 0171/1234567, 020 7946 0958
    (9, 12, re.compile(r"\(0\d{1,4}\) ?\d{3,8}", re.ASCII)),  # de, en: (030) 1234567
    (9, 9, re.compile(r"[6-9]\d{2}([ .-])\d{3}\1\d{3}(?!\1\d{3}(?!\d)(?!\1\d{3}\1\d{3}(?!\d)))", re.ASCII)),  # es: 612 345 678
    (9, 9, re.compile(r"[6-9]\d{2}([ .-])\d{2}\1\d{2}\1\d{2}", re.ASCII)),  # es: 612 34 56 78
    (9, 9, re.compile(r"[89]\d([ .-])\d{3}\1\d{2}\1\d{2}", re.ASCII)),  # es: 91 234 56 78
    (10, 10, re.compile(r"[2-9]\d{2} \d{3}[ -]\d{4}", re.ASCII)),  # en: 212 555 0123
)
#: Further groups of a number, and what may not follow a whole number: a group that does not begin the next one.
_GROUP = re.compile(r"[ -]\d{1,4}(?!\d)", re.ASCII)
_MORE = re.compile(r"[ -](?!0[1-9])\d", re.ASCII)
_AFTER = re.compile(r"\w|[.,/-]\d", re.ASCII)
_NAME_WORD = r"\p{Lu}[\p{L}\p{M}]+(?:['’-]\p{Lu}[\p{L}\p{M}]+)*"
# Forms of address, by gender.
_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "Signora", "Госпожа", "Κυρία")
_MALE = ("Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Signor", "Господин", "Κύριος")
_NEUTRAL = ("Dr", "Prof", "Professor")
_NAMED = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])({'|'.join((*_FEMALE, *_MALE, *_NEUTRAL))})(\.? )({_NAME_WORD}(?: {_NAME_WORD}){{0,2}})(?![\p{{L}}\p{{M}}\p{{N}}])")

_WORDS = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_NAME_WORD}(?![\p{{L}}\p{{M}}\p{{N}}])")

_DIGITS = re.compile(r"\d+", re.ASCII)

KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "given_f", "given_m", "surname")


def _luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _ipv6(text: str) -> str | None:
    """The short form of an address with three groups or more; names joined by colons seldom have as many."""
    if sum(1 for group in text.split(":") if group) < 3:
        return None
    try:
        return str(ipaddress.IPv6Address(text))
    except ValueError:
        return None


def _gender(title: str, given: str) -> str:
    """By the form of address; behind a neutral one by the ending of the given name."""
    if title in _NEUTRAL:
        return "f" if given.endswith(("a", "\u0430", "\u044f", "\u03b1")) else "m"
    return "f" if title in _FEMALE else "m"


def _national(text: str, start: int, end: int) -> int | None:
    """The end of a phone number in a national form. It is no part of a longer row of numbers: none but an entity (up to ``end``) ends one character before it."""
    if re.search(r"(?:\w|[+(]|\d[ .,/-]|[.-])$", text[max(end, start - 2) : start], re.ASCII):
        return None
    for least, most, pattern in _NATIONAL:
        if not (match := pattern.match(text, start)):
            continue
        ends = [match.end()]
        while least < most and len(ends) < 3 and (group := _GROUP.match(text, ends[-1])):
            ends.append(group.end())
        fits = [e for e in reversed(ends) if not _AFTER.match(text, e) and least <= sum(map(str.isdigit, text[start:e])) <= most]
        if fits:
            return next((e for e in fits if not _MORE.match(text, e)), fits[0])
    return None


def _mentions(text: str, named: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Whole words of the text that are one of the names, of the kind that the name has in the last form of address before, else in the first."""
    kinds: dict[str, str] = {}
    for *_, kind, norm in reversed(named):
        kinds[norm] = kind
    at = 0
    for word in _WORDS.finditer(text):
        while at < len(named) and named[at][0] <= word.start():
            kinds[named[at][3]] = named[at][2]
            at += 1
        norm = word[0].casefold()
        if norm in kinds:
            yield word.start(), word.end(), kinds[norm], norm


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Entities that hold digits, found from the first digit of each run."""
    end = 0
    for run in _DIGITS.finditer(text):
        at = run.start()
        if at < end:
            continue
        tries = [(at - 2, "iban", _IBAN)] if at >= 2 else []
        tries += [(at - 1, "phone", _PHONE)] if at and text[at - 1] in "+(" else []
        for start, kind, pattern in [*tries, (at, "ip", _IPV4), (at, "card", _CARD), (at, "ssn", _SSN), (at, "phone", _PHONE)]:
            if start >= end and (match := pattern.match(text, start)):
                end = match.end()
                norm = match[0] if kind == "ip" else match[0].replace(" ", "") if kind == "iban" else re.sub(r"\D", "", match[0])
                yield start, end, kind, norm
                break
        else:
            for start in (at - 1, at) if at and text[at - 1] == "(" else (at,):
                if start >= end and (stop := _national(text, start, end)):
                    end = stop
                    yield start, end, "phone", re.sub(r"\D", "", text[start:end])
                    break


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities in a text, left to right and without overlaps; e-mail addresses go before names
    and names before numbers. A name behind a form of address is one wherever its words stand in the text. The normal form is the same for all spellings of one entity."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if any(w in text for w in (*_FEMALE, *_MALE, *_NEUTRAL)):
        for m in _NAMED.finditer(text):
            at, words = m.start(3), m[3].split(" ")
            for k, word in enumerate(words):
                kind = "surname" if k == len(words) - 1 else f"given_{_gender(m[1], words[0].casefold())}"
                found.append((at, at + len(word), kind, word.casefold()))
                at += len(word) + 1
        named = [e for e in found if e[2] != "email"]
        found += _mentions(text, named) if named else ()
    if text.count(":") >= 3:
        found += [(m.start(), m.end(), "ip", norm) for m in _COLONS.finditer(text) if (norm := _ipv6(m[0]))]
    found += _numbers(text)
    found.sort(key=lambda e: e[0])  # stable: of two that start together, the one found first
    out, end = [], 0
    for entity in found:
        if entity[0] >= end:
            out.append(entity)
            end = entity[1]
    return out


class _Stream:
    """Numbers drawn from HMAC-SHA-256 of the entity; nobody without the key can tell them."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.label, self.count, self.pool = key, "\0".join(map(str, parts)).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            block = hmac.new(self.key, self.label + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.count = self.pool << 256 | int.from_bytes(block, "big"), self.left + 256, self.count + 1
        self.pool, value = divmod(self.pool, 1 << 32)
        self.left -= 32
        return value * n >> 32


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """Small letters of the script of a letter, from its part of the code table; a to z for Latin ones."""
    script = unicodedata.name(c, "LATIN").split(" ")[0]
    if script == "LATIN":
        return "abcdefghijklmnopqrstuvwxyz"
    part = ord(c.lower()[0]) & ~0xFF
    near = [chr(k) for k in range(part, part + 0x100)]
    alike = [x for x in near if x.isalpha() and not x.isupper() and unicodedata.name(x, "").split(" ")[0] == script]
    if c.lower() != c.upper():  # a script with capitals: letters that have one
        alike = [x for x in alike if x.upper() != x and len(x.upper()) == 1]
    return "".join(alike) or c


def _shaped(text: str, draw: _Stream) -> str:
    """Each letter and digit replaced by one of its kind; the rest stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            letters = _alphabet(c)
            letter = letters[draw.below(len(letters))]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


# Letters from which names are made, the endings of given names by gender, and endings of family names that show one.
_LETTERS = {
    "latin": ("bdfgklmnprstv", "aeiou", {"given_f": "a", "given_m": "o"}, ()),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"given_f": "а", "given_m": "р"}, ("ова", "ева", "ина", "ов", "ев", "ин")),
    "greek": ("βγδκλμνπρστ", "αεοι", {"given_f": "α", "given_m": "ος"}, ("ου", "ος", "ης")),
}


def _script(word: str) -> str | None:
    """A script of the table, or None for another one."""
    script = unicodedata.name(word[0], "LATIN").split(" ")[0].lower()
    return script if script in _LETTERS else None


def _name(norm: str, kind: str, draw: _Stream, attempt: int) -> str:
    if _script(norm) is None:
        letters = _alphabet(norm[0])
        return "".join(letters[draw.below(len(letters))] for _ in range(5 + draw.below(4) + attempt // 4))
    consonants, vowels, given, family = _LETTERS[_script(norm)]
    syllables = 2 + draw.below(2) + attempt // 4
    stem = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(syllables)) + consonants[draw.below(len(consonants))]
    return stem + (given[kind] if kind in given else next((e for e in family if norm.endswith(e)), ""))


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the surrogate. Attempts give different ones, in case one is taken. Kept are: an e-mail's shape and top-level
    domain, a phone's country code (or the first digits of a national form) and length, whether an IP address is private, a card's first digit and whether its check
    digit fits, an IBAN's country with fitting check digits, a name's script and the gender of its form of address."""
    draw = _Stream(key, kind, norm, attempt)
    if kind == "email":
        local, domain = norm.split("@")
        body, _, top = domain.rpartition(".")
        site = _shaped(body, _Stream(key, "domain", domain, attempt // 2))  # addresses of one domain stay together
        more = "".join(chr(97 + draw.below(26)) for _ in range(attempt // 8))  # short shapes may be used up
        return f"{_shaped(local, draw)}{more}@{site}.{top}"
    if kind == "ip" and ":" in norm:
        first = norm.split(":")[0]
        # Local and private ranges stay what they are, others become public.
        begin = first if first[:2] in ("fc", "fd", "fe", "ff") else f"{0x2000 + draw.below(0x2000):x}"
        return str(ipaddress.IPv6Address(":".join([begin, *[f"{1 + draw.below(0xFFFF):x}" for _ in range(7)]])))
    if kind == "ip":
        a, b, *_ = map(int, norm.split("."))
        tail = [draw.below(256) for _ in range(3)]
        if attempt >= 16:
            a = b = 0
        if a in (10, 127):
            return ".".join(map(str, [a, *tail]))
        if (a, b) == (192, 168) or (a == 172 and 16 <= b < 32):
            return ".".join(map(str, [a, b, *tail[:2]]))
        first = draw.below(223) + 1
        while first in (10, 127, 172, 192):
            first = draw.below(223) + 1
        return ".".join(map(str, [first, *tail]))
    if kind == "card":
        body = norm[0] + "".join(str(draw.below(10)) for _ in norm[1:-1])
        check = _luhn(body)
        return body + str(check if _luhn(norm[:-1]) == int(norm[-1]) else (check + 1 + draw.below(9)) % 10)
    if kind == "iban":
        body = _shaped(norm[4:], draw)
        number = int("".join(str(int(c, 36)) for c in body + norm[:2]) + "00")
        return f"{norm[:2]}{98 - number % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        keep = 0 if kind == "ssn" or len(norm) <= 10 else len(norm) - 10 if norm[0] == "1" or len(norm) > 12 else 2
        if kind == "phone" and (norm[0] == "0" or (len(norm) == 9 and norm[0] in "6789")):
            keep = 2 if norm[0] == "0" else 1  # what a national form is known by
        digits = norm[:keep]
        for c in norm[keep:]:
            digits += str(draw.below(10)) if c in "01" else str(2 + draw.below(8))
        return digits + "".join(str(draw.below(10)) for _ in range(attempt // 16))
    return _name(norm, kind, draw, attempt)


def _pour(original: str, kind: str, normal: str) -> str:
    """The surrogate in the spelling of the original: its separators and capitals."""
    if kind in ("phone", "ssn", "card", "iban"):
        letters = iter(normal)
        return "".join(next(letters) if c.isalnum() else c for c in original) + "".join(letters)
    if kind == "email":
        if len(original) != len(normal):
            return normal
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, normal, strict=True))
    if kind == "ip":
        return normal
    return normal.upper() if original.isupper() and len(original) > 1 else normal[:1].upper() + normal[1:]


def entities(text: Column) -> Column:
    """The distinct (kind, norm) of a text."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [sorted({e[2:] for e in find_entities(t.as_py() or "")}) for t in batch]
            yield pa.array([[{"kind": k, "norm": n} for k, n in row] for row in found], pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string())])))

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "array<struct<kind: string, norm: string>>")(text)


def _tried(key: bytes):
    def attempt(kinds: pa.Array, norms: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k.as_py(), n.as_py(), a.as_py()) for k, n, a in zip(kinds, norms, attempts, strict=True)], pa.string())

    attempt.__annotations__ = dict.fromkeys(("kinds", "norms", "attempts", "return"), pa.Array)
    return F.arrow_udf(attempt, "string")


#: Retried entities up to this many are sent to every task (some 100 bytes each); more are joined by document.
SENT_RETRIES = 50_000


def collisions(found: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``norm``, ``attempt`` of the entities in ``found`` (distinct kind and norm) whose first surrogate is taken.

    A surrogate is taken if it is an entity of the corpus itself or the surrogate of another one; of those that meet, the one with the
    fewest attempts and then the smallest normal form keeps it. The others try again until all are different. Only distinct entities
    are compared, by their surrogates' equality.
    """
    group = F.when(F.col("kind").startswith("given") | F.col("kind").startswith("surname"), F.lit("name")).otherwise(F.col("kind"))
    rows = saved(found.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("group", group))
    originals = rows.select(F.col("group").alias("o_group"), F.col("norm").alias("o_norm")).distinct()
    tried = _tried(key)
    rows = saved(rows.withColumn("new", tried("kind", "norm", "attempt")))
    while True:
        keeper = rows.groupBy("group", "new").agg(F.min(F.struct("attempt", "norm", "kind")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        shared = keeper.where("n > 1").select(F.col("group").alias("s_group"), F.col("new").alias("s_new"), "keeper")
        real = rows.select("group", "new").distinct().join(originals, (F.col("group") == F.col("o_group")) & (F.col("new") == F.col("o_norm")), "left_semi")
        taken = real.select(F.col("group").alias("s_group"), F.col("new").alias("s_new"), F.lit(None).cast("struct<attempt: int, norm: string, kind: string>").alias("keeper"))
        marks = shared.join(taken.select("s_group", "s_new"), ["s_group", "s_new"], "left_anti").unionByName(taken)
        rows_marked = rows.join(marks, (F.col("group") == F.col("s_group")) & (F.col("new") == F.col("s_new")), "left")
        again = F.col("s_new").isNotNull() & ~F.struct("attempt", "norm", "kind").eqNullSafe(F.col("keeper"))
        rows_marked = saved(rows_marked.select("kind", "norm", (F.col("attempt") + again.cast("int")).alias("attempt"), "group", "new", again.alias("again")))
        if rows_marked.where("again").isEmpty():
            return rows_marked.where("attempt > 0").select("kind", "norm", "attempt")
        redone = rows_marked.where("again").withColumn("new", tried("kind", "norm", "attempt"))
        rows = saved(rows_marked.where("not again").unionByName(redone).drop("again"))


def _replaced(key: bytes, text: Column, retries: Column | None, sent: dict[tuple[str, str], int]) -> Column:
    kinds = pa.struct([("text", pa.string()), ("n_entities", pa.int64()), ("kinds", pa.string())])

    def rewrite(value: str | None, own: dict[tuple[str, str], int]) -> dict:
        if value is None:
            return {"text": None, "n_entities": 0, "kinds": ""}
        out, end, counts, memory = [], 0, {}, {}
        for start, stop, kind, norm in find_entities(value):
            if (kind, norm) not in memory:
                memory[kind, norm] = surrogate(key, kind, norm, own.get((kind, norm), 0))
            out += [value[end:start], _pour(value[start:stop], kind, memory[kind, norm])]
            end = stop
            counts[kind] = counts.get(kind, 0) + 1
        return {"text": "".join([*out, value[end:]]), "n_entities": sum(counts.values()), "kinds": ",".join(f"{k}:{counts[k]}" for k in KINDS if k in counts)}

    if retries is None:

        def simple(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([rewrite(t.as_py(), sent) for t in batch], kinds)

        simple.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(simple, "text string, n_entities bigint, kinds string")(text)

    def joined(texts: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array(
            [rewrite(t.as_py(), {(r["kind"], r["norm"]): r["attempt"] for r in o.as_py() or ()}) for t, o in zip(texts, own, strict=True)], kinds
        )

    joined.__annotations__ = {"texts": pa.Array, "own": pa.Array, "return": pa.Array}
    return F.arrow_udf(joined, "text string, n_entities bigint, kinds string")(text, retries)


def with_surrogates(docs: DataFrame, key: bytes, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a further column ``name``, a struct of the text without personal data, n_entities and kinds (``kind:count``, comma-joined).

    Entities: e-mail addresses, phone numbers (international, and national forms of the corpus's languages), IP addresses, card numbers, IBANs, US
    social security numbers, and names behind a form of address with all other mentions of their words in the same text.
    Each becomes a surrogate of its type, made from a keyed hash of its normal form, so one entity has one surrogate in all
    texts and spellings. ``collisions`` sees to it that two entities never share one and that none is an entity of the corpus. The
    key is the caller's secret.

    Entities that had to try again are few; up to ``SENT_RETRIES`` they go with the tasks, more are joined to their documents by
    a hash of the text. Null texts stay null, empty ones empty; texts without entities are unchanged. Repeated rows stay
    repeated, an empty table stays empty, all other columns are kept as they are.
    """
    text = ref(text_col).cast("string")
    occurring = docs.select(text.alias("text")).select(F.explode(entities(F.col("text"))).alias("e"))
    retries = saved(collisions(occurring.select("e.kind", "e.norm").distinct(), key))
    count = retries.count()
    if count <= SENT_RETRIES:
        sent = {(r["kind"], r["norm"]): r["attempt"] for r in retries.collect()}
        return docs.withColumn(name, _replaced(key, text, None, sent))
    mark = F.xxhash64(text)
    pairs = docs.select(mark.alias("m"), F.explode(entities(text)).alias("e")).select("m", "e.kind", "e.norm").distinct()
    mine, its, own = (unused(docs, n) for n in ("__mark", "__its_mark", "__retries"))
    lists = pairs.join(retries, ["kind", "norm"]).groupBy(F.col("m").alias(its)).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias(own))
    rows = docs.withColumn(mine, mark).join(lists, F.col(mine) == F.col(its), "left")
    return rows.withColumn(name, _replaced(key, text, F.col(own), {})).drop(mine, its, own)


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: the id, the text with surrogates, n_entities and kinds; see ``with_surrogates``."""
    rows = with_surrogates(docs.select(ref(id_col).alias(id_col), ref(text_col).alias(text_col)), key, "__pii", text_col)
    return rows.select(ref(id_col), *[F.col("__pii")[n].alias(n) for n in ("text", "n_entities", "kinds")])


def replaced(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the texts replaced, the same columns in the same order; ``length_col``, if there, is the length of the new text."""
    name = unused(docs, "__pii")
    rows = with_surrogates(docs, key, name, text_col)
    new = {text_col: F.col(name)["text"]}
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        new[length_col] = F.length(F.col(name)["text"]).cast(kind)
    return rows.select(*[new[c].alias(c) if c in new else ref(c) for c in docs.columns])
