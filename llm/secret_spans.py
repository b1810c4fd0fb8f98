"""Secrets in texts: fixed shapes, and values in credential contexts that a guesser would need long for."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.plans.ranks import ranked_between
from llm.common import ref, saved

# The base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Words that name a credential, and what may stand between the word and its value: any number of blanks, up to three of other white space. A word
#: starts behind anything but letters and digits, or with a capital: behind a small letter or digit, or before a small letter.
_BLANKS = r"[\x20\t]*+\s{0,3}[\x20\t]*+"
_CONTEXT = re.compile(
    rf"""(?:(?<![A-Za-z0-9])(?:[A-Za-z0-9]{{1,32}}[_-])?|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))
    (?:password|passwd|passphrase|passcode|pwd|pass|pin|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)(?![A-Za-z])
    ["']?{_BLANKS}(?:is{_BLANKS}:?|are{_BLANKS}:?|->|=>|:=|=|:){_BLANKS}(?:"([^"\r\n]{{6,}})"|'([^'\r\n]{{6,}})'|([^\s"',;<>]{{6,}}))""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
_CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "key", "credential")
_USERINFO = re.compile(r"://[^\s:/@]*+:([^\s@/]{6,}+)@")

#: Common parts of passwords, the most frequent first; the place in the list is the rank. Callers may pass their own.
WORDS = (
    "password pass admin root user guest login welcome letmein master secret test default changeme hello qwerty dragon monkey "
    "football baseball love sunshine princess shadow summer winter spring autumn monday friday january december company "
    "server database example sample dummy token key none null true false private public access account"
).split()
_LEET = str.maketrans("@4831!0$57", "aaeeilosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
#: Bits of a date: day and month of about 120 years, with a separator; of a year alone.
_DATE_BITS, _YEAR_BITS = math.log2(366 * 120 * 4), math.log2(120)
#: A new segment costs the guesser this much: which kind of segment comes next, and how long it is.
_NEXT = 2.0


def _adjacent(a: str, b: str) -> bool:
    """Neighbours in a row of the keyboard, above or below each other, or one step apart in the alphabet."""
    p, q = _PLACE.get(a.lower().translate(_SHIFTED)), _PLACE.get(b.lower().translate(_SHIFTED))
    near = p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and p != q
    return near or (a.isalnum() and b.isalnum() and a.isascii() and b.isascii() and abs(ord(a) - ord(b)) == 1)


#: Characters in each class: lower case, upper case, digits, other ASCII, the rest; a span of several classes draws on their sum.
_SIZES = (26, 26, 10, 33, 100)


def _class(c: str) -> int:
    """The place in ``_SIZES`` of the class of a character."""
    if c.isdigit():
        return 2
    if c.isascii():
        return (0 if c.islower() else 1) if c.isalpha() else 3
    return 4


def _class_bits(classes: int) -> float:
    """Bits of one character of a span in which these classes (a bit each) occur."""
    return math.log2(sum(size for k, size in enumerate(_SIZES) if classes >> k & 1))


def _span_bits(span: str) -> float:
    """Bits of a span by brute force."""
    classes = 0
    for c in set(span):
        classes |= 1 << _class(c)
    return len(span) * _class_bits(classes)


def _alphabet(c: str) -> float:
    """Bits of one character that nothing else explains, its class known."""
    if c.isdigit():
        return math.log2(10)
    if c.isascii():
        return math.log2(26) if c.isalpha() else math.log2(33)
    return math.log2(100)


def _ends(value: str, ranks: dict[str, int]) -> dict[int, list[tuple[int, float]]]:
    """For each end, the starts of explained segments and their bits."""
    n, found = len(value), {}

    def add(start: int, end: int, bits: float) -> None:
        found.setdefault(end, []).append((start, bits))

    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    longest = max(map(len, ranks), default=0)
    for start in range(n):
        for size in range(3, min(longest, n - start) + 1):
            end = start + size
            word = low[start:end]
            rank = ranks.get(word)
            leet = 0.0
            if rank is None and (rank := ranks.get(plain[start:end])) is not None:
                leet = float(sum(a != b for a, b in zip(word, plain[start:end], strict=True)))
            if rank is not None:
                upper = sum(c.isupper() for c in value[start:end])
                case = 0.0 if upper == 0 else 1.0 if upper in (1, size) else math.log2(math.comb(size, min(upper, size - upper)) + 1)
                add(start, end, math.log2(rank + 1) + case + leet)
    for match in _DATE.finditer(value):
        add(match.start(), match.end(), _YEAR_BITS if match.end() - match.start() == 4 else _DATE_BITS)
    start = 0
    while start < n:  # keyboard walks: runs of neighbours, three keys or more
        end, turns, last = start + 1, 0, None
        while end < n and _adjacent(value[end - 1], value[end]):
            step = ord(value[end]) - ord(value[end - 1])
            turns += last is not None and step != last
            last, end = step, end + 1
        if end - start >= 3:
            add(start, end, math.log2(94) + math.log2(end - start) + turns)
        start = max(end - 1, start + 1)
    for period in range(1, min(8, n // 2) + 1):  # repeats: a block that follows itself once or more
        run = 0
        for at in range(period, n + 1):
            if at < n and value[at] == value[at - period]:
                run += 1
                continue
            if run >= max(period, 2):
                begin = at - run - period
                add(begin, at, _span_bits(value[begin : begin + period]) + math.log2((run + period) / period))
            run = 0
    return found


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """The base-2 logarithm of the guesses that the cheapest cut of ``value`` into words, dates, repeats, keyboard walks and brute-force spans
    needs, if the class of each character is known. ``best[i][b]`` is the least cost of the first i characters, b telling whether they end in a brute-force span, which goes
    on without a new start. Linear in the length, for any length."""
    ends = _ends(value, ranks)
    closed, open_ = [0.0], [math.inf]
    for end in range(1, len(value) + 1):
        bits = _alphabet(value[end - 1])
        open_.append(min(open_[end - 1], closed[end - 1] + _NEXT) + bits)
        best = math.inf
        for start, cost in ends.get(end, ()):
            best = min(best, min(closed[start], open_[start]) + _NEXT + cost)
        closed.append(best)
    return min(closed[-1], open_[-1])


def secret_bits(value: str, ranks: dict[str, int]) -> float:
    """Like ``guess_bits``, but a guesser does not know which class of character stands where: each character of a brute-force span costs as
    much as the classes that occur in the span ask for, 26, 52, 62 or 95 characters for ASCII. ``open_`` has the least cost
    by the set of classes of the span that goes on. Linear in the length."""
    ends = _ends(value, ranks)
    kinds = [1 << _class(c) for c in value]
    every = 0
    for kind in kinds:
        every |= kind
    bits = {s: _class_bits(s) for s in range(1, every + 1) if s & ~every == 0}
    using = {kind: [(s, b) for s, b in bits.items() if s & kind] for kind in set(kinds)}
    least, open_ = [0.0], {}
    for end, kind in enumerate(kinds, 1):
        new = least[-1] + _NEXT
        open_ = {s: min(open_.get(s, math.inf), new) + b for s, b in using[kind]}
        least.append(min([*open_.values(), *[least[start] + _NEXT + cost for start, cost in ends.get(end, ())]]))
    return least[-1]


def find_spans(text: str, ranks: dict[str, int], least_bits: float) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans, in order."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        for m in _CONTEXT.finditer(text):
            group = m.lastindex
            if secret_bits(m[group], ranks) >= least_bits:
                spans.append((m.start(group), 3, m.end(group)))
    if "://" in text:
        for m in _USERINFO.finditer(text):
            if secret_bits(m[1], ranks) >= least_bits:
                spans.append((m.start(1), 3, m.end(1)))
    return sorted(set(spans))


_PROSE = re.compile(r"[a-z]{4,24}")
#: Words that a task counts before it passes the counts on.
_HELD = 1 << 18


def _prose(text: str) -> str:
    """The text in small letters without values in credential contexts and spans of fixed shape: a secret that is copied often must not
    become a common word."""
    cuts = []
    low = text.lower()
    if any(w in low for w in _CONTEXT_WORDS):
        cuts += [m.span(m.lastindex) for m in _CONTEXT.finditer(text)]
    if any(w in low for w in _ASSIGN_WORDS):
        cuts += [m.span(2) for m in _ASSIGN.finditer(text)]
    if "://" in text:
        cuts += [m.span(1) for m in _USERINFO.finditer(text)]
    if not cuts:
        return low
    out, end = [], 0
    for a, b in sorted(cuts):
        if b > end:
            out.append(text[end : max(a, end)])
            end = b
    return "\n".join([*out, text[end:]]).lower()


def common_words(docs: DataFrame, most: int, least: int, text_col: str = "text") -> list[str]:
    """The ``most`` most frequent words of all texts (4 to 24 letters a-z, lower-cased) that occur ``least`` times or more, the most frequent
    first, equally frequent ones by letters. Tasks count, one group-by adds the counts up, and ranges of counts tell which words are in the list; only
    the list comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for text in batch["text"]:
                seen.update(_PROSE.findall(_prose(text.as_py() or "")))
                if len(seen) > _HELD:
                    yield out()
        yield out()

    parts = docs.select(ref(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    counts = saved(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select((-F.col("n")).alias("less"), "word"))
    return [r["word"] for r in sorted(ranked_between(counts, ["less", "word"], 0, most).collect())]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(
    docs: DataFrame,
    words: tuple[str, ...] | list[str] = tuple(WORDS),
    least_bits: float = 40.0,
    corpus_words: int = 20_000,
    least_count: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per row of ``docs``: the id, n_assign, n_access, n_hex, n_guess, base_sha256 (digest of the base spans), spans (all of them).

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind, comma-joined. The base kinds ``assign``,
    ``access`` and ``hex`` have fixed shapes. ``guess`` is a value in a credential context (after a word such as password, quoted or bare, or
    before the @ of a URL) of at least 6 characters that needs 2^``least_bits`` guesses or more. A guesser knows ``words`` and the ``corpus_words`` most frequent
    words of all texts (those with ``least_count`` occurrences or more; 0: none) by rank, with capitals and look-alike digits, dates, repeats and
    keyboard walks, and pays for the rest by the classes of characters in it; so ``password=Welcome2024`` is no secret, a random value is. A word in both
    lists has its better rank. What stands in credential contexts does not count as a word of the texts.

    Null and empty texts have no spans: counts 0, ``spans`` empty, the digest that of the empty string. One pass counts the words, one finds the
    spans where the text is, in time linear in its length; rows keep their number, and other columns are not looked at.
    """
    ranks = {w: k + 1 for k, w in reversed(list(enumerate(words)))}
    for k, w in enumerate(common_words(docs, corpus_words, least_count, text_col) if corpus_words else ()):
        ranks[w] = min(k + 1, ranks.get(w, k + 1))

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows: list[dict] = []
            for text in batch:
                spans = find_spans(text.as_py() or "", ranks, least_bits)
                base = _joined([s for s in spans if s[1] < 3])
                counts = {f"n_{k}": sum(s[1] == n for s in spans) for n, k in enumerate(KINDS)}
                rows.append({**counts, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": _joined(spans)})
            yield pa.array(rows, kind)

    kind = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    names = [f.name for f in kind]
    schema = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in kind)
    found: Column = F.arrow_udf(make, schema)(ref(text_col).cast("string"))
    out = docs.select(ref(id_col).alias(id_col), found.alias("__found"))
    return out.select(ref(id_col), *[F.col("__found")[n].alias(n) for n in names])
