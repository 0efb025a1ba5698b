"""Operator 8: personal data with offset-preserving deobfuscation.

Base spans are found in the text as it is. Every text also goes through transducers that write a normalised text and, for
each of its characters, the span of the source that it stands for: invisible characters go, homoglyphs become the ASCII
character they look like, runs of spelled digits become digits, and disguised at and dot signs, in addresses and in
numbers, become @ and full stops. What is detected there is mapped back to the source, and kept if it rests on a disguise.

All searches take time in proportion to the text: those that begin with a run of characters are made from the sign that
ends it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

KINDS = ("email", "ip", "card", "phone")
#: An address from its at sign on, and, in the reversed text, the name before the sign.
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Characters that look like an ASCII character, beyond those that compatibility normalisation maps (fixed values).
LOOK = dict(zip("аеорсухіјѕԁһԛԝβοορνΑΒΕΗΙΚΜΝΟΡΤΧАВЕКМНОРСТХ", "aeopcyxijsdhqwbooopvABEHIKMNOPTXABEKMHOPCTX"))
LOOK |= {"‐": "-", "‑": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "﹒": ".", "﹫": "@"}
#: Characters that take no place: soft hyphen, zero-width spaces and joiners, byte order mark (fixed values).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
ODD = re.compile(rf"[^\x00-\xff]|[²³¹·{INVISIBLE}]")
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT = "|".join(SPELLED)
RUN = re.compile(rf"(?i)(?:\bplus[\s-]+)?\b(?:{DIGIT})(?:[\s,.-]+(?:{DIGIT}))" r"{5,}\b")
#: A disguised address: a name, an at sign in brackets or as a word, and at least one dot sign, one of them disguised.
AT = r"\s*(?:[\[({<]\s*(?:at|@)\s*[\])}>]|\s[aA][tT]\s|@)\s*"
DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
TOD = r"(?:\s*[\])}>]\s*(?:tod|\.)\s*[\[({<]\s*|\s+tod\s+|\.)"  # DOT, reversed
#: After a bare "at" or a spaced @, something like 3.50 or v1.2 is no domain.
DOMAIN = rf"(?!\s*[A-Za-z0-9-]+(?:\.[0-9-][A-Za-z0-9-]*)+(?![A-Za-z0-9-]|{DOT}[A-Za-z0-9-]))"
MEANT = rf"(?:[\[({{<]\s*(?:at|@)\s*[\])}}>]|(?<!\s)@(?!\s)|(?:\sat\s|@){DOMAIN})\s*"
ADDRESS = re.compile(rf"(?i){MEANT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]+)+")
NAME = re.compile(rf"(?i)\s*[A-Za-z0-9_%+-]++(?:{TOD}[A-Za-z0-9_%+-]++)*")
AT_SIGN, DOT_SIGN = re.compile(rf"(?i){AT}"), re.compile(rf"(?i){DOT}")
#: Four numbers with dot signs between them, some disguised.
NUMBERS = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [x.lstrip("0") for x in found.split(".")]
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in parts)
    digits = re.sub(r"[^0-9]", "", found)
    return (13 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple]:
    """(start, end) of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and without overlaps: from each at
    sign back to where the run before it begins or the last address ends, whichever comes later."""
    out, done, back, n = [], 0, text[::-1], len(text)
    for m in HOST.finditer(text):
        run = LOCAL.match(back, n - m.start(), n - done)
        if run:
            out.append((m.start() - len(run[0]), m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple]:
    """(kind number, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for i, kind in enumerate(KINDS[1:], 1):
            if kind != "phone" or "+" in text:
                out += [(i, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return out


@lru_cache(1 << 16)
def _plain(c: str) -> str:
    import unicodedata

    if c in INVISIBLE:
        return ""
    if c in LOOK:
        return LOOK[c]
    d = unicodedata.normalize("NFKC", c)
    if len(d) == 1 and d.isascii():
        return d
    return str(unicodedata.decimal(c)) if c.isdecimal() else c


def addresses(plain: str) -> list[tuple]:
    """(start, end) of disguised addresses: from each at sign forward over the domain and back over the name."""
    out, done, back, n = [], 0, None, len(plain)
    for m in ADDRESS.finditer(plain):
        back = plain[::-1] if back is None else back
        name = NAME.match(back, n - m.start(), n - done)
        if name:
            out.append((m.start() - len(name[0]), m.end()))
            done = m.end()
    return out


def normalised(text: str):
    """(normalised text, start and end in the source of what each of its characters stands for, disguised places in
    order)."""
    marks: set[int] = set()
    where = None  # places of the characters of `plain` in the source, if some are gone
    plain = text
    if not text.isascii():
        edits = [(m.start(), p) for m in ODD.finditer(text) if (p := _plain(m[0])) != m[0]]
        if edits:
            shown = list(text)
            for s, p in edits:
                shown[s] = p
                marks.add(s)
            if any(not p for _, p in edits):
                where = [i for i, c in enumerate(shown) if c]
            plain = "".join(shown)
    spans = [(m.start(), m.end(), "digits") for m in RUN.finditer(plain)]
    spans += [(a, b, "address") for a, b in addresses(plain)]
    spans += [(m.start(), m.end(), "numbers") for m in NUMBERS.finditer(plain)]
    source = (lambda i: i) if where is None else where.__getitem__
    out, starts, ends = [], [], []

    def copy(a, b):
        out.append(plain[a:b])
        starts.extend(range(a, b) if where is None else where[a:b])
        ends.extend(range(a + 1, b + 1) if where is None else [i + 1 for i in where[a:b]])

    def put(c, a, b):
        out.append(c)
        starts.append(source(a))
        ends.append(source(b - 1) + 1)
        if plain[a:b] != c:
            marks.add(source(a))

    done = 0
    for a, b, kind in sorted(spans):
        if a < done:
            continue
        copy(done, a)
        if kind == "digits":
            found = list(re.finditer(rf"(?i)plus|{DIGIT}", plain[a:b]))
            digits = [SPELLED.get(m[0].lower(), "+") for m in found]
            said = digits[0] == "+"
            if not said and 9 <= len(digits) <= 15 and not (len(digits) >= 13 and luhn("".join(digits))):
                put("+", a, a + found[0].end())  # nobody spells out a number of that length but to be called
            for c, m in zip(digits, found):
                put(c, a + m.start(), a + m.end())
        else:
            at = a
            signs = [] if kind == "numbers" else [(m.start(), m.end(), "@") for m in AT_SIGN.finditer(plain, a, b)]
            signs += [(m.start(), m.end(), ".") for m in DOT_SIGN.finditer(plain, a, b)]
            for s, e, c in sorted(signs):
                if s >= at:
                    copy(at, s)
                    put(c, s, e)
                    at = e
            copy(at, b)
        done = b
    copy(done, len(plain))
    return "".join(out), starts, ends, sorted(marks)


def disguised_spans(text: str, base: list[tuple]) -> list[tuple]:
    """Spans that only the normalised text shows, as source spans that touch a disguise and lie in no base span of their kind."""
    plain, starts, ends, marks = normalised(text)
    if not marks:
        return []
    taken = {k: ([s for i, s, _ in base if i == k], [e for i, _, e in base if i == k]) for k in range(len(KINDS))}
    out = []
    for kind, s, e in base_spans(plain):
        a, b = starts[s], ends[e - 1]
        i = bisect_left(marks, a)
        if i < len(marks) and marks[i] < b:
            begins, stops = taken[kind]
            j = bisect_right(begins, a) - 1
            if j < 0 or stops[j] < b:
                out.append((kind, a, b))
    return out


def _scan():
    import hashlib

    def written(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def step(batch):
        out: dict[str, list] = {c: [] for c in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            base = base_spans(text or "")
            more = disguised_spans(text or "", base)
            numbers = [0] * len(KINDS)
            for k, _, _ in base:
                numbers[k] += 1
            row = (doc, *numbers, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more))
            for c, x in zip(out, row):
                out[c].append(x)
        return out

    return step


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (base and disguised ones), n_disguised.

    Null and empty texts have no spans (base_sha256 is that of an empty string); very long ones are read whole. Spans of
    different kinds may overlap and are all reported. Other columns are ignored, whatever their names; repeated rows are
    scanned each; an empty table gives no rows.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], schema, _scan)


def masked(text: str | None) -> str | None:
    """The text with each span, base or disguised, replaced by its kind in capitals; overlapping spans by the first."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted((s, -e, k) for k, s, e in base + disguised_spans(text, base))
    if not spans:
        return text
    out, done, covered = [], 0, 0
    for s, e, k in spans:
        if s >= covered:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        covered = done = max(covered, -e)
    return "".join(out) + text[done:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars set to the new length; columns and their order are kept,
    whatever their names.

    Null and empty texts stay as they are, as does a null n_chars whose text is not changed; repeated rows are masked
    each; an empty table gives no rows.
    """
    names = docs.columns

    def make():
        def step(batch):
            import pyarrow as pa

            out = {c: batch.column(i) for i, c in enumerate(names)}
            texts = batch.column(names.index("text")).to_pylist()
            new = [masked(x) for x in texts]
            out["text"] = pa.array(new, pa.string())
            if "n_chars" in out:
                out["n_chars"] = [len(y) if y is not None and y is not x else n for x, y, n in zip(texts, new, out["n_chars"].to_pylist())]
            return out

        return step

    return per_batch(docs, names, docs._jdf.schema().toDDL(), make)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
