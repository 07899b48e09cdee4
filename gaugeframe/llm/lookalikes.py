"""Problem 8: one consistent form for texts that look the same but differ in their characters.

Method: classes of look-alike strings and code points by union-find, each with its most frequent member in the corpus
as representative, and greedy rewriting by a multi-pattern automaton (longest match first). The relation is made of

* full-width, half-width and non-breaking forms, letter ligatures, and all blanks of category Zs,
* precomposed letters and their sequences of a letter and combining marks, also where the letter is itself a look-alike,
* look-alike letters of other scripts (the fixed list below) and hyphens,
* invisible characters (category Cf, variation selectors and fillers), which go away.

Raised, fractional and abbreviated signs stay as they are, as do letter case and accents. A joiner stays between emoji,
where it changes the picture, and in scripts whose letters it shapes; so does a variation selector after a symbol.

Cases: a null text has a null form; texts without a visible character are in no pair; copies (the same characters) are
no pair; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import sketches
from gaugeframe.llm.shingles import slices
from gaugeframe.sources.scratch import Saved

#: Letters of other scripts and the Latin letters that they look like, in the same order.
LOOKALIKES = (
    ("АВЕКМНОРСТХЅІЈӀԚԜ", "ABEKMHOPCTXSIJIQW"),  # Cyrillic capitals
    ("аеорсухѕіјһԁԛԝӏѵ", "aeopcyxsijhdqwlv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("οϲϳν", "ocjv"),  # Greek small letters
    ("ՕՍօսհց", "OUouhg"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ɑɡ", "ag"),  # letters of phonetic script
    ("‐‑", "--"),  # hyphens
)
#: Invisible characters outside category Cf.
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"
JOINERS = "‌‍"

_automata: dict[int, object] = {}


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, x: str, y: str) -> None:
        a, b = sorted((self.root(x), self.root(y)))
        self.up[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.root(x), []).append(x)
        return out


def invisible(c: str) -> bool:
    if c in FILLERS or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return True
    # signs of category Cf that are drawn: Arabic and Syriac number signs, Kaithi signs
    return unicodedata.category(c) == "Cf" and not ("؀" <= c <= "؅" or c in "۝܏࢐࢑࣢\U000110bd\U000110cd")


def same_form(c: str) -> str:
    """The ordinary form of a full-width, half-width or non-breaking character, a ligature or a blank; else itself."""
    if unicodedata.category(c) == "Zs":
        return " "
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<narrow>", "<noBreak>") or kind == "<compat>" and "LIGATURE" in unicodedata.name(c, "") and unicodedata.category(c)[0] == "L":
        return unicodedata.normalize("NFKC", c)
    return c


def confusables(path: str) -> list[tuple[str, str]]:
    """Look-alike letters from a public table (lines ``code points ; code points ; kind # comment``, in hexadecimal): pairs
    of single letters of the same case and of different scripts; digits, signs and strings in it are left out."""
    out = []
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            parts = [x.split() for x in line.split("#")[0].split(";")]
            if len(parts) < 2 or len(parts[0]) != 1 or len(parts[1]) != 1:
                continue
            x, y = (chr(int(p[0], 16)) for p in parts[:2])
            kinds, scripts = ([f(c) for c in (x, y)] for f in (unicodedata.category, lambda c: unicodedata.name(c, "").split(" ")[0]))
            if kinds[0] == kinds[1] and kinds[0][0] == "L" and all(scripts) and scripts[0] != scripts[1]:
                out.append((x, y))
    return out


def rewrites(count: np.ndarray, more: list[tuple[str, str]] | None = None) -> dict[str, str]:
    """String -> representative, for what the corpus may hold. count: occurrences by code point, of the whole corpus; more:
    further look-alike letters (``confusables``)."""
    seen = {chr(i) for i in np.flatnonzero(count) if not 0xD800 <= i < 0xE000}
    classes = Classes()
    for c in seen:
        if (s := same_form(c)) != c:
            classes.tie(c, s)
    for other, latin in LOOKALIKES:
        for x, y in zip(other, latin):
            if x in seen:
                classes.tie(x, y)
    for x, y in more or ():
        if x in seen or y in seen:
            classes.tie(x, y)
    singles = {x: [m for m in ms if len(m) == 1] for ms in classes.members().values() for x in ms if len(x) == 1}
    # letters with marks: all spellings by look-alike letters and marks are one class
    marks = {c for c in seen if unicodedata.combining(c)}
    letters = set(seen) | set(singles)
    for i in range(0xC0, 0x30000):
        c = chr(i)
        d = unicodedata.normalize("NFD", c)
        if len(d) < 2 or 0xAC00 <= i < 0xD7A4 or unicodedata.decomposition(c).startswith("<"):
            continue
        if c in seen or d[0] in letters and all(m in marks for m in d[1:]):
            classes.tie(c, d)
            for base in singles.get(d[0], ()):
                classes.tie(c, base + d[1:])
                composed = unicodedata.normalize("NFC", base + d[1:])
                if composed != base + d[1:]:
                    classes.tie(c, composed)

    def often(s: str) -> tuple:
        # the rarest character of a string bounds how often it occurs; ties: single characters, then code order
        return min(int(count[ord(x)]) for x in s), -len(s), tuple(-ord(x) for x in s)

    out = {}
    for ms in classes.members().values():
        single = [m for m in ms if len(m) == 1 and m != "" and same_form(m) == m] or ms
        best = max(single, key=often)
        out.update({m: best for m in ms if m != best})
    out.update({c: "" for c in seen if invisible(c)})
    return out


def _stays(text: str, i: int) -> bool:
    """Whether the invisible character at i changes how the text looks."""
    c, before, after = text[i], text[i - 1 : i], text[i + 1 : i + 2]
    if c in JOINERS:
        if not before or not after:
            return False
        picture = lambda x: unicodedata.category(x) in ("So", "Sk") or x == "️"
        if c == "‍" and picture(before) and picture(after):
            return True
        return unicodedata.name(before, "").split(" ")[0] in ("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "GUJARATI", "GURMUKHI", "SINHALA", "ORIYA", "KHMER", "MONGOLIAN")
    return c == "️" and bool(before) and unicodedata.category(before) in ("So", "Sk")


def automaton(rules: dict[str, str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for x, y in rules.items():
        a.add_word(x, (len(x), y))
    if rules:
        a.make_automaton()
    return a


def rewrite(text: str, a) -> str:
    """Greedy, leftmost and longest first, until nothing changes: what an invisible character parted comes together.

    A round makes the text shorter, or turns characters into representatives, which stay; so there is an end."""
    seen = {text}
    while True:
        out, at = [], 0
        for end, (n, new) in a.iter_long(text):
            start = end - n + 1
            if not new and _stays(text, start):
                continue
            out += text[at:start], new
            at = end + 1
        if not out:
            return text
        now = unicodedata.normalize("NFC", "".join(out) + text[at:])
        if now == text:
            return now
        if now in seen:  # should composition undo a rewrite, the least form of the round counts
            return min(now, text)
        seen.add(now)
        text = now


def rules_for(df: DataFrame, text_col: str, table: str | None = None) -> dict[str, str]:
    """The rewrites for a corpus. table: the path of a public table of look-alike characters (see ``confusables``)."""

    def points(b: pa.RecordBatch) -> np.ndarray:
        text = "".join(unicodedata.normalize("NFC", t) + t for t in b.column(0).to_pylist() if t)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)

    count = sketches.counts(df.select(F.col(text_col).cast("string")), points, 0x110000)
    return rewrites(count, confusables(table) if table else None) if len(count) else {}


def canonical(df: DataFrame, id_col: str, text_col: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(id, form string, form_key binary, text_key binary, visible boolean) of every row."""
    rules = rules_for(df, text_col) if rules is None else rules
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shared.value)
        touched = set("".join(shared.value))
        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            forms = []
            for t in texts:
                if t and not t.isascii():
                    t = unicodedata.normalize("NFC", t)
                forms.append(rewrite(t, a) if t and shared.value and not touched.isdisjoint(t) else t)
            seen = [bool(f) and any(unicodedata.category(c)[0] not in "ZC" for c in f) for f in forms]
            key = lambda xs: pa.array([None if x is None else digest(x.encode("utf-8", "surrogatepass")) for x in xs], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), key(forms), key(texts), pa.array(seen)], ["id", "form", "form_key", "text_key", "visible"])

    cols = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(part, "id bigint, form string, form_key binary, text_key binary, visible boolean")


def pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b; a < b): rows whose texts look the same but are not the same characters.

    Forms of several texts are found among the distinct texts; their texts are paired as classes, and only then come the
    rows of both, so copies of one text are never compared with each other."""
    rows = Saved(canonical(df, id_col, text_col).filter("visible").select("id", "form_key", "text_key").distinct()).df
    texts = rows.select("form_key", "text_key").distinct()
    mixed = texts.groupBy("form_key").agg(F.count("*").alias("n")).filter("n > 1").select("form_key")
    some = Saved(texts.join(mixed, "form_key")).df
    unlike = some.withColumnRenamed("text_key", "text_a").join(some.withColumnRenamed("text_key", "text_b"), "form_key").filter("text_a < text_b").select("text_a", "text_b")
    a, b = (rows.select(F.col("id").alias(f"row_{x}"), F.col("text_key").alias(f"text_{x}")) for x in "ab")
    found = unlike.join(a, "text_a").join(b, "text_b").filter("row_a <> row_b")
    return found.select(F.least("row_a", "row_b").alias("id_a"), F.greatest("row_a", "row_b").alias("id_b")).distinct()
