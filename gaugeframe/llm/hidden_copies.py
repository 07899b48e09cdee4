"""Problem 2: records that are the same but for white space, case, punctuation or the order of flattened fields.

Method: progressive partition refinement. The first key of a record is cheap and does not depend on the order of its
parts: the number of its letters and digits and a hash of their histogram, with the label's. Only records in classes of
several members (found through a bit set of the crowded keys, at most 32 MB) get the costly keys: the letters and
digits in order, and, for flattened records, the sorted names and values.

Notations of flattened records: a JSON object, or ``name<assign>value`` parts with ``:`` or ``=`` that are parted by
line ends, ``|``, ``;``, ``,``, ``&`` or tabs; the first part begins the text and there are two or more.

Cases: null, empty and short texts (under ``min_words``) are never copies; null and blank labels are the same label;
repeated ids count once; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import sketches
from gaugeframe.llm.shingles import LIMIT, MIN_WORDS, U, mix, slices, words
from gaugeframe.sources.scratch import Saved

_tables: dict[str, np.ndarray] = {}
MARKER = re.compile(r"(?:^[\s\"'(\[{>*]*|[\n|;,&\t][\s\"'>*-]*)([^\W\d_][\w -]{0,30}?)[\s\"'*]*([:=])(?!//)")
BREAKS = {"\n", "|", ";", ",", "&", "\t"}


def _histogram_hashes() -> np.ndarray:
    if "fold" not in _tables:
        out = np.zeros(LIMIT + 1, U)
        one = mix(np.arange(LIMIT + 1, dtype=U) + U(0x77777))
        for c in range(LIMIT):
            ch = chr(c)
            if ch.isalnum():
                out[c] = sum(int(one[ord(x)]) for x in ch.casefold() if x.isalnum()) & (2**64 - 1)
        _tables["fold"] = out
    return _tables["fold"]


def plain(text: str | None) -> str:
    return "".join(c for c in (text or "").casefold() if c.isalnum())


def unescaped(text: str) -> str:
    """A JSON object with escapes as its names and values; other texts as they are."""
    if "\\" in text and text.lstrip()[:1] == "{":
        try:
            got = json.loads(text, strict=False)
        except ValueError:
            return text
        if isinstance(got, dict):
            return " ".join(f"{k} {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in got.items())
    return text


def fields(text: str) -> list[tuple[str, str]] | None:
    """Sorted (name, value) of a flattened record, letters and digits only; None for other texts."""
    if "{" in text[:8]:
        try:
            got = json.loads(text, strict=False)
            if isinstance(got, dict) and len(got) > 1:
                return sorted((plain(str(k)), plain(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))) for k, v in got.items())
        except ValueError:
            pass
    marks = list(MARKER.finditer(text))
    if len(marks) < 2 or marks[0].start() or marks[0].group(0)[:1] in BREAKS - {"\n", "\t"}:
        return None
    assign = marks[0].group(2)
    marks = [m for m in marks if m.group(2) == assign]
    if len(marks) < 2:
        return None
    # the break before the second part is the one that counts; others belong to the values
    kind = next((c for c in marks[1].group(0) if c in BREAKS), None)
    marks = [m for k, m in enumerate(marks) if k == 0 or m.group(0).lstrip(" ")[:1] == kind or kind == "\n" and "\n" in m.group(0)]
    if len(marks) < 2:
        return None
    return sorted((plain(m.group(1)), plain(text[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(text)])) for k, m in enumerate(marks))


def cheap(texts: list[str | None], labels: list[str | None], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first key, whether the text has enough words) of each record of a batch."""
    kept = [unescaped(t) if t else "" for t in texts]
    n = np.fromiter(map(len, kept), np.int64, len(kept))
    cp = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), "<u4")
    h = _histogram_hashes()[np.minimum(cp, LIMIT)]
    ends = np.cumsum(n)
    sums = np.r_[U(0), np.cumsum(h)]
    many = np.r_[0, np.cumsum(h != 0)]
    hist, size = sums[ends] - sums[ends - n], many[ends] - many[ends - n]
    of: dict[str | None, int] = {}
    label = np.array([of[x] if x in of else of.setdefault(x, xxhash.xxh64_intdigest(plain(x))) for x in labels], U)
    return mix(hist + size.astype(U) * U(0x9E3779B97F4A7C15)) ^ label, words(texts).count >= min_words


def keyed(df: DataFrame, id_col: str, text_col: str, label_col: str, min_words: int) -> DataFrame:
    """(id, label binary, in_order binary, by_field binary or null) of the records in crowded classes."""
    cols = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            key, enough = cheap(b.column(1).to_pylist(), b.column(2).to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(enough)), pa.array(key[enough].view(np.int64))], ["id", "key"])

    crowded = Saved(cols.mapInArrow(first, "id bigint, key bigint").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    seen = sketches.bits(crowded.df, lambda b: b.column(0).to_numpy().view(U), sketches.size_for(crowded.df.count()))
    wanted = df.sparkSession.sparkContext.broadcast(seen)

    def costly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            key, enough = cheap(texts, labels, min_words)
            at = np.flatnonzero(enough & sketches.has(wanted.value, key))
            digest = xxhash.xxh3_128_digest
            got = [fields(texts[i]) for i in at]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)),
                    pa.array([digest(plain(labels[i])) for i in at], pa.binary()),
                    pa.array([digest(plain(texts[i])) for i in at], pa.binary()),
                    pa.array([digest("\x01".join("\x00".join(f) for f in g)) if g else None for g in got], pa.binary()),
                ],
                ["id", "label", "in_order", "by_field"],
            )

    return cols.mapInArrow(costly, "id bigint, label binary, in_order binary, by_field binary").distinct()


def _classes(df: DataFrame, id_col: str, text_col: str, label_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    rows = Saved(keyed(df, id_col, text_col, label_col, min_words)).df
    # a text in the same order as a flattened record is the same record, also where its fields can't be told any more
    record = rows.groupBy("label", "in_order").agg(F.min("by_field").alias("record"))
    rows = Saved(rows.join(record, ["label", "in_order"]).select("id", "label", F.coalesce("record", "in_order").alias("key"))).df
    first = rows.groupBy("label", "key").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("copies")).filter("copies > 1")
    return rows, first


def found(df: DataFrame, id_col: str, text_col: str, label_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(first_id, id) of every copy but the first of each class."""
    rows, first = _classes(df, id_col, text_col, label_col, min_words)
    return rows.join(first, ["label", "key"]).filter("id > first_id").select("first_id", "id").distinct()


def collapsed(df: DataFrame, id_col: str, text_col: str, label_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, copies): one row for each different record, with the number of its copies; short texts stand for themselves."""
    rows, first = _classes(df, id_col, text_col, label_col, min_words)
    later = rows.join(first, ["label", "key"]).filter("id > first_id").select("id").distinct()
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    return ids.join(later, "id", "left_anti").join(first.select(F.col("first_id").alias("id"), "copies"), "id", "left").select("id", F.coalesce("copies", F.lit(1)).alias("copies"))
