"""Problem 6: the token ids of every text in a public vocabulary, and back.

Method: a global shuffle of distinct words. Texts are cut into pre-tokens with their positions; the pre-tokens of a
*packet* (texts of about a million characters) are kept as numbers, so that a word leaves a packet once however often it
stands there. Each distinct word of the corpus is then encoded once, its ids are joined back to the packets, and texts
are put together again by position. A word that stands in very many packets is salted by packet. Decoding joins the
distinct ids of a packet with the table of the tokens' bytes (as many rows as the vocabulary, whatever the input).

Vocabularies are read from rank files (a base64 token and its rank in a line); the path is a parameter.

Cases: a null or empty text has the empty list; blank texts are encoded as they are; the strings of special tokens are
ordinary text; repeated rows come out as often as they stand in the table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import Saved

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKET = 1 << 20  # characters, about
HOT = 100_000  # rows of a word in a task
BLOCK = 4096  # rows of ids in a packet
_encoders: dict[tuple[str, str], object] = {}


def rank_path(name: str = RANKS, folder: str = FOLDER) -> str:
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(path: str, pattern: str = PATTERN):
    """The encoder of a rank file, made once in a process."""
    if (path, pattern) not in _encoders:
        import tiktoken

        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encoders[path, pattern]


def packets(df: DataFrame, id_col: str, text_col: str, pattern: str = PATTERN) -> DataFrame:
    """(packet bigint, id bigint, codes binary, words array<string>): a row for each text, with the numbers of its words
    in their order, and one for each packet, with the words by number."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                number: dict[str, int] = {}
                codes, size, j = [], 0, i
                while j < len(texts) and (j == i or size < PACKET):
                    t = texts[j] or ""
                    codes.append(np.array([number.setdefault(w, len(number)) for w in split(t)], np.int32).tobytes())
                    size += len(t)
                    j += 1
                n = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (n + 1), pa.int64()),
                        pa.concat_arrays([ids.slice(i, n), pa.array([None], pa.int64())]),
                        pa.array([*codes, None], pa.binary()),
                        pa.array([*[None] * n, list(number)], pa.list_(pa.string())),
                    ],
                    ["packet", "id", "codes", "words"],
                )
                name += 1
                i = j

    cols = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(part, "packet bigint, id bigint, codes binary, words array<string>")


def _joined(words: DataFrame, known: DataFrame, packets: int, hot: int) -> DataFrame:
    """words (packet, n, word) with the ids of known (word, ids). A word leaves a packet once, so no word has more rows than
    there are packets; beyond ``hot`` of them words are salted by packet: first each (word, salt) gets its ids, a row for
    each salt, then each packet gets them from there, so that a word in all packets has ``hot`` rows in a task, about."""
    salts = -(-packets // hot)
    if salts < 2:
        return words.join(known, "word")
    salted = words.withColumn("salt", F.pmod(F.xxhash64("packet"), F.lit(salts)))
    return salted.join(salted.select("word", "salt").distinct().join(known, "word"), ["word", "salt"])


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str = PATTERN, hot: int = HOT) -> DataFrame:
    """(id, ids array<int>) of every row."""
    at = path or rank_path()
    rows = Saved(packets(df, id_col, text_col, pattern))
    words = rows.df.filter("words is not null").select("packet", F.posexplode("words").alias("n", "word"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(at, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(e(w), np.int32).tobytes() for w in b.column(0).to_pylist()], pa.binary())], ["word", "ids"])

    known = words.select("word").distinct().mapInArrow(once, "word string, ids binary")
    found = _joined(words, known, rows.df.filter("words is not null").count(), hot).select("packet", "n", "ids")

    def together(texts: pa.Table, ids: pa.Table) -> pa.Table:
        flat, ends = _gathered(texts, ids.column("n").to_numpy(), ids.column("ids"), np.int32)
        return pa.table({"id": texts.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))})

    texts = rows.df.filter("codes is not null").select("packet", "id", "codes")
    return texts.groupBy("packet").cogroup(found.groupBy("packet")).applyInArrow(together, "id bigint, ids array<int>")


def _gathered(rows: pa.Table, n: np.ndarray, pieces: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The pieces (binary, numbered by n) that the codes of each row name, one after another, and where each row ends."""
    raw = pieces.combine_chunks().take(pa.array(np.argsort(n))).to_pylist() if len(n) else []
    wide = np.dtype(kind).itemsize
    size = np.array([len(x) // wide for x in raw], np.int64)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(raw), kind)
    codes = rows.column("codes").to_pylist()
    count = np.array([len(c) // 4 for c in codes], np.int64)
    code = np.frombuffer(b"".join(codes), np.int32)
    m = size[code]
    take = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[code], m)
    return flat[take], np.r_[0, np.cumsum(m)][np.r_[0, np.cumsum(count)]]


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(token int, piece binary): the tokens' bytes, as many rows as the vocabulary has."""
    ranks = read_ranks(path)
    return spark.createDataFrame(pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())}))


def decode(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """(id, text) of token ids; a null list gives a null text. Bytes that are no UTF-8 become replacement characters, and an
    id that the vocabulary has not is an error.

    The distinct ids of a packet of rows are joined with the table of the tokens' bytes, which is broadcast as the
    vocabulary bounds it, and the rows are put together again by position."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                b = batch.slice(i, BLOCK)
                lists = b.column(1)
                size = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
                if lists.flatten().null_count:
                    raise ValueError("a list of token ids holds a null")
                tokens, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                edge = np.r_[0, np.cumsum(size)]
                code = code.astype(np.int32)
                codes = [code[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])]
                n = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (n + 1), pa.int64()),
                        pa.concat_arrays([b.column(0), pa.array([None], pa.int64())]),
                        pa.array([*codes, None], pa.binary()),
                        pa.array([*[None] * n, tokens.tolist()], pa.list_(pa.int32())),
                    ],
                    ["packet", "id", "codes", "tokens"],
                )
                name += 1

    def together(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        if len(pieces) and pieces.column("piece").null_count:
            raise ValueError("a token id is not in the vocabulary")
        flat, ends = _gathered(rows, pieces.column("n").to_numpy(), pieces.column("piece"), np.uint8)
        data = flat.tobytes()
        return pa.table({"id": rows.column("id"), "text": pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])], pa.string())})

    cols = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    rows = Saved(cols.filter("ids is not null").mapInArrow(cut, "packet bigint, id bigint, codes binary, tokens array<int>"))
    used = rows.df.filter("tokens is not null").select("packet", F.posexplode("tokens").alias("n", "token"))
    pieces = used.join(F.broadcast(token_table(df.sparkSession, path or rank_path())), "token", "left").select("packet", "n", "piece")
    lists = rows.df.filter("codes is not null").select("packet", "id", "codes")
    found = lists.groupBy("packet").cogroup(pieces.groupBy("packet")).applyInArrow(together, "id bigint, text string")
    return found.unionByName(cols.filter("ids is null").select("id", F.lit(None).cast("string").alias("text")))
