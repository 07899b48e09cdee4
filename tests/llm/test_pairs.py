import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import clusters, graph, near_duplicates, shingles, sketches, split_overlap, tiles
from gaugeframe.llm.classes import class_of, of_first
from gaugeframe.llm.shingles import words
from tests.llm import texts


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "sample_id bigint, text string").repartition(5)
    return df.withColumns({"id": F.lit("clash"), "cls": F.lit(None).cast("string"), "a": F.lit(1)}) if extra else df


def test_words_and_triples():
    got = ["It's ÜBER-fine, x2!", None, "", "_ _", "no", "a b c d e f g h i j k l m", "A B C d e f g h i j k l m"]
    w = shingles.words(got)
    assert list(w.count) == [len(texts.WORD.findall((t or "").lower())) for t in got]
    doc, t = shingles.triples(w)
    assert list(doc) == [5] * 11 + [6] * 11 and list(t[:11]) == list(t[11:])
    assert len(shingles.words([None, ""]).hash) == 0


def test_near_duplicates(spark):
    rows = texts.corpus()
    for extra in (False, True):
        got = near_duplicates.pairs(table(spark, rows, extra), "sample_id", "text", 0.5).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == texts.jaccard_pairs(rows, 0.5)


def test_pairs_that_only_meet_are_not_written(spark, monkeypatch):
    """150 texts of ten out of forty sentences meet each other in many of the 11,175 pairs, but none is similar."""
    rng, written = random.Random(10), []

    class Counted(near_duplicates.Saved):
        def __init__(self, df):
            super().__init__(df)
            if df.columns[:2] == ["a", "b"]:
                written.append(self.df.count())

    monkeypatch.setattr(near_duplicates, "Saved", Counted)
    some = [texts.sentence(rng, 6, 10**6) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(some, 10))) for i in range(150)]
    rows += [(150, rows[0][1] + " and more")]
    assert [tuple(r) for r in near_duplicates.pairs(table(spark, rows), "sample_id", "text", 0.5).collect()] == [(0, 150)]
    assert written and max(written) < 500


def test_cells_of_frequent_keys_lose_nothing(spark):
    rows = texts.corpus(2, 40)
    often = tiles.LIST

    def entries(b, times):
        doc, t, cls = class_of(b.column(0).to_pylist())
        doc, t = of_first(doc, t, cls)
        n = np.bincount(doc, minlength=len(cls))
        return tiles.Entries(cls[doc], t, n[doc], np.full(len(doc), 10**9), np.full(len(doc), times * often))

    df = table(spark, rows).select("text")
    cut, plain = ({tuple(r) for r in tiles.compare(tiles.emit(df, lambda b, k=k: entries(b, k), 5)).distinct().collect()} for k in (3, 1))
    assert cut == plain and plain


def test_levels(spark):
    rows = [(i, f"{'all ' * 9}{'half ' * 9 * (i % 2)}w{i} {'z ' * 9}") for i in range(512)]
    got = sketches.levels(table(spark, rows).select("text"), lambda b: words(b.column(0).to_pylist()).hash, 10)
    first = words(["all half w77"]).hash
    assert len(got.level) == 1 << 16 and got.total == 512 * 19 + 256 * 9
    assert list(got.of(first)) == [98, 90, 0]  # 8 * log2 of 4,608 and 2,304, and of 1, rounded up
    assert ((got.often(got.of(first)) / [4608, 2304, 1] >= 1) & (got.often(got.of(first)) / [4608, 2304, 1] < 1.1)).all()
    assert sketches.levels(table(spark, []).select("text"), lambda b: words(b.column(0).to_pylist()).hash, 1).total == 0


def test_reach_is_a_bound():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ({rng.randrange(40) for _ in range(rng.randrange(1, 40))} for _ in "ab")
        both = sorted(a & b)
        for least in (0.2, 0.5):
            if len(both) < least * len(a | b):
                continue
            for r, k in enumerate(both[:4], 1):
                for x, y in ((a, b), (b, a)):
                    place = np.array([sorted(x).index(k)])
                    n = np.array([len(x)])
                    assert len(y) <= tiles.similar_reach(n, place, least, r)[0]
                    assert r > 1 or tiles.prefix(n, place, least)[0]


def test_groups(spark):
    rows = texts.corpus(3)
    want = {x: (min(g), len(g)) for g in texts.groups(texts.jaccard_pairs(rows, 0.5)).values() for x in g}
    got = near_duplicates.groups(table(spark, rows), "sample_id", "text", 0.5).collect()
    assert {r.id: (r.group_id, r.group_size) for r in got} == want
    assert near_duplicates.groups(table(spark, []), "sample_id", "text").count() == 0


def test_many_copies(spark):
    rows = [(i, "the same text of more than twelve words stands in a third of all rows") for i in range(300)] + texts.corpus(4, 20)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert {tuple(r) for r in near_duplicates.pairs(table(spark, rows), "sample_id", "text", 0.5).collect()} == texts.jaccard_pairs(rows, 0.5)


@pytest.mark.parametrize("seed", [5, 6])
def test_linked(spark, seed):
    rows = texts.corpus(seed)
    want = {(r, x) for r, g in texts.groups(texts.jaccard_pairs(rows, 0.2)).items() if len(g) >= 10 for x in g if x != r}
    got = {tuple(r) for r in clusters.linked(table(spark, rows), "sample_id", "text").collect()}
    assert want and got == want


def test_a_cell_keeps_the_lists_of_its_part_only():
    """Texts of different minima: a task's memory falls with the number of parts, whatever its texts have in other bands."""
    rng, peak = np.random.default_rng(12), {}
    cls, m = rng.integers(2, 2**60, 20_000).astype(np.uint64), rng.integers(0, 2**16, (20_000, 12)).astype(np.uint16)
    for parts in (1, 40):
        blobs = [np.array([1000, 0], np.uint32).tobytes() + cls[i : i + 1000].tobytes() + m[i : i + 1000].tobytes() for i in range(0, 20_000, 1000)]
        batches = [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([x], pa.binary())], ["cell", "blob"]) for x in blobs]
        tracemalloc.start()
        assert sum(map(len, clusters._tied(iter(batches), parts, 4))) == 0
        peak[parts] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak[40] < peak[1] / 2


def test_pairs_are_counted_in_ranges(monkeypatch):
    """60,000 pairs of a part, those of even numbers four times: the same in one range in memory and in many from a file."""
    rng, parts, got = np.random.default_rng(13), 3, []
    a = rng.integers(2, 2**63, 120_000).astype(np.uint64)
    a = a[(shingles.mix(a) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == 1][:30_000]
    b = rng.integers(0, 2**40, len(a)).astype(np.uint64)
    blobs = []
    for k in range(4):
        x, y = (a, b) if k == 0 else (a[::2], b[::2])
        order = np.argsort(shingles.mix(x))
        short = np.ascontiguousarray(y[order]).view(np.uint8).reshape(-1, 8)[:, :5]
        blobs.append(pa.py_buffer(np.uint64(len(x)).tobytes() + x[order].tobytes() + np.ones(len(x), np.uint32).tobytes() + short.tobytes()))
    for kept, counted in ((1 << 26, 1 << 22), (200_000, 1000)):
        monkeypatch.setattr(tiles, "KEPT", kept)
        monkeypatch.setattr(tiles, "COUNTED", counted)
        runs = list(tiles._met(iter(blobs), 4, parts))
        assert max(len(x) for x, _ in runs) <= max(1000, counted)
        got.append(sorted((int(i), int(j)) for x, y in runs for i, j in zip(x, y)))
    assert got[0] == got[1] == sorted(zip(a[::2].tolist(), b[::2].tolist())) and len(runs) > 50


def test_pairs_are_packed_in_little_memory():
    rng = np.random.default_rng(14)
    pool = rng.integers(2, 2**63, 50_000).astype(np.uint64)
    tracemalloc.start()
    held = [tuple(pool[rng.integers(0, len(pool), 100_000)] for _ in "ab") for _ in range(10)]
    want = sorted({(a, b & tiles.SHORT) for x in held for a, b in zip(x[0].tolist(), x[1].tolist())})
    tracemalloc.reset_peak()
    size = tracemalloc.get_traced_memory()[0]
    batch = tiles._by_class(held, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and peak - size < 1.5 * 16_000_000  # besides the pairs as they come
    got = [p for x in batch.column(1) for a, b in tiles._met(iter([x.as_buffer()]), 1, 7) for p in zip(a.tolist(), b.tolist())]
    assert batch.num_rows == 7 and sorted(got) == want


def test_pairs_of_chance_are_ruled_out_where_they_meet():
    """300 sets of 60, of which 15 are frequent keys (they come last), share 4 of these with each other; five pairs have a
    similarity of 0.2 or more."""
    rng = random.Random(15)
    sets = [{*rng.sample(range(9000), 45), *rng.sample(range(9000, 9060), 15)} for _ in range(300)]
    for i in range(0, 10, 2):
        sets[i + 1] = {*rng.sample(sorted(sets[i]), 20 + i), *rng.sample(range(9060, 9100), 40 - i)}
    want = {(i, j) for i in range(300) for j in range(i) if 6 * len(sets[i] & sets[j]) >= len(sets[i]) + len(sets[j])}
    t, size = np.array([k for x in sets for k in sorted(x)]).astype(np.uint64), np.array([len(x) for x in sets])
    doc, place = np.repeat(np.arange(300), size), np.concatenate([np.arange(k) for k in size])
    keep = tiles.prefix(size[doc], place, 0.2)
    columns = [(2 * doc + 2).astype(np.uint64), t.astype(np.uint32), size[doc].astype(np.uint16), tiles.similar_reach(size[doc], place, 0.2).astype(np.uint16), *tiles.after(t, size).T]
    blob = pa.py_buffer(b"".join(np.ascontiguousarray(x[keep]).tobytes() for x in columns))
    got = [(int(j) // 2 - 1, int(i) // 2 - 1) for x, y in tiles._pairs([blob], False, [], 0.2) for i, j in zip(x, y)]
    met = sum(len(sets[i] & sets[j]) for i in range(300) for j in range(i))
    assert len(want) >= 5 and want <= set(got) and len(got) < met / 100


def test_linked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SPLIT", 60)
    test_linked(spark, 5)


def test_linked_where_counters_are_shared(spark, monkeypatch):
    """The plan for tables beyond the counters' largest number: each group of minima is written before the next one, lists are
    made in more turns, and no more pairs of sets are moved at once than the texts allow."""
    turns, moved = [], []
    together, verified = clusters._together, clusters.verified_sets
    monkeypatch.setattr(clusters, "SPLIT", 60)
    monkeypatch.setattr(clusters, "SHARED", 0)
    monkeypatch.setattr(clusters, "PAIRS", 0.1)
    monkeypatch.setattr(clusters, "_together", lambda every: turns.append(len(every)) or together(every))
    monkeypatch.setattr(clusters, "verified_sets", lambda sets, pairs: moved.append((pairs.count(), sets.count())) or verified(sets, pairs))
    test_linked(spark, 5)
    assert turns[0] == clusters.GROUPS and 2 * clusters.TURNS in turns
    assert len(moved) > 2 and all(n < 0.3 * texts for n, texts in moved)


def test_more_bits_where_the_order_is_of_chance():
    """Texts of 60 triples that have the first one in common and no other: with more bits far fewer of those that meet pass."""
    rng, passed = np.random.default_rng(15), {}
    sets = [np.r_[np.uint64(7), rng.choice(2**40, 59, replace=False).astype(np.uint64)] for _ in range(200)]
    doc, t, size = np.repeat(np.arange(200), 60), np.concatenate(sets), np.full(200, 60)
    place = np.tile(np.arange(60), 200)
    for bits in (192, 320):
        columns = [(2 * doc + 2).astype(np.uint64), t.astype(np.uint32), size[doc].astype(np.uint16), tiles.similar_reach(size[doc], place, 0.2).astype(np.uint16), *tiles.after(t, size, bits=bits).T]
        blob = pa.py_buffer(b"".join(np.ascontiguousarray(x).tobytes() for x in columns))
        passed[bits] = sum(len(a) for a, _ in tiles._pairs([blob], False, [], 0.2, bits))
    assert passed[320] < passed[192] / 4


def test_linked_by_weak_links_only(spark):
    """Chains of 12 texts, each with a similarity of 0.21 to the next one and none to the others."""
    rng, rows = random.Random(8), []
    for _ in range(6):
        words = texts.sentence(rng, 18, 10**6).split()
        for _ in range(12):
            words = words[-18:] + texts.sentence(rng, 30, 10**6).split()
            rows.append((len(rows), " ".join(words)))
    got = {tuple(r) for r in clusters.linked(table(spark, rows), "sample_id", "text").collect()}
    assert got == {(12 * (i // 12), i) for i in range(72) if i % 12}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 300), (300, 500)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 300: 300, 400: 300, 500: 300}


def test_split_overlap(spark):
    rows = texts.corpus(7)
    splits = ["train", "Training ", "train[:80%]", "test", " DEV ", "test[:500]", "eval", "extra", None, "unlabeled"]
    full = [(i, i % 4, splits[i % len(splits)], f"s{i % 3}", t) for i, t in rows]
    requests = [(0, "test"), (0, "test"), (1, None), (2, "VAL"), (3, "train")]
    df = spark.createDataFrame(full, "sample_id bigint, request_id bigint, split string, source string, text string").repartition(4)
    asked = spark.createDataFrame(requests, "request_id bigint, split string")
    of = dict(requests)

    def side(split, request):
        s = split if split is not None else of.get(request) or "train"
        s = s.split("[")[0].strip().lower()
        return 1 if s in split_overlap.TRAIN else 0 if s in split_overlap.EVALUATION else None

    sides = {r[0]: side(r[2], r[1]) for r in full}
    sets = {i: texts.triples(t) for i, t in rows}
    want = {(e, t) for e in sets for t in sets if sides[e] == 0 and sides[t] == 1 and sets[e] and len(sets[e] & sets[t]) >= 0.7 * len(sets[e]) - 1e-9}
    got = split_overlap.pairs(df, asked).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)
    share = {r.sample_id: r.overlap for r in split_overlap.fractions(df, asked).collect()}
    assert set(share) == {i for i in sets if sets[i] and sides[i] == 0}
    assert all(0 <= v <= 1 for v in share.values())
    copies = {e for e, t in want if sets[e] == sets[t] and dict(rows)[e].lower().strip("!") == dict(rows)[t].lower().strip("!")}
    assert copies and all(share[e] == 1 for e in copies)
    rep = split_overlap.report(df, asked).collect()
    assert sum(r.records for r in rep) == sum(s == 0 for s in sides.values())
    assert sum(r.overlapping for r in rep) == len({e for e, _ in want})
    part = split_overlap.shares(df, asked).collect()
    assert sum(r.records for r in part) == len(share) and sum(r.whole for r in part) == sum(v >= 1 for v in share.values())
    assert split_overlap.pairs(df.limit(0), asked).count() == 0


def test_split_overlap_of_short_texts(spark):
    """12 words of which the first 9 stand in training: 7 of 10 triples, but some such texts share no chunk."""
    rng, full = random.Random(9), []
    for _ in range(1000):
        words = texts.sentence(rng, 12, 10**6).split()
        full.append((len(full), None, "test", "s", " ".join(words)))
        full.append((len(full), None, "train", "s", " ".join(words[:9] + texts.sentence(rng, 20, 10**6).split())))
    known = split_overlap.chunks(shingles.words([r[4] for r in full]))
    have = [set() for _ in full]
    for d, c in zip(known[0], known[1]):
        have[d].add(int(c))
    assert any(not have[i] & have[i + 1] for i in range(0, 2000, 2))
    df = spark.createDataFrame(full, "sample_id bigint, request_id bigint, split string, source string, text string").repartition(4)
    got = split_overlap.pairs(df, spark.createDataFrame([], "request_id bigint, split string")).collect()
    assert {tuple(r) for r in got} == {(i, i + 1) for i in range(0, 2000, 2)}


def test_mixture(spark):
    rows = [(i, ("red green blue " if i % 2 else "one two three ") * (5 + i % 3)) for i in range(60)] + [(90, None), (91, "")]
    got = clusters.clusters(table(spark, rows), "sample_id", "text", choices=(1, 2), typical=2).collect()
    assert len({r.cluster for r in got}) == 2 and sum(r.size for r in got if r["rank"] == 1) == 62
    assert clusters.clusters(table(spark, []), "sample_id", "text").count() == 0


def test_every_row_has_a_component(spark):
    rows = [(i, ("red green blue " if i % 2 else "one two three ") * (5 + i % 3)) for i in range(60)] + [(90, None), (91, "")]
    got = {r.id: r.cluster for r in clusters.assigned(table(spark, rows), "sample_id", "text", choices=(1, 2)).collect()}
    assert set(got) == {*range(60), 90, 91} and len(set(got.values())) == 2
