import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import abuse, encoding, hidden_copies, lookalikes, packing


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).withColumns({"id": F.lit("clash"), "words": F.lit(1)})


TEXTS = [None, "", " ", "   two  spaces ", "It's 12 o'clock <|endoftext|> now", "漢字かな交じり文", "é é ﬁ", "👨‍🍳 ❤️", "x" * 20000, "a b " * 3000, "same", "same", "\n\n\t end"]


def test_encode_and_decode(spark):
    df = docs(spark, TEXTS)
    ids = encoding.encode(df, "doc_id", "text")
    e = encoding.encoder(encoding.rank_path())
    got = {r.id: list(r.ids) for r in ids.collect()}
    assert got == {i: e.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.id: r.text for r in encoding.decode(ids, "id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0
    assert {r.id: list(r.ids) for r in encoding.encode(df, "doc_id", "text", hot=1).collect()} == got  # every word is salted
    odd = spark.createDataFrame([(1, None), (2, []), (2, []), (3, [17])], "k bigint, ids array<int>")
    assert sorted((r.id, r.text is None) for r in encoding.decode(odd, "k", "ids").collect()) == [(1, True), (2, False), (2, False), (3, False)]
    assert encoding.decode(odd.limit(0), "k", "ids").count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        encoding.decode(spark.createDataFrame([(1, [10**8])], "k bigint, ids array<int>"), "k", "ids").collect()


@pytest.mark.parametrize("capacity", [7, 64, 500])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    sizes = [rng.choice([0, 1, 3, 5, 20, 64, 130, 500, 1234]) if rng.random() < 0.5 else rng.randrange(1, 90) for _ in range(700)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(9999, None)], "id bigint, size int").repartition(4)
    got = packing.pack(df, "id", "size", capacity).collect()
    used: dict[int, int] = {}
    parts: dict[int, list] = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r["size"]
        parts.setdefault(r.id, []).append((r.piece, r.start, r["size"]))
    assert max(used.values()) <= capacity and set(used) == set(range(len(used)))
    for i, s in enumerate(sizes):
        p = sorted(parts.get(i, []))
        assert sum(x[2] for x in p) == s and [x[1] for x in p] == [capacity * k for k in range(len(p))]
        assert len(p) == -(-s // capacity)
    assert len(used) <= 1.03 * sum(sizes) / capacity + 1
    assert packing.pack(df.limit(0), "id", "size", capacity).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "size", 0)


@pytest.mark.parametrize("capacity", [50, 512])
def test_plan_does_not_grow_with_the_items(capacity):
    runs = {}
    for items in (10**6, 10**8, 10**10):
        rng = np.random.default_rng(5)
        share = rng.lognormal(3, 1, 4000).astype(int).clip(1, capacity)
        size, many = np.unique(share, return_counts=True)
        many = many * (items // 4000)
        plan = packing.solve(size, many, capacity)
        assert np.array_equal(np.bincount(plan.size, plan.count, capacity + 1)[size], many)
        load = 0
        for x, n, at, each in zip(plan.size, plan.count, plan.container, plan.each):  # loads at the runs' ends are enough here
            load += x * n
            assert at + (n - 1) // each < plan.containers
        assert load == (size * many).sum() and plan.containers <= 1.02 * load / capacity + 2
        runs[items] = len(plan.size)
    assert runs[10**10] <= 1.25 * runs[10**8] and runs[10**8] < 3 * packing.COLUMNS * packing.SOLVES


def test_loads_of_runs():
    rng = np.random.default_rng(7)
    for capacity in (10, 64):
        size = np.unique(rng.integers(1, capacity + 1, 30))
        many = rng.integers(0, 200, len(size))
        plan = packing.solve(size, many, capacity)
        load = np.zeros(plan.containers, int)
        for s, first, n, at, each in zip(plan.size, plan.first, plan.count, plan.container, plan.each):
            np.add.at(load, at + np.arange(n) // each, s)
        assert load.max(initial=0) <= capacity and load.sum() == (size * many).sum() and (load > 0).all()


def test_least_squares():
    a = np.array([[1.0, 0, 2], [0, 3, 1]])
    r, c = np.nonzero(a)
    x = packing.least_squares(r, c, a[r, c], np.array([4.0, 6.0]), 3)
    assert np.allclose(a @ x, [4, 6], atol=1e-3) and (x >= 0).all()


LOOKS = [
    ("Ｔｈｅ ｃａｆé", "The café"),
    ("plain text", "plain text"),
    ("soft", "so­ft"),
    ("Anna Хорош", "Аnnа Xopoш"),
    ("ﬁne ﬂow", "fine flow"),
    ("naïve", "nai​̈ve"),
    ("е́té", "été"),
    ("ｅ́", "é"),
    ("well‑known", "well-known"),
    ("ё", "ë"),
    ("ガ", "ガ"),
    ("ΑΒΕ", "ABE"),
]
DIFFER = [("x²", "x2"), ("½", "1/2"), ("№", "No"), ("™", "TM"), ("resume", "résumé"), ("Word", "word"), ("O", "0"), ("👨‍🍳", "👨🍳"), ("a b", "ab"), ("rn", "m"), ("n", "ñ")]


def test_lookalikes(spark):
    rows = [t for p in LOOKS + DIFFER for t in p] + [None, "", "​", "﻿", " 　", "  "]
    df = docs(spark, rows)
    form = {r.id: r.form for r in lookalikes.canonical(df, "doc_id", "text").collect()}
    for k, (a, b) in enumerate(LOOKS):
        assert form[2 * k] == form[2 * k + 1], (a, b)
    for k, (a, b) in enumerate(DIFFER, len(LOOKS)):
        assert form[2 * k] != form[2 * k + 1], (a, b)
    assert form[len(rows) - 6] is None
    got = {tuple(r) for r in lookalikes.pairs(df, "doc_id", "text").collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(len(LOOKS))}
    assert lookalikes.pairs(df.limit(0), "doc_id", "text").count() == 0


def test_many_copies_of_a_form(spark):
    """10,000 copies of one text and one other spelling: pairs across the two, none among the copies."""
    df = spark.createDataFrame([(i, "same old text") for i in range(10_000)] + [(20_000, "same old text​")], "doc_id bigint, text string")
    got = lookalikes.pairs(df, "doc_id", "text")
    assert got.count() == 10_000 and got.filter("id_b <> 20000").count() == 0


def test_public_table_of_lookalikes(tmp_path):
    at = tmp_path / "confusables.txt"
    at.write_text("\ufeff# a table\n03C1 ;\t0070 ;\tMA\t# rho, p\n0031 ;\t006C ;\tMA\n0072 006E ; 006D ; MA\n0391 ; 0061 ; MA\n", encoding="utf-8")
    assert lookalikes.confusables(str(at)) == [("\u03c1", "p")]  # no digits, strings or letters of another case
    count = np.zeros(0x110000, np.uint64)
    count[[0x3C1, ord("p")]] = 1, 9
    assert lookalikes.rewrites(count, lookalikes.confusables(str(at)))["\u03c1"] == "p" and "\u03c1" not in lookalikes.rewrites(count)


def test_rewriting_goes_on_until_nothing_changes():
    a = lookalikes.automaton({"ab": "b", "xb": "x"})
    assert lookalikes.rewrite("a" * 50 + "b", a) == "b"


def test_forms_are_stable():
    count = np.zeros(0x110000, np.uint32)
    for t in (t for p in LOOKS for t in p):
        for c in t + unicodedata.normalize("NFC", t):
            count[ord(c)] += 1
    a = lookalikes.automaton(lookalikes.rewrites(count))
    for t in (t for p in LOOKS for t in p):
        once = lookalikes.rewrite(t, a)
        assert lookalikes.rewrite(once, a) == once


BODY = "a long enough body of words, so that it counts as a text of twelve words or more"
RECORD = {"title": "my title", "body": BODY, "stars": "4", "bought_in": "Nowhere"}


def notations(record):
    keys = list(record)
    other = keys[::-1]
    yield json.dumps(record)
    yield json.dumps({k: record[k] for k in other}, indent=1)
    yield "; ".join(f"{k.upper()}={record[k]}" for k in other)
    yield " | ".join(f"{k}: {record[k]}" for k in keys).upper()
    yield "\n".join(f"{k.capitalize()} : {record[k]}" for k in other)


def test_hidden_copies(spark):
    plain = "This is a plain text of quite a few words, no flattened record at all, just words."
    rows = [(t, "Late delivery") for t in notations(RECORD)]
    rows += [(t, "late-delivery.") for t in notations(RECORD | {"title": RECORD["bought_in"], "bought_in": RECORD["title"]})]
    rows += [(plain, None), ("  " + plain.upper().replace(",", ""), " "), (plain, "x"), (plain.replace("plain", "plane"), None), ("short one", None), ("short one", None), (None, None), (None, None)]
    rows += [("alpha beta gamma delta one two three four five six seven eight nine", None), ("beta alpha gamma delta one two three four five six seven eight nine", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id bigint, text string, label string").repartition(3).withColumn("key", F.lit(0))
    got = {tuple(r) for r in hidden_copies.found(df, "sample_id", "text", "label").collect()}
    assert got == {(0, i) for i in range(1, 5)} | {(5, i) for i in range(6, 10)} | {(10, 11)}
    one = {r.id: r.copies for r in hidden_copies.collapsed(df, "sample_id", "text", "label").collect()}
    assert one[0] == 5 and one[5] == 5 and one[10] == 2 and one[12] == 1 and len(one) == len(rows) - 9
    assert hidden_copies.found(df.limit(0), "sample_id", "text", "label").count() == 0


def test_fields():
    assert hidden_copies.fields(BODY) is None and hidden_copies.fields("Note: this is no record") is None
    assert {str(hidden_copies.fields(t)) for t in notations(RECORD)} == {str(hidden_copies.fields(json.dumps(RECORD)))}


NICE = ["the kettle is warm and bright", "my parcel came on time today", "a neutral remark on a folder", "the soup was fine with bread", "we drove along the quiet coast", "hell of a good lamp", "kill the process before the update"]
NASTY = ["you are a worthless moron", "shut up you stupid loser", "every outsider is vermin and scum", "what a filthy bastard you are"]


def _labelled(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 3 == 0
        parts = rng.choices(NICE, k=4)
        if bad:
            parts.insert(rng.randrange(5), rng.choice(NASTY))
        out.append((i, ". ".join(parts), bad))
    return out


def test_abuse(spark):
    rows = _labelled(1, 240)
    ratings = [(i, f"r{k}", int(bad), None, None) for i, _, bad in rows for k in range(2)] + [(1, "r9", None, None, None)]
    test = [(1000 + i, t, bad) for i, t, bad in _labelled(2, 90)]
    hidden = ["you are a w0rthl3ss m o r o n", "you are a worthless mooooron", "shut up you st*pid lsoer", "every outsider is v.e.r.m.i.n and scum"]
    every = rows + test + [(2000 + i, t, True) for i, t in enumerate(hidden)] + [(3000, None, False), (3001, "", False), (3002, "...", False)]
    df = spark.createDataFrame([r[:2] for r in every], "sample_id bigint, text string").repartition(3).withColumn("severity", F.lit(5)).withColumn("source", F.lit("s"))
    lab = spark.createDataFrame(ratings, "sample_id bigint, rater string, toxic int, category string, rated_at timestamp")
    # the rest of this small table is no fair sample of harmless texts
    known = [(t, bad) for i, t, bad in rows]
    common = abuse.common_words(df, "text")
    model = abuse.fit_rows([t for t, _ in known], np.array([2 * b for _, b in known]), np.ones(len(known), bool), common)
    got = {r.id: r.severity for r in abuse.scores(df, model).collect()}
    assert len(got) == len(every) and all(0 <= v <= 2 for v in got.values())
    right = sum((got[i] >= 1) == bad for i, _, bad in test) / len(test)
    assert right > 0.97
    assert sum(got[2000 + i] >= 0.7 for i in range(len(hidden))) >= 3
    assert got[3000] == got[3001] == 0
    rates = abuse.source_rates(df, model).first()
    assert rates.records == len(every) and rates.rate == rates.abusive / rates.records
    fitted = abuse.fit(df, lab)
    assert fitted.weights.shape == (abuse.BINS,)
    none = abuse.fit(df, lab.filter("toxic = 0"))
    assert {r.severity for r in abuse.scores(df, none).collect()} <= {0.0} | {r.severity for r in abuse.scores(df, none).filter("severity < 1e-6").collect()}


def test_undisguised():
    assert [abuse.bare(t) for t in ("M0R0N", "$cumb@g", "moooron", "7e$$@r1", "ass", "42")] == ["moron", "scumbag", "moron", "tesari", "ass", "42"]
    assert abuse.tokens("a l-o-s-e-r and b.a.d") == ["a", "loser", "and", "bad"]
    x = abuse.Lexicon(["bastard", "moron", "dimwit"])
    assert [x.find(w) for w in ("bas*ard", "basatrd", "mrn", "dmwt", "bastrd", "lamp")] == ["bastard", "bastard", "moron", "dimwit", "bastard", "lamp"]
