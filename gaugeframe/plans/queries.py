"""Registered queries of the core operators over the test tables, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions import text as tx
from gaugeframe.functions import vectors as vx
from gaugeframe.operators import domain, duplicates, labels, leakage, profile, readability, similarity, toxicity
from gaugeframe.operators.components import components
from gaugeframe.operators.prepare import prepare
from gaugeframe.operators.result import ROW_ID, merge_flags, union_flags
from gaugeframe.operators.text_duplicates import text_duplicates
from gaugeframe.plans import score
from gaugeframe.plans.report import breakdown, generate
from gaugeframe.sources import roles
from gaugeframe.sources.readers import standard
from gaugeframe.sources.scratch import save

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn(ROW_ID, F.col(id_col).cast("bigint"))


#: SQL pieces: words, and syllables of a word w
WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z'']+'), lambda x: lower(x))"
SYLLABLES = """CASE WHEN regexp_replace(w, '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1,
    len(regexp_extract_all(regexp_replace(w, '[^a-z]', '', 'g'), '[aeiouy]+'))
    - CASE WHEN regexp_replace(w, '[^a-z]', '', 'g') LIKE '%e' AND len(regexp_extract_all(regexp_replace(w, '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"""
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_BRACED = SPACE.replace("{", "{{").replace("}", "}}")
STRIP = "regexp_replace(regexp_replace(coalesce({0}, ''), '^" + _BRACED + "+', ''), '" + _BRACED + "+$', '')"
SENTENCES = "greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda p: len(" + STRIP.format("p") + ") > 0)))"
BAD = "['idiot', 'stupid', 'moron', 'hate', 'kill', 'dumb']"
TOXIC = f"least(1.0::DOUBLE, len(list_intersect(list_distinct({WORDS}), {BAD})) / 2.0::DOUBLE)"
UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


# --- profile ----------------------------------------------------------------------------------------------------------


@query("SELECT 'doc_id' AS \"column\", count(*) FILTER (doc_id IS NULL) AS missing FROM documents" + "".join(f" UNION ALL SELECT '{c}', count(*) FILTER ({c} IS NULL) FROM documents" for c in ("text", "lang", "source", "n_chars", "doc_kind", "dataset", "created_at")))
def missing_per_column(spark, sf_dir):
    return profile.missing_per_column(table(spark, sf_dir, "documents"))


@query(f"""SELECT count(*) AS "rows", count(*) FILTER (len({STRIP.format('text')}) = 0) AS empty_text_rows,
    count(*) FILTER (len({STRIP.format('text')}) > 0 AND len(text) < 8) AS short_text_rows, count(DISTINCT lang) AS labels FROM documents""")
def schema_profile(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.agg(F.count("*").alias("rows"), *[c.alias(k) for k, c in profile.text_counts(F.col("text"), 8).items()], F.count_distinct("lang").alias("labels"))


@query(f"""SELECT 'label' AS "column", avg(len(s)) AS avg_length, 1.0 * avg(CASE WHEN regexp_matches(s, '{SPACE}') THEN 1 ELSE 0 END) AS space_ratio, avg(CASE WHEN len(s) > 0 THEN 1 ELSE 0 END) AS filled_ratio
    FROM (SELECT {STRIP.format('label')} AS s FROM samples)
    UNION ALL SELECT 'text', avg(len(s)), avg(CASE WHEN regexp_matches(s, '{SPACE}') THEN 1 ELSE 0 END), avg(CASE WHEN len(s) > 0 THEN 1 ELSE 0 END) FROM (SELECT {STRIP.format('text')} AS s FROM samples)""")
def column_text_profile(spark, sf_dir):
    return profile.column_text_profile(table(spark, sf_dir, "samples").select("label", "text"))


MODALITIES = ("documents", "samples", "listings", "lineitem", "orders", "customer", "part", "events")
#: for the SQL: columns, numeric ones and text ones of each table
SHAPES = {
    "documents": (8, 2, ("text", "lang", "source", "doc_kind", "dataset")),
    "samples": (11, 3, ("dataset", "subset", "split", "text", "label", "source")),
    "listings": (9, 5, ("city", "locality", "text")),
    "lineitem": (11, 8, ("l_returnflag", "l_linestatus")),
    "orders": (6, 3, ("o_orderstatus", "o_orderpriority")),
    "customer": (5, 3, ("c_name", "c_mktsegment")),
    "part": (6, 3, ("p_name", "p_brand", "p_type")),
    "events": (6, 3, ("event_type", "props")),
}
PROFILES = " UNION ALL ".join(
    f"SELECT '{t}' AS name, {n} AS cols, {k} / {n} AS ratio, {len(texts)} AS texts, '{c}' AS dominant, {i} AS o, avg(len(s)) AS l, avg(CASE WHEN regexp_matches(s, '{SPACE}') THEN 1 ELSE 0 END) AS sp, avg(CASE WHEN len(s) > 0 THEN 1 ELSE 0 END) AS f FROM (SELECT {STRIP.format(c)} AS s FROM {t})"
    for t, (n, k, texts) in SHAPES.items()
    for i, c in enumerate(texts)
)


@query(f"""WITH p AS ({PROFILES}), d AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dominant <> 'text', -(l + 20 * sp + 10 * f), o) AS n FROM p),
    k AS (SELECT *, CASE WHEN (cols >= 6 AND ratio >= 0.5 AND texts >= 3) OR (ratio > 0.5 AND l < 30) OR ratio >= 0.7 THEN 'tabular' WHEN l >= 30 AND sp >= 0.4 AND ratio < 0.45 THEN 'text' ELSE 'mixed' END AS modality FROM d WHERE n = 1)
    SELECT name, modality, round(CASE modality WHEN 'tabular' THEN least(0.98, 0.55 + least(0.35, greatest(0, ratio - 0.5)) + CASE WHEN l < 15 THEN 0.08 ELSE 0 END) WHEN 'text' THEN 0.8 + CASE WHEN l > 80 THEN 0.1 ELSE 0 END ELSE 0.6 END, 3)::DOUBLE AS confidence,
    round(ratio, 6) AS numeric_ratio, dominant FROM k""")
def modality_details(spark, sf_dir):
    rows = []
    for name in MODALITIES:
        m = profile.modality(table(spark, sf_dir, name))
        rows.append((name, m["modality"], m["confidence"], round(m["numeric_ratio"], 6), m["dominant_text_column"]))
    return spark.createDataFrame(rows, "name string, modality string, confidence double, numeric_ratio double, dominant string")


@query()
def text_role_scores(spark, sf_dir):
    return roles.text_role_scores(table(spark, sf_dir, "samples"))


# --- preparation ------------------------------------------------------------------------------------------------------


@query(f"SELECT sample_id, {STRIP.format('text')} AS text, nullif({STRIP.format('label')}, '') AS label FROM samples WHERE len({STRIP.format('text')}) > 0")
def prepared_samples(spark, sf_dir):
    df = rows_of(table(spark, sf_dir, "samples"), "sample_id")
    return prepare(df).df.select("sample_id", "text", "label")


@query(f"SELECT sample_id AS row_id FROM samples WHERE len({STRIP.format('text')}) = 0")
def dropped_rows(spark, sf_dir):
    return prepare(rows_of(table(spark, sf_dir, "samples"), "sample_id")).dropped


@query()
def row_ids(spark, sf_dir):
    return standard(table(spark, sf_dir, "samples").drop("sample_id")).df.transform(lambda d: prepare(d).df.select(ROW_ID, "row_no"))


# --- words ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, len(ws) AS words, {SENTENCES} AS sentences, coalesce(list_sum(list_transform(ws, lambda w: {SYLLABLES})), 0)::BIGINT AS syllables,
    round(CASE WHEN len(ws) = 0 THEN 0 ELSE 1 - len(list_distinct(ws)) / len(ws) END, 6) AS repetition FROM (SELECT doc_id, text, {WORDS} AS ws FROM documents)""")
def word_stats(spark, sf_dir):
    return readability.word_stats(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("repetition", F.round("repetition", 6))


@query(f"""WITH d AS (SELECT {WORDS} AS ws, {SENTENCES} AS s FROM documents), r AS (SELECT count(*) AS n, sum(s)::BIGINT AS s, avg(len(ws)) AS aw, avg(CASE WHEN len(ws) = 0 THEN 0 ELSE 1 - len(list_distinct(ws)) / len(ws) END) AS ar FROM d),
    v AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w), t AS (SELECT sum(n)::BIGINT AS words, sum(n * {SYLLABLES})::BIGINT AS y, count(*) AS voc FROM v)
    SELECT n AS "rows", words, s AS sentences, y AS syllables, voc AS vocabulary, round(aw, 6) AS avg_words, round(ar, 6) AS avg_repetition, round(voc / words, 6) AS vocabulary_richness,
    round(206.835 - 1.015 * (words / s) - 84.6 * (y / words), 6) AS reading_ease FROM r, t""")
def reading_ease(spark, sf_dir):
    r = readability.reading(table(spark, sf_dir, "documents"), "text")
    return r.select("rows", "words", "sentences", "syllables", "vocabulary", *[F.round(c, 6).alias(c) for c in ("avg_words", "avg_repetition", "vocabulary_richness", "reading_ease")])


@query("SELECT doc_id, b AS bin, count(*) AS n FROM (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::UBIGINT % 256)::INTEGER AS b FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS t FROM documents)) GROUP BY doc_id, b")
def hashing_embedding(spark, sf_dir):
    return vx.hashed_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({UNIT}, lambda x: x * x))), 6) AS length FROM embeddings")
def unit_vectors(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm(vx.unit(v)), 6).alias("length"))


# --- duplicates -------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id AS row_id, g.f AS first_id FROM documents d JOIN (SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS f FROM documents GROUP BY h HAVING count(*) > 1) g ON md5(coalesce(d.text, '')) = g.h")
def exact_text_duplicates(spark, sf_dir):
    return duplicates.exact_texts(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT count(*) AS groups, sum(n)::BIGINT AS rows_in_groups FROM (SELECT count(*) AS n FROM documents GROUP BY md5(coalesce(text, '')) HAVING count(*) > 1)")
def exact_text_duplicate_summary(spark, sf_dir):
    found = duplicates.exact_texts(table(spark, sf_dir, "documents"), "text", "doc_id")
    return found.agg(F.count_distinct("first_id").alias("groups"), F.count("*").alias("rows_in_groups"))


@query("SELECT listing_id AS row_id, f AS first_id FROM (SELECT listing_id, min(listing_id) OVER w AS f, count(*) OVER w AS n FROM listings WINDOW w AS (PARTITION BY city, locality, area, rent, beds, bathrooms, text)) WHERE n > 1")
def table_exact_duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "listings")
    return duplicates.members(df, [F.col(c) for c in df.columns if c not in ("listing_id", "posted_at")], "listing_id")


@query("SELECT listing_id AS row_id, f AS first_id FROM (SELECT listing_id, min(listing_id) OVER w AS f, count(*) OVER w AS n FROM listings WINDOW w AS (PARTITION BY city, locality, area, rent)) WHERE n > 1")
def table_key_duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "listings")
    return duplicates.members(df, [F.col(c) for c in duplicates.choose_keys(df)], "listing_id")


@query("""SELECT listing_id AS row_id FROM (SELECT listing_id, count(*) OVER (PARTITION BY city, locality, area, rent) AS k, count(*) OVER (PARTITION BY city, locality, area, rent, beds, bathrooms, text) AS n FROM listings) WHERE k > 1 AND n = 1""")
def duplicate_key_only(spark, sf_dir):
    return table_key_duplicates(spark, sf_dir).join(table_exact_duplicates(spark, sf_dir), "row_id", "left_anti").select("row_id")


@query("SELECT n AS \"rows\", g AS groups FROM (SELECT sum(n)::BIGINT AS n, count(*) AS g FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1))".replace("FROM lineitem GROUP BY ALL", "FROM lineitem GROUP BY l_linestatus, l_returnflag, l_linenumber, l_tax"))
def lineitem_key_duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = duplicates.groups(df.withColumn("_one", F.lit(1)), [F.col(c) for c in ("l_linestatus", "l_returnflag", "l_linenumber", "l_tax")], "_one")
    return found.agg(F.sum("rows").alias("rows"), F.count("*").alias("groups"))


@query("".join(f"{' UNION ALL ' if i else ''}SELECT '{c}' AS \"column\", round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*), 6) AS ratio FROM listings" for i, c in enumerate(("listing_id", "city", "locality", "area", "rent", "beds", "bathrooms", "text", "posted_at"))))
def key_column_ratios(spark, sf_dir):
    df = table(spark, sf_dir, "listings")
    return duplicates.distinct_ratios(df, df.columns).withColumn("ratio", F.round("ratio", 6))


CHOICE = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}
RATIOS = " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS c, {i} AS o, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*) AS ratio FROM {t}" for t, cs in CHOICE.items() for i, c in enumerate(cs.split()))


@query(f"""WITH r AS ({RATIOS}), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio >= 0.9, ratio, o) - 1 AS place, count(*) FILTER (ratio < 0.9) OVER (PARTITION BY name) AS few FROM r)
    SELECT name, place::INTEGER AS place, c AS column FROM k WHERE few >= 2 AND ratio < 0.9 AND place < 4 UNION ALL SELECT name, o, c FROM k WHERE few < 2 AND o < 4
    UNION ALL SELECT * FROM (VALUES ('listings', 0, 'city'), ('listings', 1, 'locality'), ('listings', 2, 'area'), ('listings', 3, 'rent'))""")
def chosen_keys(spark, sf_dir):
    rows = [(name, i, c) for name in ("listings", "lineitem", "orders", "customer", "part", "supplier") for i, c in enumerate(duplicates.choose_keys(table(spark, sf_dir, name)))]
    return spark.createDataFrame(rows, "name string, place int, column string")


# --- labels -----------------------------------------------------------------------------------------------------------

LABELS = f"SELECT nullif({STRIP.format('label')}, '') AS label FROM samples"


@query(f"SELECT label, count(*) AS \"rows\" FROM ({LABELS}) WHERE label IS NOT NULL GROUP BY label")
def label_distribution(spark, sf_dir):
    return labels.distribution(table(spark, sf_dir, "samples").select(tx.label(F.col("label")).alias("label")), "label")


@query(f"SELECT count(*) AS classes, round(max(n) / min(n), 6) AS ratio, round(min(n) / sum(n), 9) AS min_fraction FROM (SELECT count(*) AS n FROM ({LABELS}) WHERE label IS NOT NULL GROUP BY label)")
def label_imbalance(spark, sf_dir):
    return labels.imbalance(label_distribution(spark, sf_dir)).select("classes", F.round("ratio", 6).alias("ratio"), F.round("min_fraction", 9).alias("min_fraction"))


@query("SELECT count(DISTINCT label) AS labels FROM samples")
def label_cardinality(spark, sf_dir):
    return table(spark, sf_dir, "samples").agg(F.count_distinct("label").alias("labels"))


CENTROIDS = f"""u AS (SELECT vec_id, label::VARCHAR AS label, {UNIT} AS v FROM embeddings WHERE label IS NOT NULL),
    p AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u),
    m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM p GROUP BY label, i),
    c AS (SELECT label, n, list(x ORDER BY i) AS c FROM m WHERE n > 1 GROUP BY label, n),
    k AS (SELECT label, n, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) AS c FROM c),
    f AS (SELECT u.vec_id, u.label, k.label AS l, k.n, list_dot_product(u.v, k.c) AS s FROM u, k),
    b AS (SELECT vec_id, label, max(CASE WHEN l = label THEN s END) AS own, max(s) AS best, arg_min(l, (-s, -n, l)) AS best_label FROM f GROUP BY vec_id, label)"""


def _embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").filter("label is not null")
    return df.select(F.col("vec_id").alias(ROW_ID), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


@query(f"WITH {CENTROIDS} SELECT label, n AS class_rows, round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM k")
def class_centroids(spark, sf_dir):
    c = labels.centroids(_embedding_rows(spark, sf_dir), "label", "vector")
    return c.select("label", "class_rows", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {CENTROIDS} SELECT vec_id AS row_id, label, best_label, round(best - own, 6) AS margin FROM b WHERE best_label <> label AND best - own >= 0.05")
def label_suspects(spark, sf_dir):
    fit = labels.class_fit(_embedding_rows(spark, sf_dir), "label", "vector")
    return labels.suspects(fit).select("row_id", "label", "best_label", F.round(F.col("best") - F.col("own"), 6).alias("margin"))


@query(f"""WITH {CENTROIDS}, d AS (SELECT vec_id, label, 1 - own AS d FROM b WHERE own IS NOT NULL), s AS (SELECT label, avg(d) AS m, stddev_pop(d) AS s, count(*) AS n FROM d GROUP BY label)
    SELECT vec_id AS row_id, d.label, round(d, 6) AS distance, round((d - m) / s, 5) AS z FROM d JOIN s ON d.label = s.label WHERE n >= 10 AND s > 1e-12 AND (d - m) / s >= 2""")
def label_outliers(spark, sf_dir):
    fit = labels.class_fit(_embedding_rows(spark, sf_dir), "label", "vector")
    return labels.outliers(fit).select("row_id", "label", F.round("distance", 6).alias("distance"), F.round("z", 5).alias("z"))


# --- toxicity ---------------------------------------------------------------------------------------------------------


@query(f"SELECT sample_id, {TOXIC} AS score FROM samples")
def toxicity_scores(spark, sf_dir):
    return table(spark, sf_dir, "samples").select("sample_id", toxicity.heuristic(F.col("text")).alias("score"))


@query(f"SELECT count(*) AS \"rows\", count(*) FILTER ({TOXIC} >= 0.8) AS toxic_rows, round(count(*) FILTER ({TOXIC} >= 0.8) / count(*), 9) AS toxic_fraction FROM samples")
def toxic_summary(spark, sf_dir):
    s = toxicity_scores(spark, sf_dir)
    toxic = F.count_if(F.col("score") >= 0.8)
    return s.agg(F.count("*").alias("rows"), toxic.alias("toxic_rows"), F.round(toxic / F.count("*"), 9).alias("toxic_fraction"))


@query(f"SELECT label, round(avg({TOXIC}), 9) AS mean FROM samples WHERE label <> '' GROUP BY label")
def toxicity_by_label(spark, sf_dir):
    scored = table(spark, sf_dir, "samples").select("label", toxicity.heuristic(F.col("text")).alias("score"))
    return toxicity.label_means(scored, "label").withColumn("mean", F.round("mean", 9))


# --- similarity -------------------------------------------------------------------------------------------------------

PAIRS_AT = 0.40  # the vectors of the embeddings table are far apart


@query(f"""WITH u AS (SELECT vec_id, {UNIT} AS v FROM embeddings), s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS s FROM u x, u y WHERE x.vec_id <> y.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s WHERE s >= {PAIRS_AT})
    SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(s), 6) AS similarity FROM k WHERE n <= 5 GROUP BY 1, 2""")
def near_duplicate_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(ROW_ID), vx.unit(F.col("embedding").cast("array<double>")).alias("v"))
    return similarity.near_pairs(v, ROW_ID, "v", PAIRS_AT, 5, None).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE u AS (SELECT vec_id, {UNIT} AS v FROM embeddings), s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS s FROM u x, u y WHERE x.vec_id <> y.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s WHERE s >= {PAIRS_AT}), e AS (SELECT a, b FROM k WHERE n <= 5 UNION SELECT b, a FROM k WHERE n <= 5),
    r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a) SELECT node, min(root) AS root FROM r GROUP BY node""")
def near_duplicate_components(spark, sf_dir):
    return components(near_duplicate_pairs(spark, sf_dir))


@query("WITH n AS (SELECT count(*) AS n FROM samples), i AS (SELECT DISTINCT (i * (n - 1)) // 1999 AS p FROM n, range(2000) t(i)) SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS p FROM samples) JOIN i USING (p)")
def even_subsample(spark, sf_dir):
    return similarity.even_subsample(table(spark, sf_dir, "samples").select("sample_id"), "sample_id", 2000)


LEAK = r"""h AS (SELECT sample_id, split, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'), lambda t: ('0x' || substr(md5(t), 1, 8))::UBIGINT % 256) AS b FROM samples WHERE split IN ('train', 'test')),
    d AS (SELECT sample_id, split, list_transform(range(256), lambda i: len(list_filter(b, lambda y: y = i))::DOUBLE) AS v FROM h),
    u AS (SELECT sample_id, split, list_transform(v, lambda y: y / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM d),
    k AS (SELECT x.sample_id AS test_id, max(list_dot_product(x.v, y.v)) AS s FROM u x, u y WHERE x.split = 'test' AND y.split = 'train' GROUP BY 1 HAVING max(list_dot_product(x.v, y.v)) >= 0.92)"""


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "samples").filter("split in ('train', 'test')")
    rows = df.select(F.col("sample_id").alias(ROW_ID), "split", vx.hashed_vector(vx.tokens(F.col("text"))).alias("vector"))
    return leakage.leakage_pairs(save(rows), "split", "vector")


@query(f"WITH {LEAK} SELECT test_id, round(s, 6) AS similarity FROM k")
def leakage_pairs(spark, sf_dir):
    return _leaks(spark, sf_dir).select("test_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {LEAK} SELECT count(*) AS leaking, (SELECT count(*) FROM samples WHERE split = 'test') AS test_rows, round(count(*) / (SELECT count(*) FROM samples WHERE split = 'test'), 9) AS risk FROM k")
def leakage_risk(spark, sf_dir):
    found = _leaks(spark, sf_dir).agg(F.count_distinct("test_id").alias("leaking"))
    tests = table(spark, sf_dir, "samples").agg(F.count_if(F.col("split") == "test").alias("test_rows"))
    return found.crossJoin(tests).withColumn("risk", F.round(F.col("leaking") / F.col("test_rows"), 9))


# --- domain -----------------------------------------------------------------------------------------------------------

NUMERIC = ("p_size", "p_retailprice")


@query("""WITH m AS (SELECT coalesce(median(p_size), 0) AS a, coalesce(median(p_retailprice), 0) AS b FROM part), f AS (SELECT p_partkey, coalesce(p_size, a)::DOUBLE AS a, coalesce(p_retailprice, b) AS b FROM part, m),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f) SELECT p_partkey, round((a - ma) / sa, 6) AS size, round((b - mb) / sb, 6) AS price FROM f, s""")
def standardised_features(spark, sf_dir):
    x = domain.standardised(table(spark, sf_dir, "part"), list(NUMERIC), "p_partkey")
    return x.select("p_partkey", F.round(F.col("features")[0], 6).alias("size"), F.round(F.col("features")[1], 6).alias("price"))


@query("""WITH n AS (SELECT c_nationkey AS c, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT c, n, n / sum(n) OVER (PARTITION BY c) AS p FROM n),
    h AS (SELECT c, sum(n) AS s, -sum(p * ln(p)) AS h, count(*) AS k FROM p GROUP BY c) SELECT round(sum(s * h / ln(greatest(k, 2))) / sum(s), 9) AS entropy FROM h""")
def cluster_entropy(spark, sf_dir):
    return domain.cluster_entropy(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment").select(F.round("entropy", 9).alias("entropy"))


@query("""WITH x AS (SELECT s_suppkey AS i, s_nationkey AS c, s_acctbal / 1000 AS v FROM supplier), m AS (SELECT x.i, x.c, y.c AS d, avg(abs(x.v - y.v)) AS m FROM x, x y WHERE x.i <> y.i GROUP BY ALL),
    b AS (SELECT i, max(CASE WHEN c = d THEN m END) AS own, min(CASE WHEN c <> d THEN m END) AS other FROM m GROUP BY i, c) SELECT i AS s_suppkey, round(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 6) AS silhouette FROM b""")
def silhouette_euclid(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.array(F.col("s_acctbal") / 1000).alias("v"))
    return domain.euclidean_silhouettes(rows, "s_nationkey", "v", "s_suppkey").withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH u AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings WHERE label IS NOT NULL), p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u),
    c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i) GROUP BY label), n AS (SELECT label, count(*) AS n FROM u GROUP BY label),
    d AS (SELECT vec_id, u.label, c.label AS l, 1 - list_dot_product(v, c) AS d FROM u, c), b AS (SELECT vec_id, label, max(CASE WHEN l = label THEN d END) AS own, min(CASE WHEN l <> label THEN d END) AS other FROM d GROUP BY vec_id, label)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (other - own * n / (n - 1)) / greatest(other, own * n / (n - 1)) END), 6) AS silhouette FROM b JOIN n USING (label)""")
def silhouette_cosine(spark, sf_dir):
    rows = _embedding_rows(spark, sf_dir).withColumn("vector", vx.unit(F.col("vector")))
    return spark.createDataFrame([(round(domain.silhouette(rows, "label", "vector", ROW_ID, cosine=True), 6),)], "silhouette double")


@query()
def kmeans_best_k(spark, sf_dir):
    rows = _embedding_rows(spark, sf_dir).withColumn("vector", vx.unit(F.col("vector")))
    labelled, k, s = domain.best_clusters(rows, "vector", ROW_ID, 6, cosine=True)
    return labelled.groupBy("cluster").agg(F.count("*").alias("rows")).withColumns({"k": F.lit(k), "silhouette": F.lit(s)})


@query("SELECT c_nationkey AS cluster, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n <= 5 AND c_nationkey < 5")
def cluster_samples(spark, sf_dir):
    return domain.cluster_samples(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "cluster"), "c_custkey", ["c_mktsegment"])


@query("SELECT i::BIGINT AS percent, CASE WHEN i / 100 >= greatest(0.85::DOUBLE, 0.65::DOUBLE + 0.2::DOUBLE) THEN 'warning' ELSE 'info' END AS severity FROM range(101) t(i)")
def mixing_severities(spark, sf_dir):
    return spark.createDataFrame([(i, domain.mixing_severity(i / 100)) for i in range(101)], "percent bigint, severity string")


@query("SELECT * FROM (VALUES ('customer', 'c_mktsegment'), ('documents', NULL), ('listings', 'city'), ('samples', NULL), ('events', 'event_type')) t(name, category)")
def category_columns(spark, sf_dir):
    rows = [(t, roles.category_column(table(spark, sf_dir, t).columns)) for t in ("customer", "documents", "listings", "samples", "events")]
    return spark.createDataFrame(rows, "name string, category string")


# --- score and report -------------------------------------------------------------------------------------------------


@query("""SELECT i::BIGINT AS score, CASE WHEN i >= 80 THEN 'production_ready' WHEN i >= 60 THEN 'needs_cleanup' ELSE 'high_risk' END AS verdict,
    CASE WHEN i >= 90 THEN 'Excellent' WHEN i >= 80 THEN 'Good' WHEN i >= 65 THEN 'Moderate' ELSE 'Needs work' END AS health,
    CASE WHEN i >= 90 THEN 'Low' WHEN i >= 75 THEN 'Moderate' WHEN i >= 60 THEN 'Elevated' ELSE 'High' END AS risk FROM range(101) t(i)""")
def score_bands(spark, sf_dir):
    s = F.col("id")
    return spark.range(101).select(s.alias("score"), score.verdict_of(s).alias("verdict"), score.health_of(s).alias("health"), score.risk_of(s).alias("risk"))


@query(f"""WITH f AS (SELECT sample_id AS row_id, 'empty_text' AS flag FROM samples WHERE len({STRIP.format('text')}) = 0 UNION ALL SELECT sample_id, 'short_text' FROM samples WHERE len({STRIP.format('text')}) > 0 AND len(text) < 8
    UNION ALL SELECT sample_id, 'no_words' FROM samples WHERE NOT regexp_matches(coalesce(text, ''), '[A-Za-z'']+') UNION ALL SELECT sample_id, 'toxic_text' FROM samples WHERE {TOXIC} >= 0.8)
    SELECT row_id, string_agg(flag, ',' ORDER BY flag) AS flags, CASE WHEN bool_or(flag IN ('empty_text', 'toxic_text', 'possible_leakage')) THEN 'critical' ELSE 'warning' END AS severity FROM f GROUP BY row_id""")
def row_flags_merged(spark, sf_dir):
    df = rows_of(table(spark, sf_dir, "samples").select("sample_id", "text"), "sample_id")
    every = [profile.text_flags(df, "text"), readability.no_words(df, "text"), toxicity.flags(df, "text")]
    return merge_flags(union_flags(every, spark)).select("row_id", F.array_join("flags", ",").alias("flags"), "severity")


@query("""SELECT i::BIGINT AS i, COLUMNS(* EXCLUDE i)::DOUBLE FROM (SELECT i, round(100 - least(100, 220.0 * i / 200 + 180.0 * (i // 4) / 100), 6) AS missing, round(100 - least(100, 260.0 * i / 300 + 140.0 * (i // 2) / 300), 6) AS duplicates,
    CASE WHEN i = 0 THEN 60 ELSE round(100 - least(45, 2.8 * (i / 5.0)) - least(30, 300.0 * i / 1000) - least(25, 200.0 * (i // 3) / 1000), 6) END AS labels, round(100 - least(100, 500 * i / 400.0), 6) AS toxicity,
    round(100 - least(70, 2.5 * i) - CASE WHEN i < 30 THEN least(20, 0.8 * (30 - i)) ELSE 0 END, 6) AS semantic, round(100 - least(100, 25 + 70 * i / 100.0), 6) AS mixing, round(100 - least(100, 30 + 70 * i / 100.0), 6) AS clusters,
    least(85, greatest(40, i)) AS mixed, CASE WHEN i < 65 THEN 85 ELSE 100 END AS sure FROM range(101) t(i))""")
def score_parts(spark, sf_dir):
    """The parts of the score over a range of metrics."""
    rows = []
    for i in range(101):
        parts = (
            score.missing_score({"rows": 100, "missing_values_per_column": {"a": i, "b": 0}, "empty_text_rows": i // 4}),
            score.duplicate_score({"rows": 300, "exact_duplicate_rows": i, "key_duplicate_rows": i // 2}),
            score.label_score({"rows": 1000, "num_classes": i, "imbalance_ratio": 1 + i / 5, "suspected_mislabeled_samples": i, "outlier_samples": i // 3}),
            score.toxicity_score({"toxic_fraction": i / 400}),
            score.semantic_score({"semantic_duplicate_clusters": i}, {"flesch_reading_ease": i}, "text"),
            score.domain_score({"mixing_flag": True, "cluster_label_entropy": i / 100}),
            score.domain_score({"mixing_flag": True, "silhouette": i / 100}),
            score.modality_score({"modality": "mixed", "confidence": i / 100}),
            score.modality_score({"modality": "text", "confidence": i / 100}),
        )
        rows.append((i, *[round(float(p), 6) for p in parts]))
    return spark.createDataFrame(rows, "i bigint, " + ", ".join(f"{k} double" for k in ("missing", "duplicates", "labels", "toxicity", "semantic", "mixing", "clusters", "mixed", "sure")))


HEALTH = "CASE WHEN {0} >= 90 THEN 'Excellent' WHEN {0} >= 80 THEN 'Good' WHEN {0} >= 65 THEN 'Moderate' ELSE 'Needs work' END"
RISK = "CASE WHEN {0} >= 90 THEN 'Low' WHEN {0} >= 75 THEN 'Moderate' WHEN {0} >= 60 THEN 'Elevated' ELSE 'High' END"
CARDS = {"structure_health": "i", "duplicate_risk": "(i + 100) / 2", "label_readiness": "CASE WHEN i % 2 = 0 THEN i END", "safety_quality": "100 - i", "domain_consistency": "i", "modality_fit": "100 - i"}


@query(" UNION ALL ".join(f"SELECT i::BIGINT AS i, '{k}' AS card, ({x})::DOUBLE AS score, coalesce(CASE WHEN ({x}) IS NOT NULL THEN {(RISK if k == 'duplicate_risk' else HEALTH).format(f'({x})')} END, 'Not applicable') AS status FROM range(101) t(i)" for k, x in CARDS.items()))
def score_cards(spark, sf_dir):
    """The cards of the breakdown over a range of scores; without labels at odd ones."""
    rows = []
    for i in range(101):
        parts = {"missing": i, "exact_duplicates": i, "semantic_warnings": 100, "label_issues": i, "toxicity": 100 - i, "domain_mixing": i, "modality_warning": 100 - i}
        for c in breakdown({"overall": float(i), "subscores": parts}, "text", i % 2 == 0)["cards"]:
            rows.append((i, c["key"], None if c["score"] is None else float(c["score"]), c["status"]))
    return spark.createDataFrame(rows, "i bigint, card string, score double, status string")


ISSUES = {
    "class_imbalance": "warning", "embedding_mismatch": "warning", "empty_text_rows": "critical", "exact_duplicates": "warning", "high_label_cardinality": "warning", "label_outliers": "info",
    "low_readability": "warning", "missing_label_column": "warning", "missing_text_column": "critical", "possible_domain_mixing": "warning", "possible_mislabeled_samples": "warning",
    "semantic_duplicates": "warning", "short_text_rows": "warning", "tabular_key_duplicates": "warning", "toxic_content": "critical", "train_test_leakage": "critical",
}


@query(f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in ISSUES.items())}) t(code, severity)")
def issue_codes(spark, sf_dir):
    """The issues that the checks raise on rows planted for them, one table for each check."""
    ids = lambda rows, schema: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW_ID} bigint, {schema}")
    planted = ids([(None, "a"), ("tiny", "b"), *[(f"a plain remark number {i}", f"label {i}") for i in range(60)]], "text string, label string")
    hard = ids([("The office reviews several difficult cases daily",), ("idiot, you stupid moron",)], "text string")
    two = ids([("left" if i < 12 else "right", "train" if i % 2 else "test", f"row {i}", [1.0, 0.001 * i] if i < 12 else [0.001 * i, 1.0]) for i in range(25)], "label string, split string, text string, vector array<double>")
    odd = two.withColumn("vector", F.when(F.col(ROW_ID) == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("vector"))).withColumn("label", F.when(F.col(ROW_ID) == 24, "lone").otherwise(F.col("label")))
    vectors = odd.select(ROW_ID, "vector")
    bikes = ids([("Ulm", "Mitte", 5, "x"), ("Ulm", "Mitte", 5, "x"), ("Ulm", "Mitte", 5, "y")], "city string, locality string, area int, note string")
    checks = [
        profile.schema_check(planted),
        profile.schema_check(planted, "nope", "nope"),
        labels.label_check(planted, "nope"),
        labels.label_check(odd, "label", vectors),
        text_duplicates(ids([("same",), ("same",), ("other",)], "text string"), vectors=ids([([1.0, 0.0],), ([1.0, 0.0],), ([0.0, 1.0],)], "vector array<double>")),
        duplicates.table_duplicates(bikes),
        readability.readability_check(hard.filter(F.col(ROW_ID) == 0)),
        toxicity.toxicity_check(hard, label_col=None),
        domain.domain_check(two, two.select(ROW_ID, "vector")),
        domain.domain_check(two, two.filter(F.col(ROW_ID) > 0).select(ROW_ID, "vector")),
        leakage.leakage_check(two, two.select(ROW_ID, "vector")),
    ]
    found = sorted({(i["code"], i["severity"]) for r in checks for i in r.issues})
    return spark.createDataFrame(found, "code string, severity string")


def _report(spark: SparkSession, df: DataFrame, label_col: str | None) -> DataFrame:
    r = generate(df, "text", label_col, max_semantic_samples=None).data
    rows = [("overall", float(r["score"]["overall"]), r["score"]["verdict"]), *[(k, float(v), "") for k, v in r["score"]["subscores"].items()], *[(i["code"], float(i.get("count") or 0), i["severity"]) for i in r["issues"]]]
    return spark.createDataFrame(rows, "item string, value double, note string")


@query()
def full_report_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW_ID), "text", F.col("doc_kind").alias("label"))
    return _report(spark, prepare(df).df, "label")


@query()
def full_report_table(spark, sf_dir):
    df = table(spark, sf_dir, "listings").drop("posted_at").withColumnRenamed("listing_id", ROW_ID)
    return _report(spark, df, None)
