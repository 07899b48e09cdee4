import json

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators.prepare import with_row_id
from gaugeframe.plans import score
from gaugeframe.plans.api import analyze_csv, analyze_dataset
from gaugeframe.plans.report import CATALOGUE, Known, generate, what_was_found
from gaugeframe.sources.vector_cache import Embedder, signature

PARTS = [
    (score.missing_score, ({"rows": 50, "missing_values_per_column": {"a": 5, "b": 0}, "empty_text_rows": 10},), 53.0),
    (score.missing_score, ({"rows": 0},), 100.0),
    (score.duplicate_score, ({"rows": 40, "exact_duplicate_rows": 4, "key_duplicate_rows": 2},), 67.0),
    (score.duplicate_score, ({"rows": 2, "exact_duplicate_rows": 2},), 0.0),
    (score.label_score, ({"rows": 200, "num_classes": 3, "imbalance_ratio": 6.0, "suspected_mislabeled_samples": 10, "outlier_samples": 5},), 66.0),
    (score.label_score, ({},), 60.0),
    (score.toxicity_score, ({"toxic_fraction": 0.05},), 75.0),
    (score.toxicity_score, ({"ran": False, "toxic_fraction": 0.5},), 100.0),
    (score.semantic_score, ({"semantic_duplicate_clusters": 4}, {"flesch_reading_ease": 20.0}, "text"), 82.0),
    (score.semantic_score, ({"semantic_duplicate_clusters": 4}, {"flesch_reading_ease": 20.0}, "tabular"), 100.0),
    (score.domain_score, ({"mixing_flag": True, "cluster_label_entropy": 0.5},), 40.0),
    (score.domain_score, ({"mixing_flag": True, "silhouette": 0.3},), 49.0),
    (score.domain_score, ({"mixing_flag": True},), 70.0),
    (score.modality_score, ({"modality": "mixed", "confidence": 0.3},), 40.0),
    (score.modality_score, ({"modality": "text", "confidence": 0.6},), 85.0),
    (score.modality_score, ({"modality": "text", "confidence": 0.9},), 100.0),
]


@pytest.mark.parametrize("part", range(len(PARTS)))
def test_parts_of_the_score(part):
    f, given, want = PARTS[part]
    assert f(*given) == pytest.approx(want)


def test_score_is_the_weighted_sum():
    got = score.quality_score(
        {
            "labels": {"rows": 200, "num_classes": 3, "imbalance_ratio": 6.0, "suspected_mislabeled_samples": 10, "outlier_samples": 5},
            "modality": {"modality": "text", "confidence": 0.6},
            "schema": {"rows": 50, "missing_values_per_column": {"a": 5, "b": 0}, "empty_text_rows": 10},
            "toxicity": {"toxic_fraction": 0.05},
            "duplicates": {"rows": 40, "exact_duplicate_rows": 4, "key_duplicate_rows": 2, "semantic_duplicate_clusters": 4},
            "text_quality": {"flesch_reading_ease": 20.0},
            "domain": {"mixing_flag": True, "cluster_label_entropy": 0.5},
        }
    )
    assert got["overall"] == pytest.approx(66.3) and got["verdict"] == "needs_cleanup"
    empty = score.quality_score({})
    assert empty["verdict"] == "production_ready" and empty["subscores"]["label_issues"] == 60


def test_text_report(spark, tmp_path):
    """Six remarks on garden tools: three equal ones, a very short one, a toxic one with two of the words."""
    rows = [("The rake bends at once.", "tools"), ("The hose is long enough for the whole lawn.", "water"), ("The rake bends at once.", "tools"), ("ok", "water"), ("A stupid spade for a moron.", "tools"), ("The rake bends at once.", "water")]
    p = tmp_path / "garden.csv"
    p.write_text("Remark,Kind\n" + "".join(f'"{t}",{k}\n' for t, k in rows))
    r = analyze_csv(spark, str(p), "Remark", "Kind")
    found = {i["code"]: i for i in r["issues"]}
    assert {"exact_duplicates", "short_text_rows", "toxic_content"} <= set(found)
    same = found["exact_duplicates"]
    assert same["what_we_found"] == "3 of 6 rows (50.0 %) are in 1 groups of equal rows."
    assert same["plain_explanation"] == CATALOGUE["exact_duplicates"].plain != same["what_we_found"] != same["why_it_matters"]
    assert same["examples"][1] == 'row 2 (label="tools") text="The rake bends at once."' and len(same["examples"]) == 3
    flags = {x.row_id: set(x.flags) for x in r.flags.collect()}
    assert all("duplicate_exact" in flags[i] for i in (0, 2, 5)) and "short_text" in flags[3] and "toxic_text" in flags[4] and 1 not in flags
    assert r["score"]["overall"] == score.quality_score(r["modules"])["overall"] and r["meta"]["rows"] == 6
    n = r["summary"]
    assert n["critical_issues"] + n["warnings"] + n["info"] == len(r["issues"]) == sum(map(len, r["issue_groups"].values()))
    assert len(r["recommendations"]) <= len(r["issues"]) and json.loads(json.dumps(r.data, default=str))["report_version"] == 1


def test_every_issue_says_what_was_found(spark):
    assert all(isinstance(k, Known) and len({k.headline, k.plain, k.why, k.found}) == 4 for k in CATALOGUE.values())
    assert what_was_found(CATALOGUE["toxic_content"], {"rows": 8, "toxic_rows": 2, "toxic_fraction": 0.25}) == "2 of 8 rows (25.0%) were found toxic."
    assert what_was_found(CATALOGUE["toxic_content"], {}) is None


def test_report_looks_for_near_duplicates_in_all_rows(spark):
    words = " a longer text that says something about one subject of its own and about nothing else at all"
    data = [(f"n{i} " * 30 + words,) for i in range(5)] + [("alike " * 30 + words,), ("alike " * 30 + words + " x",)]
    df = spark.createDataFrame(data, "text string")
    assert analyze_dataset(spark, df, max_semantic_samples=2)["modules"]["duplicates"]["semantic_pairs"] == 0
    assert analyze_dataset(spark, df, max_semantic_samples=None)["modules"]["duplicates"]["semantic_pairs"] > 0


def test_table_report(spark):
    """30 bikes: one row twice but for the row id, one frame number with two prices."""
    data = [(f"frame{i}", i % 3, 100.0 + 10 * (i % 7), 20 + i % 5, 1.5 * (i % 4)) for i in range(28)]
    df = spark.createDataFrame([*data, data[3], ("frame9", 0, 999.0, 24, 1.5)], "frame string, gears int, price double, wheel int, rack double")
    r = generate(with_row_id(df), "note", None, key_columns=["frame", "gears"])
    m = r["modules"]
    assert r["meta"]["modality"]["modality"] == "tabular" and m["duplicates"]["mode"] == "tabular"
    assert m["duplicates"]["exact_duplicate_rows"] == 2 and m["duplicates"]["key_duplicate_rows"] == 4
    assert m["text_quality"]["ran"] is False and m["toxicity"]["ran"] is False
    assert {x.row_id: list(x.flags) for x in r.flags.filter(F.exists("flags", lambda f: f.startswith("duplicate"))).collect()}.keys() >= {3, 9, 28, 29}
    assert r["score"]["subscores"]["exact_duplicates"] == pytest.approx(100 - 260 * 2 / 30 - 140 * 4 / 30, abs=0.01)
    assert "treated as tabular dataset" in r["modality_explanation"]


def test_vector_cache(spark, tmp_path):
    df = spark.createDataFrame([(0, "some words here"), (1, None)], "_row_id bigint, text string")
    e = Embedder(cache="file://" + str(tmp_path))
    first, again = e.embed(df).collect(), e.embed(df).collect()
    assert sorted(first) == sorted(again) and len(list(tmp_path.iterdir())) == 1
    assert signature(df, "text") != signature(df.limit(1), "text")
