import json

import pytest
from pyspark.sql import functions as F

from maskloom.operators.apply import apply_rules
from maskloom.operators.detect import Detector, detections, select_detectors
from maskloom.operators.profile import (
    examples_by_kind,
    files_by_kind,
    matches_by_kind,
    profile_report,
    profile_then_apply,
    suggest_rules,
    suggested_rules,
)

SECRETS = ["carol@example.com", "10.20.30.80", "abcdef1234567890", "s3cr3tvalue99", "4111 1111 1111 1111", "QUJDREVGR0hJSktMTU5PUFFSU1Q1"]
PROFILE = [
    f"mail {SECRETS[0]} from {SECRETS[1]}",
    f"Authorization: BEARER {SECRETS[2]}",
    f"token={SECRETS[3]} Api_Key = 'quoted123456'",
    f"card {SECRETS[4]} not 4111 1111 1111 1112",
    f"blob {SECRETS[5]} onlylettersonlylettersonlyletters 123456789012345678901234567",
    "é1.2.3.4 1.2.3.4é 999.1.1.1",
]


def found_in(lines, *texts, **options):
    rows = detections(lines(*texts), **options).orderBy("line_no", "det_no", "pos").collect()
    return [(r["kind"], r["masked_example"]) for r in rows]


def test_kinds_and_masks(lines):
    assert found_in(lines, *PROFILE) == [
        ("email", "c***@example.com"),
        ("ipv4", "10.***.***.80"),
        ("bearer_token", "Bearer abc-***7890"),
        ("kv_secret", "token=s3c-***ue99"),
        ("card_number", "**** **** **** 1111"),
        ("probable_token", "QUJ-***U1Q1"),
        ("ipv4", "999.***.***.1"),
    ]


def test_overlapping_kinds_both_count(lines):
    token = "Bearer abcdefghij0123456789abcdef"
    assert [k for k, _ in found_in(lines, token)] == ["bearer_token", "probable_token"]


def test_selection_and_order(lines):
    assert [k for k, _ in found_in(lines, "a@b.co 1.2.3.4", names=("ipv4", "email"))] == ["ipv4", "email"]
    with pytest.raises(ValueError):
        select_detectors(("email", "nope"))


def test_own_detector(lines):
    own = Detector("ticket", "ticket", lambda line: F.regexp_extract_all(line, F.lit(r"T-\d+"), F.lit(0)))
    assert found_in(lines, "T-1 and T-22", names=("ticket",), extra=(own,)) == [("ticket", "T-1"), ("ticket", "T-22")]


@pytest.mark.parametrize("digits, ok", [("4111111111111111", True), ("4111111111111112", False), ("4222222222222", True), ("411111111111", False)])
def test_card_numbers_need_a_checksum(lines, digits, ok):
    assert bool(found_in(lines, f"n {digits} n", names=("card",))) is ok


def spread_findings(spark):
    rows = [(f"f{i % 7}", i, f"user{i:04d}x@h{i % 40}.example.com 10.0.{i % 9}.{i % 5}") for i in range(400)]
    return spark.createDataFrame(rows, "path string, line_no bigint, line string").repartition(8)


def test_counts_files_and_first_examples(spark):
    df = spread_findings(spark)
    found = detections(df)
    assert {r["kind"]: r["n"] for r in matches_by_kind(found).collect()} == {"email": 400, "ipv4": 400}
    assert sum(r["n"] for r in files_by_kind(found).collect()) == 800
    ordered = sorted((r["kind"], r["path"], r["line_no"], r["pos"], r["masked_example"]) for r in found.collect())
    for k in (1, 5, 100, 0):
        expected = {}
        for kind, _, _, _, example in ordered:
            seen = expected.setdefault(kind, [])
            if len(seen) < k and example not in seen:
                seen.append(example)
        got = {}
        for r in examples_by_kind(found, k).orderBy("kind", "rank").collect():
            got.setdefault(r["kind"], []).append(r["masked_example"])
        assert got == {kind: seen for kind, seen in expected.items() if seen}


def test_first_examples_are_cut_before_the_shuffle(spark):
    plan = examples_by_kind(detections(spread_findings(spark)), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_report_has_all_sections_and_no_raw_value(spark, lines):
    df = lines(*PROFILE)
    report = profile_report(detections(df), df.select("path"), generated_at="2024-01-01T00:00:00Z").collect()
    sections = {r["section"] for r in report}
    assert sections == {
        "version", "generated_at", "detectors", "files_scanned", "matches_by_kind", "files_by_kind",
        "masked_examples_by_kind", "suggested_rules",
    }
    text = json.dumps([r.asDict() for r in report])
    assert not any(secret in text for secret in SECRETS)
    assert [r["n"] for r in report if r["section"] == "files_scanned"] == [1]
    kinds = [r["kind"] for r in sorted((r for r in report if r["section"] == "suggested_rules"), key=lambda r: r["rank"])]
    assert kinds == ["email", "ipv4", "bearer_token", "kv_secret", "card_number", "probable_token"]


def test_detections_drop_the_raw_value(lines):
    text = str(detections(lines(*PROFILE)).collect())
    assert not any(secret in text for secret in SECRETS)


def test_suggested_rules_hide_what_was_found(lines):
    df = lines(*PROFILE)
    found = detections(df)
    assert [r["kind"] for r in suggest_rules(matches_by_kind(found)).collect()][:2] == ["email", "ipv4"]
    out = [r["line_out"] for r in profile_then_apply(df, found).orderBy("line_no").collect()]
    assert not any(secret in text for secret in SECRETS for text in out)
    assert out[0] == "mail c****@example.com from 10.***.***.80"
    assert out == [r["line_out"] for r in apply_rules(df, suggested_rules(matches_by_kind(found))).orderBy("line_no").collect()]


def test_nothing_found_changes_nothing(lines):
    df = lines("plain")
    assert profile_then_apply(df, detections(df)).first()["line_out"] == "plain"


def test_one_row_group_is_scanned_by_many_tasks(spark, tmp_path, monkeypatch):
    import pandas as pd
    from maskloom.plans import tables
    from maskloom.plans.detecting import scan_lines

    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    day = pd.Timestamp("2024-01-01")
    rows = {
        "documents": {"doc_id": [1], "source": ["s"], "text": ["a"]},
        "conversations": {"conv_id": [1], "turn": [1], "text": ["b"]},
        "pages": {"page_id": [1], "html": ["c"]},
        "events": {"event_id": range(500), "user_id": [1] * 500, "event_type": ["t"] * 500, "ts": [day] * 500},
        "orders": {"o_orderkey": [7, None] * 500, "o_custkey": [3] * 1000},
    }
    for name, columns in rows.items():
        pd.DataFrame(columns).astype({"o_orderkey": "Int64"} if name == "orders" else {}).to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    found = scan_lines(spark, str(tmp_path))
    assert found.count() == 3 + 500 + 1000
    for kind, n in (("user-", 500), ("cust-", 1000)):
        parts = found.where(F.startswith("path", F.lit(kind))).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == n
        assert max(r["count"] for r in parts) <= 200
