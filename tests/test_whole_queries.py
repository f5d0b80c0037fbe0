"""Queries that do the whole job where an older one, kept with its SQL, does a part of it."""

from datetime import datetime, timezone

from recallspark.queries import reference


def test_passages_are_whole(spark, tmp_path):
    start = "The harbour desk counted forty lanterns. "
    items = [(1, start + "Then the tower fell silent."), (2, start + "Then the ballad began."), (3, "never seen")]
    docs = [(1, "x " + items[0][1].upper()), (2, items[0][1] + " y"), (3, start + "Nothing else."), (4, start + "Then the ballad began."), (5, None)]
    spark.createDataFrame(items, "item_id long, item_text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in reference.r_g03_x09_passage_df(spark, str(tmp_path)).collect()]
    assert got == [(1, 2)]


def test_cutoffs_are_instants(spark, tmp_path):
    kinds = [("a", "Europe/Berlin", "DMY"), ("recent_patch", "UTC", "MDY")]
    rows = [
        ("c1", "a", True, "2024-05-30T10:00:00Z"), ("c1", "a", True, "01.06.2024 01:30"), ("c2", "a", True, "20240601 120000"), ("c3", "a", True, "3/6/2024 08:00:00"),
        ("c4", "a", True, "no date"), ("c5", "a", False, "2024-07-01T00:00:00Z"), ("c6", "recent_patch", True, "9/1/2024 00:00:00"),
    ]
    at = datetime(2025, 1, 1)
    spark.createDataFrame(kinds, "source_kind string, zone_name string, date_order string").write.parquet(f"{tmp_path}/source_profiles.parquet")
    spark.createDataFrame([(*r, at) for r in rows], "conversation_id string, source_kind string, verified boolean, source_cutoff_at string, imported_at timestamp_ntz").write.parquet(f"{tmp_path}/records_v1.parquet")
    ladder = {r.state: r.n for r in reference.r_m16_coverage_ladder_instants(spark, str(tmp_path)).collect()}
    assert ladder == {"outside_verified_cutoff": 1, "within_verified_cutoff": 3, "verified_cutoff_unknown": 2}
    (one,) = reference.r_g01_coverage_instants(spark, str(tmp_path)).collect()
    assert one.verified_cutoff == int(datetime(2024, 6, 3, 6, tzinfo=timezone.utc).timestamp()) * 1_000_000 and one.n_records == 7 and one.has_recent_patch


def test_all_labels_and_exclusions(spark, tmp_path):
    rows = [
        ("As we said, please remember it", "retelling,reminder", None), ("Damals war es so", "historical_reference", None), ("他说“好”", "quoted_or_original", None), ("C'est faux", "correction", None),
        ("补充一点", "explicit_detail_addition", None), ("En résumé, tout va bien", "summary", None), ("Es wird regnen", "plan", "future"), ("warum nicht", "question", "negated"), ("plain", "direct", None),
        ("un cuento nuevo", "direct", "creative"), ("Ojalá llueva", "direct", "hypothetical"), ("wollen wir los", "direct", "invitation"), ("我陪着你吃饭", "direct", "companion"), ("recuerda", "reminder", None), (None, "direct", None),
    ]
    spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id long, content string").write.parquet(f"{tmp_path}/records_v1.parquet")
    labels = {r.id: r.label for r in reference.r_m07_all_labels(spark, str(tmp_path)).collect()}
    assert labels == {i: r[1] for i, r in enumerate(rows)}
    reasons = {r.id: r.reason for r in reference.r_x13_all_exclusions(spark, str(tmp_path)).collect()}
    assert reasons == {i: r[2] for i, r in enumerate(rows) if r[0] is not None}


def test_timelines_read_texts_and_keep_corrections(spark, tmp_path):
    texts = {0: "It was set down at 2024-03-01T00:00:00Z.", 10: "That is not true."}
    docs = [(i, "k", datetime(2024, 1, 1 + i), texts.get(i, "x")) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, doc_kind string, captured_at timestamp_ntz, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = [*range(1, 20), 0]
    got = {r.doc_id: r.node for r in reference.r_m06_w05_text_timeline(spark, str(tmp_path)).collect()}
    assert got == {k: n for n, k in enumerate(order, 1) if n <= 6 or n > 14 or k == 10}
    spark.createDataFrame([("a", "UTC", "DMY")], "source_kind string, zone_name string, date_order string").write.parquet(f"{tmp_path}/source_profiles.parquet")
    records = [(k, "c", "a", f"2024-01-{1 + k:02d}T00:00:00Z", texts.get(k, "x"), "g" if k == 12 else None) for k in range(20)]
    spark.createDataFrame(records, "id long, conversation_id string, source_kind string, created_at string, content string, conflict_group_id string").write.parquet(f"{tmp_path}/records_v1.parquet")
    got = {r.id: r.node for r in reference.r_m06_w05_record_timeline(spark, str(tmp_path)).collect()}
    assert got == {k: n for n, k in enumerate(order, 1) if n <= 6 or n > 14 or k in (10, 12)}
