"""Streams end where the batch answer is, however the rows come in."""

import base64
import json

import pytest
from pyspark.sql import functions as F
from test_scenarios import _random_clauses, clause, clauses, product, world

from complyframe.operators import reconcile
from complyframe.schemas import PUSH_MESSAGES
from complyframe.sources import messages, storage
from complyframe.sources.fixtures import Tables
from complyframe.sources.tables import stream_of
from complyframe.streaming import stages
from complyframe.streaming.logs import ChangeLog, drain, drain_to_files


def delivered(data, name="delivery-7", **attributes):
    """One pushed row: the envelope around ``data``, which is base64 text or null."""
    return ((data, attributes, name, None), None)


def packed(text):
    return base64.b64encode(text.encode()).decode()


def test_envelopes(spark):
    """Good, traced, without data, unreadable in two ways, without a message, without an id: by delivery name."""
    rows = [
        delivered(packed(json.dumps({"document_id": "regulation 9"})), "plain"),
        delivered(packed("{}"), "traced", trace_id="journey 42"),
        delivered(None, "without data"),
        delivered(packed('["open'), "broken json"),
        delivered("not base64!", "broken base64"),
        (None, None),
        delivered(packed('{"name": "Käse"}'), None),
    ]
    got = {r["message_id"]: r for r in messages.decode(spark.createDataFrame(rows, PUSH_MESSAGES)).collect() if r["problem"] != "no_message"}
    assert len(got) == 6
    assert json.loads(got["plain"]["payload"])["document_id"] == "regulation 9" and got["plain"]["trace_id"] is None
    assert got["traced"]["trace_id"] == "journey 42" and got["without data"]["payload"] == "{}"
    assert {name: r["problem"] for name, r in got.items() if r["problem"]} == {"broken json": "bad_json", "broken base64": "bad_base64"}
    assert json.loads(got[""]["payload"]) == {"name": "Käse"}


def test_processed_messages_are_dropped_but_blank_ids_pass(spark):
    seen = spark.createDataFrame([("a",), ("b",), ("",)], "message_id STRING")
    done = spark.createDataFrame([("extract", "a"), ("other", "b"), ("extract", "")], "handler STRING, message_id STRING")
    assert sorted(r[0] for r in messages.unprocessed(seen, done, "extract").collect()) == ["", "b"]


def files(spark, df, n, tag):
    """The rows in n files, every row twice, in shuffled order."""
    folder = f"{storage.run_folder(spark)}/{tag}"
    doubled = df.unionByName(df).repartition(n, F.rand(4))
    doubled.write.parquet(folder)
    return folder


def test_redelivery_in_other_batches(spark):
    """First deliveries count however late they come, and null ids are never duplicates."""
    rows = [(f"m{i}", f"2026-01-{1 + i:02d} 00:00:00") for i in range(30)] + [("", "2026-01-05 00:00:00"), (None, "2026-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "message_id STRING, at STRING").withColumn("received_at", F.to_timestamp("at"))
    folder = storage.run_folder(spark)
    log = ChangeLog(spark, f"{folder}/log", ["marker"])

    def each(batch, number):
        for _ in range(2):
            stages.deduplicated(batch, "extract", log, number)

    drain(stream_of(spark, files(spark, df, 4, "in"), df.schema, files_per_batch=1), f"{folder}/cp", each)
    counts = {r["message_id"]: r["count"] for r in log.rows().groupBy("message_id").count().collect()}
    assert counts.pop("") == 2 and counts.pop(None) == 2 and set(counts.values()) == {1} and len(counts) == 30


def test_late_rows_count_in_their_window(spark):
    rows = [("2026-01-20 00:01:00", "a"), ("2026-01-20 00:02:00", "a"), ("2026-01-01 00:01:00", "a"), ("2026-01-02 00:01:00", "b")]
    df = spark.createDataFrame(rows, "at STRING, kind STRING").select(F.to_timestamp("at").alias("at"), "kind")
    folder = storage.run_folder(spark)
    log = ChangeLog(spark, f"{folder}/log", ["window_start", "kind"])
    stream = stream_of(spark, files(spark, df, 4, "in"), df.schema, files_per_batch=1)
    drain(stages.windowed_counts(stream, "at", "kind"), f"{folder}/cp", log.write, mode="update")
    assert sorted((str(r["window_start"]), r["kind"], r["n"]) for r in log.state().collect()) == [
        ("2026-01-01 00:00:00", "a", 2), ("2026-01-02 00:00:00", "b", 2), ("2026-01-20 00:00:00", "a", 4)]


def test_counts_over_batches_equal_the_batch(spark):
    df = spark.range(50).select((F.col("id") % 4).alias("user"))
    folder = storage.run_folder(spark)
    log = ChangeLog(spark, f"{folder}/log", ["user"])
    stream = stream_of(spark, files(spark, df, 3, "in"), df.schema, files_per_batch=1)
    drain(stages.failed_attempts(stream, "user"), f"{folder}/cp", log.write, mode="update")
    assert {tuple(r) for r in log.state().collect()} == {(0, 26, True), (1, 26, True), (2, 24, True), (3, 24, True)}


def state_of(spark, base, requests=(product(),)):
    places, _, ingredients = world(spark, *requests)
    folder = storage.run_folder(spark)
    compliance = stages.ComplianceState(spark, folder, places, ingredients)
    compliance.seed(base)
    return compliance, folder


def test_restart_reads_what_was_logged(spark):
    compliance, folder = state_of(spark, clauses(spark, clause("e1", "EU", "0.10")))
    pending = [clause(name, "EU", limit, day=day, status="pending_reconciliation")
               for name, limit, day in (("e2", "0.09", 5), ("e3", "0.05", 9))]
    compliance.on_clauses(clauses(spark, pending[0]), 1)
    again = stages.ComplianceState(spark, folder, compliance.places, compliance.ingredients)
    again.on_clauses(clauses(spark, pending[1]), 2)
    assert {(r["clause_id"], r["status"]) for r in again.clauses.state().collect()} == {
        ("e1", "superseded"), ("e2", "superseded"), ("e3", "active")}
    assert [tuple(r) for r in again.alerts().collect()] == [("p1", "market_de", "compliant", "non_compliant")]


def test_regulation_arrives_and_the_product_flips_once(spark):
    base = clauses(spark, clause("b", "ID_BPOM", "0.10"), clause("e1", "EU", "0.10"))
    compliance, folder = state_of(spark, base)
    new = clauses(spark, clause("e2", "EU", "0.05", day=9, status="pending_reconciliation"),
                  clause("weak", "EU", "0.01", day=9, doc_day=3, tier="0.2", status="pending_reconciliation"))
    stream = stream_of(spark, files(spark, new, 3, "in"), new.schema, files_per_batch=1)
    drain(stream, f"{folder}/cp", compliance.on_clauses)
    assert {(r["clause_id"], r["status"]) for r in compliance.clauses.state().select("clause_id", "status").collect()} == {
        ("b", "active"), ("e1", "superseded"), ("e2", "active"), ("weak", "needs_review")}
    assert [tuple(r) for r in compliance.alerts().collect()] == [("p1", "market_de", "compliant", "non_compliant")]
    events = {(r["event_type"], r["entity_id"]) for r in compliance.events.rows().collect()}
    assert events == {("clause_superseded", "e1"), ("clause_created", "e2"), ("clause_flagged_review", "weak"),
                      ("conflict_opened", "b:e2"), ("product_status_changed", "p1:market_de")}
    assert compliance.events.rows().count() == len(events)
    # The same batch again, and once more under a new number: nothing is added.
    compliance.on_clauses(new, 1)
    compliance.on_clauses(new, 900)
    assert {(r["event_type"], r["entity_id"]) for r in compliance.events.rows().collect()} == events


@pytest.mark.parametrize("batches", [1, 3])
def test_statuses_do_not_depend_on_batching(spark, batches):
    base = _random_clauses(spark, 40, 11, "a", "active")
    new = _random_clauses(spark, 40, 12, "n", "pending_reconciliation")
    # Without clauses of equal dates, which the first to come would decide.
    new = new.withColumn("document_date", F.date_add("document_date", (10 + F.substring("clause_id", 2, 3).cast("int")).cast("int")))
    compliance, folder = state_of(spark, base)
    stream = stream_of(spark, files(spark, new, batches, "in"), new.schema, files_per_batch=1)
    drain(stream, f"{folder}/cp", compliance.on_clauses)
    got = sorted(map(tuple, compliance.clauses.state().select("clause_id", "status").collect()))
    want = sorted(map(tuple, reconcile.verdicts(base.unionByName(new)).select("clause_id", "status").collect()))
    assert got == want


def test_a_clause_that_contradicts_a_replaced_one_goes_to_review(spark):
    """The clause of the same dates was superseded by a later one before the stream began."""
    base = clauses(spark, clause("e1", "EU", "0.10"), clause("e2", "EU", "0.20", day=5))
    new = clauses(spark, clause("e3", "EU", "0.05", status="pending_reconciliation"),
                  clause("e4", "EU", "0.10", day=7, status="pending_reconciliation"))
    settled = reconcile.verdicts(base).drop("was", "gated", "verdict", "supersedes", "superseded_by", "change").localCheckpoint()
    later = settled.where("status = 'active'").unionByName(new)
    rows = reconcile.verdicts(later, history=settled.where("status = 'superseded'")).select("clause_id", "status").collect()
    assert dict(map(tuple, rows)) == {"e2": "superseded", "e3": "needs_review", "e4": "active"}
    whole = reconcile.verdicts(base.unionByName(new)).where("clause_id <> 'e1'").select("clause_id", "status").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, whole))


def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path):
    """A table of several files is a folder of its name; both forms give all rows."""
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        seen = []
        live = Tables(spark, folder).streaming("documents").table("documents")
        drain(live, f"{storage.run_folder(spark)}/cp", lambda rows, n, seen=seen: seen.extend(r.doc_id for r in rows.collect()))
        assert sorted(seen) == sorted(r.doc_id for r in whole.collect())


def test_a_batch_that_moves_nothing_leaves_the_products_alone(spark, monkeypatch):
    """Delivered again later, a clause is known; no product is looked at, and the logs stay as they were."""
    places, _, ingredients = world(spark, product())
    compliance = stages.ComplianceState(spark, storage.run_folder(spark), places, ingredients, keep_requirements=True)
    compliance.seed(clauses(spark, clause("e1", "EU", "0.10")))
    new = clauses(spark, clause("e2", "EU", "0.01", day=9, status="pending_reconciliation"))
    compliance.on_clauses(new, 1)
    logs = (compliance.conflicts, compliance.status, compliance.events, compliance.requirements, compliance.requirement_events)
    before = [log.rows().count() for log in logs]
    monkeypatch.setattr(stages.impact, "affected_pairs", lambda *_: pytest.fail("looked at products"))
    compliance.on_clauses(new, 1001)
    assert [log.rows().count() for log in logs] == before


def test_the_chain_is_built_for_clauses_that_take_part(spark, monkeypatch):
    """Other kinds and gated clauses have no neighbours and are not sorted into chains."""
    seen, whole = [], reconcile.supersede_chain
    monkeypatch.setattr(reconcile, "supersede_chain", lambda rows, *keys: (seen.append(rows), whole(rows, *keys))[1])
    rows = clauses(spark, clause("e1", "EU", "0.10"), clause("e2", "EU", "0.05", day=9, status="pending_reconciliation"),
                   clause("label", "EU", None, kind="labeling", unit=None),
                   clause("weak", "EU", "0.01", day=10, tier="0.2", status="pending_reconciliation"))
    decided = {r["clause_id"]: r for r in reconcile.verdicts(rows).collect()}
    assert sorted(r["clause_id"] for r in seen[0].collect()) == ["e1", "e2"]
    assert {c: (r["status"], r["supersedes"], r["superseded_by"]) for c, r in decided.items()} == {
        "e1": ("superseded", None, "e2"), "e2": ("active", "e1", None), "label": ("active", None, None), "weak": ("needs_review", None, None)}
