"""Behaviour of the archive operators on hand-built rows."""

import itertools
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lettermill.operators import aggregates as agg, duplicates as dup, filters as flt, mutations as mut, search as srch
from lettermill.operators.components import connected_components
from lettermill.operators.ingest import dedup_messages
from lettermill.plans import archive_queries, mailview as V, views
from lettermill.plans.queries import QUERIES
from lettermill.schemas import ASSETS, ATTACHMENTS, CONTACTS, EMAILS, IGNORES, JOBS, LINKS, SEARCH_DOCS, SESSIONS, SOURCES, Archive


def frame(spark, schema, rows):
    names = spark.createDataFrame([], schema).schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def mails(spark, rows):
    base = {"ingestion_source_id": "s1", "import_source": "s1", "sent_at": 1, "archived_at": 1, "sender_email": "a@x", "tags": [], "size_bytes": 10, "duplicate_subject_hash": "sub", "duplicate_body_hash": "body", "duplicate_recipient_fingerprint": "to"}
    return frame(spark, EMAILS, [{**base, "storage_hash_sha256": r["id"], **r} for r in rows])


def groups_of(spark, rows, links=(), attachments=(), ignored=()):
    members = dup.cluster_members(mails(spark, rows), frame(spark, LINKS, links), frame(spark, ATTACHMENTS, attachments), frame(spark, IGNORES, [{"fingerprint": f, "created_at": 1} for f in ignored]))
    return {(r["class"], tuple(sorted(r.members)), r.keeper) for r in dup.duplicate_groups(members).collect()}


def test_components_on_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(7, 7), (None, 1)]
    label = {i: i for e in edges for i in e if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: label[i] for i in got} and len(got) == len({i for a, b in edges if a is not None and a != b for i in (a, b)})
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_same_message_in_two_sources_is_exact(spark):
    rows = [{"id": "a", "message_id_header": "<M>", "sent_at": 5}, {"id": "b", "message_id_header": "<m>", "ingestion_source_id": "s2", "sent_at": 5}]
    assert groups_of(spark, rows) == {("exact", ("a", "b"), "a")}


def test_other_recipient_no_group_other_id_likely(spark):
    rows = [{"id": "a", "message_id_header": "<1>"}, {"id": "b", "message_id_header": "<2>", "duplicate_recipient_fingerprint": "else"}]
    assert groups_of(spark, rows) == set()
    rows[1] = {"id": "b", "message_id_header": "<2>"}
    assert groups_of(spark, rows) == {("likely", ("a", "b"), "a")}


def test_attachment_name_differs_is_likely_and_suppresses_exact(spark):
    rows = [{"id": i, "message_id_header": "<1>"} for i in "abc"]
    links = [{"email_id": i, "attachment_id": f"t{i}"} for i in "abc"]
    files = [{"id": f"t{i}", "filename": n, "content_hash_sha256": "h", "size_bytes": 1} for i, n in (("a", "x"), ("b", "x"), ("c", "y"))]
    assert groups_of(spark, rows, links, files) == {("likely", ("a", "b", "c"), "a")}
    assert groups_of(spark, rows, links, files, ["a"]) == set()


def test_chain_over_both_edge_kinds_and_trash(spark):
    rows = [
        {"id": "a", "storage_hash_sha256": "h1", "message_id_header": "<1>", "duplicate_body_hash": None}, {"id": "b", "storage_hash_sha256": "h1", "message_id_header": "<2>", "duplicate_body_hash": "q"},
        {"id": "c", "storage_hash_sha256": "h2", "message_id_header": "<2>", "duplicate_body_hash": "q"}, {"id": "d", "storage_hash_sha256": "h2", "message_id_header": None, "duplicate_body_hash": "z"},
        {"id": "e", "storage_hash_sha256": "h2", "deleted_at": 3, "duplicate_body_hash": "z"},
    ]
    assert groups_of(spark, rows) == {("exact", ("a", "b", "c", "d"), "a")}


def test_approvals(spark):
    emails = mails(spark, [{"id": i} for i in "abcd"])
    decisions = spark.createDataFrame([("a", ["a", "b", "b"]), ("gone", ["c"])], "keeper string, delete array<string>")
    after, outcome = dup.approve_groups(emails, decisions, 9)
    assert {r.id: r.deleted_at for r in after.collect()} == {"a": None, "b": 9, "c": None, "d": None} and outcome.count() == 1
    rows = [{"id": "a", "message_id_header": "<1>"}, {"id": "b", "message_id_header": "<1>"}, {"id": "c", "message_id_header": "<3>", "sent_at": 7}, {"id": "d", "message_id_header": "<4>", "sent_at": 7}]
    emails = mails(spark, rows)
    members = dup.cluster_members(emails, frame(spark, LINKS, []), frame(spark, ATTACHMENTS, []), frame(spark, IGNORES, []))
    after, _ = dup.approve_all_exact(emails, members, 9)
    assert {r.id for r in after.where("deleted_at = 9").collect()} == {"b"}
    ledger, new = dup.ignore_groups(frame(spark, IGNORES, [{"fingerprint": "x", "created_at": 1}]), spark.createDataFrame([("cluster:x",), ("cluster:y",), ("y",)], "fingerprint string"), 5)
    assert new.count() == 1 and ledger.count() == 2


def archive(spark):
    emails = mails(spark, [{"id": "a", "deleted_at": 1, "storage_path": "pa"}, {"id": "b", "storage_path": "pb", "ingestion_source_id": "s2"}, {"id": "c", "storage_path": "pc"}])
    links = frame(spark, LINKS, [{"email_id": e, "attachment_id": t} for e, t in (("a", "t1"), ("a", "t2"), ("b", "t1"))])
    files = frame(spark, ATTACHMENTS, [{"id": t, "filename": f"{t}.pdf", "storage_path": f"p{t}", "content_hash_sha256": t, "size_bytes": 1} for t in ("t1", "t2")])
    sources = frame(spark, SOURCES, [{"id": s, "name": s.upper(), "provider": "mbox_import", "status": st, "merged_into_id": m, "created_at": k, "updated_at": k} for k, (s, st, m) in enumerate((("s1", "imported", None), ("s2", "imported", "s1"), ("s3", "error", None)))])
    docs = frame(spark, SEARCH_DOCS, [{"email_id": i, "subject": i} for i in "abc"])
    return Archive.empty(spark, emails=emails, links=links, attachments=files, sources=sources, docs=docs)


def test_trash_and_delete(spark):
    t = archive(spark)
    ids = spark.createDataFrame([("a",), ("b",), ("zz",)], "id string")
    after, outcome = mut.soft_delete(t.emails, ids, 9)
    assert {r.id: r.deleted_at for r in after.collect()} == {"a": 1, "b": 9, "c": None}
    assert {r.id: r.error for r in outcome.collect()} == {"a": None, "b": None, "zz": mut.NOT_FOUND}
    assert mut.restore(t.emails, ids)[0].where("deleted_at is not null").count() == 0
    left, orphans, _ = mut.empty_trash(t)
    assert {r.id for r in left.attachments.collect()} == {"t1"} and {r.storage_path for r in orphans.collect()} == {"pa", "pt2"}
    assert {r.id for r in left.emails.collect()} == {"b", "c"} == {r.email_id for r in left.docs.collect()} and left.links.count() == 1
    left, orphans = mut.delete_source(t, "s1")
    assert left.emails.count() == 0 and {r.id for r in left.sources.collect()} == {"s3"} and orphans.count() == 5
    assert {r.id for r in mut.drop_emptied_sources(t).sources.collect()} == {"s1", "s2"}


def test_filters_and_merge_groups(spark):
    t = archive(spark)
    ids = lambda **p: {r.id for r in flt.filter_emails(t.emails, t.sources, t.links, t.attachments, **p).collect()}
    assert ids(source_id="s2") == {"b", "c"} and ids(source_id="nope") == set() and ids(trashed="true") == {"a"}
    assert ids(exts=["PDF"]) == {"b"} and ids(exts=["p*"]) == {"b", "c"} and ids(sent_after="garbage") == {"b", "c"}
    assert {r.id: r.merged_into_id for r in mut.merge_into(t.sources, "s3", "s2").collect()}["s3"] == "s1"
    assert mut.unmerge(t.sources, "s2").where("merged_into_id is not null").count() == 0


def test_pages_are_disjoint(spark):
    emails = mails(spark, [{"id": f"m{k}"} for k in range(7)])
    pages = [[r.id for r in flt.paginate(flt.sort_emails(emails), p, 3).collect()] for p in (1, 2, 3, 4)]
    assert list(itertools.chain(*pages)) == [f"m{k}" for k in range(7)] and pages[3] == []


def test_search(spark):
    rows = [("1", "Quick brown fox", "lazy dogs", "ann@x Ann", "", "", "inbox"), ("2", "lazy", "the quick-brown fox", "bob@x", "", "", ""), ("3", "résumé", "brown quick", "", "", "", "Élan")]
    docs = spark.createDataFrame(rows, SEARCH_DOCS)
    postings = srch.build_postings(docs)
    find = lambda q, **k: {r.email_id for r in srch.match(postings, q, **k).collect()}
    assert find("quick lazy") == {"1", "2"} and find("quick lazy", fields=["subject"]) == set() and find("qui") == {"1", "2", "3"}
    assert find("quick-brown") == {"1", "2"} and find("RESUME") == {"3"} and find("elan", fields="tags") == {"3"} and find("qui lazy") == set()
    assert find('"" --') == set() and srch.match(postings, "  ") is None and find("fox -- quick") == {"1", "2"}
    fallback = lambda q, **k: {r.email_id for r in srch.match_with_fallback(postings, q, **k).collect()}
    assert fallback("fox resume") == {"1", "2", "3"} and fallback("fox resume", strategy="all") == set()
    both = srch.match_clauses(postings, {"subject": "lazy", "sender": "ann"}, "any")
    assert {r.email_id for r in both.collect()} == {"1", "2"} and srch.match_clauses(postings, {"subject": "lazy", "sender": "ann"}).count() == 0
    scores = {r.email_id: r.score for r in srch.bm25(srch.match(postings, "quick"), postings, srch.doc_lengths(docs), "quick").collect()}
    assert set(scores) == {"1", "2", "3"} and all(s < 0 for s in scores.values())
    moved = srch.reindex_meta(postings, spark.createDataFrame([("1", "archive")], "email_id string, meta string"))
    assert moved.where("term = 'inbox'").count() == 0 and moved.where("term = 'archive'").count() == 1
    assert srch.reindex(postings, docs.where("email_id <> '1'"), spark.createDataFrame([("1",)], "id string")).where("email_id = '1'").count() == 0


def test_listing_view(spark):
    t = archive(spark)
    postings, lengths = srch.build_postings(t.docs), srch.doc_lengths(t.docs)
    page, total = views.list_emails(t, postings, lengths, query="b c", limit=1)
    assert total == 2 and page.count() == 1
    page, total = views.list_emails(t, sort="subject", direction="asc")
    assert [r.id for r in page.collect()] == ["b", "c"] and total == 2
    detail = views.email_detail(t, ["b"]).first()
    assert detail.source.name == "S2" and [a.filename for a in detail.attachments] == ["t1.pdf"]
    assert {r.id: r.group_status for r in views.list_sources(t).collect()} == {"s1": "active", "s2": "active", "s3": "error"}


def test_tag_edit(spark):
    emails = mails(spark, [{"id": "a", "tags": ["Old"]}, {"id": "b", "tags": ["new"]}])
    after, changed = mut.update_tags(emails, ["a", "b", "a"], ["New"], ["old"])
    assert {r.id: r.tags for r in after.collect()} == {"a": ["New"], "b": ["new"]} and [r.id for r in changed.collect()] == ["a"]
    with pytest.raises(ValueError):
        mut.update_tags(emails, [f"x{k}" for k in range(1001)], ["t"], [])


def test_message_dedup_and_folders(spark):
    sources = frame(spark, SOURCES, [{"id": "s1"}, {"id": "s2", "merged_into_id": "s1"}])
    rows = [("n1", "s1", "<k>", "a.mbox", 2), ("n2", "s2", "<k>", "a.mbox", 1), ("n3", "s1", "<old>", "a.mbox", 3), ("n4", "s1", None, "a.mbox", 4)]
    incoming = spark.createDataFrame(rows, "id string, ingestion_source_id string, message_key string, input_path string, ordinal long")
    known = spark.createDataFrame([("e1", "s2", "<old>")], "id string, ingestion_source_id string, provider_message_id string")
    got = {r.id: (r.status, r.survivor_id) for r in dedup_messages(incoming, known, sources).collect()}
    assert got == {"n1": ("duplicate", "n2"), "n2": ("archived", "n2"), "n3": ("duplicate", "e1"), "n4": ("failed", None)}
    survivors = spark.createDataFrame([("n2", ["Inbox"])], "id string, tags array<string>")
    copies = spark.createDataFrame([("n2", "Work", 2), ("n2", "Inbox", 1), ("n2", "Work", 3)], "id string, path string, ordinal long")
    assert mut.merge_folder_tags(survivors, copies).first().tags == ["Inbox", "Work"]


def test_contacts_and_assets(spark):
    old = frame(spark, CONTACTS, [{"id": "1", "email": "a@x", "display_name": "A"}, {"id": "2", "email": "b@x", "display_name": "B"}])
    parsed = spark.createDataFrame([("a@x", "A", 0), ("b@x", "no", 1), ("b@x", "BB", 2), ("c@x", "C", 3)], "email string, display_name string, ordinal long")
    merged, counts = mut.upsert_contacts(old, parsed)
    assert {r.email: r.display_name for r in merged.collect()} == {"a@x": "A", "b@x": "BB", "c@x": "C"} and tuple(counts.first()) == (4, 1, 1, 1)
    assets = frame(spark, ASSETS, [{"id": "1", "email_id": "e", "original_url": "http://emltrk.com/a", "url_hash": "h1", "status": "failed"}, {"id": "2", "email_id": "e", "original_url": "http://x.example/b", "url_hash": "h2", "status": "archived"}])
    outcomes = frame(spark, ASSETS, [{"email_id": "e", "url_hash": "h1", "status": "blocked"}, {"email_id": "e", "url_hash": "h2", "status": "failed"}, {"email_id": "e", "url_hash": "h3", "original_url": "u", "status": "archived"}])
    after = {r.url_hash: r for r in mut.upsert_assets(assets, outcomes).collect()}
    assert {k: r.status for k, r in after.items()} == {"h1": "blocked", "h2": "archived", "h3": "archived"} and after["h1"].id == "1" and after["h3"].id
    left, emails = mut.sweep_tracking_assets(assets, mails(spark, [{"id": "e", "remote_content_status": "partial"}]))
    assert left.count() == 1 and emails.first().remote_content_status == "archived"
    assert agg.remote_status(assets).first().status == "partial"


def test_sessions_and_jobs(spark):
    sessions = frame(spark, SESSIONS, [{"id": "x", "ingestion_source_id": "s1", "is_initial_import": True, "total_mailboxes": 2, "completed_mailboxes": 0, "failed_mailboxes": 0, "error_messages": [], "last_activity_at": 0}])
    sources = frame(spark, SOURCES, [{"id": "s1", "status": "importing", "provider": "mbox_import"}, {"id": "s2", "status": "active"}])
    left, moved = mut.clean_stale_sessions(sessions, sources, 1_800_001)
    assert left.count() == 0 and {r.id: r.status for r in moved.collect()} == {"s1": "error", "s2": "active"}
    log = spark.createDataFrame([("x", True, None), ("x", False, "bad")], "session_id string, ok boolean, error string")
    done = agg.session_progress(sessions, log)
    assert done.first().last and done.first().error_messages == ["bad"]
    final = {r.id: r for r in mut.finalize_import(sources, done.drop("last"), 5).collect()}
    assert final["s1"].status == "error" and final["s1"].last_import_status_message == "Import finished with 1 error(s):\nbad" and final["s2"].status == "active"
    jobs = frame(spark, JOBS, [{"id": "1", "queue": "ingestion", "state": "waiting", "run_at": 5, "created_at": 1}, {"id": "2", "queue": "ingestion", "state": "waiting", "run_at": 50, "created_at": 1}])
    assert {r.queue: (r.waiting, r.delayed) for r in agg.queue_counts(jobs, 10).collect()} == {"ingestion": (1, 1), "indexing": (0, 0), "remote-content": (0, 0)}
    with pytest.raises(ValueError):
        flt.job_status(jobs, "odd", 1)


def test_results_do_not_depend_on_partitions(spark):
    rows = [{"id": f"m{k}", "message_id_header": f"<{k % 5}>", "sent_at": k % 5} for k in range(20)]
    emails = mails(spark, rows)
    none = frame(spark, LINKS, []), frame(spark, ATTACHMENTS, []), frame(spark, IGNORES, [])
    got = [sorted(map(str, dup.duplicate_groups(dup.cluster_members(e, *none)).collect())) for e in (emails.coalesce(1), emails.repartition(8))]
    assert got[0] == got[1]
    assert emails.agg(F.count("*")).first()[0] == 20


def test_filters_by_presence_join_each_key_once(spark):
    from lettermill.operators import joins as jn, mutations as mut
    from lettermill.plans import mailview as V
    from lettermill.plans.archive_queries import semi_and_anti

    rows, keys = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    assert sorted(r.id for r in jn.semi_filter(rows, keys, "id").collect()) == [1, 2]
    assert [r.id for r in jn.anti_filter(rows, keys, ["id"]).collect()] == [3]
    plan = semi_and_anti(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan  # links were grouped by both their ends
    assert mut.dedup_links(V.link_rows(spark, "/root/testdata/sf0.001")).count() == V.links(spark, "/root/testdata/sf0.001").count()


def test_attachment_dedup_deals_links_over_all_partitions(spark):
    # joined by adaptive execution they were one partition, and the table of attachments stood in every task
    assert V.links(spark, SF, "attachment_id").rdd.getNumPartitions() == 4
    plan = QUERIES["attachment_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_emptied_trash_reads_links_once(spark):
    plan = QUERIES["empty_trash_orphans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1


def test_pages_of_a_small_file_are_dealt(spark):
    assert archive_queries._urls(spark, SF).rdd.getNumPartitions() == 4
