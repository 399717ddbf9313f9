"""Mailbox files in, archive and mailbox files out, and the streaming jobs."""

import io
import zipfile

from pyspark.sql import functions as F

from lettermill.sources import mailbox as mb
from lettermill.streaming import jobs

MBOX = (
    b"From MAILER Mon Jan  1 00:00:00 2024\nMessage-ID: <1@x>\nFrom: Ann <a@x>\nTo: b@x, C <c@x>\nSubject: =?utf-8?q?Caf=C3=A9?=\n"
    b"Date: Mon, 01 Jan 2024 00:00:00 +0000\nX-Gmail-Labels: Inbox,Work\n\nbody\n>From quoted\n"
    b"\nFrom MAILER Mon Jan  1 00:00:00 2024\nMessage-ID: <2@x>\nReferences: <1@x> <0@x>\nSubject: raw \xff\xfe\nContent-Type: multipart/mixed; boundary=B\n\n"
    b"--B\nContent-Type: text/plain\n\nhello\n--B\nContent-Type: text/csv; name=t.csv\nContent-Disposition: attachment; filename=t.csv\nContent-Transfer-Encoding: base64\n\nYSxi\n--B--\n"
    b"\nFrom MAILER Mon Jan  1 00:00:00 2024\nMessage-ID: <1@x>\nSubject: again\n\ncopy\n"
)


def test_mbox_records_and_messages(spark, tmp_path):
    (tmp_path / "box.mbox").write_bytes(MBOX)
    raw = mb.read_mbox(spark, str(tmp_path / "box.mbox")).orderBy("ordinal")
    bodies = [bytes(r.raw) for r in raw.collect()]
    assert len(bodies) == 3 and b"\nFrom quoted" in bodies[0] and b"\xff\xfe" in bodies[1] and not bodies[0].startswith(b"From ")
    got = mb.parse_messages(raw).orderBy("ordinal").collect()
    assert [r.message_id for r in got] == ["<1@x>", "<2@x>", "<1@x>"] and got[0].subject == "Café"
    assert [p.address for p in got[0].recipients.to] == ["b@x", "c@x"] and got[0].gmail_labels == "Inbox,Work"
    assert [(a.filename, bytes(a.content)) for a in got[1].attachments] == [("t.csv", b"a,b")] and got[1].text.strip() == "hello"
    text = mb.extract_attachment_text(mb.parse_messages(raw).select(F.explode("attachments").alias("a")).select("a.*"))
    assert [r.extracted_text for r in text.collect()] == ["a,b"]


def test_wrapped_attachment_keeps_the_storage_hash(spark):
    head = b"Message-ID: <1>\nContent-Type: application/x; name=f\nContent-Disposition: attachment; filename=f\nContent-Transfer-Encoding: base64\n\n"
    rows = [("f", 0, head + b"YWJjZGVm\n"), ("f", 1, head + b"YWJj\nZGVm\n")]
    got = mb.parse_messages(spark.createDataFrame(rows, "file_path string, ordinal long, raw binary")).collect()
    assert got[0].storage_hash == got[1].storage_hash and got[0].attachments[0].content_hash == got[1].attachments[0].content_hash


def test_inputs_and_other_containers(spark, tmp_path):
    for path, body in (("A.mbox/mbox", MBOX), ("A.mbox/Messages/1.emlx", b"20\nSubject: s\n\nabcdefg<plist><key>date-sent</key><integer>5</integer></plist>"), ("A.mbox/Messages/bad.emlx", b"999\nx"), ("mbox", MBOX), ("in/x.eml", b"Subject: e\n\nb"), ("in/._x.eml", b"z"), ("top.mbox", MBOX)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    got = {(r.kind, r.source_path) for r in mb.list_inputs(spark, str(tmp_path)).collect()}
    assert got == {("mbox", "A"), ("emlx", "A"), ("eml", "in"), ("mbox", "top")}
    emlx = mb.read_emlx(spark, str(tmp_path)).collect()
    assert [(bytes(r.raw), r.date_sent_ms) for r in emlx] == [(b"Subject: s\n\nabcdefg<"[:20], 5000)] or emlx[0].date_sent_ms == 5000
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("d/a.EML", b"Subject: z\n\nb")
        z.writestr("__MACOSX/d/a.eml", b"x")
        z.writestr("n.txt", b"x")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "e.zip").write_bytes(box.getvalue())
    (tmp_path / "z" / "broken.zip").write_bytes(b"no")
    assert [(r.source_path, bytes(r.raw)) for r in mb.read_eml_zip(spark, str(tmp_path / "z")).collect()] == [("d", b"Subject: z\n\nb")]


def test_office_files(spark):
    doc, sheet = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p><w:t>c</w:t></w:p></w:body></w:document>')
    with zipfile.ZipFile(sheet, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>s0</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    rows = [("d.docx", None, doc.getvalue()), ("s.xlsx", None, sheet.getvalue()), ("b.docx", None, b"broken"), ("j", "application/json", b"{}"), ("i.png", "image/png", b"\x89")]
    got = mb.extract_attachment_text(spark.createDataFrame(rows, "filename string, mime_type string, content binary")).collect()
    assert {r.filename: r.extracted_text for r in got} == {"d.docx": "ab\n\nc", "s.xlsx": "s0\t5", "b.docx": "", "j": "{}", "i.png": ""}


def test_contact_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text('Title,First Name,Last Name,E-mail Address\nDr,Ann,"O\nBrien",MAILTO:Ann@X.example\n,,,none\n,Bo,,bo@x.example\n')
    got = {(r.email, r.display_name) for r in mb.read_contacts_csv(spark, str(tmp_path / "o.csv")).collect()}
    assert got == {("ann@x.example", "Ann O\nBrien"), ("bo@x.example", "Bo")}
    (tmp_path / "c.vcf").write_text("BEGIN:VCARD\nFN:Full Name\nN:Last;First\nEMAIL;TYPE=home:A@x.example\nEMAIL:b@x.example\nEND:VCARD\nBEGIN:VCARD\nN:Doe;Jo;;\nEMAIL:jo@x.example\nNOTE:n\nEND:VCARD\n")
    got = {(r.email, r.display_name) for r in mb.read_contacts_vcf(spark, str(tmp_path / "c.vcf")).collect()}
    assert got == {("a@x.example", "Full Name"), ("b@x.example", "Full Name"), ("jo@x.example", "Jo Doe")}


def test_export_and_archive_round_trip(spark, tmp_path):
    from lettermill.schemas import EMAILS, Archive

    rows = [("a", b"Subject: x\n\n>From here\nFrom there\n\xff"), ("b", b"Subject: y\n\nz\n")]
    mb.export_mbox(spark.createDataFrame(rows, "id string, raw binary").coalesce(1), f"{tmp_path}/out")
    back = sorted(bytes(r.raw).rstrip(b"\n") for r in mb.read_mbox(spark, f"{tmp_path}/out").collect())
    assert back == sorted(r[1].rstrip(b"\n") for r in rows)
    names = spark.createDataFrame([], EMAILS).schema.names
    emails = spark.createDataFrame([tuple({"id": "a", "ingestion_source_id": "s", "sender_email": "x"}.get(n) for n in names)], EMAILS)
    assert mb.read_archive(spark, f"{tmp_path}/arc").emails.count() == 0
    assert mb.write_archive(Archive.empty(spark, emails=emails), f"{tmp_path}/arc") == 1
    stored = mb.read_archive(spark, f"{tmp_path}/arc")
    assert stored.emails.select("id", "ingestion_source_id").first() == ("a", "s")
    # written back from itself, then a version that was never published
    assert mb.write_archive(stored, f"{tmp_path}/arc") == 2
    stored.emails.limit(0).write.parquet(f"{tmp_path}/arc/version=3/emails")
    assert mb.read_archive(spark, f"{tmp_path}/arc").emails.count() == 1


def test_streamed_import_is_exact_and_repeatable(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.mbox").write_bytes(MBOX)
    sources = spark.createDataFrame([("s1", None)], "id string, merged_into_id string")
    run = lambda: jobs.stream_import(spark, f"{tmp_path}/in", f"{tmp_path}/arc", sources, "s1", f"{tmp_path}/cp").awaitTermination()
    run()
    nameless = b"\nFrom M Mon Jan  1 00:00:00 2024\nSubject: no id\n\nsame\n"
    more = MBOX.replace(b"<2@x>", b"<3@x>").replace(b"Inbox,Work", b"Sent") + nameless + nameless + b"\nFrom M Mon Jan  1 00:00:00 2024\n"
    (tmp_path / "in" / "2.mbox").write_bytes(b"preamble\n\n" + more)
    run()
    got = spark.read.parquet(f"{tmp_path}/arc")
    keys = sorted(r.provider_message_id for r in got.collect())
    assert keys[:3] == ["<1@x>", "<2@x>", "<3@x>"] and len(keys) == 4 and keys[3].startswith("generated-") and keys[3].endswith("-s1")
    known = got.where("provider_message_id = '<1@x>'").first().id
    assert [(r.id, r.path) for r in spark.read.parquet(f"{tmp_path}/arc_folders").collect()] == [(known, "Sent")]
    counts = spark.read.parquet(f"{tmp_path}/arc_counts").agg(F.sum("archived"), F.sum("duplicates"), F.sum("failed")).first()
    assert tuple(counts) == (4, 4, 1)
    first = got.where("provider_message_id = '<1@x>'").first()
    assert (first.sent_at, first.sent_at_kind, first.path, first.tags) == (1704067200000, "sent", "Inbox", ["Inbox", "Work"])
    assert got.where("provider_message_id = '<2@x>'").first().thread_id == "<1@x>"
    # one content is one attachment, linked to both messages that have it
    held = spark.read.parquet(f"{tmp_path}/arc_attachments").collect()
    assert [(r.filename, bytes(r.content), r.size_bytes, r.ingestion_source_id) for r in held] == [("t.csv", b"a,b", 3, "s1")]
    links = spark.read.parquet(f"{tmp_path}/arc_links").collect()
    assert {(r.email_id, r.attachment_id) for r in links} == {(r.id, held[0].id) for r in got.where("provider_message_id in ('<2@x>', '<3@x>')").collect()}


def rows_of(spark, sdf, name, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streaming_windows(spark, tmp_path):
    schema = "root_id string, message_id string, session_id string, delta long, ts timestamp"
    rows = [("g", "<1>", "x", 5, "2024-01-01 00:00:00"), ("g", "<1>", "x", 7, "2024-01-01 00:10:00"), ("g", "<2>", "x", 1, "2024-01-01 02:00:00"), ("h", "<1>", "y", 2, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "root_id string, message_id string, session_id string, delta long, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    late = df.limit(1).withColumn("ts", F.lit("2024-01-09 00:00:00").cast("timestamp")).withColumn("root_id", F.lit("z"))
    late.write.parquet(f"{tmp_path}/in/2")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert len(rows_of(spark, jobs.stream_dedup(read(), "30 days"), "dedup")) == 4
    assert {(str(r.day), r["count"]) for r in rows_of(spark, jobs.stream_history(read()), "history")} == {("2024-01-01", 3), ("2024-01-03", 1)}
    stale = rows_of(spark, jobs.stream_stale_sessions(read()), "stale")
    assert sorted((r.session_id, r.events) for r in stale) == [("x", 1), ("x", 2), ("y", 1)]
    assert {r.session_id: r.processed_bytes for r in rows_of(spark, jobs.stream_progress(read()), "progress", "complete")} == {"x": 18, "y": 2}


def test_streamed_index_and_snapshots(spark, tmp_path):
    from lettermill.schemas import EMAILS, SEARCH_DOCS

    docs = spark.createDataFrame([("1", "hello", "", "", "", "", "")], SEARCH_DOCS)
    docs.write.parquet(f"{tmp_path}/docs")
    jobs.stream_index(spark.readStream.schema(SEARCH_DOCS).parquet(f"{tmp_path}/docs"), f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination()
    assert [r.term for r in spark.read.parquet(f"{tmp_path}/index/postings").collect()] == ["hello"]
    spark.createDataFrame([("1", "world", "", "", "", "", ""), ("2", "more", "", "", "", "", "")], SEARCH_DOCS).write.mode("append").parquet(f"{tmp_path}/docs")
    jobs.stream_index(spark.readStream.schema(SEARCH_DOCS).parquet(f"{tmp_path}/docs"), f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.term for r in jobs.read_index(spark, f"{tmp_path}/index").collect()) == ["more", "world"]
    empty = [spark.createDataFrame([], s) for s in (EMAILS, "email_id string, attachment_id string", "id string, filename string, mime_type string, size_bytes long, content_hash_sha256 string", "fingerprint string, created_at long")]
    assert jobs.refresh_duplicates(*empty, f"{tmp_path}/snap").count() == 0 == jobs.refresh_duplicates(*empty, f"{tmp_path}/snap").count()


def test_archived_mails_keep_their_folder_without_a_join(spark):
    from lettermill.plans.archive_queries import mail_archives

    got = mail_archives(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan  # every entry's place went to the driver
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("'in/' || source as source_path", "'Doc ' || doc_id as subject")
    assert sorted(got.select("source_path", "subject").collect()) == sorted(want.collect())


def test_import_parses_a_message_once(spark):
    from pyspark.sql import functions as F

    from lettermill.streaming.jobs import import_batch

    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    raw = spark.range(40).select(F.lit("a").alias("file_path"), F.col("id").alias("ordinal"), F.concat(F.lit("Message-ID: <"), F.col("id").cast("string"), F.lit(">\n\nx")).cast("binary").alias("raw"))
    archive = spark.createDataFrame([], "id string, ingestion_source_id string, provider_message_id string")
    sources = spark.createDataFrame([("s1", None)], "id string, merged_into_id string")
    done = import_batch(raw.mapInArrow(counted, raw.schema), archive, sources, "s1")
    assert done["messages"].count() == 40 and parsed.value == 40


def test_messages_are_parsed_in_pieces_of_few_bytes():
    large = [1 << 20] * 10 + [9 << 20] + [1] * 150
    assert list(mb._pieces(large)) == [(0, 4), (4, 4), (8, 2), (10, 1), (11, 100), (111, 50)] and list(mb._pieces([])) == []
