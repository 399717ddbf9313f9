"""Mailboxes and archives read by ranges: the same messages for any cut, and for entries of any kind."""

import io
import random
import re
import zipfile

import pytest

from lettermill.sources import ranged


def mailbox(n, seed):
    rng = random.Random(seed)
    bits = [b"From here\n", b">From there\n", b">>From x\n", b"\n", b"a line\n", b"From", b"\xff\xfe\n", b"no end"]
    return b"".join(b"From MAILER %d\n" % k + b"Subject: %d\n\n" % k + b"".join(rng.choices(bits, k=rng.randint(0, 9))) + b"\n" for k in range(n))


def slow_records(data):
    starts = [m.start() for m in re.finditer(rb"(?m)^From ", data)]
    return [(a, data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)])]


@pytest.mark.parametrize("read", [1, 3, 7, 1000])
def test_records_of_ranges(read, monkeypatch):
    monkeypatch.setattr(ranged, "_READ", read)
    for seed in range(12):
        data = [b"", b"x\n", b"no record"][seed % 3] + mailbox(seed, seed)
        want = slow_records(data)
        for split in (1, 5, 17, 10_000):
            got = [r for at in range(0, len(data), split) for r in ranged.records(io.BytesIO(data), at, min(at + split, len(data)))]
            assert got == want, (seed, split)


def messages(df):
    return sorted((r.file_path.rpartition("/")[2], r.ordinal, bytes(r.raw)) for r in df.collect())


def test_mailboxes_for_any_split(spark, tmp_path):
    boxes = {f"{k} b%20x.mbox": mailbox(30, k) for k in range(3)} | {"empty.mbox": b"", "none.mbox": b"no record\n"}
    for name, data in boxes.items():
        (tmp_path / name).write_bytes(data)
    files = ranged.list_files(spark, str(tmp_path), "*.mbox")
    want = sorted((name, at, ranged.message(record)) for name, data in boxes.items() for at, record in slow_records(data))
    got = [messages(ranged.read_mbox_ranges(files, n)) for n in (50, 64 << 20)]
    assert got == [want, want]
    source = ranged.register(spark).read.format("lettermill-mbox").option("splitBytes", 70).load(str(tmp_path))
    assert messages(source) == want
    assert ranged.read_mbox_ranges(files.limit(0)).count() == 0


def test_growing_mailbox_as_a_stream(spark, tmp_path):
    box, out, check = tmp_path / "in" / "a.mbox", f"{tmp_path}/out", f"{tmp_path}/check"
    box.parent.mkdir()
    data = mailbox(40, 3)
    starts = [a for a, _ in slow_records(data)]

    def run():
        source = ranged.register(spark).readStream.format("lettermill-mbox").option("splitBytes", 60).option("closed", "false").load(str(box.parent))
        # an available-now run isn't offered to sources of this kind; one batch after the other is
        query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        query.processAllAvailable()
        query.stop()
        return [m[1:] for m in messages(spark.read.parquet(out).drop("file_path").selectExpr("'' as file_path", "ordinal", "raw"))]

    records = [(a, ranged.message(r)) for a, r in slow_records(data)]
    box.write_bytes(data[: starts[20] + 5])
    assert run() == records[:20]  # the last may still grow
    box.write_bytes(data)
    assert run() == records[:-1]
    (box.parent / "b.mbox").write_bytes(data)
    assert sorted(run()) == sorted(records[:-1] * 2)


def test_archives_by_their_directories(spark, tmp_path):
    rng = random.Random(5)
    mails = {f"d{k % 7}/é {k}.eml": bytes(rng.choices(range(256), k=rng.randint(0, 400))) + b"PK\5\6PK\3\4" for k in range(300)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k, (name, body) in enumerate(mails.items()):
            z.writestr(name, body, zipfile.ZIP_STORED if k % 3 else zipfile.ZIP_DEFLATED)
        z.writestr("d/", b"")
        z.writestr("__MACOSX/x.eml", b"x")
        z.writestr("n.txt", b"x")
        z.writestr("slow.eml", b"x" * 100, zipfile.ZIP_BZIP2)
        z.comment = b"PK\1\2 a comment"
    (tmp_path / "led.zip").write_bytes(b"#!/bin/sh\n" * 50 + (tmp_path / "a.zip").read_bytes())
    (tmp_path / "broken.zip").write_bytes((tmp_path / "a.zip").read_bytes()[:-400])
    (tmp_path / "empty.zip").write_bytes(b"")
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    at = broken.find(list(mails.values())[1])
    broken[at] ^= 1
    (tmp_path / "changed.zip").write_bytes(broken)
    files = ranged.list_files(spark, str(tmp_path), "*.zip")
    want = {(name.rpartition("/")[0], k, body) for k, (name, body) in enumerate(mails.items())}
    for block in (500, 16 << 20):
        got = {}
        for r in ranged.read_eml_archives(files, block).collect():
            got.setdefault(r.file_path.rpartition("/")[2], set()).add((r.source_path, r.ordinal, bytes(r.raw)))
        assert got["a.zip"] == got["led.zip"] == want and got["changed.zip"] == {w for w in want if w[1] != 1} and set(got) == {"a.zip", "led.zip", "changed.zip"}
    spread = ranged.read_eml_archives(files.where("path like '%/a.zip'"), 500).selectExpr("spark_partition_id() as p").distinct().count()
    assert spread > 1


def test_large_directory_form(tmp_path):
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        for k in range(66_000):  # more entries than the short form counts
            z.writestr(f"{k}.eml", b"%d" % k)
    path = str(tmp_path / "l.zip")
    with ranged.open_file(path) as file:
        entries = list(ranged.zip_directory(file, (tmp_path / "l.zip").stat().st_size))
        assert len(entries) == 66_000
        for k in (0, 1, 65_535, 65_999):
            assert ranged.inflate(file, *entries[k][2:]) == b"%d" % k
