import hashlib

import pytest
from pyspark.sql import functions as F

from lettermill.functions import dates as D, html as H, tags as G, text as P


def one(spark, column, *values):
    df = spark.createDataFrame([values], [f"c{k}" for k in range(len(values))]) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("f, given, want", [
    (P.normalize_source_path, r" a \\ b/../c/./d ", "a/b/c/d"),
    (P.normalize_duplicate_text, "<b>Hello,</b>  WORLDé!", "hello world"),
    (P.normalize_duplicate_text, "привет", ""),
    (P.sanitize_text, " a�b\x01\tc\x0b ", "ab\tc"),
    (P.sanitize_filename, " dir/my file.pdf ", "my_file.pdf"),
    (P.sanitize_filename, "..", "file"),
    (P.sanitize_path_component, "a/b\\c\x07", "a_b_c_"),
    (P.base_name, r"..\..\evil", "evil"),
    (P.base_name, "x/..", "attachment"),
    (P.honest_attachment_name, "Image/PNG; name=x", "attachment.png"),
    (P.honest_attachment_name, "application/x-unknown", "attachment"),
    (P.normalize_email, " MailTo:A@B.example ", "a@b.example"),
    (P.import_display_name, "/x/Inbox.mbox/mbox", "Inbox"),
    (P.import_display_name, "/x/trip.zipped.zip", "trip.zipped"),
    (P.import_display_name, "/x/Sent.mbox", "Sent"),
    (P.format_bytes, 1536, "1.5 KB"),
    (P.format_bytes, 0, "0 Bytes"),
    (P.human_size, 8808038, "8.4 MB"),
    (P.human_size, 512, "512 bytes"),
    (P.subject_label, "  ", "(no subject)"),
    (G.normalize_tag, " ##  My \t tag\x00 ", "My tag"),
    (H.decode_entities, "&amp;#38; &#x41;&lt;&bogus; &", "&#38; A<&bogus; &"),
    (H.normalize_content_type, "Text/CSS; charset=x", "text/css"),
    (H.extension_for, "image/webp", ".webp"),
    (H.http_reason, 404, "Remote server returned HTTP 404 Not Found"),
    (H.http_reason, 799, "Remote server returned HTTP 799"),
    (H.sanitize_css, "/*x*/@import 'a';b{background:url(\"http://x/y\")}<", "b{background:url('data:,')}"),
    (H.sanitize_style, "color:red; behavior:url(x) ; width:expression(1)", "color:red; width:"),
    (H.sanitize_style, "background:url(data:image/png;base64,AA==) red;scroll-behavior:smooth", "background:url('data:,') red; scroll-behavior:smooth"),
    (H.sanitize_css, "a{width:expression(f(1));-moz-binding:url(x)}", "a{width:;}"),
    (H.sanitize_css, "a{b:image-set(url(x) 1x), red}\n@media print{c{d:'};{'}}", "a{b:none, red}\n@media print{c{d:'};{'}}"),
    (H.sanitize_css, "a{b:url( http://x;y )} @IMPORT url(z) print;c{d:javascript:e}", "a{b:url('data:,')}c{d:e}"),
    (H.html_to_text, "<head><title>t</title></head><h1>Hi</h1><p>a <a href='http://x'>b</a><br>c<img src='i' alt='d'></p>&lt;", "HI\n\na b [http://x]\ncd [i]\n\n<"),
    (H.html_to_text, "x <3 y<script>var a='<p>';</script>z", "x <3 yz"),
    (D.iso_ms, 1704067200123, "2024-01-01T00:00:00.123Z"),
])
def test_strings(spark, f, given, want):
    assert one(spark, f("c0"), given) == want


def test_fingerprints(spark):
    rows = spark.createDataFrame([(([(None, " B@x "), (None, "a@x")], [(None, "a@x")], []),)], "r struct<to:array<struct<name:string,address:string>>,cc:array<struct<name:string,address:string>>,bcc:array<struct<name:string,address:string>>>")
    assert rows.select(P.recipient_fingerprint("r")).first()[0] == hashlib.sha256(b"a@x|a@x|b@x").hexdigest()
    assert rows.select(P.addresses("r", "to")).first()[0] == [" B@x ", "a@x"]
    assert one(spark, P.duplicate_hash("c0"), "") is None


def test_names_stay_unique(spark):
    rows = spark.createDataFrame([(1, 0, "a.pdf"), (1, 1, "a-2.pdf"), (1, 2, "a.pdf"), (1, 3, "x"), (1, 4, "x"), (2, 0, "a.pdf")], "g int, o int, n string")
    got = {(r.g, r.o): r.unique_name for r in P.unique_names(rows, "g", "n", "o").collect()}
    assert got == {(1, 0): "a.pdf", (1, 1): "a-2.pdf", (1, 2): "a-3.pdf", (1, 3): "x", (1, 4): "x-2", (2, 0): "a.pdf"}


def test_unique_names_of_large_groups_and_of_names_that_meet(spark):
    import random

    rng = random.Random(3)
    pool = ["a.pdf", "a-2.pdf", "a-3.pdf", "a-2-2.pdf", "a-02.pdf", "a-1.pdf", "x", "x-2", "x-2-2", "x-3", ".b", "-2.b", "a.", "a-2.", "a.b-2", "a-2.b-2", "a-2.b"]
    rows = [(g, k, rng.choice(pool)) for g in range(12) for k in range(60)] + [(None, k, n) for k, n in enumerate(("x-2", "x", "x", "x"))]
    want, used = {}, {}
    for g, k, name in rows:
        stem, dot, ext = name.rpartition(".")
        n, made = 1, name
        while made in used.setdefault(g, set()):
            n += 1
            made = f"{stem}-{n}.{ext}" if dot else f"{name}-{n}"
        used[g].add(made)
        want[g, k] = made
    got = P.unique_names(spark.createDataFrame(rows, "g int, o int, n string"), "g", "n", "o").collect()
    assert {(r.g, r.o): r.unique_name for r in got} == want
    large = spark.range(100_000).selectExpr("1 as g", "id as o", "'a.pdf' as n")  # a fold over this group took hours
    last = P.unique_names(large, "g", "n", "o").agg(F.count_distinct("unique_name").alias("n"), F.max_by("unique_name", "o").alias("last")).first()
    assert tuple(last) == (100_000, "a-100000.pdf")


@pytest.mark.parametrize("raw, want", [("Ann <a@x>", ("Ann", "a@x")), ('"B, C" <b@x>', ("B, C", "b@x")), ("<c@x>", ("c@x", "c@x")), ("d@x", ("d@x", "d@x")), ("nobody", None), ("", None)])
def test_display_address(spark, raw, want):
    got = one(spark, P.parse_display_address("c0"), raw)
    assert (got and tuple(got)) == want


def test_thread_and_folders(spark):
    pick = lambda *v: one(spark, P.thread_id(*[F.col(f"c{k}") for k in range(4)]), *v)
    assert [pick("<a>\r\n <b>", "<c>", "d", "e"), pick(" ", " <c> ", "d", "e"), pick("", "", "", "e")] == ["<a>", "<c>", "e"]
    got = one(spark, P.folder_and_labels(F.col("c0"), F.col("c1"), F.col("c2")), "Inbox, Work ,", "f", "p")
    assert (got.path, got.labels) == ("Inbox", ["Inbox", "Work"])


def test_source_name(spark):
    def name(given, paths, file, provider="mbox_import"):
        df = spark.createDataFrame([(given, paths, file, provider)], "n string, p array<string>, f string, k string")
        return df.select(P.derive_source_name(F.col("n"), F.col("p"), F.col("f"), F.col("k"))).first()[0]

    assert name(" X ", [], None) == "X"
    assert name("", ["a/Box.mbox/mbox"], None) == "Box"
    assert name("", ["Mail/x.eml"], None) == "Mail"
    assert name("", [], "old.MBOX") == "old"
    assert name(None, [], None) == "mbox import"


@pytest.mark.parametrize("date, emlx, received, want", [
    ("Mon, 01 Jan 2024 02:00:00 +0200", 5, [], (1704067200000, "sent")),
    ("1 Jan 2024 00:00:00 GMT", None, [], (1704067200000, "sent")),
    ("Mon, 01 Jan 2024 00:00:00", 7, [], (7, "sent")),
    ("Mon, 01 Jan 2024 00:00:00", None, [], (1704067200000, "sent_zone_unknown")),
    ("Mon, 01 Jan 2024 47:99:99 +0000", None, ["2 Jan 2024 00:00:00 +0000", "1 Jan 2024 00:00:00 +0000"], (1704067200000, "received")),
    ("Mon, 01 Jan 2024 00:00:00 +9999", None, [], (0, "unknown")),
    (None, None, [], (0, "unknown")),
])
def test_sent_at_ladder(spark, date, emlx, received, want):
    df = spark.createDataFrame([(date, emlx, received)], "d string, e long, r array<string>")
    assert tuple(df.select(D.derive_sent_at(F.col("d"), F.col("e"), F.col("r"))).first()[0]) == want


@pytest.mark.parametrize("text, want", [("2024-01-01", 1704067200000), ("2024-01-01T00:00:00.9+05:00", 1704067200000), ("1704067200000", 1704067200000), ("2024-02-30", None), ("99999-01-01", None), ("soon", None)])
def test_filter_timestamp(spark, text, want):
    assert one(spark, D.parse_filter_timestamp("c0"), text) == want


def test_described_dates(spark):
    say = lambda kind, **k: tuple(one(spark, D.describe_date("c0", F.lit(kind), **k), 1704067200000))
    assert say("sent", zone="Europe/Berlin", order="dmy") == ("Sent", "01/01/2024, 1:00", None)
    assert say("sent_zone_unknown", zone="Europe/Berlin") == ("Sent", "Jan 1, 2024, 0:00", "timezone unknown")
    assert say("unknown") == ("", "Date unknown", None)


def test_tags(spark):
    df = spark.createDataFrame([(["Work", "old", "Keep"], ["#New", "new", "work", "OLD"], ["OLD"])], "c array<string>, a array<string>, r array<string>")
    got = df.select(G.apply_tag_changes("c", G.normalize_tags("a"), F.col("r"))).first()[0]
    assert got == ["Work", "Keep", "New"]
    many = spark.createDataFrame([([f"t{k}" for k in range(63)], ["x", "y"])], "c array<string>, a array<string>")
    none = F.expr("cast(array() as array<string>)")
    assert len(many.select(G.apply_tag_changes("c", F.col("a"), none)).first()[0]) == 64


@pytest.mark.parametrize("url, want", [
    ("http://x.example/track/open?a", True), ("https://www.google-analytics.com/collect", True), ("https://notgoogle-analytics.com/a.png", False),
    ("https://www.amazon.co.uk/gp/r.html?U=1", True), ("https://ssl-images-amazon.com/gp/r.html", False), ("https://facebook.com/tr?id=1", True),
    ("https://facebook.com/trees", False), ("https://x.example/logo.png", False), ("https://x.example/o.gif", True),
])
def test_trackers(spark, url, want):
    assert one(spark, H.is_tracking_url("c0"), url) is want


@pytest.mark.parametrize("url, blocked", [
    ("ftp://x/", True), ("http://u:p@x/", True), ("http://x:8080/", True), ("http://x:80/", False), ("https://localhost/", True), ("http://10.1.2.3/", True),
    ("http://172.32.0.1/", False), ("http://100.64.0.1/", True), ("http://8.8.8.8/", False), ("http://[::1]/", True), ("http://[::ffff:127.0.0.1]/", True),
    ("http://[2002:7f00:1::]/", True), ("http://[64:ff9b::8.8.8.8]/", False), ("http://[fe80::1]/", True), ("http://[2606:4700::1111]/", False), ("https://x.example/a", False),
    ("http://2130706433/", True), ("http://0x7f.1/", True), ("http://127.1/", True), ("http://0177.0.0.1/", True), ("http://127.0.0.1./", True), ("http:\\\\127.0.0.1/a", True),
    ("http://LOCALHOST./", True), ("http:/127.0.0.1/", True), ("http://%31%32%37.0.0.1/", True), ("http://256.1.1.1/", True), ("http://1.2.3.4.5/", True), ("http://134744072/", False),
    ("http://8.8.2056/", False), ("http://a.1x/", False), ("http:///", True), ("http://x:/", False), ("http://0x7f.0x0.0x0.0x1/", True),
])
def test_url_policy(spark, url, blocked):
    assert (one(spark, H.url_block_reason("c0"), url) is not None) is blocked


def test_url_policy_names_the_address(spark):
    said = lambda url: one(spark, H.url_block_reason("c0"), url)
    assert said("http://2130706433/") == "Address 127.0.0.1 is a private or local network address"
    assert said("http://256.1.1.1/") == "Remote content URL has no valid host"


def test_sniffing(spark):
    kinds = [b"\x89PNG\r\n\x1a\n....", b"\xff\xd8\xff\xe0", b"GIF89a......", b"RIFF1234WEBPxx", b"\x00\x00\x00\x20ftypavif", b"<svg>"]
    got = [one(spark, H.sniff_image("c0"), k) for k in kinds]
    assert got == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/avif", None]
    verdict = lambda body, kind: one(spark, H.archivable("c0", F.lit(kind)), body)
    assert verdict(b"a{}", "text/css").content_type == "text/css"
    assert "SVG" not in verdict(b"<svg>", "image/svg+xml").reason and "image/svg+xml" in verdict(b"<svg>", "image/svg+xml").reason
    assert verdict(b"a\x00", "text/css").reason == "Remote stylesheet is not valid text"
    assert verdict(b"", None).reason == "Remote content is empty"


def test_remote_urls(spark):
    page = (
        "<style>a{background:url(http://h/s.png)}</style><img src='http://h/a.png'><img width=1 height=1 src='http://h/px1.png'>"
        "<img srcset='http://h/b.png 1x, http://h/c.png 2x'><div style=\"background:url('http://h/d.png')\"></div>"
        "<link href='http://h/x.css'><img src='cid:1'><img src='http://h/a.png'><img src='http://emltrk.com/x.png'>"
    )
    df = spark.createDataFrame([("m", page)], "id string, html string")
    got = [r.url for r in H.extract_remote_urls(df, "html", "id").orderBy("ord").collect()]
    assert got == ["http://h/a.png", "http://h/b.png", "http://h/c.png", "http://h/d.png", "http://h/x.css", "http://h/s.png"]
    assert one(spark, H.cid_references("c0"), "cid:<Logo> url(cid:hero) cid:logo") == ["logo", "hero"]


def test_attributes_last_wins(spark):
    df = spark.createDataFrame([("m", "<IMG Width='1' width=2 alt=\"a&amp;b\">")], "id string, html string")
    r = H.scan_tags(df, "html", "id").first()
    assert (r.tag, r.attrs) == ("img", {"width": "2", "alt": "a&b"})


@pytest.mark.parametrize("ref, want", [("../i/a.png", "http://h/i/a.png"), ("b.png?x=1", "http://h/css/b.png?x=1"), ("/c", "http://h/c"), ("//k/d", "http://k/d"), ("https://z/e", "https://z/e")])
def test_relative_urls(spark, ref, want):
    assert one(spark, H.resolve_url(F.lit("http://h/css/s.css"), F.col("c0")), ref) == want


def test_clamps(spark):
    assert [P.clamp_positive(v, 10, 100) for v in ("5.9", "0", "x", None, "1e9", "nan")] == [5, 10, 10, 10, 100, 10]
    assert one(spark, P.progress_percent("c0", "c1"), 150, 100) == 100.0
    assert one(spark, P.progress_percent("c0", "c1"), 1, 0) is None
    assert one(spark, P.payload_field("c0"), '{"ingestionSourceId": "s1"}') == "s1"
    assert one(spark, P.append_error("c0", F.lit("b")), ["a"]) == ["a", "b"]
