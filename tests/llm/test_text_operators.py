"""Tokenizer alignment, spelling variants and URL filters against slow twins, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from lettermill.llm import alignment, pieces, queries, urlfilter, variants

SF = "/root/testdata/sf0.001"


def vocabulary(name):
    return str(pytest.importorskip("public_tokenizers").path(name))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


# alignment


@pytest.fixture(scope="module")
def pair():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    letters = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, letters


def slow_alignment(text, pair):
    """``(ids_a, ids_b, groups, links)`` from the libraries' whole-text encodings."""
    a, b, letters = pair
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelt_a = [bytes(letters[x] for x in a.id_to_token(k)) for k in ids_a]
    spelt_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return None
    ends = []
    for spelt in (spelt_a, spelt_b):
        at = 0
        ends.append([at := at + len(x) for x in spelt])
    groups, i, j = [], 0, 0
    for x, end in enumerate(ends[0]):
        if end in ends[1]:
            y = ends[1].index(end)
            groups.append((ids_a[i : x + 1], ids_b[j : y + 1]))
            i, j = x + 1, y + 1
    links = [(ids_a[x], ids_b[y]) for x, end in enumerate(ends[0]) for y, other in enumerate(ends[1]) if end == other]
    return ids_a, ids_b, groups, links


def slow_rows(rows, pair):
    found = [(i, slow_alignment(t, pair)) for i, t in rows]
    counts = collections.Counter(x for _, f in found if f for x in f[3])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, "", 0, 0))
            continue
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        best = sum(counts[x] == most[x[1]] for x in f[3])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), hashlib.sha256(shown.encode()).hexdigest(), best, sum(counts[x] for x in f[3])))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_alignment_query_matches_slow_twin(spark, pair):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rows = [(i, t) for i, t in rows if t is None or len(t) < 20_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = alignment.AlignConfig(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), block_links=3000)
    got = alignment.align_tokenizers(docs, cfg).collect()
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "", r.n_best, r.count_sum) for r in got]
    assert sorted(got) == sorted(slow_rows(rows, pair))


def test_alignment_query_columns(spark):
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, SF)
    assert set(got.columns) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert got.count() == documents(spark).count() and got.where("n_a > 0").count() == documents(spark).where("text <> ''").count()


def test_alignment_of_awkward_rows(spark, pair):
    rng = random.Random(4)
    bits = [" ", "  ", "a", "the", "\n", "\t", "é", "日", "👍", "x" * 70, "▁", "<s>", "</s>", "<|endoftext|>", "0", "\x00", "...", "of ", "<0x41>", "\xa0", "́", "'s", "don't", "(", "\x85", "\x1c"]
    texts = [None, "", " ", "▁", "a ", " a", "<|endoftext|>", "日" * 700, "x" * 3000, "a b" * 500, *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "one row of no id"), (5, "two rows of one id"), (5, "two rows of one id")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_a long, block string")
    cfg = alignment.AlignConfig(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), remembered=20, window=256, block_links=100)
    got = alignment.align_tokenizers(docs, cfg).collect()
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "", r.n_best, r.count_sum) for r in got]
    assert sorted(got, key=key) == sorted(slow_rows(rows, pair), key=key)
    assert alignment.align_tokenizers(docs.limit(0), cfg).count() == 0


def test_common_ends_in_windows():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (sorted(rng.sample(range(1, 400), rng.randint(1, 80))) + [400] for _ in range(2))
        want = [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]
        assert {tuple(zip(*alignment.common_ends(a, b, w))) == tuple(want) for w in (7, 100, 1000)} == {True}


def test_parts_are_used(pair):
    aligner = alignment.Aligner(alignment.AlignConfig(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")))
    assert aligner.at_letters and aligner.at_spaces
    encoder = pieces.PieceEncoder(vocabulary("piece_bpe_32k.model"))
    assert encoder.encode("one, two") == encoder.part(" one") + encoder.part(",") + encoder.part(" two")


# spelling variants


def slow_variants(rows):
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    gaps, near = collections.defaultdict(set), {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :], k].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for same in gaps.values():
        for w in same if len(same) > 1 else ():
            near[w] |= same - {w}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def got_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_variants_query_matches_slow_twin(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = got_variants(queries.QUERIES["op12_trie_spelling_variants"](spark, SF))
    assert got == slow_variants(rows) and any(r[1] for r in got)


def test_variants_of_dense_and_awkward_words(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abÿé×", k=rng.randint(6, 9))) for _ in range(400)]
    words += ["receive"] * 2000 + ["recieve", "recive"] * 60 + ["receiv"] * 3 + ["receivee"] * 5 + ["receivees"] * 2 + ["a" * k for k in range(7, 40)] * 2 + ["z" * 3000, "z" * 3001, "z" * 2999 + "y"] * 2 + ["RÉCEIVE", "Récéive"]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40])) for k in range(40)] + [(None, "of no number " * 3), (3, None), (4, ""), (5, "same words twice"), (5, "same words twice"), (None, None)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert got_variants(variants.group_variants(docs)) == slow_variants(rows)
    assert variants.group_variants(docs.limit(0)).count() == 0


def test_variants_of_one_word(spark):
    docs = spark.createDataFrame([(1, "lonesome lonesome")], "doc_id long, text string")
    assert got_variants(variants.group_variants(docs)) == slow_variants([(1, "lonesome lonesome")])


def test_variants_send_no_table_of_words_to_every_task(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join("".join(rng.choices("abc", k=7)) for _ in range(200))) for k in range(10)] + [(10, "abcabca " * 400)]
    docs, plans, write = spark.createDataFrame(rows, "doc_id long, text string"), [], variants.materialize

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(variants, "materialize", kept)
    made = variants.group_variants(docs)
    assert got_variants(made) == slow_variants(rows)
    plans.append(("made", made._jdf.queryExecution().executedPlan().toString()))
    # only states that were counted, after the first level
    assert {name for name, plan in plans if "Broadcast" in plan} == {"variants-level"}
    assert "Broadcast" not in next(plan for name, plan in plans if name == "variants-level")
    plans.clear()
    monkeypatch.setattr(variants, "_FEW", 0)
    assert got_variants(variants.group_variants(docs)) == slow_variants(rows)
    assert len(plans) > 6 and not any("Broadcast" in plan for _, plan in plans)


# URL filters


def slow_verdicts(rows, rules, otherwise):
    out = []
    for i, url in rows:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, otherwise)
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=key)


URLS = [
    None, "", "no scheme", "http://", "http://org", "https://EXAMPLE.org/es/", "http://a.example.org/es/x?y#z", "http://notexample.org/es/1", "http://example.org/en/12", "http://example.org/en/2",
    "http://.org/", "http://org./", "http://x.com/fr/", "http://com/de/#/fr/", "ftp://a.b.com/de", "http://x.com?u=/fr/", "x://y.net/://z", "http://ÄÖ.com/fr/ü", "http://a..example.org/es/\n", "http://" + "a." * 5000 + "com/de/1",
]


def test_urls_match_slow_twin_and_sql(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_bloom_cascade_urls"](spark, SF).collect()), key=key)
    assert got == slow_verdicts(rows, urlfilter.RULES, "allow") and {r[4] for r in got} == {"allow", "block"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(db.sql(urlfilter.oracle_sql()).fetchall(), key=key) == got


def test_awkward_urls(spark):
    rows = [*enumerate(URLS), (None, URLS[5]), (3, URLS[6]), (3, URLS[6])]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    want = slow_verdicts(rows, urlfilter.RULES, "allow")
    assert sorted(map(tuple, urlfilter.judge_urls(pages).collect()), key=key) == want
    joined = urlfilter.UrlFilterConfig(literal_bytes=1)
    assert sorted(map(tuple, urlfilter.judge_urls(pages, joined).collect()), key=key) == want
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    bare = urlfilter.UrlFilterConfig(rules=(), otherwise="block")
    assert sorted(map(tuple, urlfilter.judge_urls(pages, bare).collect()), key=key) == slow_verdicts(rows, [], "block")
    with pytest.raises(ValueError):
        urlfilter.judge_urls(pages, urlfilter.UrlFilterConfig(rules=(("allow", "a", "/"), ("block", "a", "/"))))


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id % 15000) as key")
    listed = spark.range(300).selectExpr("concat('k', id * 60) as key")
    cascade = urlfilter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2 and cascade.size < 4 * 300
    import pyspark.sql.functions as F

    found = {r.key for r in universe.where(cascade.holds(F.col("key"))).distinct().collect()}
    assert found == {f"k{i * 60}" for i in range(250)}
    assert listed.where(~cascade.holds(F.col("key"))).count() == 0


def test_many_rules(spark):
    rng = random.Random(2)
    hosts = [f"{a}{b}" for a in ("", "x.", "y.x.") for b in ("org", "com", "net", "site.org", "a.b.com")]
    paths = ["/", "/a", "/a/b", "/long/path/", ""]
    rules = [(rng.choice(("allow", "block")), h, p) for h in hosts for p in paths if rng.random() < 0.5]
    rows = [(k, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/a', 'b', '?q', '/b/c'])}") for k in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urlfilter.judge_urls(pages, urlfilter.UrlFilterConfig(rules=tuple(rules)))
    assert sorted(map(tuple, got.collect()), key=key) == slow_verdicts(rows, rules, "allow")
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
