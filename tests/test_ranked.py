"""Pages of best hits out of blocks with bounds, against the order of all hits."""

import random

import pytest

from lettermill.operators import ranked, search as srch

DOCS = "email_id string, subject string, body string, sender string, recipients string, attachments string, meta string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "li", "ma", "mi", "ru") for b in ("ta", "to", "ne", "ni", "so", "x")]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(f"{k:05}", text(rng.randint(0, 4)), text(rng.randint(0, 120)), f"u{k % 9}@x", "", text(2) if k % 7 == 0 else "", None) for k in range(600)]
    rows += [(f"9{k:04}", "lota lota", "same text", "twin@x", "", "", "") for k in range(30)] + [("empty", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, ranked.write_index(docs, str(tmp_path_factory.mktemp("ranked")), per_part=20)


def all_hits(docs, query, fields, or_mode):
    postings = srch.build_postings(docs)
    hits = srch.match(postings, query, fields, or_mode)
    rows = srch.bm25(hits, postings, srch.doc_lengths(docs), query, fields).collect()
    return sorted((r.score, r.email_id) for r in rows)


@pytest.mark.parametrize(
    ("query", "fields", "or_mode"),
    [("lota rux", None, False), ("max ru", None, True), ("lota-lota mi", None, False), ("twin", None, False), ("lita max", ["subject", "body"], True), ("absent lota", None, False)],
)
def test_top_hits_are_those_of_all_hits(made, query, fields, or_mode):
    docs, index = made
    want = all_hits(docs, query, fields, or_mode)
    for k in (10, 2000):
        got = ranked.top_hits(index, query, k, fields, or_mode, first_parts=2).collect()
        assert [r.email_id for r in got] == [i for _, i in want[:k]]
        assert [r.score for r in got] == pytest.approx([x for x, _ in want[:k]])


def test_dictionary_and_skipped_blocks(made):
    docs, index = made
    postings = srch.build_postings(docs)
    want = {r.term: r.n for r in postings.select("term", "email_id").distinct().groupBy("term").count().withColumnRenamed("count", "n").collect()}
    assert {r.term: r.df for r in index.terms.collect()} == want
    parts, _ = ranked.needed_parts(index, "rux", 3)
    assert 0 < parts.count() < index.blocks.where("term like 'rux%'").count() / 2


def test_empty_index_and_queries(spark, made, tmp_path):
    index = ranked.write_index(made[0].limit(0), str(tmp_path))
    assert ranked.top_hits(index, "lota").collect() == [] and ranked.top_hits(made[1], ' "" --').collect() == []


def test_postings_are_those_of_exploded_tokens_and_equal_ids_are_one(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(f"{k % 250:03}", "É one", f"a b a {'x ' * (k % 40)}" if k % 3 else "", None, "", "--", f"m{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = None
    for f in srch.FIELDS:
        part = docs.select("email_id", F.lit(f).alias("field"), F.posexplode(srch.tokenize(f)).alias("pos", "term"))
        whole = part if whole is None else whole.unionByName(part)
    want = whole.groupBy("term", "email_id", "field").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    made = srch.build_postings(docs)
    key = lambda df: sorted((r.term, r.email_id, r.field, r.tf, tuple(r.positions)) for r in df.collect())
    assert key(made) == key(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no row a token
    index = ranked.write_index(docs, str(tmp_path), per_part=7)
    assert index.total == 250
    assert {r.term: r.df for r in index.terms.collect()} == {r.term: r["n"] for r in want.groupBy("term").agg(F.count_distinct("email_id").alias("n")).collect()}
    lists = ranked._postings(index.blocks).select("term", "email_id", "field", "tf", "positions")
    assert key(lists) == key(want)


def test_index_is_written_from_one_pass_over_the_texts(spark, made, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    def refused(df, name):
        raise AssertionError(f"a copy on the way: {name}")

    monkeypatch.setattr(ranked, "materialize", refused)
    reads = spark.sparkContext.accumulator(0)
    read = F.udf(lambda x: (reads.add(1), x)[1], "string").asNondeterministic()
    docs = made[0].repartition(3).withColumn("body", read("body"))
    index = ranked.write_index(docs, str(tmp_path), per_part=20)
    assert reads.value == made[0].count()
    key = lambda df: sorted((r.term, r.email_id, r.length, r.field, r.tf, tuple(r.positions)) for r in df.collect())
    assert key(ranked._postings(index.blocks)) == key(ranked._postings(made[1].blocks))
    assert (index.total, index.average) == (made[1].total, made[1].average)


def test_best_counts_of_a_block_bound_all_its_shares(made):
    weight = [srch.WEIGHTS[f] for f in srch.FIELDS]
    for r in made[1].blocks.collect():
        counts = {}
        for i, field, tf, n in zip(r.email_id, r.field, r.tf, r.length):
            counts[i] = (counts.get(i, (0,))[0] + tf * weight[field], n)
        assert len(counts) == r.df and len(r.best) <= r.df
        for average in (0.5, 30.0, 4000.0):
            share = lambda f, n: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / average))  # noqa: E731, B023
            assert max(share(*x) for x in counts.values()) == pytest.approx(max(share(x.f, x.length) for x in r.best), rel=1e-12)


def test_runs_of_blocks_are_in_order_of_term(monkeypatch):
    import pyarrow as pa

    from lettermill.operators import postings as kernels

    rng = random.Random(2)
    rows = [{"email_id": f"{k:03}", "length": 9, **{f: "" for f in srch.FIELDS}, "body": " ".join(rng.choices("abcdefgh", k=9))} for k in range(40)]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    found = {}
    for run in (1, 6_000, 1 << 30):
        monkeypatch.setattr(kernels, "_RUN", run)
        found[run] = [r for b in kernels.blocks(iter(batches), srch.FIELDS, srch.WEIGHTS, 5, 3) for r in b.to_pylist()]
    order = lambda r: (r["term"], r["part"])
    assert found[1 << 30] == sorted(found[1], key=order) == sorted(found[6_000], key=order)
    falls = {run: sum(b["term"] < a["term"] for a, b in zip(x, x[1:])) for run, x in found.items()}
    assert falls[1 << 30] == 0 < falls[6_000] < falls[1] == 7
