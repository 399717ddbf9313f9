"""The corpus operators against brute force, on the small tables and on rows made to be awkward."""

import bisect
import collections
import hashlib
import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lettermill.llm import annforest, chat, embdedup, langid, licenses, minhash, mixing, packing, queries, sharding, tokenfile, tokens
from lettermill.operators.components import connected_components
from lettermill.session import scratch_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, replica string, score string"


def vocabulary(name):
    return str(pytest.importorskip("public_tokenizers").path(name))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, a very long text, and columns with clashing names."""
    words = [f"w{k}" for k in range(60)]
    near = [*words[:58], "x", *words[59:]]
    long = " ".join(f"v{k % 7919}" for k in range(20_000))
    rows = [
        (1, " ".join(words), "en", "s0", 1, "r", "s"), (2, " ".join(near), "en", "s0", 1, "r", "s"), (3, None, "de", None, None, None, None),
        (4, "", "de", "s1", 0, None, None), (5, " \n\t ", None, "s1", 3, None, None), (6, "a b", "fr", "s1", 3, None, None), (7, "A  B", "fr", "s1", 4, None, None),
        (8, long, "en", "s0", 1, None, None), (8, long, "en", "s0", 1, None, None), (None, " ".join(words), "en", "s0", 1, None, None), (None, None, None, None, None, None, None),
        (9, "1234 5678 ---", "en", "s0", 1, None, None), (10, "x" * 50_000, "en", "s0", 1, None, None), (8, "another text of the same id", "en", "s2", 1, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# MinHash


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def linked_components(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = queries.QUERIES["op1_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked_components(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_large_groups_and_blocks(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:12] + [f"u{i}_{k}" for k in range(60)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = minhash.MinHashConfig(words=4, list_block=16, cluster_block=16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, cfg).collect()}
    assert got == linked_components(rows, 4)


def test_minhash_many_texts_and_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]

    def near():
        words = list(base)
        words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        return " ".join(words)

    def alone():
        return " ".join(f"a{rng.randrange(10**6)}" for _ in range(30))

    other = alone()
    rows = [(7, " ".join(base))] * 400 + [(7, near()) for _ in range(60)] + [(7, alone()) for _ in range(60)]
    rows += [(8, near()), (9, rows[-1][1]), (10, other), (11, other), (12, alone())]
    widest = []
    inner = minhash.block_pairs

    def watched(df, group, size, member, block):
        out = inner(df, group, size, member, block)
        if group == ["cluster"]:
            widest.append(out.groupBy("cluster", "ba", "bb").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(minhash, "block_pairs", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(df, minhash.MinHashConfig(words=4, list_block=16, cluster_block=16)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (8, 7), (9, 7), (10, 10), (11, 10), (12, 12)}
    # rows of one id are no reason for larger blocks: two blocks of about 16 classes
    assert widest and widest[0] <= 4 * 16


def test_minhash_awkward_rows(spark, odd, none):
    got = minhash.near_duplicates(odd, minhash.MinHashConfig(words=4)).collect()
    assert len(got) == 14
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[2] == {(1, False)} and by[7] == {(6, False)} and by[8] == {(8, True)}
    assert by[3] == {(3, True)} and by[4] == {(4, True)} and by[None] == {(None, True)}
    assert minhash.near_duplicates(none).count() == 0


# Token files and packing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    enc, library = tokens.Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    parts = ["a", "foo", "The", "é.", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "'RE", "é", "23", "!", "\x7f", "\x85", "\u00a0", "\u2028", "\x1c", "İ", "ß", "ŉ", "\u0301", "漢字", "мир", "Σας", "😀", "\r\n", "Ω", "_", "a.\nB", "“", "”", "’s", "–", "…", "½", "٣", "x" * 70]
    specials = [t.content for t in library.get_added_tokens_decoder().values()]
    for seed, known in ((3, parts), (4, [*parts[:8], *specials, specials[0].upper(), specials[0][:-1]])):
        rng = random.Random(seed)
        for _ in range(4000):
            text = "".join(rng.choice(known) for _ in range(rng.randint(0, 14)))
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
    library.encode_special_tokens = True
    text = f"x {specials[0]} y{specials[0]}"
    plain = tokens.Encoder(vocabulary(name), specials_as_text=True)
    assert np.frombuffer(plain.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_under_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED", 5)
    enc = tokens.Encoder(vocabulary("word_bpe_49k.json"))
    texts = [f"word{k} other {chr(97 + k)}ab and the same, twice" for k in range(20)]
    assert [enc.encode(t) for t in texts] == [enc._direct(t) for t in texts]
    assert len(enc.known) < 20 and len(enc.known.old) < 20


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(unit, width):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 60000, n).astype(f"<u{width}")
        data, chunks = tokenfile.compress(ids, unit, 256, 1)
        assert np.array_equal(tokenfile.decompress(data, chunks, n, width, unit, 256), ids)


def expected_ids(rows, name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    return [np.array(e.ids + [end], "<u4") for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def test_token_files_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op2_bitplane_token_files"](spark, SF).collect()}
    start = 0
    for (doc, _), ids in zip(rows, expected_ids(rows, "byte_bpe_50k.json", 2)):
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_awkward_rows(spark, odd, none):
    cfg = tokenfile.TokenFileConfig(vocabulary("byte_bpe_50k.json"), 2, unit="bit", block=64, segment_ids=500)
    for df, n in ((odd, 14), (none, 0)):
        path = scratch_path(spark, "test-tokens")
        tokenfile.write_tokens(df, path, cfg)
        got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
        assert len(got) == n and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(n)]
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))


def test_packing_covers_every_id_once(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    ids = {d: x for (d, _), x in zip(rows, expected_ids(rows, "word_bpe_49k.json", 1))}
    got = queries.QUERIES["op7_curve_packing"](spark, SF).collect()
    places, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for runs, total in [*((pieces[d], len(ids[d])) for d in ids), *((p, None) for p in places.values())]:
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
        assert at == total if total else at <= 2048
    assert sum(len(x) for x in ids.values()) > 2048 * (len(places) - 1)


def test_packing_awkward_rows(spark, odd, none):
    cfg = packing.PackingConfig(vocabulary("word_bpe_49k.json"), 1, length=64, bucket_docs=3)
    got = packing.pack(odd, cfg).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_id == 3) == 1
    assert sum(1 for r in got if r.start == 0) == 14 and packing.pack(none, cfg).count() == 0
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert sum(n < 64 for n in filled.values()) <= 1


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# Chat


def cheapest(roles, cfg):
    """The least cost over every legal sequence of roles, found without the operator's table of steps: a turn
    is told as the next message of the sequence or merged into the present one, and messages may stay empty."""
    best = None
    for length in range(1, 2 * len(roles) + 3):
        for system in (False, True):
            body = length - system
            if body < 2 or body % 2:
                continue
            legal = [0] * system + [1, 2] * (body // 2)
            cost = {(-1, False): 0}  # (message at hand, whether a turn has filled it)
            for g in roles:
                new = {}
                for (at, filled), c in cost.items():
                    for to in range(max(at, 0), length):
                        if to == at and not filled:
                            continue
                        name = 0 if g == legal[to] else cfg.unknown if g == 3 else cfg.relabel
                        step = name + (cfg.merge if to == at else cfg.insert * (to - at - 1))
                        new[to, True] = min(new.get((to, True), 10**9), c + step)
                cost = new
            for (at, _), c in cost.items():
                total = c + cfg.insert * (length - 1 - at)
                best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("block", [4096, 2])
def test_chat_repairs_at_least_cost(spark, block):
    rng = random.Random(5)
    names = ["system", "user", "assistant", "tool"]
    convs = {c: [rng.randrange(4) for _ in range(rng.randint(1, 7))] for c in range(40)}
    rows = [(c, t, names[g], f"t{c}.{t}") for c, gs in convs.items() for t, g in enumerate(gs)]
    cfg = chat.ChatConfig(block_turns=block)
    got = collections.defaultdict(list)
    for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), cfg).collect():
        got[r.conv_id].append(r)
    for c, gs in convs.items():
        messages = sorted(got[c], key=lambda r: r.message)
        assert [m.message for m in messages] == list(range(len(messages)))
        assert sum(m.cost for m in messages) == cheapest(gs, cfg)
        roles = [m.role for m in messages]
        rest = roles[1:] if roles[0] == "system" else roles
        assert rest == ["user", "assistant"] * (len(rest) // 2) and rest
        said = [x for m in messages for x in m.text.split("\n\n") if x]
        assert said == [f"t{c}.{t}" for t in range(len(gs))]


def test_chat_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, message string, block int, known string, place int"
    least = -(2**63)
    rows = [(1, None, " USER ", None, "m", 1, "k", 1), (1, 0, None, "b", "m", 1, None, 1), (None, 0, "user", "x", None, None, None, 1), (1, 0, None, "b", "m", 1, "k", 1), (least, 0, "user", "y", None, 1, "k", 1)]
    got = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id for r in got} == {1, None, least} and sum(r.n_turns for r in got) == 5
    assert [r.text for r in got if r.conv_id is None and r.n_turns] == ["x"] and [r.text for r in got if r.conv_id == least and r.n_turns] == ["y"]
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_chat_cuts_a_conversation_without_turn_numbers(spark):
    rows = spark.range(6000).selectExpr("cast(null as long) conv_id", "cast(null as long) turn", "if(id % 2 = 0, 'user', 'assistant') role", "'same' text")
    got = chat.format_chats(rows, chat.ChatConfig(block_turns=100)).agg(F.sum("n_turns"), F.max(F.length("text"))).first()
    assert got[0] == 6000
    given = spark.range(6000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "string(id) text")
    whole = chat.format_chats(given, chat.ChatConfig(block_turns=100)).orderBy("message").collect()
    assert [r.text for r in whole] == [str(k) for k in range(6000)] and sum(r.cost for r in whole) == 0


# Licenses


def test_licenses_found_and_confirmed(spark):
    filler = " ".join(["word"] * 300)
    rows = [
        (1, "intro\nReleased under the MIT License.\nend"), (2, f"{filler} Licensed under the Apache License, Version 2.0. {filler}"), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "This work is licensed under the GNU General Public License, version 2."), (5, "a driving licence and the copyright office"), (6, None), (7, ""), (8, "Licensed under CC BY-NC 4.0."), (None, "All rights reserved."),
        (9, "Licensed under the Apache License, Version 9.9."), (10, "x" * 100_000),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (4, "GPL-2.0"), (8, "CC-BY-NC-4.0"), (None, "All-rights-reserved")}
    assert all(r.exact and r.conditional_bytes < r.plain_bytes for r in got)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_of_the_table(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "All-rights-reserved"}
    want = collections.Counter((r.doc_id, lines[x]) for r in documents(spark).collect() for x in r.text.split("\n") if x in lines)
    got = collections.Counter((r.doc_id, r.license) for r in queries.QUERIES["op4_conditional_license_scan"](spark, SF).collect() if r.exact)
    assert got == want


def scanned(spark, texts):
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.line, r.license) for r in got if r.exact)


def test_licenses_inside_prose(spark):
    prose = " ".join(documents(spark).orderBy("doc_id").limit(20).toPandas().text).split()
    cases = [(name, n) for name in licenses.TEMPLATES for n in (0, 10, 20, 40, 80)]
    texts = [" ".join([*prose[k * 37 : k * 37 + n], licenses.TEMPLATES[name], *prose[k * 37 + n : k * 37 + 2 * n]]) for k, (name, n) in enumerate(cases)]
    assert len(prose) > len(cases) * 37 + 160
    assert scanned(spark, texts) == [(k, 0, name) for k, (name, n) in enumerate(cases)]
    assert scanned(spark, [t.upper() for t in licenses.TEMPLATES.values()]) == [(k, 0, name) for k, name in enumerate(licenses.TEMPLATES)]


def test_licenses_are_ranked_by_compression(spark, monkeypatch):
    text = 'Licensed under the Apache License, Version 2.0 (the "License"); you must not use the file except in compliance with the License.'
    scanner = licenses.Scanner(licenses.LicenseConfig())
    # the short notice stands there word for word, but the long one saves more of the block
    (row,) = scanner.scan(f"before it {text} behind it")
    assert (row[2], row[6], row[7]) == ("Apache-2.0-notice", ["may", "this"], ["must", "the"])
    saved = scanner.saved(" ".join(licenses.words(text)).encode())
    assert set(saved) == set(licenses.TEMPLATES) and max(saved, key=saved.get) == "Apache-2.0-notice"
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, raw: dict.fromkeys(licenses.TEMPLATES, len(raw)))
    assert [r[2] for r in scanner.scan(text)] == ["Apache-2.0"]


def test_license_ranking_matches_slow_twin():
    rng = random.Random(11)
    cfg = licenses.LicenseConfig()
    scanner = licenses.Scanner(cfg)
    for _ in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        own = licenses.words(licenses.TEMPLATES[name])
        for _ in range(rng.randint(0, int(cfg.changes * len(own)))):
            own[rng.randrange(len(own))] = rng.choice(("other", "words", "instead"))
        text = " ".join(["aa", "bb", *own, "cc"])
        # every template at every place of the text, by word differences alone, then ranked by what it saves
        places = []
        for other, want in scanner.words.items():
            for start in range(len(own) + 3):
                for end in range(start + 1, len(own) + 4):
                    got = text.split()[start:end]
                    if len(got) == len(want) and sum(x != y for x, y in zip(got, want)) <= scanner.limit[other]:
                        places.append((other, start, end))
        found = scanner.scan(text)
        assert bool(found) == bool(places)
        if places:
            block = " ".join(text.split()[min(p[1] for p in places) : max(p[2] for p in places)]).encode()
            best = max(scanner.saved(block)[p[0]] for p in places)
            assert scanner.saved(block)[found[0][2]] == best


def test_licenses_wrapped_many_and_changed(spark):
    t = licenses.TEMPLATES
    wrapped = ["\n".join(f" * {x}" for x in textwrap.wrap(t[k], 34)) for k in t]
    assert scanned(spark, wrapped) == [(k, 0, name) for k, name in enumerate(t)]
    far = "copyright " + "so " * 29 + t["MIT-grant"] + " and more" * 60 + " " + t["MIT-grant"]
    both = f"{t['MIT']} {t['All-rights-reserved']} {t['MIT']}\n\n{t['GPL-2.0']}"
    assert scanned(spark, [far, both]) == [(0, 0, "MIT-grant")] * 2 + [(1, 0, "All-rights-reserved"), (1, 0, "MIT"), (1, 0, "MIT"), (1, 2, "GPL-2.0")]
    changed = t["MIT-grant"].replace("is hereby granted", "is herewith granted").replace("any person", "any one person")
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, f"so {changed}; so")], "doc_id long, text string")).collect()
    assert (row.license, row.missing, row.extra, row.exact) == ("MIT-grant", ["hereby"], ["herewith", "one"], False) and row.block == f"{changed};"


# Language


def test_language_accuracy(spark):
    got = queries.QUERIES["op5_centroid_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = got.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[0] > 0.97 and 0 <= r[1] <= r[2] <= 1 and r[3] > 100


def test_language_awkward_rows(spark, odd, none):
    docs = documents(spark)
    model = langid.fit(docs)
    got = langid.predict(odd, model).collect()
    assert len(got) == 14 and {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 9) and not (r.text or "").strip("0123456789- \n\t")} == {"und"}
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und") and "replica" in got[0].asDict()
    empty = langid.fit(none)
    assert langid.predict(none, model).count() == 0 and {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_language_rejects_what_it_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    unseen = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ", "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler. ", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. ",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(20_000)),
    ]
    rows = [(10_000 + 10 * k + i, (t * (n // len(t) + 1))[:n]) for k, n in enumerate((40, 160, 600, 3000, 20_000)) for i, t in enumerate(unseen)]
    model = langid.fit(docs.where(~langid.held_out()))
    assert [r.doc_id for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).where("not rejected").collect()] == []
    clean = docs.where(langid.held_out() & F.col("text").rlike("[A-Za-z]"))
    cut = [clean.select("doc_id", F.expr(f"substring(text, 1, {n})").alias("text")) for n in (40, 160, 600, 100_000)]
    for df in cut:
        r = langid.predict(df, model).agg(F.avg(F.col("rejected").cast("int")), F.count("*")).first()
        assert r[0] <= 0.01 and r[1] > 100


# Embeddings


VECS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dims))
    x = np.vstack([base, base[: n // 3] + 0.12 * rng.standard_normal((n // 3, dims)), base[np.zeros(n // 3, int)] + 0.15 * rng.standard_normal((n // 3, dims))])
    return x.astype(np.float32)


def test_letters_of_every_plane_are_letters():
    assert langid.counts(chr(0x30000) * 50, 4096) is not None and langid.counts("1" + chr(0x10FFFF), 4096) is None


def test_embedding_links_match_brute_force(spark):
    x = vectors()
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)] + [(500, [float(v) for v in x[0]], 1), (501, [float(v) for v in x[0]], 1)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (604, [], 0)]
    cfg = embdedup.ProjectionConfig(windows=(40,), block=64)
    got = {r.vec_id: r for r in embdedup.embedding_near_duplicates(spark.createDataFrame(rows, VECS), cfg).collect()}
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and i < 600}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    ids = sorted(unit)
    u = np.array([unit[i] for i in ids])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(1).tolist()))
    label = list(range(len(ids)))
    for _ in ids:
        label = [min([label[k], *(label[j] for j in np.flatnonzero(near[k]))]) for k in range(len(ids))]
    assert {i: got[i].component_id for i in ids} == {i: ids[label[k]] for k, i in enumerate(ids)}
    assert all(got[i].n_links == 0 and got[i].kept for i in (600, 601, 602, 603, 604, None))
    assert embdedup.embedding_near_duplicates(spark.createDataFrame([], VECS)).count() == 0


def test_embeddings_of_equal_ids_and_other_lengths(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0, 0.0], 0), (6, [1.0, 0.1, 0.0, 0.0], 0), (7, [1.0, 0.0, 0.1, 0.0], 0), (8, [0.0, 1.0, 0.1, 0.0], 0)]
    rows += [(9, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [0.0, 0.0, 0.0, 1.0], 0), (12, [-0.0, 0.0, 0.0, 2.0], 0), (12, [-0.0, 0.0, 0.0, 2.0], 0), (13, [1.0], 0)]
    df = spark.createDataFrame(rows, VECS).select("*", F.lit("x").alias("node"), F.lit(1).alias("v"), F.lit(1).alias("cluster"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embdedup.embedding_near_duplicates(df).collect())
    assert got == [
        (5, 1, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 1, 5, False), (9, 0, 9, True), (10, 0, 10, True),
        (11, 2, 11, True), (12, 2, 11, False), (12, 2, 11, False), (13, 0, 13, True),
    ]
    ragged = annforest.nearest(df, df.where("vec_id in (6, 9)")).collect()
    assert {r.query_id for r in ragged} == {6} and {r.vec_id for r in ragged} == {5, 7, 8, 11, 12}


def topic(n, pairs, inner, dims=64, cosine=0.953, seed=4):
    """``n`` unit vectors of one topic, mutual cosine about ``inner``, then a partner at ``cosine`` for each of the first ``pairs``."""
    rng = np.random.default_rng(seed)

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    centre = unit(rng.standard_normal((1, dims)))
    own = rng.standard_normal((n, dims))
    own = unit(own - (own @ centre.T) * centre)
    aside = rng.standard_normal((pairs, dims))
    aside -= (aside @ centre.T) * centre
    aside = unit(aside - (aside * own[:pairs]).sum(1, keepdims=True) * own[:pairs])
    c = (cosine - inner) / (1 - inner)
    own = np.vstack([own, c * own[:pairs] + np.sqrt(1 - c * c) * aside])
    return np.sqrt(inner) * centre + np.sqrt(1 - inner) * own


def found_of_planted(spark, path, x, pairs, cfg):
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)))}), path)
    got = embdedup.embedding_near_duplicates(spark.read.parquet(path), cfg).select("vec_id", "component_id", "n_links").toPandas().set_index("vec_id")
    assert len(got) == len(x)
    first, second = got.loc[range(pairs)], got.loc[range(len(x) - pairs, len(x))]
    return (first.component_id.to_numpy() == second.component_id.to_numpy()).mean(), got


def test_embedding_pairs_of_a_dense_topic(spark, tmp_path):
    recall, _ = found_of_planted(spark, f"{tmp_path}/v.parquet", topic(100_000, 500, 0.85), 500, embdedup.ProjectionConfig())
    assert recall == 1


def test_embedding_windows_keep_the_stated_miss(spark, tmp_path):
    x = topic(8000, 300, 0.7)
    cfg = embdedup.ProjectionConfig(windows=(64,), row_cost=0, block=128)
    passes = embdedup.plan(x, len(x), cfg)
    assert passes.window == 64 and passes.number >= 16
    recall, got = found_of_planted(spark, f"{tmp_path}/v.parquet", x, 300, cfg)
    assert recall >= 0.99
    near = x.astype(np.float32).astype(np.float64)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    assert abs(got.n_links.sum() - ((near @ near.T >= 0.95).sum() - len(x))) <= 6


def test_embedding_windows_reach_over_borders(spark):
    x = vectors(600)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, v array<double>").repartition(7)
    passes = embdedup.Passes(3, 20, x.mean(0).astype(np.float64))
    rows = embdedup.windowed(df, passes, 30, embdedup.ProjectionConfig()).select("stretch", "place", "pass", "node").collect()
    order = sorted({(r.place, r["pass"], r.node) for r in rows})
    assert [r[0] for r in order] == list(range(1800)) and [r[1] for r in order] == sorted(r[1] for r in order)
    held = collections.defaultdict(set)
    for r in rows:
        held[r.stretch].add(r.place)
    assert all(any({a, b} <= s for s in held.values()) for a in range(1800) for b in (a + 1, a + 20) if b < 1800)


def test_depths_of_runs():
    keys = np.packbits(np.random.default_rng(8).random((300, 128)) < 0.5, axis=1)
    signs = np.unpackbits(keys, axis=1)
    for width in (1, 5, 40, 299, 400):
        got = embdedup._depths(keys, width)
        for k in range(0, 300, 7):
            depth = 0
            while (signs[:, :depth] == signs[k, :depth]).all(1).sum() > width:
                depth += 1
            assert got[k] == depth


def test_embedding_few_dense_rows_among_many(spark, tmp_path):
    """A topic as dense as the cosine allows, of fewer than a thousandth of the rows: none of its pairs is lost."""
    rng = np.random.default_rng(11)
    basis = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    c, own = (0.9505 - 0.9495) / (1 - 0.9495), basis[1:13]
    own = np.vstack([own, c * own + np.sqrt(1 - c * c) * basis[13:25]])
    x = np.vstack([rng.standard_normal((26_000, 32)), np.sqrt(0.9495) * basis[0] + np.sqrt(1 - 0.9495) * own])
    path = f"{tmp_path}/v.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)))}), path)
    got = embdedup.embedding_near_duplicates(spark.read.parquet(path), embdedup.ProjectionConfig(windows=(1,), row_cost=0, block=128)).where("vec_id >= 26000")
    assert [(r.n_links, r.component_id) for r in got.orderBy("vec_id").collect()] == [(1, 26_000 + k % 12) for k in range(24)]


def test_embedding_windows_wider_than_a_block(spark):
    x = vectors(900)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, v array<double>")
    cfg, passes = embdedup.ProjectionConfig(), embdedup.Passes(2, 600, x.mean(0).astype(np.float64), 5)
    rows = embdedup.windowed(df, passes, 100, cfg)
    held = collections.defaultdict(set)
    for r in rows.collect():
        held[r.stretch].add(r.place)
    assert max(map(len, held.values())) <= 3 * 256
    together = np.zeros((1800, 1800), bool)
    for s in held.values():
        together[np.ix_(sorted(s), sorted(s))] = True
    a, b = np.triu_indices(1800)
    assert together[a, b][b - a <= 600].all()

    def linked(size):
        stretches = embdedup.windowed(df, passes, size, cfg).repartition("stretch").sortWithinPartitions("stretch", "place")
        return components(stretches.mapInArrow(lambda it: embdedup._linking(it, passes, size, cfg), "u long, v long"))

    assert linked(100) == linked(4096) and len(linked(100)) > 300


def components(links):
    return {(r.node, r.component) for r in connected_components(links).collect()}


def test_depths_from_places(spark):
    x = np.random.default_rng(9).standard_normal((400, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, v array<double>")
    cfg, passes = embdedup.ProjectionConfig(), embdedup.Passes(2, 0, np.zeros(16), 3)
    got = {r.node: {(s["pass"], s.window): s.depth for s in r.seen} for r in embdedup.depths(embdedup.placed(df, passes, cfg), [5, 60, 500]).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for number in (3, 4):
        keys = passes.keys(unit, number, cfg)
        signs, place = np.unpackbits(keys, axis=1), np.empty(400, int)
        place[np.lexsort(keys.T[::-1])] = np.arange(400)
        for window in (5, 60, 500):
            for k in range(0, 400, 7):
                depth = 0
                while (np.abs(place[(signs[:, :depth] == signs[k, :depth]).all(1)] - place[k]) > window).any():
                    depth += 1
                assert got.get(k, {}).get((number, window), 0) == depth


def test_forest_recall_and_order(spark):
    x = vectors(600, 24, 7)
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)] + [(1000, None, 0), (1100, [0.0] * 24, 0), (1200, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, VECS)
    got = collections.defaultdict(list)
    for r in annforest.nearest(df, df.where("vec_id % 20 = 0"), annforest.ForestConfig(block_rows=200, query_rows=10)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, rs in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len({r.vec_id for r in rs} & set(want.tolist()))
        assert [r.rank for r in rs] == list(range(1, 11)) and all(abs(d[r.vec_id] - r.score) < 1e-12 for r in rs)
        assert [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)
    assert hits / (10 * len(got)) >= 0.9
    few = df.where("vec_id < 5")
    assert annforest.nearest(few, few).count() == 20 and annforest.nearest(df.limit(0), df.limit(0)).count() == 0


# Mixing and sharding


def poisson_count(u, rate):
    import math

    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_counts_and_shares(spark):
    docs = documents(spark)
    cfg = mixing.MixConfig(weights={"src0": 3.0, "src1": 1.0}, epochs=0.5)
    n = collections.Counter(r.source for r in docs.collect())
    rate = {"src0": 0.75 * 200 * 0.5 / n["src0"], "src1": 0.25 * 200 * 0.5 / n["src1"]}
    want = collections.Counter()
    for r in docs.collect():
        h = hashlib.md5(str(r.doc_id).encode()).hexdigest()
        u = int(hashlib.md5(f"42 count|{h}".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id] = poisson_count(u, rate[r.source]) if r.source in rate else 0
    got = mixing.mix(docs, cfg).collect()
    assert collections.Counter(r.doc_id for r in got) == +want
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_mixing_awkward_rows(spark, odd, none):
    got = mixing.mix(odd, mixing.MixConfig(epochs=3.0)).collect()
    assert {r.replica for r in got} >= {1, 2} and got[0].asDict().keys() >= {"score", "n_replicas"}
    assert {r.source for r in got} == {"s0", "s1", "s2", None}
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, mixing.MixConfig(weights={"zz": 1.0})).count() == 0


@pytest.mark.parametrize("n, shards", [(200, 16), (37, 5), (3, 16)])
def test_ring_matches_one_by_one(spark, n, shards):
    cfg = sharding.RingConfig(shards=shards, points=8, cell_bits=6)
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(rows, cfg).collect()}
    places, orders = sharding.ring(cfg)
    room = [n // shards + (s < n % shards) for s in range(shards)]

    def turn(i):
        p = int(hashlib.md5(f"{cfg.seed} key {i}".encode()).hexdigest()[:15], 16)
        return bisect.bisect_left(places, p) % len(places), p - 2**60 if p > places[-1] else p

    used, want = [0] * shards, {}
    for i in sorted(range(n), key=turn):
        s = next(s for s in orders[turn(i)[0]] if used[s] < room[s])
        want[i], used[s] = (s, used[s]), used[s] + 1
    assert got == want


def test_ring_awkward_rows(spark, odd, none):
    got = sharding.shard(odd, sharding.RingConfig(shards=4, points=4)).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == 14 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in counts.items())
    assert sharding.shard(none).count() == 0


def test_ring_moves_few_rows_when_it_grows(spark):
    at = {k: {r.doc_id: r.shard for r in sharding.shard(spark.range(4000).withColumnRenamed("id", "doc_id"), sharding.RingConfig(shards=k)).collect()} for k in (8, 9)}
    assert sum(at[8][i] != at[9][i] for i in at[8]) < 0.25 * 4000
