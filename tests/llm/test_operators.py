"""The training-data operators against brute force, round trips and odd input."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pointloom.llm import decontaminate, licenses, linecrf, linededup, packing, rules, simhash, tokencount, tokenfile, warc  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __x string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


BASE = prose(1, 300)
ODD = [None, "", " \n\t ", "one", "two words", BASE, BASE, BASE.replace(" ", "  "), "É\x00 x\x0by", prose(2, 30_000), "a" * 50_000, BASE + " tail", "x\nx\nx\n\ny"]


def test_simhash_matches_brute_force(spark):
    texts = ODD + [" ".join(w if (i * 7 + k) % 290 else prose(k, 1) for i, w in enumerate(BASE.split())) for k in range(60)]
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    import xxhash

    fps = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        g = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert out == {i: (f"{f:016x}", find(i)) for i, f in enumerate(fps)}
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_cells_find_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 3), 2)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from pointloom.plans.components import connected_components

    e = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    roots = {r.node: r.root for r in connected_components(e).collect()}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            assert roots.get(a, a) == roots.get(b, b)


def test_keep_one_keeps_the_smallest(spark):
    got = simhash.keep_one(table(spark, [BASE, BASE, prose(9, 50), None, "x"], [5, 3, 4, 9, None]))
    assert sorted(r.doc_id for r in got.where("doc_id IS NOT NULL").collect()) == [3, 4, 9] and got.where("doc_id IS NULL").count() == 1


def test_token_counts_match_the_library(spark):
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, "<|endoftext|>a<|endoftext|>", "aaaaaaa" * 9, "don't  we\n\n'll   "]
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(table(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert out[i] == (len((x or "").encode()), n, n > 1024)


def test_token_files_round_trip(spark, tmp_path):
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, "<|endoftext|> a", "Ωmega É"]
    out = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_ids(table(spark, texts), path, 1).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        assert out[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for bits in (1, 7, 16, 19):
        docs = [np.arange(n, dtype=np.uint32) % (1 << bits) for n in (5, 0, 300)]
        (tmp_path / "f").write_bytes(b"".join(tokenfile.encode_file([3, None, 9], docs, bits, block=64)))
        f = tokenfile.TokenFile(str(tmp_path / "f"))
        assert f.doc_ids() == [3, None, 9] and all(np.array_equal(f.document(k), d) for k, d in enumerate(docs))
        assert np.array_equal(f.ids(60, 70), np.concatenate(docs)[60:70])


def test_classifier_learns_and_holds_out(spark):
    good = [prose(k, 60).replace(" j", ".\nj") for k in range(60)]
    bad = ["\n".join(" ".join(w + "###" for w in x.split()) for x in prose(100 + k, 60).split(" j")) for k in range(60)]
    docs = table(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    out = linecrf.quality(docs, labels).collect()
    held = [r for r in out if r.held_out and r.doc_id < 120]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == (r.doc_id < 60) for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 122
    none = linecrf.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    n = np.array([4, 1, 3])
    s, step = rng.normal(size=8), rng.normal(size=(2, 2))
    got, steps, _ = linecrf.forward_backward(s, n, step)
    at, want, moved = 0, [], np.zeros((2, 2))
    for k in n:
        p = {y: np.exp(sum(s[at + i] * y[i] for i in range(k)) + sum(step[y[i], y[i + 1]] for i in range(k - 1))) for y in itertools.product((0, 1), repeat=int(k))}
        z = sum(p.values())
        want += [sum(v for y, v in p.items() if y[i]) / z for i in range(k)]
        for y, v in p.items():
            for i in range(k - 1):
                moved[y[i], y[i + 1]] += v / z
        at += k
    assert np.allclose(got, want) and np.allclose(steps, moved)


def test_rules_and_licenses_match_sql(spark, tmp_path):
    import duckdb

    ring = " ".join([prose(7, 9)] * 3)
    texts = [*ODD, ring, "A!! B!! C!! " * 9, "x x x x y y y y " * 6, "a " * 7, "Licensed under CC BY-NC 4.0.\nfoo. Released under the MIT License. bar",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
             "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."]  # fmt: skip
    docs = table(spark, [t and t.replace("\x00", "")[:8000] for t in texts])
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    for df, sql in ((rules.verdicts(docs), rules.SQL), (licenses.scan(docs), licenses.SQL)):
        want = duckdb.sql(sql)
        assert df.columns == want.columns
        assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    found = {r.doc_id: r.licenses for r in licenses.scan(docs).where("has_license").collect()}
    assert set(found.values()) == {"mit,cc-by-nc-4.0", "isc"}
    assert all(any(re.search(licenses.MARKS, s) for s in [x]) for x in licenses._known())
    book = rules.ledger(docs)
    a = {(r.policy, r.version, r.rule): r for r in rules.ablation(book).collect()}
    p = rules.policy("prose", 2)
    assert a["prose", 2, "symbols"].n_kept == book.where(rules.passes(p)).count()


def test_packing(spark):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(0, 600, 500), rng.integers(600, 4097, 60)])
    b, slot, cap = packing.pack(lengths)
    fill = np.bincount(b, lengths)
    assert (fill <= cap).all() and set(cap) <= set(packing.CAPACITIES)
    assert all(cap[i] == min(c for c in packing.CAPACITIES if c >= fill[i]) for i in range(len(cap)))
    assert fill.sum() / cap.sum() > 0.97
    assert sorted(zip(b, slot, strict=True)) == sorted((i, s) for i in range(len(cap)) for s in range(np.count_nonzero(b == i)))
    rows = [(1, 10_000), (2, 0), (3, None), (None, 7), (2, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.pack_documents(df).collect()
    assert sorted(r.n_tokens for r in got if r.doc_id == 1) == [1808, 4096, 4096] and len(got) == 7
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = prose(3, 20_000)
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (3, None, None), (None, "z", ""), (4, "q", "é\r\n0\r\n\r\n"), (7, "v", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, len(big), sha(big), "revisit", 7), (2, len(big), sha(big), "revisit", 7), (2, len(big), sha(big), "revisit", 7), (3, 0, sha(""), "response", None),
            (None, 0, sha(""), "revisit", 3), (4, 9, sha("é\r\n0\r\n\r\n"), "response", None), (7, len(big), sha(big), "response", None)]
    assert got == sorted(want, key=str)
    assert len(list(warc.parse(b"".join(warc.response_records("<a>", "u", big.encode(), "1"))))) > 1
    assert warc.dechunked(warc.chunked(b"x" * 9999)) == b"x" * 9999
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_line_dedup_properties(spark):
    near = BASE.replace("a", "b", 2)
    texts = [BASE + "\nshared line of six words here\n\n" + prose(11, 12), near + "\nown", "shared line of six words here", None, "", "The The", "the the", prose(11, 12) + " more", BASE]
    docs = table(spark, texts)
    out = {(r.doc_id, r.line_no): r.removed for r in linededup.line_verdicts(docs).collect()}
    assert out[0, 0] is False and out[1, 0] and out[2, 0] and out[8, 0] and out[7, 0] and not out[1, 1]
    assert not out[5, 0] and out[6, 0]  # equal word sets match, however short
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert kept[1] == "own" and 2 not in kept and 8 not in kept and kept[3] is None and kept[4] == "" and kept[0] == texts[0]
    assert linededup.line_verdicts(docs.limit(0)).count() == 0


def test_line_dedup_leaves_no_match(spark):
    words = [prose(500 + k, 1) for k in range(80)]
    r = random.Random(4)
    base = [r.sample(words, 20) for _ in range(6)]
    lines = []
    for _ in range(300):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            b[r.randrange(20)] = r.choice(words)
        lines.append(" ".join(b))
    out = {x.doc_id: x.removed for x in linededup.line_verdicts(table(spark, lines)).collect()}
    s = [frozenset(x.split()) for x in lines]
    match = lambda i, j: 9 * len(s[i] & s[j]) >= 4 * (len(s[i]) + len(s[j]))
    for j in range(300):
        if out[j]:
            assert any(match(i, j) or lines[i] == lines[j] for i in range(j))
        else:
            assert not any(match(i, j) for i in range(j) if not out[i])


def test_contamination(spark):
    items = [(1, prose(20, 12)), (2, "short item"), (3, None), (4, "!!"), (10, prose(21, 9))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, extra string")
    quote = ", ".join(items[0][1].upper().split())
    texts = [None, "", "clean text", f"lead {quote}. tail", f"a Short, item! and {items[4][1]}", " ".join(items[0][1].split()[:7])]
    out = {r.doc_id: r for r in decontaminate.contamination(table(spark, texts), bench, with_spans=True).collect()}
    assert (out[3].n_hit, out[3].n_items, out[3].contaminated) == (12, 1, False)
    assert (out[4].n_words, out[4].n_hit, out[4].n_items, out[4].contaminated) == (13, 11, 2, True)
    assert out[4].items_sha256 == hashlib.sha256(b"10,2").hexdigest() and out[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[5].n_items == 0 and [texts[3][a:b] for a, b in out[3].spans] == [quote]
    kept = {r.doc_id: r.text for r in decontaminate.clean(table(spark, texts), bench).collect()}
    assert 4 not in kept and kept[3] == "lead . tail" and kept[2] == "clean text" and kept[0] is None
    assert len(decontaminate.write_patterns(bench, limit=3)) > 1 and len(decontaminate.write_patterns(bench)) == 1
    assert decontaminate.contamination(table(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
