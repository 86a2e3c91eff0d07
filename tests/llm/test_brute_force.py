"""The operators against plain Python over whole tables, random texts and odd rows."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from pointloom.llm import decontaminate, licenses, linecrf, linededup, packing, rules, simhash, tokencount, tokenfile, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def random_texts(n, seed=3):
    """Text of all planes, with gaps of all kinds and special strings."""
    r = random.Random(seed)
    ranges = [(32, 127), (0xA0, 0x250), (0x370, 0x600), (0x1E00, 0x2100), (0x3040, 0x3100), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (0, 32)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 40)):
            a, b = r.choice(ranges[: r.randint(1, len(ranges))])
            parts.append("".join(chr(r.randrange(a, b)) for _ in range(r.randint(1, 8))))
            parts.append(r.choice([" ", "  ", "\n", "\t", "", "<|endoftext|>", "[SEP]", " ́", "'s"]))
        out.append("".join(parts))
    return out


def with_random(spark, sf):
    docs = read(spark, "documents", sf).select("doc_id", "text")
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(random_texts(300))], "doc_id bigint, text string")
    return docs.unionByName(extra)


def test_token_counts_on_whole_tables_and_random_text(spark):
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    docs = with_random(spark, "/root/testdata/sf0.01")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.token_counts(docs, path).collect()}
    assert got == {k: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for k, x in text.items()}


def test_token_ids_on_whole_tables_and_random_text(spark):
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    docs = with_random(spark, "/root/testdata/sf0.01").unionByName(spark.createDataFrame([(None, "a b"), (7, "zz"), (None, None)], "doc_id bigint, text string"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_ids(docs, path, 1).collect())
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for k, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((start, k, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def windows_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))] if w else []


@pytest.mark.parametrize("limit", [10**6, 700])
def test_contamination_by_all_windows(spark, limit):
    r = random.Random(8)
    words = ["ab", "Ba", "c", "é", "x1"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) + r.choice(["", ".", " ab-c"]) for _ in range(200)]
    items = [" ".join(r.choice(words) for _ in range(r.randint(0, 11))) for _ in range(40)]
    docs = read(spark, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([*((10**6 + i, t) for i, t in enumerate(texts)), (None, "ab ab"), (5, "ab ba c"), (5, "ab ba c")], "doc_id bigint, text string"))
    bench = read(spark, "benchmark").select("item_id", "text").unionByName(
        spark.createDataFrame([*((10**6 + i, t) for i, t in enumerate(items)), (None, "c c é"), (10**6, "x1 x1 x1 x1")], "item_id bigint, text string"))
    where: dict[tuple, set[str]] = {}
    for row in bench.collect():
        for w in windows_of(row.text)[1]:
            where.setdefault(w, set()).add("null" if row.item_id is None else str(row.item_id))
    sizes = sorted({len(w) for w in where})

    def expect(row):
        w, _ = windows_of(row.text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := where.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        return row.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2

    assert len(where) > 700
    got = sorted(map(str, map(tuple, decontaminate.contamination(docs, bench, limit=limit).collect())))
    assert got == sorted(str(expect(r)) for r in docs.collect())
    assert len(decontaminate.write_patterns(bench, limit=limit)) == (1 if limit > 700 else -(-len(where) // 700))


def slow_pack(lengths, caps, cost):
    """Best fit as the docstring states it, by looking at every open bin."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, left = [], sum(lengths)
    rest = sorted(lengths)
    for i in order:
        n = lengths[i]
        open_ = [b for b in bins if b["room"] >= n]
        if open_:
            least = min(b["room"] for b in open_)
            b = next(x for x in open_ if x["room"] == least)
        else:
            def price(c, n=n):
                behind = sum(x for x in rest if x <= min(c - n, n))
                return cost(c) / max(1, n + min(c - n, behind))
            c = min((c for c in caps if c >= n), key=lambda c: (price(c), c))
            b = {"room": c, "held": []}
            bins.append(b)
        b["room"] -= n
        b["held"].append(n)
    assert left == sum(sum(b["held"]) for b in bins)
    return sorted(min(c for c in caps if c >= sum(b["held"])) for b in bins)


def test_packing_by_looking_at_every_bin():
    r = random.Random(1)
    cost = lambda c: packing.OVERHEAD + c * (1 + c / packing.QUADRATIC)
    for _ in range(300):
        lengths = np.array([r.randint(1, r.choice([5, 16, 40, 64])) for _ in range(r.randint(0, 25))], np.int64)
        caps = (16, 32, 64)
        b, slot, cap = packing.pack(lengths, caps)
        fill = np.bincount(b, lengths, minlength=len(cap)) if len(lengths) else np.zeros(0)
        assert (fill <= cap).all() and sorted(cap.tolist()) == slow_pack(lengths.tolist(), caps, cost)


def test_packing_deals_equal_rows_to_many_shards(spark):
    df = spark.range(30_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "7L AS n_tokens").unionByName(
        spark.createDataFrame([(1, 9000), (2, 5), (2, 5)], "doc_id bigint, n_tokens bigint"))
    out = packing.pack_documents(df, shard=1000)
    assert out.count() == 30_000 + 3 + 2
    shards = out.groupBy((F.col("bin_id") / 2**32).cast("int")).count().collect()
    assert len(shards) == 31 and max(r["count"] for r in shards) < 1200
    same = packing.pack_documents(df.repartition(7), shard=1000)
    assert out.exceptAll(same).count() == 0 and same.exceptAll(out).count() == 0
    fill = out.groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("c"), F.max("slot").alias("m")).where("s > capacity OR m <> c - 1")
    assert fill.count() == 0


def test_warc_by_a_plain_model(spark):
    pages = read(spark, "pages").unionByName(spark.createDataFrame([(10**6, None, "x" * 70_000), (10**6 + 1, "u", "x" * 70_000), (10**6 + 1, "u", "x" * 70_000), (None, "v", None)], "page_id bigint, url string, html string"))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last: dict[bytes, object] = {}
    for k, body in rows:
        if body not in last or (k is not None and (last[body] is None or k > last[body])):
            last[body] = k
    want = sorted((str(k), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for k, b in rows)
    for segment in (None, 1000):
        out = (warc.round_trip(pages) if segment is None else warc.round_trip(pages, segment=segment)).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in out) == want
        by = {base64.b32encode(hashlib.sha1(b).digest()).decode(): k for b, k in last.items()}
        for r in out:
            assert r.record_type == "response" and r.refers_to is None and r.page_id == by[r.payload_digest] or r.record_type == "revisit" and r.refers_to == by[r.payload_digest]
        assert sum(r.record_type == "response" for r in out) == len(by)


CLASH = ["__score", "__clean", "__d", "__t", "__lost", "__text", "h", "k", "n", "w", "row", "path", "root", "fp", "bin_id", "html", "start"]


def clashing(spark, rows):
    schema = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, None if t is None else len(t), *CLASH) for i, t in rows], schema)


ODD = [(1, "a b c d e\nsame line of words here"), (1, "a b c d e\nsame line of words here"), (1, "another text"), (None, None), (None, ""), (2, None), (3, " \n"), (4, "word " * 30_000), (5, "same line of words here"), (None, "same line of words here")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_and_clashing_names(spark, rows):
    """Every operator and stage takes nulls, repeats, long texts, empty tables and any column names."""
    docs = clashing(spark, rows)
    n = len(rows)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (5, 0, None), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same line of words here", "x"), (None, None, "x"), (2, "", "x")], "item_id bigint, text string, __clean string")
    ids = sorted(str(i) for i, _ in rows)
    whole = {
        "simhash": simhash.near_duplicates(docs), "counts": tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "ids": tokenfile.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 1), "quality": linecrf.quality(docs, labels),
        "rules": rules.verdicts(docs), "lines": linededup.per_document(docs), "hits": decontaminate.contamination(docs, bench), "licenses": licenses.scan(docs),
    }
    for name, df in whole.items():
        assert sorted(str(r.doc_id) for r in df.collect()) == ids, name
    assert packing.pack_documents(packing.word_lengths(docs)).where("piece = 0").count() == n
    pages = docs.withColumnRenamed("doc_id", "page_id").drop("html").withColumnRenamed("text", "html").withColumn("url", F.lit(None).cast("string"))
    assert sorted(str(r.page_id) for r in warc.round_trip(pages).collect()) == ids
    for stage in (lambda d: linecrf.keep_good(d, labels), linededup.dedup_lines, simhash.keep_one, lambda d: decontaminate.clean(d, bench)):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in CLASH] == CLASH
    if rows:
        left = sorted((str(r.doc_id), str(r.text)[:9]) for r in simhash.keep_one(docs).collect())
        assert [x for x, _ in left] == ["1", "1", "2", "4", "5", "None", "None", "None"]
        again = simhash.keep_one(docs.repartition(3)).collect()
        assert left == sorted((str(r.doc_id), str(r.text)[:9]) for r in again)


def test_classifier_takes_long_documents_into_its_sample(spark, monkeypatch):
    rows = [(i, "\n".join(("good words in a line" if i % 2 else "### !! ##") for _ in range(3000 if i < 4 else 5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    seen = []
    fit = linecrf.fit
    monkeypatch.setattr(linecrf, "fit", lambda x, length, n, q: seen.append(n.tolist()) or fit(x, length, n, q))
    linecrf.train(docs, labels)
    assert max(seen[-1]) == 3000
    monkeypatch.setattr(linecrf, "SAMPLE_LINES", 3100)
    linecrf.train(docs, labels)
    assert sum(seen[-1]) <= 3100


def test_pipeline_stages_keep_their_contract(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in docs.collect())
    assert packed.agg(F.sum("n_tokens")).first()[0] == words
    assert json.dumps(packed.columns)


def test_token_ids_of_many_distinct_words(spark):
    """Some thousands of pre-tokens are encoded in one text; capitals, marks and separators must not show."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcéßA'9-.\x1c\x85\xa0") for _ in range(rng.randint(1, 7))) for _ in range(9000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, 9000, 300)] + ["A", " A ", "a A\x1cA", "", None, "x" * 200]
    e = tokenfile.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(texts)] == want
    calls, library = [], e.pieces
    e.known, e.pieces = {}, type("Counted", (), {"encode_batch_fast": lambda _, t, **k: calls.append(len(t)) or library.encode_batch_fast(t, **k)})()
    assert [x.tolist() for x in e.encode(texts)] == want and 0 < sum(calls) < 10
    assert list(tokenfile.spans(["a" * tokenfile.AT_ONCE, None, "b", "c"])) == [(0, 1), (1, 4)] and list(tokenfile.spans([])) == []


def test_archives_store_what_follows_from_other_columns_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(warc, "cut", lambda df, keep=warc.cut: stored.append(df.columns) or keep(df))
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (None, None, None), (4, "v", "b" * 40000)], "page_id bigint, url string, html string")
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())))
    assert got == sorted(map(str, [(1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "revisit", 2), (None, 0, "response", None), (4, 40000, "response", None)]))
    assert sorted(stored[0]) == ["copy", "digest", "n", "page_id", "url"]
