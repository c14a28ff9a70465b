"""The operators against brute force, and rows that are awkward for their joins: repeated and null ids, clashing names, hot groups."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import bpe, common, exact, fingerprints, jaccard_join, labelled, lines, packing, pii, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def auc(y, score):
    y, order = np.asarray(y), np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    n = y.sum()
    return (rank[y == 1].mean() - (n - 1) / 2) / (len(y) - n)


# --- 1 and 9: tokens -------------------------------------------------------------------------------


def odd_texts(n, seed):
    r = random.Random(seed)
    marks = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i))[0] == "M"]

    def one():
        k = r.random()
        if k < 0.4:
            return r.choice("abcxyz ABC 019'\n.é")
        if k < 0.65:
            return r.choice(marks)
        i = r.randrange(0x80, 0x3000 if k < 0.8 else 0x110000)
        return "x" if 0xD800 <= i < 0xE000 else chr(i)

    # The last ones have marks that only newer tables order.
    return ["".join(one() for _ in range(r.randint(1, 14))) for _ in range(n)] + [f"a{m}̣́b" for m in "࣏࢘࢜࣌࣍́"]


def test_tokens_of_20_000_odd_texts_are_the_librarys():
    texts = odd_texts(20_000, 2)
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    got = [[x for w in words for x in w] for (words,) in bpe.Coder(TOKENIZER, None, [bpe.plain_ids]).encode(texts)]
    assert got == want


def test_words_are_kept_or_taken_over_or_resolved_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 30)
    coder, r = bpe.Coder(TOKENIZER, None, [bpe.plain_ids]), random.Random(1)
    lib = Tokenizer.from_file(TOKENIZER)
    for _ in range(40):
        texts = [" ".join(f"w{r.randrange(60)}" for _ in range(8)) for _ in range(3)]
        assert [[x for w in words for x in w] for (words,) in coder.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(coder.memo[0]) <= 30 + 24


def test_exchanges_empty_sequences():
    r, first, last, bound = random.Random(3), 0, 0, 0
    for _ in range(60):
        lengths = [r.randint(200, 900) for _ in range(60)]
        start = packing.first_moves(lengths, 2048)
        done = packing.local_search(start, lengths, 2048)
        assert sorted(i for b in done for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 2048 for b in done)
        square = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)  # noqa: B023, E731
        assert square(done) >= square(start)
        first, last, bound = first + len(start), last + len(done), bound + packing.least_bins(lengths, 2048)
    assert bound <= last < first and last <= bound * 1.003
    assert packing.least_bins([1100] * 40, 2048) == 40 and packing.least_bins([2048, 1, 2047], 2048) == 2 and packing.least_bins([], 2048) == 0
    assert packing.local_search([], [], 10) == [] and len(packing.local_search([[0], [1]], [6, 6], 10)) == 2


def test_sequences_are_close_to_the_bound(spark):
    cut = packing.pieces(spark.read.parquet(f"{SF}/documents.parquet"), TOKENIZER)
    lengths = [r.length for r in cut.collect()]
    for group in (40_000, 60):
        packed = packing.pack(cut, group=group).toPandas()
        assert sorted(packed["length"]) == sorted(lengths) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
        for _, s in packed.sort_values("offset").groupby("sequence_id"):
            assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        assert packed["sequence_id"].nunique() <= packing.least_bins(lengths, 2048) + (0 if group > 60 else 4)


def test_packing_replaces_clashing_columns_and_takes_ties(spark):
    rows = spark.createDataFrame([(2**60 + 1, 7, 700, "x")] * 6 + [(None, 7, None, "y")], "doc_id long, offset int, length long, _group string")
    packed = packing.pack(rows)
    assert packed.columns == ["doc_id", "length", "_group", "sequence_id", "offset"]
    got = packed.collect()
    assert sorted(r["_group"] for r in got) == ["x"] * 6 + ["y"] and {r.doc_id for r in got} == {2**60 + 1, None} and len({r.sequence_id for r in got}) == 3
    with pytest.raises(ValueError):
        packing.pack_lengths([2049])


# --- 2: fingerprints -------------------------------------------------------------------------------


def test_likeness_against_brute_force(spark):
    r = random.Random(8)
    base = [f"t{r.randrange(80)}" for _ in range(200)]
    texts = []
    for k in range(40):
        words = base[: 200 - 5 * k] + [f"u{r.randrange(80)}" for _ in range(5 * k)]
        texts.append(" ".join(words))
    texts += ["", None, "same", "same"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id // 3: x for x in fingerprints.compare_with_next(docs).collect()}
    texts = [t or "" for t in texts]
    alone = lambda t: fingerprints.Sampler().signatures([t])[0]  # noqa: E731  without a batch around it
    weight = lambda t: Counter(t.split())
    errors = []
    for i in range(len(texts)):
        nxt = texts[i - 1]  # descending doc_id; after the last comes the first
        n = len(texts[i]) // 3
        new = texts[i][: len(texts[i]) - n] + nxt[:n]
        x = got[i]
        assert x.n_chars == len(texts[i]) and x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for shown, t in ((x.fingerprint, texts[i]), (x.edited_fingerprint, new)):
            assert shown == alone(t).astype(">u2").tobytes().hex()
        for near, t in ((x.near_edited, new), (x.near_next, nxt)):
            assert near == pytest.approx(np.mean(alone(texts[i]) == alone(t)))
            a, b = weight(texts[i]), weight(t)
            union = sum((a | b).values())
            errors.append(near - (sum((a & b).values()) / union if union else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06 and max(map(abs, errors)) < 0.2
    assert got[42].fingerprint == got[43].fingerprint and got[43].near_next == 1 and got[41].near_next == 1


def test_order_with_repeated_and_null_ids(spark):
    rows = [(5, f"t{i}") for i in range(50)] + [(None, "n"), (-(2**63), "least"), (2**63 - 1, "most"), (5, "t1"), (5, "t1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.compare_with_next(docs).collect()
    assert len(got) == len(rows) and Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    dealt = fingerprints.in_descending_order(docs).where("NOT guard").collect()
    by_bucket = [[x.doc_id for x in dealt if x.bucket == b] for b in sorted({x.bucket for x in dealt})]
    flat = [i for b in by_bucket for i in b]
    assert flat[0] == 2**63 - 1 and flat[-1] is None and flat[-2] == -(2**63) and len(by_bucket) > 3  # an id may span buckets


# --- 3: similarity join ----------------------------------------------------------------------------


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def near_copies(n, seed, size=60):
    """Texts that lie about the threshold, some that are mostly boilerplate, some of other lengths, exact copies, and blanks."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(size)]
    out = ["", None, " \n", "one two", "one  TWO"]
    for k in range(n):
        t = list(base[: size - (k % 7) * 3])
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = f"n{r.randrange(99)}"
        out.append(" ".join(t))
    out += [" ".join(base[:45] + [f"z{k}{i}" for i in range(15)]) for k in range(n // 3)]
    return out + out[7:12]


@pytest.mark.parametrize("limit", [500_000, 600, 150])
def test_all_links_and_their_number(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    texts = near_copies(36, limit)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, member = jaccard_join.join_pairs(docs)
    sets = word_sets(texts)
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {}
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] != sets[b] and linked(sets[a], sets[b]):
                want[frozenset((first[sets[a]], first[sets[b]]))] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {frozenset((x.doc_a, x.doc_b)): x.similarity for x in pairs.collect()}
    assert got == pytest.approx(want) and pairs.count() == len(want) and len(want) > 20
    for x in member.collect():
        s = sets[x.doc_id]
        assert (x["class"] is None) == (not s) and x.n_shingles == len(s) and x.n_links == sum(linked(s, o) for i, o in enumerate(sets) if i != x.doc_id)


def test_split_groups_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIMIT", 500)
    texts = near_copies(90, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard_join._rows(docs)
    profiles = jaccard_join.profile(rows, jaccard_join.sketch(rows, 5), 5).cache()
    groups = jaccard_join.dealt(jaccard_join.prefix_groups(profiles)).cache()
    assert groups.where("split").groupBy("pivot").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > 1500
    assert groups.groupBy("pivot", "chunk").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 3 * 500
    split = groups.where("split").withColumn("same", F.lit(False))
    visits = jaccard_join.visiting(split, split, False)
    assert visits.groupBy("pivot", "chunk", "block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 6 * 500
    # Only chunks that may hold a partner are visited.
    everyone = split.join(split.select("pivot", F.col("chunk").alias("other")).distinct(), "pivot").where("chunk <> other").count()
    assert 0 < visits.where("visit").count() < everyone


def test_rows_are_judged_one_by_one(spark):
    copy = " ".join(f"a{i}" for i in range(20))
    rows = [(1, copy), (7, copy), (7, "quite another text with words of its own"), (9, "and the last one is other again too"), (None, copy), (None, copy), (None, "alone without an id but with words"), (None, ""), (None, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("key", F.lit("k")).withColumn("root", F.lit(2))
    kept = jaccard_join.keep_one(docs)
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, copy), (7, rows[2][1]), (9, rows[3][1]), (None, rows[6][1]), (None, ""), (None, ""), (3, None)], key=repr)
    twice = spark.createDataFrame([(4, copy), (4, copy), (4, copy + " x")], "doc_id long, text string")
    assert jaccard_join.keep_one(twice).count() == 1
    out = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join_components(docs).collect()}
    assert out[7, 16] == 1 and out[None, 16] == 1 and out[7, 4] == 7
    assert jaccard_join.keep_one(docs.where("false")).count() == 0


# --- 4 and 10: classifiers -------------------------------------------------------------------------


@pytest.mark.parametrize(("query", "label", "divisor", "held", "threshold", "floor"), [(quality.op4, "quality", 5, 0, 0.3, 0.9), (toxicity.op10, "toxic", 3, 1, 0.7, 0.75)])
def test_classifier_queries(spark, query, label, divisor, held, threshold, floor):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[label] is not None and r.doc_id in got and got[r.doc_id].held_out]
    assert auc([r[label] for r in labels], [got[r.doc_id].score for r in labels]) > floor


def test_toxicity_score_against_brute_force(spark):
    texts = ["some plain words", "x" * 200 + "idiot" + "y" * 90, "", "猫が好きです" * 30, "a_b_c " * 40, "word " * 1000]
    m = toxicity.train(["calm words"] * 20 + ["idiot here"] * 20, [0] * 20 + [1] * 20, {0: 20, 1: 20}, rounds=30)

    def gram_ids(word):
        whole, marked = word if isinstance(word, tuple) else (None, f"<{word}>")
        crc = lambda s: zlib.crc32(s.encode()) % toxicity.BUCKETS
        return [crc(marked) if whole is None else whole, *(crc(marked[i : i + n]) for n in (3, 4, 5) for i in range(len(marked) - n + 1))]

    def brute(text):
        words = [p for run in re.findall(r"\w+", text.lower()) for p in toxicity.parts(run)]
        values = []
        for w in words:
            ids = [g for g in gram_ids(w) if m.known[g]]
            values.append(float(np.diff(m.embedding[ids].mean(axis=0) @ m.softmax)[0]) if ids else 0.0)
        step = toxicity.SEGMENT
        starts = [0] if len(values) <= step else [*range(0, len(values) - step, step // 2), len(values) - step]
        best = max((np.mean(values[s : s + step]) for s in starts), default=0.0) if values else 0.0
        return 1 / (1 + np.exp(-(best + m.bias[1] - m.bias[0])))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([brute(t) for t in texts], abs=1e-4)
    # What stands in the middle of a long run counts.
    a, b = ({g for p in toxicity.parts("a" * 40 + w + "b" * 40) for g in toxicity.grams(p)} for w in ("idiot", "clean"))
    assert a != b


def test_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(1, f"text {i:04d}") for i in range(5000)] + [(i, "other") for i in range(2, 60)] + [(60, "x" * (labelled.MAX_CHARS + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 61)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    texts, y, counts = labelled.sample(docs, labels, "quality", F.lit(True), 10)
    assert len(texts) <= 20 and counts == {0: 30, 1: 30} and 0 < sum(y) <= 10
    assert (texts, y, counts) == labelled.sample(docs, labels, "quality", F.lit(True), 10)
    assert "text 0000" in labelled.sample(docs, labels, "quality", F.lit(True), 100)[0]
    assert labelled.sample(docs, labels.where("false"), "quality", F.lit(True), 10) == ([], [], {})
    assert labelled.sample(docs, labels, "toxic", F.lit(True), 10) == ([], [], {})
    none = labels.where("false")
    for module in (quality, toxicity):
        scores = {r.score for r in module.score(docs.limit(50), module.fit(docs, none, F.lit(True))).collect()}
        assert len(scores) == 1  # the prior


# --- 5: lines --------------------------------------------------------------------------------------


def test_lines_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.sql(lines.OP5_SQL).fetchall()}
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.op5(spark, SF).collect()} == want


def test_a_repeat_takes_in_the_lines_beside_it(spark):
    r = random.Random(4)
    passage = [f"line {i} of the passage" for i in range(9)]
    rows, cut = [], 0
    for k in range(60):
        own = [f"own {k} {r.random()}" for _ in range(6)]
        rows.append((k, "\n".join(own[:3] + passage + own[3:])))
    got = {x.doc_id: x for x in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for k in range(1, 60):
        assert f"own {k} " in got[k].text and got[k].text.count("own") == 6  # nothing of its own goes
        cut += got[k].n_removed == 9
    assert cut >= 56  # a passage without a boundary of its own at the right place may keep a line
    off = lines.deduplicate(spark.createDataFrame([(i, "one long line " * 30) for i in range(3)], "doc_id long, text string"), passage=None)
    assert {x.n_removed for x in off.collect()} == {0}
    assert {x.doc_id: x.n_removed for x in lines.deduplicate(off.drop("n_lines", "n_removed")).collect()} == {0: 0, 1: 1, 2: 1}


def test_lines_keep_columns_of_any_name(spark):
    names = ["rid", "chunks", "pos", "doc", "key", "h", "marks", "n_lines", "_gone", "lines"]
    docs = spark.createDataFrame([(1, "a\nb"), (None, "a\nb"), (None, None)], "doc_id long, text string")
    for n in names:
        docs = docs.withColumn(n, F.lit("own"))
    out = lines.deduplicate(docs)
    assert set(out.columns) == {*docs.columns, "n_removed"} and out.count() == 3 and {r.rid for r in out.collect()} == {"own"}


# --- 6, 7, 8 ---------------------------------------------------------------------------------------


def test_pii_scores_and_many_matches(spark):
    many = " ".join(f"a{i}@b.c" for i in range(500))
    docs = spark.createDataFrame([(1, "my card is 4111 1111 1111 1111"), (2, "4111 1111 1111 1111"), (3, many), (4, " x@y.z ")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[1].scored == "card:11:30:1.00" and got[2].scored == "card:0:19:0.85" and got[1].n_spans == 1
    assert got[3].n_email == 500 and got[3].spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", many))
    assert got[4].spans == "email:2:7"


def test_filters_against_counters():
    r = np.random.default_rng(3)
    for bits in (4, 8, None):
        parts = [r.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 300, 700)]
        parts.append(np.concatenate([parts[2][:50]] * 400 + [parts[3][:9]]))
        want = Counter(int(x) for p in parts for x in p)
        merged = exact.Merging()
        for p in parts:
            merged.add(exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.build(p, bits).to_bytes()))
        f = merged.take()
        prints, counts = f.items()
        assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == want and (np.diff(prints.astype(object)) > 0).all() and len(f) == len(want)
        small = exact.CountingQuotientFilter.of_sorted(prints, counts, bits)
        assert all(small.count(k) == v for k, v in want.items()) and not any(small.count(int(x)) for x in r.integers(0, 2**64, 200, dtype=np.uint64))
        again = [exact.CountingQuotientFilter.from_bytes(p.to_bytes()) for _, p in f.ranges(7)]
        assert np.array_equal(np.concatenate([p.prints() for p in again]), prints)


def test_exact_ties_and_routes(spark, monkeypatch):
    docs = spark.createDataFrame([(5, "a b"), (3, "ab "), (4, "a\tb"), (2, "ab"), (9, "x"), (9, "x"), (None, "a  b"), (None, "z")], "doc_id long, text string").withColumn("fp", F.lit(1))
    few = sorted(map(tuple, exact.deduplicate(docs).collect()), key=repr)
    kept = {(r[0], r[3]) for r in few}
    assert (None, True) in kept and {r[1] for r in few if r[2] == 5} == {None}  # the longest text stays, with or without an id
    assert [r[3] for r in few if r[0] == 9] == [True, True]
    monkeypatch.setattr(exact, "BROADCAST", 0)
    assert sorted(map(tuple, exact.deduplicate(docs).collect()), key=repr) == few
    tie = exact.deduplicate(spark.createDataFrame([(5, "a b"), (3, "ab "), (4, "a\tb")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in tie} == {(3, 3, True), (4, 3, False), (5, 3, False)}


SECRETS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute_secrets(text):
    out = []
    for rank, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secret_spans_against_brute_force(spark):
    r = random.Random(6)
    parts = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "abc123", "x", "AKIA", "ABCDEFGHIJKLMNOP", "Z9", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "/+=", "K", "ſecret"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)]
    got = {x.doc_id: x for x in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in SECRETS)
        assert set(want) <= set(got[i].spans.split(","))


def test_ledger_lives_on(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    first = spark.createDataFrame([("a", "password = hunter22"), ("b", "clean"), ("c", "clean"), (None, None)], "path string, text string")
    assert ledger.commit(first, "1", "path") == 3 and ledger.commit(first, "1", "path") == 0 and ledger.history().count() == 4
    second = spark.createDataFrame([("a", "fixed"), ("d", "password = hunter22")], "path string, text string")
    assert ledger.commit(second, "2", "path") == 1
    assert {(r.path, r.version) for r in ledger.found().collect()} == {("a", "1"), ("d", "2")}
    # A later run sees what is there; new rules see every blob again.
    assert secrets.Ledger(spark, f"file://{tmp_path}/ledger").commit(first, "3", "path") == 0
    assert ledger.commit(first, "3", "path", rules="next") == 3 and ledger.found("next").count() == 3


def test_hot_blobs_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "token: abcdef99" if i % 3 else "clean") for i in range(90)] + [(7, "token: abcdef99")], "doc_id long, text string")
    for n in ("_blob", "_starts", "_ends", "blob_", "size", "starts"):
        docs = docs.withColumn(n, F.lit(n))
    out = secrets.masked(docs, secrets.update(docs))
    assert out.schema == docs.schema and out.count() == 91 and out.where("text LIKE '%abcdef%'").count() == 0 and out.where("text = 'clean' AND _blob = '_blob'").count() == 30
    assert secrets.findings(docs, secrets.update(docs)).where("size(kinds) = 1").count() == 61


# --- the pipeline ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def awkward(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    block = "\n".join(f"line {i} of a block that many hold" for i in range(8))
    rows = [(1, words(1)), (1, words(1)), (2, words(1)), (2, words(2)), (None, words(3)), (None, words(3)), (None, None), (4, None), (5, ""), (6, " \n "), (7, f"a\n{block}\nb"), (8, f"c\n{block}\nd"), (9, "password = hunter2222"), (10, words(10) * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    for n in ("rid", "_blob", "offset", "doc", "key", "n_lines", "label", "sequence_id", "length", "piece"):
        docs = docs.withColumn(n, F.lit(n))
    return docs.cache()


@pytest.mark.parametrize("at", range(4))
def test_stages_take_awkward_rows(spark, awkward, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, awkward, SF)
    assert out.columns == awkward.columns and stage(spark, awkward.where("false"), SF).count() == 0
    got = out.collect()
    assert all(r.rid == "rid" and r._blob == "_blob" and r.n_lines == "n_lines" for r in got)
    ids = Counter(r.doc_id for r in got)
    if name == "toxicity":
        assert set(map(repr, got)) <= set(map(repr, awkward.collect()))
    elif name == "line_dedup":
        assert len(got) == awkward.count() and {r.doc_id: r.text for r in got if r.doc_id in (7, 8)} == {7: awkward.where("doc_id = 7").first().text, 8: "c\nd"}
        assert all(r.n_chars is None or r.n_chars == len(r.text) for r in got)
    elif name == "ngram_jaccard_join":
        assert ids == Counter([1, 2, None, None, 4, 5, 6, 7, 9, 10]) or ids == Counter([1, 2, None, None, 4, 5, 6, 7, 8, 9, 10])
    else:
        assert len(got) == awkward.count() and next(r.text for r in got if r.doc_id == 9) == "*" * len("password = hunter2222")


def test_last_stage_and_no_labels(spark, awkward, tmp_path):
    packed = corpus_pipeline.STAGES[4][1](spark, awkward, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in awkward.collect()}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.STAGES[0][1](spark, awkward, str(tmp_path)).count() == awkward.count()
    awkward.where("false").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.op4(spark, str(tmp_path)).count() == 0 and toxicity.op10(spark, str(tmp_path)).count() == 0


def test_pipeline_rows_follow_from_its_stages(spark):
    """The sequence of the stages by hand: no document is lost but by the verdict of a stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), labelled.crc_of_id() % 3 != 1)
    clean = {r.doc_id: r.text or "" for r in docs.collect()}
    p = toxicity.Scorer(model).probabilities([*clean.values()])
    clean = {i: t for (i, t), x in zip(clean.items(), p, strict=True) if x < toxicity.THRESHOLD}
    left = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame([*clean.items()], "doc_id long, text string")).collect()}
    texts = {i: r.text for i, r in left.items() if not (r.n_removed and not r.text.strip(" "))}
    ids = sorted(texts)
    sets, up = word_sets([texts[i] for i in ids]), list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    stay = [ids[k] for k in range(len(ids)) if up[k] == k]
    assert sorted(set(out["doc_id"])) == stay
    lib = Tokenizer.from_file(TOKENIZER)
    for i in stay[::9]:
        text = texts[i]
        for _, a, b in secrets.find(text):
            text = text[:a] + "*" * (b - a) + text[b:]
        assert out[out["doc_id"] == i]["length"].sum() == len(lib.encode(text, add_special_tokens=False).ids) + 1


# --- shared ----------------------------------------------------------------------------------------


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    left = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("long").alias("k"), F.lit("x").alias("size"))
    right = left.where("k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.count("*").alias("weight")).cache()
    for how in ("left", "inner"):
        got = common.join_per_key(left, right, "k", size="weight", how=how)
        want = left.join(right.drop("weight"), "k", how)
        assert set(got.columns) == set(want.columns) and got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()
    assert common.join_per_key(left, right.where("false"), "k", size="weight").count() == 3000
    assert common.join_per_key(left.where("false"), right, "k", size="weight").count() == 0


def test_release_keeps_to_its_account(spark):
    outer = common.materialize(spark.range(3), "outer")
    with common.own_account():
        first, last = common.materialize(spark.range(4), "first"), common.materialize(spark.range(5), "last")
        common.release(spark, keep=1)
        assert last.count() == 5
        with pytest.raises(Exception, match="first"):
            first.count()
    assert outer.count() == 3
