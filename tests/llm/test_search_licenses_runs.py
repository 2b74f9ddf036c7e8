"""Ranked lexical search, licence scans and periodic runs against brute force and hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkglass.llm import lexical_search, license_scan, periodic_runs, queries

ID_TEXT = "doc_id long, text string, item_id long, term string, rank int"


def documents(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "x", 0) for r in rows], ID_TEXT)


# ---- 11: ranked lexical search ---------------------------------------------------------


def terms_of(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute_search(docs, items, k=10):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    big_n, big_l = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c in counted:
            m = 10 + 90 * c.total() * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("shard_terms", [1, 60, 10**6])
def test_search_equals_brute_force(spark, shard_terms):
    r = random.Random(shard_terms)
    vocabulary = [f"t{i}" for i in range(30)] + ["Été", "日本", "I", "i"]
    docs = [(i // 2 * 2 if i % 7 else None, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 9, 40])))) for i in range(160)]
    docs += [docs[5]] * 12 + [(500, None), (501, "-.,!"), (-3, "t1 t1 t2"), (-4, "t1 t1 t2")]
    r.shuffle(docs)
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 8])))) for i in range(25)] + [(3, "t5"), (90, ""), (91, None), (92, "nowhere"), (None, "T1 t2")]
    found = lexical_search.search(documents(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), shard_terms=shard_terms, block_pairs=40)
    assert told(found) == brute_search(docs, items)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    nothing = items.limit(0)
    some = documents(spark, [(1, "a"), (2, None)])
    assert told(lexical_search.search(some, nothing)) == told(lexical_search.search(some.limit(0), items)) == []
    assert told(lexical_search.search(documents(spark, [(1, None), (2, "..")]), items)) == []


def test_long_texts_and_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(100, "word " * 300_000 + "here")]
    found = told(lexical_search.search(documents(spark, docs), spark.createDataFrame([(1, "same word")], "item_id long, text string")))
    assert found == brute_search(docs, [(1, "same word")])


def index_in_memory(docs, shard_terms=10**9):
    big_n, big_l = sum(1 for _, t in docs if terms_of(t)), sum(len(terms_of(t)) for _, t in docs)
    batch = pa.RecordBatch.from_pydict({"id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    return [lexical_search.Shard(b.to_pylist()[0]) for b in lexical_search._shards(iter([batch]), big_n, big_l, shard_terms)]


def test_treaps_are_trees_of_documents_and_heaps_of_impacts():
    r = random.Random(4)
    (shard,) = index_in_memory([(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 30)))) for i in range(300)])
    for term in range(len(shard.counts)):
        seen = []

        def walk(node):
            if node < 0:
                return
            for child in (shard.lefts[node], shard.rights[node]):
                assert child < 0 or shard.impacts[child] <= shard.impacts[node]
            walk(shard.lefts[node])
            seen.append(node)
            walk(shard.rights[node])

        walk(shard.root(term))
        start = shard.starts[term]
        assert seen == list(range(start, start + shard.counts[term])) and (shard.keys[seen][1:] > shard.keys[seen][:-1]).all()


def test_search_scores_few_documents():
    r = random.Random(9)
    common, rare = [f"c{i}" for i in range(50)], [f"r{i}" for i in range(2000)]
    docs = [(i, " ".join(r.choices(common, k=20) + r.choices(rare, k=20))) for i in range(5000)]
    (shard,) = index_in_memory(docs)
    tops = [[]]
    scored = lexical_search.search_shard(shard, [[("c1", 900), ("r1", 5000), ("r2", 5000), ("r3", 5000)]], 10, tops)
    assert len(tops[0]) == 10 and scored < 500


def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    expected = con.execute(queries.OP11_SQL).fetchall()
    assert told(queries.op11_lexical_search(spark, "/root/testdata/sf0.001")) == sorted(expected, key=str)


# ---- 12: licence scans -----------------------------------------------------------------


def words_of(text):
    return terms_of(text)


def brute_places(words):
    out = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        out += [(label, i, i + len(p)) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out)


def scanned(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", license_scan.find_licenses(F.col("t")).alias("f")).collect()
    return [r.f for r in sorted(rows, key=lambda r: r.i)]


def test_base_phrases_equal_brute_force(spark):
    r = random.Random(6)
    pieces = ["GNU", "gnu general public license", "General", "public", "LICENSE", "apache", "Apache-License", "cc", "by", "CC BY-NC", "mit", "MIT.license", "é", "x", "the", "the software is provided", "3"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(200)]
    for text, found in zip(texts, scanned(spark, *texts), strict=True):
        words = words_of(text)
        assert found.n_words == len(words) and sorted(tuple(p) for p in found.places) == brute_places(words)


def test_matching_statistics_equal_brute_force():
    r = random.Random(8)
    sequences = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 12))] for _ in range(6)]
    automaton = license_scan.Automaton(sequences)
    joined = [b" " + b" ".join(s) + b" " for s in sequences]
    for _ in range(200):
        text = [r.choice([b"a", b"b", b"c", b"c", b"z"]) for _ in range(30)]
        sizes = {i: (state, size) for i, state, size in automaton.follow(iter([text[:11], text[11:]]))}
        for i in range(len(text)):
            longest = max(n for n in range(i + 2) if n == 0 or any(b" " + b" ".join(text[i + 1 - n : i + 1]) + b" " in s for s in joined))
            assert sizes.get(i, (0, 0))[1] == longest
            if longest:
                state, size = sizes[i]
                stretch = text[i + 1 - size : i + 1]
                ends = {(w, at + size) for w, s in enumerate(sequences) for at in range(len(s) - size + 1) if s[at : at + size] == stretch}
                assert set(automaton.ends[state]) == ends
                suffixes = {w for w, s in enumerate(sequences) if s == text[i + 1 - len(s) : i + 1] and len(s) <= i + 1}
                assert {w for w in automaton.whole[state] if len(sequences[w]) <= size} == suffixes


def test_notices_are_found_and_changed_ones_too(spark):
    texts = []
    for _, notice in license_scan.NOTICES:
        words = notice.split()
        dropped = [w for i, w in enumerate(words) if i % 17 != 9]
        texts += [f"before {notice.upper()} after", "x " * 50 + " ".join(dropped), " ".join(words[: len(words) // 3])]
    found = scanned(spark, *texts)
    for k, (label, notice) in enumerate(license_scan.NOTICES):
        whole, changed, part = ([(s.label, s.share) for s in f.spans if s.label == label] for f in found[3 * k : 3 * k + 3])
        assert whole == [(label, 1.0)] and len(changed) == 1 and 0.6 <= changed[0][1] < 1 and not part
        (span,) = (s for s in found[3 * k].spans if s.label == label)
        assert (span.start, span.end) == (1, 1 + len(words_of(notice)))


def test_license_hard_cases(spark):
    notice = license_scan.NOTICES[0][1]
    long = "word " * 400_000 + notice + " no" * 300_000 + " MIT license"
    empty, none, plain, far, huge = scanned(spark, "", None, "just some words", long, "x" * 5_000_000 + " cc by")
    for f in (empty, none):
        assert (f.n_words, f.places, f.spans, f.score) == (0, [], [], 0.0)
    assert (plain.n_words, plain.score) == (3, 0.0)
    assert [(s.label, s.start) for s in far.spans] == [("mit-text", 400_000)] and far.score == 1.0 and len(far.places) == 1
    assert huge.n_words == 3 and huge.places[0].start == 1


def test_license_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op12_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and any(r.n_base for r in rows)
    for r in rows:
        words = words_of(docs[r.doc_id])
        places = brute_places(words)
        starts = [p[1] for p in places]
        base = sorted({p[0] for p in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
        assert set(base) <= set(r.labels.split(",")) or not base
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(base)


# ---- 13: periodic runs -----------------------------------------------------------------


def brute_runs(w):
    """Maximal stretches of each period, shortest period first, by walking over all pairs."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic_texts(n):
    r = random.Random(3)
    out = []
    for _ in range(n):
        k, size = r.choice([1, 2, 3, 60]), r.choice([0, 1, 5, 6, 7, 20, 150])
        w = [f"w{r.randint(1, k)}" for _ in range(size)]
        for _ in range(r.choice([0, 0, 1, 2])):
            if size > 12:
                p, a = r.randint(1, size // 4), r.randint(0, size - 1)
                b = r.randint(a, size)
                w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
        out.append(r.choice([" ", "\n", " \t "]).join(w))
    return out


def test_runs_equal_brute_force(spark):
    texts = periodic_texts(600)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", periodic_runs.periodic_runs(F.col("t")).alias("f")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        w = texts[row.i].split()
        runs = brute_runs(w)
        assert (row.f.n_words, [tuple(x) for x in row.f.runs]) == (len(w), runs), texts[row.i]
        assert row.f.collapsed == brute_collapsed(w, runs)


def test_runs_hard_cases(spark):
    texts = [None, "", " \n\t", "a b  c", "a " * 200_000, "ab cd " * 50_000 + "x " + "é " * 7]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", periodic_runs.periodic_runs(F.col("t")).alias("f")).collect()
    found = [r.f for r in sorted(rows, key=lambda r: r.i)]
    for f in found[:3]:
        assert (f.n_words, f.runs, f.collapsed) == (0, [], "")
    assert (found[3].n_words, found[3].collapsed) == (2, texts[3])  # only ASCII white space parts words
    assert [tuple(x) for x in found[4].runs] == [(0, 200_000, 1)] and found[4].collapsed == "a"
    assert [tuple(x) for x in found[5].runs] == [(0, 100_000, 2), (100_001, 7, 1)] and found[5].collapsed == "ab cd x é"


def test_common_prefixes_of_suffixes():
    import numpy as np

    r = random.Random(2)
    for n in (1, 2, 9, 200):
        a = np.array([r.randint(0, 2) for _ in range(n)])
        order, rank, common = periodic_runs.suffix_array(a)
        listed = a.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: listed[i:]) and rank[order].tolist() == list(range(n))
        for k in range(1, n):
            x, y = listed[order[k - 1] :], listed[order[k] :]
            assert common[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_runs_query_equals_brute_force(spark, tmp_path):
    texts = [*periodic_texts(150), None, "", "one two three " * 30, "x"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1 and rows[None].n_runs == 1
    changed = 0
    for i, text in enumerate(texts):
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs = brute_runs(w)
        r = rows[i]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert changed > 5
