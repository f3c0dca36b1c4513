"""Text operators against brute force, exact round trips and edge cases."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark import llm
from tidemark.llm import bpe, fingerprint, html_extract, knn, langid, line_dedup, linking, ngram_join, packing, quotes, url_filter
from tidemark.llm.common import components, save

SF = "/root/testdata/sf0.001"
WEIRD = [
    (1, "", "en"), (2, None, "en"), (3, " \n\t ", None), (4, "One two three four five six seven eight.", "en"), (4, "One two three four five six seven eight.", "en"),
    (5, "one two THREE four five six seven eight.", "en"), (None, "one two three four five six seven eight.", "en"), (6, "x" * 50_000, None), (7, "日本語 ½ 🎉\nline", None), (8, "a b", "en"), (9, "A B", "en"),
]


@pytest.fixture(scope="module")
def weird(spark):
    return spark.createDataFrame(WEIRD, "doc_id long, text string, lang string").withColumn("id", F.lit(9)).withColumn("key", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


# ---- shared


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(None, 1), (5, 5)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op1


def test_urls_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(tuple, url_filter.op1_url_filter(spark, SF).select(*columns).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.OP1_SQL})").fetchall(), key=str)


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.Example.org/es/1?x", "http://example.org/en/12", "http://notexample.org/es/", "x://b.com/fr/?q", "http://É.com/de/x", "http://example.org/es", "ftp://u@h:8/p#f"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("org", "/", "org/", "allow") and got[5] == ("org", "", None, "allow")
    assert got[6] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[7][2:] == ("example.org/en/1", "block")
    assert got[8][2:] == ("org/", "allow") and got[9][2:] == ("com/fr/", "allow") and got[10] == ("É.com", "/de/x", "com/de/", "block")
    assert got[11][2:] == ("org/", "allow") and got[12][:2] == ("u@h:8", "/p")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, [], "block").collect()} == {"block"}


def test_url_collisions_are_confirmed(tmp_path):
    names = url_filter.write_index([("a/x", "block")], str(tmp_path))
    index = url_filter.DigestArray(lambda n: str(tmp_path / n), names)
    stored = index.text.tobytes()
    assert index.rule(index.probe(["a"], ["/x"])[0]) == "a/x"
    for other in (stored.replace(b"a/x", b"b/x"), stored.replace(b"a2", b"b2")):  # same digest, another string
        assert other != stored
        index.text = np.frombuffer(other, np.uint8)
        assert index.probe(["a"], ["/x"]) == [-1]


def test_url_very_long(spark):
    host = ".".join(["a"] * 300_000) + ".example.org"
    rows = [(1, f"http://{host}/es/x"), (2, "http://org/" + "p" * 1_000_000), (3, "http://x.fr.com/fr/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("com/fr/", "allow")}


# ---- op2


def test_bpe_equals_library_and_round_trips(spark, docs, weird):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    texts = docs["text"].tolist()[:60] + [t or "" for _, t, _ in WEIRD] + ["aaaaaaaaaab" * 300, "<|endoftext|>", "\r\n \x00\x85  é"]
    for text in texts:
        ids = theirs.encode_ordinary(text)
        assert ours.encode(text) == ids and ours.decode(ids) == text.encode()
    for (n, ids_sha, text_sha), text in zip(ours.digests(texts, 7), texts, strict=True):
        ids = theirs.encode_ordinary(text)
        assert (n, ids_sha, text_sha) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    out = bpe.encode_documents(weird, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert out.count() == len(WEIRD) and {r["n_tokens"] for r in out.where("doc_id in (1, 2)").collect()} == {0}
    assert bpe.encode_documents(weird.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_long_pieces():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ours, theirs = bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "a", "日本語éü"):
        text = "".join(rnd.choice(letters) for _ in range(6000))
        assert ours.encode(text) == theirs.encode(text)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    assert ours.decode(ours.encode(text)).decode() == text


# ---- op3


def test_prefix_hash_spans_and_extensions():
    a, b = "the cat sat on the mat", "a cat sat on the map"
    x, y = fingerprint.PrefixHash(fingerprint.codes(a)), fingerprint.PrefixHash(fingerprint.codes(b))
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.common_extension(i, y, j) == n
    assert x.equal(4, y, 2, 5) and not x.equal(4, y, 3, 5)


def test_fingerprints(spark, docs, weird):
    got = {r["doc_id"]: r for r in fingerprint.op3_document_fingerprints(spark, SF).collect()}
    line = docs.sort_values("doc_id", ascending=False)
    texts, ids = line["text"].tolist(), line["doc_id"].tolist()
    prints = {}
    for k, i in enumerate(ids):
        r, following = got[i], texts[(k + 1) % len(ids)]
        changed = fingerprint.edited(texts[k], following)
        assert r["n_chars"] == len(texts[k]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, other = (fingerprint.fingerprint(fingerprint.codes(t)) for t in (texts[k], changed))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other) and 0 <= r["near_next"] <= 1
        assert r["near_edited"] == fingerprint.likeness(own, other)
        assert prints.setdefault(texts[k], own) == own
    rows = fingerprint.fingerprint_documents(weird).collect()
    assert len(rows) == len(WEIRD) and sorted(r["doc_id"] or 0 for r in rows) == sorted(i or 0 for i, _, _ in WEIRD)
    assert fingerprint.fingerprint_documents(weird.limit(0)).count() == 0
    one = fingerprint.fingerprint_documents(weird.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def slow_fingerprint(text):
    """From the definition, one code point at a time."""
    c = [ord(x) + 1 for x in text]
    whole = "".join(f"{sum(v * pow(int(x), j, int(p)) for j, v in enumerate(c)) % int(p):08x}" for p, x in ((2147483647, 1_000_003), (2147483629, 91_138_233)))
    k, found = min(16, len(c)), set()
    for i in range(len(c) - k + 1 if c else 0):
        h = sum(v * pow(1_000_003, j, 2147483647) for j, v in enumerate(c[i : i + k])) % 2147483647
        h = h * 0x9E3779B97F4A7C15 % 2**64
        found.add(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> 32)
    return whole + "".join(f"{h:08x}" for h in sorted(found)[:64])


def test_fingerprints_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CHUNK", 300)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé日") for _ in range(rnd.randrange(1, 9)))
    passage = " ".join(word() for _ in range(150))
    texts = ["", "a", "x" * 1000] + [" ".join(word() for _ in range(rnd.randrange(300))) for _ in range(12)]
    texts += [texts[-1], texts[-1][:-40] + "!", "start " + passage + " end", " ".join(word() for _ in range(20)) + passage + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(df).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]  # the next lower id, and after the last the first
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, other, following = map(slow_fingerprint, (t, changed, after))
        sketch = lambda f: {f[j : j + 8] for j in range(16, len(f), 8)}

        def near(x, y):
            union = sorted(sketch(x) | sketch(y))[:64]
            return 1.0 if x == y else sum(h in sketch(x) & sketch(y) for h in union) / len(union) if union else 0.0

        prefix = next((k for k, (a, b) in enumerate(zip(t, changed, strict=False)) if a != b), min(len(t), len(changed)))
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"], r["shared_prefix"]) == (own, other, prefix)
        assert (r["near_edited"], r["near_next"]) == (near(own, other), near(own, following))
    n = len(texts) - 1
    assert got[n]["shared_next"] >= len(passage) and got[n - 2]["shared_next"] == len(texts[n - 2]) - 1 and got[n - 3]["shared_next"] == len(texts[-4]) and got[1]["shared_next"] == 0


def test_fingerprint_ids_far_apart(spark):
    ids = [0, 1, 5, 2**20, 2**20 + 300, 2**40, 2**62, -7, -(2**50)]
    df = spark.createDataFrame([(i, f"text number {i} " * 5) for i in ids], "doc_id long, text string")
    texts = {i: f"text number {i} " * 5 for i in ids}
    line = sorted(ids, reverse=True)
    want = {i: hashlib.sha256(fingerprint.edited(texts[i], texts[line[(k + 1) % len(line)]]).encode()).hexdigest() for k, i in enumerate(line)}
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprint_documents(df).collect()} == want


# ---- op4


def brute_links(rows, size, percent):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, docs, size, percent):
    rnd = random.Random(size)
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    for k in range(160):  # a family of near copies around the threshold
        words = list(base)
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(120)] = f"v{rnd.randrange(50)}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000 + k, " ".join(["the same line"] * 3 + [f"u{k}"] * rnd.randrange(3))) for k in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert got == brute_links(rows, size, percent)


def test_ngram_join_edges(spark, weird):
    rows = ngram_join.join_documents(weird, 3, 90).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert len(rows) == len(WEIRD) and got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)}
    assert got[4] == got[5] == {(6, 4)} and got[None] == {(6, None)} and got[8] == got[9] == {(1, 8)} and got[6] == {(1, 6)}
    assert ngram_join.join_documents(weird.limit(0)).count() == 0
    kept = ngram_join.keep_one(weird, 3, 90)
    assert kept.columns == weird.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8]


def test_cells_emit_fewer_rows_than_items():
    sets = [(i, np.array([1, 2, 3], np.uint64)) for i in range(50)]
    index, joined = linking._index(sets[:25]), {}
    for i, t in sets[25:]:
        for a in linking._partners(index, t, 90):
            x, y = sorted((linking._root(joined, a), linking._root(joined, i)))
            joined[y] = x
    assert len(linking._stars(joined)) == 49


# ---- op5


def test_language_held_out_accuracy(spark, docs):
    got = {r["doc_id"]: r for r in langid.op5_language_id(spark, SF).collect()}
    held = [i for i in docs["doc_id"] if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    langs = docs.set_index("doc_id")["lang"]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark, weird):
    rows = langid.identify(weird).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["lang_pred"])
    assert len(rows) == len(WEIRD) and got[1] == got[2] == got[3] == {"und"} and got[8] <= {"en", "und"}
    assert {r["lang_pred"] for r in langid.identify(weird.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(weird.limit(0)).count() == 0 and langid.keep_identified(weird).columns == weird.columns


def test_false_positives_are_corrected():
    rnd = np.random.default_rng(0)
    f = langid.LanguageFilter({"a": rnd.integers(1, 2**62, 6000), "b": rnd.integers(1, 2**62, 6000)})
    h = rnd.integers(1, 2**62, 50_000).astype(np.uint64)
    hits = np.count_nonzero(f.masks(h) & np.uint64(1))
    assert abs(hits - len(h) * f.false[0]) < 60


def test_language_sample_counts_copies_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    word = lambda k, letters: " ".join(letters[(k + j * j) % 8] * 2 + letters[(k // 8 + j) % 8] + letters[k // 64] for j in range(9))
    rows = [("xx", "kilo wemu zafi topu rano")] * 400 + [("yy", word(k, "abcdefgh")) for k in range(100)] + [("yy", word(0, "abcdefgh"))] * 300 + [("zz", "123 ?")] * 50
    rows += [("ww", word(k, "mnoprstu")) for k in range(3)] * 200
    df = spark.createDataFrame(rows, "lang string, text string")
    sample = [tuple(r) for r in langid.learning_sample(df).select("lang", "text").collect()]
    assert len(sample) == len(set(sample)) and {x: sum(lang == x for lang, _ in sample) for x in ("xx", "yy", "zz", "ww")} == {"xx": 1, "yy": 20, "zz": 0, "ww": 3}
    assert langid.fit(df).languages == ["ww", "xx", "yy"]


# ---- op6


def test_knn_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, knn.op6_voronoi_knn(spark, SF).select(*columns).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({knn.OP6_SQL})").fetchall())


def test_knn_edges(spark, monkeypatch):
    monkeypatch.setattr(knn, "NUMBERS", 8)
    monkeypatch.setattr(knn, "CELL_ROWS", 1)
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (8, [0.0, 3.0])] + [(10 + i, [0.001 * i, 0.2]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    fine = {i: np.floor(1024 * np.array(v + [0.0] * (2 - len(v)))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (0, 100):
        best = sorted(((-int(fine[q] @ x), i) for i, x in fine.items() if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0 and knn.top_k(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


def test_knn_repeated_query_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0])] * 2 + [(100, [1.0, 0.0]), (100, [0.0, -1.0])] + [(i, [1.0 + 0.001 * i, 0.0]) for i in range(1, 6)] + [(i, [0.001 * i, 2.0]) for i in range(200, 260) if i != 200]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding"])
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.register("embeddings", frame)
    columns = ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, knn.op6_voronoi_knn(spark, str(tmp_path)).select(*columns).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({knn.OP6_SQL})").fetchall())


def test_knn_against_brute_force(spark, monkeypatch):
    """Clusters, repeated rows and ids, cells smaller than k, wide and huge vectors, many chunks and groups."""
    monkeypatch.setattr(knn, "NUMBERS", 1 << 11)
    monkeypatch.setattr(knn, "HEAD", 16)
    monkeypatch.setattr(knn, "CELL_ROWS", 64)
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(20, 8)) * 3
    rows = [(i, (centres[i % 20] + rnd.normal(size=8) * 0.1).tolist()) for i in range(2000)]
    share, shipped = knn.visited_share(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert share < 0.4 and shipped < 0.7  # clusters: most chunks stay closed
    rows += [rows[0]] * 12 + [rows[100]] * 2 + [(7, [0.5])] * 50 + [(8, []), (9, [2e5] * 3), (200, [1e12, 1.0]), (300, [0.1] * 40), (10, [0.2] * 40)]
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for q in {i for i, _ in rows if i % 100 == 0}:
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, x, strict=False)))), i) for own, v in fine if own == q for i, x in fine if i != q]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:10])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


# ---- op7


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "> how are  you?\nFine."), (1, 2, "u", "> > How are you?\n> Fine.\nGood"), (1, 3, "b", "On Mon, X wrote:\n> Good\nBye"),
        (1, 4, "b", "> unknown\nnew"), (2, 0, "u", None), (None, 1, "u", "> a"), (2, 1, "x", ""), (1, 5, "u", "> Hello there\n> How are you?\nagain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1))
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["depth"], r["text"]) for r in quotes.link_quotes(df).collect()}
    assert got == {
        (1, 0): (None, 0, "Hello there\nHow are you?"), (1, 1): (0, 1, "Fine."), (1, 2): (1, 2, "Good"), (1, 3): (2, 3, "Bye"), (1, 4): (None, 0, "> unknown\nnew"),
        (2, 0): (None, 0, None), (None, 1): (None, 0, "> a"), (2, 1): (None, 0, ""), (1, 5): (0, 1, "again"),
    }
    order = [r["turn"] for r in quotes.link_quotes(df.where("conv_id = 1")).orderBy("thread_turn", "reply_order").collect()]
    assert order == [0, 1, 2, 3, 5, 4] and quotes.link_quotes(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(1, k, "u", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(20)], "conv_id long, turn long, role string, text string")
    assert [r["depth"] for r in quotes.link_quotes(chain).orderBy("turn").collect()] == list(range(20))
    assert quotes.op7_quotation_linking(spark, SF).count() == 87


def test_quotes_wrapped_partial_and_deeper(spark):
    rows = [
        (1, 0, "The harbour office opens at nine, and the ferry leaves\nshortly after ten. Bring both tickets."),
        (1, 1, "> The harbour office opens at\n> nine, and the ferry leaves shortly\n> after ten.\nWhich gate?"),
        (1, 2, "> the ferry leaves\nAnd when does it return?"),
        (1, 3, "> whichever gate was it\n> > The harbour office opens at nine,\n> > and the ferry leaves shortly after ten.\nGate four."),
        (1, 4, "> nothing of this kind\nHm."),
        (1, 5, "> Which\n> gate?\nFive."),
        (2, 0, "船は十時に出ます。切符を忘れずに。"), (2, 1, "> 切符を忘れずに\nはい"),
    ]
    df = spark.createDataFrame([(c, k, "u", t) for c, k, t in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotes.link_quotes(df).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): None, (1, 5): 1, (2, 0): None, (2, 1): 0}


def test_quotes_against_generated_mail(spark):
    """Trees of 1,500 messages: quotes wrapped anew, cited in part, nested, with strangers' words, a chain and a star."""
    rnd = random.Random(7)

    def wrapped(marks, text):
        words, out, width = text.split(), [], rnd.randrange(20, 60)
        while words:
            line = [words.pop(0)]
            while words and len(" ".join([*line, words[0]])) < width:
                line.append(words.pop(0))
            out.append(f"{marks} " + " ".join(line))
        return out

    rows, parent, wrote, quoted = [], {}, {}, {}
    for conv in range(30):
        n = 300 if conv < 2 else 32
        for k in range(n):
            up = None if k == 0 or rnd.random() < 0.1 and conv > 1 else k - 1 if conv == 0 else 0 if conv == 1 else rnd.randrange(k)
            own = [" ".join(f"w{rnd.randrange(10**5)}" for _ in range(rnd.randrange(4, 12))) + "." for _ in range(3)]
            lines = []
            if up is not None:
                lines = ["On Monday, someone wrote:"] * (rnd.random() < 0.5)
                cited = rnd.choice(wrote[conv, up])
                if rnd.random() < 0.5 and quoted.get((conv, up)):  # the parent's own quote comes along
                    lines += wrapped("> >", quoted[conv, up])
                lines += wrapped(">", cited.upper() if rnd.random() < 0.2 else cited)
                quoted[conv, k] = cited
            elif rnd.random() < 0.5:
                lines = ["> these words were never written"]
            parent[conv, k], wrote[conv, k] = up, own
            rows.append((conv, k, "u", "\n".join([*lines, *own])))
    want = {}
    for conv in range(30):
        children, turns = defaultdict(list), sorted(k for c, k in parent if c == conv)
        for k in turns:
            children[parent[conv, k]].append(k)
        for top in children[None]:
            stack, order = [(top, 0)], 0
            while stack:
                k, depth = stack.pop()
                want[conv, k] = (parent[conv, k], top, order, depth)
                order += 1
                stack += [(c, depth + 1) for c in reversed(children[k])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["thread_turn"], r["reply_order"], r["depth"]) for r in quotes.link_quotes(df).collect()}
    assert got == want


def test_quotes_of_common_words(spark):
    """A reply goes to the message that holds the whole quote, not to the latest that shares some of its words."""
    rows = [
        (1, 1, "I think we should thank you for the work you did last week."), (1, 2, "Really, thank you for the cake. And for the tea."), (1, 3, "> thank you for the work\nYou are welcome."),
        (1, 4, "Try this:\n>>> print(1)\n1"), (1, 5, "> Really, thank you for the cake.\n> nobody wrote this here at all\n\nIt was good.\n\n> words from elsewhere, not here\nIndeed."),
    ]
    df = spark.createDataFrame([(c, k, "u", t) for c, k, t in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["parent_turn"], r["text"]) for r in quotes.link_quotes(df).collect()}
    assert got == {1: (None, rows[0][2]), 2: (None, rows[1][2]), 3: (1, "You are welcome."), 4: (None, rows[3][2]), 5: (2, "It was good.\n\n> words from elsewhere, not here\nIndeed.")}


def test_quotes_against_brute_force_with_few_words(spark):
    """With 40 words every window has many writers; the parent is one that holds the whole quote, the latest of these."""
    rnd = random.Random(8)
    rows, texts, want = [], {}, {}
    for conv in range(6):
        for k in range(60):
            own = " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(15, 40)))
            lines, up = [], rnd.randrange(k) if k and rnd.random() < 0.7 else None
            if up is not None:
                said = texts[conv, up].split()
                n = rnd.randrange(6, 13)
                at = rnd.randrange(len(said) - n)
                quote = " ".join(said[at : at + n])
                lines = ["> " + " ".join(said[at : at + 4]), "> " + " ".join(said[at + 4 : at + n])]
                want[conv, k] = max(t for t in range(k) if f" {quote} " in f" {texts[conv, t]} ")
            texts[conv, k] = own
            rows.append((conv, k, "u", "\n".join([*lines, own])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["text"]) for r in quotes.link_quotes(df).collect()}
    wrong = [key for key in got if got[key][0] != want.get(key)]
    assert len(wrong) <= 0.01 * len(want) and all(got[key][1] == texts[key] for key in want)


# ---- op8


def test_boundaries_are_optimal():
    import itertools

    rnd = random.Random(2)
    for _ in range(20):
        lengths = sorted(rnd.sample(range(1, 60), 7))
        counts = [rnd.randrange(1, 9) for _ in lengths]
        for k in (1, 2, 3):
            def padding(tops):
                return sum(c * (next(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts, strict=True))

            best = min(padding((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], k - 1))
            assert padding(packing.boundaries(np.array(lengths), np.array(counts), k)) == best


def test_packing(spark, weird):
    for df in (weird, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = packing.pack(df, budget=2000).collect()
        assert len(rows) == df.count()
        batches = defaultdict(list)
        for r in rows:
            batches[r["batch_id"]].append(r)
        for b in batches.values():
            assert sorted(r["slot"] for r in b) == list(range(len(b))) and {r["batch_docs"] for r in b} == {len(b)} and len({r["bucket_len"] for r in b}) == 1
            assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= 2000
            assert all(r["n_tokens"] <= r["bucket_len"] for r in b)
        tops = defaultdict(int)
        for r in rows:
            tops[r["bucket_len"]] = max(tops[r["bucket_len"]], r["n_tokens"])
        assert all(k == v for k, v in tops.items())
    words = {(r["doc_id"], r["n_tokens"]) for r in packing.pack(weird).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 8), (8, 2)} <= words and packing.pack(weird.limit(0)).count() == 0


def test_packing_against_all_boundaries(spark, monkeypatch):
    """Long texts, and many rows of one id and one length, which are dealt into shards."""
    import itertools

    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    lengths = [3, 40, 1100, 1111, 2050, 5003]
    rows = [(k, " ".join(["w"] * n)) for n in lengths for k in range(n % 7 + 1)] + [(None, "a b")] * 400 + [(5, "a")] * 300
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()
    sizes = sorted(len(t.split()) for _, t in rows)
    best = min(sum(next(b for b in (*c, 5003) if b >= n) - n for n in sizes) for c in itertools.combinations([1, 2, 3, 40, 1100, 1111, 2050], 2))
    assert sum(r["bucket_len"] - r["n_tokens"] for r in packed) == best and len(packed) == len(rows)
    assert max(len(list(g)) for _, g in itertools.groupby(sorted(r["batch_id"].rsplit("-", 1)[0] for r in packed))) <= 2 * 50 + 50
    counted = packing.pack(spark.createDataFrame([(1, "a b", 7), (2, "a", None)], "doc_id long, text string, n int"), tokens_col="n").collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in counted} == {(1, 7), (2, 0)}


# ---- op9


def test_html_cases(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><!-- x -->
    <div class="ad">Buy now, cheap.</div><article><h1>Head &amp; line</h1><p><b>Bold   text,<br><p>Second&nbsp;one. &lt;tag&gt;<ul><li>item one<li>item two</ul></article>
    <aside>Side, text.</aside><div id="comments"><p>I disagree, strongly.</p></div><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line\nBold text,\nSecond one. <tag>\nitem one\nitem two"
    page2 = '<body class="no-sidebar"><div id="main" class="content with-sidebar"><article><div class="article-header"><h1>T</h1></div><p>Some text, here.</p><article class="comment"><p>Mine.</p></article></article></div></body>'
    assert html_extract.main_text(page2) == "T\nSome text, here."
    assert html_extract.main_text("<article><p>cut off &am") == "cut off &am" and html_extract.main_text("<article><p>cut <b") == "cut"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    df = spark.createDataFrame([(1, None, None, "c"), (2, "u", page, "c"), (2, "u", page, "c")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()) == [(1, 0), (2, 58), (2, 58)]


def test_html_ratios_decide(spark, monkeypatch):
    """Without what the markup says nothing changes on the tables; without the densities pages change."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"].tolist()
    full = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "MARKED", 1.0)
    assert [html_extract.main_text(p) for p in pages] == full
    monkeypatch.setattr(html_extract, "TITLE", 0)
    same = sum(html_extract.main_text(p) == f for p, f in zip(pages, full, strict=True))
    monkeypatch.setattr(html_extract, "density", lambda *_: 1.0)
    constant = sum(html_extract.main_text(p) == f for p, f in zip(pages, full, strict=True))
    assert same > 0.9 * len(pages) > constant


def test_html_long_and_broken_pages():
    assert html_extract.main_text('<a href="x>foo</a>') == "foo" and html_extract.main_text('<p title="a>b">one</p>') == "one"
    deep = "<div>" * 20_000 + "deep words." + "</div>" * 20_000
    assert html_extract.main_text(deep) == "deep words."
    page = "<body>" + "".join(f"<p>paragraph {i}, with words.</p>" for i in range(40_000)) + "</body>"
    assert html_extract.main_text(page).count("\n") == 39_999
    assert "x" in html_extract.main_text("<p>" * 30_000 + "x y, z.") and html_extract.main_text("<b" * 50_000) == ""
    wrapped = '<body class="page-with-sidebar"><div class="layout-sidebar"><form id="f"><article><h1>T</h1><p>Some long text here, with words. And more of it.</p><ul><li><a>Reference one</a><li><a>Reference two</a></ul><div class="comments"><p>I think, this is good.</p></div><aside>Side, note.</aside></article></form></div><footer>Foot, note. Now.</footer></body>'
    assert html_extract.main_text(wrapped) == "T\nSome long text here, with words. And more of it.\nReference one\nReference two"
    assert html_extract.main_text("<article><p>See <math><mi>x</mi></math> here, please.</p></article>") == "See x here, please."


def test_html_whole_table(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(html_extract.op9_tag_path_extraction(spark, SF).select("page_id", "text", "n_chars"), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub("<[^>]*>?", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


def test_pages_keep_sections_named_like_furniture():
    """Inside an article a name that says more than comment or advert is no mark; comments and adverts go."""
    p = lambda k: f"<p>Paragraph {k} has enough words, and some commas, to be read as text of the article itself.</p>"
    page = f"""<html><head><title>On work</title></head><body><nav><a href=a>Home</a></nav><article><h1>On work</h1>{p(1)}{p(2)}
<div class="related-work">{p(3)}{p(4)}{p(5)}</div><section id="reply-from-author">{p(6)}</section>
<div class="comments">{p(7)}</div><div id="comment-list"><div class="comment-body">{p(8)}</div></div><div class="related-posts">{p(9)}</div><div class="ad-slot">{p(10)}</div></article></body></html>"""
    got = [k for k in range(1, 11) if f"Paragraph {k} " in html_extract.main_text(page)]
    assert got == [1, 2, 3, 4, 5, 6]


# ---- op10


def brute_lines(rows):
    first, sets, up, lines = {}, {}, {}, []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            k = line_dedup.normalised(line)
            if k:
                lines.append((i, n, k))
                first.setdefault(k, (i, n))
                first[k] = min(first[k], (i, n))
                sets[k] = frozenset(k[j : j + 9] for j in range(max(1, len(k) - 8)))
                up[k] = k

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    by = defaultdict(list)
    for k in keys:
        near = {j for s in sets[k] for j in by[s]}
        for j in near:
            both = len(sets[k] & sets[j])
            if 100 * both >= 80 * (len(sets[k]) + len(sets[j]) - both):
                a, b = sorted((root(k), root(j)), key=lambda x: first[x])
                up[b] = a
        for s in sets[k]:
            by[s].append(k)
    gone = defaultdict(list)
    for i, n, k in lines:
        if first[root(k)] != (i, n):
            gone[i].append(n)
    return gone


def test_line_dedup_against_brute_force(spark, docs):
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    for k in range(60):  # near copies of one long and one short line
        at = rnd.randrange(380)
        rows.append((10_000 + k, base[:at] + "#" * rnd.randrange(4) + base[at:] + "\nshort line with a number " + str(k % 7)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(df).collect()}
    n = sum(map(len, want.values()))
    missed = sum(len(set(want[i]) ^ set(got.get(i, []))) for i in want)
    assert missed <= 0.02 * n and set(got) <= set(want)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_documents(df).collect()}
    owner = {(r["doc_id"], r["line_no"]): r["owner"] for r in line_dedup.line_owners(df).collect()}
    owners = {o for (i, _), o in owner.items() if o != i}
    for i, text in rows:
        lines = text.split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if k not in set(got.get(i, [])))
        if i in kept:
            assert kept[i] == left
        else:  # nothing was left, or it is a near copy of one document that stays
            held = defaultdict(int)
            for k, x in enumerate(lines):
                held[owner.get((i, k))] += len(line_dedup.normalised(x))
            best = max((o for o in held if o not in (None, i)), key=held.get)
            assert not left.strip() or 10 * held[best] >= 8 * sum(held.values()) and best in kept and i not in owners


def test_line_dedup_finds_edited_lines(spark, docs, tmp_path):
    """Recall of the query by the edit that was made, not by the module's own spans."""
    rnd = random.Random(9)
    words = sorted({w for t in docs["text"][:60] for w in t.split() if w.isalpha()})
    rows = []
    for k in range(300):
        line = f"{k:04d} " + " ".join(rnd.choice(words) for _ in range(40))[:70]
        at = rnd.randrange(5, 75)
        rows += [(2 * k, line), (2 * k + 1, line[:at] + "#" + line[at + 1 :])]
    tail = "".join(f"{i:03d}" for i in range(40))  # equal sets, of very different lengths
    rows += [(1000, "ab" * 10 + tail), (1001, "ab" * 200 + tail)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.op10_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    found = sum(got[2 * k + 1] == [0] for k in range(300))
    assert found >= 0.97 * 300 and not any(got[i] for i in got if i % 2 == 0) and got[1001] == [0]


def test_line_dedup_edges(spark, weird):
    out = line_dedup.dedup_documents(weird).collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r["text"])
    assert got[1] == [""] and got[2] == [None] and got[3] == [" \n\t "] and len(got[4]) == 2 and 5 not in got and len(got[None]) == 1 and got[7] == ["日本語 ½ 🎉\nline"] and got[8] == ["a b"] and 9 not in got
    assert line_dedup.dedup_documents(weird).columns == weird.columns and line_dedup.removed_lines(weird.limit(0)).count() == 0


def test_line_dedup_keeps_text_that_is_nowhere_else(spark):
    """Boilerplate from several documents doesn't take a document with it; a near copy of one does go."""
    line = lambda k: f"boilerplate number {k} " + "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(60))
    rows = [(k, f"{line(k)}\nfirst story {k} of its own, told at length and with care") for k in range(8)]
    rows += [(50, "\n".join(map(line, range(8))) + "\nonly here stands this one sentence")]
    long = "\n".join(f"paragraph {k} of the long text {k * k} goes on and on about thing {k ** 3}" for k in range(12))
    rows += [(60, long), (61, long + "\nadded by the copyist"), (62, long.replace("paragraph 3", "changed 3 entirely to something that differs much")), (63, long)]
    rows += [(70, "x y z shared by one id\nstays in the first row of it"), (70, "quite another row of this id\nfirst story 3 of its own, told at length and with care")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("own_id", "removed", "owns_none", "lost", "__removed", "__lost", "__doc_id", "LOST"):
        df = df.withColumn(name, F.lit(name)) if name.lower() not in map(str.lower, df.columns) else df
    out = line_dedup.dedup_documents(df)
    assert out.columns == df.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
        assert r["lost"] == "lost" and r["removed"] == "removed"
    assert got[50] == ["only here stands this one sentence"] and len(got) == 8 + 1 + 1 + 1 and got[60] == [long]
    assert sorted(got[70]) == ["quite another row of this id", "x y z shared by one id\nstays in the first row of it"]


def test_language_stage_with_clashing_names(spark, docs):
    df = spark.createDataFrame(docs[["doc_id", "text", "lang"]]).withColumn("__lang_pred", F.lit("a")).withColumn("__score", F.lit(0)).withColumn("lang_pred", F.lit("b")).withColumn("score", F.lit(1))
    out = langid.keep_identified(df)
    assert out.columns == df.columns and out.where("lang_pred = 'b' AND score = 1").count() == out.count() > 0


# ---- registry and pipeline


def test_registered_queries():
    assert [k.split("_")[0] for k in llm.queries()] == [f"op{i}" for i in range(1, 14)] and set(llm.oracle_sql()) <= set(llm.queries())


def test_pipeline(spark, weird):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = save(stage(spark, docs, SF))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in docs.collect()}
    odd = weird.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "id", "key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() <= odd.count()
        odd = save(out)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
    again = ngram_join.join_documents(docs, 5, 80).where("component_id <> doc_id").count()
    assert again == 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
