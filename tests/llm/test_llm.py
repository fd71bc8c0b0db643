"""Each operator against brute force, an exact round trip, a library or held-out accuracy, and its odd rows."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import ann, byte_bpe, decontaminate, language_id, quality, queries, sharding, simhash, token_counts, token_files, url_filters
from palimpsest.llm.common import fresh_path
from palimpsest.llm.elias_fano import EliasFano
from palimpsest.llm.pretokens import Splitter, lower_words, word_pieces, words

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " \n\t", "a", "naïve ﬁancée İstanbul 12³ ½", "don't I'LL ''s !'s a_b\x1cc\x85d\u200be", "<|endoftext|>x <|startoftext|>", "日本語 テキスト", "x" * 3000, "ab" * 700 + " " * 600, "😀\u0301 \u2003y"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Odd texts, a repeated row, a row without an id, and extra columns named like results."""
    rows = [(i, t, "en", "s", 0.5, 7) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0.5, 7), (None, "no id here", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n_tokens int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_query_is_named_for_its_operator():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 11)]


# --- 1: URL filters
URLS = [None, "", "no scheme com/en/", "HTTP://EXAMPLE.COM/en/77", "HTTP://EXAMPLE.COM/en/77", "http://a.b.example.net/de/8?x", "x://net/de/", "x://com", "x://com/en/?q", "x://xcom/en/1", "x://my.spam-farm.org/es", "x://y/a://com/en/", "x://com/en", "a\nb://com/en/\n", "x://example.com/EN/7", "x://org/es/#", "x://example.com/en/7"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(n), n, v) for h, p, v in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")) for n in [h + p] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(f"(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)", host + path) for w in ("spam-farm", "cheap-pills", "casino", "free-download", "adserver", "click-bait"))
    return host, path, None, "block" if bad else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[3])], "page_id long, url string").withColumn("verdict", F.lit("x"))
    key = lambda x: tuple(map(str, x))
    for most in (50_000, 0):  # broadcast rules, and joined ones
        got = [tuple(r) for r in url_filters.judge(pages, url_filters.RULES, url_filters.DEFAULT_RULES, max_broadcast=most).collect()]
        assert sorted(got, key=key) == sorted([(i, *judged(u)) for i, u in [*enumerate(URLS), (None, URLS[3])]], key=key)
    assert url_filters.judge(pages.limit(0), url_filters.RULES, url_filters.DEFAULT_RULES).count() == 0


def test_url_filters_by_sql(spark):
    got = {tuple(r) for r in queries.QUERIES["op1_url_filters"](spark, SF).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
    assert got == set(c.execute(url_filters.ORACLE_SQL).fetchall())


def test_url_filters_count_rows_of_hosts_that_begin_with_a_rule_token(spark):
    # The label com is rarer than en and example, so two rules lie under it.
    urls = ["https://com/en/", *(f"https://a{i}.example/en/" for i in range(5))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (50_000, 0):
        got = sorted(tuple(r) for r in url_filters.judge(pages, url_filters.RULES, url_filters.DEFAULT_RULES, max_broadcast=most).collect())
        assert got == [(i, *judged(u)) for i, u in enumerate(urls)]


def test_url_filters_by_sql_row_by_row(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(i, u) for i, u in enumerate(["https://y/", "https://com/en/", *["https://a.example/en/"] * 5])] + [(1, "https://com/en/")], "page_id long, url string").write.parquet(path)
    got = sorted(map(str, (tuple(r) for r in queries.QUERIES["op1_url_filters"](spark, str(tmp_path)).collect())))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS FROM '{path}/*.parquet'")
    assert got == sorted(map(str, c.execute(url_filters.ORACLE_SQL).fetchall()))


def test_rules_are_filed_under_whole_tokens(spark):
    rules = [url_filters.prefix_rule("example.com", "/en/7", "allow"), url_filters.Rule("^a*b^c", "block")]
    got = url_filters.rule_table(spark, rules).orderBy("number").select(url_filters.rule_tokens(F.col("pattern"))).collect()
    assert [r[0] for r in got] == [["example", "com", "en"], []]


def fits(pattern, text):
    """Plain matching: anchors, separators and wild cards by recursion."""
    body = pattern.removeprefix("||")

    def at(i, k):
        if k == len(body):
            return True
        if body[k] == "*":
            return any(at(j, k + 1) for j in range(i, len(text) + 1))
        if body[k] == "^":
            here = i < len(text) and not (text[i].isascii() and text[i].isalnum())
            return here and at(i + 1, k + 1) or i in (0, len(text)) and at(i, k + 1)
        return i < len(text) and text[i] == body[k] and at(i + 1, k + 1)

    if body == pattern:
        return any(at(i, 0) for i in range(len(text) + 1))
    host = text.partition("/")[0]
    return any(at(i, 0) for i in range(len(host) + 1) if i == 0 or text[i - 1] == ".")


def test_many_rules_by_plain_matching(spark):
    rng = np.random.default_rng(2)
    names = ["ads", "track", "cdn", "shop", "news", "img", "a", "b2", "com", "net"]
    pick = lambda n: [names[i] for i in rng.integers(0, len(names), n)]
    rules = []
    for i in range(1500):
        host, path = ".".join(pick(2)), "/".join(pick(2))
        kinds = (f"||{host}^", f"||{host}/{path}", f"/{path}/*{pick(1)[0]}", f"^{path}^", f"{pick(1)[0]}*{pick(1)[0]}", f"||{host}/é?{i % 7}", f"{pick(1)[0]}.")
        rules.append((i, i % 3, kinds[int(rng.integers(0, len(kinds)))], "allow" if i % 5 == 0 else "block", f"r{i}"))
    urls = [f"http://{'.'.join(pick(int(rng.integers(1, 4))))}/{'/'.join(pick(int(rng.integers(0, 4))))}{'é?' if i % 9 == 0 else ''}" for i in range(60)]
    pages = spark.createDataFrame([(i % 50, u) for i, u in enumerate(urls)] + [(7, None)], "page_id long, url string")
    table = spark.createDataFrame(rules, "number long, class int, pattern string, verdict string, name string")
    want = []
    for i, u in [*((i % 50, u) for i, u in enumerate(urls)), (7, None)]:
        host, path, _, _ = judged(u)
        hit = min(((k, -len(p), n, name, v) for n, k, p, v, name in rules if fits(p, host + path)), default=None)
        want.append((i, host, path, hit and hit[3], hit[4] if hit else "allow"))
    for most in (50_000, 10):
        got = url_filters.judge_by(pages, table, max_broadcast=most)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# --- 2: sharding
def shard_facts(df, shards):
    rows = df.collect()
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return rows


def test_sharding_balances_and_keeps_groups(spark, docs):
    rows = shard_facts(sharding.shard(docs, 8), 8)
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in texts_of(docs))
    text = dict(texts_of(docs))
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    sums = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=8)
    assert sums.max() < 1.1 * sums.mean()
    of = {}
    for r in rows:
        of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_sharding_cuts_hot_groups(spark):
    rows = [(i, "the same text") for i in range(600)] + [(i, f"other {i}" * (i % 7)) for i in range(600, 900)]
    got = shard_facts(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8), 8)
    sums = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got], minlength=8)
    assert len(got) == 900 and sums.max() < 1.02 * sums.mean()


def test_sharding_odd_rows(spark, odd_docs):
    got = shard_facts(sharding.shard(odd_docs, 3), 3)
    assert len(got) == odd_docs.count() and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    assert sharding.shard(odd_docs.limit(0), 3).count() == 0


# --- 3: nearest neighbours
def nearest_by_force(ids, x, k):
    out = {}
    for i in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[i]
        s[i] = -np.inf
        out[int(ids[i])] = s[np.lexsort([ids, -s])[: min(k, len(ids) - 1)]]
    return out


def test_ann_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(10, 16))[rng.integers(0, 10, 3000)] * 2
    x = x.astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, list_size=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want, hits = nearest_by_force(np.arange(3000), x, 20), 0
    for q, scores in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {v for _, v, _ in own}
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in own)
        hits += sum(s >= scores[-1] - 1e-9 for _, _, s in own)
    assert hits / (20 * len(want)) >= 0.9


def test_ann_copies_ties_and_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(60)] + [(60, [2.0, 1.0]), (61, None), (62, [0.0, 0.0]), (63, [None, 1.0]), (64, [float("nan"), 1.0]), (65, [1.0]), (None, same), (60, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, block=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [v for _, v in sorted(got[20])] == [i for i in range(21) if i != 20]
    assert [v for _, v in sorted(got[0])] == list(range(1, 21))
    assert [v for _, v in sorted(got[60])] == list(range(20))
    few = df.where("vec_id IN (0, 1, 60)")
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest(few, F.col("id") % 20 == 0).collect()} == {(0, 1), (0, 60), (60, 0), (60, 1)}
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


# --- 4 and 6: classifiers
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 0), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels, F.lit(True))
    got = quality.score(odd_docs, model, keep=["doc_id"]).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality.fit(odd_docs, labels.limit(0), F.lit(True))
    assert {round(r["score"], 6) for r in quality.score(odd_docs, none, keep=["doc_id"]).collect()} == {0.5}
    assert quality.score(odd_docs.limit(0), none, keep=["doc_id"]).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_language_odd_rows(spark, odd_docs):
    profiles = language_id.fit_profiles(odd_docs, F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd_docs, profiles, keep=["doc_id"]).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (None, "en")} <= got
    nothing = language_id.fit_profiles(odd_docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, nothing, keep=["doc_id"]).collect()} == {"und"}


def test_language_distance_by_hand():
    row, code, count = language_id.ngrams(["Abab 1", None, "b"])
    one = {c: n for r, c, n in zip(row, code, count, strict=True) if r == 0}
    a, b = ord("a"), ord("b")
    assert one[a] == 2 and one[b] == 2 and one[a << 16 | b] == 2 and one[1 << 16 | a] == 1 and one[1 << 32 | a << 16 | b] == 1
    p = language_id.Profiles({"x": [a, b], "y": [b]}, top=10)
    names, score = p.predict(["b", "?"])
    assert names == ["y", "und"] and score[1] == 0


# --- 5: byte-level BPE
@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_as_the_library(spark, docs, odd_docs, tik):
    for df in (docs, odd_docs):
        want = sorted((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts_of(df) for ids in [tik.encode_ordinary(t or "")])
        assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()) == want


def test_byte_bpe_general_interface(spark, odd_docs, tik):
    encoded = byte_bpe.encode(odd_docs, RANKS, P.PATTERN)
    back = byte_bpe.decode(encoded, RANKS)
    assert sorted((r["text"], bytes(r["data"])) for r in back.collect()) == sorted((t or "", (t or "").encode()) for _, t in texts_of(odd_docs))
    assert byte_bpe.encode(odd_docs.limit(0), RANKS, P.PATTERN).count() == 0


BPE = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS))
SPLIT = Splitter(P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcTHE  \n'stré²½٣中😀_0\x1c\x85\u0301%ⅷ"), max_size=80))
def test_byte_bpe_any_text(text):
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
    ids = np.frombuffer(b"".join(BPE.encode_pieces([p.encode() for p in SPLIT(text)])), "<u4")
    assert ids.tolist() == tik.encode_ordinary(text) and BPE.decode(ids)[0].tobytes() == text.encode()


# --- 7 and 9: token files and counts
def test_words_and_pieces_as_the_library():
    tok = Tokenizer.from_file(VOCABULARY)
    memo = word_pieces(VOCABULARY, list, lambda parts: [i for p in parts for i in p], 100).words
    for text in filter(None, ODD):
        held = memo.hold(set(words(text)))
        assert [i for w in words(text) for i in held[w]] == tok.encode(text, add_special_tokens=False).ids


PIECES = word_pieces(VOCABULARY, tuple, lambda parts: sum(parts, ()), 20_000).words
LIBRARY = Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcTHE  \n'stré²½٣中😀_0\x1c\x85\u0301%ⅷ<|>.,-!İ"), st.characters(min_codepoint=33, max_codepoint=0x24F)), max_size=60))
def test_pieces_of_any_text(text):
    for split in (words, lower_words):
        held = PIECES.hold(set(split(text)))
        assert [i for w in split(text) for i in held[w]] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, odd_docs):
    tok = Tokenizer.from_file(VOCABULARY)
    for df, size in ((docs, 5000), (odd_docs, 3)):
        path = fresh_path(spark, "files")
        manifest = token_files.write_token_files(df, VOCABULARY, path, end_id=1, ids_per_file=size)
        got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
        start, want = 0, []
        for d, t in sorted(texts_of(df), key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want and manifest.count() > 1
    assert token_files.write_token_files(odd_docs.limit(0), VOCABULARY, fresh_path(spark, "files"), end_id=1).isEmpty()


def test_token_file_access():
    packed = [np.arange(n, dtype="<u2").tobytes() for n in (3, 1, 0, 5)]
    f = token_files.TokenFile(b"".join(token_files.pack_file(packed, [None, -5, 7, 7], 2)))
    assert len(f) == 4 and f.doc_ids() == [None, -5, 7, 7] and [f.ids(i).tolist() for i in range(4)] == [[0, 1, 2], [0], [], [0, 1, 2, 3, 4]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=700), st.booleans())
def test_elias_fano(values, small):
    values = sorted(v % 1000 if small else v for v in values)
    e = EliasFano.from_bytes(EliasFano.build(np.array(values, np.int64)).to_bytes())
    assert e.values().tolist() == values and [e.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(EliasFano.build(ends).to_bytes()) * 8 / 10_000 < 13


def test_token_counts_as_the_libraries(spark, docs, odd_docs):
    import sentencepiece

    tok = Tokenizer.from_file(VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for path, count in ((VOCABULARY, lambda t: len(tok.encode(t, add_special_tokens=False))), (P.path("piece_bpe_32k.model"), lambda t: len(sp.encode(t)))):
        for df in (docs.limit(40), odd_docs):
            got = sorted((str(r[0]), *r[1:]) for r in token_counts.count_tokens(df, path, limit=100, head=50, held=30).collect())
            assert got == sorted((str(d), len((t or "").encode()), n, n > 100) for d, t in texts_of(df) for n in [count(t or "")])
    assert token_counts.count_tokens(odd_docs.limit(0), VOCABULARY).count() == 0


# --- 8: decontamination
def test_decontamination_finds_passages_and_rewordings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r["item_id"], r["text"].split()) for r in bench.collect() if len(r["text"].split()) >= 20][:6]
    base = [r["text"] for r in docs.collect() if r["doc_id"] in clean][:12]
    rows = []
    for k, (item, w) in enumerate(items):
        reworded = [f"quite{k}" if i % 9 == 4 else x for i, x in enumerate(w)]
        rows += [(1000 + k, f"{base[k]} {' '.join(w)} {base[k + 6]}"), (2000 + k, f"{base[k]} {' '.join(reworded).upper()} {base[k + 6]}"), (3000 + k, base[k])]
    rows += [(4000, None), (4001, ""), (None, " ".join(items[0][1])), (1000, rows[0][1])]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cosine", F.lit(0))
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(made, bench).collect()]
    want = [(o + k, item) for k, (item, _) in enumerate(items) for o in (1000, 2000)] + [(None, items[0][0]), (1000, items[0][0])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(made, bench, block_items=17).collect()])) == sorted(map(str, want))
    assert decontaminate.contaminated(made.limit(0), bench).count() == 0 and decontaminate.contaminated(made, bench.limit(0)).count() == 0


def test_decontamination_fits_on_the_passages_of_all_documents():
    rng = np.random.default_rng(0)
    size = np.array([100, 0, 1, 24, 25, 60, 48])
    terms, weight = rng.integers(-1, 30, size.sum()), rng.random(30).astype(np.float32)
    weight[:5] = 0
    p = decontaminate.Passages(terms, size)
    rows = rng.normal(size=(30, 7)).astype(np.float32)
    a = p.sums(terms, np.eye(30, dtype=np.float32), weight)
    got = decontaminate._applied(*decontaminate._pairs(p, terms, weight, 30), weight, rows)
    assert np.allclose(a.T @ (a @ rows), got, atol=1e-3)


def test_decontamination_space_sees_every_document(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    fit = decontaminate.fit_latent

    def watched(items, rows, *more):
        seen.add(rows.count())
        return fit(items, rows, *more)

    monkeypatch.setattr(decontaminate, "fit_latent", watched)
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"))
    bench = spark.createDataFrame([(1, "eight or more words of a text to find 17")], "item_id long, text string")
    decontaminate.contaminated(docs, bench).collect()
    assert seen.value == 9000


def test_decontamination_finds_rewordings_that_keep_common_words_only(spark):
    common = [f"common{i}" for i in range(20)]
    item = [w if i not in (3, 9, 14) else f"rare{i}" for i, w in enumerate(common)]
    reworded = [w if i not in (3, 9, 14) else f"other{i}" for i, w in enumerate(common)]
    # The common words are in all documents, too far apart or in another order to hold the item.
    rows = [(i, " ".join(reversed(common)) + f" filler{i}") for i in range(400)] + [(1000, " ".join(item)), (1001, "x " * 60 + " ".join(reworded) + " y" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == {1000, 1001}


def test_words_are_cut_together():
    odd = ["", None, " ", "A-b C_d!", "\x00 \x1cx\x00y", "É\u2003Été—nœud", "ΑΣ-Β ΑΣ", "İx", "\U0010ffff z", "…", "naïve " * 7, "a\u00a0b\u0301c", "日本語、x９ ²", "_", "é" * 5 + "\n\n"]
    known = decontaminate.Items([(0, "b cd x y été nœud nœud ας ασβ ix naïve bc x９ ² éééée 日本語x９ z")]).number
    rng = random.Random(3)
    many = [" ".join(rng.choice(["naïve", "b", "Été,", "w—x", "cd.", "déjà"]) for _ in range(rng.randrange(3000))) for _ in range(150)]
    for texts in (odd, many, odd * 3 + many, [], [None]):
        terms, size = decontaminate.Cutter(known)(texts)
        want = [[known.get(w, -1) for w in decontaminate.normal_words(t)] for t in texts]
        assert size.tolist() == list(map(len, want)) and terms.tolist() == [t for w in want for t in w]
    cut, many = decontaminate.Cutter(known), many * 3
    cut(many)

    def seconds(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    # No object and no lookup a word: far less than the words one by one.
    assert seconds(lambda: cut(many)) < 0.5 * seconds(lambda: [list(map(known.get, decontaminate.normal_words(t))) for t in many])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    mask = {}
    for i, t in enumerate(b):
        mask[t] = mask.get(t, 0) | 1 << i
    assert decontaminate.common_subsequence(a, mask, len(b)) == table[-1, -1]


# --- 10: SimHash
def fingerprint_by_force(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(fps):
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_by_force(spark, docs, odd_docs):
    for df in (docs, odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = sorted(texts_of(df))
        fps = [fingerprint_by_force(t) for _, t in rows]
        roots = components_by_force(fps)
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
        assert got == {d: (f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, roots, strict=True)}
    assert len(simhash.near_duplicates(odd_docs).collect()) == odd_docs.count()
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 5])
def test_simhash_large_buckets(spark, bucket):
    rng = np.random.default_rng(3)
    centres = [int(v) for v in rng.integers(0, 2**63, 3)]
    fps = sorted({c ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 4, 6) for _ in range(25)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    edges = simhash.links(df, bucket=bucket)
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3 for r in edges.collect())
    reached = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
    assert [reached.get(i, i) for i in range(len(fps))] == components_by_force(fps)


def test_simhash_wide_links_by_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = dict(sorted(texts_of(docs)))
    ids = list(text)
    fps = [fingerprint_by_force(text[d]) for d in ids]
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) for d in ids for w in [re.findall("[^\x20\x09-\x0d]+", (text[d] or "").lower())]]
    at, more = components_by_force(fps), 0
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 11 and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = at[i], at[j]
                if a != b:
                    more += 1
                    at = [min(a, b) if x == max(a, b) else x for x in at]
    assert more >= 3
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, wide=11).collect()}
    assert got == {d: ids[r] for d, r in zip(ids, at, strict=True)}


def test_simhash_keeps_one(spark, odd_docs):
    rows = [(5, "a b c d"), (2, "A b  c d"), (9, "something else entirely here"), (9, "something else entirely here"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("kept"))
    got = simhash.deduplicated(df)
    assert got.columns == df.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "9", "None"]


def test_simhash_with_an_id_on_two_texts(spark):
    one, other = "a text that three rows share word by word", "quite another text that only one row of all has"
    df = spark.createDataFrame([(2, one), (9, one), (9, other), (9, one)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicated(df).collect())) == [(2, one), (9, other)]
    for wide in (0, 11):
        got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, wide=wide).collect())
        assert got == [(2, 2), (9, 2), (9, 2), (9, 9)]
    assert sorted(map(tuple, simhash.deduplicated(df, wide=11).collect())) == [(2, one), (9, other)]


def test_token_ranges_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(0)
    ids = [None] * 300 + [7] * 300 + list(range(100, 400))
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 50, 6))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    borders, blank = token_files.range_borders(df, "doc_id", 12)
    assert borders == sorted(borders) and borders.count(7) >= 4 and blank == 4
    digest = np.sort(rng.integers(-(2**63), 2**63 - 1, 300))
    for given in ([None] * 300, [7] * 300):
        found = token_files.ranges(token_files.pa.array(given, token_files.pa.int64()), digest, np.array(borders), blank)
        assert (np.diff(found) >= 0).all() and np.bincount(found).max() < 130
    path = fresh_path(spark, "files")
    token_files.write_token_files(df, VOCABULARY, path, end_id=1, ids_per_file=500)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    tok = Tokenizer.from_file(VOCABULARY)
    want = [zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows]
    assert sorted(r[3] for r in got) == sorted(want)


def test_very_long_texts(spark, tik):
    """Some megabytes in many words, and in a single one, beside a short text."""
    many = "the quick brown fox jumps over a lazy dog. " * 50_000
    single = "ab" * 1_000_000
    rows = [(1, many, "en", "s"), (2, single, "en", "s"), (3, "short", "en", "s"), (20, many, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tok = Tokenizer.from_file(VOCABULARY)
    count = {d: len(tok.encode(t, add_special_tokens=False)) for d, t, *_ in rows[:3]}
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, VOCABULARY).collect()}
    assert counted == {**count, 20: count[1]}
    path = fresh_path(spark, "files")
    token_files.write_token_files(df, VOCABULARY, path, end_id=1)
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.read_token_files(spark, path).collect()} == counted
    assert {r["doc_id"]: r["n_tokens"] for r in byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()}[1] == len(tik.encode_ordinary(many))
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 20: 1}
    assert sorted(r["size"] for r in sharding.shard(df, 2).collect()) == [6, 2_000_001, len(many) + 1, len(many) + 1]
    profiles = language_id.fit_profiles(df, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(df, profiles, keep=["doc_id"]).collect()} == {"en"}
    model = quality.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(df, model, keep=["doc_id"]).collect())
    bench = spark.createDataFrame([(1, "a lazy dog. the quick brown fox jumps over a lazy")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(df, bench).collect()} == {1, 20}
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.com/en/"), "text").alias("url"))
    assert {r["rule"] for r in url_filters.judge(pages, url_filters.RULES, url_filters.DEFAULT_RULES).collect()} == {"com/en/"}
