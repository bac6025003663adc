"""The operators against brute force on small inputs, and their edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from airseries.llm import (bpe, decontaminate, graph, html_text, near_dup, queries, sharding, suffix_dedup, token_counts,
                           toxicity, url_filter, vector_topk)
from tests.conftest import SF

VOCAB = P.path(queries.VOCAB)
DOCS = "doc_id long, text string, score int, ids string, u string"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(1, "The cat's  2,000 hats,\n\nhé!", 1, "x", "y"), (2, None, None, None, None), (3, "", 0, "", ""),
            (4, LONG, 1, "a", "b"), (4, LONG, 1, "a", "b"), (None, "some words of a text without any id", 2, None, "c"),
            (5, "\U0001f600  \t end", 3, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own_codec():
    return bpe.Codec(bpe.Tables(bpe.load_ranks(VOCAB), P.PATTERN))


# --- 1: byte-level BPE

@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encode_matches_library(own_codec, reference, text):
    ids = own_codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert own_codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(own_codec):
    h = own_codec.hash
    assert sorted(h.index.tolist()) == list(range(h.n))
    assert all(h.index[h.slot(e)] == i for i, e in enumerate(own_codec.entries[:3000]))


def test_encode_long_pretoken(own_codec, reference):
    text = "ab" * 20_000 + " " * 5_000
    assert own_codec.encode(text) == reference.encode_ordinary(text)


def test_bpe_round_trip_and_edges(spark, odd, empty, reference):
    out = bpe.decode(bpe.encode(odd, VOCAB, P.PATTERN), VOCAB, P.PATTERN)
    assert out.columns == ["doc_id", "score", "u", "ids", "decoded"]  # a clashing column is replaced
    want = sorted(((r.doc_id or 0), (r.text or "")) for r in odd.collect())
    got = sorted(((r.doc_id or 0), bytes(r.decoded).decode()) for r in out.collect())
    assert got == want
    assert bpe.encode(empty, VOCAB, P.PATTERN).count() == 0


def test_op1_against_library(spark, reference):
    got = {r.doc_id: r for r in queries.QUERIES["op1_bpe_round_trip"](spark, SF["0.001"]).collect()}
    for r in spark.read.parquet(SF["0.001"] + "/documents.parquet").collect():
        ids = reference.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


# --- 2: html

PAGE = """<html><head><title>T</title><script>a<b</script></head><body><nav><a>Menu</a></nav><header>Site</header>
<div class="cookie-notice">We use</div><article class="post"><h1>A &amp; B</h1><p>One<br>two &nbsp; <b>three<p>Four
five</p><div class="ad">Buy</div><section id="comments"><p>Nice</p></section><form><input>x</form></article>
<aside>Side</aside><footer>&copy;</footer></body></html>"""


def test_html_page():
    assert html_text.text_of_page(PAGE) == "A & B\n\nOne two three\n\nFour five"
    assert html_text.text_of_page("") == "" and html_text.text_of_page("plain &lt;x&gt;\n text") == "plain <x> text"
    assert html_text.text_of_page("<p>" * 3000 + "deep") == "deep"
    assert html_text.text_of_page("<div><p>a</p><p>b</div>c") == "a\n\nb\n\nc"


def test_site_templates(spark):
    page = "<body><div><div>Welcome to the site</div></div><div><p>text {0}</p><p>shared line</p></div><div>contact us</div></body>"
    rows = [(i, "https://a.org/%d" % i, page.format(i)) for i in range(8)]
    rows += [(100, "https://b.org/1", page.format(100)), (101, None, page.format(101)), (102, "https://a.org/n", None),
             (None, "https://a.org/x", ""), (103, "https://c.org/", page.format(0)), (103, "https://c.org/", page.format(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages.withColumn("host", pages.url)).collect()}
    assert got[3] == "text 3\n\nshared line" or got[3] == "text 3"  # the repeated blocks of a.org are gone
    assert "Welcome" not in got[3] and "contact" not in got[3]
    assert "Welcome to the site" in got[100] and "contact us" in got[101]  # one page is no template
    assert got[102] == "" and got[None] == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_shared_article_paragraph_stays(spark):
    rows = [(i, "http://h.net/%d" % i, f"<nav>n</nav><article><p>own {i}</p><p>same everywhere</p></article>") for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"own {r.page_id}\n\nsame everywhere" for r in got)


# --- 3: suffix dedup

def brute_spans(rows):
    """[(doc_id, n_bytes, removed mask)] by the definition."""
    starts = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            starts[w] = min(starts.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if starts[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        out.append((i, len(b), gone))
    return out


def check_suffix(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in suffix_dedup.repeated_bytes(df).collect()}
    for i, n, gone in brute_spans(rows):
        g = got[i]
        mask = np.zeros(n, bool)
        for s in g.spans:
            mask[s.start:s.end] = True
        assert g.n_bytes == n and (mask == gone).all(), i
        raw = np.frombuffer((dict(rows)[i] or "").encode(), np.uint8)
        assert bytes(g.kept) == raw[~gone].tobytes()
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert len(g.spans) == edges


def test_suffix_dedup_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "de", "é", "zeta", "\0\0", "eta"]
    passage = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choice(words) + str(rnd.randint(0, 400)) for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(passage)[rnd.randint(0, 30):])
        rows.append((i * 7 % 61, "".join(parts)))
    rows += [(100, "a" * 500), (101, "b" + "a" * 300 + "b"), (102, "ab" * 200), (103, "ab" * 30 + "c"), (104, None), (105, ""),
             (106, "x" * 49), (107, "x" * 49), (108, "a" * 50), (109, "é" * 100), (110, "€" + "é" * 60)]
    check_suffix(spark, rows, 9)


def test_suffix_dedup_edges(spark, odd, empty):
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    got = suffix_dedup.repeated_bytes(odd).collect()
    assert len(got) == odd.count()
    assert all(not r.spans for r in got)  # rows with one doc_id are no sources for each other
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns
    key = lambda r: (r.doc_id or 0, r.text or "", r.text is None)
    assert sorted(map(key, out.collect())) == sorted(map(key, odd.collect()))


def test_remove_repeats_keeps_characters(spark):
    rows = [(1, "é" * 40), (2, "à" + "é" * 40 + "ô"), (None, "é" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1] == "é" * 40 and got[2] == "àô" and got[None] == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: b.replace(b"\xff", b"") + b"\xff"), max_size=12), min_size=1, max_size=6))
def test_merge_runs(runs):
    runs = [sorted(set(r)) for r in runs]

    def coded(r):
        prev = b""
        for x in r:
            n = 0
            while n < min(len(prev), len(x)) and prev[n] == x[n]:
                n += 1
            yield n, x
            prev = x
    heads = [iter(r) for r in runs]
    merged, last = [], None
    for run, same in suffix_dedup.merge_runs([coded(r) for r in runs]):
        x = next(heads[run])
        assert same == (x == last)
        merged.append(x)
        last = x
    assert merged == sorted(x for r in runs for x in r)


# --- 4: edit-aware counts

def test_edits_against_full_recount(own_codec):
    rnd, alpha = random.Random(5), "ab 's\n\t're1é!,  X"
    for _ in range(400):
        x = "".join(rnd.choice(alpha) for _ in range(rnd.choice([0, 1, 5, 40, 900])))
        tokens = own_codec.find(x)
        known = own_codec.learn(tokens)
        tree = token_counts.Tree([len(t) for t in tokens], [len(known[t]) for t in tokens])
        for _ in range(4):
            start, length = rnd.randint(-1, len(x) + 2), rnd.randint(-1, 12)
            insert = "".join(rnd.choice(alpha) for _ in range(rnd.choice([0, 0, 1, 3, 300])))
            new, _ = token_counts.edited(own_codec, tree, x, start, length, insert)
            s = min(max(start, 0), len(x))
            assert new == x[:s] + insert + x[s + min(max(length, 0), len(x) - s):]
            x = new
            tokens = own_codec.find(x)
            assert [n for b in tree.lens for n in b] == [len(t) for t in tokens]
            assert tree.total == sum(len(own_codec.learn(tokens)[t]) for t in tokens)


def test_edit_touches_little(own_codec):
    text = "some words here and there " * 2000
    tokens = own_codec.find(text)
    known = own_codec.learn(tokens)
    tree = token_counts.Tree([len(t) for t in tokens], [len(known[t]) for t in tokens])
    _, encoded = token_counts.edited(own_codec, tree, text, 20_000, 3, "new")
    assert encoded < 10


def test_token_counts_tables(spark, odd, empty, reference):
    state = token_counts.build(odd, VOCAB, P.PATTERN)
    edits = spark.createDataFrame([(1, 2, 0, 3, "A"), (1, 1, 4, 0, " zoo"), (3, 1, 0, 0, "new text"), (2, 1, 5, 5, None),
                                   (99, 1, 0, 0, "none")], "doc_id long, seq int, start int, length int, text string")
    out = {(r.doc_id, r.u): r for r in token_counts.apply_edits(state, edits, VOCAB, P.PATTERN).collect()}
    texts = {r.doc_id: r.text for r in odd.collect()}
    one = texts[1][:4] + " zoo" + texts[1][4:]
    one = "A" + one[3:]
    assert out[1, "y"].text == one and out[1, "y"].n_tokens == len(reference.encode_ordinary(one))
    assert out[3, ""].n_tokens == len(reference.encode_ordinary("new text"))
    assert out[2, None].n_tokens == 0 and out[4, "b"].n_tokens == len(reference.encode_ordinary(LONG))
    assert token_counts.build(empty, VOCAB, P.PATTERN).count() == 0


# --- 5: sharding

def test_kd_shards(spark):
    out = queries.QUERIES["op5_kd_shards"](spark, SF["0.01"]).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(SF["0.01"] + "/documents.parquet").collect()}
    by, slots, homes = {}, {}, {}
    for r in out:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        by[r.shard] = by.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(out) == len(texts) and sorted(by) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(len(t.encode()) + 8 for t in texts.values())
    mean = sum(by.values()) / 24
    assert max(by.values()) - mean < biggest and mean - min(by.values()) < biggest
    assert sum(len(s) > 1 for s in homes.values()) <= 24  # copies stay together, but for a cut through a group


def test_kd_shards_edges(spark, odd, empty):
    assert sharding.kd_shards(empty, 24).count() == 0
    out = sharding.kd_shards(odd.withColumn("shard", odd.u), 4).collect()
    assert len(out) == odd.count() and {r.size for r in out if r.doc_id == 2} == {8}
    same = spark.createDataFrame([(i, "same text") for i in range(480)], "doc_id long, text string")
    n = [r["count"] for r in sharding.kd_shards(same, 24).groupBy("shard").count().collect()]
    assert len(n) == 24 and min(n) >= 10 and max(n) <= 30  # one hot group is divided


# --- 6: top-k

def test_top_k_edges(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-40, 40, 24) / 16], 0) for i in range(0, 300)]
    rows += [(20, rows[20][1], 0), (301, None, 0), (302, [1.0, None], 0), (303, [float("nan")] * 24, 0), (304, [float("inf")] * 24, 0),
             (None, [1.0] * 24, 0), (340, [1.0, 2.0], 0), (341, [3.0, 1.0], 0), (360, [], 0), (361, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in vector_topk.top_k(df.repartition(5), 7, divisor=20, lanes=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, (i, q) in enumerate(ok):
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:7]
            want = [(k + 1, j, -x) for k, (x, j) in enumerate(s)]
            assert want == sorted(got[i])[:7] or i == 20
    assert vector_topk.top_k(df.limit(0), 7).count() == 0


def test_top_k_over_many_blocks(spark):
    """Several blocks, query blocks and lanes; many equal vectors; scores beyond what a double holds."""
    rnd = np.random.default_rng(2)
    vectors = [rnd.integers(-40, 40, 20) for _ in range(3000)] + [np.full(20, 9)] * 700
    vectors += [rnd.integers(-2 ** 30, 2 ** 30, 6) for _ in range(80)]
    rows = [(int(i), [x / 64 for x in v.tolist()]) for i, v in zip(rnd.permutation(len(vectors)), vectors, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = sorted(map(tuple, vector_topk.top_k(df, 11, divisor=7, lanes=3).collect()))
    want = []
    for dim in (20, 6):
        some = [(i, [int(64 * x) for x in v]) for i, v in rows if len(v) == dim]
        m = np.array([v for _, v in some], object if dim == 6 else np.int64)
        scores = m @ m.T
        for q, (i, _) in enumerate(some):
            if i % 7 == 0:
                best = sorted((-int(s), j) for (j, _), s in zip(some, scores[q], strict=True) if j != i)[:11]
                want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_k_copies_of_queries_stay_off_the_driver(spark):
    """Files of queries under the threshold of a broadcast are copied to every lane; the copies are no broadcast."""
    rows = [(i, [float(i % 7), 1.0, 2.0]) for i in range(200)]
    out = vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, divisor=5, lanes=2)
    assert len(out.collect()) == 40 * 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Broadcast" not in plan


# --- 7: decontamination

def test_templates_found(spark):
    item = "Anna buys 12 apples for 3 kg of flour and Anna gives 12 of them to her neighbour Paul today"
    copy = "noise before " + item + " noise behind"
    moved = item.replace("Anna", "Maria").replace("12", "7").replace("Paul", "Sven").replace("3 kg", "9 lb")
    mixed = moved.replace("Maria gives", "Eva gives")  # one slot with two values
    docs = spark.createDataFrame(
        [(1, copy), (2, "x " + moved), (3, mixed), (4, "Clean words about nothing " * 5), (5, None), (6, ""), (1, copy), (None, copy),
         (7, "A B C D E F G H I J K L M N O P"), (8, item[:len(item) // 2])], "doc_id long, text string").withColumn("hash", LIT(spark))
    bench = spark.createDataFrame([(0, item), (0, item), (1, None), (2, ""), (3, "too short"), (4, "A B C D E F G H I J K"), (None, item)],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0): True, (2, 0): False}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def LIT(spark):
    from pyspark.sql import functions as F
    return F.lit("clash")


# --- 8: toxicity

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("idots", min_size=1, max_size=8))
def test_automaton_matches_edit_distance(word):
    words = ["idiot", "stoods", "tostid"]
    near = min(((edit_distance(word, w), w) for w in words))
    got = toxicity.Trie(words, []).near(word)
    assert got == ((near[1], near[0]) if near[0] <= 1 else None)


def test_quotation_and_stems():
    m = toxicity.Matcher(toxicity.Model(["idiot"], ["vequ"]))
    direct, quoted = m.scan("You idiot, you!"), m.scan('She said "you idiot" to him')
    assert direct[0][4] == 0 and quoted[0][4] == 1.0
    assert [h[2] for h in m.scan("idoit idi0t Vequera vecu")] == ["idiot", "vequ"]  # idi0t is one edit away, idoit two


def test_toxicity_learns(spark, odd, empty):
    docs = spark.createDataFrame([(i, f"plain words about {i} {'weather' if i % 2 else 'idiot'} number {i * 7}") for i in range(200)]
                                 + [(300, None), (301, ""), (302, "such an idiott")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)] + [(None, 1), (5, None), (900, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.5) == (i % 2 == 0) for i in range(200))
    assert got[300].score == got[301].score < 0.5 and got[302].hits[0].edits == 1
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_held_out_toxicity(spark):
    out = queries.QUERIES["op8_toxicity"](spark, SF["0.1"])
    rows = out.join(spark.read.parquet(SF["0.1"] + "/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.8


# --- 9: urls

def test_url_filter(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [(1, "http://bad.net/a", None), (2, "https://Mirror.org/x#top", link.format("http://bad.net/a")),
            (3, "https://mirror.org/x", ""), (4, "https://third.com/", '<meta http-equiv="refresh" content="0; url=//mirror.org/x">'),
            (5, "https://x.example.net/en/", link.format("https://third.com/")), (6, None, None), (7, "no scheme", "x"),
            (8, "http://EXAMPLE.net/en", None), (9, "ftp://org/fr/", None), (1, "http://bad.net/a", None),
            (10, "https://solo.com/de/?x#y", link.format("/other")), (11, "http://a.com/", link.format("http://b.net/")),
            (12, "http://internet/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", LIT(spark))
    got = [tuple(r)[:5] for r in url_filter.judge_urls(pages, queries.RULES).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows)
    assert by[1] == ("bad.net", "/a", "net/", "block") and by[6] == ("", "", None, "allow") == by[7]
    assert by[8][2:] == ("net/", "block") and by[9] == ("org", "/fr/", "org/fr/", "allow") and by[12][2:] == (None, "allow")
    # 5 is allowed by a rule, so the unruled members of its component are
    assert by[5][2:] == ("example.net/en/", "allow") and by[4][3] == by[3][3] == by[2][3] == "allow"
    assert by[11][2:] == (None, "block")  # alias of a blocked url
    assert url_filter.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1200)] + \
            [(2000, i) for i in range(2001, 2300)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


# --- 10: near duplicates

def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([8, 20, 60, 200, 500]))]
        for _ in range(rnd.randint(1, 5)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "a b"), (1004, "A  b!"), (1005, rows[0][1]), (1005, rows[0][1]),
             (None, rows[1][1]), (None, "nobody else has this")]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("key", LIT(spark))).collect()}
    words = {i: near_dup.word_hashes(t or "") for i, t in rows if i is not None}
    parent = {i: i for i in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(words)
    text = dict(r for r in rows if r[0] is not None)
    for x in ids:
        for y in ids:
            if x < y and (near_dup.similar(words[x], words[y]) if len(words[x]) and len(words[y]) else (text[x] or "") == (text[y] or "")):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    assert {i: got[i] for i in ids} == {i: find(i) for i in ids}
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_is_ordered():
    a = list(range(100))
    assert near_dup.aligned_shingles(a, a, 0) == 96
    assert near_dup.aligned_shingles(a, a[:50] + [999] + a[51:], 2) == 91
    half = np.array(a[50:] + a[:50], np.uint32)
    assert near_dup.shared_at_most(near_dup.shingles(np.array(a, np.uint32)), near_dup.shingles(half)) == 92
    assert not near_dup.similar(np.array(a, np.uint32), half)
