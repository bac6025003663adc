"""SentencePiece, spelling variants and tokenizer alignment against brute force, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airseries.llm import align, common, piece, queries, spelling
from tests.conftest import SF

MODEL, JSON = P.path(queries.PIECES), P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, score int, ids string, u string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(1, "The cat's  2,000 hats,\n\n  hé! ▁x <s> <0x0A>", 1, "x", "y"), (2, None, None, None, None), (3, "", 0, "", ""),
            (4, "word " * 30_000, 1, "a", "b"), (4, "word " * 30_000, 1, "a", "b"), (None, "some words of a text", 2, None, "c"),
            (5, "\U0001f600  \t end \n", 3, "x", "y"), (6, "ab" * 20_000 + " " * 5_000 + "\x1c !\x1c ,", 1, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return piece.Codec(f.read())


# --- 11: SentencePiece

@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\n.,'aeinrst")), max_size=60))
def test_pieces_match_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258), st.just(29871)), max_size=12))
def test_any_ids_decode_like_library(codec, library, ids):
    assert codec.decode(ids) == library.decode(ids)


def test_long_segments_and_both_agendas(codec, library):
    rng = random.Random(5)
    for alphabet in ("aeinrst", "ab", "▁", "漢é"):
        text = "".join(rng.choice(alphabet) for _ in range(4000))
        assert codec.encode(text) == library.encode(text)
        assert codec._few(text) == codec._many(text)


def test_piece_tables(spark, odd, library):
    out = piece.decode(piece.encode(odd, MODEL, begin=True, end=True), MODEL)
    assert out.columns == ["doc_id", "score", "u", "ids", "decoded"]  # a clashing column is replaced
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in out.collect())
    texts = [(r.doc_id or 0, r.text or "") for r in odd.collect()]
    assert got == sorted((i, [1, *library.encode(t), 2], t.replace("▁", " ")) for i, t in texts)
    assert piece.encode(odd.where("false"), MODEL).count() == 0
    assert piece.disagreements(odd, MODEL).count() == 0


def test_op11_against_library(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op11_sentencepiece"](spark, SF["0.001"]).collect()}
    for r in spark.read.parquet(SF["0.001"] + "/documents.parquet").collect():
        ids = library.encode(r.text, add_eos=True)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused():
    with open(MODEL, "rb") as f:
        raw = f.read()
    with pytest.raises(ValueError, match="merge-type"):
        piece.Model(raw + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="own or unused"):
        piece.Model(raw + b"\x0a\x06\x0a\x02zq\x18\x04")


# --- 12: spelling variants

def near(a, b):
    """Whether one code point inserted, deleted or replaced makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b))) if len(b) == len(a) + 1 else False


def brute_variants(counts):
    out = {}
    for w in counts:
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= 10 * counts[w] else None, len(others))
    rows = []
    for w, (form, n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, counts[w], n, counts[form] if form else None))
    return sorted(rows)


def test_variants_against_all_pairs(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))): rng.choice([2, 3, 25, 300, 4000]) for _ in range(400)}
    for size in (39, 40, 41, 42, 300):  # both sides of the compressed edge, with edits all over the word
        base = "".join(rng.choice("ab") for _ in range(size))
        words[base] = 50
        for i in (0, 1, size // 2 - 1, size // 2, size // 2 + 1, size - 1):
            words[base[:i] + "c" + base[i + 1:]] = 2
            words[base[:i] + "c" + base[i:]] = 3
            words[base[:i] + base[i + 1:]] = 4
        words[base + "a"] = 900
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.variants(counted).collect()))
    assert got == brute_variants(words)


def test_words_of_documents(spark):
    rows = [(1, "Straßenbahn Elephant elephant ELEPHANT short ab\ncaféteria-Caféteria", "w", 1), (None, "elephant Übergabe übergabe", "w", 2),
            (2, None, None, None), (3, "", "", 0), (1, "Straßenbahn", "w", 1), (4, "a" * 70_000 + " " + "a" * 70_000, "x", 3)]
    rows += [(i, "lanterns lanterns", "x", 3) for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    want = collections.Counter()
    import re
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 7:
                want[low] += 1
    got = {r.word: r.n for r in spelling.words(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert any(len(w) == 7 for w in got)  # some run lost a letter
    assert spelling.variants(spelling.words(docs.where("false"))).count() == 0


# --- 13: alignment

def brute_alignment(texts):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    entries = align.byte_entries(JSON)
    docs, links = [], collections.Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text or "")
        of_a = [entries[i] for i in a]
        of_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            docs.append(([], [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        groups, la, lb = [], 0, 0
        for end in sorted(set(end_a) & set(end_b)):
            na, nb = end_a.index(end, la) + 1, end_b.index(end, lb) + 1
            groups.append((a[la:na], b[lb:nb]))
            la, lb = na, nb
            links[(a[na - 1], b[nb - 1])] += 1
        docs.append((a, b, groups))
    top = collections.Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    rows = []
    for a, b, groups in docs:
        own = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), text))
    of_docs = collections.Counter(p for _, _, groups in docs for p in {(x[-1], y[-1]) for x, y in groups})
    return rows, {p: (of_docs[p], n) for p, n in links.items()}


def test_alignment_against_brute_force(spark, odd):
    out, pairs = align.align(odd, JSON, P.PATTERN, MODEL, counts=True)
    assert out.columns == ["doc_id", "score", "ids", "u", *align.OUTPUTS]
    rows = odd.collect()
    want, counts = brute_alignment([r.text for r in rows])
    got = sorted(((r.doc_id or 0, r.u or ""), *r[4:]) for r in out.collect())
    assert got == sorted(((r.doc_id or 0, r.u or ""), *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in pairs.collect()} == counts
    assert align.align(odd.where("false"), JSON, P.PATTERN, MODEL).count() == 0


def test_op13_against_brute_force(spark):
    docs = spark.read.parquet(SF["0.001"] + "/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute_alignment([r.text for r in docs])
    want = {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, want, strict=True)}
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_token_alignment"](spark, SF["0.001"]).collect()}
    assert got == want


def test_bitmaps(spark):
    """Sparse and plain bitmaps, their popcounts, OR and planes."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, align.SLOTS, n)) for n in (1, 50, 4095, 4096, 30_000)] + [np.arange(align.SLOTS)]
    keys = [(np.int64(i) << 16) + s for i, s in enumerate(sets)]
    pairs, bitmaps = align.pack(align.bitmap_or([np.concatenate(keys), keys[3], keys[1][:10]]))
    assert pairs.tolist() == list(range(len(sets)))
    rows, slots = align.unpack(bitmaps)
    for i, s in enumerate(sets):
        assert np.array_equal(np.sort(slots[rows == i]), s)
    df = spark.createDataFrame([(i, bytes(b.as_py())) for i, b in enumerate(bitmaps)], "i int, m binary")
    got = {r.i: r.n for r in df.select("i", align.popcount(F.col("m")).alias("n")).collect()}
    assert got == {i: len(s) for i, s in enumerate(sets)}
    assert max(len(b.as_py()) for b in bitmaps) == align.DENSE
    table = spark.createDataFrame([(7, p, bytes(bitmaps[1].as_py())) for p in (0, 1, 3)], "_pair long, _plane int, _bitmap binary")
    r = align.pair_counts(table).first()
    n = len(sets[1])
    assert (r.n_docs, r.n_links) == (n, n + n + 4 * n)


def test_scratch_writes_are_shared(spark):
    assert common.written(spark.range(3).toDF("x"), "t").count() == 3


# --- 8: toxicity, after its second form

def test_misspelled_and_quoted(spark):
    """A misspelling scores above a text without hits, a quotation below abuse; copies and chance teach nothing."""
    from airseries.llm import toxicity
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(1500)]
    text = lambda: " ".join(rng.choices(vocab, k=30))
    slurs = ["vlerkig", "dwazerik", "snotoor"]
    rows = [(i, f"{text()} you {slurs[i % 3]} {text()}", 1) for i in range(150)]
    rows += [(1000 + i, f"{text()} you rare{i // 5}word {text()}", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    assert all(any(s.startswith(t) for t in [*model.words, *model.stems]) for s in slurs)
    chance = [t for t in [*model.words, *model.stems] if not any(s.startswith(t) for s in slurs)]
    assert len(chance) <= 1
    say = [f"hello you {w} over there" for w in ("friend", "dwazerik", "dwazerlk")] + ['he said "you dwazerik" again']
    out = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(say)), "doc_id long, text string"), model).collect()}
    assert out[1] > 0.5 and out[0] < 0.5 and out[0] < out[2] <= out[1] and out[3] < out[1]
    assert min(model.weights[1:]) >= 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.integers(1, 2))
def test_bit_parallel_automaton(word, edits):
    from airseries.llm import toxicity
    from tests.llm.test_llm_ops import edit_distance
    words = ["abcab", "bbcaab", "cabcabc"]
    best = min((edit_distance(word, w), w) for w in words)
    assert toxicity.Trie(words, []).near(word, edits) == ((best[1], best[0]) if best[0] <= edits else None)


# --- 10: near duplicates with negative ids

def test_negative_ids_have_classes(spark):
    from airseries.llm import near_dup
    words = [f"w{i}" for i in range(60)]
    near_copy = " ".join(words[:59] + ["other"])
    rows = [(-5, " ".join(words)), (-7, near_copy), (3, "something of its own"), (None, " ".join(words)), (None, "no id here at all")]
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-7, -7), (-5, -7), (0, -7), (0, 0), (3, 3)]
