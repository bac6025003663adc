"""Stages of the corpus pipeline, and the queries of operators 4 and 10, against plain Python."""

import base64

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from airseries.llm import near_dup, queries
from tests.conftest import SF

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, ids string"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.VOCAB), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", "x") for i, t in rows], COLUMNS)


def test_near_duplicate_stage(spark):
    """Of each class the least id stays, of rows with one id one; rows without an id stay."""
    words = [f"w{i}" for i in range(50)]
    text, near_copy = " ".join(words), " ".join([*words[:-1], "other"])
    docs = docs_of(spark, [(9, text), (4, near_copy), (4, near_copy), (None, text), (None, text), (20, "own words only"),
                           (20, "own words only"), (30, None), (31, ""), (40, "short")])
    out = C.drop_near_duplicates(spark, docs, SF["0.001"])
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == sorted([(0, text), (0, text), (4, near_copy), (20, "own words only"), (30, ""), (40, "short")])
    assert C.drop_near_duplicates(spark, docs.where("false"), SF["0.001"]).count() == 0


def test_repeats_stage(spark):
    """Later copies of 50 bytes go, earlier ones stay; n_chars follows; other columns are kept."""
    shared = "The quick brown fox jumps over the lazy dog while é watches from afar. "
    docs = docs_of(spark, [(1, "First. " + shared), (2, "Second: " + shared + "End."), (3, None), (4, ""), (5, "nothing shared")])
    out = {r.doc_id: r for r in C.drop_repeats(spark, docs, SF["0.001"]).collect()}
    assert out[1].text == "First. " + shared and out[5].text == "nothing shared" and (out[3].text or "") == "" == out[4].text
    assert out[2].text.startswith("Second:") and "lazy dog" not in out[2].text and out[2].text.endswith("End.")
    assert all((r.n_chars or 0) == len(r.text or "") and r.class_id == "c" and r.ids == "x" for r in out.values())


def test_tokens_stage(spark, reference):
    rows = [(1, "The cat's hats"), (2, None), (3, ""), (3, ""), (None, "no id")]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in C.tokens(spark, docs_of(spark, rows), SF["0.001"]).collect())
    assert got == sorted((i or 0, len(reference.encode_ordinary(t or ""))) for i, t in rows)


def test_toxicity_stage_follows_the_scores(spark):
    docs = spark.read.parquet(SF["0.01"] + "/documents.parquet")
    kept = {r.doc_id for r in C.drop_toxic(spark, docs, SF["0.01"]).select("doc_id").collect()}
    told = {r.doc_id: r.predicted for r in queries.QUERIES["op8_toxicity"](spark, SF["0.01"]).collect()}
    assert kept == {i for i, p in told.items() if not p} and 0 < len(kept) < len(told)


def test_op4_against_recounts(spark, reference):
    """The query's counts and edited texts from the edits applied in Python."""
    docs = spark.read.parquet(SF["0.001"] + "/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: r for r in queries.QUERIES["op4_edit_counts"](spark, SF["0.001"]).collect()}
    import hashlib
    for r in docs.withColumn("edits", F.expr(queries.EDITS_SQL)).collect():
        text = r.text
        for e in r.edits:
            s = min(max(e["start"], 0), len(text))
            text = text[:s] + e["text"] + text[s + min(max(e["length"], 0), len(text) - s):]
        g = got[r.doc_id]
        assert g.n_tokens_before == len(reference.encode_ordinary(r.text)) and g.n_tokens_after == len(reference.encode_ordinary(text))
        assert g.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op10_against_all_pairs(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(SF["0.001"] + "/documents.parquet").select("doc_id", "text").collect()]
    words = {i: near_dup.word_hashes(t) for i, t in rows}
    shingled = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, list(w)) for i, w in words.items())}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    text = dict(rows)
    for x in parent:
        for y in parent:
            if x < y and ((shingled[x] & shingled[y] and near_dup.similar(words[x], words[y])) or
                          (list(words[x]) == list(words[y]) and (len(words[x]) or text[x] == text[y]))):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op10_order_minhash"](spark, SF["0.001"]).collect()}
    assert got == {i: find(i) for i in parent}


def test_near_duplicates_of_a_loose_group_make_few_pairs(spark, monkeypatch):
    """Variants of one text, few of them similar to each other: pairs looked at stay in the order of the texts."""
    import random
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    edits = [(p, f"{base[p]}x{k}") for p in range(4, 146, 6) for k in range(3)]
    rows = []
    for i in range(150):
        words = list(base)
        for p, w in rnd.sample(edits, rnd.choice((2, 5, 6))):
            words[p] = w
        rows.append((i, " ".join(words)))
    looked, linked = [], near_dup._linked
    monkeypatch.setattr(near_dup, "_linked", lambda pairs, words: (looked.append(pairs.count()), linked(pairs, words))[1])
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: near_dup.word_hashes(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x, y in ((x, y) for x in words for y in words if x < y):
        if near_dup.similar(words[x], words[y]):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    assert got == {i: find(i) for i, _ in rows}
    assert 20 < len(set(got.values())) < 150
    assert looked[-1] <= 4 * len(rows), looked


def test_unit_hashes_a_text_in_small_pieces():
    """A unit of suffix_dedup holds one hash a byte and little else, across the borders of the pieces too."""
    import tracemalloc

    import numpy as np

    from airseries.llm import suffix_dedup
    n = 4_000_000
    blob = np.random.default_rng(3).integers(97, 123, n, np.uint8).tobytes()
    tracemalloc.start()
    whole = suffix_dedup.Unit(np.array([7]).tobytes(), np.array([n]).tobytes(), blob)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n, peak / n
    lo = (1 << 18) - 1000
    part = suffix_dedup.Unit(np.array([7]).tobytes(), np.array([2000]).tobytes(), blob[lo:lo + 2000])
    there = {int(a) - lo: (int(c), int(w)) for a, c, w in zip(whole.at, whole.count, whole.own)}
    # the first and the last segment of the part may be cut short
    assert all(there[int(a)] == (int(c), int(w)) for a, c, w in list(zip(part.at, part.count, part.own))[1:-1])


def test_sizes_of_pre_tokens_are_the_numbers_of_their_ids():
    import random

    import public_tokenizers

    from airseries.llm import bpe
    c = bpe.Codec(bpe.Tables(bpe.load_ranks(public_tokenizers.path(queries.VOCAB)), queries.PATTERN))
    rnd = random.Random(2)
    words = ["".join(rnd.choice(" aehtnorsé界\u0000Xß9\n") for _ in range(rnd.choice((1, 2, 3, 9, 14, 31, 33, 60)))) for _ in range(3000)]
    words += ["aaaaaaaaaaaaaaaa", " the", "x" * 200]
    assert c.learn_sizes(words) == {w: len(c.ids_of(w)) for w in words}
    assert not c.known


def test_near_duplicates_hold_sketches_once(spark, monkeypatch):
    """When texts are compared, no table of sketches is left on the disk, and buckets were joined once."""
    import os
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    left, linked = [], near_dup._linked

    def look(pairs, words):
        left.append({n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before})
        return linked(pairs, words)
    monkeypatch.setattr(near_dup, "_linked", look)
    rows = [(i, " ".join(f"w{j}x{i % 7 if j == 40 else 0}" for j in range(60))) for i in range(30)] + [(None, "a b c"), (99, None)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(30)}, None: None, 99: 99}
    assert left and not left[0] & {"near-rows", "near-nodes", "near-marks"}, left
    assert not {n for n in set(os.listdir(folder)) - before if n.startswith("near-") and not n.startswith("near-classes")}


def test_lists_of_ids_are_decoded_at_once():
    """NULL and empty lists give empty bytes, also in a slice; ids that are unknown, negative or NULL are errors."""
    import pyarrow as pa

    from airseries.llm import bpe
    entries = pa.array([b"a", b"bc", b"", b"\xff"], pa.binary())
    lists = pa.array([[1, 0], None, [], [2], [3, 1, 1]], pa.list_(pa.int32()))
    assert bpe.decoded_lists(entries, lists).to_pylist() == [b"bca", b"", b"", b"", b"\xffbcbc"]
    assert bpe.decoded_lists(entries, lists.slice(1, 4)).to_pylist() == [b"", b"", b"", b"\xffbcbc"]
    assert bpe.decoded_lists(entries, lists.slice(1, 2)).to_pylist() == [b"", b""]
    assert bpe.decoded_lists(entries, lists.slice(0, 0)).to_pylist() == []
    for wrong in ([4], [-1], [0, None]):
        with pytest.raises((IndexError, ValueError)):
            bpe.decoded_lists(entries, pa.array([[0], wrong], pa.list_(pa.int32())))


def test_decoding_workers_hold_entries_only(monkeypatch):
    """The codec with its memory of pre-tokens is made where texts are encoded, ids are remembered as bytes."""
    from types import SimpleNamespace

    from airseries.llm import bpe
    monkeypatch.setattr(bpe, "_CODECS", {})
    monkeypatch.setattr(bpe, "_ENTRIES", {})
    shared = SimpleNamespace(id=-1, value=bpe.Tables(bpe.load_ranks(P.path(queries.VOCAB)), P.PATTERN))
    assert bpe._entries(shared)[300].as_py() == shared.value.entries[300]
    assert not bpe._CODECS
    c = bpe.codec(shared)
    text = "Some words, some wwwwordss 界\n"
    assert all(type(raw) is bytes for raw in (c.packed(text), *c.known.values()))
    assert len(c.packed(text)) == 4 * len(c.encode(text))
    assert c.decode(c.encode(text)) == text.encode()


def test_batches_of_long_texts_are_bounded(spark, tmp_path):
    """After a stage was made, workers get a few MB of texts at once, not 10,000 rows of any size; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    path = str(tmp_path / "docs")
    spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 6_000).alias("text")).write.parquet(path)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(len, b.column(1).to_pylist()))], pa.int64())})
    try:
        spark.conf.unset(key)
        C.drop_repeats(spark, docs_of(spark, [(1, "a text")]), SF["0.001"])
        got = [r.n for r in spark.read.parquet(path).mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 300 * 66_000 and max(got) <= (4 << 20) + 66_000
        spark.conf.set(key, str(1 << 20))
        C.prepare(spark)
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key)


def test_toxicity_stage_sends_a_text_once(spark, monkeypatch):
    """Rows keep their NULL texts and all their columns, in their order; the text is no part of the row sent beside it."""
    sent = []
    real = C.toxicity.score
    monkeypatch.setattr(C.toxicity, "score", lambda rows, *a, **k: sent.append(rows) or real(rows, *a, **k))
    monkeypatch.setattr(C.q, "toxicity_model", lambda *a: C.toxicity.Model(base=0.1))
    docs = docs_of(spark, [(1, None), (1, None), (2, ""), (None, "plain words"), (3, "plain words")])
    out = C.drop_toxic(spark, docs, SF["0.001"])
    assert sent[0].schema.simpleString().count("text") == 1
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    only = C.drop_toxic(spark, docs.select("text"), SF["0.001"])
    assert only.columns == ["text"] and only.where("text IS NULL").count() == 2
