"""Toxicity scores: Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learnt from labelled rows: whole words, and word stems (a stem
stands for every word that begins with it), whose share among toxic texts is far
above their share among the others, and above what chance brings: among the terms
that occur equally often, fewer than ``CHANCE`` may be expected to be so one-sided.
Scoring runs the bit-parallel Levenshtein automaton of each distinct word along the
trie of the lexicon, which finds misspelled terms too (words that clean texts use
are no misspellings). Each hit looks at a window around it: inside quotation marks,
or behind a reporting verb, it counts as quotation, else as abuse. A logistic model
over the amount of abuse gives the score; a misspelled hit counts like an exact one, but
for a fixed discount, a quoted one counts less or not at all, and no weight is negative.

Only the text is an input of a score. The model is fitted on a bounded sample of
labelled rows (``SAMPLE_PER_CLASS`` rows of either class, chosen by a hash of
doc_id); every row is scored, over its whole text, without a shuffle.

Defined results: NULL and empty texts have no hits and get the model's base
score; without labelled rows, or with one class only, every score is that class's
smoothed share (0.0 without any); a doc_id labelled twice counts as toxic if any
label says so; NULL labels and labels without a text are ignored; repeated rows are scored
each; other columns of the documents pass through (one named like an output is
replaced by it); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airseries.llm import near_dup
from airseries.llm.bpe import _pieces
from airseries.llm.common import hold, let_go, prepare, text_of, written

#: Labelled rows of either class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 6_000
#: A term has to occur in so many toxic texts that are not copies of each other.
LEAST = 4
#: Share of a term's (class-balanced) occurrences that fall on toxic texts, at least.
PRECISION = 0.95
STEM_LENGTHS = (4, 5, 6)
#: A stem needs so many different words that carry it.
STEM_KINDS = 5
#: Terms shorter than this are matched exactly only.
FUZZY_FROM = 5
#: Characters before a hit that are searched for an open quotation.
QUOTE_WINDOW = 400
#: Words before a hit in which a reporting verb marks a quotation.
VERB_WINDOW = 6
#: Terms of equal frequency that chance may bring into the lexicon, at most (expected number).
CHANCE = 0.05
#: A hit counts so much for each of its edits.
EDITED = 0.9
#: Texts are scored and handed on in pieces of about so many bytes.
PIECE_BYTES = 1_000_000
#: Words a worker remembers as resolved.
REMEMBER = 150_000

# fixed values: quotation marks and reporting verbs
OPENING, CLOSING, BOTH = "“«„‹", "”»‟›", "\""
REPORTING = frozenset("said says wrote writes called calls quoted quotes quoting replied reported sagte schrieb nannte "
                      "zitierte dit écrit appelé cite cita dijo escribió llamó citó".split())

WORD = re.compile(r"[^\W_]+")


class Trie:
    """Lexicon words; a node is [children, term or None, is it a stem]."""

    def __init__(self, words: list[str], stems: list[str]):
        self.root: list = [{}, None, False]
        for term, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = self.root
            for ch in term:
                node = node[0].setdefault(ch, [{}, None, False])
            node[1], node[2] = term, stem
        # one edit leaves the first or the last half of a term intact
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for w in words:
            if len(w) >= FUZZY_FROM:
                h = len(w) // 2
                self.heads.setdefault(h, set()).add(w[:h])
                self.tails.setdefault(len(w) - h, set()).add(w[h:])

    def exact(self, word: str) -> tuple[str, int] | None:
        """(term, 0) if the word is a term or begins with a stem."""
        node = self.root
        for ch in word:
            node = node[0].get(ch)
            if node is None:
                return None
            if node[2]:
                return node[1], 0
        return (node[1], 0) if node[1] else None

    def _may(self, word: str) -> bool:
        for n, s in self.heads.items():
            if word[:n] in s:
                return True
        for n, s in self.tails.items():
            if word[-n:] in s:
                return True
        return False

    def near(self, word: str, edits: int = 1) -> tuple[str, int] | None:
        """(term, edits) of the nearest whole-word term within ``edits``; ties by spelling.

        The automaton of ``word``: bit j of ``states[e]`` says that its first j letters have been
        read with e edits. All positions step at once; a branch of the trie is left when no
        bit is set."""
        if edits == 1 and not self._may(word):
            return None
        at: dict[str, int] = {}
        for j, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << j
        start = [1]
        for _ in range(edits):
            start.append(start[-1] | start[-1] << 1)
        end, within = 1 << len(word), (2 << len(word)) - 1
        best: tuple[int, str] | None = None
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            if node[1] and not node[2] and len(node[1]) >= FUZZY_FROM:
                for e, bits in enumerate(states):
                    if bits & end:
                        best = min(best, (e, node[1])) if best else (e, node[1])
                        break
            for ch, child in node[0].items():
                same = at.get(ch, 0)
                new = [(states[0] & same) << 1]
                for e in range(1, edits + 1):  # read, or one more edit: insert, replace, delete
                    new.append(((states[e] & same) << 1 | states[e - 1] | states[e - 1] << 1 | new[e - 1] << 1) & within)
                if any(new):
                    stack.append((child, new))
        return (best[1], best[0]) if best else None


@dataclass
class Model:
    """Lexicon and weights; its terms come from the bounded sample."""
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    base: float = 0.0
    edits: int = 1
    harmless: list[str] = field(default_factory=list)  # words of clean texts close to a term


class Matcher:
    """Finds the hits of a text; remembers words (bounded)."""

    def __init__(self, model: Model):
        self.trie, self.edits = Trie(model.words, model.stems), model.edits
        self.harmless = frozenset(model.harmless)
        self.hits: dict[str, tuple[str, int]] = {}
        self.clean: set[str] = set()

    def word(self, w: str) -> tuple[str, int] | None:
        return self.trie.exact(w) or (self.trie.near(w, self.edits) if self.edits and w not in self.harmless else None)

    def scan(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, term, edits, quotation 0..1) of every hit."""
        low = text.lower()
        seen = set(WORD.findall(low))
        if len(self.clean) + len(self.hits) > REMEMBER:
            self.clean.clear()
            self.hits.clear()
        found = False
        for w in seen - self.clean:
            if w in self.hits:
                found = True
            elif hit := self.word(w):
                self.hits[w] = hit
                found = True
            else:
                self.clean.add(w)
        if not found:
            return []
        out, recent = [], []
        for m in WORD.finditer(low):
            if hit := self.hits.get(m[0]):
                out.append((m.start(), m.end(), *hit, quotation(low, m.start(), recent)))
            recent = [*recent[-VERB_WINDOW + 1:], m[0]]
        return out


def quotation(low: str, at: int, before: list[str]) -> float:
    """0 (abuse) to 1 (quotation): half for an open quotation, half for a reporting verb."""
    window = low[max(0, at - QUOTE_WINDOW):at].rpartition("\n")[2]
    opened = window.count(BOTH) % 2 == 1 or sum(map(window.count, OPENING)) > sum(map(window.count, CLOSING))
    return 0.5 * opened + 0.5 * any(w in REPORTING for w in before)


def features(hits: list[tuple[int, int, str, int, float]]) -> list[float]:
    """Abuse: any at all, and how much. A quotation takes from a hit, and so does each edit."""
    n = sum((1 - q) * EDITED ** e for *_, e, q in hits)
    return [1.0, min(1.0, n), math.log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge (none on the intercept); no other weight below 0."""
    used = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[used] = _newton(x[:, used], y, ridge, rounds)
        worst = min(used[1:], key=lambda i: w[i], default=0)
        if not worst or w[worst] >= 0:
            return w
        used.remove(worst)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Lexicon and weights from the rows of ``labels`` that have a text in ``docs``."""
    prepare(docs.sparkSession)
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y")))
    order = [F.xxhash64("_id"), "_id"]
    sample = written(known.where("_y = 1").orderBy(*order).limit(SAMPLE_PER_CLASS).unionByName(
        known.where("_y = 0").orderBy(*order).limit(SAMPLE_PER_CLASS)), "toxicity-sample")
    # at most 2 * SAMPLE_PER_CLASS rows of a number and a label
    rows = written(docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_text"))
                   .join(F.broadcast(sample), "_id").groupBy("_id")
                   .agg(F.first("_text").alias("_text"), F.max("_y").alias("_y")), "toxicity-train")
    size = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    if not size.get(0) or not size.get(1):
        n = sum(size.values())
        return Model(base=size.get(1, 0) / (n + 1) if n else 0.0)
    model = Model(*_lexicon(rows, size))
    model.harmless = _harmless(rows, model)
    feats = _scan(rows, "_text", model, ["_y"]).select("_y", "features").toPandas()
    x, y = np.array(feats["features"].tolist(), float), feats["_y"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    model.weights = fit_logistic(x[order], y[order]).tolist()
    return model


def _lexicon(rows: DataFrame, size: dict[int, int]) -> tuple[list[str], list[str]]:
    """Whole words and stems that tell toxic texts from others."""
    toxic, clean = rows.where("_y = 1"), rows.where("_y = 0")
    # copies, near ones too, count as one text: their class stands for them (its ids are not negative)
    key = F.xxhash64("_id").bitwiseAND(F.lit((1 << 62) - 1))
    classes = near_dup.near_duplicates(toxic.select(key.alias("doc_id"), F.col("_text").alias("text")))
    classes = written(classes.select(F.col("doc_id").alias("_key"), F.col("class_id").alias("_class")).distinct(), "toxicity-classes")
    n1, n0 = float(classes.agg(F.countDistinct("_class")).first()[0]), float(size[0])
    toxic = toxic.withColumn("_key", key).join(classes, "_key")
    pos = _terms(toxic, "_class").distinct().groupBy("term", "stem").agg(F.count("*").alias("pos"))
    neg = _terms(clean).groupBy("term", "stem").agg(F.count("*").alias("neg"))
    terms = written(pos.join(neg, ["term", "stem"], "full").fillna(0, ["pos", "neg"])
                    .withColumn("k", F.col("pos") + F.col("neg")), "toxicity-terms")
    # k occurrences, a share p of them on toxic texts: by chance in exp(-k KL(p, q)) of all terms
    # with k occurrences at most (Chernoff), q the share of toxic texts
    q = n1 / (n1 + n0)
    p = F.col("pos") / F.col("k")
    apart = F.col("k") * (p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0))
    share1, share0 = F.col("pos") / n1, (F.col("neg") + 0.5) / n0
    able = terms.where((F.col("pos") >= LEAST) & (p > q) & (share1 / (share1 + share0) >= PRECISION))
    many = terms.groupBy("stem", "k").agg(F.count("*").alias("m"))
    telling = written(able.join(many, ["stem", "k"]).where(F.log("m") - apart <= math.log(CHANCE))
                      .select("term", "stem", "pos"), "toxicity-telling")
    # the different words that carry a stem
    stems = [F.struct(F.substring("w", 1, n).alias("term"), F.lit(n).alias("stem")) for n in STEM_LENGTHS]
    kinds = (toxic.select(F.explode(_words()).alias("w")).distinct()
             .select("w", F.explode(F.array(*stems)).alias("t")).where("length(w) > t.stem").select("w", "t.term", "t.stem")
             .groupBy("term", "stem").agg(F.count("*").alias("kinds")))
    found = telling.join(kinds, ["term", "stem"], "left").collect()
    words = {r["term"]: r["pos"] for r in found if not r["stem"]}
    able = {r["term"]: r["pos"] for r in found if r["stem"] and (r["kinds"] or 0) >= STEM_KINDS
            and r["pos"] >= 2 * max([0, *(c for w, c in words.items() if w.startswith(r["term"]))])}
    # the longest stem that still carries nearly all of the shorter one's texts
    kept = [t for t, c in able.items() if not any(u != t and u.startswith(t) and d >= 0.9 * c for u, d in able.items())]
    shortest = [t for t in kept if not any(t != u and t.startswith(u) for u in kept)]
    return sorted(words), sorted(shortest)


def _harmless(rows: DataFrame, model: Model) -> list[str]:
    """Words of the clean rows of the sample that are close to a term of the lexicon."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in batches:
            hits = [w for w in b.column(0).to_pylist() if (hit := matcher.word(w)) and hit[1]]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], names=["w"])

    words = rows.where("_y = 0").select(F.explode(_words()).alias("w")).distinct()
    return sorted(r[0] for r in words.mapInArrow(run, "w string").collect())  # within an edit of a term: few


def _words() -> Column:
    words = F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}\p{N}]+"))
    return F.filter(words, lambda w: w != "")


def _terms(rows: DataFrame, *keep: str) -> DataFrame:
    """(term, stem) once per text, with its ``keep``: its words (stem 0) and their first letters (stem = how many)."""
    w = rows.select(*keep, _words().alias("_w"))
    kinds = [F.struct(F.lit(0).alias("stem"), F.col("_w").alias("of"))]
    for n in STEM_LENGTHS:
        cut = F.expr(f"array_distinct(transform(filter(_w, x -> length(x) > {n}), x -> substring(x, 1, {n})))")
        kinds.append(F.struct(F.lit(n).alias("stem"), cut.alias("of")))
    return (w.select(*keep, F.explode(F.array(*kinds)).alias("k"))
            .select(*keep, "k.stem", F.explode("k.of").alias("term")))


_MATCHERS: dict[int, Matcher] = {}


def _scan(docs: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with features, score and hits of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = shared._jbroadcast.id()
    # a text that is kept is sent once
    own = [] if text in keep and isinstance(docs.schema[text].dataType, T.StringType) else [text_of(f"`{text}`").alias("_text")]
    at, n_kept = len(keep) if own else keep.index(text), len(keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], *T._parse_datatype_string(
        "features array<double>, score double, "
        "hits array<struct<start:int,end:int,term:string,edits:int,quotation:double>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hold("toxicity", _MATCHERS.clear)
        if key not in _MATCHERS:  # a worker keeps one
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(m)
        scan, weights = _MATCHERS[key].scan, m.weights
        kinds = (("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quotation", pa.float64()))
        for b in batches:
            texts = pa.compute.fill_null(b.column(at), "")
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_BYTES):  # a batch may hold thousands of long texts with many hits
                feats, scores, ends, flat = [], [], [0], []
                for t in texts.slice(lo, hi - lo):
                    hits = scan(t.as_py())
                    f = features(hits)
                    z = sum(map(float.__mul__, weights, f)) if weights else 0.0
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if weights else m.base)
                    feats.append(f)
                    flat += hits
                    ends.append(len(flat))
                columns = zip(*flat, strict=True) if flat else [()] * len(kinds)
                spans = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)],
                                                   names=[n for n, _ in kinds])
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in b.columns[:n_kept]], pa.array(feats, pa.list_(pa.float64())),
                     pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)],
                    names=[*keep, "features", "score", "hits"])
        let_go()

    return docs.select(*[F.col(f"`{c}`") for c in keep], *own).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with score and hits (spans in the lower-cased text)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("features", "score", "hits")]
    return _scan(docs, text, model, keep).drop("features")
