"""Benchmark decontamination by template windows (DataFrame operations only).

Texts become templates: tokens are words and numbers; a number is replaced by
``<num>``, a unit behind a number by ``<unit>``, a word with a capital letter by
``<name>``. Every window of five template tokens of a benchmark item is hash-joined
with the documents' windows. Windows that match with one offset between item and
document form an alignment; an alignment with 0.8 or more of the item's windows
is a hit if its slots are consistent: inside it, each value a placeholder of the
item stands for (a name, a number, a unit) corresponds to one value of the
document. So verbatim copies and re-parameterised questions are caught, and
chance matches of placeholders are not.

Only hashes of windows are exploded, and only the distinct hashes of the
benchmark are broadcast, if they number at most ``BROADCAST_ROWS`` (8 bytes each);
beyond that the same join runs over a shuffle. Documents are read again for the
slots of the few aligned ones.

Defined results: NULL texts are empty texts; windows with fewer than two literal
words carry no evidence and are left out on both sides; items without any other
window (or of fewer than five tokens) match nothing; rows with NULL doc_id or
item_id are not judged; rows with one id are judged together; repeated rows
change nothing; other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import text_of, written
from airseries.session import broadcast_if_small

WINDOW, SIMILAR = 5, 0.8
#: Distinct window hashes that may be broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
#: Literal words a window needs to be evidence.
LITERALS = 2

# fixed values: units that follow a number
UNITS = tuple("""mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl dl l gal ms s sec min h hr hrs hz khz mhz ghz w kw mw v kv a
 ma j kj cal kcal pa kpa bar n c f k mph kph b kb mb gb tb bit byte bytes px dpi percent pct usd eur gbp cents cent dollars
 dollar euros euro pounds pound meters meter metres metre kilometers kilometres miles mile inches inch feet foot
 grams gram kilograms kilogram liters litres liter litre seconds second minutes minute hours hour days day weeks week
 months month years year degrees degree""".split())


def tokens(text: Column) -> Column:
    """Words, and numbers with their separators, in text order."""
    return F.regexp_extract_all(text, F.lit(r"(\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}\p{N}]+)"), 1)


def template(raw: str) -> Column:
    """The tokens of array column ``raw`` with typed placeholders."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    number = "{0} >= '0' AND {0} < ':'"
    return F.expr(f"""transform({raw}, (x, i) -> CASE
        WHEN {number.format('x')} THEN '<num>'
        WHEN i > 0 AND x IN ({units}) AND {number.format(f'get({raw}, i - 1)')} THEN '<unit>'
        WHEN x <> lower(x) THEN '<name>' ELSE x END)""")


def window_hashes(shape: str) -> Column:
    """Hash of the window that starts at each token of the template column; NULL without evidence.

    Tokens are read in place, no window is copied."""
    at = [f"get({shape}, i + {j})" if j else "x" for j in range(WINDOW)]
    literals = " + ".join(f"CAST({t} < '<' OR {t} >= '=' AS INT)" for t in at)
    return F.expr(f"""transform(slice({shape}, 1, greatest(size({shape}) - {WINDOW - 1}, 0)), (x, i) ->
        CASE WHEN {literals} >= {LITERALS} THEN xxhash64({', '.join(at)}) END)""")


def _templates(rows: DataFrame, id_: str, text: str, out: str) -> DataFrame:
    raw = rows.where(F.col(id_).isNotNull()).select(F.col(id_).alias(out), tokens(text_of(text)).alias("raw"))
    return raw.select(out, "raw", template("raw").alias("shape"))


def _windows(rows: DataFrame, out: str, place: str) -> DataFrame:
    return (rows.select(out, F.posexplode(window_hashes("shape")).alias(place, "hash")).where("hash IS NOT NULL"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id",
                 text: str = "text", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity (share of the item's windows), verbatim (all slots equal)."""
    items = written(_templates(benchmark, item_id, item_text, "item_id").distinct(), "bench-items")
    of_items = written(_windows(items, "item_id", "i").distinct(), "bench-windows")
    # windows of an item: distinct places, whatever rows repeat it
    total = of_items.groupBy("item_id").agg(F.countDistinct("i").alias("of"))
    hashes = broadcast_if_small(written(of_items.select("hash").distinct(), "bench-hashes"), BROADCAST_ROWS)
    shapes = _templates(docs, doc_id, text, "doc_id").select("doc_id", "shape")
    found = written(_windows(shapes, "doc_id", "p").join(hashes, "hash", "left_semi"), "bench-found")
    aligned = (found.join(of_items, "hash").groupBy("doc_id", "item_id", (F.col("p") - F.col("i")).alias("shift"))
               .agg(F.countDistinct("i").alias("matched"))
               .join(total, "item_id").where(F.col("matched") >= F.col("of") * SIMILAR - 1e-9)
               .select("doc_id", "item_id", "shift", (F.col("matched") / F.col("of")).alias("similarity")))
    aligned = written(aligned, "bench-aligned")
    if aligned.isEmpty():
        return aligned.select("doc_id", "item_id", "similarity", F.lit(True).alias("verbatim"))
    return _consistent(aligned, items, docs, doc_id, text)


def _consistent(aligned: DataFrame, items: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The alignments whose slots correspond one to one value, best per (doc_id, item_id)."""
    ids = written(aligned.select(F.col("doc_id").alias("_id")).distinct(), "bench-ids")
    texts = _templates(docs.join(ids, docs[doc_id] == ids["_id"], "left_semi"), doc_id, text, "doc_id")
    both = (aligned.join(items.withColumnsRenamed({"raw": "item_raw", "shape": "item_shape"}), "item_id")
            .join(texts.withColumnsRenamed({"raw": "doc_raw", "shape": "doc_shape"}), "doc_id"))
    # one entry per placeholder of the item whose counterpart has the same type: bounded by the item's length
    slots = both.withColumn("slots", F.expr("""filter(transform(item_shape, (x, i) -> struct(
        x AS kind, get(item_raw, i) AS ours, get(doc_raw, i + shift) AS theirs, get(doc_shape, i + shift) AS there)),
        s -> s.kind IN ('<num>', '<unit>', '<name>') AND s.there = s.kind)"""))
    distinct = F.expr("size(array_distinct(transform(slots, s -> struct(s.kind, s.ours, s.theirs))))")
    values = F.expr("size(array_distinct(transform(slots, s -> struct(s.kind, s.ours))))")
    same = F.expr("forall(slots, s -> s.ours = s.theirs)")
    return (slots.where(distinct == values).select("doc_id", "item_id", "similarity", same.alias("verbatim"))
            .groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("verbatim").alias("verbatim")))


def literal_hashes(raw: str) -> Column:
    """Hash of the case-folded window that starts at each token; no placeholder, no literal minimum."""
    at = ", ".join(f"get(low, i + {j})" for j in range(WINDOW))
    return F.expr(f"""transform(array(transform({raw}, x -> lower(x))), low -> transform(
        slice(low, 1, greatest(size(low) - {WINDOW - 1}, 0)), (x, i) -> xxhash64({at})))[0]""")


def _runs(rows: DataFrame, id_: str) -> DataFrame:
    """raw, shape (each run of names, and of numbers with their units, is one placeholder) and the
    token that each of its places starts at."""
    typed = rows.withColumn("_typed", F.expr("transform(shape, x -> if(x = '<unit>', '<num>', x))"))
    head = "i = 0 OR x NOT IN ('<num>', '<name>') OR x <> get(_typed, i - 1)"
    return typed.select(id_, "raw", F.expr(f"filter(_typed, (x, i) -> {head})").alias("shape"),
                        F.expr(f"filter(transform(_typed, (x, i) -> if({head}, i, NULL)), i -> i IS NOT NULL)").alias("starts"))


def _evidence(rows: DataFrame, id_: str, text: str, out: str) -> DataFrame:
    """``out``, kind, place and hash of every window: the case-folded tokens, and the template of runs."""
    w = _runs(_templates(rows, id_, text, out), out).select(
        out, literal_hashes("raw").alias("_literal"), window_hashes("shape").alias("_shape"))
    w = w.select(out, F.size("_literal").alias("_n"), F.posexplode(F.concat("_literal", "_shape")).alias("_at", "hash"))
    shape = F.col("_at") >= F.col("_n")
    return (w.where("hash IS NOT NULL")
            .select(out, F.when(shape, "shape").otherwise("literal").alias("kind"),
                    F.when(shape, F.col("_at") - F.col("_n")).otherwise(F.col("_at")).alias("place"), "hash"))


def leaked(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text", item_text: str = "text") -> DataFrame:
    """doc_id, item_id of every pair of ``contaminated``, and of every copy that its windows do not show.

    Case-folded literal windows find copies in capitals, and items made of names and
    numbers. Templates of runs find re-parameterised questions whose values have other
    numbers of tokens. Matched windows are summed over neighbouring offsets, up to an item's
    length apart, so words inserted into a copy or left out of it do not split it."""
    items = written(_evidence(benchmark, item_id, item_text, "item_id").distinct(), "leak-windows")
    of = items.groupBy("item_id", "kind").agg(F.countDistinct("place").alias("of"))
    places = written(items.withColumnRenamed("place", "i").join(of, ["item_id", "kind"]), "leak-places")
    hashes = broadcast_if_small(written(places.select("hash").distinct(), "leak-hashes"), BROADCAST_ROWS)
    found = written(_evidence(docs, doc_id, text, "doc_id").withColumnRenamed("place", "p")
                    .join(hashes, "hash", "left_semi"), "leak-found")
    aligned = written(_bands(found, places).groupBy("doc_id", "item_id", "kind", "band", "of")
                      .agg(F.countDistinct("i").alias("matched"))
                      .where(F.col("matched") >= F.col("of") * SIMILAR - 1e-9), "leak-aligned")
    exact = contaminated(docs, benchmark, doc_id=doc_id, item_id=item_id, text=text, item_text=item_text)
    sure = exact.select("doc_id", "item_id").unionByName(aligned.where("kind = 'literal'").select("doc_id", "item_id"))
    sure = written(sure.distinct(), "leak-sure")
    # slots are read only where no literal copy is known
    unsure = written(aligned.where("kind = 'shape'").join(sure, ["doc_id", "item_id"], "left_anti"), "leak-unsure")
    if unsure.isEmpty():
        return sure
    ids = written(unsure.select("doc_id").distinct(), "leak-ids")
    known = docs.join(ids.select(F.col("doc_id").alias("_id")), docs[doc_id] == F.col("_id"), "left_semi")
    matches = (_bands(found.where("kind = 'shape'").join(ids, "doc_id", "left_semi"), places)
               .join(unsure.select("doc_id", "item_id", "kind", "band"), ["doc_id", "item_id", "kind", "band"], "left_semi"))
    fit = _fitting(matches, _slots(benchmark, item_id, item_text, "item_id", "i", "ours"),
                   _slots(known, doc_id, text, "doc_id", "p", "theirs"))
    return sure.unionByName(fit).distinct()


def _slots(rows: DataFrame, id_: str, text: str, out: str, place: str, value: str) -> DataFrame:
    """``out``, place, type and case-folded value of every placeholder; the values of all texts with one id."""
    r = _runs(_templates(rows, id_, text, out).distinct(), out)
    end = "coalesce(get(starts, i + 1), size(raw)) - starts[i]"
    each = r.select(out, F.posexplode(F.expr(f"""transform(shape, (x, i) -> if(x IN ('<num>', '<name>'),
        struct(x AS type, lower(array_join(slice(raw, starts[i] + 1, {end}), ' ')) AS value), NULL))""")).alias(place, "_s"))
    return each.where("_s IS NOT NULL").select(out, place, F.col("_s.type").alias("type"), F.col("_s.value").alias(value)).distinct()


def _fitting(matches: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """doc_id, item_id of the bands where the share ``SIMILAR`` of the slots inside matched windows
    corresponds one to one value."""
    key = ["doc_id", "item_id", "band"]
    # a place of the item is read at the offset that most windows of the band share
    places = (matches.select(*key, (F.col("p") - F.col("i")).alias("shift"),
                             F.explode(F.sequence("i", F.col("i") + (WINDOW - 1))).alias("i")).distinct())
    weight = matches.groupBy(*key, (F.col("p") - F.col("i")).alias("shift")).agg(F.countDistinct("i").alias("w"))
    best = (places.join(weight, [*key, "shift"]).groupBy(*key, "i")
            .agg(F.max_by("shift", F.struct("w", -F.col("shift"))).alias("shift")))
    slots = (best.withColumn("p", F.col("i") + F.col("shift")).join(ours, ["item_id", "i"])
             .join(theirs, ["doc_id", "p", "type"]))
    votes = slots.groupBy(*key, "type", "ours", "theirs").agg(F.countDistinct("i").alias("n"))
    values = votes.groupBy(*key, "type", "ours").agg(F.max("n").alias("n"), F.sum("n").alias("of"))
    judged = values.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    # bands without a slot have nothing to contradict them
    bad = judged.where(F.col("n") < F.col("of") * SIMILAR - 1e-9).select(*key)
    return matches.select(*key).distinct().join(bad, key, "left_anti").select("doc_id", "item_id")


def _bands(found: DataFrame, places: DataFrame) -> DataFrame:
    """Matched windows by band of offsets; two overlapping bands hold each offset, so that
    offsets up to ``of`` apart share one."""
    at = F.floor((F.col("p") - F.col("i")) / F.greatest("of", F.lit(WINDOW)))
    return found.join(places, ["hash", "kind"]).withColumn("band", F.explode(F.array(at, at - 1)))
