"""The operators over inputs that a narrower rule would lose."""

import random

import corpus_pipeline
from airseries.llm import decontaminate, html_text, toxicity

ITEM = ("Anna buys twelve apples at the market and then she gives some of them to her old neighbour Paul who "
        "lives near the river with his dog and two cats")
NAMES = "Anna Berta Clara 12 Dora Emil 7 Fritz Gustav 30 Hans Ida"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def bench_of(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def pairs(rows):
    return {(r.doc_id, r.item_id) for r in rows.collect()}


# --- decontamination

def test_capitals_and_names(spark):
    docs = docs_of(spark, ["NOISE " + ITEM.upper() + " NOISE", "noise " + NAMES + " noise", "other words " * 30, None])
    bench = bench_of(spark, ITEM, NAMES)
    assert pairs(decontaminate.leaked(docs, bench)) == {(0, 0), (1, 1)}
    assert decontaminate.leaked(docs.limit(0), bench).count() == 0
    assert decontaminate.leaked(docs, bench.limit(0)).count() == 0


def test_stage_drops_capitals(spark, tmpdir_path):
    bench_of(spark, ITEM).write.parquet(tmpdir_path + "/benchmark.parquet")
    docs = docs_of(spark, [ITEM.upper(), ITEM, "other words " * 30]).unionByName(
        spark.createDataFrame([(None, ITEM.upper())], "doc_id long, text string"))
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, tmpdir_path).collect()} == {2, None}


QUESTION = ("Anna buys 5 apples at the market and then she walks home along the river while Paul waits for 20 minutes "
            "near the old bridge and then they share the fruit with all their neighbours")


def test_inserted_word_and_longer_values(spark):
    inserted = ITEM.replace("some of", "some few of")
    longer = QUESTION.replace("Anna", "Mary Ann").replace("5 apples", "5 1/2 apples").replace("20 minutes", "3 hours 20 minutes")
    both = longer.replace("walks home", "walks slowly home")
    docs = docs_of(spark, ["x " + inserted + " y", longer, both, ITEM[:len(ITEM) // 2], "A B C D E F G 1 2 3 4 " * 9])
    assert pairs(decontaminate.leaked(docs, bench_of(spark, ITEM, QUESTION))) == {(0, 0), (1, 1), (2, 1)}
    assert not pairs(decontaminate.contaminated(docs, bench_of(spark, ITEM, QUESTION)))


def test_one_slot_in_conflict(spark):
    item = ("The ship leaves port with 30 sailors and 12 dogs when Anna calls out to Paul near the old tower and Berta "
            "waits until The guard of the bridge has seen Emil at the gate with 9 cats")
    moved = (item.replace("30", "41").replace("12", "8").replace("Anna", "Eva").replace("Paul", "Sven")
             .replace("Berta", "Mia").replace("Emil", "Otto").replace("9", "6"))
    docs = docs_of(spark, [item.replace("The guard", "My guard"), moved.replace("The guard", "My guard"),
                           moved.replace("The guard", "My guard") + " Then Max and Eva and 8 others left. The End"])
    assert pairs(decontaminate.leaked(docs, bench_of(spark, item))) == {(0, 0), (1, 0), (2, 0)}


# --- toxicity

def test_fixed_phrase_is_learnt(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    text = lambda: " ".join(rng.choices(vocab, k=40))
    copied = text() + " qqcopied " + text()
    rows = [(i, text() + (" you zzslur " if i < 10 else " you vvcommon ") + text(), 1) for i in range(1200)]
    rows += [(5000 + i, copied + f" {vocab[i]}", 1) for i in range(60)]
    rows += [(10_000 + i, text() + " you " + text(), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    known = lambda w: w in model.words or any(w.startswith(s) for s in model.stems)
    assert known("vvcommon") and known("zzslur") and not known("qqcopied")


# --- html

def test_text_beside_an_article():
    inner = "<h1>Head</h1><p>Body of the page</p>"
    teaser = "<article><h2>Teaser</h2></article>"
    want = "Head\n\nBody of the page\n\nTeaser"
    assert html_text.text_of_page(f"<body><nav>n</nav><main>{inner}</main>{teaser}<footer>f</footer></body>") == want
    assert html_text.text_of_page(f"<body><header>s</header><div>{inner}</div>{teaser}</body>") == want
    assert html_text.text_of_page(f"<body><article><header>own</header>{inner}</article></body>") == "own\n\n" + want[:-8]


def texts_of(spark, pages):
    rows = [(i, f"https://a.org/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
            .orderBy("page_id").collect()]


def test_copied_articles_stay(spark):
    body = "<p>A long article that many pages hold</p><p>in two paragraphs</p>"
    want = "A long article that many pages hold\n\nin two paragraphs"
    assert texts_of(spark, [f"<article><div>{body}</div></article><div>ref {i}</div>" for i in range(8)])[3].startswith(want)
    assert texts_of(spark, [f"<body><div>{body}</div><div>ref {i}</div></body>" for i in range(8)])[3].startswith(want)
    same = "<body><div>first words</div><div>second words</div></body>"
    assert texts_of(spark, [same] * 8) == ["first words\n\nsecond words"] * 8


def test_notice_of_one_section(spark):
    pages = [f"<body><div>own long text of page number {i}</div>{'<div>Box</div>' if i % 10 < 4 else ''}</body>" for i in range(60)]
    assert texts_of(spark, pages) == [f"own long text of page number {i}" for i in range(60)]
