"""Null and empty texts, repeated rows, ties, clashing columns and empty tables, for every operator and stage."""

import math
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from datarights.llm import stages
from datarights.llm.common import crc_mod
from datarights.llm.decontaminate import contamination
from datarights.llm.exact import exact_groups
from datarights.llm.html_wrappers import blocks_of, extract_main_text
from datarights.llm.interpolation import folds, score_texts
from datarights.llm.log_templates import drop_recurring_lines
from datarights.llm.minhash import near_groups
from datarights.llm.packing import pack
from datarights.llm.quality import fit_quality, sample_by_label, score_quality
from datarights.llm.recompress import remove_repeats
from datarights.llm.toxicity import fit_toxicity, score_toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} Übung{i % 31}." for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three"), (5, "one TWO three"), (5, "one TWO three"), (None, "no id here"), (6, LONG),
        (7, f"alpha {PASSAGE} beta"), (8, f"gamma delta {PASSAGE}"), (9, "é " * 40), (10, "x " * 40)]
# other columns named like those the operators make
EXTRA = ["_d", "_k", "block", "kind", "score", "h1", "t", "recipe", "keep_id", "length", "rank", "kept", "cls", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    return df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint")).withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")


ITEMS = [(1, PASSAGE), (2, None), (3, "!!"), (4, "two three"), (None, "no id"), (4, "two three")]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_exact(docs, empty):
    got = by_id(exact_groups(docs))
    assert [r.keep_id for r in got[1] + got[2]] == [2, 2] and got[1][0].group_size == 2 and not got[1][0].kept
    assert got[4][0].keep_id == 5 and got[4][0].group_size == 3 and [r.kept for r in got[5]] == [True, True]
    assert got[None][0].kept and got[None][0].keep_id is None and got[3][0].group_size == 1
    assert exact_groups(empty).count() == 0


def test_minhash(docs, empty):
    got = by_id(near_groups(docs))
    assert [got[i][0].n_shingles for i in (1, 2, 3, 4, 10)] == [0, 0, 0, 1, 1]
    assert got[5][0].component_id == 4 and len(got[5]) == 2 and not got[5][0].kept
    assert got[1][0].component_id == 1 and got[2][0].kept and got[None][0].component_id is None and got[None][0].kept
    assert got[9][0].component_id == 9 and got[8][0].component_id == 7
    assert near_groups(empty).count() == 0


def test_one_document_with_two_texts(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "q w e r t y"), (9, "q w e r t y")]
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.component_id for r in got.collect()} == {3}


def test_interpolation(docs, empty):
    got = by_id(score_texts(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0].n_tokens == 1 and got[1][0].score == got[2][0].score == got[3][0].score
    assert len({r.train_tokens for rows in got.values() for r in rows}) == 1
    assert got[5][0].score == got[5][1].score and all(r.score <= 0 for rows in got.values() for r in rows)
    assert all(r.held_out == (zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2) for k, rows in got.items() for r in rows)
    assert score_texts(empty).count() == 0


def test_interpolation_of_equal_blocks(spark):
    shape = "doc_id bigint, text string"
    two = spark.createDataFrame(spark.sparkContext.parallelize([(5, "x"), (5, "x")], 2), shape)
    assert len(two.rdd.glom().filter(len).collect()) == 2
    got, one = (score_texts(df).collect() for df in (two, two.coalesce(1)))
    assert sorted(got) == sorted(one) and [r.train_tokens for r in got] == [4, 4]
    long = spark.range(2).select(F.lit(5).cast("bigint").alias("doc_id"), F.repeat(F.lit("word "), 1_800_000).alias("text")).coalesce(1)
    got = score_texts(long).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].train_tokens == 2 * 1_800_001


def test_interpolation_of_equal_blocks_set_aside(spark):
    aside = next(i for i in range(1000) if folds([i])[1][0])
    rows = spark.sparkContext.parallelize([(aside, "x"), (aside, "x")], 2)
    got = score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].train_tokens == 4


def test_quality(docs, empty, labelled):
    model = fit_quality(docs, labelled)
    got = by_id(score_quality(docs, model))
    assert sum(map(len, got.values())) == len(ROWS) and all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert got[1][0].score == got[2][0].score
    assert score_quality(empty, model).count() == 0
    assert fit_quality(docs, labelled.limit(0)) is None
    assert {r.score for r in score_quality(docs, None).collect()} == {0.5}


def test_toxicity(spark, docs, empty):
    draw = random.Random(5)
    text = lambda: " ".join(draw.choice("bcdfgh") + draw.choice("aeiou") + draw.choice("klmnprst") + draw.choice("aeiou") + draw.choice("xyzw") for _ in range(14))
    bad = [(i, f"{text()} grimbo {text()}") for i in range(40)]
    good = [(100 + i, text()) for i in range(80)]
    train = spark.createDataFrame(bad + good, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(80)], "doc_id bigint, toxic int")
    model = fit_toxicity(train, labels)
    assert {(r.doc_id < 100) == (r.predicted == 1) for r in score_toxicity(train, model).collect()} == {True}
    got = by_id(score_toxicity(docs, model))
    assert sum(map(len, got.values())) == len(ROWS) and {r.predicted for rows in got.values() for r in rows} == {0}
    assert score_toxicity(empty, model).count() == 0
    assert fit_toxicity(train, labels.where("toxic = 1")) is None
    assert {r.score for r in score_toxicity(docs, None).collect()} == {0.0}


def test_few_toxic_texts(spark):
    small, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(small, labels)
    words = "disgusting|scum|loser|moron|clown|worthless|trash|pathetic|stupid|idiot"
    insults = F.size(F.array_distinct(F.expr(f"regexp_extract_all(lower(text), '\\\\b({words})\\\\b', 1)")))
    got = score_toxicity(small, model).join(small.select("doc_id", insults.alias("n")), "doc_id").join(labels, "doc_id", "left").collect()
    planted = [r for r in got if r.toxic and r.n > 1]  # the other toxic labels are noise, they hold no such word
    assert len(planted) > 5 and all(r.predicted for r in planted)
    assert not any(r.predicted for r in got if not r.n)


def test_rare_toxic_texts_are_all_drawn(spark):
    ids = spark.range(4_000).withColumn("text", F.concat(F.lit("w"), F.col("id"))).withColumnRenamed("id", "doc_id")
    labels = ids.select("doc_id", (F.col("doc_id") % 200 == 1).cast("int").alias("toxic"))
    rows, shift = sample_by_label(ids, labels, "toxic", 5, 0, 160, ["text"])
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    known = labels.where(crc_mod(F.col("doc_id"), 5) != 0).groupBy("toxic").count().collect()
    known = {r["toxic"]: r["count"] for r in known}
    assert n[1] == min(20, known[1]) and n[0] == 160 - n[1]
    assert abs(shift - math.log(known[1] * n[0] / known[0] / n[1])) < 1e-9


def test_toxicity_by_patterns_alone(spark):
    rows = [(i, f"t{i} s{i} u{i} really!!! v{i}" if i % 4 == 0 else f"t{i} s{i} u{i} calm v{i}") for i in range(60)]
    rows = [(i, t.replace("really", f"r{i}")) for i, t in rows]
    train = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    model = fit_toxicity(train, labels)
    assert not model.lexicon.features
    assert {(r.doc_id % 4 == 0) == (r.predicted == 1) for r in score_toxicity(train, model).collect()} == {True}


def test_repeats(docs, empty):
    got = by_id(remove_repeats(docs))
    assert got[7][0].n_removed == got[8][0].n_removed == 60 and got[7][0].n_words == 62
    assert got[1][0].n_words == got[3][0].n_words == 0 and got[10][0].n_removed == 40 and got[5][0].n_removed == 0
    assert sum(map(len, got.values())) == len(ROWS) and remove_repeats(empty).count() == 0


def test_templates(spark, docs, empty):
    assert sum(r.n_dropped for r in drop_recurring_lines(docs).collect()) == 0
    assert drop_recurring_lines(empty).count() == 0
    letter = "abcdefghijklmnop"
    rows = [(i, f"{letter[i] * 3} {letter[i] * 4} {letter[i] * 5}\nPosted by user{i} at 10:{i}0 in {letter[i] * 3}\n\nlast{i} line") for i in range(12)]
    got = drop_recurring_lines(spark.createDataFrame([*rows, (99, None), (98, "")], "doc_id bigint, text string")).collect()
    assert {(r.n_lines, r.n_dropped) for r in got if r.doc_id < 90} == {(4, 2)}  # the posted-by line and the last one
    assert all(r.kept.startswith(letter[r.doc_id] * 3) and r.kept.endswith(letter[r.doc_id] * 5 + "\n") for r in got if r.doc_id < 90)
    assert {r.n_dropped for r in got if r.doc_id >= 90} == {0}


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("_d", F.lit(1))
    got = by_id(contamination(docs, items))
    assert got[7][0].n_hit == 60 and got[7][0].contaminated and got[7][0].item_ids == ["1"]
    assert got[4][0].n_hit == 2 and got[5][0].item_ids == ["4"] and len(got[5]) == 2
    assert got[None][0].n_hit == 2 and got[None][0].n_items == 0 and got[None][0].contaminated
    assert got[1][0].n_words == 0 and not got[1][0].contaminated and got[6][0].n_hit == 0
    assert contamination(empty, items).count() == 0
    assert {r.n_hit for r in contamination(docs, items.limit(0)).collect()} == {0}


def test_packing(docs, empty):
    rows = pack(docs, TOKENIZER).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS} and sum(r.doc_id == 5 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    long = sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)
    assert len(long) > 5 and all(r.length == 4096 for r in long[:-1]) and [r.start for r in long] == [4096 * i for i in range(len(long))]
    assert pack(empty, TOKENIZER).count() == 0


def test_pages(spark):
    page = "<html><body><div class='menu'>m</div><article><h1>T</h1><p>a &amp; b<p>c</article></body></html>"
    rows = [(1, "http://a.b/c", page), (1, "http://a.b/c", page), (2, None, page), (3, "http://a.b/d", None), (4, "http://a.b/e", ""), (5, "no url", "just text"), (None, "http://A.B/", "<p>x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("host", "stream", "blocks", "text")})
    got = {}
    for r in extract_main_text(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert [r.text for r in got[1]] == ["T\n\na & b\n\nc"] * 2 and got[2][0].text == "T\n\na & b\n\nc" and got[2][0].url is None
    assert got[3][0].text == got[4][0].text == "" and got[3][0].n_chars == 0 and got[5][0].text == "just text" and got[None][0].text == "x"
    assert extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("attribute", ['class="entry" data-title="Hidden gems of Rome"', 'title="hidden costs"', 'data-hidden="false"', 'data-role="banner"', 'data-grid="footer"', "title='a \"class=menu\" b'"])
def test_attributes_by_exact_name(attribute):
    assert [t for _, t, _ in blocks_of(f"<div {attribute}><p>kept</p></div>")] == ["kept"]
    assert not any("!" in path for path, _, _ in blocks_of(f"<div {attribute}><p>kept</p></div>"))
    for off in ("hidden", 'HIDDEN=""', "class=menu", 'role="banner"', 'aria-hidden="true"', "style='display: none'"):
        assert all("!" in path for path, _, _ in blocks_of(f"<div {attribute} {off}><p>off</p></div>"))


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "video", "canvas"])
def test_unclosed_elements(tag):
    text = lambda page: [t for _, t, _ in blocks_of(page)]
    assert text(f"<p>a</p><{tag}><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert text(f"<p>a</p><{tag}><p>b</p><{tag}>x</{tag}><p>c</p>") == ["a", "b", "c"]
    assert text(f"<p>a</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>c</p>") == ["a", "c"]
    assert text(f"<{tag}>x<!-- <{tag}> --><script>'<{tag}>'</script>y</{tag}><p>c</p>") == ["c"]
    assert text("<p>a</p><script>b<p>c</p>") == ["a"]


@pytest.mark.parametrize("stage", [stages.drop_toxic, stages.drop_copies, stages.drop_near_copies, stages.drop_contaminated])
def test_stages(spark, docs, empty, labelled, tmp_path, stage):
    labelled.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = stage(spark, docs, str(tmp_path))
    assert left.schema.names == docs.schema.names
    ids = [r.doc_id for r in left.collect()]
    want = {"drop_toxic": 12, "drop_copies": 9, "drop_near_copies": 9, "drop_contaminated": 12 - 6}[stage.__name__]
    assert len(ids) == want, sorted(map(str, ids))
    assert stage(spark, empty, str(tmp_path)).count() == 0
    packed = stages.pack_sequences(spark, left, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(ids)
