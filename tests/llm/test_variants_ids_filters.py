"""Spelling forms, files of id planes and the filter audit beside plain versions, and their edge cases."""

import io
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datarights.llm import filter_audit, planes, spelling
from datarights.llm.common import LOWER, UPPER, documents, labels

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, source string"
EXTRA = ["word", "n", "key", "base", "mask", "part", "digest", "path", "start", "place", "good"]


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    shorts = ["", None, " \t", "Ünïcode Straße naïve coöperate", "a  b \n\n c   d", "x<|endoftext|>y  <|endoftext|> z", "tab\tand space   end ", "#" * 70, "AB " * 60]
    made = [(i, t, "s" if i % 2 else None) for i, t in enumerate(shorts)]
    words = ["variant", "varient", "variants", "variante", "varints", "colour", "colours", "kolours", "abcdefgh", "bacdefgh"]
    made += [(100 + i, " ".join(random.choices(words, range(len(words), 0, -1), k=70)), random.choice(["a", "b", ""])) for i in range(30)]
    made += [(300 + i, "the same text again " * 13, "copies") for i in range(20)] + [(300, "the same text again " * 13, "copies")] * 3
    return made + [(None, "the same text again " * 13, "copies"), (None, "no id", "a"), (None, "no id", "b"), (7, "a second text of seven", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA}).repartition(4)


def triples(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in documents(spark, folder).collect()]


# spelling

def plain_forms(rows, noise=31):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted(set("".join(words)))
    near = {}
    for w in words:
        edits = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in ["", *letters]} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [x for x in edits - {w} if x in words]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def forms(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("most", [spelling.GROUP, 3])
def test_forms(spark, most):
    got = forms(spelling.spelling_forms(documents(spark, SF), most=most))
    assert got == plain_forms(triples(spark, SF)) and any(f for _, f, *_ in got) and max(n for *_, n, _ in got) > 2


def test_forms_of_made_words(spark, docs, rows):
    assert forms(spelling.spelling_forms(docs, noise=5)) == plain_forms(rows, 5)
    chain = [(1, "letters " * 400 + "lettters " * 40 + "letttters " * 4 + "lletttters " * 4 + "Zeppelin zeppelin ", "s")]
    got = {w: (f, r, k) for w, f, r, _, k, _ in forms(spelling.spelling_forms(spark.createDataFrame(chain, SCHEMA), noise=0))}
    assert got["letttters"] == ("lettters", "letters", 2) and got["lletttters"] == ("", "lletttters", 1) and got["zeppelin"] == ("", "zeppelin", 0)
    assert spelling.spelling_forms(docs.limit(0)).count() == 0


def test_groups_stay_small(spark):
    """Words with one common half are cut by the other; what stays together has one open place."""
    random.seed(5)
    words = {"prefix" + "".join(random.choices("abcdef", k=6)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    groups = spelling.grouped(df, most=50).groupBy("key", (F.col("high") - F.col("low")).alias("open")).count().collect()
    assert max(r["count"] for r in groups if r.open > 1) <= 50
    found = {(r.word, r.near) for r in spelling.near_words(df, most=50).collect()}
    plain = {(w, x) for w in words for i in range(6, 12) for c in "abcdef" if (x := w[:i] + c + w[i + 1:]) in words and x != w}
    assert found == plain and plain


def test_gram_blocks_find_all_edits():
    random.seed(1)
    words = sorted({"".join(random.choices("abc", k=k)) for k in (7, 8) for _ in range(300)})
    ones = np.ones(len(words), np.int64)
    got = spelling.block_pairs(words, ones, 7 * ones, 0 * ones, 7 * ones, block=64)

    def near(a, b):
        return any(a[:i] + a[i + 1:] == b[:i] + b[i + 1:] for i in range(len(a))) if len(a) == len(b) else any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    plain = {(a, b) for a, b in itertools.combinations(sorted(words, key=lambda w: (len(w), w)), 2) if len(a) == 7 and near(a, b)}
    assert {frozenset((words[x], words[y])) for x, y in got} == {frozenset(p) for p in plain} and len(got) == len(plain)


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(spelling, "_SEGMENT", 50)
    text = "Straßenbahn überholen, " * 40 + "x" * 200 + " endlich9endlich"
    whole = Counter()
    for w, n in spelling.runs_of(4, text.encode(), noise=0):
        whole[w] += n
    assert whole == {"straßenbahn": 40, "überholen": 40, "x" * 200: 1, "endlich": 2}


# id planes

PLAIN = Tokenizer.from_file(TOKENIZER)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 1000])
def test_planes(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 100 else 60_000, n).astype("<u4")
    assert np.array_equal(planes.from_planes(planes.to_planes(ids, bits), n, bits), ids)


@pytest.mark.parametrize("bits", [True, False])
def test_plane_file(bits):
    rng, stream = np.random.default_rng(0), io.BytesIO()
    docs = [(i if i % 5 else None, rng.integers(0, 50_257, k).astype("<u4")) for i, k in enumerate([3, 0, 1, 130, 64, 63, 500, 2])]
    writer = planes.PlaneWriter(stream, bits, chunk=64)
    for d, ids in docs:
        writer.add(d, ids)
    assert writer.close() == len(stream.getvalue())
    file = planes.PlaneFile(pa.BufferReader(stream.getvalue()))
    back = list(file.documents())
    assert [b[0] for b in back] == [d for d, _ in docs] and all(np.array_equal(b[2], ids) for b, (_, ids) in zip(back, docs))
    whole = np.concatenate([ids for _, ids in docs])
    assert [b[1] for b in back] == np.cumsum([0] + [len(i) for _, i in docs])[:-1].tolist()
    for first, n in [(0, len(whole)), (5, 0), (63, 2), (64, 64), (100, 400), (len(whole) - 1, 1)]:
        assert np.array_equal(file.ids(first, n), whole[first: first + n])
    with pytest.raises(ValueError):
        planes.PlaneFile(pa.BufferReader(b"something else" * 20))


def test_encoder(spark):
    texts = [t or "" for _, t, _ in triples(spark, SF)][:60] + ["", " ", "  ", " a", "a ", "a  b", "\n a", "a \x1c b \x85 c ᠎ d", "é́   x", "it's  we'll ", "line.\nnext, line\nünd 3, 4.5. x.. y ,\nlast", "a\n\nb\n c", "x\u00a0\ny", "\0a b \0a", "two\nlines", "w. 7, Ä, é.", "é,\ne\u0301. \u00d7.", "<|endoftext|>  <|endoftext|>"]
    encoder = planes.Encoder(TOKENIZER, most=300)
    for _ in range(2):
        assert [b.tolist() + [2] for b in encoder.encode([t.encode() for t in texts])] == [plain_ids(t) for t in texts]


def test_encoder_knows_stems():
    """A word that was seen is not encoded again for the stop or comma behind it, nor what the older half still holds."""
    texts = ["the velum kappa und Übermut", "a kappa, Übermut velum.", "velum, kappa. velum"]
    encoder, asked = planes.Encoder(TOKENIZER, most=10), []
    of_letters = encoder._of_letters
    encoder._of_letters = lambda parts: asked.extend(parts) or of_letters(parts)
    for t in texts:
        assert encoder.encode([t.encode()])[0].tolist() + [2] == plain_ids(t)
    assert sorted(asked) == sorted(["\0the", "velum", "kappa", "und", "Übermut", "\0a", "\0velum"]) and encoder.old


@pytest.mark.parametrize("partitions", [1, 5])
def test_files(spark, docs, rows, partitions):
    manifest = planes.write_ids(docs, TOKENIZER, file_ids=400, chunk=64, partitions=partitions)
    got = planes.read_documents(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got if r.doc_id is not None) == sorted((False, d, plain_ids(t)) for d, t, _ in rows if d is not None)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    ids = np.concatenate([r.ids for r in got])
    assert manifest.count() > 3 and np.array_equal(planes.read_range(manifest, 390, 900), ids[390:1290])


def test_token_files(spark, docs, tmp_path):
    got = {r.doc_id: r for r in planes.token_files(documents(spark, SF), TOKENIZER, str(tmp_path / "ids")).collect()}
    start = 0
    for doc_id, text, _ in sorted(triples(spark, SF)):
        ids = plain_ids(text)
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert planes.token_files(docs.limit(0), TOKENIZER).count() == 0


# filter audit

def plain_audit(rows, good=(), toxic=()):
    firsts, out = {}, {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t or ""] = min(firsts.get(t or "", d), d)
    failing = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        copy = t in firsts and (d is None or firsts[t] < d)
        tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), copy]
        failing.append((s or "", {c for c, f in zip("ABCDE", tests) if f}, d in good, d in toxic))
    for part in {f[0] for f in failing}:
        mine, shapley = [f for f in failing if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                fails = sum(c in f[1] for f in mine)
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(f[1] == {c} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit(spark, docs, rows):
    marks = [(3, 1, 0), (3, 0, 1), (301, 1, 1), (102, 1, 0), (104, 0, 1), (7, 1, 1), (None, 1, 1), (8, None, None)]
    marked = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(1))
    want = plain_audit(rows, {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, t in marks if t == 1 and d is not None})
    got = audit(filter_audit.audit_filters(docs, marked))
    assert got == want and len(got) == 600 * 5
    assert sum(w[6] for (p, _, s), w in want.items() if s == 1) > 0 and filter_audit.audit_filters(docs.limit(0), marked).count() == 0
    assert audit(filter_audit.audit_filters(docs, marked.limit(0))).keys() == want.keys()


def test_audit_of_the_table(spark):
    marks = {r.doc_id: r for r in labels(spark, SF).collect()}
    want = plain_audit(triples(spark, SF), {d for d, r in marks.items() if r.quality == 1}, {d for d, r in marks.items() if r.toxic == 1})
    assert audit(filter_audit.audit_filters(documents(spark, SF), labels(spark, SF))) == want


def test_paths_through_the_lattice():
    ahead, behind = filter_audit.path_counts(4)
    orders = list(itertools.permutations(range(4)))
    for state in range(16):
        members = {i for i in range(4) if state >> i & 1}
        assert ahead[state] * behind[state] == sum(set(o[: len(members)]) == members for o in orders)


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(filter_audit, "_SEGMENT", 20)
    text = ("some words that come\tagain\n" * 9 + "z" * 70).encode()
    assert filter_audit._word_counts(text) == (46, 6)


def test_filters_may_be_others(spark):
    cells = spark.createDataFrame([("p", 0, 4, 1, 0), ("p", 3, 2, 0, 2), ("p", 1, 1, 1, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = audit(filter_audit.audit_orders(cells, "XY"))
    assert got["p", "XY", 1] == [4, 3, 0, 1, 1, 2, 4] and got["p", "YX", 2] == [4, 1, 2, 1, 1, 0, 4] and got["p", "XY", 2] == [4, 0, 2, 0, 0, 0, 2]
    with pytest.raises(ValueError):
        filter_audit.audit_orders(cells, "ABCDEFGH")
