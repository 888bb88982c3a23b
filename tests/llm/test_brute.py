"""Operators beside plain versions of what they compute, on the smallest tables and on made cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from datarights.llm import decontaminate, interpolation, log_templates, minhash, packing, queries, recompress
from datarights.llm.common import LOWER, UPPER, crc_mod, hash_words
from datarights.llm.exact import exact_groups
from datarights.llm.html_wrappers import align, blocks_of, collapse, extract_main_text, fold
from datarights.session import stage

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def lower(text):
    return text.translate(str.maketrans(UPPER, LOWER))


def near_classes(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_word_hashes():
    rows = [b"A b\tc\n", None, b"", b"x" * 600_000 + b" y " + b"z " * 300_000, "é É".encode()]
    hashes, counts = hash_words(rows, lower=True)
    words = [w for r in rows for w in (r or b"").lower().split()]
    assert counts.tolist() == [3, 0, 0, 300_002, 2] and len(set(words)) == len(set(zip(words, hashes.tolist()))) == len(set(hashes.tolist()))


def test_near_groups(docs, texts):
    want = near_classes(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect()} == want


def test_near_group_of_many(spark):
    """A family of texts of which some pairs are linked and most are not, with copies."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(160):
        w = list(base)
        for i in rng.integers(0, 120, rng.integers(0, 9)):
            w[i] = f"n{d}_{i}"
        texts[d] = " ".join(w)
    texts |= {1000 + d: texts[0] for d in range(30)}
    got = minhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_classes(texts)


def test_estimate(spark):
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    one, two = (np.sort(np.concatenate([common, x])) for x in (a, b))
    minima = minhash._signatures(np.concatenate([one, two]), np.array([0, 800]))
    low = (minima & 15).astype(np.uint64).reshape(2, 8, 16)
    sig = (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist())], "a array<bigint>, b array<bigint>")
    got = df.select(minhash.estimate(F.col("a"), F.col("b")).alias("e"), minhash.estimate(F.col("a"), F.col("a")).alias("s")).first()
    same = (low[0] == low[1]).mean()
    assert got.s == 1.0 and math.isclose(got.e, (same - 1 / 16) / (15 / 16)) and abs(got.e - 0.6) < 0.2


def test_exact_with_colliding_digests(docs, texts):
    """Even a digest that most chunks share groups equal texts only."""
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_groups(docs, digest=lambda c: F.length(c).cast("bigint") % 7).collect()}
    groups = {}
    for d, t in texts.items():
        groups.setdefault(lower(t), []).append(d)
    assert got == {d: (max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def test_repeats(docs, texts):
    words = {d: t.encode().split() for d, t in texts.items()}
    seen = Counter(tuple(w[i: i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i: i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.remove_repeats(docs).collect()} == want
    assert sum(n for _, n, _ in want.values())


def test_anchors_agree():
    """Any window has an anchor in its range, and the same one wherever it stands, runs included."""
    rng = np.random.default_rng(9)
    margin, seek, _ = recompress.margins()
    for _ in range(200):
        window = rng.integers(0, rng.integers(1, 30), 35).astype(np.uint64) + np.uint64(1)
        sides = [np.concatenate([rng.integers(0, 9, rng.integers(0, 40)).astype(np.uint64) + np.uint64(1), window, rng.integers(0, 9, 40).astype(np.uint64) + np.uint64(1)]) for _ in range(2)]
        sides = [np.concatenate([rng.choice(window[:1], k), s]) for k, s in zip((0, 3), sides)]
        found = []
        for s in sides:
            starts = [i for i in range(len(s) - 34) if (s[i: i + 35] == window).all()]
            at, key = recompress.anchors(s, np.array([len(s)]))
            found.append([{(a - i, k) for a, k in zip(at.tolist(), key.tolist()) if margin <= a - i < margin + seek} for i in starts])
        assert all(x & y for x in found[0] for y in found[1])


def test_interpolation(docs, texts):
    rows = interpolation.score_texts(docs, ranges=5).collect()
    words = {d: [*WORD.findall(lower(t)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    total, types = sum(counts.values()), len(counts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_interpolated_sums(spark):
    """All counts in several blocks and lists give what one dictionary gives."""
    texts = {i: " ".join(f"v{(i * j) % 7}" for j in range(1, 9)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    several, one = (sorted((r.doc_id, round(r.score, 9)) for r in interpolation.score_texts(x, n).collect()) for x, n in ((df, 9), (df.coalesce(1), 1)))
    assert several == one


def test_counts_above_32_bits():
    import pyarrow as pa

    pack, keys = interpolation._numbers, interpolation.pack_keys(np.array([5, 9], np.uint64))
    assert interpolation._read_numbers(pack(np.array([1, 2**32 - 1]))).tolist() == [1, 2**32 - 1] and interpolation._read_numbers(pack(np.zeros(0, np.int64))).tolist() == []
    rows = pa.table({"block": [1, 2], "kind": [interpolation.BIGRAM] * 2, "range": [0, 0], "keys": [keys, keys], "train": [pack(np.array([3_000_000_000, 1]))] * 2, "aside": [pack(np.array([1, 0]))] * 2})
    out = interpolation._merge(rows)
    assert interpolation._read_numbers(out.column("train")[0].as_py()).tolist() == [6_000_000_000, 2]
    assert interpolation._read_numbers(out.column("aside_train")[0].as_py()).tolist() == [6_000_000_000]


def test_weights():
    bins = [(3, -8, -40, 90), (3, -9999, -16, 10), (5, -9999, -16, 50)]
    w = interpolation.fit_weights(bins, 1e-4)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[3, 0] > 0.8 and w[5, 0] < 0.1 and (w[4] == w[3]).all()


def test_pack_keys():
    for keys in (np.array([5], np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))):
        assert (interpolation.unpack_keys(interpolation.pack_keys(keys)) == keys).all()


@pytest.mark.parametrize("name,label,threshold", [("op5_quality", "quality", 0.85), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, threshold):
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES[name](spark, sf)
    judged = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert judged.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= threshold


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r.piece)):
            part = ids[4096 * k: 4096 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
        assert len(pieces[d]) == -(-len(ids) // 4096)
    for slots in sequences.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))] and sum(n for _, n in slots) <= 4096
    return len(sequences), -(-sum(r.length for r in rows) // 4096)


def test_packing(docs, texts):
    used, least = check_packing(packing.pack(docs, TOKENIZER).collect(), texts)
    assert used <= least + 2


def test_tokens_of_odd_texts():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    odd = ["", " ", "H̱ello Áb <|ENDOFTEXT|> <|endoftext|>x,", "It's, a. b!, c.\n..., x,\ty. Ü. ΟΔΟΣ. İ, 3.4, $5. don't. l'été,", "a b.  c,", "x<|startoftext|>y.", "A" * 5000, "각, 한글.", "x́, y"]
    for text, got in zip(odd, packing.token_bytes([t.encode() for t in odd], TOKENIZER, 1)):
        assert got == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes(), text


def test_tokens_of_words_that_come_apart():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    apart = ["İstanbul", "\u0958", "\ufb2a"]
    assert all(w.isalpha() for w in apart)
    for text in [*(f"one {w} two" for w in apart), f"a {' b '.join(apart)} c"]:
        got = next(packing.token_bytes([text.encode()], TOKENIZER, 1))
        assert got == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes(), text
    ends = packing._encoder(TOKENIZER)[1]
    several = dict(packing._encode_words(tokenizer, np.ones_like(ends), ["ordinary", "unforeseeable"]))  # as if every id ended a word
    assert all(np.frombuffer(v, "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids for w, v in several.items())


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(2)
    for size, n in ((64, 500), (4096, 3000), (16, 0)):
        histogram = Counter(rng.integers(1, size + 1, n).tolist())
        plan = packing.plan_packing(histogram, size)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= size and times > 0
            for x in lengths:
                used[x] += times
        assert used == histogram
        assert sum(t for _, t in plan) <= 1.02 * -(-sum(k * v for k, v in histogram.items()) // size) + 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "blue green red"), (3, "red " + "x " * 20 + "green blue"), (4, "green blue")], "doc_id bigint, text string")
    index = decontaminate.postings(docs)
    phrases = spark.createDataFrame([("p", ["red", "green", "blue"])], "wid string, words array<string>")
    near = decontaminate.near_phrases(index, phrases, slop=2).join(docs.withColumn("_d", F.col("doc_id")), "_d")
    assert sorted(r.doc_id for r in near.collect()) == [1, 2]
    assert decontaminate.exact_phrases(index, phrases).count() == 0
    assert decontaminate.exact_phrases(index, spark.createDataFrame([("q", ["green", "blue"])], "wid string, words array<string>")).count() == 2


def test_unrestricted_index_gives_the_same(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    phrases, _ = decontaminate.phrases_of(items)
    found = [sorted(map(tuple, decontaminate.exact_phrases(stage(x), phrases).collect())) for x in (decontaminate.postings(docs), decontaminate.postings(docs, phrases, 3), decontaminate.postings(docs, phrases, 3, sent=10))]
    assert found[0] and found[0] == found[1] == found[2]


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body class="page with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>{title}</h1></header>
<p>{one} &amp; <b>bold</b><br>same   block<p>second &lt;p&gt;<ul><li>item<li>item 2</ul>
<div class="ad-box">Buy</div><form><label>Mail</label></form><script>var x = "</p>";</script>
<table><tr><td>a</td><td>b</td></tr></table></article><section id="comments"><article><p>A reader says</p></article></section></main>
<aside>Related</aside><footer>&copy; x</footer></body></html>"""


def test_page():
    text = [t for p, t, _ in blocks_of(PAGE.format(title="T &amp; U", one="One")) if "!" not in p]
    assert text == ["T & U", "One & bold same block", "second <p>", "item", "item 2", "a", "b"]


def test_wrappers(spark):
    div = "<body><div><a href=/>home</a> <a href=/x>menu</a></div><div class=c><h2>{}</h2><p>{}</p>{}</div><div>Same line on all pages</div></body>"
    rows = [(i, f"http://h.example/{i}", div.format(f"Title {i}", f"text {i}", "<p>more</p>" * (i % 3) + f"<h3>sub {i}</h3>" * (i % 2))) for i in range(9)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Title 3\n\ntext 3\n\nsub 3" and got[4] == "Title 4\n\ntext 4\n\nmore"


def test_copies_and_layout_classes(spark):
    page = "<body><div class='layout with-sidebar'><div class='sidebar'>s</div><h2>Title</h2><p>copied text</div></body>"
    rows = [(i, "http://c.example/x", page) for i in range(4)]
    got = {r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {"Title\n\ncopied text"}


def test_alignment():
    a, slots = collapse(list("nnnabababz"))
    assert a == [[True, ["n"]], [True, ["a", "b"]], [False, ["z"]]] and slots == [0, 0, 0, 1, 2, 1, 2, 1, 2, 3]
    wrapper = fold([a, collapse(list("nabz"))[0], collapse(list("nqz"))[0]])
    assert [g for g in wrapper if g[1] == ["n"]] == [[True, ["n"], False]] and [g for g in wrapper if g[1] == ["q"]] == [[False, ["q"], True]]
    merged, to_a, to_b = align(wrapper, collapse(list("nz"))[0])
    assert [merged[i][1] for i in to_b] == [["n"], ["z"]] and [merged[i][1] for i in to_a] == [g[1] for g in wrapper]


def test_pipeline(spark, docs, texts):
    """Each stage against a plain version of it, on what the stage before left."""
    left = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in left.collect()}
        left = stage(apply(spark, left, SF))
        assert left.columns == docs.columns
        after = {r.doc_id for r in left.collect()}
        if name == "toxicity":
            judged = queries.QUERIES["op9_toxicity"](spark, SF)
            assert after == {r.doc_id for r in judged.collect() if not r.predicted}
        elif name == "exact dedup":
            assert after == set({lower(t): d for d, t in sorted(before.items())}.values())
        elif name == "minhash near-dedup":
            assert after == {d for d, (_, c) in near_classes(before).items() if d == c}
        else:
            table = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert after == before.keys() - {r.doc_id for r in table.where("contaminated").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, {r.doc_id: r.text for r in left.collect()})


def test_unlike_words_of_equal_polynomials():
    one, other = b"a", b"b"
    for _ in range(12):  # sums of powers of any odd number modulo 2^64 are equal for these two
        one, other = one + other, other + one
    first, second, counts = hash_words([one, other, one + b" " + other], lower=False, second=True)
    assert counts.tolist() == [1, 1, 2]
    assert first[0] == first[2] != first[1] == first[3] and second[0] == second[2] != second[1] == second[3]


def test_all_patterns_are_fitted():
    lengths = np.arange(1, 60)
    rows = packing._patterns(lengths, 60)
    found = {tuple(sorted(int(lengths[i]) for i in row if i >= 0)) for row in rows}
    assert found == {(a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == 60} | {(a, 60 - a) for a in lengths if 2 * a <= 60}
    assert len(found) == len(rows)


def test_masked_lines():
    text = b"a1 b 22\n\tx\r\ny9z9 w\n7\n\nno digits\v3a"
    assert log_templates.masked_lines(text) == [[re.sub(rb".*[0-9].*", b"<*>", w) for w in line.split()] for line in text.split(b"\n")]
    assert log_templates.masked_lines(None) == log_templates.masked_lines(b"") == [[]]


def plain_templates(rows: set, least: int, share: float) -> dict:
    """Dropped lines of every (doc_id, text), by sets of documents."""
    split = {row: log_templates.masked_lines((row[1] or "").encode()) for row in rows}
    held: dict = {}
    for row, lines in split.items():
        for line in lines:
            for pos, token in enumerate(line):
                held.setdefault((len(line), *line[:2], pos, token), set()).add(row)

    def template(line):
        fixed = [len(held[(len(line), *line[:2], pos, token)]) >= least for pos, token in enumerate(line)]
        return (len(line), *line[:2], tuple(t if f else None for t, f in zip(line, fixed))) if sum(fixed) >= share * len(line) else (tuple(line),)

    where: dict = {}
    for row, lines in split.items():
        for line in filter(None, lines):
            where.setdefault(template(line), set()).add(row)
    return {row: [bool(line) and len(where[template(line)]) >= least for line in lines] for row, lines in split.items()}


@pytest.mark.parametrize(("least", "share"), [(2, 0.5), (3, 0.9), (10, 0.5)])
def test_templates_of_all_documents(spark, docs, least, share):
    lines = ["alpha beta gamma one", "alpha beta gamma two", "alpha beta delta one", "alpha beta delta 7", "", "zeta 5 x", "zeta 6 x", "omega"]
    made = [(1000 + i, "\n".join(lines[(i * 3 + j * (1 + i % 4)) % 8] for j in range(1 + i % 6))) for i in range(40)]
    made += [(2000, None), (2001, ""), made[5], made[5], (None, made[7][1]), (2002, "\n".join(lines * 3))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string").repartition(3))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = plain_templates(set(rows), least, share)
    expected = Counter()
    for row in rows:
        kept = [line for line, out in zip((row[1] or "").split("\n"), want[row], strict=True) if not out]
        expected[row[0], len(want[row]), sum(want[row]), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = stage(log_templates.drop_recurring_lines(stage(table), least, share))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == expected
    assert sum(n[2] for n in expected) > 0


def test_folds(spark, docs):
    got = {r.doc_id: r.m for r in docs.select("doc_id", crc_mod(F.col("doc_id"), 7).alias("m")).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) % 7 for d in got}
