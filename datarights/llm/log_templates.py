"""Line deduplication by log templates.

Lines are sorted into a tree of fixed depth: first by their number of tokens, then by their two
leading tokens, fields with a digit counting as variable. In a leaf, a token that enough documents
have at its place is fixed and anything else there is variable, which gives every line its template; a
line that shares fewer than half of its tokens with others stays itself. Lines whose template stands
in enough documents are dropped.

Leaves are counted by blocks of texts, so that only lines of leaves that recur are looked at closer.
Equal lines are one row from there on: tokens are kept and taken apart once for each different line,
and documents are told by the names of their lines.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.blocks import PRESENT, beside, count_in_blocks, in_blocks
from datarights.llm.common import KEY, column_bytes
from datarights.session import stage_unsized as stage

LEAST_DOCS = 10
_DIGIT = re.compile(rb"[0-9]")
_BLANK = re.compile(rb"[ \n]")
_BLANKS = bytes.maketrans(b"\t\v\f\r", b"    ")
VARIABLE = b"<*>"


def _hash(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data)
    return value - (value >> 63 << 64)


def masked_lines(text: bytes | None) -> list[list[bytes]]:
    """The tokens of every line, fields with a digit replaced; a blank line has none."""
    text, parts, at = (text or b"").translate(_BLANKS), [], 0
    for digit in _DIGIT.finditer(text):
        i = digit.start()
        if i >= at:
            parts += text[at: 1 + max(text.rfind(b" ", at, i), text.rfind(b"\n", at, i), at - 1)], VARIABLE
            end = _BLANK.search(text, i)
            at = end.start() if end else len(text)
    return [line.split() for line in b"".join([*parts, text[at:]]).split(b"\n")]


def leaf_of(tokens: list[bytes]) -> int:
    return _hash(b"%d %b" % (len(tokens), b" ".join(tokens[:2])))


def _leaf_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    found: Counter = Counter()
    for text in column_bytes(batch):
        found.update({leaf_of(t) for t in masked_lines(text) if t})
    return {"leaf": np.fromiter(found.keys(), np.int64, len(found)), "n": np.fromiter(found.values(), np.int64, len(found))}


def _sha(lines: list[bytes]) -> str:
    return hashlib.sha256(b"\n".join(lines)).hexdigest()


_LINES = pa.list_(pa.struct([("no", pa.int32()), ("leaf", pa.int64()), ("line", pa.binary())]))
_SEEN = "doc_id bigint, _d bigint, _k bigint, text string, lines array<struct<no:int,leaf:bigint,line:binary>>, n_lines bigint, kept_sha256 string"
_DONE = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept string"


def _recurring(texts: pa.Table, back: pa.Table) -> pa.Table:
    """Two kinds of rows: every text with its lines of recurring leaves (a text without any is done), and the block's different lines."""
    leaves = set(back.column("leaf").to_pylist())
    rows, tokens = [], {}
    for doc_id, d, k, text in zip(*(texts.column(c).to_pylist() for c in ("doc_id", *KEY)), texts.column("text").cast(pa.binary()).to_pylist()):
        lines, found = masked_lines(text), []
        for no, line in enumerate(lines):
            if line and (leaf := leaf_of(line)) in leaves:
                name = xxhash.xxh3_128_digest(b" ".join(line))
                found.append({"no": no, "leaf": leaf, "line": name})
                if name not in tokens:
                    tokens[name] = (leaf, [_hash(w) for w in line])
        rows.append(("text", doc_id, d, k, text if found else None, found or None, len(lines), None if found else _sha([text or b""]), None, None, None))
    rows += [("line", *[None] * 7, leaf, name, words) for name, (leaf, words) in tokens.items()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), _LINES, pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = ["part", "doc_id", *KEY, "text", "lines", "n_lines", "kept_sha256", "leaf", "line", "tokens"]
    columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)]
    columns[4] = columns[4].cast(pa.string())
    return pa.Table.from_arrays(columns, names=names)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose names are in `gone`."""
    for batch in batches:
        rows = []
        for lines, gone, text in zip(batch.column("lines").to_pylist(), batch.column("gone").to_pylist(), column_bytes(batch)):
            names = set(gone or ())
            out = {x["no"] for x in lines if x["line"] in names}
            kept = b"\n".join(line for no, line in enumerate(text.split(b"\n")) if no not in out)
            rows.append((len(out), _sha([kept]), kept))
        columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))] if rows else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), *columns[:2], columns[2].cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])


def _fixed(lines: DataFrame, words: DataFrame, uses: DataFrame, least_docs: int) -> DataFrame:
    """leaf, pos, token where `least_docs` documents have the token.

    Documents are added up over the lines; a document with several lines of a leaf that share the token is then taken off as often as it came too often."""
    at = ["leaf", "pos", "token"]
    often = stage(words.groupBy(*at).agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs))
    several = uses.groupBy(*KEY, "leaf").agg(F.collect_list("line").alias("line")).where(F.size("line") > 1)
    several = several.select(*KEY, "leaf", F.explode("line").alias("line")).join(lines.select("line", "tokens"), "line")
    shared = several.select(*KEY, "leaf", F.posexplode("tokens").alias("pos", "token")).groupBy(*KEY, *at).count().where("count > 1")
    less = shared.groupBy(*at).agg(F.sum(F.col("count") - 1).alias("less"))
    return often.join(less, at, "left").where(F.col("n") - F.coalesce("less", F.lit(0)) >= least_docs).select(*at)


def _dropped(lines: DataFrame, uses: DataFrame, fixed: DataFrame, words: DataFrame, least_docs: int, least_fixed: float) -> DataFrame:
    """The names of lines whose template stands in `least_docs` documents."""
    shapes = words.join(fixed, ["leaf", "pos", "token"]).groupBy("line").agg(F.bit_xor(F.xxhash64("pos", "token")).alias("shape"), F.count("*").alias("n_fixed"))
    template = ["leaf", "own", "form"]
    own = F.coalesce(F.col("n_fixed") < least_fixed * F.size("tokens"), F.lit(True))
    formed = stage(lines.join(shapes, "line", "left").select("line", "leaf", "docs", own.alias("own"), F.when(own, F.xxhash64("line")).otherwise(F.col("shape")).alias("form")))
    known = stage(formed.groupBy(*template).agg(F.max("docs").alias("least"), F.sum("docs").alias("most")).where(F.col("most") >= least_docs))
    sure = known.where(F.col("least") >= least_docs).select(*template)
    open_ = formed.join(known.where(F.col("least") < least_docs).select(*template), template).select("line", *template)
    counted = uses.select(*KEY, "line").join(open_, "line").select(*template, *KEY).distinct().groupBy(*template).count()
    common = sure.unionByName(counted.where(F.col("count") >= least_docs).select(*template))
    return formed.join(common, template).select("line")


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_fixed: float = 0.5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and kept (the text without dropped lines, null where none is) for every row of `docs`.

    Lines end at a line feed; blank lines stay. A line is dropped when its template stands in
    `least_docs` documents or more. A token is fixed where `least_docs` documents have it at that
    place in lines of the leaf; with a share of fixed tokens below `least_fixed`, a line is its own
    template. Null counts as empty. Equal rows are one document. Extra columns are ignored.
    """
    counts = stage(count_in_blocks(docs, _leaf_counts, "leaf bigint, n bigint"))
    leaves = counts.where(F.col("kind") != PRESENT).groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("leaf")
    back = counts.where(F.col("kind") != PRESENT).select("block", "kind", "leaf").join(leaves, "leaf").select("block", "kind", "leaf")
    back = back.unionByName(counts.where(F.col("kind") == PRESENT).select("block", "kind", "leaf"))
    rows = stage(beside(in_blocks(docs), back, _recurring, f"part string, {_SEEN}, leaf bigint, line binary, tokens array<bigint>"), ["part"])
    seen = rows.where("part = 'text'")
    uses = stage(seen.where("lines IS NOT NULL").select(*KEY, F.inline("lines")).select(*KEY, "leaf", "line").distinct())
    tokens = rows.where("part = 'line'").groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    lines = stage(tokens.join(uses.groupBy("line").agg(F.count("*").alias("docs")), "line"))
    words = lines.select("line", "leaf", "docs", F.posexplode("tokens").alias("pos", "token"))
    fixed = stage(_fixed(lines, words, uses, least_docs))
    dropped = stage(_dropped(lines, uses, fixed, words, least_docs, least_fixed))
    gone = stage(uses.join(dropped, "line").groupBy(*KEY).agg(F.collect_list("line").alias("gone")))
    joined = seen.where("lines IS NOT NULL").join(gone, KEY, "left").select("doc_id", "n_lines", "text", "lines", "gone")
    whole = seen.where("lines IS NULL").select("doc_id", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return whole.unionByName(joined.mapInArrow(_without, _DONE))
