"""Main text of web pages by union-free wrappers.

A page becomes the stream of its text blocks, each known by the path of its block elements. Streams
of one host are aligned one after another: what both have stays, what repeats in place becomes a
repeated group, what only one has becomes optional, and text is a slot. The wrapper that results has
no alternatives, only sequences, options, repeats and slots. What a slot holds over all pages of the
host, and where it stands, decides whether its text is the article's.

Streams are collapsed and counted per host before anything is aligned, so pages built alike are
aligned once, and a host of any size is folded in pieces.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datarights.llm.common import slices
from datarights.session import stage_unsized as stage

# HTML elements by what they do to text, and names that mark what is not the article.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = "script style noscript iframe textarea title".split()  # what follows is text up to the end tag, or to the end of the page
SKIPPED = "template svg math object audio video canvas select button".split()
ASIDE = set("nav footer aside form menu dialog search head".split())
NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split())
ABOUT = set("with without has no free layout columns".split())  # a class that says what its element stands beside
ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
CLOSES_P = BLOCKS - {"html", "body"}
AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_SKIPPED = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?![a-zA-Z0-9:-])[^>]*(?<!/)>.*?(?:</\1\b[^>]*>|\Z)|<(/?)({'|'.join(SKIPPED)})(?![a-zA-Z0-9:-])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
OFF, MAIN = "!", "*"


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _mark(tag: str, attributes: str, path: list[tuple[str, str]]) -> str:
    """OFF for what is not the article, MAIN for what holds it, nothing otherwise."""
    if tag in ASIDE:
        return OFF
    inside = any(MAIN in m for _, m in path)
    if tag == "header" and not inside:
        return OFF
    mark = MAIN if tag in ("article", "main") else ""
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "role":
            mark = MAIN if value.lower() in ("main", "article") else OFF if value.lower() in ROLES else mark
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OFF
        elif name in ("class", "id") and tag not in ("body", "html"):
            for name in value.split():
                words = {w.lower() for w in _PART.findall(name)}
                if not words & ABOUT and (words & NAMES or not inside and tag not in ("article", "main") and words & {"header"}):
                    return OFF
    return mark


def _ends(source: str) -> dict[int, int]:
    """Where each skipped element ends, by where it begins; unclosed ones are left out."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    for token in _SKIPPED.finditer(source):
        if token[3] is None:
            continue
        begun = open_[token[3].lower()]
        if not token[2]:
            if not token[4].endswith("/"):
                begun.append(token.start())
        elif begun:
            ends[begun.pop()] = token.end()
    return ends


def blocks_of(text: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of every text block in page order."""
    source, at, out = text or "", 0, []
    path: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked, in_link = 0, False
    ends: dict[int, int] | None = None

    def flush():
        nonlocal pieces, linked
        line = " ".join("".join(pieces).split())
        if line:
            out.append(("/".join(t + m for t, m in path), line, min(linked, len(line))))
        pieces, linked = [], 0

    while at < len(source):
        token = _TOKEN.match(source, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            if token[0][0] != "<" or token[0] == "<":
                piece = html.unescape(token[0])
                pieces.append(piece)
                linked += len(piece) * in_link
            continue
        tag = tag.lower()
        if tag in _RAW_END:
            if not token[1] and not token[3].endswith("/"):
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
        elif tag in SKIPPED:
            if not token[1] and not token[3].endswith("/"):
                ends = _ends(source) if ends is None else ends
                at = ends.get(token.start(), at)
        elif tag == "a":
            in_link = not token[1]
        elif tag == "br":
            pieces.append(" ")
        elif tag == "hr" or tag in BLOCKS or tag == "head":
            flush()
            if token[1]:
                if any(t == tag for t, _ in path):
                    while path.pop()[0] != tag:
                        pass
            elif tag not in VOID:
                if tag == "body" and path and path[-1][0] == "head":
                    path.pop()
                if tag in CLOSES_P and path and path[-1][0] == "p":
                    path.pop()
                if tag in AGAIN and path and path[-1][0] in AGAIN[tag]:
                    path.pop()
                    if tag == "tr" and path and path[-1][0] == "tr":
                        path.pop()
                path.append((tag, _mark(tag, token[3], path)))
    flush()
    return out


def collapse(paths: list[str], longest: int = 6) -> tuple[list, list[int]]:
    """The stream with runs folded into repeated groups, and the slot of each block.

    A stream is a list of [repeated, [paths]]; slots number the paths of all groups in order."""
    out, slots, at, slot = [], [], 0, 0
    while at < len(paths):
        size, times = 1, 1
        for n in range(1, longest + 1):
            body, reps = paths[at: at + n], 1
            while paths[at + reps * n: at + (reps + 1) * n] == body:
                reps += 1
            if reps > 1 and reps * n > size * times:
                size, times = n, reps
            if n == 1 and reps > 1:
                break
        body = paths[at: at + size]
        if out and out[-1][1] == body:  # goes on after a longer group
            out[-1][0] = True
            slots += [slot - size + i for _ in range(times) for i in range(size)]
        else:
            out.append([times > 1, body])
            slots += [slot + i for _ in range(times) for i in range(size)]
            slot += size
        at += size * times
    return out, slots


def align(wrapper: list, stream: list) -> tuple[list, list[int], list[int]]:
    """One wrapper for both and, for the groups of either, the group of it that takes them.

    Groups are [repeated, paths, optional]. Equal bodies meet; a group meets its own body spelt out;
    anything else becomes optional."""
    stream = [[*g[:2], g[2] if len(g) > 2 else False] for g in stream]
    merged, to_a, to_b = [], [0] * len(wrapper), [0] * len(stream)
    keys_a, keys_b = (["\n".join(g[1]) for g in x] for x in (wrapper, stream))
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if kind == "equal":
            for i, j in zip(range(a0, a1), range(b0, b1)):
                to_a[i] = to_b[j] = len(merged)
                merged.append([wrapper[i][0] or stream[j][0], wrapper[i][1], wrapper[i][2] or stream[j][2]])
            continue
        for side, first, last, to in ((wrapper, a0, a1, to_a), (stream, b0, b1, to_b)):
            for i in range(first, last):
                to[i] = len(merged)
                merged.append([side[i][0], side[i][1], True])
    return merged, to_a, to_b


def _slots_of(stream: list, to: list[int], merged: list) -> list[int]:
    """The merged wrapper's slot for every slot of a stream."""
    first, n = [], 0
    for g in merged:
        first.append(n)
        n += len(g[1])
    return [first[t] + i for g, t in zip(stream, to) for i in range(len(g[1]))]


def fold(streams: list[list]) -> list:
    """The wrapper of several streams, the plainest first."""
    wrapper: list = []
    for k, stream in enumerate(sorted(streams, key=lambda s: (len(s), json.dumps(s)))):
        wrapper = [[*g[:2], g[2] if len(g) > 2 else False] for g in stream] if not k else align(wrapper, stream)[0]
    return wrapper


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host, stream (JSON), blocks of (slot, text, linked)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("linked", pa.int64())]))
        for batch in slices(batches, "html"):
            hosts, streams, blocks = [], [], []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                found = blocks_of(source)
                stream, slots = collapse([p for p, _, _ in found])
                hosts.append(host_of(url))
                streams.append(json.dumps(stream))
                blocks.append([{"slot": s, "text": t, "linked": n} for s, (_, t, n) in zip(slots, found)])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(hosts), pa.array(streams), pa.array(blocks, kind)], names=["page_id", "url", "host", "stream", "blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(parse, "page_id bigint, url string, host string, stream string, blocks array<struct<slot:int,text:string,linked:bigint>>")


def infer_wrappers(streams: DataFrame, pieces: int = 64) -> DataFrame:
    """host, wrapper (JSON) from the distinct streams (host, stream) of every host, folded in pieces and then together."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "stream": [json.dumps(fold([json.loads(s) for s in frame["stream"]]))]})

    part = F.pmod(F.xxhash64("stream"), F.lit(pieces))
    some = streams.withColumn("part", part).groupBy("host", "part").applyInPandas(join, "host string, stream string")
    return some.groupBy("host").applyInPandas(join, "host string, stream string").withColumnRenamed("stream", "wrapper")


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (host, stream, slot, wslot, path): where each slot of a stream stands in the host's wrapper."""
    for frame in batches:
        rows = []
        for host, stream, wrapper in frame[["host", "stream", "wrapper"]].itertuples(index=False):
            groups = json.loads(stream)
            merged, _, to = align(json.loads(wrapper), groups)
            paths = [p for g in groups for p in g[1]]
            rows += [(host, stream, i, w, p) for i, (w, p) in enumerate(zip(_slots_of(groups, to, merged), paths))]
        yield pd.DataFrame(rows, columns=["host", "stream", "slot", "wslot", "path"])


def extract_main_text(pages: DataFrame, least_pages: int = 3, linked_share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`.

    A slot in a menu, footer, aside, form, advert, notice or comment, by element, role or name, is
    never the article's. Inside `article` or `main` all others are. A page without these takes the
    slots that are not mostly links (`linked_share`) and do not say the same on all of `least_pages`
    or more pages of the host, unless all its pages are copies. A null or empty page gives the empty text. A url without a host
    counts as a host of its own name. Repeated rows are extracted each. Extra columns are ignored.
    """
    parsed = stage(page_blocks(pages))
    streams = stage(parsed.groupBy("host", "stream").count().where("stream <> '[]'"))
    wrappers = infer_wrappers(streams.select("host", "stream"))
    placed = stage(streams.join(wrappers, "host").mapInPandas(_place, "host string, stream string, slot int, wslot int, path string"))
    block = parsed.select("host", "stream", F.explode("blocks").alias("b")).select("host", "stream", "b.*")
    said = block.groupBy("host", "stream", "slot").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("linked").alias("linked"),
                                                       F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    off, main = F.col("path").contains(OFF), F.col("path").contains(MAIN)
    slots = placed.join(said, ["host", "stream", "slot"]).groupBy("host", "wslot").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    slots = slots.withColumn("varies", F.bool_or(F.col("lo") != F.col("hi")).over(Window.partitionBy("host")))  # one row per slot of a wrapper
    same = F.col("varies") & (F.col("lo") == F.col("hi")) & (F.col("n") >= least_pages)
    plain = (F.col("linked") < linked_share * F.col("chars")) & ~same
    has_main = placed.groupBy("host", "stream").agg(F.bool_or(main & ~off).alias("has_main"))
    judged = placed.join(slots, ["host", "wslot"]).join(has_main, ["host", "stream"]).where(~off & F.when(F.col("has_main"), main).otherwise(plain))
    chosen = stage(judged.groupBy("host", "stream").agg(F.array_sort(F.collect_set("slot")).alias("slots")))
    kept = F.filter("blocks", lambda b: F.array_contains("slots", b["slot"]))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"), F.lit(""))
    joined = parsed.join(chosen, ["host", "stream"], "left").select("page_id", "url", text.alias("text"))
    return joined.withColumn("n_chars", F.length("text").cast("bigint"))
