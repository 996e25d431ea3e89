"""Passages of held-out items inside a training corpus, found with a generalised suffix automaton."""

from __future__ import annotations

import functools
import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import mail
from spotweave.session import checkpoint


class ItemAutomaton:
    """Generalised suffix automaton over the items' words.

    Fed with the words of a text it tracks, at each word, the longest run ending there that occurs in some item. A run of at least
    ``least`` words, or a whole shorter item, is a leak. For each state the items that share its last ``least`` words, and the short items
    that are suffixes of it, are prepared, so a leak is read off without searching.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int = 12):
        self.least = least
        self.ids = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.next, self.link, self.length, own = [{}], [-1], [0], [set()]
        ends = []
        for item, ws in items:
            state = 0
            for w in ws:
                state = self._extend(self.ids[w], state, own)
                own[state].add(item)
            ends.append((item, ws))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            if self.link[s] > 0:
                own[self.link[s]] |= own[s]
        n = len(self.next)
        self.long: list[tuple | None] = [None] * n
        self.short: list[tuple] = [()] * n
        whole: dict[int, list] = {}
        for item, ws in ends:
            if 0 < len(ws) < least:
                whole.setdefault(self._find(ws), []).append((len(ws), item))
        for s in reversed(order):
            up = self.link[s]
            self.short[s] = self.short[up] + tuple(whole.get(s, ())) if up >= 0 else ()
            if self.length[s] >= least:
                self.long[s] = self.long[up] if up > 0 and self.length[up] >= least else tuple(sorted(own[s]))
        self.shortest = min([least, *(len(ws) for _, ws in ends if ws)])

    def _find(self, ws: list[str]) -> int:
        s = 0
        for w in ws:
            s = self.next[s][self.ids[w]]
        return s

    def _extend(self, w: int, last: int, own: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            own.append(set())
            link[q] = len(nxt) - 1
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = len(nxt) - 1
                p = link[p]
            return len(nxt) - 1

        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else clone(last, q)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        new, p = len(nxt) - 1, last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def spans(self, text_words: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, words) of each longest leaked run; runs of one item that overlap come out as one."""
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in text_words), dtype=np.int64, count=len(text_words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        found: dict[int, list[list[int]]] = {}
        nxt, link, length, least = self.next, self.link, self.length, self.least
        for a, z in zip(known[::2], known[1::2]):
            if z - a < self.shortest:
                continue
            s = run = 0
            for i, w in enumerate(codes[a:z].tolist(), int(a)):
                while s and w not in nxt[s]:
                    s = link[s]
                    run = length[s]
                if w in nxt[s]:
                    s = nxt[s][w]
                    run += 1
                else:
                    s = run = 0
                hits = [(item, least) for item in self.long[s] or ()] if run >= least else []
                for size, item in self.short[s]:
                    if run >= size:
                        hits.append((item, size))
                for item, size in hits:
                    mine = found.setdefault(item, [])
                    if mine and i - size + 1 <= mine[-1][1] + 1:
                        mine[-1][1] = i
                    else:
                        mine.append([i - size + 1, i])
        return [(item, b, e - b + 1) for item, runs in found.items() for b, e in runs]


def item_blocks(items: DataFrame, id_: str, text: str, least: int, most_words: int, most_bytes: int) -> Iterator[Broadcast]:
    """Automata over the held-out items, one for each block of about ``most_words`` words, each built in a task and broadcast when it is asked for.

    Items go to blocks by hash. Only one pickled block is at the driver at a time; ValueError if it exceeds ``most_bytes``.
    """
    kind = items.schema[id_].dataType.simpleString()
    rows = items.select(F.col(id_).alias("item"), F.col(text).alias("said")).filter("item is not null and said is not null").distinct()

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(mail.words(t)) for t in b["said"]]})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "said"])
        known = [(i, ws) for i, ws in zip(pdf["item"].tolist(), map(mail.words, pdf["said"])) if ws]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "automaton": [pickle.dumps(ItemAutomaton(known, least), 5)]}) if known else pd.DataFrame(columns=["block", "automaton"])

    words = rows.select("said").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(words / most_words))
    built = rows.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.col("item").cast(kind).alias("item"), "said").groupBy("block").applyInPandas(build, "block int, automaton binary")
    if blocks > 1:
        built = checkpoint(built)
    for r in built.select("automaton").toLocalIterator():
        if len(r[0]) > most_bytes:
            raise ValueError(f"a block of held-out items takes {len(r[0])} bytes; lower most_words")
        yield items.sparkSession.sparkContext.broadcast(bytes(r[0]))


@functools.lru_cache(maxsize=1)
def _loaded(raw: bytes) -> ItemAutomaton:
    return pickle.loads(raw)


def _mail_parts(batch: pd.DataFrame) -> Iterator[tuple]:
    """(doc, part_no, text) of every part of the messages of a batch."""
    for doc, said in zip(batch["doc"], batch["text"]):
        for no, part in enumerate(mail.parts(said)):
            yield doc, no, part


def _hits(automaton: ItemAutomaton, doc, no: int, part: str) -> list[tuple]:
    """(doc, part_no, part_words, item, first_word, n_words, start, end) of each leaked run of a part."""
    ws = mail.words(part)
    found = automaton.spans(ws)
    if not found:
        return []
    at = mail.word_spans(part)
    return [(doc, no, len(ws), item, first, n, at[first][0], at[first + n - 1][1]) for item, first, n in found]


HIT = ["doc", "part_no", "part_words", "item", "first_word", "n_words", "start", "end"]


def leaked_spans(docs: DataFrame, id_: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, most_words: int = 500_000, most_bytes: int = 2**30, part_no: str | None = None) -> DataFrame:
    """(id_, part_no, part_words, item_id, first_word, n_words, start, end): every leaked run in every document.

    Each message is read part by part (subject, bodies, attached texts), whole; parts are matched where the scan reads them, so nothing is
    shuffled and nothing about documents reaches the driver. Part 0 is the first text; ``start`` and ``end`` are characters of the part as it is read. Held-out items of more than
    ``most_words`` words come in blocks, one after the other: the messages are read once, their parts are written to the checkpoint folder, and each block is matched with these.
    Null or empty texts and items without words match nothing; an item listed twice is one item; repeated documents come out each.
    With ``part_no`` (an int column) the rows of ``docs`` are parts that have been read already.
    """
    d, i = docs.schema[id_].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc {d}, part_no int, part_words int, item {i}, first_word int, n_words int, start int, end int"
    mails = part_no is None
    rows = docs.select(F.col(id_).alias("doc"), *([] if mails else [F.col(part_no).cast("int").alias("part_no")]), F.col(text).alias("text")).filter("text is not null")

    def read_parts(batches):
        for b in batches:
            yield pd.DataFrame(list(_mail_parts(b)), columns=["doc", "part_no", "text"])

    def matched(source: DataFrame, shared: Broadcast, whole: bool) -> DataFrame:
        def match(batches):
            automaton = _loaded(shared.value)
            for b in batches:
                of = _mail_parts(b) if whole else zip(b["doc"], b["part_no"], b["text"])
                yield pd.DataFrame([hit for part in of for hit in _hits(automaton, *part)], columns=HIT)

        return source.mapInPandas(match, schema)

    blocks = item_blocks(items, item_id, item_text, least, most_words, most_bytes)
    one, out = next(blocks, None), None
    following = next(blocks, None)
    if one is None:
        out = docs.sparkSession.createDataFrame([], schema)
    elif following is None:
        out = matched(rows, one, mails)
    else:
        read = checkpoint(rows.mapInPandas(read_parts, f"doc {d}, part_no int, text string") if mails else rows)
        for block in itertools.chain((one, following), blocks):
            found = checkpoint(matched(read, block, False))
            block.unpersist()
            out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"doc": id_, "item": item_id})


def without_leaks(docs: DataFrame, id_: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, coverage: float = 0.5, most_words: int = 500_000, most_bytes: int = 2**30, mark: str = " ") -> DataFrame:
    """(id_, part_no, n_words, n_leaked, decision, removed, text): every part of every document as it is read, its leaked runs cut out.

    A run is cut if it has ``least`` words of an item, or all of a shorter one; a part whose leaked words are at least ``coverage`` of its words is emptied.
    ``decision`` is ``keep``, ``cut`` or ``drop``; ``removed`` lists the (start, end) characters that are gone, joined where they touch; ``mark`` is put in their place. Words on both sides
    of a cut become neighbours and may then continue a run, unless ``mark`` holds a word that no item has.
    Null texts have no part. Ids are unique.
    """
    d = docs.schema[id_].dataType.simpleString()
    rows = docs.select(F.col(id_).alias("doc"), F.col(text).alias("text")).filter("text is not null")
    schema = f"doc {d}, part_no int, n_words int, n_leaked int, decision string, removed array<struct<start int, end int>>, text string"

    def cleaned(doc, no: int, part: str, hits: list[tuple]) -> tuple:
        n = hits[0][2] if hits else len(mail.words(part))
        gone = len({w for h in hits for w in range(h[4], h[4] + h[5])})
        if not hits:
            return doc, no, n, 0, "keep", [], part
        if gone >= coverage * n:
            return doc, no, n, gone, "drop", [{"start": 0, "end": len(part)}], ""
        cuts = []
        for start, end in sorted((h[6], h[7]) for h in hits):
            if cuts and start <= cuts[-1][1]:
                cuts[-1][1] = max(cuts[-1][1], end)
            else:
                cuts.append([start, end])
        edges = [0, *(x for cut in cuts for x in cut), len(part)]
        return doc, no, n, gone, "cut", [{"start": a, "end": z} for a, z in cuts], mark.join(part[a:z] for a, z in zip(edges[::2], edges[1::2]))

    columns = ["doc", "part_no", "n_words", "n_leaked", "decision", "removed", "text"]
    blocks = item_blocks(items, item_id, item_text, least, most_words, most_bytes)
    one = next(blocks, None)
    if next(blocks, None) is None:

        def clean(batches):
            automaton = _loaded(one.value) if one else None
            for b in batches:
                yield pd.DataFrame([cleaned(*part, _hits(automaton, *part) if automaton else []) for part in _mail_parts(b)], columns=columns)

        return rows.mapInPandas(clean, schema).withColumnRenamed("doc", id_)

    spans = leaked_spans(docs, id_, text, items, item_id, item_text, least, most_words, most_bytes)
    spans = spans.groupBy(F.col(id_).alias("doc")).agg(F.collect_list(F.struct("part_no", "part_words", "first_word", "n_words", "start", "end")).alias("hits"))

    def apply(batches):
        for b in batches:
            out = []
            for doc, said, hits in zip(b["doc"], b["text"], b["hits"]):
                mine: dict[int, list[tuple]] = {}
                for h in hits if hits is not None else ():
                    mine.setdefault(h["part_no"], []).append((doc, h["part_no"], h["part_words"], None, h["first_word"], h["n_words"], h["start"], h["end"]))
                out += [cleaned(*part, mine.get(part[1], [])) for part in _mail_parts(pd.DataFrame({"doc": [doc], "text": [said]}))]
            yield pd.DataFrame(out, columns=columns)

    both = rows.join(spans.withColumnRenamed("doc", "of"), F.col("doc").eqNullSafe(F.col("of")), "left").drop("of")
    return both.mapInPandas(apply, schema).withColumnRenamed("doc", id_)
