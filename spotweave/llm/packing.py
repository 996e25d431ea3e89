"""Containers of fixed capacity, filled by bounded-space online best fit."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.session import checkpoint


class Bins:
    """At most ``limit`` open bins. A bitset has bit f set while some open bin has f units free."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: dict[int, list[int]] = {}
        self.bits = self.open = self.made = 0
        self.closed: list[tuple[int, int]] = []

    def _put(self, bin_: int, space: int) -> None:
        if not space:
            self.closed.append((bin_, 0))
            return
        self.free.setdefault(space, []).append(bin_)
        self.bits |= 1 << space
        self.open += 1

    def _take(self, space: int) -> int:
        bins = self.free[space]
        bin_ = bins.pop()
        if not bins:
            del self.free[space]
            self.bits ^= 1 << space
        self.open -= 1
        return bin_

    def add(self, size: int) -> int:
        """The bin an item of ``size`` goes to: the open one it leaves least space in, else a new one."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.closed.append((self._take(fullest), fullest))
            bin_, space = self.made, self.capacity
            self.made += 1
        self._put(bin_, space - size)
        return bin_

    def still_open(self) -> list[int]:
        return [b for bins in self.free.values() for b in bins]


def _stream(items: DataFrame, streams: int, capacity: int, limit: int) -> DataFrame:
    """(key, size, stream, bin, last): each stream packed in hash order, in constant memory; rows marked ``last`` name the bins still open.

    A partition may hold several streams; they come one after the other.
    """
    kind = items.schema["key"].dataType.simpleString()

    def pack(batches):
        bins, place = Bins(capacity, limit), None

        def left() -> pd.DataFrame:
            open_ = bins.still_open()
            return pd.DataFrame({"key": [None] * len(open_), "size": 0, "stream": place, "bin": open_, "last": True}).astype({"bin": "int64"})

        for batch in batches:
            for stream, b in batch.groupby("stream", sort=False):
                if stream != place:
                    if place is not None:
                        yield left()
                    bins, place = Bins(capacity, limit), int(stream)
                yield pd.DataFrame({"key": b["key"], "size": b["size"], "stream": b["stream"], "bin": [bins.add(int(s)) for s in b["size"]], "last": False})
        if place is not None:
            yield left()

    order = F.xxhash64("key")
    salted = items.withColumn("o", order).withColumn("stream", F.pmod("o", F.lit(streams)).cast("int"))
    out = salted.repartitionByRange(streams, "stream").sortWithinPartitions("stream", "o", "key", "size").select("key", "size", "stream")
    return out.mapInPandas(pack, f"key {kind}, size long, stream int, bin long, last boolean")


def pack(items: DataFrame, id_: str, size: str, capacity: int = 4096, limit: int = 256, per_stream: int = 20_000) -> DataFrame:
    """(id_, piece_no, start_token, n_tokens, container_id): the container of each text.

    A text longer than ``capacity`` is cut into full pieces, each a container of its own, and a rest; no other text is split. Texts and
    rests are spread by hash over streams of about ``per_stream`` items, and each stream is packed online with ``limit`` open bins. Bins still
    open at a stream's end are packed once more, as blocks, by streams of the same width. A stream needs memory for its open bins only, so a
    partition may have any size. Null sizes are left out; a text without tokens takes a place in some container; repeated rows take space
    each; the same input always gives the same containers.
    """
    t = items.select(F.col(id_).alias("id"), F.col(size).cast("long").alias("n")).filter("n is not null and n >= 0")
    t = checkpoint(t)  # sizes cost a pass of the tokenizer; what follows reads them several times
    full = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(F.lit(0)).cast("long")
    cut = t.withColumn("full", full)
    whole = cut.filter("full > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no"))
    whole = whole.select("id", "piece_no", ((F.col("piece_no") - 1) * capacity).alias("start_token"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("full"), F.col("id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"))
    rest = cut.select("id", (F.col("full") + 1).alias("piece_no"), (F.col("full") * capacity).alias("start_token"), (F.col("n") - F.col("full") * capacity).alias("size")).filter("size > 0 or start_token = 0")
    rest = rest.select(F.struct("id", "piece_no", "start_token").alias("key"), "size")
    streams = max(1, math.ceil(t.count() / per_stream))
    first = checkpoint(_stream(rest, streams, capacity, limit))
    placed = first.filter("not last").withColumn("part", F.col("stream"))
    open_ = first.filter("last").select("stream", "bin")
    fill = placed.join(open_, ["stream", "bin"]).groupBy("stream", "bin").agg(F.sum("size").alias("size"))
    again = _stream(fill.select(F.struct("stream", "bin").alias("key"), "size"), max(1, math.ceil(streams * limit / per_stream)), capacity, limit)
    moved = again.filter("not last").select(F.col("key.stream").alias("stream"), F.col("key.bin").alias("bin"), F.concat_ws("-", F.lit("tail"), F.col("stream").cast("string"), F.col("bin").cast("string")).alias("tail"))
    done = placed.join(moved, ["stream", "bin"], "left")
    ident = F.coalesce("tail", F.concat_ws("-", F.lit("bin"), F.col("stream").cast("string"), F.col("bin").cast("string")))
    done = done.select("key.id", "key.piece_no", "key.start_token", F.col("size").alias("n_tokens"), ident.alias("container_id"))
    return whole.unionByName(done).withColumnRenamed("id", id_)
