"""Mixing sources to target weights (problem 7).

The texts of a source form a stream, repeated as often as its share needs and its cap allows, and cut into blocks of equal size in tokens, the last one as long as the rest. The k-th
block of a source of weight w is released at slot k / w and due before slot (k + 1) / w (Pfair); earliest deadline first gives each slot to one block, so that at every slot
no source is a block or more away from its target weight. Where all weights are multiples of 1 / n the schedule begins anew after n slots, so only one such period is computed, however many
blocks there are; the slot of any block follows by arithmetic. The driver holds the period and one row for each source.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut

TOKENIZERS = "/opt/tokenizers"
#: How a vocabulary of byte-level BPE splits text before merging; a fixed value, published with the vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Weights are multiples of one part in so many, unless the targets have fewer decimals: the longest period of a schedule.
FINEST = 100_000
_encoders: dict[bytes, object] = {}


def encoder(vocabulary: bytes):
    """The public byte-level BPE whose .tiktoken file has this content, kept for the process."""
    name = hashlib.sha256(vocabulary).digest()
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        _encoders[name] = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def source_key(c: str):
    """Sources however they are spelt: letter case, blanks and hyphens don't count."""
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s_-]+", "_")


def count_tokens(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, tokens) of each document; null and empty texts have 0 tokens. The vocabulary, a file of a few MB on the driver, is sent with the job."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(sent.value)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n})

    texts = docs.where("doc_id is not null").select("doc_id", source_key("source").alias("source"), "text")
    return texts.mapInPandas(run, "doc_id bigint, source string, tokens bigint")


def edf_schedule(weights: list[Fraction], blocks: list[int]) -> list[tuple[int, int, int]]:
    """(slot, source, block): one block a slot, the released one that is due first (ties: the one released first, then the lower source).

    weights sum to 1; a source has blocks[s] blocks, about weights[s] of all. A slot in which nothing is released (only at the end, when
    a source is used up) goes to the block that is released next.
    """
    waiting = [(math.floor(Fraction(0)), math.ceil(1 / w), s, 0) for s, w in enumerate(weights) if w > 0 and blocks[s] > 0]
    heapq.heapify(waiting)  # by release
    ready: list[tuple[int, int, int, int]] = []  # by deadline
    out, slot = [], 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot or waiting and not ready:
            release, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, release, s, k))
        due, release, s, k = heapq.heappop(ready)
        out.append((slot, s, k))
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor((k + 1) / weights[s]), math.ceil((k + 2) / weights[s]), s, k + 1))
    return out


def plan_mix(have: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[dict]:
    """What each target source contributes. Sources without tokens contribute nothing and their weight goes to the others in proportion. Without `total` the mix is as
    large as it can be with every share met: the least of available tokens times repeats over weight. With `total`, what a source's cap keeps it from giving is handed on to
    the others in the same way, as far as they can give it. `parts` of a source are its blocks in each period of the schedule."""
    rows = [{"source": s, "target_share": float(w or 0), "max_repeats": max(0, int(r if r is not None else 1)), "available": int(have.get(s, 0)), "need": 0, "parts": 0} for s, w, r in targets]
    live = [r for r in rows if r["available"] * r["max_repeats"] > 0 and r["target_share"] > 0]
    share = {r["source"]: Fraction(str(r["target_share"])) for r in live}
    whole = sum(share.values())
    most = min((r["available"] * r["max_repeats"] * whole / share[r["source"]] for r in live), default=0)
    left, open_ = int(most if total is None else total), list(live)
    while open_:
        whole = sum(share[r["source"]] for r in open_)
        full = [r for r in open_ if left * share[r["source"]] / whole > r["available"] * r["max_repeats"]]
        if not full:
            for r in open_:
                r["need"] = round(left * share[r["source"]] / whole)
            break
        for r in full:
            r["need"] = r["available"] * r["max_repeats"]
            left -= r["need"]
        open_ = [r for r in open_ if r not in full]
    # Weights: the targets themselves where all sources can meet them, else what is given.
    weight = share if len(open_) == len(live) else {r["source"]: Fraction(r["need"]) for r in live}
    whole = sum(weight.values())
    if whole:
        exact = [weight[r["source"]] / whole for r in live]
        n = math.lcm(*(x.denominator for x in exact))
        for r, x in zip(live, exact):
            r["parts"] = int(x * n) if n <= FINEST else max(1, round(x * FINEST)) if r["need"] else 0
        common = math.gcd(*(r["parts"] for r in live))
        for r in live:
            r["parts"] //= common
    return rows


class Mix:
    """uses, shares and schedule, see mix_sources; block: tokens of a block; period: slots after which the schedule begins anew; plan: one dict for each target."""

    def __init__(self, uses: DataFrame, shares: DataFrame, schedule: DataFrame, block: int, period: int, plan: list[dict]):
        self.uses, self.shares, self.schedule, self.block, self.period, self.plan = uses, shares, schedule, block, period, plan


def _of_source(values: dict[str, int]) -> Column:
    out = F.lit(0).cast("bigint")
    for s, v in values.items():
        out = F.when(F.col("source") == s, F.lit(v).cast("bigint")).otherwise(out)
    return out


def mix_sources(docs: DataFrame, targets: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", total: int | None = None, block_tokens: int = 16_384, buckets: int = 256) -> Mix:
    """The mix of `docs` (doc_id, source, text) to the shares of `targets` (source, target_share, max_repeats), in tokens.

    uses: (doc_id, source, tokens, uses, position), every document with the number of its uses (0 for blank texts and sources without a target), and where it
    stands in a round through its source, by a hash of its id: a use is in the mix if it begins in a scheduled block, of which the last has as many tokens as are left. shares: one row
    for each target. schedule: (slot, source, block) of one period. Positions are summed by buckets of the hash, so that a source that holds
    a third of all rows isn't summed in one task. Repeated rows of a document count once.
    """
    spark = docs.sparkSession
    counted = cut(count_tokens(docs.select("doc_id", "source", "text"), vocabulary).groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens"))
    wanted = [(r.s, r.target_share, r.max_repeats) for r in targets.where("source is not null").select(source_key("source").alias("s"), "target_share", "max_repeats").dropDuplicates(["s"]).orderBy("s").collect()]
    names = [s for s, _, _ in wanted]
    inside = counted.where(F.col("source").isin(names) & (F.col("tokens") > 0))
    have = {r.source: r.t for r in inside.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    plan = plan_mix(have, wanted, total)
    order = F.xxhash64(F.lit("mix"), "doc_id")
    placed = inside.withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - (buckets - 1).bit_length()).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # One offset for each target source and bucket, so no more rows than the plan in the driver times `buckets`.
    positioned = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(F.broadcast(offsets), ["source", "bucket"]).withColumn("position", F.col("base") + F.col("inner"))
    blocks = {r["source"]: -(-r["need"] // block_tokens) for r in plan}
    last = {r["source"]: r["need"] - (blocks[r["source"]] - 1) * block_tokens for r in plan}
    rounds = {r["source"]: r["need"] // max(1, r["available"]) for r in plan}
    at = _of_source(rounds) * _of_source({r["source"]: r["available"] for r in plan}) + F.col("position")
    block, place = F.floor(at / block_tokens), at % block_tokens
    scheduled = (block < _of_source(blocks) - 1) | ((block == _of_source(blocks) - 1) & (place < _of_source(last)))
    used = positioned.select("doc_id", "source", "tokens", (_of_source(rounds) + scheduled.cast("int")).cast("int").alias("uses"), "position")
    outside = counted.where(~(F.coalesce(F.col("source").isin(names), F.lit(False)) & (F.col("tokens") > 0))).select("doc_id", "source", "tokens", F.lit(0).alias("uses"), F.lit(None).cast("bigint").alias("position"))
    uses = cut(used.unionByName(outside))
    reached = {r.source: r.t for r in uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).where(F.col("source").isin(names)).collect()}
    all_tokens = sum(reached.values())
    rows = [(r["source"], r["target_share"], r["max_repeats"], r["available"], int(reached.get(r["source"], 0)), reached.get(r["source"], 0) / all_tokens if all_tokens else 0.0) for r in plan]
    shares = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens_available bigint, tokens_used bigint, share_reached double")
    parts = [r["parts"] for r in plan]
    period = sum(parts)
    slots = [(slot, plan[s]["source"], k) for slot, s, k in edf_schedule([Fraction(b, max(1, period)) for b in parts], parts)]
    return Mix(uses, shares, spark.createDataFrame(slots, "slot int, source string, block int"), block_tokens, period, plan)


def interleaved(mix: Mix) -> DataFrame:
    """(slot, place, doc_id, source, tokens): every use of every document at its slot; sort by slot and place to read the mix in order. Slots of a source that is
    used up, in the last period, stay empty."""
    each = mix.uses.where("uses > 0").select("doc_id", "source", "tokens", "position", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("turn"))
    at = F.col("turn") * _of_source({r["source"]: r["available"] for r in mix.plan}) + F.col("position")
    parts = F.greatest(_of_source({r["source"]: r["parts"] for r in mix.plan}), F.lit(1))
    start = each.withColumn("at", at).withColumn("nth", F.floor(F.col("at") / mix.block)).withColumn("block", (F.col("nth") % parts).cast("int"))
    # A period has at most FINEST slots and one for each source.
    return (
        start.join(F.broadcast(mix.schedule), ["source", "block"])
        .select((F.floor(F.col("nth") / parts) * mix.period + F.col("slot")).alias("slot"), (F.col("at") - F.col("nth") * F.lit(mix.block)).alias("place"), "doc_id", "source", "tokens")
    )
