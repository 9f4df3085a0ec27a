"""Problem 9: mix sources to target shares of tokens by cube-method balanced sampling.

Each source's token budget gives its records an expected number of copies, at most ``max_repeats``: a whole part that
every record gets, and a fraction that is an inclusion probability. Within a source the fractions are resolved by the
cube method: probabilities move along null-space directions of the constraints (token total and record total) until
all but two records are decided. The largest records are decided first, each against all lighter ones at once; where it
outweighs what these can give, the record total is given up for it and the token total kept. So the last to be decided
are small. Records fly in blocks of bounded size; what a block leaves undecided flies again with other blocks' rest, until
one landing problem of two records a source remains. The landing goes on as the flight does without the constraints, so
that every record keeps its inclusion probability; a source's tokens miss their budget by less than its two last records.

The total is the largest at which every source with records reaches its share, or ``total_tokens`` where given (then a
source's copies are capped and the shares reached fall short). Shares of targets without records are spread over the
others in proportion, and reported.

Defined cases: sources are compared without case and outer blanks; records of null, blank or untargeted sources, and
records of no tokens (null or empty texts), are never used; an empty table, or targets without any record, give no
rows; two targets of one name count as one with the summed share and the lower cap. Randomness comes from hashes of
the ids and a seed, so that a lost task gives the same rows again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents
from .encode import TOKENIZER, count_tokens

#: Records of a block of the flight.
BLOCK = 4096
SEED = 20


def source_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


#: Records of a block that are decided against all others at once; of a larger block one in ``ONE_IN``.
AT_ONCE = 512
ONE_IN = 8
_EPS = 1e-9


def _fraction(p: np.ndarray) -> np.ndarray:
    return (p > _EPS) & (p < 1 - _EPS)


def _room(p: np.ndarray, d: np.ndarray) -> tuple[float, float]:
    """How far probabilities may move along ``d``, and against it."""
    with np.errstate(divide="ignore"):
        size = np.abs(d)
        up = np.where(d > 0, 1 - p, p) / size
        down = np.where(d > 0, p, 1 - p) / size
    return float(up.min()), float(down.min())


def _large_first(t: np.ndarray, p: np.ndarray, live: np.ndarray, count: int, rng: np.random.Generator) -> None:
    """Decides the first ``count`` of ``live`` (by falling tokens) one after the other, against all after it: along a
    direction that keeps both totals if that decides the record whichever way it goes, else one that keeps the tokens."""
    for k in range(count):
        i = live[k]
        rest = live[k + 1 :]
        while _EPS < p[i] < 1 - _EPS:
            rest = rest[_fraction(p[rest])]
            if not len(rest):
                return
            tr, pr = t[rest], p[rest]
            g = pr * (1 - pr)
            s0, s1, s2 = g.sum(), g @ tr, g @ (tr * tr)
            det = s0 * s2 - s1 * s1
            d = None
            if det > 1e-9 * s0 * s2:
                d = -g * ((s2 - s1 * t[i]) / det + (s0 * t[i] - s1) / det * tr)
                up, down = _room(pr, d)
                if up < 1 - p[i] or down < p[i]:
                    d = None
            if d is None:
                d = -g * (t[i] / s1)
                up, down = _room(pr, d)
            up, down = min(up, 1 - p[i]), min(down, p[i])
            step = up if rng.random() < down / (up + down) else -down
            p[i] += step
            moved = np.clip(pr + step * d, 0.0, 1.0)
            moved = np.where(_fraction(moved), moved, np.round(moved))
            p[rest] = moved
            if not _EPS < p[i] < 1 - _EPS:
                p[i] = round(p[i])
            elif _fraction(moved).all():  # rounding kept all off their bounds: settle the nearest
                x = rest[int(np.argmin(np.minimum(moved, 1 - moved)))]
                p[x] = round(p[x])


def flight(tokens: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: at most two are still fractions; the sum of ``p * tokens`` is that at the start, that
    of ``p`` too but for records that outweigh others (up to rounding)."""
    t, p = tokens.astype(float), p.astype(float).copy()
    p = np.where(_fraction(p), p, np.round(p))
    order = np.argsort(-t, kind="stable")
    live = order[_fraction(p[order])]
    _large_first(t, p, live, len(live) if len(live) <= AT_ONCE else len(live) // ONE_IN, rng)
    live = live[_fraction(p[live])]
    return _threes(t, p, live.tolist(), rng) if len(live) > 2 else p


def _threes(tokens: np.ndarray, p: np.ndarray, live: list[int], rng: np.random.Generator) -> np.ndarray:
    """The flight of many records of like size: three at a time, which keeps both totals."""
    p, t = p.tolist(), tokens.tolist()
    draws = iter(rng.random(len(live) + 8).tolist())
    hold: list[int] = []
    waiting = iter(live)
    while True:
        while len(hold) < 3 and (x := next(waiting, None)) is not None:
            hold.append(x)
        if len(hold) < 3:
            return np.array(p)
        i, j, k = hold
        u = (t[k] - t[j], t[i] - t[k], t[j] - t[i])  # orthogonal to (1, 1, 1) and to the tokens
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, v in zip(hold, u):
            if v > 0:
                up, down = min(up, (1 - p[x]) / v), min(down, p[x] / v)
            elif v < 0:
                up, down = min(up, p[x] / -v), min(down, (1 - p[x]) / -v)
        step = up if next(draws, 0.5) < down / (up + down) else -down
        for x, v in zip(hold, u):
            p[x] = min(1.0, max(0.0, p[x] + step * v))
        kept = []
        for x in hold:
            if p[x] <= _EPS or p[x] >= 1 - _EPS:
                p[x] = float(round(p[x]))
            else:
                kept.append(x)
        if len(kept) == 3:  # rounding kept all three off their bounds: settle the nearest
            x = min(kept, key=lambda y: min(p[y], 1 - p[y]))
            p[x] = float(round(p[x]))
            kept.remove(x)
        hold = kept


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The landing: the two fractions that the flight may leave are decided without its constraints, the token total given
    up first. Two move against each other, which keeps the number of records, until one is decided; a last one is
    decided by chance. Each keeps its probability."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1)).tolist()
    while len(left) > 1:
        i, j = left[-2:]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() < down / (up + down) else -down
        p[i], p[j] = p[i] + step, p[j] - step
        for x in (i, j):
            if min(p[x], 1 - p[x]) < 1e-9:
                p[x] = round(p[x])
                left.remove(x)
    for x in left:
        p[x] = float(rng.random() < p[x])
    return p


def budgets(stats: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> dict[str, tuple[float, int]]:
    """Expected copies of a record, and the cap, of each source: from (source, records, tokens) and (source, share,
    max_repeats), both of the bounded list of targets."""
    have = {s: t for s, n, t in stats if t > 0}
    merged: dict[str, tuple[float, int]] = {}
    for s, share, cap in targets:
        if s in merged:
            share, cap = merged[s][0] + share, min(merged[s][1], cap)
        merged[s] = (share, cap)
    usable = {s: (share, cap) for s, (share, cap) in merged.items() if s in have and share > 0 and cap > 0}
    norm = sum(share for share, _ in usable.values())
    if not norm:
        return {}
    total = min(cap * have[s] * norm / share for s, (share, cap) in usable.items())
    if total_tokens is not None:
        total = total_tokens
    return {s: (min(float(cap), share / norm * total / have[s]), cap) for s, (share, cap) in usable.items()}


def _fly(df: DataFrame, block: int, seed: int, level: int, landing: bool) -> DataFrame:
    """One round of the flight over (doc_id, source, n_tokens, p, blocks): blocks of each source apart."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["order"].min()) if len(g) else 0
        rng = np.random.default_rng([seed, level, len(g), first & 0xFFFFFFFF])
        g = g.sort_values(["order", "doc_id"], kind="stable")
        p = flight(g["n_tokens"].to_numpy(), g["p"].to_numpy(), rng)
        return g.assign(p=land(p, rng) if landing else p)[["doc_id", "source", "n_tokens", "p"]]

    keyed = df.withColumn("order", F.xxhash64(F.lit(seed), F.lit(level), "doc_id")).withColumn("block", F.pmod(F.shiftrightunsigned("order", 7), F.col("blocks")))
    return keyed.groupBy("source", "block").applyInPandas(run, "doc_id bigint, source string, n_tokens bigint, p double")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, block: int = BLOCK, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the records used, from (doc_id, source, text) and (source, target_share,
    max_repeats)."""
    spark = docs.sparkSession
    wanted = [(r["s"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s <> ''").collect()]  # a fixed table
    names = spark.createDataFrame([(s,) for s in sorted({w[0] for w in wanted})], "source string")
    pool = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("text <> ''")
    pool = pool.join(F.broadcast(names), "source", "left_semi")
    sized = cut(count_tokens(pool.select("doc_id", "source", "text"), tokenizer=tokenizer).where("n_tokens > 0"))
    stats = [(r["source"], r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()]  # one row a target
    copies = budgets(stats, wanted, total_tokens)
    counts = {s: n for s, n, _ in stats}
    rows = [(s, int(math.floor(r + 1e-12)), max(0.0, r - math.floor(r + 1e-12)), max(1, -(-counts[s] // block))) for s, (r, _) in copies.items()]
    rates = F.broadcast(spark.createDataFrame(rows, "source string, base int, p double, blocks bigint"))
    pool = sized.join(rates, "source")
    # records whose source has no fraction are decided
    flying = pool.where("p > 0").select("doc_id", "source", "n_tokens", "p", "blocks")
    blocks = {s: b for s, _, p, b in rows if p > 0}
    decided = None
    level = 0
    while blocks:
        last = max(blocks.values()) == 1
        flown = cut(_fly(flying, block, seed, level, last)) if not last else _fly(flying, block, seed, level, True)
        done = flown.where("p = 0 OR p = 1").select("doc_id", F.col("p").cast("int").alias("extra"))
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        level += 1
        blocks = {s: max(1, -(-2 * b // block)) for s, b in blocks.items()}  # a block leaves at most two
        sizes = F.broadcast(spark.createDataFrame(sorted(blocks.items()), "source string, blocks bigint"))
        flying = flown.where("p > 0 AND p < 1").join(sizes, "source").select("doc_id", "source", "n_tokens", "p", "blocks")
    base = pool.select("doc_id", "source", "n_tokens", "base")
    if decided is None:
        out = base.withColumn("copies", F.col("base").cast("bigint"))
    else:
        out = base.join(decided, "doc_id", "left").withColumn("copies", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("bigint"))
    return out.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target the share reached: (source, target_share, max_repeats, records, tokens, share, most_copies)."""
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = used.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
    zero = F.lit(0).cast("bigint")
    joined = t.join(F.broadcast(got), "source", "left").join(F.broadcast(total), F.lit(True), "left")  # one row a target, one row
    return joined.select(
        "source",
        "target_share",
        F.col("max_repeats").cast("bigint").alias("max_repeats"),
        F.coalesce("records", zero).alias("records"),
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
        F.coalesce("most_copies", zero).alias("most_copies"),
    )


def _targets(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/mix_targets.parquet")


def p9_mix(spark, sf):
    """The records used and how often."""
    return mix(documents(spark, sf).select("doc_id", "source", "text"), _targets(spark, sf))


def p9_shares(spark, sf):
    """The shares reached."""
    return shares(cut(p9_mix(spark, sf)), _targets(spark, sf))
