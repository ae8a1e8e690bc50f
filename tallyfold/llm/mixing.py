"""Sources mixed to target shares of the total size.

The total is the largest at which every source can fill its share within its repeats.  A source's records are then used
`rate` times on average: each as often as the whole part of the rate, and once more with the fractional part as its
inclusion probability.  Which records get the extra use is decided by the cube method: inside blocks of bounded size,
the probabilities move along the null space of the balancing constraints (number of records, number of tokens) until at
most two per block are fractional; those of all blocks are gathered into new blocks, level by level, until one small
landing problem per source remains, which is solved by enumeration.
"""

from __future__ import annotations

import base64
import importlib.util
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyfold.storage import written

#: The session setting that names the folder of vocabularies, as the driver sees it, and the folder where it is unset.
SETTING, TOKENIZERS = "spark.tallyfold.tokenizers", "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
EPS = 1e-9


def vocabulary(folder: str, name: str) -> tuple[str, bytes]:
    """The splitting pattern of a folder of public vocabularies, and a file of ranks (a few MB)."""
    spec = importlib.util.spec_from_file_location("tokenizer_folder", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{name}", "rb") as file:
        return module.PATTERN, file.read()


@lru_cache(2)
def encoding(pattern: str, ranks: bytes):
    """The coder of a byte-level vocabulary, built once per Python worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def token_count(spark: SparkSession, folder: str | None = None, name: str = VOCABULARY):
    """A column function: text -> number of tokens; null for null.  Executors get the vocabulary from the driver."""
    held = spark.sparkContext.broadcast(vocabulary(folder or spark.conf.get(SETTING, TOKENIZERS), name))

    def run(texts: pd.Series) -> pd.Series:
        coder = encoding(*held.value)
        return pd.Series([None if t is None else len(coder.encode_ordinary(t)) for t in texts], dtype="Int32")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, IntegerType())


def plain_source(c: Column) -> Column:
    """A source's plain spelling: lower case, without outer spaces, parts joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities along the null space of (1, x) until at most two units are fractional; each keeps its expectation."""
    pi = pi.astype(float).copy()
    open_units = [int(k) for k in np.flatnonzero((pi > EPS) & (pi < 1 - EPS))]
    if len(open_units) < 3:
        return pi
    window, at = open_units[:3], 3
    while True:
        a, b, c = window
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, v in zip(window, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - pi[k]) / v), min(down, pi[k] / v)
            elif v < 0:
                up, down = min(up, pi[k] / -v), min(down, (1 - pi[k]) / -v)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for k, v in zip(window, u, strict=True):
            pi[k] = min(1.0, max(0.0, pi[k] + step * v))
            if EPS < pi[k] < 1 - EPS:
                left.append(k)
            else:
                pi[k] = round(pi[k])
        while len(left) < 3 and at < len(open_units):
            left.append(open_units[at])
            at += 1
        if len(left) < 3:
            return pi
        window = left


def landing(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the last fractional units so that tokens, then records, stay nearest to their expectation."""
    pi = pi.copy()
    left = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda s: (abs(sum((v - pi[k]) * x[k] for v, k in zip(s, left))), abs(sum(v - pi[k] for v, k in zip(s, left)))))
    pi[left] = best
    return pi


def _balanced(land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # an order and a seed that hang on the records only, so that a lost task comes out the same again
        pdf = pdf.sort_values(["draw", "doc_id"], kind="stable")
        x = pdf["tokens"].to_numpy(float)
        pi = flight(pdf["pi"].to_numpy(float), x, np.random.default_rng(int(pdf["draw"].iloc[0] * (1 << 40))))
        return pdf.assign(pi=landing(pi, x) if land else pi)

    return run


def cube(units: DataFrame, block: int = 4096) -> DataFrame:
    """doc_id, source, tokens, extra (0 or 1) for units with doc_id, source, tokens, pi."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(20_77)), F.lit(1 << 40)) / float(1 << 40)
    state = written(units.select("doc_id", "source", "tokens", "pi", draw.alias("draw")), "cube-0")
    fractional = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
    settled, level = None, 0
    while True:
        fixed, left = state.where(~fractional), state.where(fractional)
        settled = fixed if settled is None else settled.unionByName(fixed)
        sizes = left.groupBy("source").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        last, level = most <= block, level + 1
        # one block per `block` units of a source: a hot source becomes many blocks
        grouped = left.join(F.broadcast(sizes), "source").withColumn("blk", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.ceil(F.col("n") / F.lit(block // 2))).cast("int") if not last else F.lit(0))
        state = written(grouped.select("doc_id", "source", "tokens", "pi", "draw", "blk").groupBy("source", "blk").applyInPandas(_balanced(last), "doc_id bigint, source string, tokens int, pi double, draw double, blk int").drop("blk"), f"cube-{level}")
    return settled.select("doc_id", "source", "tokens", F.round("pi").cast("int").alias("extra"))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens, docs, share (of the sources that have tokens), rate (uses per record).

    A listed source without tokens can't be filled: its share is 0 and the others' are scaled to 1; so is every source
    if nothing is there.  Of a source listed twice the shares add up and the smaller cap counts.  Null or negative shares
    and caps are 0.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("docs"))
    want = targets.select(plain_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("m"))
    want = want.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("w").alias("target_share"), F.min("m").alias("max_repeats"))
    rows = want.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
    usable = (F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    rows = written(rows, "mix-sources")
    total = rows.where(usable).agg(F.sum("target_share")).first()[0] or 1.0
    rows = rows.withColumn("share", F.when(usable, F.col("target_share") / F.lit(total)).otherwise(0.0))
    size = rows.where(usable).agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("share"))).first()[0] or 0.0
    rate = F.least(F.col("max_repeats").cast("double"), F.lit(size) * F.col("share") / F.col("tokens"))
    return rows.select("source", "target_share", "max_repeats", "tokens", "docs", "share", F.when(usable, rate).otherwise(0.0).alias("rate"))


def mixed(documents: DataFrame, targets: DataFrame, folder: str | None = None, name: str = VOCABULARY, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(chosen: doc_id, source, tokens, repeats >= 1; the plan by source).

    Records without an id, of unlisted or null sources, or without tokens (null or empty text) are not used.  Of a
    record delivered twice the row with the most tokens counts once.
    """
    want = targets.select(plain_source(F.col("source")).alias("source")).where(F.col("source").isNotNull()).distinct()
    listed = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).join(want, "source", "left_semi")
    counted = listed.select("doc_id", "source", token_count(documents.sparkSession, folder, name)("text").alias("tokens")).where(F.col("tokens") > 0)
    sized = written(counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("r")).select("doc_id", "r.source", "r.tokens"), "mix-sized")
    sources = written(plan(sized, targets), "mix-plan")
    units = sized.join(F.broadcast(sources.select("source", "rate")), "source").where(F.col("rate") > 0)  # one row per listed source
    whole = F.floor(F.col("rate") + EPS)
    units = units.withColumn("pi", F.greatest(F.col("rate") - whole, F.lit(0.0)))
    chosen = cube(units, block).join(F.broadcast(sources.select("source", whole.cast("int").alias("whole"))), "source")
    chosen = chosen.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("repeats")).where(F.col("repeats") > 0)
    return chosen, sources


def shares(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """source, target_share, planned_share, max_repeats, docs, tokens, share reached."""
    used = chosen.groupBy("source").agg(F.count("*").alias("docs"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens").cast("bigint") * F.col("repeats")).alias("tokens"))
    rows = sources.select("source", "target_share", F.col("share").alias("planned_share"), "max_repeats").join(used, "source", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("docs", "uses", "most_repeats", "tokens")})
    rows = written(rows, "mix-shares")
    total = rows.agg(F.sum("tokens")).first()[0] or 1
    return rows.select("source", "target_share", "planned_share", "max_repeats", "docs", "uses", "most_repeats", "tokens", (F.col("tokens") / F.lit(total)).alias("actual_share"))
