"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is rotated at random and only the signs are kept, with a correction factor: the inner
product of the vector with its own code. Against a rotated full vector, the code gives an unbiased
estimate of the inner product with a known spread, and its upper confidence bound decides which pairs
are computed exactly.

1. Sign bits of further rotations, `band_bits` at a time, deal the vectors into buckets; the number
   of bands follows from the wished recall at the threshold, the bits from the number of vectors.
   Rows of buckets carry the code: the share of differing bits estimates the angle of two vectors, so
   nearly all pairs that met by chance are gone before any full vector is fetched.
2. Tight groups: each vector is compared with the smallest vector of each of its buckets. Those
   within half the threshold angle of one form a group around it. Two vectors of a group are within
   the threshold angle of each other, so the links within groups are counted, not listed, and a group
   of copies costs rows in proportion to its size.
3. Groups that share a bucket are compared by their centres. With the groups' radii, the triangle
   inequality settles most pairs of groups as a whole; the members of the rest are compared in blocks.
4. Connected components of the linked groups give the component of each vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import stored, unit_rows
from tabulon.llm.components import components
from tabulon.operators.lookup import fits_broadcast

#: Standard deviations added to an estimate; a pair at the threshold is overlooked once in 30,000 times.
CONFIDENCE = 4.0
#: Standard deviations added when only differing bits are counted, which are binomial and so have a heavier tail.
BITS_CONFIDENCE = 5.0
#: Members of a group that are compared at once.
BLOCK = 1024
#: Room for rounding in comparisons of angles; pairs within it are computed one by one.
ROUNDING = 1e-9


def rotations(width: int, count: int, seed: int = 11) -> np.ndarray:
    """`count` random rotations of `width` dimensions."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((width, width)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def choose_bands(vectors: int, threshold: float, recall: float = 0.99) -> tuple[int, int]:
    """Bits of a band, so that unrelated vectors hardly meet, and bands for the wished recall."""
    bits = max(4, math.ceil(math.log2(max(vectors, 2))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def encode(units: np.ndarray, rotation: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Packed sign codes and correction factors of unit vectors."""
    turned = units @ rotation
    return [r.tobytes() for r in np.packbits(turned > 0, axis=1)], np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimate(codes: list[bytes], factors: np.ndarray, others: np.ndarray, rotation: np.ndarray):
    """Unbiased estimates of inner products of coded unit vectors with full ones, and their standard deviations."""
    width = rotation.shape[0]
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=width)
    turned = others @ rotation
    found = ((2.0 * bits - 1.0) * turned).sum(axis=1) / math.sqrt(width) / factors
    return found, np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(width - 1, 1))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only if the measured size allows it."""
    return F.broadcast(df) if fits_broadcast(df) else df


def _parts(width: int) -> list[str]:
    """Names of the columns that hold a code as 64-bit integers."""
    return [f"code{i}" for i in range(math.ceil(width / 64))]


def may_reach(width: int, left: str, right: str, least: Column) -> Column:
    """Whether two vectors may have a cosine of `least`, by the differing bits of the codes in two structs."""
    apart = sum((F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in _parts(width)), F.lit(0))
    share = F.acos(least) / math.pi
    return apart <= 1 + width * share + BITS_CONFIDENCE * F.sqrt(width * share * (1 - share))


def _prepared(vectors: DataFrame, width: int, rotation: np.ndarray) -> DataFrame:
    """(row, unit, code, factor) of the usable vectors, and the code in parts."""
    names = _parts(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, found = unit_rows(batch["embedding"], width)
            if keep:
                # Scaled first, so that the squares of very large or small components stay finite.
                scaled = np.stack(found)
                scaled /= np.abs(scaled).max(axis=1, keepdims=True)
                units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                codes, factors = encode(units, rotation)
                filled = b"".join(c.ljust(8 * len(names), b"\0") for c in codes)
                parts = np.frombuffer(filled, "<i8").reshape(len(codes), len(names))
                found = {"row": batch["row"].to_numpy()[keep], "unit": list(units), "code": codes, "factor": factors}
                yield pd.DataFrame(found | dict(zip(names, parts.T)))

    schema = ", ".join(["row long, unit array<double>, code binary, factor double", *(f"{c} long" for c in names)])
    return vectors.select("row", "embedding").mapInPandas(run, schema)


def _buckets(prepared: DataFrame, width: int, bits: int, bands: int) -> DataFrame:
    """(band, row) and the code in parts: the bucket of each vector in each band."""
    names = _parts(width)
    turns = rotations(width, math.ceil(bits * bands / width), seed=13)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = np.stack(batch["unit"])
            signs = np.concatenate([units @ t > 0 for t in turns], axis=1)[:, : bits * bands]
            keys = signs.reshape(len(units), bands, bits) @ powers + (np.arange(bands, dtype=np.int64) << bits)
            carried = {c: np.repeat(batch[c].to_numpy(), bands) for c in ("row", *names)}
            yield pd.DataFrame({"band": keys.ravel()} | carried)

    schema = ", ".join(["band long, row long", *(f"{c} long" for c in names)])
    return prepared.select("row", "unit", *names).mapInPandas(run, schema)


def _exact(pairs: DataFrame, prepared: DataFrame, rotation: np.ndarray) -> DataFrame:
    """`pairs` (a, b, least) with their exact cosine, of those whose estimate may reach `least`."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found, spread = estimate(
                    batch["code"].tolist(), batch["factor"].to_numpy(), np.stack(batch["unit"]), rotation
                )
                yield batch.loc[found + CONFIDENCE * spread >= batch["least"].to_numpy(), ["a", "b", "least"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosine = np.einsum("ij,ij->i", np.stack(batch["unit"]), np.stack(batch["other"]))
                yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "cosine": cosine})

    codes = _small(prepared.select(F.col("row").alias("a"), "code", "factor"))
    first = _small(prepared.select(F.col("row").alias("a"), F.col("unit").alias("other")))
    second = _small(prepared.select(F.col("row").alias("b"), "unit"))
    kept = stored(
        pairs.join(codes, "a").join(second, "b").select("a", "b", "least", "code", "factor", "unit")
        .mapInPandas(likely, "a long, b long, least double"),
        "likely",
    )
    return kept.join(first, "a").join(second, "b").select("a", "b", "unit", "other").mapInPandas(
        exact, "a long, b long, cosine double"
    )


def _blocks(open_pairs: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Links between the members of pairs of groups that the triangle inequality leaves open.

    (group, other, row, links) for each member with links; a block holds parts of two groups.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def done():
            left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
            if not left or not right:
                return None
            linked = np.stack([r[2] for r in left]) @ np.stack([r[2] for r in right]).T >= threshold
            links = np.concatenate((linked.sum(axis=1), linked.sum(axis=0)))
            out = pd.DataFrame({"group": key[0], "other": key[1], "row": [r[1] for r in left + right], "links": links})
            return out[links > 0]

        for batch in batches:
            found = []
            for g, h, i, j, side, row, unit in batch.itertuples(index=False):
                if (g, h, i, j) != key:
                    if rows:
                        found.append(done())
                    key, rows = (g, h, i, j), []
                rows.append((side, row, unit))
            found = [f for f in found if f is not None]
            if found:
                yield pd.concat(found)
        if rows and (last := done()) is not None:
            yield last

    parts = sizes.select(F.col("group"), F.ceil(F.col("size") / BLOCK).alias("parts"))
    pairs = (
        open_pairs.join(parts.withColumnRenamed("parts", "p"), "group")
        .join(parts.select(F.col("group").alias("other"), F.col("parts").alias("q")), "other")
        .select("group", "other", "p", "q")
    )
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    left = pairs.join(members, "group").select(
        "group", "other", part("p").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"),
        F.lit(0).alias("side"), "row", "unit",
    )
    right = pairs.join(members.withColumnRenamed("group", "other"), "other").select(
        "group", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("i"), part("q").alias("j"),
        F.lit(1).alias("side"), "row", "unit",
    )
    key = ["group", "other", "i", "j"]
    both = left.unionByName(right.select(left.columns)).repartition(*key).sortWithinPartitions(*key)
    return both.mapInPandas(run, "group long, other long, row long, links long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Pairs with a cosine of `threshold` or more are linked, none below; of pairs just at the threshold
    the share `recall` is expected to be found, of closer ones more. Repeated rows are vectors of their
    own. Null and zero vectors, vectors with null or non-finite components and vectors that have not
    the commonest length link with nothing; their component is their own id.
    """
    table = stored(
        vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("embedding"))
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    counted = table.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "width").first()
    lone = table.select("id", "row")
    if top is None:
        return lone.select(
            F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    width, count = top["width"], top["n"]
    rotation = rotations(width, 1)[0]
    angle = math.acos(threshold)
    bits, bands = choose_bands(count, threshold, recall)
    prepared = stored(_prepared(table, width, rotation), "codes")
    buckets = stored(_buckets(prepared, width, bits, bands), "buckets")

    # Tight groups around the smallest vectors of buckets.
    held = buckets.select("band", F.struct("row", *_parts(width)).alias("one"))
    shared = held.groupBy("band").agg(F.min("one").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    tight = math.cos(angle / 2) + ROUNDING
    tries = (
        held.join(shared, "band").where("one.row <> first.row").where(may_reach(width, "one", "first", F.lit(tight)))
        .select(F.col("one.row").alias("a"), F.col("first.row").alias("b")).distinct()
    )
    close = _exact(tries.withColumn("least", F.lit(tight)), prepared, rotation).where(F.col("cosine") >= tight)
    centre = close.groupBy("a").agg(F.min(F.struct("b", "cosine")).alias("best"))
    members = stored(
        prepared.select("row").join(centre.withColumnRenamed("a", "row"), "row", "left").select(
            "row",
            F.coalesce("best.b", "row").alias("group"),
            F.when(F.col("best").isNull(), 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.col("best.cosine")))).alias("off"),
        ),
        "members",
    )
    sizes = stored(members.groupBy("group").agg(F.count("*").alias("size"), F.max("off").alias("radius")), "groups")

    # Pairs of groups that share a bucket, compared by their centres.
    known = _small(sizes)
    codes = prepared.select(F.col("row").alias("group"), F.struct(*_parts(width)).alias("bits"))
    centres = _small(stored(codes.join(known.select("group", "radius"), "group"), "centres"))
    spots = stored(
        buckets.select("band", "row").join(_small(members.select("row", "group")), "row").select("band", "group").distinct()
        .join(centres, "group"),
        "spots",
    )
    seen = spots.select("band", F.col("group").alias("other"), F.col("radius").alias("other_radius"), F.col("bits").alias("other_bits"))
    other = known.select(F.col("group").alias("other"), F.col("size").alias("other_size"), F.col("radius").alias("other_radius"))
    reach = F.col("radius") + F.col("other_radius")
    least = F.cos(F.least(F.lit(math.pi), F.lit(angle + ROUNDING) + reach))
    pairs = (
        spots.join(seen, "band").where("group < other").where(may_reach(width, "bits", "other_bits", least))
        .select(F.col("group").alias("a"), F.col("other").alias("b"), least.alias("least")).distinct()
    )
    compared = stored(
        _exact(pairs, prepared, rotation).select(F.col("a").alias("group"), F.col("b").alias("other"), "cosine")
        .join(known, "group").join(other, "other"),
        "compared",
    )
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    single = reach == 0
    whole = F.when(single, F.col("cosine") >= threshold).otherwise(apart + reach <= angle - ROUNDING)
    none = F.when(single, F.col("cosine") < threshold).otherwise(apart - reach > angle + ROUNDING)
    linked = compared.where(whole)
    with_unit = members.join(prepared.select("row", "unit"), "row").select("row", "group", "unit")
    found = stored(_blocks(compared.where(~whole & ~none).select("group", "other"), with_unit, sizes, threshold), "blocks")

    by_group = (
        linked.select("group", F.col("other_size").alias("links"))
        .unionByName(linked.select(F.col("other").alias("group"), F.col("size").alias("links")))
        .groupBy("group").agg(F.sum("links").alias("group_links"))
    )
    by_row = found.groupBy("row").agg(F.sum("links").alias("row_links"))
    joined = components(linked.select("group", "other").unionByName(found.select("group", "other")), "group", "other")
    facts = (
        members.join(sizes.select("group", "size"), "group")
        .join(by_group, "group", "left")
        .join(by_row, "row", "left")
        .join(joined.withColumnRenamed("id", "group"), "group", "left")
        .select(
            "row",
            (F.col("size") - 1 + F.coalesce("group_links", F.lit(0)) + F.coalesce("row_links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "group").alias("component"),
        )
    )
    facts = stored(lone.join(facts, "row", "left"), "facts")
    least = facts.groupBy("component").agg(F.min("id").alias("least")).where(F.col("component").isNotNull())
    component_id = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
    return facts.join(least, "component", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"),
    )
