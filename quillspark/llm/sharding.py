"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import rank_within

#: Racks of a region and shards of a rack; regions are added as shards are.
RACKS, SLOTS = 2, 2
#: What a slot weighs that no shard has taken yet.
RESERVED = 1.0
_LEVELS = {"region": 1, "rack": 2, "shard": 3}


def weights_of(shards: int, weights: Sequence[float] | None = None, racks: int = RACKS, slots: int = SLOTS) -> list[float]:
    """The weights of all slots: shard s has slot s, and the last region's other slots are reserved."""
    given = [1.0] * shards if weights is None else [float(w) for w in weights]
    if len(given) != shards or any(w < 0 for w in given) or not any(given):
        raise ValueError("there must be a weight for each shard, none below zero and one above it")
    return given + [RESERVED] * (-shards % (racks * slots))


def _draw(level: str, node: Column, key: Column, weight: Column | float) -> Column:
    """-ln(u) / weight with u from the hash of (level, node, key): exponential, with the weight as rate."""
    h = F.xxhash64(F.lit(_LEVELS[level]).cast("long"), node.cast("long"), key)
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _first_least(draws: Sequence[Column], values: Sequence[Column]) -> Column:
    """The value of the least draw, the first among equals."""
    least = F.least(*draws) if len(draws) > 1 else draws[0]
    out = values[-1]
    for d, v in reversed(list(zip(draws[:-1], values[:-1]))):
        out = F.when(d == least, v).otherwise(out)
    return out


def descend(df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, *, racks: int = RACKS, slots: int = SLOTS, out: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each row's ``key``, and as ``grown`` the shard if one more took the next slot.

    The draws: a node draws -ln(u) / weight, an exponential, from a hash of its own; a region's
    weight is the sum of its slots'. Of the regions the least draw wins, then of its racks, then of
    the rack's slots. So a key costs regions + racks + slots draws and not one for each shard, and a
    changed weight moves keys only into or out of the region, and in it the rack, whose weight
    changed.

    Growth: the slots of the last region are weighed before shards take them. What matters there is
    where a key would be if only taken slots counted. Draws below a node are comparable with those
    beside it: a child's is the node's plus what its own is above the least of its siblings' (the
    least of exponentials is exponential, and what the others are above it is too). So whole regions
    compete with the last region's whole racks and with the single shards of its last rack, and the
    winner is descended. A shard that takes a reserved slot brings a draw of its own and changes no
    other: it takes keys into itself and moves none elsewhere.
    """
    w, size = weights_of(shards, weights, racks, slots), racks * slots
    given = list(df.columns)
    name = lambda x: f"__{out}_{x}"
    key = F.col(key)
    rack_weights = [sum(w[i : i + slots]) for i in range(0, len(w), slots)]
    whole, rest = divmod(shards, size)

    def racks_of(region: Column, fixed: int | None = None) -> list[Column]:
        table = F.array(*[F.lit(x) for x in rack_weights])
        return [_draw("rack", region * racks + j, key, F.lit(rack_weights[fixed * racks + j]) if fixed is not None else F.get(table, region * racks + j)) for j in range(racks)]

    def slots_of(rack: Column, fixed: int | None = None) -> list[Column]:
        table = F.array(*[F.lit(x) for x in w])
        return [_draw("shard", rack * slots + j, key, F.lit(w[fixed * slots + j]) if fixed is not None else F.get(table, rack * slots + j)) for j in range(slots)]

    # The last region, down to the rack where the next shard goes; with all regions whole, that is a region to come.
    extended = [*w, *[RESERVED] * size] if not rest else w
    w, rack_weights = extended, [sum(extended[i : i + slots]) for i in range(0, len(extended), slots)]
    last, full_racks, taken = whole, rest // slots, rest % slots
    spine = df.withColumns({
        **{name(f"region{r}"): _draw("region", F.lit(r), key, float(sum(w[r * size : (r + 1) * size]))) for r in range(last + 1)},
        **{name(f"rack{j}"): d for j, d in enumerate(racks_of(F.lit(last), last))},
        **{name(f"slot{j}"): d for j, d in enumerate(slots_of(F.lit(last * racks + full_racks), last * racks + full_racks))},
    })

    def above(own: str, siblings: str, n: int, parent: Column) -> Column:
        draws = [F.col(name(f"{siblings}{j}")) for j in range(n)]
        return parent + F.col(name(own)) - (F.least(*draws) if n > 1 else draws[0])

    rack = [above(f"rack{j}", "rack", racks, F.col(name(f"region{last}"))) for j in range(racks)]
    slot = [above(f"slot{j}", "slot", slots, rack[full_racks]) for j in range(slots)]
    # Subtrees that are taken whole: (draw, region, rack, shard), each as far as it is settled.
    none = F.lit(None).cast("long")
    front = [(F.col(name(f"region{r}")), F.lit(r).cast("long"), none, none) for r in range(whole)]
    front += [(rack[j], none, F.lit(last * racks + j).cast("long"), none) for j in range(full_racks)]
    front += [(slot[j], none, none, F.lit((last * racks + full_racks) * slots + j).cast("long")) for j in range(taken)]
    draws = [x[0] for x in front]
    placed = spine.withColumns({
        name("best"): F.least(*draws) if len(draws) > 1 else draws[0],
        **{name(k): _first_least(draws, [x[i] for x in front]) for i, k in enumerate(("region", "rack", "shard"), 1)},
        name("next"): slot[taken],
    })
    region, chosen = F.col(name("region")), F.col(name("rack"))
    placed = placed.withColumn(name("rack"), F.when(region.isNull(), chosen).otherwise(_first_least(racks_of(region), [region * racks + j for j in range(racks)])))
    settled = F.col(name("shard"))
    placed = placed.withColumn(out, F.when(settled.isNotNull(), settled).otherwise(_first_least(slots_of(chosen), [chosen * slots + j for j in range(slots)])).cast("int"))
    if grown:
        placed = placed.withColumn(grown, F.when(F.col(name("next")) < F.col(name("best")), F.lit(shards)).otherwise(F.col(out)).cast("int"))
    return placed.select(*[F.col(f"`{c}`") for c in given], out, *([grown] if grown else []))


def shard(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, *, racks: int = RACKS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all documents to shards 0 .. ``shards`` - 1 by the law ``key``.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (0, 1 ... within the
    shard) and grown_shard (the shard if there were one more, of weight RESERVED). A null text has
    no bytes and the checksum 0; a null id is a key of its own; repeated ids share a shard and get
    slots of their own; other columns are left out; an empty table gives no rows; a shard of weight
    0 gets none. Placement is a map; only the narrow rows are shuffled, once, to number the slots
    (by shard and part file, so a hot key or heavy shard is not gathered in a task).
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    placed = descend(slim, "doc_id", shards, weights, racks=racks, slots=slots, grown="grown_shard")
    return rank_within(placed, ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
