"""SimHash fingerprints with DataFrame functions only, and the search for those within a Hamming radius.

A text's terms are its words, each with the next one. Every term hashes to 128 bits and votes on each of
them, for or against, with the letters of its two words as weight: long words say more than short
ones. A bit is set when the votes for it outweigh those against. Votes are summed in pairs, two bits
to a 64-bit number: a text has fewer than 2^31 characters, so each half stays below 2^32.

The search cuts fingerprints into ``radius + 1`` blocks. Two within the radius agree on one block at
least, so there is one table per block, ordered by the permutation that puts this block first, and
equal first blocks are looked up and verified on all bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.session import cut_lineage

BITS = 128
#: Ids per window group: neighbouring documents are at most this many ids apart inside one.
GROUP_BITS = 8
#: Rows without a key are dealt to groups from here on, above those of any key.
LOOSE = 1 << 60
#: Upper levels of the order of groups; at the top at most 2^16 groups remain.
LEVEL_BITS = (12, 12, 16)
PAIR = (1 << 32) | 1


def votes() -> tuple[list[Column], list[Column]]:
    """Hashes and weight of a term (columns first, second), and their sums: weight, then 32 pairs for each 64 bits."""
    hashes = [F.xxhash64("first", "second"), F.xxhash64(F.lit(1), "first", "second")]
    weight = F.coalesce(F.length("first"), F.lit(0)) + F.coalesce(F.length("second"), F.lit(0))
    sums = [F.sum("weight").alias("total")]
    for half, name in enumerate(("h0", "h1")):
        for bit in range(32):
            pair = F.shiftright(F.col(name), bit).bitwiseAND(F.lit(PAIR))
            sums.append(F.sum(pair * F.col("weight")).alias(f"v{half}_{bit}"))
    return [hashes[0].alias("h0"), hashes[1].alias("h1"), weight.cast("bigint").alias("weight")], sums


def decided(half: int) -> Column:
    """64 bits from the sums of ``votes``."""
    bits = []
    for bit in range(32):
        pair, total = F.col(f"v{half}_{bit}"), F.col("total")
        low, high = pair.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(pair, 32)
        top = (1 << (bit + 32)) - (1 << 64 if bit == 31 else 0)
        bits.append(F.when(2 * low > total, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        bits.append(F.when(2 * high > total, F.lit(top).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return reduce(Column.bitwiseOR, bits)


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the two halves f0, f1 of every text; keys must tell rows apart. An empty text has all bits 0.

    One partially aggregated pass; there is no shuffle when ``rows`` are already dealt by some of ``keys``.
    """
    made, sums = votes()
    words = rows.select(*keys, F.array_remove(F.split(F.col(text), r"\s+"), "").alias("words"))
    following = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = words.select(*keys, F.explode_outer(F.arrays_zip(F.col("words").alias("first"), following.alias("second"))).alias("term"))
    hashed = pairs.select(*keys, F.col("term")["first"].alias("first"), F.col("term")["second"].alias("second"))
    return hashed.select(*keys, *made).groupBy(*keys).agg(*sums).select(*keys, decided(0).alias("f0"), decided(1).alias("f1"))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - differing(a, b) / BITS


def differing(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b))


def as_hex(f0: str, f1: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f), 16, "0") for f in (f0, f1)]))


def following(ids: DataFrame, levels: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """(id, next) of distinct ids in ascending order, the last followed by the first.

    Ids are grouped by their upper bits, level by level, so no task orders more than 2^16 of them.
    """
    if not levels:
        order = Window.orderBy("id")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ids.select("id", F.coalesce(F.lead("id").over(order), F.min("id").over(every)).alias("next"))
    grouped = ids.select("id", F.shiftright("id", levels[0]).alias("group"))
    firsts = grouped.groupBy("group").agg(F.min("id").alias("first"))
    after = following(firsts.select(F.col("group").alias("id")), levels[1:])
    beyond = after.join(firsts.withColumnRenamed("group", "next"), "next").select(F.col("id").alias("group"), "first")
    inside = F.lead("id").over(Window.partitionBy("group").orderBy("id"))
    return grouped.withColumn("inside", inside).join(beyond, "group").select(
        "id", F.coalesce("inside", "first").alias("next")
    )


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, next_text, and the columns group, place (its row number there) and last (the group's last row).

    Rows are dealt by groups of neighbouring keys in one shuffle; only the first text of each group moves
    once more, to the group before, and all later steps keep the dealing. Rows with equal keys follow each other by text; rows without a key
    have no next text (empty).
    """
    value = F.coalesce(F.col(text), F.lit("")).alias("text")
    number = F.col(key).cast("bigint")
    beside_all = F.pmod(F.xxhash64(text), F.lit(LOOSE)) + F.lit(LOOSE)
    group = F.coalesce(F.shiftright(number, GROUP_BITS), beside_all).alias("group")
    rows = docs.select(number.alias("key"), value, group)
    order = Window.partitionBy("group").orderBy("key", "text")
    placed = rows.withColumns({"place": F.row_number().over(order), "beside": F.lead("text").over(order)})
    placed = placed.withColumn("last", F.lead("key").over(order).isNull())
    heads = placed.where("place = 1 AND key IS NOT NULL").select(F.col("group").alias("next"), F.col("text").alias("beyond"))
    groups = rows.where("key IS NOT NULL").select(F.col("group").alias("id")).distinct()
    after = following(groups).join(heads, "next").select(F.col("id").alias("group"), "beyond")
    joined = placed.join(after, "group", "left")
    next_text = F.when(F.col("key").isNull(), F.lit("")).when(F.col("last"), F.col("beyond")).otherwise(F.col("beside"))
    return joined.select("key", "text", next_text.alias("next_text"), "group", "place", "last")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and that to the next text.

    The edited text has the last floor(n / 2) of the n characters replaced by as many (or all) of the next
    document's first ones. Columns: key, n_chars, edited_sha256, f0, f1, e0, e1, near_edited, near_next.
    A null text is empty and has all bits 0; a single row is its own next. Rows with equal keys each
    give a row and follow each other by text. A row without a key has no next: its edited text is its
    first half, and near_next is null. Other columns are not read.
    """
    rows = with_next(docs, key, text)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["group", "key", "place", "last", "n_chars", "edited_sha256"]
    beyond = F.when(F.col("last") & F.col("key").isNotNull(), F.struct(F.lit(2).alias("part"), F.col("next_text").alias("body")))
    bodies = F.array(
        F.struct(F.lit(0).alias("part"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("part"), F.col("edited").alias("body")),
        beyond,
    )
    parts = rows.select(*keys, F.explode(bodies).alias("one")).where("one IS NOT NULL")
    hashed = simhash(parts.select(*keys, "one.part", "one.body"), [*keys, "part"], "body")
    picked = {
        f"{name}{half}": F.max(F.when(F.col("part") == part, F.col(f"f{half}")))
        for part, name in enumerate(("own", "edited", "beyond")) for half in (0, 1)
    }
    whole = hashed.groupBy(*keys).agg(*[value.alias(name) for name, value in picked.items()])
    order = Window.partitionBy("group").orderBy("place")
    whole = whole.withColumns({
        f"next{half}": F.when(F.col("last"), F.col(f"beyond{half}")).otherwise(F.lead(f"own{half}").over(order))
        for half in (0, 1)
    })
    own = ("own0", "own1")
    return whole.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", F.col("own0").alias("f0"), F.col("own1").alias("f1"),
        F.col("edited0").alias("e0"), F.col("edited1").alias("e1"),
        likeness(own, ("edited0", "edited1")).alias("near_edited"),
        F.when(F.col("key").isNotNull(), likeness(own, ("next0", "next1"))).alias("near_next"),
    )


def block(number: int, blocks: int) -> Column:
    """Bits of one of ``blocks`` equal parts of (f0, f1); parts do not cross the halves."""
    per_half = blocks // 2
    width = 64 // per_half
    half, offset = divmod(number, per_half)
    size = 64 - width * (per_half - 1) if offset == per_half - 1 else width
    value = F.shiftrightunsigned(F.col(f"f{half}"), offset * width)
    return value if size == 64 else value.bitwiseAND(F.lit((1 << size) - 1))


def block_tables(prints: DataFrame, radius: int) -> DataFrame:
    """The columns of ``prints`` and all blocks, once per table: its number, and the block that leads there."""
    blocks = radius + 1 + (radius + 1) % 2
    cut = prints.select("*", F.array(*[block(i, blocks) for i in range(blocks)]).alias("blocks"))
    return cut.select("*", F.posexplode("blocks").alias("table", "lead"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """For every distinct (f0, f1) of ``queries``: the distinct ones of ``prints`` at most ``radius`` bits away.

    ``prints`` must have a row per distinct fingerprint; further columns of it are kept. Columns: q0, q1,
    then those of ``prints``, and ``distance``. A pair is found in every table on whose block it agrees
    and is reported by the first of them. The number of tables is even and above the radius.
    """
    asked = block_tables(queries.select("f0", "f1").distinct(), radius)
    asked = asked.select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), F.col("blocks").alias("asked"), "table", "lead")
    met = asked.join(block_tables(prints, radius), ["table", "lead"])
    earlier = F.exists(
        F.arrays_zip(F.slice(F.col("asked"), F.lit(1), F.col("table")).alias("a"), F.slice(F.col("blocks"), F.lit(1), F.col("table")).alias("b")),
        lambda pair: pair["a"] == pair["b"],
    )
    met = met.withColumn("distance", differing(("q0", "q1"), ("f0", "f1"))).where((F.col("distance") <= radius) & ~earlier)
    return met.select("q0", "q1", *prints.columns, "distance")


def fingerprint_report(docs: DataFrame, radius: int = 3, every: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``edited_fingerprints`` with, for keys divisible by ``every``, ``n_within``: how many rows, itself
    included, have a fingerprint at most ``radius`` bits away. Null for the other keys."""
    found = cut_lineage(edited_fingerprints(docs, key, text))
    asked = F.coalesce(F.col(key) % every == 0, F.lit(False))
    prints = found.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("rows"))
    near = within_radius(found.where(asked), prints, radius)
    counts = near.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("rows").alias("n_within"))
    return found.where(asked).join(counts, ["f0", "f1"], "left").select(*found.columns, "n_within").unionByName(
        found.where(~asked).withColumn("n_within", F.lit(None).cast("bigint"))
    )
