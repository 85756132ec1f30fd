"""As-of joins with a tolerance: sharded by client hash and time chunk, matched inside cogrouped Arrow tasks."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.llm.common import discard, stash

HOUR = 3_600_000_000
#: Rows of both sides that a cell is meant to hold; a key with more is cut into time chunks.
TARGET = 32_768
#: Ranges of equal depth that a heavy key's times are cut into before chunks are dealt evenly within them.
RANGES = 16
#: Keys with their ranges (200 bytes each), or crowded cells, that go to every executor; beyond, a join is shuffled.
BROADCAST_KEYS = 4_000


def micros(time: Column, kind: str) -> Column:
    """Microseconds since 1970 of a time with or without zone; the latter as it is written, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(time)
    second = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")
    in_day = F.hour(time).cast("long") * HOUR + F.minute(time).cast("long") * 60_000_000 + second
    return F.unix_date(time.cast("date")).cast("long") * 24 * HOUR + in_day


def floored(time: Column, width: int) -> Column:
    return time - F.pmod(time, F.lit(width))


def tie_groups(orders: DataFrame) -> DataFrame:
    """key, t, best, n_tied: orders (key, t, rank, value) of one key and time as one row, with the value of least rank."""
    known = orders.filter("key is not null and t is not null")
    return known.groupBy("key", "t").agg(F.min(F.struct("rank", "value")).alias("b"), F.count("*").alias("n_tied")).select(
        "key", "t", F.col("b.value").alias("best"), "n_tied"
    )


@cache
def _duck():
    """A database in memory, one for each worker; a cell fits into it, so nothing is written to a local folder."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


MATCH = """
    SELECT l.id, l.key, l.t, r.t AS at, r.place
    FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.t >= r.t
"""


def matched(looks: DataFrame, groups: DataFrame, within: int, target: int = TARGET) -> DataFrame:
    """id, key, t of looks, with at, best, n_tied of the latest group of its key at or before t and at most `within` earlier.

    looks: id, key, t, none of key and t null; groups: key, t, best, n_tied, one row for each key and time. Both are
    read several times, so they should be written tables.

    Keys are dealt into shards by hash. A key with over `target` rows has a shard of its own, cut into time chunks: its
    rows are counted by the hour, quantiles of the hours give ranges of equal depth, and chunks of equal width lie
    within these. The halo of a chunk is the
    last group before it, one row. A chunk with far more looks than `target` (many at one time) is dealt into pieces,
    each with the chunk's groups. So a cell holds some `target` rows however hot a key is; what follows the input's size
    is a row for each chunk of a heavy key, in a window of that key.
    """
    hour = F.floor(F.col("t") / HOUR).alias("hour")
    slots = looks.select("key", hour).union(groups.select("key", hour)).groupBy("key", "hour").agg(F.count("*").alias("n"))
    slots = stash(slots)
    counts = slots.groupBy("key").agg(F.sum("n").alias("n"))
    light = counts.agg(F.coalesce(F.sum(F.when(F.col("n") <= target, F.col("n"))), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, light // target)
    heavy = stash(counts.filter(F.col("n") > target).select("key", F.ceil(F.col("n") / target).cast("int").alias("chunks")))
    n_heavy = heavy.count()
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    plain = [F.lit(False).alias("own"), shard.alias("shard"), F.lit(0).alias("chunk")]
    left, right = looks.select(*plain, "id", "key", "t"), groups.select(*plain, "key", "t", "best", "n_tied")
    if n_heavy:
        few = F.broadcast if n_heavy <= BROADCAST_KEYS else lambda df: df
        cuts = F.array(*(F.lit(k / RANGES) for k in range(RANGES + 1)))
        q = F.percentile(F.col("hour") * HOUR, cuts, F.col("n")).cast("array<bigint>").alias("q")
        plan = stash(slots.join(few(heavy), "key").groupBy("key", "chunks").agg(q))
        discard(slots, heavy)

        def chunked(df: DataFrame) -> DataFrame:
            """own, shard, chunk before the columns: of a heavy key, its place among the quantiles as a chunk."""
            reached = F.size(F.filter("q", lambda x: x <= F.col("t")))
            j = F.least(F.greatest(reached, F.lit(1)), F.lit(RANGES))
            low, high = F.element_at("q", j), F.element_at("q", j + 1)
            inside = (F.col("t") - low) / F.greatest(high - low, F.lit(1))
            place = (j - 1 + F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))) / RANGES
            chunk = F.least(F.floor(place * F.col("chunks")).cast("int"), F.col("chunks") - 1)
            own = F.col("q").isNotNull()
            return df.join(few(plan), "key", "left").select(
                own.alias("own"), F.when(own, F.xxhash64("key")).otherwise(shard).alias("shard"),
                F.when(own, chunk).otherwise(0).alias("chunk"), *df.columns,
            )

        left, right = stash(chunked(looks)), stash(chunked(groups))
        # the halo: for each chunk of a heavy key the last group of the chunks before it
        last = right.filter("own").groupBy("key", "chunk").agg(F.max_by(F.struct("t", "best", "n_tied"), "t").alias("g"))
        grid = plan.select("key", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        halo = grid.join(last, ["key", "chunk"], "left").withColumn("g", F.last("g", ignorenulls=True).over(before))
        halo = halo.filter("g is not null").select(
            F.lit(True).alias("own"), F.xxhash64("key").alias("shard"), "chunk", "key", "g.t", "g.best", "g.n_tied"
        )
        right = right.union(halo)
        crowd = left.filter("own").groupBy("key", "chunk").count().filter(F.col("count") > 4 * target)
        crowd = stash(crowd.select("key", "chunk", F.ceil(F.col("count") / target).cast("int").alias("pieces")))
        n_crowd = crowd.count()
        few = F.broadcast if n_crowd <= BROADCAST_KEYS else lambda df: df
        pieces = F.coalesce("pieces", F.lit(1))
    if n_heavy and n_crowd:
        left = left.join(few(crowd), ["key", "chunk"], "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
        right = right.join(few(crowd), ["key", "chunk"], "left")
        right = right.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    else:
        left, right = left.withColumn("piece", F.lit(0)), right.withColumn("piece", F.lit(0))
    cell = ["own", "shard", "chunk", "piece"]
    kinds = dict(looks.dtypes) | dict(groups.dtypes)

    def meet(ls: pa.Table, rs: pa.Table) -> pa.Table:
        rest = rs.select(["best", "n_tied"])
        db = _duck()
        db.register("l", ls.select(["id", "key", "t"]))
        db.register("r", rs.select(["key", "t"]).append_column("place", pa.array(range(rs.num_rows), pa.int64())))
        told = db.sql(MATCH).to_arrow_table()
        db.unregister("l")
        db.unregister("r")
        late = pc.fill_null(pc.greater(pc.subtract(told["t"], told["at"]), within), True)
        near, at = (pc.if_else(late, None, told[c]) for c in ("place", "at"))
        found = rest.take(near)
        return pa.table([told["id"], told["key"], told["t"], at, found["best"], found["n_tied"]], schema=out)

    shape = f"id {kinds['id']}, key {kinds['key']}, t long, at long, best {kinds['best']}, n_tied long"
    out = to_arrow_schema(looks.sparkSession.createDataFrame([], shape).schema)
    cols = ["id", "key", "t"], ["key", "t", "best", "n_tied"]
    pair = left.select(*cell, *cols[0]).groupBy(*cell).cogroup(right.select(*cell, *cols[1]).groupBy(*cell))
    return pair.applyInArrow(meet, shape)


def crc(number: Column) -> Column:
    """Unsigned CRC-32 of a whole number's decimal digits."""
    return F.crc32(number.cast("string").cast("binary"))


def cents(total: Column) -> Column:
    """floor(100 x total + 0.5); null where that is no 64-bit number."""
    raw = F.floor(F.when(F.abs(total) < 9e16, 100 * total + 0.5))
    return raw.cast("long")


def click_orders(clicks: DataFrame, sales: DataFrame, hours: int = 240, target: int = TARGET) -> DataFrame:
    """click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied: for each click id the latest order of its client.

    Rows of clicks with one click_id count once; if they differ, the one with the smallest time counts, then the smallest
    client (nulls last). Times are microseconds since 1970, floored to the hour where the CRC-32 of the row's id is odd.
    Each row of sales is an order, repeated rows too, and where that CRC-32 is not divisible by 3 a second order equals
    it but for sale_id -1 - sale_id and priority 6 - priority. The match is the latest order at or before the click and
    at most `hours` earlier; of equal times the smaller priority, then the larger sale_id, then the larger total; nulls
    lose. n_tied counts all orders of the client at that time.

    Null ids of clicks count as one id, whose time is not floored; a sale with a null id is one order, its time as it is.
    A click with a null client or time matches nothing (n_tied 0, the rest null), and so do orders with such. A total
    that is null, not finite or beyond 64 bits of cents gives null. Empty tables give unmatched clicks or no rows;
    further columns are ignored.
    """
    kind = dict(clicks.dtypes)["ts"]
    rows = clicks.select("click_id", micros(F.col("ts"), kind).alias("us"), F.col("client_id").alias("key"))
    order = F.struct(F.col("us").isNull().alias("a"), "us", F.col("key").isNull().alias("b"), "key")
    once = rows.groupBy("click_id").agg(F.min(order).alias("o")).select("click_id", "o.us", "o.key")
    odd = F.coalesce(crc(F.col("click_id")) % 2 == 1, F.lit(False))
    looks = stash(once.select(
        F.col("click_id").alias("id"), "key", F.when(odd, floored(F.col("us"), HOUR)).otherwise(F.col("us")).alias("t")
    ))

    kind = dict(sales.dtypes)["sold_at"]
    us, h = micros(F.col("sold_at"), kind), crc(F.col("sale_id"))
    sold = sales.filter("client_id is not null and sold_at is not null").select(
        F.col("client_id").alias("key"), F.when(F.coalesce(h % 2 == 1, F.lit(False)), floored(us, HOUR)).otherwise(us).alias("t"),
        "sale_id", F.col("priority").cast("long").alias("priority"), cents(F.col("total")).alias("cents"),
        F.coalesce(h % 3 != 0, F.lit(False)).alias("twice"),
    )
    one = F.struct("sale_id", "priority")
    two = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    sold = sold.withColumn("o", F.explode(F.when(F.col("twice"), F.array(one, two)).otherwise(F.array(one))))
    rank = F.struct(
        F.col("o.priority").isNull().alias("a"), F.col("o.priority").alias("priority"), F.col("o.sale_id").isNull().alias("b"),
        (-1 - F.col("o.sale_id")).alias("less"), F.col("cents").isNull().alias("c"), (-1 - F.col("cents")).alias("lower"),
    )
    value = F.struct(F.col("o.sale_id").alias("sale_id"), "cents")
    groups = stash(tie_groups(sold.select("key", "t", rank.alias("rank"), value.alias("value"))))
    known = F.col("key").isNotNull() & F.col("t").isNotNull()
    told = matched(looks.filter(known), groups, hours * HOUR, target)
    none = looks.filter(~known).select("id", "key", "t", *(F.lit(None).cast("long").alias(c) for c in ("sale_id", "lag_us", "total_cents")))
    out = told.select(
        F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("t").alias("ts_us"),
        F.col("best.sale_id").alias("sale_id"), (F.col("t") - F.col("at")).alias("lag_us"),
        F.col("best.cents").alias("total_cents"), F.coalesce("n_tied", F.lit(0)).cast("long").alias("n_tied"),
    )
    return out.union(none.withColumn("n_tied", F.lit(0).cast("long")))
