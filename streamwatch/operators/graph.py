"""River networks as edge tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files: spark.checkpoint.dir, or where that is unset a folder in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between"


def cut(df: DataFrame) -> DataFrame:
    """df from files in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """df from a table of its own in the shared folder, with the size it really has."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def of_order(segments: DataFrame, orders: DataFrame, least: int) -> DataFrame:
    """segments (entity_id) of at least so high an order, with it; one without an order counts as of order 1.

    Raises where nothing is left, for then the limit is wrong.
    """
    known = segments.join(orders.select("entity_id", "strahler_order"), "entity_id", "left")
    kept = known.withColumn("strahler_order", F.coalesce("strahler_order", F.lit(1))).filter(F.col("strahler_order") >= least)
    if kept.isEmpty() and not segments.isEmpty():
        raise ValueError(f"no segment has an order of {least} or more")
    return kept


def downstream(starts: DataFrame, topology: DataFrame, hops: int) -> DataFrame:
    """entity_id, reached_id, hops: what each start reaches in at most so many steps, itself with 0; the least number counts."""
    at = starts.select("entity_id", F.col("entity_id").alias("reached_id"), F.lit(0).alias("hops"))
    out = at
    for k in range(1, hops + 1):
        at = at.join(topology, at["reached_id"] == topology["upstream_id"]).select("entity_id", F.col("downstream_id").alias("reached_id"), F.lit(k).alias("hops")).distinct()
        out = out.unionByName(at)
    return out.groupBy("entity_id", "reached_id").agg(F.min("hops").alias("hops"))


def outlets(topology: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity_id, outlet_id, steps by pointer doubling; nodes of a cycle keep a null outlet."""
    first = topology.groupBy(F.col("upstream_id").alias("entity_id")).agg(F.min("downstream_id").alias("to"))
    at = cut(nodes.select("entity_id").distinct().join(first, "entity_id", "left").select("entity_id", F.coalesce("to", "entity_id").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    for _ in range(max(1, at.count()).bit_length() + 1):  # by then every walk is longer than any path
        nxt = at.select(F.col("entity_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_s"))
        new = cut(at.join(nxt, "to").select("entity_id", F.col("_to").alias("to"), (F.col("steps") + F.col("_s")).alias("steps")))
        done = new.join(at.select("entity_id", F.col("to").alias("old")), "entity_id").filter("old <> to").isEmpty()
        at = new
        if done:
            break
    roots = nodes.select("entity_id").distinct().join(topology.select(F.col("upstream_id").alias("entity_id")).distinct(), "entity_id", "left_anti").select(F.col("entity_id").alias("to"), F.lit(True).alias("_root"))
    return at.join(roots, "to", "left").select("entity_id", F.when(F.col("_root"), F.col("to")).alias("outlet_id"), F.when(F.col("_root"), F.col("steps")).alias("steps"))


#: Rounds after which the results of a loop are put together.
TOGETHER = 16


def contracted(edges: DataFrame, states: DataFrame, gathered: Callable[[DataFrame], DataFrame], merged: Callable[[Column, Column], Column], composed: Callable[[Column, Column], Column]) -> DataFrame:
    """Values that flow down a network, by tree contraction: entity_id, state, settled.

    edges: up, down, without nulls. states: entity_id, state; one row an entity, all of edges among them. A state is what
    is known of an entity and, at once, how its value follows from one more inflow's. Each round does two things. An
    entity whose inflows are all in settles, and its state is gathered and merged into the entities it flows to (rake).
    An entity that waits for one inflow only is composed with the state of that inflow and waits from then on for what
    that one waits for (compress), so a chain halves; where such entities are no more than those that settle, a third of a
    tree settles in the round, and it is left out. A tree of n entities takes about log(n) rounds however deep it is;
    a network with bifurcations takes at most as many as it has levels. Entities on a cycle or below one don't settle.
    A round is a table in the shared folder, not a checkpoint: that would keep the size that was estimated for its join,
    and sizes that multiply round after round keep the optimizer busier than the network. The tables go at the end.

    gathered: entity_id, x (an inflow's state), state, waits -> entity_id, g, n (inflows), state, waits.
    """
    n = states.count()
    into = edges.groupBy(F.col("down").alias("entity_id")).agg(F.count("*").alias("waits"))
    at = states.join(into, "entity_id", "left").join(edges.select(F.col("down").alias("entity_id"), "up"), "entity_id", "left")
    folder, rounds = f"{shared_folder(states.sparkSession)}/contracted-{uuid.uuid4().hex}", count()
    at = written(at.select("entity_id", "up", F.coalesce("waits", F.lit(0).cast("long")).alias("waits"), "state", F.lit(1).cast("long").alias("span")), f"{folder}/{next(rounds)}")
    done: list[DataFrame] = []
    while True:
        ready, single = at.agg(F.count_if(F.col("waits") == 0), F.count_if(F.col("waits") == 1)).first()
        if not ready:  # while any is off the cycles, one of them has all its inflows
            break
        settled = at.filter("waits = 0").select(F.col("entity_id").alias("up"), F.col("state").alias("x"))
        met = at.filter("waits > 0").join(settled, "up", "left")
        sums = gathered(met.filter("x is not null and waits > 1").select("entity_id", "x", "state", "waits"))
        sums = sums.select("entity_id", merged(F.col("state"), F.col("g")).alias("_s"), (F.col("waits") - F.col("n")).alias("_w"))
        several = met.filter("x is null and waits > 1").drop("x").join(sums, "entity_id", "left").withColumns({"waits": F.coalesce("_w", "waits"), "state": F.coalesce("_s", "state")})
        names = ["entity_id", "up", "waits", "state", "span"]
        rest = met.filter("x is null and waits = 1").select(names).unionByName(several.select(names))
        last = met.filter("x is not null and waits = 1").select("entity_id", composed(F.col("state"), F.col("x")).alias("state"))
        last = last.unionByName(sums.filter("_w = 0").select("entity_id", F.col("_s").alias("state")))
        last = last.select("entity_id", F.lit(None).cast(at.schema["up"].dataType).alias("up"), F.lit(0).cast("long").alias("waits"), "state", F.lit(1).cast("long").alias("span"))
        if single > ready:
            # an entity whose inflow waits for one as well waits for that one; a span of more than n goes round a cycle
            chain = rest.filter("waits = 1")
            over = chain.select(F.col("entity_id").alias("up"), F.col("up").alias("_up"), F.col("state").alias("_state"), F.col("span").alias("_span"))
            jumps = F.col("_up").isNotNull() & (F.col("span") + F.col("_span") <= n)
            either = lambda new, old: F.when(jumps, new).otherwise(F.col(old)).alias(old)
            jumped = chain.join(over, "up", "left").select("entity_id", either(F.col("_up"), "up"), "waits", either(composed(F.col("state"), F.col("_state")), "state"), either(F.col("span") + F.col("_span"), "span"))
            rest = rest.filter("waits > 1").unionByName(jumped)
        done.append(at.filter("waits = 0").select("entity_id", "state"))
        if len(done) > TOGETHER:
            done = [written(reduce(DataFrame.unionByName, done), f"{folder}/{next(rounds)}")]
        at = written(rest.unionByName(last), f"{folder}/{next(rounds)}")
    held = at.groupBy("entity_id").agg(F.first("state").alias("state")).withColumn("settled", F.lit(False))
    out = cut(reduce(DataFrame.unionByName, [d.withColumn("settled", F.lit(True)) for d in done], held))
    removed(states.sparkSession, folder)
    return out


def _both(a: Column, b: Column) -> Column:
    """Their sum, where a null adds nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def contributing(topology: DataFrame, nodes: DataFrame, amount: str) -> DataFrame:
    """entity_id with the sum of amount over itself and all that drains to it, in about log(n) rounds for a tree.

    Repeated nodes add up, each row of topology passes its sum on, edges with a null end don't count. An entity of edges
    only has a row if a node drains to it. What a cycle holds, on it or below it, has a null sum.
    """
    edges = topology.select(F.col("upstream_id").alias("up"), F.col("downstream_id").alias("down")).dropna()
    own = nodes.filter("entity_id is not null").groupBy("entity_id").agg(F.sum(amount).alias("sum"), F.lit(True).alias("known"))
    passing = edges.select(F.col("up").alias("entity_id")).union(edges.select("down")).distinct().join(own, "entity_id", "left_anti")
    every = own.unionByName(passing.withColumn("known", F.lit(False)), allowMissingColumns=True)
    kind = every.schema["sum"].dataType
    add = lambda s, x: F.struct(_both(s["sum"], x["sum"]).cast(kind).alias("sum"), (s["known"] | x["known"]).alias("known"))

    def gathered(arrived: DataFrame) -> DataFrame:
        g = F.struct(F.sum("x.sum").cast(kind).alias("sum"), F.max("x.known").alias("known"))
        return arrived.groupBy("entity_id").agg(g.alias("g"), F.count("*").alias("n"), F.first("state").alias("state"), F.first("waits").alias("waits"))

    out = contracted(edges, every.select("entity_id", F.struct("sum", "known").alias("state")), gathered, add, add)
    return out.filter("state.known").select("entity_id", F.when(F.col("settled"), F.col("state.sum")).alias("contributing"))


def strahler(topology: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stream order: 1 at sources; the largest inflow's, one more where two or more inflows have it.

    Repeated edges count once, edges with a null end not at all; entities of edges only are ordered but not returned.
    What a cycle holds, on it or below it, gets order 1 and cycle_broken.

    The state is most (the largest order of the inflows that are in), twice (two have it) and the order as a function of
    one more inflow's order x: low where x < at, high where at <= x <= high, else x. Such functions compose to such
    functions, and low is the order without a further inflow.
    """
    edges = topology.select(F.col("upstream_id").alias("up"), F.col("downstream_id").alias("down")).dropna().distinct()
    ids = nodes.select("entity_id").dropna().distinct()
    every = ids.union(edges.select("up")).union(edges.select("down")).distinct()
    # without inflows the order is 1, with a further one it is that one's
    fresh = F.struct(F.lit(0).alias("most"), F.lit(False).alias("twice"), F.lit(1).alias("at"), F.lit(1).alias("low"), F.lit(1).alias("high"))

    def gathered(arrived: DataFrame) -> DataFrame:
        orders = arrived.groupBy("entity_id", F.col("x.low").alias("o")).agg(F.count("*").alias("n"), F.first("state").alias("state"), F.first("waits").alias("waits"))
        largest = F.max(F.struct("o", (F.col("n") > 1).alias("twice")))
        return orders.groupBy("entity_id").agg(largest.alias("g"), F.sum("n").alias("n"), F.first("state").alias("state"), F.first("waits").alias("waits"))

    def merged(s: Column, g: Column) -> Column:
        most = F.greatest(s["most"], g["o"])
        twice = F.when(s["most"] == g["o"], True).when(s["most"] > g["o"], s["twice"]).otherwise(g["twice"])
        least = most + twice.cast("int")
        return F.struct(most.alias("most"), twice.alias("twice"), least.alias("at"), least.alias("low"), (most + 1).alias("high"))

    def composed(s: Column, x: Column) -> Column:
        """s after x."""
        of = lambda v: F.when(v < s["at"], s["low"]).otherwise(F.greatest(v, s["high"]))
        over = x["high"] < s["at"]
        at, high = F.when(over, s["at"]).otherwise(x["at"]), F.when(over, s["high"]).otherwise(F.greatest(x["high"], s["high"]))
        return F.struct(s["most"].alias("most"), s["twice"].alias("twice"), at.alias("at"), of(x["low"]).alias("low"), high.alias("high"))

    out = ids.join(contracted(edges, every.select("entity_id", fresh.alias("state")), gathered, merged, composed), "entity_id")
    return out.select("entity_id", F.when(F.col("settled"), F.col("state.low")).otherwise(1).alias("strahler_order"), (~F.col("settled")).alias("cycle_broken"))


def not_monotone(topology: DataFrame, areas: DataFrame, absolute: float = 0.01, relative: float = 0.02) -> DataFrame:
    """Edges along which the area shrinks by more than the larger of the two tolerances."""
    a = areas.select(F.col("entity_id").alias("upstream_id"), F.col("catchment_area_km2").alias("up_area"))
    b = areas.select(F.col("entity_id").alias("downstream_id"), F.col("catchment_area_km2").alias("down_area"))
    return topology.join(a, "upstream_id").join(b, "downstream_id").filter(F.col("up_area") - F.col("down_area") > F.greatest(F.lit(absolute), F.lit(relative) * F.col("up_area")))


def links(nodes: DataFrame) -> DataFrame:
    """Ways cut at nodes that are shared, repeated or ends. nodes: way_id, pos, node_id, x, y -> way_id, link, path, length."""
    uses = nodes.groupBy("node_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("way_id").orderBy("pos")
    at = nodes.join(uses, "node_id").withColumn("_x", F.lag("x").over(w)).withColumn("_y", F.lag("y").over(w)).withColumn("_cut", (F.col("n") > 1).cast("int"))
    at = at.withColumn("step", F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)))
    # a step belongs to the link that the cuts before its end have opened
    at = at.withColumn("link", F.coalesce(F.sum("_cut").over(w.rowsBetween(1 - 2**31, -1)), F.lit(0)))
    return at.filter("step is not null").groupBy("way_id", "link").agg(F.sum("step").alias("length"), F.count("*").alias("n_steps"), F.min_by("pos", "pos").alias("from_pos"), F.max("pos").alias("to_pos")).filter("length > 0")


def pieces(lines: DataFrame, target: float = 350.0, most: float = 500.0, least: float = 200.0) -> DataFrame:
    """n equal pieces of each line: rounded length over target, more where pieces would be too long."""
    n = F.greatest(F.lit(1), F.round(F.col("length") / target), F.ceil(F.col("length") / most)).cast("int")
    out = lines.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    step = F.col("length") / F.col("n_pieces")
    return out.withColumns({"from_m": F.col("piece") * step, "to_m": (F.col("piece") + 1) * step, "flag": F.when(step < least, "SHORT_LINK")})
