"""Services as a table: discovery, health, change detection, and choice of an instance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalar import matches, ring_position, significant_change

#: Fixed values of the usual score.
REGION_BOOST, ZONE_BOOST = 1.1, 1.05
TARGET_LATENCY_MS = 50.0
IMPORTANCE = {"cpu": 1.0, "latency": 1.0, "memory": 0.0, "inflight": 0.0, "queue": 0.0, "errorRate": 0.0}


def active(instances: DataFrame, now_ms: int, timeout_ms: int, conditions: dict[str, str] | None = None, heartbeat: str = "heartbeat_ms", fields: str = "metadata") -> DataFrame:
    """Instances heard of within the timeout whose fields meet all conditions (``"weight:>=": "80"``)."""
    out = instances.where(F.col(heartbeat) >= now_ms - timeout_ms)
    return out.where(matches(fields, conditions)) if conditions else out


def healthy(instances: DataFrame) -> DataFrame:
    return instances.where("enabled and healthy")


def expired(instances: DataFrame, now_ms: int, timeout_ms: int, heartbeat: str = "heartbeat_ms") -> DataFrame:
    return instances.where(F.col(heartbeat) < now_ms - timeout_ms)


def service_details(instances: DataFrame, service: str = "service") -> DataFrame:
    return instances.groupBy(service).agg(F.count("*").alias("instances"), F.count_if(F.col("enabled") & F.col("healthy")).alias("healthy"), F.max("heartbeat_ms").alias("last_heartbeat_ms"))


def changes_marked(df: DataFrame, key: str, value: str, kind: str, threshold: float = 0.0, seq: str = "seq") -> DataFrame:
    """Whether each value differs enough from the key's one before."""
    return df.withColumn("significant", significant_change(F.lag(value).over(Window.partitionBy(key).orderBy(seq)), F.col(value), kind, threshold))


def heartbeat_decision(health_flipped: Column, metrics_changed: Column, since_update_ms: Column, interval_ms: int, since_heartbeat_ms: Column, heartbeat_ms: int) -> Column:
    """What a beat sends: metrics if health flipped, they changed or their interval is over; else the beat alone if that is due."""
    return F.when(health_flipped | metrics_changed | (since_update_ms >= interval_ms), "METRICS_UPDATE").when(since_heartbeat_ms >= heartbeat_ms, "HEARTBEAT_ONLY").otherwise("NO_UPDATE")


def load_score(weight: Column, metrics: dict[str, Column], importance: dict[str, float] | None = None, limits: dict[str, float] | None = None, near: list[tuple[Column, str, float]] = (), weight_factor: float = 1.0, target_latency_ms: float = TARGET_LATENCY_MS) -> Column:
    """Greater is better; null for instances with a metric beyond its limit.

    ``metrics``: columns by the names of ``IMPORTANCE``, which is the exponent of each one's share. Percentages
    count as what is left of 100, latency against its target, lengths of queues inversely. A metric that is null or
    negative says nothing. ``near``: (place, the preferred one, boost).
    """
    say = IMPORTANCE | (importance or {})
    score = 1 + weight_factor * F.log10(F.greatest(weight, F.lit(1)) + 1)
    for place, preferred, boost in near:
        score = score * F.when(place == preferred, boost).otherwise(1.0)
    within = F.lit(True)
    for name, column in metrics.items():
        x = column.cast("double")
        if name == "latency":
            target = max(1.0, target_latency_ms)
            share = target / (target + x)
        elif name in ("inflight", "queue"):
            share = 1 / (1 + x)
        else:
            share = 1 - F.least(x, F.lit(100.0)) / 100
        if say[name] > 0:
            score = score * F.when(x >= 0, F.pow(share, F.lit(say[name]))).otherwise(1.0)
        most = (limits or {}).get(name, -1)
        if most >= 0:
            within = within & F.coalesce(x <= most, F.lit(True))
    return F.when(within, score)


def best(instances: DataFrame, service: str, score: Column, instance: str) -> DataFrame:
    """The instance of the greatest score by service, ties to the lesser name. Where all are excluded, the least name without a score."""
    scored = instances.withColumn("__s", score)
    first = F.min(F.struct(F.coalesce(-F.col("__s"), F.lit(float("inf"))), instance, "__s")).alias("__m")
    return scored.groupBy(service).agg(first).select(service, F.col(f"__m.{instance}").alias(instance), F.col("__m.__s").alias("score"))


def hash_ring(nodes: DataFrame, node: str, virtual_nodes: int = 128) -> DataFrame:
    """(position, node) of every virtual node."""
    return nodes.select(F.col(node).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("v")).select(ring_position(F.concat_ws("#", "node", "v")).alias("position"), "node")


def on_ring(keys: DataFrame, key: str, ring: DataFrame) -> DataFrame:
    """Each key's node: the first at or after its place, else the first of the ring.

    Ring and keys are dealt together by slots of the circle and walked downwards in each, the last node met being
    the next one; a slot's last keys get theirs from the next slot that has a node. Only a row a slot is broadcast.
    """
    slots, bits = 4096, 51  # a slot is the upper 12 of 63 bits
    marks = ring.groupBy(F.shiftright("position", bits).alias("slot")).agg(F.min(F.struct("position", "node")).alias("first"))
    every = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)  # at most ``slots`` rows
    frame = ring.sparkSession.range(slots).select(F.col("id").alias("slot")).join(F.broadcast(marks), "slot", "left")
    lowest = F.min("first").over(Window.partitionBy())
    beyond = frame.select(F.col("slot").alias("__slot"), F.coalesce(F.first("first", ignorenulls=True).over(every), lowest)["node"].alias("__beyond"))
    placed = keys.drop("node").withColumn("__p", ring_position(key)).where("__p is not null").withColumn("__key", F.lit(True))
    both = placed.unionByName(ring.select(F.col("position").alias("__p"), F.lit(False).alias("__key"), F.col("node").alias("__node")), allowMissingColumns=True)
    down = Window.partitionBy("__slot").orderBy(F.desc("__p"), "__key", F.desc("__node")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__slot", F.shiftright("__p", bits)).withColumn("__node", F.last("__node", ignorenulls=True).over(down)).where("__key")
    joined = met.join(F.broadcast(beyond), "__slot")
    return joined.withColumn("node", F.coalesce("__node", "__beyond")).drop("__p", "__slot", "__key", "__node", "__beyond")


def weighted_choice(instances: DataFrame, requests: DataFrame, service: str, weight: str, instance: str, draw: str) -> DataFrame:
    """Weighted random: a request's ``draw`` in [0, 1) falls into an instance's share of the summed weights; a weight counts as 1 at least.

    A service's line of weights is cut into as many pieces as it has instances. A share lies in the pieces it touches,
    fewer than twice as many in all, and a request meets only the shares in its own piece.
    """
    by, whole = Window.partitionBy(service).orderBy(instance), Window.partitionBy(service)
    shares = instances.withColumn("__w", F.greatest(F.col(weight), F.lit(1))).withColumn("__hi", F.sum("__w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__w").over(whole))
    shares = shares.withColumn("__width", F.col("__all") / F.count("*").over(whole)).select(service, instance, (F.col("__hi") - F.col("__w")).alias("__lo"), "__hi", "__width")

    def piece(at: Column) -> Column:
        return F.floor(at / F.col("__width")).cast("bigint")

    cut = shares.withColumn("__piece", F.explode(F.sequence(piece(F.col("__lo")), piece(F.col("__hi"))))).drop("__width")
    totals = instances.groupBy(service).agg(F.sum(F.greatest(F.col(weight), F.lit(1))).alias("__all"), F.count("*").alias("__n"))  # a row a service
    drawn = requests.join(F.broadcast(totals), service).withColumn("__at", F.col(draw) * F.col("__all")).withColumn("__width", F.col("__all") / F.col("__n")).withColumn("__piece", piece(F.col("__at")))
    found = drawn.drop("__all", "__n", "__width").join(cut, [service, "__piece"])
    return found.where((F.col("__at") >= F.col("__lo")) & (F.col("__at") < F.col("__hi"))).drop("__lo", "__hi", "__at", "__piece")


def _cycle(instances: pa.Table) -> pa.Table:
    """One cycle of smooth weighted round-robin over a service's (service, id, w): rows (service, k, id).

    Instances of one weight take turns in their order, so a weight's first in turn stands for all of them
    and a step costs as much as there are different weights.
    """
    instances = instances.sort_by([("id", "ascending"), ("w", "ascending")])
    w = instances.column("w").to_numpy()
    weights, of = np.unique(w, return_inverse=True)
    turns = [np.flatnonzero(of == d).tolist() for d in range(len(weights))]
    total, now, at = int(w.sum()), np.zeros(len(weights), np.int64), [0] * len(weights)
    picks = np.empty(total, np.int64)
    for k in range(total):
        now += weights
        d = min(np.flatnonzero(now == now.max()).tolist(), key=lambda d: turns[d][at[d]])
        picks[k] = turns[d][at[d]]
        at[d] += 1
        if at[d] == len(turns[d]):  # all of this weight have paid
            at[d] = 0
            now[d] -= total
    chosen = instances.select([0, 1]).take(pa.array(picks))
    return pa.table([chosen.column(0), pa.array(np.arange(total)), chosen.column(1)], names=["service", "k", "id"])


def round_robin(instances: DataFrame, requests: DataFrame, service: str, weight: str, instance: str, seq: str, slot: Column | None = None) -> DataFrame:
    """Smooth weighted round-robin: at each request all instances gain their weight (at least 1), the largest is chosen and pays the sum.

    After as many requests as the weights' sum all stand at their beginning, so one cycle is made
    for each service (its length is the sum of its weights) and requests look it up by number.
    ``slot``, a long that never falls as ``seq`` goes on, deals a service's requests: only the count of each
    slot is carried on, so no task numbers all requests of a service.
    """
    own = instances.select(F.col(service).alias("service"), F.col(instance).alias("id"), F.greatest(F.col(weight).cast("bigint"), F.lit(1)).alias("w"))
    kinds = own.schema
    slots = own.groupBy("service").applyInArrow(_cycle, T.StructType([kinds["service"], T.StructField("k", T.LongType()), kinds["id"]]))
    slots = slots.select(F.col("service").alias(service), F.col("k").alias("__k"), F.col("id").alias(instance))
    lengths = own.groupBy(F.col("service").alias(service)).agg(F.sum("w").alias("__n"))  # a row a service
    if slot is None:
        numbered = requests.withColumn("__r", F.row_number().over(Window.partitionBy(service).orderBy(seq)) - 1)
    else:
        placed = requests.withColumn("__slot", F.coalesce(slot.cast("bigint"), F.lit(-(2**62))))
        before = F.sum("__of").over(Window.partitionBy(service).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
        counts = placed.groupBy(service, "__slot").agg(F.count("*").alias("__of")).select(service, "__slot", F.coalesce(before, F.lit(0)).alias("__before"))
        here = F.row_number().over(Window.partitionBy(service, "__slot").orderBy(seq)) - 1
        numbered = placed.withColumn("__r", here).join(counts, [service, "__slot"]).withColumn("__r", F.col("__r") + F.col("__before")).drop("__slot", "__before")
    return numbered.join(F.broadcast(lengths), service).withColumn("__k", F.pmod(F.col("__r").cast("bigint"), "__n")).join(slots, [service, "__k"]).drop("__k", "__r", "__n")
