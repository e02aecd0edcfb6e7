"""Control-flow replay of a log on a Petri net.

The net is a small object; the log is not. Equal traces are replayed once: one
case stands for each variant, its events are sorted inside a partition and
streamed through a small state machine batch by batch, so a trace is never held
in memory whole. A trace that is much longer than a partition's share of the events
is cut into blocks: each block is read from every marking that can be reached at all,
which gives a table from the marking before it to the one after it; the tables are
composed in order, and then every block is replayed from its true start, on its own.
All counting is done by Spark on what the replay emits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import ordered
from ..functions.columns import END, ratio
from ..functions.ordered import along, in_blocks, latest_before
from ..functions.ship import ship
from ..functions.staging import staged
from .shape import bucket, fingerprints, first_of_case, order_of, positions


@dataclass(frozen=True)
class Transition:
    name: str
    label: str | None
    takes: tuple[tuple[str, int], ...]
    gives: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class PetriNet:
    """Transitions ordered by name; markings are sorted (place, tokens) tuples."""
    transitions: tuple[Transition, ...]
    initial: tuple[tuple[str, int], ...]
    final: tuple[tuple[str, int], ...]

    @staticmethod
    def build(transitions, initial, final) -> "PetriNet":
        """``transitions``: (name, label or None, {place: n} taken, {place: n} given)."""
        ts = tuple(Transition(n, lab, tuple(sorted(a.items())), tuple(sorted(b.items())))
                   for n, lab, a, b in sorted(transitions, key=lambda t: t[0]))
        return PetriNet(ts, tuple(sorted(initial.items())), tuple(sorted(final.items())))

    @staticmethod
    def from_json(text: str) -> "PetriNet":
        d = json.loads(text)
        return PetriNet.build([(t["name"], t.get("label"), t["takes"], t["gives"])
                               for t in d["transitions"]], d["initial"], d["final"])

    def labels(self) -> list[str]:
        return sorted({t.label for t in self.transitions if t.label is not None})


class Player:
    """Firing rules on one net, with answers per marking remembered by the worker."""

    def __init__(self, net: PetriNet):
        self.net = net
        self._front: dict = {}
        self._stop: dict = {}

    def fire(self, marking, t: Transition):
        m = dict(marking)
        for p, n in t.takes:
            m[p] = m.get(p, 0) - n
        for p, n in t.gives:
            m[p] = m.get(p, 0) + n
        return tuple(sorted((p, n) for p, n in m.items() if n))

    def enabled(self, marking):
        m = dict(marking)
        return [t for t in self.net.transitions if all(m.get(p, 0) >= n for p, n in t.takes)]

    def frontier(self, marking) -> dict:
        """Visible label -> (marking where it is enabled, tokens moved by silent steps)."""
        if marking in self._front:
            return self._front[marking]
        found: dict = {}
        seen: set = set()
        stack = [(marking, (0, 0))]
        while stack:
            m, (c, p) = stack.pop()
            if m in seen:
                continue
            seen.add(m)
            on = self.enabled(m)
            for t in on:
                if t.label is not None:
                    found.setdefault(t.label, (m, (c, p)))
            for t in reversed(on):
                if t.label is None:
                    stack.append((self.fire(m, t), (c + sum(n for _, n in t.takes),
                                                    p + sum(n for _, n in t.gives))))
        self._front[marking] = found
        return found

    def stop_cost(self, marking):
        """Tokens moved by silent steps to the final marking, or None if out of reach."""
        if marking in self._stop:
            return self._stop[marking]
        seen, queue, answer = {marking}, [(marking, (0, 0))], None
        for m, (c, p) in queue:
            if m == self.net.final:
                answer = (c, p)
                break
            for t in self.enabled(m):
                if t.label is None:
                    nxt = self.fire(m, t)
                    if nxt not in seen:
                        seen.add(nxt)
                        queue.append((nxt, (c + sum(n for _, n in t.takes),
                                            p + sum(n for _, n in t.gives))))
        self._stop[marking] = answer
        return answer

    def step(self, marking, label):
        """(kind, marking after, taken, given, missing, surplus) for one event.

        kind: legal, repaired (fired with missing tokens added) or unknown (no such
        label; the marking stays). After a repair a place keeps one token at most;
        the surplus is reported.
        """
        on = self.frontier(marking).get(label)
        if on is not None:
            m, (c, p) = on
            t = next(t for t in self.enabled(m) if t.label == label)
            return ("legal", self.fire(m, t), c + sum(n for _, n in t.takes),
                    p + sum(n for _, n in t.gives), 0, 0)
        best = None
        for t in self.net.transitions:
            if t.label != label:
                continue
            have = dict(marking)
            lack = sum(max(0, n - have.get(p, 0)) for p, n in t.takes)
            if best is None or lack < best[0]:
                best = (lack, t)
        if best is None:
            return "unknown", marking, 0, 0, 0, 0
        lack, t = best
        m = dict(marking)
        for p, n in t.takes:
            m[p] = max(m.get(p, 0), n)
        after = dict(self.fire(tuple(sorted(m.items())), t))
        surplus = sum(max(0, n - 1) for n in after.values())
        clean = tuple(sorted((p, min(n, 1)) for p, n in after.items() if n))
        return ("repaired", clean, sum(n for _, n in t.takes), sum(n for _, n in t.gives),
                lack, surplus)


STEP_SCHEMA = ("example_case string, position long, activity string, kind string, "
               "dp_key string, can_end boolean, fitting boolean, prefix string, "
               "taken long, given long, missing long, surplus long, remaining long")


#: Markings that a block is read from, at most; a net with more replays a long trace in one task.
MARKINGS = 1024
_PRIME = (1 << 127) - 1
_BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835


class Prefix:
    """What a prefix of labels is known by: a polynomial, so that blocks can be put together."""

    def __init__(self):
        self._code: dict = {}

    def add(self, h: int, label) -> int:
        x = self._code.get(label)
        if x is None:
            x = self._code[label] = int(hashlib.md5(str(label).encode()).hexdigest(), 16) % _PRIME
        return (h * _BASE + x + 1) % _PRIME

    @staticmethod
    def join(h: int, n: int, block: int) -> int:
        """The prefix ``h`` followed by ``n`` labels that alone give ``block``."""
        return (h * pow(_BASE, n, _PRIME) + block) % _PRIME


def reachable(net: PetriNet, limit: int = MARKINGS) -> list | None:
    """All markings that replay can be in before an event, the initial one first; None if
    there are more than ``limit``."""
    player, labels = Player(net), net.labels()
    found = {net.initial: None}
    queue = [net.initial]
    for m in queue:
        for label in labels:
            after = player.step(m, label)[1]
            if after not in found:
                found[after] = None
                queue.append(after)
                if len(found) > limit:
                    return None
    return queue


def _streamed(net: PetriNet, marks: list | None = None):
    """mapInPandas function: events sorted by case in, one row per event and per end out.

    With ``marks`` the rows are sorted by case and block (``b``) and say how their block
    starts: ``at`` (a number in ``marks``), ``pos``, ``fits``, ``prefix``, and whether the
    trace ends with it (``last``).
    """
    names = [f.split()[0] for f in STEP_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, chain = Player(net), Prefix()
        now = case = marking = None
        pos, fits, prefix, last = 0, True, 0, True
        start = dict(net.initial)

        def close(out):
            front = player.frontier(marking)
            cost = player.stop_cost(marking)
            want, have = dict(net.final), dict(marking)
            if cost is not None:
                lack, left, c, p = 0, 0, cost[0], cost[1]
            else:
                lack = sum(max(0, n - have.get(q, 0)) for q, n in want.items())
                left = sum(max(0, n - want.get(q, 0)) for q, n in have.items())
                c = p = 0
            out.append((case, pos, END, "end", " | ".join(sorted(front)), cost is not None, fits,
                        f"{prefix:x}", c + sum(want.values()), p + sum(start.values()), lack, 0, left))

        for batch in batches:
            out: list = []
            cut = None if marks is None else batch["b"].tolist()
            for r, (c, label) in enumerate(zip(batch["case_id"], batch["activity"])):
                key = c if cut is None else (c, cut[r])
                if key != now:
                    if now is not None and last:
                        close(out)
                    now, case = key, c
                    if cut is None:
                        marking, pos, fits, prefix = net.initial, 0, True, 0
                    else:
                        x = batch.iloc[r]
                        marking, pos, fits = marks[int(x["at"])], int(x["pos"]), bool(x["fits"])
                        prefix, last = int(x["prefix"], 16), bool(x["last"])
                front = player.frontier(marking)
                can_end = player.stop_cost(marking) is not None
                kind, after, taken, given, lack, surplus = player.step(marking, label)
                out.append((case, pos, label, kind, " | ".join(sorted(front)), can_end, fits,
                            f"{prefix:x}", taken, given, lack, surplus, 0))
                marking, pos = after, pos + 1
                fits = fits and kind == "legal"
                prefix = chain.add(prefix, label)
            yield pd.DataFrame(out, columns=names)
        if now is not None and last:
            out = []
            close(out)
            yield pd.DataFrame(out, columns=names)
    return run


_TABLE = "case_id string, b int, n long, prefix string, after array<int>, legal array<boolean>"
_START = "case_id string, b int, at int, pos long, fits boolean, prefix string, last boolean"


def _tabled(net: PetriNet, marks: list):
    """mapInPandas function: per block, where each marking leads and if all its steps are legal."""
    number = {m: i for i, m in enumerate(marks)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, chain = Player(net), Prefix()
        moves: dict = {}
        now, n, prefix, legal = None, 0, 0, []
        where: dict = {}        # marking now -> the markings that led here

        def row():
            after = [0] * len(marks)
            for m, first in where.items():
                for i in first:
                    after[i] = m
            return (*now, n, f"{prefix:x}", after, list(legal))
        for batch in batches:
            out = []
            for c, b, label in zip(batch["case_id"], batch["b"].tolist(), batch["activity"]):
                if (c, b) != now:
                    if now is not None:
                        out.append(row())
                    now, n, prefix, legal = (c, b), 0, 0, [True] * len(marks)
                    where = {i: [i] for i in range(len(marks))}
                then: dict = {}
                for m, first in where.items():
                    if (m, label) not in moves:
                        kind, after, *_ = player.step(marks[m], label)
                        moves[m, label] = number[after], kind == "legal"
                    to, ok = moves[m, label]
                    if not ok:
                        for i in first:
                            legal[i] = False
                    if to in then:      # from here on these go the same way
                        then[to] = then[to] + first
                    else:
                        then[to] = first
                where, n, prefix = then, n + 1, chain.add(prefix, label)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _TABLE.split(", ")])
        if now is not None:
            yield pd.DataFrame([row()], columns=[f.split()[0] for f in _TABLE.split(", ")])
    return run


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """Tables of one trace's blocks: the state each block starts in."""
    blocks = blocks.sort_values("b")
    at, pos, fits, prefix, out = 0, 0, True, 0, []
    for i, x in enumerate(blocks.itertuples()):
        out.append((x.case_id, x.b, at, pos, fits, f"{prefix:x}", i == len(blocks) - 1))
        fits = fits and bool(x.legal[at])
        at, pos, prefix = int(x.after[at]), pos + int(x.n), Prefix.join(prefix, int(x.n), int(x.prefix, 16))
    return pd.DataFrame(out, columns=[f.split()[0] for f in _START.split(", ")])


def _in_pieces(rows: DataFrame, net: PetriNet, marks: list, blocks: int) -> DataFrame:
    """Steps of long traces, block by block."""
    order = order_of(rows)
    cut = in_blocks(rows.select("case_id", "activity", *order), ["case_id"], order, blocks) \
        .withColumnRenamed("__b", "b")

    def dealt(d):
        return d.repartition("case_id", "b").sortWithinPartitions("case_id", "b", *order).drop(*order)
    # a block and a trace give one row, so these tables have no more rows than two a block
    tables = dealt(cut).mapInPandas(_tabled(net, marks), _TABLE)
    starts = staged(tables.groupBy("case_id").applyInPandas(_composed, _START))
    return dealt(cut.join(F.broadcast(starts), ["case_id", "b"])).mapInPandas(
        _streamed(net, marks), STEP_SCHEMA)


def variant_cases(df: DataFrame) -> DataFrame:
    """case_id, example_case: the smallest case id with the same trace."""
    fp = fingerprints(df)
    v = fp.groupBy("fp1", "fp2", "length").agg(F.min("case_id").alias("example_case"))
    return fp.join(v, ["fp1", "fp2", "length"]).select("case_id", "example_case")


def replay(df: DataFrame, net: PetriNet) -> DataFrame:
    """Replay steps of one case per variant, with ``weight`` = cases of the variant.

    One row per event and one (kind = end) per trace. A trace with over twice a
    partition's share of the events is replayed in blocks, with the same steps. That
    needs the net's reachable markings; with more than ``MARKINGS`` of them one task
    replays such a trace, in constant memory.
    """
    spark = df.sparkSession
    ship(spark)
    fp = staged(fingerprints(df).groupBy("fp1", "fp2", "length").agg(
        F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("weight")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = fp.agg(F.sum("length")).first()[0] or 0
    block = max(ordered.LEAST, total // n)
    # no more than n / 2 traces can be that long
    long = fp.filter(F.col("length") > 2 * block).select("case_id", "length").collect()
    marks = reachable(net) if long else None
    short = fp if marks is None else fp.filter(F.col("length") <= 2 * block)
    shown = df.join(short.select("case_id"), "case_id", "left_semi")
    rows = shown.repartition("case_id").sortWithinPartitions("case_id", *order_of(df))
    steps = rows.select("case_id", "activity").mapInPandas(_streamed(net), STEP_SCHEMA)
    if marks is not None:
        blocks = min(n, -(-sum(r["length"] for r in long) // block))
        whole = df.join(F.broadcast(fp.filter(F.col("length") > 2 * block).select("case_id")), "case_id", "left_semi")
        steps = steps.unionByName(_in_pieces(whole, net, marks, blocks))
    return steps.join(fp.select(F.col("case_id").alias("example_case"), "weight"), "example_case")


def trace_fitness(steps: DataFrame) -> DataFrame:
    """example_case, weight, taken, given, missing, remaining, fits, fitness."""
    t = steps.groupBy("example_case", "weight").agg(
        F.sum("taken").alias("taken"), F.sum("given").alias("given"),
        F.sum("missing").alias("missing"),
        F.sum(F.col("remaining") + F.col("surplus")).alias("remaining"),
        F.max((F.col("kind") == "unknown").cast("int")).alias("__u"))
    t = t.withColumn("fits", (F.col("missing") == 0) & (F.col("remaining") == 0)
                     & (F.col("__u") == 0)).drop("__u")
    return t.withColumn("fitness", 0.5 * (1.0 - ratio("missing", "taken"))
                        + 0.5 * (1.0 - ratio("remaining", "given")))


def fitness(steps: DataFrame) -> DataFrame:
    """One row: share of fitting traces, mean trace fitness, fitness of the whole log."""
    t, w = trace_fitness(steps), F.col("weight")
    n = F.sum("weight")
    return t.agg(
        ratio(F.sum(F.when(F.col("fits"), w).otherwise(0)) * 100.0, n).alias("pct_fitting"),
        ratio(F.sum(F.col("fitness") * w), n).alias("average_trace_fitness"),
        (0.5 * (1.0 - ratio(F.sum(F.col("missing") * w), F.sum(F.col("taken") * w)))
         + 0.5 * (1.0 - ratio(F.sum(F.col("remaining") * w), F.sum(F.col("given") * w))))
        .alias("log_fitness"))


def precision(steps: DataFrame) -> DataFrame:
    """One row: 1 - escaping / enabled edges over the fitting prefixes of the log."""
    s = steps.filter((F.col("kind") != "end") & F.col("fitting"))
    p = s.groupBy("prefix", "dp_key", "activity").agg(F.sum("weight").alias("w"))
    p = p.withColumn("known", F.array_contains(F.split("dp_key", " \\| "), F.col("activity")))
    p = p.groupBy("prefix", "dp_key").agg(
        F.sum("w").alias("w"), F.sum(F.col("known").cast("int")).alias("used"))
    n = F.when(F.col("dp_key") == "", 0).otherwise(F.size(F.split("dp_key", " \\| ")))
    p = p.withColumn("n", n)
    return p.agg((1.0 - ratio(F.sum((F.col("n") - F.col("used")) * F.col("w")),
                              F.sum(F.col("n") * F.col("w")))).alias("precision"))


def replay_summary(steps: DataFrame) -> DataFrame:
    """One row: perfect and repaired cases, repaired and unknown events, missing tokens."""
    t = steps.filter("kind <> 'end'").groupBy("example_case", "weight").agg(
        F.sum((F.col("kind") == "repaired").cast("int")).alias("r"),
        F.sum((F.col("kind") == "unknown").cast("int")).alias("u"), F.sum("missing").alias("m"))
    w, bad = F.col("weight"), (F.col("r") + F.col("u")) > 0
    return t.agg(F.sum(F.when(~bad, w).otherwise(0)).alias("n_perfect"),
                 F.sum(F.when(bad, w).otherwise(0)).alias("n_repaired"),
                 F.sum(F.col("r") * w).alias("n_repair_events"),
                 F.sum(F.col("m") * w).alias("n_missing_tokens"),
                 F.sum(F.col("u") * w).alias("n_unknown_events"))


def decisions(steps: DataFrame) -> DataFrame:
    """Recorded decisions: example_case, position, dp_key, visit, label, weight.

    A legal step with more than one option (ending counts as one), and stopping
    where going on was possible.
    """
    options = F.when(F.col("dp_key") == "", 0).otherwise(F.size(F.split("dp_key", " \\| ")))
    going = (F.col("kind") == "legal") & (options + F.col("can_end").cast("int") > 1)
    stop = (F.col("kind") == "end") & (options > 0) & F.col("can_end")
    d = steps.filter(going | stop)
    d = along(d, ["example_case", "dp_key"], ["position"], {"__v": _nth()})
    return d.select("example_case", "position", "dp_key", (F.col("__v") + 1).alias("visit"),
                    F.col("activity").alias("label"), "weight", "can_end")


def _nth():
    from ..functions.ordered import nth
    return nth()


def decision_counts(made: DataFrame, cap: int = 5) -> DataFrame:
    """dp_key, bucket (visit bucket, or all), label, n."""
    b = F.explode(F.array(bucket("visit", cap), F.lit("all")))
    return made.select("dp_key", b.alias("bucket"), "label", "weight").groupBy(
        "dp_key", "bucket", "label").agg(F.sum("weight").alias("n"))


def end_rate(counts: DataFrame) -> DataFrame:
    """One row: share of stopping over all decision points and visit buckets."""
    c = counts.filter("bucket <> 'all'")
    return c.agg(F.coalesce(ratio(F.sum(F.when(F.col("label") == END, F.col("n")).otherwise(0)),
                                  F.sum("n")), F.lit(0.0)).alias("end_rate"))


def decision_probabilities(counts: DataFrame, min_samples: int = 30,
                           end_weight: float = 0.0) -> DataFrame:
    """dp_key, bucket, label, p. Sparse buckets are left out.

    ``end_weight`` > 0 draws the share of stopping towards the pooled rate; the
    other labels keep their proportions.
    """
    w = Window.partitionBy("dp_key", "bucket")
    stop = F.col("label") == END
    c = counts.withColumns({
        "__t": F.sum("n").over(w),
        "__e": F.sum(F.when(stop, F.col("n")).otherwise(0)).over(w)})
    c = c.filter((F.col("bucket") == "all") | (F.col("__t") >= min_samples))
    if end_weight <= 0:
        return c.select("dp_key", "bucket", "label", ratio("n", "__t").alias("p"))
    prior = end_rate(counts).scalar()
    # a bucket that never stopped still gets its share of the pooled rate
    keys = c.groupBy("dp_key", "bucket").agg(F.max("__t").alias("__t"), F.max("__e").alias("__e"))
    p_end = (F.col("__e") + end_weight * prior) / (F.col("__t") + end_weight)
    ends = keys.select("dp_key", "bucket", F.lit(END).alias("label"), p_end.alias("p")).filter("p > 0")
    rest = c.filter(~stop).withColumn("p", (1.0 - p_end) * ratio("n", F.col("__t") - F.col("__e")))
    return rest.select("dp_key", "bucket", "label", "p").unionByName(ends)


def decision_examples(df: DataFrame, net: PetriNet, fixed: list[str], offer: list[str],
                      offer_activity: str = "O_Create Offer") -> DataFrame:
    """Training rows: dp_key, label, case_start and the attributes known before the step.

    Each variant is replayed once; its decisions meet every case of the variant on
    the position. Offer attributes carry the last offer strictly before the step.
    """
    made = decisions(replay(df, net)).filter(
        (F.col("label") != END) & F.col("dp_key").contains(" | ")).select(
        "example_case", "position", "dp_key", "label")
    is_offer = F.col("activity") == offer_activity
    ev = positions(df)
    ev = along(ev, ["case_id"], order_of(df), {"__o": latest_before(
        F.when(is_offer, F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                    for c in offer])))})
    begin = first_of_case(df, ["timestamp", *fixed]).withColumnRenamed("timestamp", "case_start")
    j = (ev.select("case_id", "position", "__o").join(variant_cases(df), "case_id")
         .join(made, ["example_case", "position"]).join(begin, "case_id"))
    return j.select("case_id", "position", "dp_key", "label", "case_start", *fixed,
                    F.col("__o").isNotNull().cast("int").alias("has_offer"),
                    *[F.coalesce(F.col(f"__o.{c}"), F.lit(0.0)).alias(c) for c in offer])
