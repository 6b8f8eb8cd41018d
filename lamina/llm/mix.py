"""Mixing sources to target weights by balanced sampling (problem 8).

Each source gives every document the same expected number of copies: as many whole copies as fit, and
one more with an inclusion probability. The cube method decides the further copies: probabilities move
along the null space of the two balancing constraints, the number of documents and the number of
tokens, until each is 0 or 1. Every partition does so for its own rows and passes on at most two
undecided documents a source; these meet again in ever fewer partitions, and the last two are landed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.encode import count_tokens
from lamina.session import cut_lineage, ship_package, spread

#: Partitions whose undecided documents meet in one, round by round.
FAN_IN = 64
EPS = 1e-9


def _move(units: list[list], vector: list[float], rng: random.Random) -> None:
    """One step of the flight: along ``vector`` or against it, to the nearest face of the cube."""
    up = down = float("inf")
    for unit, v in zip(units, vector):
        if v > EPS:
            up, down = min(up, (1 - unit[3]) / v), min(down, unit[3] / v)
        elif v < -EPS:
            up, down = min(up, unit[3] / -v), min(down, (1 - unit[3]) / -v)
    by = up if rng.random() * (up + down) < down else -down
    for unit, v in zip(units, vector):
        unit[3] = min(1.0, max(0.0, unit[3] + by * v))


def _decided(p: float) -> bool:
    return p < 1e-7 or p > 1 - 1e-7


class Flight:
    """Undecided documents of one source, at most two between calls."""

    def __init__(self, seed: str) -> None:
        self.rng, self.open = random.Random(seed), []

    def take(self, unit: list) -> list[list]:
        """Add ``[source, doc_id, n_tokens, p]``; gives the units decided thereby."""
        self.open.append(unit)
        if len(self.open) < 3 and not _decided(unit[3]):
            return []
        if len(self.open) == 3:
            a, b, c = (u[2] for u in self.open)
            # (1, 1, 1) and (a, b, c) are both at right angles to this; equal sizes leave one constraint
            vector = [float(c - b), float(a - c), float(b - a)] if not a == b == c else [1.0, -1.0, 0.0]
            scale = max(map(abs, vector))
            _move(self.open, [v / scale for v in vector], self.rng)
        done = [u for u in self.open if _decided(u[3])]
        self.open = [u for u in self.open if not _decided(u[3])]
        return done

    def land(self) -> list[list]:
        """Decide the rest: first keeping the number of documents, then by chance."""
        if len(self.open) == 2:
            _move(self.open, [1.0, -1.0], self.rng)
        for u in self.open:
            if not _decided(u[3]):
                u[3] = 1.0 if self.rng.random() < u[3] else 0.0
        done, self.open = self.open, []
        return done


#: Ids travel as strings, which keep nulls.
SCHEMA = "source string, doc_id string, n_tokens long, p double, part int"


def _fly(seed: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        flights: dict[str, Flight] = {}
        for batch in batches:
            done: list[list] = []
            for unit in batch[["source", "doc_id", "n_tokens", "p"]].itertuples(index=False, name=None):
                flight = flights.get(unit[0])
                if flight is None:
                    flight = flights[unit[0]] = Flight(f"{seed}/{part}/{unit[0]}")
                done += flight.take(list(unit))
            yield pd.DataFrame(done, columns=["source", "doc_id", "n_tokens", "p"]).assign(part=part).astype({"doc_id": object, "n_tokens": "int64", "p": "float64"})
        rest = [u for f in flights.values() for u in (f.land() if last else f.open)]
        yield pd.DataFrame(rest, columns=["source", "doc_id", "n_tokens", "p"]).assign(part=part).astype({"doc_id": object, "n_tokens": "int64", "p": "float64"})

    return run


def balanced_sample(units: DataFrame, seed: int = 7) -> DataFrame:
    """``source, doc_id, n_tokens, p`` with each ``p`` moved to 0 or 1, balanced within each source.

    Rows with ``p`` at 0 or 1 come back as they are. Repeated rows are units of their own.
    """
    flown = cut_lineage(units.mapInPandas(_fly(seed, False), SCHEMA))
    undecided = (F.col("p") >= 1e-7) & (F.col("p") <= 1 - 1e-7)
    decided, parts = flown.filter(~undecided), max(1, flown.rdd.getNumPartitions())
    rest = flown.filter(undecided)
    while True:
        parts = -(-parts // FAN_IN)
        met = rest.repartition(parts, F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("source", "doc_id", "p")
        seed += 1
        if parts == 1:
            landed = met.mapInPandas(_fly(seed, True), SCHEMA)
            return decided.unionByName(cut_lineage(landed)).drop("part")
        flown = cut_lineage(met.mapInPandas(_fly(seed, False), SCHEMA))
        decided, rest = decided.unionByName(flown.filter(~undecided)), flown.filter(undecided)


def document_sizes(documents: DataFrame, targets: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents of the target sources; null texts have 0 tokens."""
    wanted = targets.select("source").distinct()
    return count_tokens(spread(documents.select("doc_id", "source", "text")).join(wanted, "source", "left_semi"), vocabulary_path=vocabulary_path).select("doc_id", "source", "n_tokens")


#: What a mixture keeps where a source falls short: the size of the corpus, or the shares.
KEEP = ("size", "shares")


def mixing_plan(sizes: DataFrame, targets: DataFrame, keep: str = "size") -> DataFrame:
    """For each target source: tokens it has and should give, expected copies of each document, feasibility.

    With ``keep="size"`` the mixture is as large as all documents of the target sources together, and a
    source that falls short leaves its place empty. With ``keep="shares"`` it is the largest mixture in
    which every source with a token and a share reaches its share. ``feasible`` is false where ``max_repeats``
    times the tokens of the source are fewer than its share of all documents. A source without documents
    has 0 tokens; a null share is 0, a null ``max_repeats`` 1.
    """
    if keep not in KEEP:
        raise ValueError(f"keep is one of {KEEP}")
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).dropDuplicates(["source"])
    plan = plan.join(have, "source", "left").na.fill(0, ["tokens", "docs"])
    reach = F.col("max_repeats") * F.col("tokens")
    held = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    total = plan.agg(F.sum("tokens").alias("all_tokens"), F.min(F.when(held, reach / F.col("target_share"))).alias("most"))
    plan = plan.crossJoin(F.broadcast(total))  # one row
    size = F.least("all_tokens", F.coalesce("most", "all_tokens")) if keep == "shares" else F.col("all_tokens")
    goal = F.col("target_share") * size
    return plan.select(
        "source", "target_share", "max_repeats", "tokens", "docs", "all_tokens", goal.alias("goal_tokens"),
        (reach >= F.col("target_share") * F.col("all_tokens")).alias("feasible"),
        F.when(F.col("tokens") > 0, F.least(goal / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("copies"),
    )


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary_path: str | None = None, seed: int = 7, keep: str = "size") -> tuple[DataFrame, DataFrame]:
    """The mixture (``source, doc_id, n_tokens, copies``) and the report of shares reached.

    Documents of sources without a target are left out. No document has more than ``max_repeats`` copies.
    ``keep`` is that of the plan; the report gives the share of the mixture and that of the corpus.
    """
    ship_package(documents.sparkSession)
    sizes = cut_lineage(document_sizes(documents, targets, vocabulary_path))
    plan = mixing_plan(sizes, targets, keep)
    planned = sizes.join(plan.select("source", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p")), "source")
    # the rows are read in the order of the checkpoint's files: a repeated task decides as the first did
    planned = cut_lineage(planned)
    sample = balanced_sample(planned.select("source", F.col("doc_id").cast("string"), "n_tokens", "p"), seed).withColumn("doc_id", F.col("doc_id").cast(planned.schema["doc_id"].dataType))
    whole = plan.select("source", F.floor("copies").alias("whole"))
    mixture = sample.join(whole, "source").select("source", "doc_id", "n_tokens", (F.col("whole") + F.round("p")).cast("int").alias("copies")).filter("copies > 0")
    used = mixture.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.sum("copies").alias("used_docs"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").na.fill(0, ["used_tokens", "used_docs", "most_copies"])
    report = report.crossJoin(F.broadcast(report.agg(F.sum("used_tokens").alias("mixed")))).select(
        "source", "target_share", "max_repeats", "tokens", "docs", "goal_tokens", "feasible", "used_tokens", "used_docs", "most_copies",
        F.when(F.col("mixed") > 0, F.col("used_tokens") / F.col("mixed")).otherwise(0.0).alias("actual_share"),
        F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("share_of_goal_size"), "all_tokens",
    )
    return mixture, report


def short_sources(documents: DataFrame, targets: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """The sources that cannot reach their share, by the report of the mixture: all copies they may give were used."""
    _, report = mix_sources(documents, targets, vocabulary_path)
    return report.filter(~F.col("feasible") & (F.col("used_tokens") < F.col("target_share") * F.col("all_tokens"))).select("source")
