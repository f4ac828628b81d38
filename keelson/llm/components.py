"""Connected components of a link table by rounds of contraction; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import MULT, finish
from .tables import Work

#: Links that a task holds at once, beside a row for each of its vertices.
TASK_LINKS = 1 << 20
STARS = "id bigint, low bigint"


def stars_of(a: np.ndarray, b: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the first member of each one's component in the order of this turn)."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    with np.errstate(over="ignore"):
        order = np.argsort(finish((ids.astype(np.uint64) + np.uint64(turn)) * MULT), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    x, y = place[inv[: len(a)]], place[inv[len(a) :]]
    label = np.arange(len(ids))
    while True:
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            return ids, ids[order[label[place]]]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame, work: Work, name: str) -> DataFrame:
    """(id, label) of every id in links (a, b); label is one member of its component, the same for all.

    In a round each task joins its own links to components and names them by a member; a vertex that got several names,
    at most one a task, links the first to the others, and these links are the next round's. Names are the first in a
    random order that changes by round, so even long chains lose a constant share of their vertices in each round. A
    round is one job of two stages, whose width follows the data, and a flag; a hot vertex sends a row per task. At the
    end the names are looked up from the last round back.
    """
    edges = links.select("a", "b")
    rounds: list[DataFrame] = []
    while True:
        turn = len(rounds)

        def local(batches, turn=turn):
            held, size = [np.zeros((2, 0), np.int64)], 0
            for batch in batches:
                held.append(np.array([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
                size += batch.num_rows
                if size >= TASK_LINKS:
                    held, size = [np.array(stars_of(*np.concatenate(held, axis=1), turn))], 0
            ids, low = stars_of(*np.concatenate(held, axis=1), turn)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], ["id", "low"])

        stars = edges.mapInArrow(local, STARS).groupBy("id").agg(F.min("low").alias("low"), F.collect_set("low").alias("lows"))
        table = work.save(stars, f"{name}-{turn}")
        rounds.append(table)
        several = table.filter(F.size("lows") > 1)
        if not several.limit(1).count():
            break
        edges = several.select(F.col("low").alias("a"), F.explode("lows").alias("b")).filter("a <> b")
    labels = rounds[-1].select("id", F.col("low").alias("label"))
    for table in reversed(rounds[:-1]):
        later = labels.select(F.col("id").alias("_id"), "label")
        labels = table.select("id", "low").join(later, F.col("low") == F.col("_id"), "left").select("id", F.coalesce("label", "low").alias("label"))
    out = work.save(labels, name)
    work.drop(*[f"{name}-{k}" for k in range(len(rounds))])
    return out


def relabel(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links between the labels of their ends, without loops; ids that have no label are their own."""
    out = links
    for end in ("a", "b"):
        lab = labels.select(F.col("id").alias(end), F.col("label").alias("_l"))
        out = out.join(lab, end, "left").withColumn(end, F.coalesce("_l", end)).drop("_l")
    return out.filter("a <> b")
