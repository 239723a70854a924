"""State merging along time: runs of equal labels, absorption of short blocks, merging of similar neighbours.

Both merges restart from the left after each change, so their order is part of the result; a whole activity is one
group, and its blocks are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK_SCHEMA = (
    "activity_id long, block_id int, label int, start long, end long, length long, n_segments int, "
    "members array<long>, absorbed_labels array<int>, n_absorbed int, similar_merged boolean"
)


class Block(dict):
    @property
    def mean(self) -> np.ndarray:
        return self["sums"] / max(self["length"], 1)


def runs_of(rows: pd.DataFrame) -> list[Block]:
    """Blocks of equal consecutive labels; rows (id, start, length, label, features) in any order."""
    out: list[Block] = []
    for r in rows.sort_values(["start", "id"]).itertuples():
        f = np.asarray(r.features, float) * r.length
        if out and out[-1]["label"] == r.label:
            b = out[-1]
            b.update(end=r.start + r.length, length=b["length"] + r.length, sums=b["sums"] + f, members=[*b["members"], r.id])
        else:
            out.append(Block(label=int(r.label), start=r.start, end=r.start + r.length, length=r.length, sums=f, members=[r.id], absorbed=[], n_absorbed=0, similar=False))
    return out


def joined(left: Block, right: Block, label: int, kind: str) -> Block:
    """One block of two neighbours, under label; what the other label was is remembered."""
    other = [b for b in (left, right) if b["label"] != label]
    absorbed = left["absorbed"] + right["absorbed"] + [b["label"] for b in other]
    lost = sum(len(b["members"]) for b in other) if kind == "short" else 0
    return Block(
        label=label, start=left["start"], end=right["end"], length=left["length"] + right["length"], sums=left["sums"] + right["sums"], members=left["members"] + right["members"],
        absorbed=absorbed, n_absorbed=left["n_absorbed"] + right["n_absorbed"] + lost, similar=left["similar"] or right["similar"] or kind == "similar",
    )


def absorb_short(blocks: list[Block], least: float) -> list[Block]:
    """The leftmost block under least goes to its longer neighbour (the left one if equal), until none is left."""
    blocks = list(blocks)
    while len(blocks) > 1 and (at := next((i for i, b in enumerate(blocks) if b["length"] < least), None)) is not None:
        lone_right = at == 0 or at + 1 < len(blocks) and blocks[at + 1]["length"] > blocks[at - 1]["length"]
        a = at if lone_right else at - 1
        label = blocks[at + 1 if lone_right else at - 1]["label"]
        blocks[a : a + 2] = [joined(blocks[a], blocks[a + 1], label, "short")]
    return blocks


def merge_similar(blocks: list[Block], tolerance: float) -> list[Block]:
    """The leftmost neighbours of different labels (none noise) with means nearer than tolerance become one, under the
    label of the longer (the left one if equal), until none are left."""
    blocks = list(blocks)

    def near(i: int) -> bool:
        a, b = blocks[i], blocks[i + 1]
        return a["label"] != b["label"] and -1 not in (a["label"], b["label"]) and float(np.linalg.norm(a.mean - b.mean)) < tolerance

    while (at := next((i for i in range(len(blocks) - 1) if near(i)), None)) is not None:
        a, b = blocks[at], blocks[at + 1]
        blocks[at : at + 2] = [joined(a, b, a["label"] if a["length"] >= b["length"] else b["label"], "similar")]
    return blocks


def merged_activities(primitives: DataFrame, least_length: float = 15.0, tolerance: float = 2.0, similar: bool = True) -> DataFrame:
    """The final blocks of each activity of primitives (id, activity_id, start, length, label, features)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks = absorb_short(runs_of(rows), least_length)
        if similar:
            blocks = merge_similar(blocks, tolerance)
        return pd.DataFrame([
            {"activity_id": key[0], "block_id": i, "label": b["label"], "start": b["start"], "end": b["end"], "length": b["length"], "n_segments": len(b["members"]),
             "members": b["members"], "absorbed_labels": sorted(set(b["absorbed"])), "n_absorbed": b["n_absorbed"], "similar_merged": b["similar"]}
            for i, b in enumerate(blocks)
        ])

    return primitives.groupBy("activity_id").applyInPandas(run, BLOCK_SCHEMA)
