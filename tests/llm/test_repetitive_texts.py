"""Repetitive items and texts, repeated rows and ties in benchmark decontamination."""

from __future__ import annotations

import random
import time

from fathomline.llm import decontaminate


def brute(items, docs):
    """Every item against every whole text."""
    out = []
    for d, t in docs:
        t = decontaminate.normalise(t)
        for i, x in items:
            x = decontaminate.normalise(x)
            budget = len(x) // decontaminate.CHARS_PER_EDIT
            if x and budget and (hit := decontaminate.distance(x, t, budget)):
                out.append((d, i, hit[0]))
    return sorted(out)


def test_repetitive_items_equal_brute_force(spark):
    rng = random.Random(8)
    unit = lambda: "".join(rng.choice("xy ") for _ in range(rng.randint(1, 4)))
    items = [(i, unit() * rng.randint(10, 30) + rng.choice(["", " tail of it", "zz"])) for i in range(25)]
    docs = []
    for d in range(60):
        t = list(unit() * rng.randint(0, 60) + rng.choice(items)[1] + unit() * 20)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyq ")
        docs.append((d // 2 * 2, "".join(t)))  # keys come twice
    docs += docs[:5]  # and rows
    items = [(i, t) for i, t in items if len(decontaminate.normalise(t)) >= decontaminate.CHARS_PER_EDIT]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.leaks(df, bench).collect())) == brute(items, docs)


def test_repetitive_item_is_linear():
    tail = "and a tail that is longer than all the edits which an item of this length may have, so that its repetitive part alone is not found"
    item = "xy " * 300 + tail
    block = decontaminate.Items([(1, decontaminate.normalise(item))])
    began = time.process_time()
    assert block.matches("xy " * 33_000) == []
    assert block.matches("xy " * 33_000 + tail)[0][:2] == (1, 0)
    assert time.process_time() - began < 20


def test_equal_items_and_places():
    block = decontaminate.Items([(i, decontaminate.normalise(t)) for i, t in ((1, "one two three four five six"), (2, "One, two three four five six!"))])
    assert block.matches("a one two three four five six b one two three four five six") == [(1, 0, 29), (2, 0, 29)]
