"""Text of a page from positioned items: lines, spaces, paragraphs and the offset of every item."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

LINE_TOLERANCE, MIN_TOLERANCE = 0.45, 2.0
PARAGRAPH_GAP = 1.65
SPACE_GAP, MIN_SPACE = 0.2, 1.0


def assign_lines(items: list[dict]) -> list[dict]:
    """Items with line_number from the top; an item joins the first line whose mean height on the page is near."""
    lines: list[dict] = []
    for item in sorted(items, key=lambda i: (-i["y"], i["x"], i["text"] or "")):
        text = " ".join((item["text"] or "").split())
        if not text:
            continue
        item = {**item, "text": text}
        near = next((ln for ln in lines if abs(ln["y"] - item["y"]) <= max(MIN_TOLERANCE, LINE_TOLERANCE * max(ln["height"], item["height"]))), None)
        if near is None:
            lines.append({"y": item["y"], "height": item["height"], "items": [item]})
        else:
            n = len(near["items"])
            near["items"].append(item)
            near["y"] = (near["y"] * n + item["y"]) / (n + 1)
            near["height"] = max(near["height"], item["height"])
    lines.sort(key=lambda ln: -ln["y"])
    return [{**item, "line_number": k, "line_y": ln["y"], "line_height": ln["height"]}
            for k, ln in enumerate(lines, 1) for item in sorted(ln["items"], key=lambda i: (i["x"], i["text"]))]


def assemble(items: list[dict]) -> tuple[str, list[dict]]:
    """(text of the page, items with start_character and end_character into it)."""
    text, out, before = "", [], None
    for item in assign_lines(items):
        if before is not None and item["line_number"] != before["line_number"]:
            wide = abs(before["line_y"] - item["line_y"]) > PARAGRAPH_GAP * max(before["line_height"], item["line_height"])
            text += "\n\n" if wide else "\n"
        elif before is not None:
            gap = item["x"] - (before["x"] + before["width"])
            if gap > max(MIN_SPACE, SPACE_GAP * before["width"] / len(before["text"])):
                text += " "
        start = len(text)
        text += item["text"]
        before = item
        out.append({**item, "start_character": start, "end_character": len(text)})
    return text, out


def assemble_pages(items: DataFrame) -> DataFrame:
    """Pages (page_key, text, n_items) from items (page_key, text, x, y, width, height).

    Pages are met in sorted partitions and pass one after the other; none is a Python group of its own.
    """
    names = ["page_key", "text", "x", "y", "width", "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in chain(batches, [None]):
            rows = held + batch.to_pylist() if batch is not None else held
            groups = [list(g) for _, g in groupby(rows, key=itemgetter("page_key"))]
            held = groups.pop() if groups and batch is not None else []  # the last page may go on in the next batch
            made = [(g[0]["page_key"], *assemble(g)) for g in groups]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], items_type), pa.array([m[1] for m in made], pa.string()),
                                                  pa.array([len(m[2]) for m in made], pa.int32())], names=["page_key", "text", "n_items"])

    kind = items.schema["page_key"].dataType
    items_type = to_arrow_type(kind)
    ordered = items.select(*names).repartition("page_key").sortWithinPartitions("page_key")
    return ordered.mapInArrow(run, f"page_key {kind.simpleString()}, text string, n_items int")


def offsets(lined: DataFrame) -> DataFrame:
    """Character offsets by window functions for items whose lines are known.

    In: page_key, line_number, line_y, line_height, x, width, text. Out: those and start_char, end_char.
    """
    order = Window.partitionBy("page_key").orderBy("line_number", "x", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("x") - (F.lag("x").over(order) + F.lag("width").over(order))
    space = gap > F.greatest(F.lit(MIN_SPACE), SPACE_GAP * F.lag("width").over(order) / F.length(F.lag("text").over(order)))
    wide = F.abs(F.lag("line_y").over(order) - F.col("line_y")) > PARAGRAPH_GAP * F.greatest(F.lag("line_height").over(order), F.col("line_height"))
    first = F.lag("line_number").over(order).isNull()
    new_line = F.lag("line_number").over(order) != F.col("line_number")
    sep = F.when(first, 0).when(new_line, F.when(wide, 2).otherwise(1)).otherwise(F.when(space, 1).otherwise(0))
    staged = lined.withColumn("sep", sep)
    end = F.sum(F.col("sep") + F.length("text")).over(running)
    return staged.withColumn("end_char", end.cast("int")).withColumn("start_char", (F.col("end_char") - F.length("text")).cast("int")).drop("sep")
