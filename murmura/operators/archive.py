"""Archived channels: parsing, replay statistics, cleaning and a text graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions.scores import archive_debate_score
from murmura.operators.ranks import numbered
from murmura.scratch import materialize


def newest(messages: DataFrame, limit: int = C.ARCHIVE_LIMIT) -> DataFrame:
    """The newest messages of a channel, oldest first."""
    return messages.orderBy(F.desc("ts"), F.desc("message_id")).limit(limit).orderBy("ts", "message_id")


def replayed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``message`` to the lines that have a bracket end and, after it, an author mark; others go."""
    t = F.col(line)
    close, colon = F.instr(t, "] "), F.instr(t, ": ")
    return lines.where((close > 0) & (colon > close)).withColumn("message", F.expr(f"substring({line}, instr({line}, ': ') + 2)"))


PATTERN = r"\A\[(.*?)\]\s+(.*?):\s+(.*?)\z"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds time, author and message as text; null where the line is blank or has another form."""
    t = F.rtrim(F.col(line))
    fits = t.rlike(PATTERN)
    return lines.withColumns({name: F.when(fits, F.regexp_extract(t, PATTERN, i + 1)) for i, name in enumerate(("time", "author", "message"))})


def scored_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the debate score (null for lines of another form) and ``kept``."""
    out = parsed(lines, line).withColumn("score", F.when(F.col("message").isNotNull(), archive_debate_score(F.col("message"))))
    return out.withColumn("kept", F.coalesce(F.col("score") <= C.ARCHIVE_CUT, F.lit(True)))


def cleaning_report(scored: DataFrame) -> DataFrame:
    """One row: lines, kept and removed messages, and the removed share of all lines in percent."""
    return scored.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("kept") & F.col("score").isNotNull()).alias("kept"),
        F.count_if(~F.col("kept")).alias("removed"),
    ).withColumn("removed_percent", F.when(F.col("lines") > 0, F.round(F.col("removed") / F.col("lines") * 100, 1)).otherwise(0.0))


def removed_samples(scored: DataFrame, order: str, n: int = 10) -> DataFrame:
    return scored.where("not kept").orderBy(order).limit(n)


def order_statistics(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean, median, population deviation, quartiles, range between them and maximum per key.

    A quartile is the value at rank ``floor(q * (n - 1))``, without
    interpolation.  All values are ranked once, by ranges: a key may have any
    number of values, and equal ones are split as well.
    """
    v = F.col(value)
    figures = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.greatest(F.lit(0.0), F.max(v)).alias("maximum"))
    rows = df.where(v.isNotNull()).select(*keys, v.alias("_v")).withColumn("_tie", F.monotonically_increasing_id())
    ranked = materialize(numbered(rows, [*[F.col(k) for k in keys], F.col("_v"), F.col("_tie")], "_r").drop("_tie"), "ranked")
    spans = ranked.groupBy(*keys).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    last = F.col("_n") - 1
    wanted = {"q1": F.floor(last * 0.25), "low": F.floor(last / 2), "high": F.ceil(last / 2), "q3": F.floor(last * 0.75)}
    places = spans.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_which"), (F.col("_first") + at).alias("_r")) for k, at in wanted.items()])).alias("_p")).select("_p.*")
    found = ranked.join(places, "_r").groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == k, F.col("_v"))).alias(k) for k in wanted])
    found = found.withColumn("median", (F.col("low") + F.col("high")) / 2).drop("low", "high")
    return figures.join(found, keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def sampled(df: DataFrame, keys: list[str], order: list[str], width: int = C.GRAPH_COLUMNS) -> DataFrame:
    """Every k-th row of each key for a graph, with ``k = floor(n / width)``, the first row included."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.least(F.lit(width), F.col("_n"))))
    return rows.where(F.col("position") % step == 0).drop("_n")


# The captions, rules and signs of the printed graph.
GRAPH_TITLE = "Heat  │"
GRAPH_MARGIN = "      │"
GRAPH_CORNER = "      └"
GRAPH_RULE = "─"
GRAPH_DOT = "●"
GRAPH_AXIS = "       0{last:>{width}} (Message #)"


def line_graph(values: list[float], rows: int = C.GRAPH_ROWS) -> str:
    """A text graph: a column for each value, a dot at its share of the largest, every fifth of the rows labelled."""
    v = np.asarray(values, float)
    if not len(v):
        return ""
    top = v.max()
    depth = np.clip((1 - (v / top if top > 0 else v * 0)) * (rows - 1), 0, rows - 1).astype(int)
    labels = {row: f"{top * (1 - row / rows):5.2f} │" for row in range(0, rows, max(1, rows // 5))}
    picture = [labels.get(row, GRAPH_MARGIN) + "".join(np.where(depth == row, GRAPH_DOT, " ")) for row in range(rows)]
    axis = GRAPH_AXIS.format(last=len(v) - 1, width=max(1, len(v) - 2))
    return "\n".join([GRAPH_TITLE, *picture, GRAPH_CORNER + GRAPH_RULE * len(v), axis])
