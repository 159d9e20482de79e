"""Which sentence a card shows, from the order of its fronts and backs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.text import seeded_pick
from glossaria.sources.scratch import fresh_folder


def _bucket(views: DataFrame, column: str) -> Column:
    """Stretches of a day, or of 86,400 of a number, in the order of ``column``."""
    return F.date_trunc("day", F.col(column)) if views.schema[column].dataType.typeName().startswith("timestamp") else F.floor(F.col(column) / 86_400)


def epochs(views: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds epoch to rows with side front or back: how many backs of the key came before. A back shows its front's
    sentence and then forgets it, so that a new epoch begins after it.

    Counts run within a stretch of the first order column and start from the sums of the stretches before, so that no
    task holds all views of a key.
    """
    back = F.when(F.col("side") == "back", 1).otherwise(0)
    placed = views.withColumn("_stretch", _bucket(views, order[0]))
    sums = placed.groupBy(key, "_stretch").agg(F.sum(back).alias("_backs"))
    earlier = F.sum("_backs").over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.sum(back).over(Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    counted = placed.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    joined = counted.join(sums, F.col(key).eqNullSafe(F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_of")))
    return joined.withColumn("epoch", (F.col("_before") + F.col("_inside")).cast("long")).select(*views.columns, "epoch")


def shown(views: DataFrame, notes: DataFrame, key: str = "key", seed: str = "", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Joins views with each key's sentence_list and adds chosen, the sentence of its epoch, which the first view of the
    epoch draws. Keys without views and views without notes give no rows; a key has one note here, keyed state in a
    stream takes several."""
    placed = epochs(views, key, order)
    draws = placed.groupBy(key, "epoch").agg(F.min_by("event_id", F.struct(*order)).alias("_drawn"))
    joined = placed.join(draws, [key, "epoch"]).join(notes, key)
    by = F.concat_ws("#", F.lit(seed), F.col(key).cast("string"), F.col("_drawn").cast("string"))
    return joined.withColumn("chosen", seeded_pick(F.col("sentence_list"), by)).drop("_drawn")


#: Views that one task runs through.
STRETCH = 200_000


def draw(options: list[str], seed: str, key: str, event_id: int) -> str | None:
    """The sentence that a view draws, as ``seeded_pick`` does; none from an empty list."""
    number = int(hashlib.md5(f"{seed}#{key}#{event_id}".encode()).hexdigest()[:8], 16)
    return options[number % len(options)] if options else None


class Run:
    """What a stretch of a key's views does to the key's state, whatever that was before.

    A front keeps a stored sentence that is among the view's and else draws one; a back does the same and then forgets it.
    So all states that the first view doesn't list end alike, and only its own sentences have to be followed besides:
    ``other`` is where all states but these have come to, ``kept`` where each of these has, as long as it is elsewhere.
    That is a function of the state before, and functions of following stretches are composed by looking one up in the
    next.
    """

    def __init__(self, key: str | None):
        self.key, self.kept, self.other, self.begun = key, {}, None, False

    def view(self, event_id: int, side: str, options: list[str], seed: str) -> tuple[str | None, dict[str, str | None]]:
        """The sentence shown, and those shown instead if the stretch began with another state."""
        if not self.begun:
            self.kept, self.begun = {s: s for s in options}, True
        drawn, listed = draw(options, seed, self.key, event_id), set(options)
        after = lambda s: s if s in listed else drawn
        self.other = after(self.other)
        self.kept = {s: t for s, now in self.kept.items() if (t := after(now)) != self.other}
        shown = self.other, self.kept
        if side == "back":
            self.other, self.kept = None, {}
        return shown


_RUN = "kept map<string,string>, other string"


def _stretches(views: DataFrame, seed: str, order: tuple[str, ...], stretch: int) -> DataFrame:
    """Views with the sentence that each shows (``default``), the one it shows instead by what was stored before its
    stretch (``instead``), the stretch's number, and on the last view of a key in a stretch the stretch's function (run)."""
    spark, columns = views.sparkSession, views.columns
    n = max(1, math.ceil(views.count() / stretch))
    dealt = views.repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order).withColumn("stretch", F.spark_partition_id())

    def run_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, held = None, None
        for rows in batches:
            default, instead = [], []
            runs: list[dict | None] = [None] * len(rows)
            for i, (key, event_id, side, sentences) in enumerate(zip(rows["key"], rows["event_id"], rows["side"], rows["sentences"], strict=True)):
                if run is None or run.key != key:
                    if run is not None:
                        if i:
                            runs[i - 1] = {"kept": run.kept, "other": run.other}
                        else:
                            held["run"] = [{"kept": run.kept, "other": run.other}]
                    run = Run(key)
                shown, others = run.view(event_id, side, [] if sentences is None else list(sentences), seed)
                default.append(shown)
                instead.append(dict(others))
            out = rows.assign(default=default, instead=instead, run=runs)
            if held is not None:
                yield held
            held = out.iloc[-1:].copy()
            yield out.iloc[:-1]
        if held is not None:
            held["run"] = [{"kept": run.kept, "other": run.other}]
            yield held

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    path = fresh_folder(spark, "stretches")
    done = dealt.mapInPandas(run_through, f"{kinds}, default string, instead map<string,string>, run struct<{_RUN}>")
    done.write.parquet(path)  # so that no second run deals views into other stretches
    return spark.read.schema(done.schema).parquet(path).select(*columns, "stretch", "default", "instead", "run")


def replayed(views: DataFrame, seed: str = "", order: tuple[str, ...] = ("ts", "event_id"), stretch: int = STRETCH) -> DataFrame:
    """``views`` (key, event_id, side, sentences, the columns of ``order``) with ``chosen``, the sentence each shows.

    ``sentences`` are those of the view's own note at that time, so that several notes of one word, whose lists differ,
    share their state, and lists may change. A stored sentence is kept while it is among the view's; else the view draws
    one. A null key is a key, null lists are empty ones, and views of equal order are taken in any one order.

    Views are dealt into stretches by key and order, so that a hot key is in many. Each stretch becomes a function of the
    state before it; the functions of keys that go over several stretches are composed in order, one small row for each,
    and what they give picks among the outcomes that the stretches have noted. Only one pass reads the views in order.
    """
    rows = _stretches(views, seed, order, stretch)
    runs = rows.where("run is not null").select("key", "stretch", "run")
    several = runs.groupBy(F.col("key").alias("_several")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")  # a border of stretches splits one key at most
    spread = runs.join(F.broadcast(several), F.col("key").eqNullSafe(F.col("_several"))).select("key", "stretch", "run")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        state, before = None, []
        rows = rows.sort_values("stretch")
        for run in rows["run"]:
            before.append(state)
            state = dict(run["kept"]).get(state, run["other"])
        return pd.DataFrame({"_key": rows["key"], "_stretch": rows["stretch"], "_before": before})

    key_kind = views.schema["key"].dataType.simpleString()
    before = spread.groupBy("key").applyInPandas(compose, f"_key {key_kind}, _stretch int, _before string").where("_before is not null")
    joined = rows.join(F.broadcast(before), F.col("key").eqNullSafe(F.col("_key")) & (F.col("stretch") == F.col("_stretch")), "left")
    chosen = F.when(F.map_contains_key("instead", F.coalesce("_before", F.lit(""))) & F.col("_before").isNotNull(), F.element_at("instead", F.coalesce("_before", F.lit("")))).otherwise(F.col("default"))
    return joined.select(*views.columns, chosen.alias("chosen"))
