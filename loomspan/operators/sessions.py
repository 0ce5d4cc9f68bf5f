"""Session-level metadata: ids, ages, weights, days from an event, performance and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_id(user: str, mouse: str, day: str, num: str) -> Column:
    return F.format_string("session_%s_M%03d_%s_%02d", F.col(user), F.col(mouse), F.date_format(day, "yyyy-MM-dd"), F.col(num))


def age_days(dob: str, at: str) -> Column:
    return F.datediff(at, dob)


def weight_threshold(surgery: DataFrame, weight: DataFrame, key: list[str], rel: float = 0.85) -> DataFrame:
    """``key, threshold``: weight on the date of the latest surgery times ``rel``; null without a weight of that day."""
    last = surgery.groupBy(key).agg(F.max_by(F.to_date("surgery_date"), "surgery_num").alias("date_of_weight"))
    return last.join(weight, [*key, "date_of_weight"], "left").select(*key, (F.col("weight") * rel).alias("threshold"))


def below_threshold(weight: DataFrame, threshold: DataFrame, key: list[str]) -> DataFrame:
    return weight.join(threshold, key).where("weight < threshold")


def relative_weight(weight: DataFrame, threshold: DataFrame, key: list[str], rel: float = 0.85) -> DataFrame:
    return weight.join(threshold, key).withColumn("relative", F.col("weight") / (F.col("threshold") / rel))


def days_from(sessions: DataFrame, events: DataFrame, key: list[str], day: str, event_day: str, out: str = "days") -> DataFrame:
    return sessions.join(events.select(*key, event_day), key).withColumn(out, F.datediff(day, event_day)).drop(event_day)


def normalise_days(df: DataFrame, key: list[str], day: str = "days", out: str = "norm") -> DataFrame:
    """Sessions before the event are ranked backwards, -1, -2, ...; equal days share a rank; days from 0 on stay."""
    w = Window.partitionBy(*key, F.col(day) < 0).orderBy(F.col(day).desc())
    return df.withColumn(out, F.when(F.col(day) < 0, -F.rank().over(w)).otherwise(F.col(day)))


def performance(trials: DataFrame, key: list[str], successful: str = "successful") -> DataFrame:
    return trials.groupBy(key).agg(F.avg(F.col(successful).cast("int")).alias("performance"))


def phase(perf: str, days: str, norm: str, thr: float = 0.8) -> Column:
    p, d, n = F.col(perf), F.col(days), F.col(norm)
    return F.when((p >= thr) & (d <= 0) & (n >= -3), "Expert").when(d <= 0, "Learning").when(d <= 10, "Early").when(d > 7, "Late")


def side(hand: str, handedness: str) -> Column:
    return F.when(F.col(hand) == F.col(handedness), "ipsi").otherwise("contra")


def hemisphere(roi: str, side_of_lesion: str) -> Column:
    """From the last part of the ROI's name, _L or _R."""
    return F.when(F.element_at(F.split(roi, "_"), -1) == F.col(side_of_lesion), "ipsi").otherwise("contra")


def select_sessions(catalog: DataFrame, days: list[int] | None = None, phases: list[str] | None = None, groups: list[str] | None = None, min_id: int | None = None) -> DataFrame:
    for column, values in (("days", days), ("phase", phases), ("stroke_group", groups)):
        if values is not None:
            catalog = catalog.where(F.col(column).isin(values))
    return catalog.where(F.col("mouse_id") >= min_id) if min_id is not None else catalog


def imaged_sessions(sessions: DataFrame, day: str = "days", skip: tuple[int, ...] = (8, 10, 15, 17, 22, 24)) -> DataFrame:
    return sessions.where(~F.col(day).isin(list(skip)))


def dataset_info(sessions: DataFrame, phases: dict[str, str], groups: dict[str, str], group_order: list[str]) -> DataFrame:
    """Phase and group labels replaced, with the group's rank in an explicit order."""
    out = sessions.replace(phases, subset=["phase"]).replace(groups, subset=["stroke_group"])
    at = F.array_position(F.lit(group_order), F.col("stroke_group"))
    return out.withColumn("group_rank", F.when(at > 0, at - 1))
