"""Run state over page results (url, status, error, flags, ...): roll-ups, resume, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import round_to

SECRETS = ("api_key", "base_url", "model", "token")


def manifest(results: DataFrame, config: dict[str, str]) -> DataFrame:
    """M1: one JSON row; secret settings are left out."""
    kept = {k: v for k, v in config.items() if k not in SECRETS}
    settings = F.create_map(*[F.lit(x) for p in kept.items() for x in p]) if kept else F.create_map().cast("map<string,string>")
    gathered = results.agg(F.sort_array(F.collect_list(F.struct(*results.columns))).alias("pages"))
    return gathered.select(F.to_json(F.struct(settings.alias("config"), "pages")).alias("value"))


def save_manifest(one: DataFrame, path: str) -> None:
    """M2: the commit protocol makes the write atomic."""
    one.coalesce(1).write.mode("overwrite").text(path)


def quality_summary(results: DataFrame) -> DataFrame:
    """M3: (ok, clean, clean_percent); 100 without ok pages."""
    r = results.filter("status = 'ok'").agg(F.count(F.lit(1)).alias("ok"), F.count_if(F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0).alias("clean"))
    return r.select("ok", "clean", F.when(F.col("ok") == 0, F.lit(100.0)).otherwise(round_to(F.col("clean") * 100.0 / F.col("ok"), 1)).alias("clean_percent"))


def flag_counts(results: DataFrame) -> DataFrame:
    return results.filter("status = 'ok'").select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def exclusions(results: DataFrame) -> DataFrame:
    """M4: failures by reason, most first."""
    return results.filter("status <> 'ok'").groupBy(F.coalesce("error", F.lit("Unknown error")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def exclusion_breakdown(reasons: DataFrame) -> DataFrame:
    """M4 as text, one row: most frequent reason first, ties by name. Reasons are few kinds."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason")))
    return reasons.agg(F.array_join(F.transform(listed, lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["reason"])), ", ").alias("breakdown"))


def resume_state(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: (done, pending)."""
    return results.filter("status = 'ok'"), results.filter("status <> 'ok'")


def upsert(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """M6: rows of url fetched again are replaced. Where several pages share an address, key names
    what tells them apart, so that a page's result does not replace another's."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def inspect(results: DataFrame) -> DataFrame:
    """M7: counts and percentages by status."""
    total = results.agg(F.count(F.lit(1)).alias("total"))  # one row
    by = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0).alias("flagged"))
    return by.crossJoin(F.broadcast(total)).select("status", "n", "flagged", round_to(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def attach_flags(results: DataFrame, flags: DataFrame) -> DataFrame:
    """M8."""
    return results.drop("flags").join(flags.select("slug", "flags"), "slug", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def run_name(url):
    """M9: the host's first label that is neither www nor docs, with the path's first segment."""
    host = F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^((www|docs)\.)+", "")
    first = F.get(F.array_remove(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), ""), F.lit(0))
    return F.concat_ws("-", F.split(host, r"\.")[0], first)
