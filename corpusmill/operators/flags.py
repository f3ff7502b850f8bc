"""Per-page quality flags over fenced lines: expressions over each page's row, and one join with
the raw pages for the flag that compares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import heading_count, word_count
from corpusmill.operators.lines import page_lines, with_fences

FLAGS = ("GATE", "FIDELITY", "OTP", "BC", "FOOTER", "JINA", "SKIP", "COOKIE")


def page_flags(clean: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """clean (page_ord, content[, quality_gate_failed]), raw (page_ord, content) -> (page_ord, flags)."""
    gate = F.col("quality_gate_failed") if "quality_gate_failed" in clean.columns else F.lit(False)
    counted = clean.select("page_ord", "content", gate.alias("GATE"), heading_count(F.col("content")).alias("ch"), word_count(F.col("content")).alias("cw"))
    fenced = with_fences(page_lines(counted, "GATE", "ch", "cw"))
    outside = F.transform("ls", lambda s, i: F.struct(s["pos"].alias("pos"), s["line"].alias("line"), s["t"].alias("t"), F.lower(s["t"]).alias("low"), F.get(F.col("in_code"), i).alias("code")))
    lines = fenced.select("page_ord", "GATE", "ch", "cw", F.explode(F.array(outside)).alias("ls"))
    # blank lines neither count in a run of listed ones nor end it
    listed = F.array_join(F.transform("ls", lambda s: F.when(s["t"].rlike(r"^\d+\.\s+\[") & (F.length(s["t"]) < 100) & ~s["code"], "1").when(s["t"] == "", "b").otherwise("0")), "")
    half = F.floor(F.size("ls") / 2)

    def some(test):
        return F.exists("ls", lambda s: ~s["code"] & test(s))

    found = lines.select(
        "page_ord", "GATE", "ch", "cw",
        some(lambda s: s["low"].rlike("^on this page")).alias("OTP"),
        listed.rlike("1b*1b*1").alias("BC"),
        some(lambda s: (s["pos"] >= half) & s["low"].rlike("^last (modified|updated)")).alias("FOOTER"),
        some(lambda s: s["low"].startswith("title:") & ~s["line"].startswith("  ")).alias("JINA"),
        some(lambda s: s["low"].rlike("skip to (main )?content")).alias("SKIP"),
        some(lambda s: s["low"].rlike("(?<![a-z0-9_])cookie(?![a-z0-9_])") & (F.length(s["t"]) < 120)).alias("COOKIE"),
    )
    if raw is None:
        found = found.withColumn("FIDELITY", F.lit(False))
    else:
        source = raw.select("page_ord", heading_count(F.col("content")).alias("rh"), word_count(F.col("content")).alias("rw"))
        lost = (F.col("rh") >= 4) & (F.col("ch") < 0.4 * F.col("rh")) & (F.col("rw") > 0) & (F.col("cw") < 0.5 * F.col("rw"))
        found = found.join(source, "page_ord", "left").withColumn("FIDELITY", F.coalesce(lost, F.lit(False)))
    return found.select("page_ord", F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS])).alias("flags"))
