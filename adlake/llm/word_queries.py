"""The query of the spelling operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm import spelling
from adlake.llm.common import table
from adlake.llm.registry import registered


def misspelt(runs: DataFrame) -> DataFrame:
    """``word``: one run in 97, by checksum of ``<id>:<run>``, loses one of its letters."""
    run, checksum = F.col("run"), F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    at = F.pmod(F.col("checksum"), F.char_length("run")).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length("run")))
    return runs.select("run", checksum.alias("checksum")).select(
        F.when(F.col("checksum") % 97 == 0, without).otherwise(run).alias("word")
    )


@registered()
def op11_kd_tree_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and three uses or more, with their more frequent spelling."""
    runs = spelling.words_in(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.counted(misspelt(runs))).select(
        "word", "form", "root", "n", F.col("near").alias("n_near"), "form_n"
    )
