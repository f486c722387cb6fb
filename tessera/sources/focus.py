"""Focus modes: their JSON, normalised."""

from __future__ import annotations

import contextlib
import json
import os
import urllib.parse

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import options as O
from tessera.functions.scalars import trim_space
from tessera.schemas import FOCUS_MODES

_LISTS = ("keywords", "folders", "include_urls", "exclude_keywords", "exclude_urls")


def normalise(spark: SparkSession, text: str | None) -> tuple[DataFrame, str]:
    """(modes, default id) of a JSON text; bad JSON counts as an empty configuration.

    Entries that are no objects or have a blank id go; ids are lower-cased and
    the first of equal ones stays; lists keep their trimmed non-blank strings;
    mode all is put in front where it is missing; an unknown default is all.
    """
    raw = spark.createDataFrame([(text,)], "text string").select(F.try_parse_json("text").alias("config"))
    entries = spark.sql("SELECT e.pos, e.value AS entry FROM {raw}, LATERAL variant_explode(try_variant_get(config, '$.modes', 'variant')) AS e", raw=raw)
    entries = entries.where("schema_of_variant(entry) LIKE 'OBJECT%'")

    def strings(field: str) -> Column:
        typed = F.expr(f"transform(try_variant_get(entry, '$.{field}', 'array<variant>'), v -> IF(schema_of_variant(v) = 'STRING', try_variant_get(v, '$', 'string'), NULL))")
        kept = F.filter(F.transform(typed, trim_space), lambda s: s != "")
        return F.coalesce(kept, F.array().cast("array<string>")).alias(field)

    key = F.lower(trim_space(F.expr("try_variant_get(entry, '$.id', 'string')")))
    label = F.coalesce(F.nullif(F.expr("try_variant_get(entry, '$.label', 'string')"), F.lit("")), trim_space(F.expr("try_variant_get(entry, '$.id', 'string')")))
    modes = entries.select(key.alias("id"), label.alias("label"), F.expr("try_variant_get(entry, '$.description', 'string')").alias("description"), *map(strings, _LISTS), F.col("pos").alias("pos"))
    modes = modes.where("id <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("_n = 1").drop("_n")
    whole = spark.createDataFrame([(*O.ALL_MODE, [], [], [], [], [], -1)], FOCUS_MODES)
    modes = modes.unionByName(whole.join(modes.where("id = 'all'"), "id", "left_anti"))
    given = raw.select(F.lower(trim_space(F.expr("try_variant_get(config, '$.default_mode', 'string')"))).alias("d")).first().d
    known = given and modes.where(F.col("id") == given).limit(1).count()
    return modes.orderBy("pos"), given if known else "all"


def load(spark: SparkSession, path: str, create: bool = True) -> tuple[DataFrame, str]:
    """The configuration at path; a bad one is empty, a missing one is written with the defaults where that can be done."""
    try:
        text = spark.read.text(path, wholetext=True).first()
        return normalise(spark, text.value if text else None)
    except PySparkException:
        if create:
            _write(spark, path, default_text())
        return normalise(spark, default_text())


def default_text() -> str:
    """The configuration where there is none: the mode of all bookmarks."""
    key, label, description = O.ALL_MODE
    lists = {name: [] for name in _LISTS}
    return json.dumps({"default_mode": key, "modes": [{"id": key, "label": label, "description": description, **lists}]}, ensure_ascii=False, indent=2)


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Hadoop reaches; one that exists, or can't be written, is left alone."""
    url = urllib.parse.urlsplit(path)
    if url.scheme in ("", "file"):  # by hand, as Hadoop's would come with a checksum that an editor's changes break
        with contextlib.suppress(OSError):
            os.makedirs(os.path.dirname(os.path.abspath(url.path)), exist_ok=True)
            with open(url.path, "x", encoding="utf-8") as file:
                file.write(text)
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Py4JJavaError):
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()


def choose(modes: DataFrame, wanted: str | None, default: str) -> DataFrame:
    """The wanted mode, else the default, else the first: one row."""
    prio = F.when(F.col("id") == (wanted or "").lower(), 0).when(F.col("id") == default, 1).otherwise(2)
    return modes.orderBy(prio, "pos").limit(1)


def mode_options(modes: DataFrame, active: str) -> DataFrame:
    return modes.select("id", "label", "description", (F.col("id") == active).alias("is_active"), "pos")


def example(**lists: list[str]) -> str:
    """JSON of a configuration with one mode, for callers that have none yet."""
    return json.dumps({"default_mode": "all", "modes": [{"id": "focus", "label": "Focus", **lists}]})
