"""News articles: cleaning, keep-first de-duplication, dates, mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_to_local_midnight, parse_us_datetime
from ..functions.text import has_min_words, mentioned_currencies, truncate_chars
from ..session import materialize

ARTICLE_COLUMNS = ["Title", "Date", "Full Text", "URL"]


def dedup_keep_first(df: DataFrame, key: str, ordinal: str = "ordinal",
                     partition: Sequence[str] = ("source",)) -> DataFrame:
    """Keep the first row (lowest ``ordinal``) per ``key`` within ``partition``.

    NULL keys compare equal (one NULL row survives).  Skew-safe: the first
    ordinal per key is found with a partially-combined ``min`` aggregate
    (a key shared by a third of the rows collapses to one row per task), and
    the survivors are selected by a semi join on the unique (partition,
    ordinal) pair, never on the hot key itself.
    """
    part = list(partition)
    first = df.groupBy(*part, F.col(f"`{key}`").alias("_key")).agg(F.min(ordinal).alias(ordinal))
    return df.join(first.select(*part, ordinal), on=[*part, ordinal], how="left_semi")


def clean_articles(df: DataFrame, min_words: int = 20, max_chars: int = 32767,
                   dedup_keys: Sequence[str] = ("Full Text", "Title", "URL"),
                   ordinal: str = "ordinal", partition: Sequence[str] = ("source",),
                   keep: Sequence[str] = ()) -> DataFrame:
    """Filter short texts, de-duplicate sequentially on each key, then truncate.

    The sequential passes run on a narrow key table (partition, ordinal and a
    SHA-256 of each key), materialised once; only the surviving (partition,
    ordinal) pairs are semi-joined back, so the article text is read twice,
    not once per pass.
    """
    cols = [*partition, ordinal, *keep, *ARTICLE_COLUMNS]
    out = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(cols)])
    out = out.where(has_min_words(F.col("`Full Text`"), min_words))
    names = [f"_k{i}" for i in range(len(dedup_keys))]
    keys = out.select(*partition, ordinal,
                      *[F.sha2(F.col(f"`{k}`").cast("string"), 256).alias(n) for k, n in zip(dedup_keys, names)])
    keys = materialize(keys)
    for n in names:
        keys = dedup_keep_first(keys, n, ordinal, partition)
    out = out.join(keys.select(*partition, ordinal), on=[*partition, ordinal], how="left_semi")
    return out.withColumn("Full Text", truncate_chars(F.col("`Full Text`"), max_chars))


def normalise_dates(df: DataFrame, style: str = "iso", col: str = "Date") -> DataFrame:
    """``iso``: offset timestamp -> New York midnight; ``us``: 'Published m/d/Y, h:mm AM'."""
    if style == "iso":
        expr = iso_to_local_midnight(F.col(col))
    elif style == "us":
        expr = parse_us_datetime(F.col(col))
    else:
        raise ValueError(f"unknown date style {style!r}")
    return df.withColumn(col, expr)


def with_mentions(df: DataFrame, synonyms: dict[str, list[str]] | None = None,
                  text: str = "Full Text", out: str = "mentioned_currencies",
                  word_boundary: bool = False, drop_empty: bool = True) -> DataFrame:
    res = df.withColumn(out, mentioned_currencies(F.col(f"`{text}`"), synonyms, word_boundary))
    return res.where(F.size(out) > 0) if drop_empty else res


def land_articles(spark, sources: dict[str, str]) -> DataFrame:
    """CSV files of each source (quoted fields may span lines) -> the article columns, ``source`` and ``ordinal``.

    ``ordinal`` is (file, position in it).  A file is read by one task in its order; ids that grow with the rows of a
    task become positions by taking off the file's first.  The rows are written to the shared folder
    once, before the ids are used, so all later plans see the same numbers; read that instead of CSV again."""
    frames = []
    for src, path in sources.items():
        raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
               .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        cols = [F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ARTICLE_COLUMNS]
        frames.append(raw.select(F.lit(src).alias("source"), *cols, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")))
    landed = frames[0]
    for f in frames[1:]:
        landed = landed.unionByName(f)
    landed = materialize(landed)
    first = landed.groupBy("_file").agg(F.min("_row").alias("_first"))  # one row per file
    position = F.struct(F.col("_file").alias("file"), (F.col("_row") - F.col("_first")).alias("position"))
    return landed.join(first, "_file").withColumn("ordinal", position).drop("_file", "_row", "_first")


def read_articles(spark, sources: dict[str, str], date_styles: dict[str, str] | None = None) -> DataFrame:
    """Land, clean and union the sources; each source's dates by its style (``iso`` unless named)."""
    styles = {s: (date_styles or {}).get(s, "iso") for s in sources}
    if bad := set(styles.values()) - {"iso", "us"}:
        raise ValueError(f"unknown date style {sorted(bad)!r}")
    out = clean_articles(land_articles(spark, sources))
    us = [s for s, style in styles.items() if style == "us"]
    iso = iso_to_local_midnight(F.when(~F.col("source").isin(us), F.col("Date")))
    return out.withColumn("Date", F.coalesce(iso, parse_us_datetime(F.when(F.col("source").isin(us), F.col("Date")))))


def date_window(df: DataFrame, lo, hi, col: str = "Date") -> DataFrame:
    """Half-open range ``[lo, hi)``."""
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi)))
