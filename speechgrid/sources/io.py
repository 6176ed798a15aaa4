"""Readers and stores: tolerant JSON lines, traces, job documents, keyed stores, media links, content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE_SCHEMA = T.StructType([
    T.StructField("t", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("call", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()), T.StructField("wall_s", T.DoubleType()),
    T.StructField("error", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("cache_read_tokens", T.LongType()),
    T.StructField("cache_creation_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])


def _objects(raw: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """The JSON objects among the texts ``value``: typed fields (NULL where a field is missing or of another type), the columns
    ``keep``, and ``__v``, the object itself. Texts that are no JSON, or no object, are left out."""
    v = F.try_parse_json("value")
    x = raw.withColumn("__v", v).filter(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")))
    return x.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), *keep, "__v").select("j.*", *keep, "__v")


def _json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.posexplode(F.split("value", "\r")).alias("part", "value"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return _objects(raw.select("value", F.struct("file", "split", "row", "part").alias("file_pos")), schema, "file_pos")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with torn lines and non-objects left out. Lines end at LF or CR (other separators are data). A field of another
    type than asked for is NULL, its row stays. ``file_pos`` keeps order inside a file: file path, split start, and the place in
    the split."""
    return _json_lines(spark, path, schema).drop("__v")


def read_trace(spark: SparkSession, path: str, schema: T.StructType = TRACE_SCHEMA) -> DataFrame:
    """Trace events whose time ``t`` is a JSON number; a quoted or boolean time is none."""
    t = F.try_variant_get("__v", "$.t", "variant")
    number = F.rlike(F.schema_of_variant(t), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    x = _json_lines(spark, path, schema).filter(number)
    return x.withColumn("t", F.try_variant_get("__v", "$.t", "double")).drop("__v")


def latest_by_key(df: DataFrame, key: list[str], order: list[str], match: dict | None = None) -> DataFrame:
    """The last row of each key among rows whose key is not NULL and whose ``match`` columns equal the values given. A maximum
    by order combines before the shuffle, so one hot key is no hot task."""
    x = df.filter(F.expr(" and ".join(f"`{k}` is not null" for k in key)))
    for c, v in (match or {}).items():
        x = x.filter(F.col(c).eqNullSafe(F.lit(v)))
    rest = [c for c in df.columns if c not in key]
    g = x.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*[F.col(c) if c in key else F.col(f"__r.`{c}`").alias(c) for c in df.columns])


def reuse_if_inputs_match(stored: DataFrame, today: DataFrame, key: list[str], inputs: list[str]) -> DataFrame:
    """Stored rows whose inputs (per key) equal today's, NULLs equal to NULLs."""
    a = stored.withColumn("__f", fingerprint(*inputs))
    b = today.select(*key, fingerprint(*inputs).alias("__f")).distinct()
    return a.join(b, [*key, "__f"], "left_semi").drop("__f")


def fingerprint(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def content_key(*cols: str, n: int = 20) -> Column:
    """The first ``n`` hex digits of the SHA-256 of the columns as a JSON array of strings."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in cols])), 256), 1, n)


def read_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job documents (one JSON object a file, a glob over the library); unreadable ones and non-objects left out, a field of
    another type NULL."""
    raw = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return _objects(raw, T._parse_datatype_string(schema), "file").drop("__v")


def explode_stages(jobs: DataFrame, key: list[str], stages: str = "stages") -> DataFrame:
    """One row per stage of a job's stage map: (key, stage, and the stage's fields)."""
    return jobs.select(*key, F.explode(stages).alias("stage", "__s")).select(*key, "stage", "__s.*")


# Hosts and forms of the media links accepted.
LINK_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com",
              "www.youtube-nocookie.com")
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
LINK_OFFSET = "^(?:(\\d+)h)?(?:(\\d+)m)?(?:(\\d+)s?)?$"
LINK_ID = "^[A-Za-z0-9_-]{11}$"
# End of fixed values.


def media_refs(df: DataFrame, url: str = "url") -> DataFrame:
    """Links with video_id, start_ms, is_short and error (empty, other_host, live, playlist, no_video; NULL when usable)."""
    raw = F.trim(F.coalesce(F.col(url), F.lit("")))
    u = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    x = df.withColumn("__u", u)
    x = x.withColumns({"__host": F.lower(F.regexp_extract("__u", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)),
                       "__parts": F.filter(F.split(F.regexp_extract("__u", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != ""),
                       "__q": F.concat(F.lit("&"), F.regexp_extract("__u", "\\?([^#]*)", 1))})

    def arg(name: str) -> Column:
        return F.nullif(F.regexp_extract("__q", f"&{name}=([^&]+)", 1), F.lit(""))

    off = F.trim(F.coalesce(arg("t"), arg("start"), F.lit("")))
    part = [F.coalesce(F.nullif(F.regexp_extract(off, LINK_OFFSET, k), F.lit("")).cast("bigint"), F.lit(0)) for k in (1, 2, 3)]
    p0, p1 = F.get("__parts", F.lit(0)), F.get("__parts", F.lit(1))
    short_host, host = F.col("__host").isin(*SHORT_HOSTS), F.col("__host").isin(*LINK_HOSTS)
    vid = F.when(short_host, p0).when(host & (p0 == "watch"), arg("v")).when(host & p0.isin("shorts", "embed", "v"), p1)
    bad = (F.when(raw == "", "empty").when(~short_host & ~host, "other_host").when(host & (p0 == "live"), "live")
           .when(host & (p0 == "playlist"), "playlist").when(vid.isNull() | ~F.rlike(vid, F.lit(LINK_ID)), "no_video"))
    x = x.withColumn("error", bad)
    ok = F.col("error").isNull()
    return x.select(*df.columns, F.when(ok, vid).alias("video_id"), F.when(ok, ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000).alias("start_ms"),
                    F.when(ok, F.coalesce(host & (p0 == "shorts"), F.lit(False))).alias("is_short"), "error")


def distinct_media(refs: DataFrame) -> DataFrame:
    """Usable links, one row per video with the earliest start and how many links name it."""
    return refs.filter("error is null").groupBy("video_id").agg(F.min("start_ms").alias("start_ms"), F.max("is_short").alias("is_short"), F.count("*").alias("links"))


def media_metadata(df: DataFrame) -> DataFrame:
    """description (trimmed), chapters (start, title; malformed ones left out) and distinct tags in order."""
    ch = F.transform(F.filter(F.coalesce("chapters", F.expr("cast(array() as array<struct<start_time:double,title:string>>)")),
                              lambda c: c["start_time"].isNotNull() & (F.trim(F.coalesce(c["title"], F.lit(""))) != "")),
                     lambda c: F.struct(c["start_time"].alias("start"), F.trim(c["title"]).alias("title")))
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))
    return df.withColumns({"description": F.trim(F.coalesce("description", F.lit(""))), "chapters": ch, "tags": tags})


def write_table(df: DataFrame, path: str, by: str = "media_id", buckets: int = 256, mode: str = "overwrite") -> None:
    """Parquet partitioned by a hash bucket of ``by``; only the buckets present are replaced. A hot key's bucket may be written
    by several tasks: rows are spread over it before the write, not gathered into one."""
    x = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    x.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
