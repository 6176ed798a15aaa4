"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import read
from .exact_dedup import exact_dedup
from .language import identify, learn
from .licenses import license_scan
from .neighbours import nearest_neighbours
from .packing import pack
from .pages import extract_main
from .pieces import piece_encode
from .quotes import reply_order
from .secrets import secret_scan
from .simhash import simhash_groups
from .spelling import spelling_variants
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


#: Lower case of A-Z only.
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_exact_dedup", f"""
    WITH d AS (SELECT doc_id, {LOW.format("coalesce(text, '')")} AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""")
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read(spark, folder, "documents"), keep="max")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(read(spark, folder, "documents"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(read(spark, folder, "documents"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(read(spark, folder, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


@query("op5_piece_encode")
def op5_piece_encode(spark: SparkSession, folder: str) -> DataFrame:
    return piece_encode(read(spark, folder, "documents"), full=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op4_pack")
def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))


def fold(parts: int):
    """The fold of a document by its id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def language_model(docs: DataFrame):
    """Learnt from the labelled rows outside the held-out fold."""
    return learn(docs.filter(fold(5) != 0))


@query("op1_language")
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = identify(docs, language_model(docs))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


@query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = quality.learn(docs, read(spark, folder, "labels").filter(fold(3) != 1))
    found = quality.quality_scores(docs, model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


@query("op2_nearest")
def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op6_reply_order")
def op6_reply_order(spark: SparkSession, folder: str) -> DataFrame:
    return reply_order(read(spark, folder, "conversations"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(read(spark, folder, "documents"), every=31)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    # at some millions of rows the exact sum no longer fits a long: then null, and whole in deviation_exact
    return whiten(read(spark, folder, "embeddings")).withColumns({"deviation": F.col("deviation").try_cast("long"), "deviation_exact": F.col("deviation")})


@query("op11_main_text")
def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main(read(spark, folder, "pages"))
