"""Problems 8, 9 and 10: token ids, packs, and texts that look the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .encoding import corpus_tokens, token_counts, token_ids
from .lookalike import look_members, look_pairs, text_forms, text_looks
from .packing import packed


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p8_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_tokens(p8_ids(spark, sf))


def p9_packs(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "pack_sizes").filter("pack_name is not null and capacity_tokens > 0")
    packs = sorted((r["pack_name"], r["c"]) for r in sizes.groupBy("pack_name").agg(F.min("capacity_tokens").alias("c")).collect())
    counts = cut(token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    return packed(counts, "doc_id", packs)


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Packs, tokens and share of used space of each pack size."""
    packs = p9_packs(spark, sf).filter("size > 0").groupBy("pack_name", "pack_no").agg(F.sum("size").alias("used"))
    sizes = table(spark, sf, "pack_sizes").groupBy("pack_name").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    per = packs.groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return per.join(sizes, "pack_name").select("pack_name", "packs", "tokens", "fullest", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 4).alias("used_share"))


def p9_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Of each pack size: pages packed, pieces that come twice, pages whose pieces don't follow each other, packs above the capacity."""
    sizes = table(spark, sf, "pack_sizes").groupBy("pack_name").agg(F.min("capacity_tokens").alias("capacity"))
    packs = cut(p9_packs(spark, sf))
    after = F.lead("token_from").over(Window.partitionBy("pack_name", "doc_id").orderBy("piece_no"))
    pieces = packs.withColumn("torn", after.isNotNull() & (after != F.col("token_from") + F.col("size")) | (F.col("piece_no") == 0) & (F.col("token_from") != 0))
    pages = pieces.groupBy("pack_name", "doc_id").agg((F.count("*") - F.countDistinct("piece_no")).alias("twice"), F.max("torn").alias("torn"))
    pages = pages.groupBy("pack_name").agg(F.count("*").alias("pages"), F.sum("twice").alias("twice"), F.count_if("torn").alias("torn"))
    loads = packs.groupBy("pack_name", "pack_no").agg(F.sum("size").alias("load")).join(sizes, "pack_name").groupBy("pack_name").agg(F.count_if(F.col("load") > F.col("capacity")).alias("too_full"))
    return pages.join(loads, "pack_name").select("pack_name", "pages", "twice", "torn", "too_full")


def _looks(spark: SparkSession, sf: str) -> DataFrame:
    return cut(text_looks(table(spark, sf, "documents"), "doc_id", "text"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_pairs(_looks(spark, sf), "doc_id")


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    return text_forms(table(spark, sf, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    return look_members(_looks(spark, sf), "doc_id")


QUERIES = {f.__name__: f for f in (p8_ids, p8_tokens, p9_packs, p9_fill, p9_pages, p10_found, p10_forms, p10_classes)}


# fixed values: letters and marks, and what they look like, one under the other
ALIKE = (
    "ΑАΒВСϹΕЕΗНΙІӀЈͿΚКΜМΝΟОΡРЅΤТΧХΥҮΖԌԚԜѴаϲсԁеһіϳјοоρрԛѕԝνѵхуүГПФѲӏ\u00a0\u2007\u202f\u2010\u2011\u2043\ufe63",
    "AABBCCEEHHIIIJJKKMMNOOPPSTTXXYYZGQWVaccdehijjooppqswvvxyyΓΠΦΘl   ----",
)


def _look_sql() -> str:
    """The look by the database's own composition: invisible characters out, letters and marks to one of each kind, ligatures spelled out."""
    alike = dict(zip(*ALIKE, strict=True)) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"\u3000": " "}
    alike = {c: alike.get(t, t) for c, t in alike.items()}
    text = "regexp_replace(text, '[\\p{Cf}]', '', 'g')"
    spelled = [("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl")]
    for c in map(chr, (*range(0x0370, 0x0530), *range(0x1F00, 0x2000))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in alike:
            plain = unicodedata.normalize("NFC", alike[parts[0]] + parts[1:])
            if len(plain) == 1:
                alike[c] = plain
            else:
                spelled.append((c, plain))
    for c, plain in spelled:
        text = f"replace({text}, '{c}', '{plain}')"
    source, target = "".join(alike), "".join(alike.values())
    return f"nfc_normalize(translate({text}, '{source.replace(chr(39), chr(39) * 2)}', '{target.replace(chr(39), chr(39) * 2)}'))"


SQL: dict[str, str] = {
    "p9_pages": "SELECT pack_name, count(DISTINCT doc_id) AS pages, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS too_full FROM documents CROSS JOIN (SELECT DISTINCT pack_name FROM pack_sizes) GROUP BY pack_name",
    "p10_found": f"""WITH looks AS (SELECT doc_id, text, {_look_sql()} AS look FROM documents WHERE text IS NOT NULL)
      SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p10_classes": f"""WITH looks AS (SELECT doc_id, text, {_look_sql()} AS look FROM documents WHERE text IS NOT NULL),
      per AS (SELECT look, min(doc_id) AS class_id, count(*) AS n_pages, count(DISTINCT text) AS n_texts FROM looks GROUP BY look) SELECT doc_id, class_id, n_pages, n_texts FROM looks JOIN per USING (look)""",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
